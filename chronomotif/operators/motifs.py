"""Motif queries: presence, counts, first times, instances, missing edges; each keyed by graph_id.

``te`` is a table of temporal edges (graph_id, seq, u, v, t, op); a graph may be of any size. Forms for several motifs match all
of them in one chain of joins (``plans.shared``). Reported sentinels of the compat forms are fixed values.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomotif.plans import catalog, shared
from chronomotif.plans.motif import Prepared, absent, instances, loose_pair, pruned, routed, within

NO_INSTANCE = 0x3F3F3F3F


def found(te: DataFrame, motif: str | list, window: int | None = None, window_op: str = "le", mode: str = "induced", identity: bool = False, which: str = "default", p: Prepared | None = None, prune: bool = False, unit_events: int | None = None) -> DataFrame:
    """Instances of a catalog motif (by name) or of ordered edges. ``prune``: graphs too small for it are left out first.

    Graphs of any size: ``routed`` plans those beyond ``unit_events`` apart, unless ``p`` is given.
    """
    edges, w = _edges(motif), _window(motif, window, which)
    parts = [p] if p else routed(te, w, unit_events)
    return reduce(DataFrame.unionByName, [instances(pruned(x, edges) if prune and not x.binned else x, edges, w, window_op, mode, identity) for x in parts])


def _edges(motif: str | list) -> list[tuple[int, int]]:
    return catalog.EDGES[motif] if isinstance(motif, str) else motif


def _window(motif: str | list, window: int | None, which: str) -> int:
    return window if window is not None else catalog.WINDOWS[which][motif]


def _shared(te: DataFrame, motifs: dict[str, tuple[list, int]], kind: str, window_op: str, mode: str, unit_events: int | None) -> DataFrame:
    """(graph_id, motif_name, n_instances or first_time) by one plan for all motifs (edges, window)."""
    windows = [w for _, w in motifs.values()]
    widest = 0 if min(windows) <= 0 else max(windows)
    node = te.schema["u"].dataType.simpleString()
    parts = []
    for p in routed(te, widest, unit_events):
        text = shared.query(motifs, window_op, mode, kind, p.binned, node)
        parts.append(p.directed.sparkSession.sql(text, **({"directed": p.directed} | ({"static": p.static} if "{static}" in text else {}))))
    return reduce(DataFrame.unionByName, parts)


def graphs(te: DataFrame) -> DataFrame:
    return te.select("graph_id").distinct()


def count(te: DataFrame, motif, plan: str = "rows", **options) -> DataFrame:
    """(graph_id, n_instances) of graphs with at least one instance.

    ``plan``: rows finds every instance and counts them; summed adds up partial matches with the same open ends, for logs where
    instances are far more than events (not for ``identity``, ``prune`` or patterns whose prefixes aren't connected).
    """
    if plan == "summed":
        return _of_one(te, motif, "count", **options).select("graph_id", "n_instances")
    return found(te, motif, **options).groupBy("graph_id").agg(F.count("*").alias("n_instances"))


def _of_one(te: DataFrame, motif, kind: str, window: int | None = None, window_op: str = "le", mode: str = "induced", which: str = "default", unit_events: int | None = None) -> DataFrame:
    edges = _edges(motif)
    if not _sharable(edges):
        raise ValueError("a pattern whose prefixes aren't connected has no summed plan")
    return _shared(te, {"motif": (edges, _window(motif, window, which))}, kind, window_op, mode, unit_events)


def _sharable(edges: list[tuple[int, int]]) -> bool:
    return shared.canonical(edges) is not None and not loose_pair(edges)


def judge(te: DataFrame, motif, plan: str = "rows", **options) -> DataFrame:
    """(graph_id, answer): Yes or No for every graph. ``plan``: rows finds every instance; first keeps, of partial matches with the same open ends and last time, the one that began last."""
    yes = _of_one(te, motif, "first", **options).select("graph_id") if plan == "first" else found(te, motif, **options).select("graph_id").distinct()
    return graphs(te).join(yes.withColumn("_y", F.lit(True)), "graph_id", "left").select("graph_id", F.when(F.col("_y"), "Yes").otherwise("No").alias("answer"))


def first_time(te: DataFrame, motif, compat: bool = False, plan: str = "rows", **options) -> DataFrame:
    """(graph_id, first_time): the least time at which an instance is complete. ``compat``: all graphs, with sentinels. ``plan`` as in ``judge``."""
    if plan == "first":
        out = _of_one(te, motif, "first", **options).select("graph_id", "first_time")
    else:
        df = found(te, motif, **options)
        last = max(int(c[1:]) for c in df.columns if c[0] == "t")
        out = df.groupBy("graph_id").agg(F.min(f"t{last}").alias("first_time"))
    if not compat:
        return out
    adds = te.groupBy("graph_id").agg(F.count_if(F.col("op") == "a").alias("_a"))
    return adds.join(out, "graph_id", "left").select("graph_id", F.when(F.col("_a") == 0, 0).otherwise(F.coalesce("first_time", F.lit(NO_INSTANCE))).cast("int").alias("first_time"))


def _all(te: DataFrame, motifs, kind: str, window_op: str = "le", mode: str = "induced", which: str = "default", unit_events: int | None = None) -> DataFrame:
    """One plan for all motifs, by names or a dictionary of (edges, window) by name."""
    own = motifs if isinstance(motifs, dict) else {m: (catalog.EDGES[m], catalog.WINDOWS[which][m]) for m in motifs}
    alone = {m: x for m, x in own.items() if not _sharable(x[0])}
    options = {"window_op": window_op, "mode": mode, "unit_events": unit_events}
    parts = [_shared(te, some, kind, **options)] if (some := {m: x for m, x in own.items() if m not in alone}) else []
    for m, (edges, w) in alone.items():
        one = count if kind == "count" else first_time
        rows = one(te, edges, window=w, **options)
        parts.append(rows.select("graph_id", F.lit(m).alias("motif_name"), rows.columns[-1]))
    return reduce(DataFrame.unionByName, parts)


def multi_judge(te: DataFrame, motifs=tuple(catalog.NAMES), window_op: str = "lt", **options) -> DataFrame:
    """(graph_id, motifs): sorted names of the motifs present, joined by commas; every graph."""
    rows = _all(te, motifs, "first", window_op, **options)
    names = rows.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_set("motif_name")), ",").alias("motifs"))
    return graphs(te).join(names, "graph_id", "left").select("graph_id", F.coalesce("motifs", F.lit("")).alias("motifs"))


def multi_count(te: DataFrame, motifs=tuple(catalog.NAMES), **options) -> DataFrame:
    """(graph_id, motif_name, n_instances) without zeros."""
    return _all(te, motifs, "count", **options).select("graph_id", "motif_name", "n_instances")


def multi_first_time(te: DataFrame, motifs=tuple(catalog.NAMES), **options) -> DataFrame:
    """(graph_id, motif_name, first_time) of the motifs present."""
    return _all(te, motifs, "first", **options).select("graph_id", "motif_name", "first_time")


def completions(te: DataFrame, motif, window: int | None = None, mode: str = "induced", reach: int = 10, which: str = "default", unit_events: int | None = None) -> DataFrame:
    """(graph_id, missing, lo, hi, t_add): every single edge that completes an instance of which one edge is missing.

    Times: before the first event from ``reach`` back (not below 0); between neighbours, less than ``reach`` after the
    earlier one; one after the last. The span stays within the window.
    """
    edges = catalog.EDGES[motif] if isinstance(motif, str) else motif
    w = window if window is not None else catalog.WINDOWS[which][motif]
    routes = routed(te, None, unit_events)
    parts = []
    last = len(edges) - 2
    for p, (gap, (a, b)) in product(routes, enumerate(edges)):
        df = instances(p, edges, w, "le", mode, gap=gap)
        if mode != "induced":
            df = absent(df, p.static, f"n{a}", f"n{b}")
        if gap == 0:
            times = F.when(F.col("t0") > 0, F.sequence(F.greatest(F.col("t0") - reach, F.lit(0)), F.col("t0") - 1))
            first, end = F.col("t_add"), F.col(f"t{last}")
        elif gap == len(edges) - 1:
            times = F.array(F.col(f"t{last}") + 1)
            first, end = F.col("t0"), F.col("t_add")
        else:
            before, after = F.col(f"t{gap - 1}"), F.least(F.col(f"t{gap}"), F.col(f"t{gap - 1}") + reach)
            times = F.when(after - before > 1, F.sequence(before + 1, after - 1))
            first, end = F.col("t0"), F.col(f"t{last}")
        df = df.withColumn("t_add", F.explode(times)).where(within(first, end, w, "le"))
        parts.append(df.select("graph_id", F.lit(gap).alias("missing"), F.least(f"n{a}", f"n{b}").alias("lo"), F.greatest(f"n{a}", f"n{b}").alias("hi"), "t_add").distinct())
    return reduce(DataFrame.unionByName, parts)  # no two parts have both a graph and a gap in common


def modify(te: DataFrame, motif, **options) -> DataFrame:
    """(graph_id, missing, t_add, lo, hi): the least completion by (missing, t_add, lo, hi)."""
    best = completions(te, motif, **options).groupBy("graph_id").agg(F.min(F.struct("missing", "t_add", "lo", "hi")).alias("b"))
    return best.select("graph_id", "b.*")
