"""The motif planner: an ordered edge pattern becomes a chain of equi-joins on (graph, node) with band conditions on time.

``prepare`` deals the log by graph once; in a session of ``one_shuffle`` every join and anti-join of the chain reuses that
partitioning, since it holds the graph in every key. Its columns can't be null, so nothing is pushed below that exchange for one
leg of the chain alone, and all legs read the same one. Each step checks order and window at once, and each absent edge is an
anti-join as soon as both its nodes are bound, so partial matches die early. A chain is one SQL text, analysed once.

A graph is one task's work then. ``routed`` measures the log and plans graphs beyond ``UNIT_EVENTS`` apart:

* in time bins as wide as the window, where no bin is too large: every event is in its own bin and in the one before, an
  instance belongs to the bin of its first event, and (graph, bin) takes the graph's place in every key, so a long log with a
  hub is as many tasks as it has bins. Connected pairs that an absent edge may meet go to the bins of the end that has fewer.
* else, or without a window, by (graph, node) join by join, where Spark splits skewed nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.plans import catalog
from chronomotif.sources.tables import cut


#: Events of a graph, or of a bin, that one task matches.
UNIT_EVENTS = 100_000
#: Events that a task matches where graphs are small, so that tasks follow the log: it sorts up to 25 kB of partial matches for each.
TASK_EVENTS = 20_000
#: A log of so few bytes has no graph beyond a task; it isn't measured.
SMALL_BYTES = 4 << 20


@dataclass
class Prepared:
    """``directed``: distinct add events (graph_id, s, d, t), both ways. ``static``: distinct node pairs (graph_id, lo, hi).

    ``binned``: both have a column bin too, events a column own, true in the bin of their time.
    """

    directed: DataFrame
    static: DataFrame
    binned: bool = False


def one_shuffle(spark: SparkSession, broadcasts: bool = True) -> SparkSession:
    """A session with the settings of ``spark`` in which joins on (graph, node) may use a partitioning by graph alone; ``spark`` is left as it is.

    ``broadcasts``: False for logs that rows explode to; Spark takes them for as small as those rows, and would send them through the driver.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own.conf.set("spark.sql.requireAllClusterKeysForDistribution", "false")
    own.conf.set("spark.sql.unionOutputPartitioning", "false")  # else a task has the same graphs of all branches, one chain after another
    if not broadcasts:
        own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    return own


def adds_of(te: DataFrame) -> DataFrame:
    """(graph_id, lo, hi, t) of add events; self-loops are no edges, rows with nulls go."""
    adds = te.where((F.col("op") == "a") & (F.col("u") != F.col("v")) & F.col("graph_id").isNotNull() & F.col("t").isNotNull())
    return adds.select(_sure(te, "graph_id", F.col("graph_id")), _sure(te, "u", F.least("u", "v"), "lo"), _sure(te, "u", F.greatest("u", "v"), "hi"), _sure(te, "t", F.col("t")))


def tasks_for(events: int | None) -> int:
    return max(1, -(-(events or 0) // TASK_EVENTS))


def prepare(te: DataFrame, large_graphs: bool = False, tasks: int | None = None) -> Prepared:
    """Add events only, undirected, distinct; deletions never undo a connection, self-loops are no edges. Rows with nulls go.

    Graphs are dealt to ``tasks``; None: to as many as the session's settings give.
    """
    adds = adds_of(te)
    if not large_graphs:
        adds = adds.repartition(tasks, "graph_id") if tasks else adds.repartition("graph_id")
    ways = F.explode(F.array(F.struct(F.col("lo").alias("s"), F.col("hi").alias("d")), F.struct(F.col("hi").alias("s"), F.col("lo").alias("d"))))
    return Prepared(adds.distinct().select("graph_id", "t", ways.alias("w")).select("graph_id", "w.s", "w.d", "t"), adds.select("graph_id", "lo", "hi").distinct())


def in_bins(te: DataFrame, width: int, tasks: int | None = None) -> Prepared:
    """The log in time bins, for windows up to ``width``. Times below 0 begin no instance and are left out. ``tasks`` as in ``prepare``."""
    dealt_out = lambda df: df.repartition(tasks, "graph_id", "bin") if tasks else df.repartition("graph_id", "bin")
    place = lambda b, own: F.struct(b.alias("bin"), F.lit(own).alias("own"))
    at = F.floor(F.col("t") / width).cast("bigint")
    adds = adds_of(te).where("t >= 0").distinct()
    dealt = adds.select("graph_id", "lo", "hi", "t", F.explode(F.array(place(at, True), place(at - 1, False))).alias("b")).where("b.bin >= 0")
    dealt = dealt_out(dealt.select("graph_id", F.coalesce("b.bin", F.lit(0)).alias("bin"), "lo", "hi", "t", F.coalesce("b.own", F.lit(False)).alias("own")))
    ways = F.explode(F.array(F.struct(F.col("lo").alias("s"), F.col("hi").alias("d")), F.struct(F.col("hi").alias("s"), F.col("lo").alias("d"))))
    directed = dealt.select("graph_id", "bin", "own", "t", ways.alias("w")).select("graph_id", "bin", "own", "w.s", "w.d", "t")
    nodes = directed.select("graph_id", "bin", F.col("s").alias("node")).distinct()
    often = nodes.groupBy("graph_id", "node").agg(F.count("*").alias("bins"))
    pairs = adds_of(te).select("graph_id", "lo", "hi").distinct()
    for end in ("lo", "hi"):  # pairs with an end in no bin can't meet an instance
        pairs = pairs.join(often.select("graph_id", F.col("node").alias(end), F.col("bins").alias(f"{end}_bins")), ["graph_id", end])
    rarer = pairs.select("graph_id", "lo", "hi", F.when(F.col("lo_bins") <= F.col("hi_bins"), F.col("lo")).otherwise(F.col("hi")).alias("node"))
    met = rarer.join(nodes, ["graph_id", "node"]).withColumn("other", F.when(F.col("node") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")))
    static = met.join(nodes.withColumnRenamed("node", "other"), ["graph_id", "bin", "other"], "left_semi")
    return Prepared(directed, dealt_out(static.select("graph_id", "bin", "lo", "hi")), True)


def is_small(df: DataFrame) -> bool:
    """Whether the whole of it is a task's work by Spark's own estimate of its bytes, which is huge where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES


def routed(te: DataFrame, window: int | None = None, unit_events: int | None = None) -> list[Prepared]:
    """The log in parts that have every instance of motifs of at most this ``window`` between them, once; None or 0: no window.

    One part where no graph has more than ``unit_events`` add events; larger graphs make one or two more.
    """
    if unit_events is None:
        if is_small(te):
            return [prepare(te)]
        unit_events = UNIT_EVENTS
    adds = adds_of(te)
    sizes = adds.groupBy("graph_id").agg(F.count("*").alias("_n"))
    over = F.when(F.col("_n") > unit_events, F.col("_n"))
    most, events, of_large = sizes.agg(F.max("_n"), F.sum("_n"), F.sum(over)).first()
    if (most or 0) <= unit_events:
        return [prepare(te, tasks=tasks_for(events))]
    large = cut(sizes.where(F.col("_n") > unit_events).select("graph_id"), "large-graphs")
    parts = [prepare(te.join(large, "graph_id", "left_anti"), tasks=tasks_for(events - of_large))]
    wide = large
    if window and window > 0:
        bins = adds.join(large, "graph_id", "left_semi").groupBy("graph_id", F.floor(F.col("t") / window).alias("_b")).agg(F.count("*").alias("_n"))
        wide = cut(bins.groupBy("graph_id").agg(F.max("_n").alias("_n")).where(F.col("_n") > unit_events).select("graph_id"), "wide-graphs")
        parts.append(in_bins(te.join(large, "graph_id", "left_semi").join(wide, "graph_id", "left_anti"), window, tasks_for(2 * of_large)))
    if wide is large or not wide.isEmpty():
        parts.append(prepare(te.join(wide, "graph_id", "left_semi"), large_graphs=True))
    return parts


def _sure(te: DataFrame, like: str, value: Column, name: str | None = None) -> Column:
    """A column that can't be null, as the filter before it made sure; its type is that of ``like``."""
    return F.coalesce(value, F.lit(0).cast(te.schema[like].dataType)).alias(name or like)


def within(first: Column, last: Column, window: int, op: str) -> Column:
    if window <= 0:
        return F.lit(True)
    return (last - first <= window) if op == "le" else (last - first < window)


def absent(df: DataFrame, static: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose nodes a and b are not connected."""
    edge = static.select(F.col("graph_id").alias("_g"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    on = (F.col("graph_id") == F.col("_g")) & (F.least(a, b) == F.col("_lo")) & (F.greatest(a, b) == F.col("_hi"))
    return df.join(edge, on, "left_anti")


def chain(edges: list[tuple[int, int]], window: int, window_op: str = "le", mode: str = "induced", identity: bool = False, gap: int | None = None, binned: bool = False) -> tuple[str, int, int]:
    """(SQL over {directed} and {static}, nodes, events) of the join chain of ``instances``."""
    kept = [e for i, e in enumerate(edges) if i != gap]
    k = catalog.n_nodes(edges)
    missing = catalog.non_edges(kept, k) if mode == "induced" else []
    node: dict[int, str] = {}
    joins: list[str] = []
    same = lambda x: f"{x}.graph_id = e0.graph_id" + (f" AND {x}.bin = e0.bin" if binned else "")

    def anti() -> None:
        for a, b in [x for x in missing if x[0] in node and x[1] in node]:
            missing.remove((a, b))
            x = f"x{a}{b}"
            joins.append(f"LEFT ANTI JOIN {{static}} {x} ON {same(x)} AND {x}.lo = least({node[a]}, {node[b]}) AND {x}.hi = greatest({node[a]}, {node[b]})")

    for i, (a, b) in enumerate(kept):
        on = [same(f"e{i}"), f"e{i}.t > e{i - 1}.t"]
        if window > 0:
            on.append(f"e{i}.t - e0.t {'<=' if window_op == 'le' else '<'} {window}")
        new = {}
        for x, column in ((a, f"e{i}.s"), (b, f"e{i}.d")):
            if x in node:
                on.append(f"{node[x]} = {column}")
            else:
                on += [f"{other} <> {column}" for other in node.values()]
                new[x] = column
        joins.append(f"{{directed}} e{i}" if i == 0 else f"JOIN {{directed}} e{i} ON " + " AND ".join(on))
        node |= new
        anti()
    for x in range(k):
        if x not in node:  # a node whose only edge was left out
            on = [f"y{x}.graph_id = e0.graph_id", *[f"{other} <> y{x}.s" for other in node.values()]]
            joins.append(f"JOIN (SELECT DISTINCT graph_id, s FROM {{directed}}) y{x} ON " + " AND ".join(on))
            node[x] = f"y{x}.s"
            anti()
    where = ["e0.t > -1", *(["e0.own"] if binned else []), *([f"{c} < {k}" for c in node.values()] if identity else [])]
    columns = ["e0.graph_id", *[f"{node[x]} AS n{x}" for x in range(k)], *[f"e{i}.t AS t{i}" for i in range(len(kept))]]
    return f"SELECT {', '.join(columns)} FROM {' '.join(joins)} WHERE {' AND '.join(where)}", k, len(kept)


def instances(p: Prepared, edges: list[tuple[int, int]], window: int, window_op: str = "le", mode: str = "induced", identity: bool = False, gap: int | None = None) -> DataFrame:
    """(graph_id, n0.., t0..): one row an instance. ``mode``: induced or monomorphism. ``identity``: nodes are 0..k-1.

    ``gap`` names an edge that is left out: it isn't matched, but its nodes are (missing-edge fragments); its pair must be absent.
    """
    if p.binned and gap is not None:
        raise ValueError("a node of a missing edge may be in no bin")
    query, _, n_events = chain(edges, window, window_op, mode, identity, gap, p.binned)
    tables = {"directed": p.directed} | ({"static": p.static} if "{static}" in query else {})
    df = p.directed.sparkSession.sql(query, **tables)
    if gap is None and loose_pair(edges):
        times = [F.col(f"t{i}") for i in range(n_events)]
        ends = [F.struct(F.least(f"n{a}", f"n{b}"), F.greatest(f"n{a}", f"n{b}")) for a, b in edges]
        df = df.withColumn("_events", F.array_sort(F.array(*[F.struct(t.alias("t"), e.alias("e")) for t, e in zip(times, ends, strict=True)]))).dropDuplicates(["graph_id", "_events"]).drop("_events")
    return df


def large_enough(p: Prepared, edges: list[tuple[int, int]]) -> DataFrame:
    """(graph_id) of graphs with as many nodes and connected pairs as the pattern has; the others can't hold it."""
    pairs = len({(min(e), max(e)) for e in edges})
    nodes = F.count_distinct(F.col("n"))
    ends = p.static.select("graph_id", F.explode(F.array("lo", "hi")).alias("n"))
    sizes = ends.groupBy("graph_id").agg(nodes.alias("_n"), (F.count("*") / 2).alias("_e"))
    return sizes.where((F.col("_n") >= catalog.n_nodes(edges)) & (F.col("_e") >= pairs)).select("graph_id")


def pruned(p: Prepared, edges: list[tuple[int, int]]) -> Prepared:
    """Only the graphs that are ``large_enough``."""
    some = large_enough(p, edges)
    return Prepared(p.directed.join(some, "graph_id", "left_semi"), p.static.join(some, "graph_id", "left_semi"), p.binned)


def loose_pair(edges: list[tuple[int, int]]) -> bool:
    """Whether two nodes are joined to each other alone, so that swapping them gives the same events again."""
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return any(len(near[a]) == 1 and len(near[b]) == 1 for a, b in edges)


def instances_sql(edges: list[tuple[int, int]], window: int, window_op: str = "le", mode: str = "induced", identity: bool = False) -> str:
    """DuckDB SQL for ``instances`` over te, as one plain join with NOT EXISTS (written apart from the DataFrame plan)."""
    where: dict[int, str] = {}
    conditions = ["e0.t > -1"]
    for i, (a, b) in enumerate(edges):
        if i:
            conditions += [f"e{i}.graph_id = e0.graph_id", f"e{i}.t > e{i - 1}.t"]
            if window > 0:
                conditions.append(f"e{i}.t - e0.t {'<=' if window_op == 'le' else '<'} {window}")
        for node, column in ((a, f"e{i}.s"), (b, f"e{i}.d")):
            if node in where:
                conditions.append(f"{column} = {where[node]}")
            else:
                conditions += [f"{column} <> {other}" for other in where.values()]
                where[node] = column
    if mode == "induced":
        conditions += [f"NOT EXISTS (SELECT 1 FROM directed x WHERE x.graph_id = e0.graph_id AND x.s = {where[a]} AND x.d = {where[b]})" for a, b in catalog.non_edges(edges)]
    if identity:
        conditions += [f"{c} < {len(where)}" for c in where.values()]
    columns = ", ".join(["e0.graph_id", *[f"{where[n]} AS n{n}" for n in sorted(where)], *[f"e{i}.t AS t{i}" for i in range(len(edges))]])
    return f"SELECT {columns} FROM {', '.join(f'directed e{i}' for i in range(len(edges)))} WHERE {' AND '.join(conditions)}"


def completions_sql(edges: list[tuple[int, int]], window: int, reach: int = 10, longest: int = 1000) -> str:
    """DuckDB SQL for all single edges that complete an induced instance: (graph_id, missing, lo, hi, t_add), times below ``longest``."""
    parts = []
    for gap, (a, b) in enumerate(edges):
        kept = [e for i, e in enumerate(edges) if i != gap]
        where: dict[int, str] = {}
        conditions, tables = ["e0.t > -1"], []
        for i, (x, y) in enumerate(kept):
            tables.append(f"directed e{i}")
            if i:
                conditions += [f"e{i}.graph_id = e0.graph_id", f"e{i}.t > e{i - 1}.t"]
                if window > 0:
                    conditions.append(f"e{i}.t - e0.t <= {window}")
            for node, column in ((x, f"e{i}.s"), (y, f"e{i}.d")):
                if node in where:
                    conditions.append(f"{column} = {where[node]}")
                else:
                    conditions += [f"{column} <> {other}" for other in where.values()]
                    where[node] = column
        for node in range(catalog.n_nodes(edges)):
            if node not in where:
                tables.append(f"(SELECT DISTINCT graph_id, s FROM directed) z{node}")
                conditions += [f"z{node}.graph_id = e0.graph_id", *[f"z{node}.s <> {other}" for other in where.values()]]
                where[node] = f"z{node}.s"
        conditions += [f"NOT EXISTS (SELECT 1 FROM directed x WHERE x.graph_id = e0.graph_id AND x.s = {where[x]} AND x.d = {where[y]})" for x, y in catalog.non_edges(kept, catalog.n_nodes(edges))]
        last = f"e{len(kept) - 1}.t"
        if gap == 0:
            times = [f"y.t >= greatest(e0.t - {reach}, 0)", "y.t < e0.t", f"{last} - y.t <= {window}"]
        elif gap == len(kept):
            times = [f"y.t = {last} + 1", f"y.t - e0.t <= {window}"]
        else:
            times = [f"y.t > e{gap - 1}.t", f"y.t < least(e{gap}.t, e{gap - 1}.t + {reach})", f"{last} - e0.t <= {window}"]
        inner = ", ".join(["e0.graph_id", f"least({where[a]}, {where[b]}) AS lo", f"greatest({where[a]}, {where[b]}) AS hi", "y.t AS t_add"])
        parts.append(f"SELECT DISTINCT graph_id, {gap} AS missing, lo, hi, CAST(t_add AS INT) AS t_add FROM (SELECT {inner} FROM {', '.join(tables)}, (SELECT unnest(range(0, {longest})) AS t) y WHERE {' AND '.join(conditions + times)})")
    return " UNION ALL ".join(parts)


DIRECTED_SQL = """directed AS (SELECT DISTINCT graph_id, u AS s, v AS d, t FROM te WHERE op = 'a' UNION SELECT DISTINCT graph_id, v AS s, u AS d, t FROM te WHERE op = 'a')"""
