"""Seeded generators of temporal graphs, as tables: nothing is drawn on the driver, every draw is a hash of its key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronomotif.functions.rng import rnd, rnd_sql, whole
from chronomotif.operators import motifs
from chronomotif.plans import catalog
from chronomotif.plans.motif import DIRECTED_SQL, instances_sql, one_shuffle, prepare, tasks_for
from chronomotif.sources.tables import cut, uncut


#: Node pairs that a task draws from.
TASK_PAIRS = 500_000


def param_grid(spark: SparkSession, times: list[int], nodes: list[int], ps: list[float], n_seeds: int) -> DataFrame:
    """(graph_id, T, N, p, seed, folder): the product of all parameters with seeds 0 and up."""
    one = lambda name, kind, values: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    grid = one("T", "int", times).crossJoin(one("N", "int", nodes)).crossJoin(one("p", "double", ps))  # parameters, a few rows each
    return _named(grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1))).alias("seed")))


def _named(seeds: DataFrame) -> DataFrame:
    """Parameter rows of (T, N, p, seed)."""
    folder = F.format_string("T%d_N%d_p%.1f_seed%d", "T", "N", "p", "seed")
    return seeds.select(F.xxhash64("T", "N", "p", "seed").alias("graph_id"), "T", "N", "p", "seed", folder.alias("folder"))


def _ordered(te: DataFrame, *order) -> DataFrame:
    seq = F.row_number().over(W.partitionBy("graph_id").orderBy(*order)) - 1
    return te.select("graph_id", seq.alias("seq"), "u", "v", "t", "op")


def er_events(params: DataFrame) -> DataFrame:
    """Random graphs: every node pair with probability p, added at a uniform time; half of those that can be are deleted later."""
    g, u, v, t = (F.col(c) for c in ("graph_id", "u", "v", "T"))
    pairs = params.select("*", F.explode(F.sequence(F.lit(0), F.col("N") - 2)).alias("u")).select("*", F.explode(F.sequence(u + 1, F.col("N") - 1)).alias("v"))
    pairs = pairs.where(rnd("p", g, u, v) < F.col("p")).withColumn("ta", whole(rnd("t", g, u, v), t))
    gone = (rnd("d", g, u, v) < 0.5) & (F.col("ta") < t - 1)
    td = F.col("ta") + 1 + whole(rnd("e", g, u, v), t - 1 - F.col("ta"))
    events = F.array(F.struct(F.col("ta").alias("t"), F.lit("a").alias("op")), F.when(gone, F.struct(td.cast("int").alias("t"), F.lit("d").alias("op"))))
    rows = pairs.select("graph_id", "u", "v", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("graph_id", "u", "v", "e.t", "e.op")
    return _ordered(rows, "t", "op", "u", "v")


def _place(params: DataFrame, edges: list[tuple[int, int]], window: int, p_remap: float = 1.0) -> DataFrame:
    """One instance a graph: increasing times inside the window, nodes shifted by a draw with ``p_remap``."""
    g = F.col("graph_id")
    start = whole(rnd("s", g), F.greatest(F.col("T") - window + 1, F.lit(1)))
    slots = F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda x: F.struct(rnd("w", g, x).alias("r"), x.alias("x")))
    times = F.array_sort(F.transform(F.slice(F.array_sort(slots), 1, len(edges)), lambda s: s["x"]))
    shift = F.when(rnd("rm", g) < p_remap, whole(rnd("n", g), F.col("N"))).otherwise(0)
    node = lambda k: ((F.lit(k) + shift) % F.col("N")).cast("int")
    rows = F.array(*[F.struct(node(a).alias("u"), node(b).alias("v"), (start + F.element_at(times, i + 1)).alias("t"), F.lit(i).alias("i")) for i, (a, b) in enumerate(edges)])
    return params.select("*", F.explode(rows).alias("e")).select("graph_id", F.col("T").alias("horizon"), "e.u", "e.v", "e.t", "e.i")


def _sampled(df: DataFrame, keys: list[str], n, *salt) -> DataFrame:
    """Of each group of ``keys`` the first ``n`` rows by a draw: sampling without replacement. ``n`` is a number or a column."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(rnd(*salt), *[c for c in df.columns if c not in keys]))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def _deletes(adds: DataFrame, params: DataFrame, keys: list[str], left: Column, salt: str) -> DataFrame:
    """``left`` of a graph's adds, sampled, with a delete each at a time from the last add on."""
    g = [F.col(k) for k in keys]
    ends = adds.groupBy(*keys).agg(F.max("t").alias("_end"))
    drawn = _sampled(adds.join(params.select("graph_id", F.col("T").alias("_horizon"), "M"), "graph_id").withColumn("_n", left), keys, F.col("_n"), salt, *g, F.col("u"), F.col("v"), F.col("t"))
    drawn = drawn.join(ends, keys)
    t = F.col("_end") + whole(rnd(salt + "t", *g, F.col("u"), F.col("v"), F.col("t")), F.greatest(F.col("_horizon") - F.col("_end"), F.lit(1)))
    return drawn.select(*keys, "u", "v", t.cast("int").alias("t"), F.lit("d").alias("op"))


def _with_events(params: DataFrame, n_events: int | None) -> DataFrame:
    return params if n_events is None else params.withColumn("M", F.lit(n_events))


def contain_positive(params: DataFrame, motif: str, n_events: int | None = None, which: str = "contain") -> DataFrame:
    """Logs of M events (``n_events``, or a column of ``params``) with a planted instance.

    Two thirds of the other events are adds of distinct pairs of other nodes, the rest deletes of any adds from the last add on.
    Rows with fewer nodes, events or time steps than the instance needs, or too few free pairs, give no log.
    """
    edges, window = catalog.EDGES[motif], catalog.WINDOWS[which][motif]
    k, n, g = catalog.n_nodes(edges), len(edges), F.col("graph_id")
    params = _with_events(params, n_events).withColumn("_more", F.expr(f"2 * (M - {n}) div 3"))
    free = F.expr(f"(N - {k}) * (N - {k} - 1) div 2")
    params = params.where((F.col("N") >= k) & (F.col("M") >= n) & (F.col("T") >= n) & (free >= F.col("_more")))
    nodes = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.col("N") - 1), lambda x: F.struct(rnd("n", g, x).alias("r"), x.alias("x")))), lambda s: s["x"])
    start = whole(rnd("s", g), F.greatest(F.lit(0), F.col("T") - window - 2) + 1)
    slots = F.transform(F.sequence(F.lit(0), F.least(F.col("T") - F.col("_start"), F.lit(window)) - 1), lambda x: F.struct(rnd("w", g, x).alias("r"), x.alias("x")))
    times = F.array_sort(F.transform(F.slice(F.array_sort(slots), 1, n), lambda s: s["x"]))
    placed = params.withColumn("_start", start).withColumn("_nodes", nodes).withColumn("_times", times).where(F.size("_times") == n)
    node = lambda x: F.col("_nodes")[x]
    rows = F.array(*[F.struct(node(a).alias("u"), node(b).alias("v"), (F.col("_start") + F.col("_times")[i]).cast("int").alias("t")) for i, (a, b) in enumerate(edges)])
    planted = placed.select("graph_id", F.explode(rows).alias("e")).select("graph_id", "e.*")
    rest = F.slice("_nodes", F.lit(k + 1), F.greatest(F.col("N") - k, F.lit(0)))
    pairs = placed.select("graph_id", "T", "_more", F.explode(rest).alias("u"), rest.alias("_rest")).select("graph_id", "T", "_more", "u", F.explode("_rest").alias("v")).where("u < v")
    more = _sampled(pairs, ["graph_id"], F.col("_more"), "bg", g, F.col("u"), F.col("v"))
    more = more.select("graph_id", "u", "v", whole(rnd("bt", g, F.col("u"), F.col("v")), F.col("T")).alias("t"))
    adds = planted.unionByName(more)
    deletes = _deletes(adds, params, ["graph_id"], F.col("M") - n - F.expr(f"2 * (M - {n}) div 3"), "dl")
    return _ordered(adds.withColumn("op", F.lit("a")).unionByName(deletes), "t", "op", "u", "v")


def _random_logs(tries: DataFrame) -> DataFrame:
    """(graph_id, attempt, u, v, t, op): for each attempt two thirds of M distinct pairs of N nodes, added at any time, the rest deletes of them."""
    g, a = F.col("graph_id"), F.col("attempt")
    most = F.expr("(2 * M + 2) div 3")
    pairs = tries.select("graph_id", "attempt", "T", "M", "N", F.explode(F.sequence(F.lit(0), F.col("N") - 2)).alias("u")).select("*", F.explode(F.sequence(F.col("u") + 1, F.col("N") - 1)).alias("v"))
    drawn = _sampled(pairs.select("graph_id", "attempt", "T", "M", "u", "v"), ["graph_id", "attempt"], most, "ng", g, a, F.col("u"), F.col("v"))
    adds = drawn.select("graph_id", "attempt", "u", "v", whole(rnd("nt", g, a, F.col("u"), F.col("v")), F.col("T")).alias("t"))
    deletes = _deletes(adds, tries.select("graph_id", "T", "M").distinct(), ["graph_id", "attempt"], F.col("M") - most, "nd")
    return adds.withColumn("op", F.lit("a")).unionByName(deletes)


def contain_negative(params: DataFrame, motif: str, n_events: int | None = None, which: str = "contain", at_once: int = 4, rounds: int = 50) -> DataFrame:
    """Random logs of M events without the motif: each row's first attempt that lacks it, ``at_once`` drawn in a round until all rows have one.

    Each round reads the rows that are left from a table of its own and writes the logs it tries and those it accepts, so no
    plan holds earlier rounds. Node pairs and events are dealt out by their numbers and never broadcast. Raises an error if rows are left after ``rounds``; rows of fewer than two nodes or without events give no log.
    """
    own = one_shuffle(params.sparkSession, broadcasts=False)
    left = cut(_with_events(params, n_events).where("N >= 2 AND M >= 1").select("graph_id", "T", "N", "M"), "left", own)
    parts: list[DataFrame] = []
    for k in range(rounds):
        pairs = left.agg(F.sum(F.expr("bigint(N) * (N - 1) div 2"))).first()[0] or 0
        dealt = left.repartition(max(1, at_once * pairs // TASK_PAIRS), "graph_id")
        tries = dealt.select("*", F.explode(F.sequence(F.lit(k * at_once), F.lit((k + 1) * at_once - 1))).alias("attempt"))
        logs = cut(_random_logs(tries), "logs")
        both = F.concat_ws(":", F.col("graph_id").cast("string"), F.col("attempt").cast("string"))
        named = logs.withColumn("graph_id", both)
        bad = motifs.found(named, motif, which=which, p=prepare(named, tasks=tasks_for(logs.count()))).select(F.col("graph_id").alias("_b")).distinct()
        good = tries.withColumn("_b", both).join(bad, "_b", "left_anti").groupBy("graph_id").agg(F.min("attempt").alias("attempt"))
        good = cut(good, "good")
        parts.append(cut(logs.join(good, ["graph_id", "attempt"], "left_semi").drop("attempt"), "accepted"))
        before, left = left, cut(left.join(good, "graph_id", "left_anti"), "left")
        uncut(before, good, logs)
        if left.isEmpty():
            return _ordered(reduce(DataFrame.unionByName, parts), "t", "op", "u", "v")
    raise ValueError(f"{motif}: some graphs had the motif in {rounds * at_once} attempts; they have too many events for their nodes")


def contain_task(params: DataFrame, motif: str, which: str = "contain") -> DataFrame:
    """Logs of M events: even seeds with the motif, odd ones without."""
    even = F.col("seed") % 2 == 0
    return contain_positive(params.where(even), motif, which=which).unionByName(contain_negative(params.where(~even), motif, which=which))


def _mixed_background(params: DataFrame, kept: DataFrame, n_events: int, p_delete: float) -> DataFrame:
    """``n_events`` events a graph, in turn: with ``p_delete`` the delete of an edge alive, from its time on, else an add of any two nodes."""
    g, n, end = F.col("graph_id"), F.col("N"), F.col("T")
    alive = kept.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("u", "v", "t"))).alias("_alive"))
    event = "array<struct<u:int,v:int,t:int,op:string>>"

    def step(state, i):
        live = state["live"]
        at = whole(rnd("me", g, i), F.greatest(F.size(live), F.lit(1)))
        old = F.get(live, at)
        a = whole(rnd("ma", g, i), n)
        b = (a + 1 + whole(rnd("mb", g, i), n - 1)) % n
        new = F.struct(F.least(a, b).cast("int").alias("u"), F.greatest(a, b).cast("int").alias("v"), whole(rnd("mt", g, i), end).alias("t"))
        gone = F.struct(old["u"].alias("u"), old["v"].alias("v"), (old["t"] + whole(rnd("md", g, i), F.greatest(end - old["t"], F.lit(1)))).cast("int").alias("t"), F.lit("d").alias("op"))
        added = F.struct(new["u"].alias("u"), new["v"].alias("v"), new["t"].alias("t"), F.lit("a").alias("op"))
        delete = (rnd("mo", g, i) < p_delete) & (F.size(live) > 0)
        left = F.concat(F.slice(live, F.lit(1), at), F.slice(live, at + 2, F.size(live)))
        return F.struct(
            F.concat(state["events"], F.array(F.when(delete, gone).otherwise(added))).cast(event).alias("events"),
            F.when(delete, left).otherwise(F.concat(live, F.array(new))).cast("array<struct<u:int,v:int,t:int>>").alias("live"),
        )

    start = F.struct(F.array().cast(event).alias("events"), F.coalesce(F.col("_alive"), F.array()).cast("array<struct<u:int,v:int,t:int>>").alias("live"))
    made = F.aggregate(F.sequence(F.lit(1), F.lit(n_events)), start, step)["events"] if n_events > 0 else F.array().cast(event)
    rows = params.where(n >= 2).join(alive, "graph_id", "left").select("graph_id", F.explode(made).alias("e"))
    return rows.select("graph_id", "e.*")


def _modify_once(params: DataFrame, motif: str, n_events: int, window: int, p_delete: float, p_remap: float) -> tuple[DataFrame, DataFrame]:
    edges = catalog.EDGES[motif]
    planted = _place(params, edges, window, p_remap)
    last = F.col("i") == len(edges) - 1
    answers = planted.where(last).select("graph_id", "u", "v", "t", F.lit("a").alias("op"))
    kept = planted.where(~last).select("graph_id", "u", "v", "t", F.lit("a").alias("op"))
    te = cut(kept.unionByName(_mixed_background(params, kept, n_events - len(edges) + 1, p_delete)), "tried")
    tasks = tasks_for(te.count())
    has = lambda df: motifs.found(df, motif, window=window, p=prepare(df, tasks=tasks)).select("graph_id").distinct()
    return te, cut(answers.join(has(te.unionByName(answers)), "graph_id", "left_semi").join(has(te), "graph_id", "left_anti"), "answers")


def modify_task(params: DataFrame, motif: str, n_events: int, p_delete: float = 0.5, window: int | None = None, p_remap: float = 0.5, attempts: int = 5) -> tuple[DataFrame, DataFrame]:
    """(log, answers): an instance without its last edge among other events. A log lacks the motif and has it with the answer.

    The first of ``attempts`` that is so counts; rows for which none is give no log. Nodes are moved with ``p_remap``, else 0 and up.
    All tries are written as a table once, and so are their answers; events are dealt out by their number and never broadcast.
    """
    w = catalog.WINDOWS["default"][motif] if window is None else window
    tries = params.select("*", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    tries = tries.withColumnRenamed("graph_id", "_g").withColumn("graph_id", F.concat_ws(":", F.col("_g").cast("string"), F.col("attempt").cast("string")))
    own = one_shuffle(params.sparkSession, broadcasts=False)
    tries = cut(tries, "tries", own)
    tries = tries.repartition(tasks_for(tries.count() * max(n_events, 1)), "graph_id")
    te, good = _modify_once(tries, motif, n_events, w, p_delete, p_remap)
    of = tries.select("graph_id", "_g", "attempt").join(good.select("graph_id"), "graph_id", "left_semi")
    first = of.groupBy("_g").agg(F.min("attempt").alias("attempt")).join(of, ["_g", "attempt"]).select("graph_id", "_g")
    of_first = lambda df: df.join(first, "graph_id").drop("graph_id").withColumnRenamed("_g", "graph_id").select("graph_id", "u", "v", "t", "op")
    return _ordered(of_first(te), "t", "u", "v", "op"), of_first(good)


def is_motif_task(params: DataFrame, motif: str, topology: float = 0.75, permute: float = 0.5, p_delete: float = 0.5, cases: bool = False) -> DataFrame:
    """Logs of the motif's size over 2 * T steps, T being the window; with ``cases`` (graph_id, assignment_case) instead.

    Its topology, half of the time with its nodes permuted, or as many random pairs of its nodes. Times: (1) in order inside the
    window, (2) in order with a span beyond it, (3) those of 1 in another order, a third each; (4) any, for random pairs and
    where the steps don't suffice. Adds are deleted later with ``p_delete``.
    """
    edges = catalog.EDGES[motif]
    k, n, g = catalog.n_nodes(edges), len(edges), F.col("graph_id")
    window, end = F.col("T"), F.col("T") * 2
    ordered = lambda salt, items: F.transform(F.array_sort(F.transform(items, lambda x: F.struct(rnd(*salt, x).alias("r"), x.alias("x")))), lambda s: s["x"])
    some = lambda salt, last, m: F.when(last >= 1, F.array_sort(F.slice(ordered(salt, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))), 1, m))).otherwise(F.array().cast("array<int>"))
    df = params.withColumn("_real", rnd("top", g) < topology).withColumn("_perm", F.when(rnd("pq", g) < permute, ordered(("pm", g), F.sequence(F.lit(0), F.lit(k - 1)))).otherwise(F.sequence(F.lit(0), F.lit(k - 1))))
    df = df.withColumn("_start", whole(rnd("st", g), F.greatest(end - window - 1, F.lit(0)))).withColumn("_base", F.concat(F.array(F.lit(0)), some(("bs", g), window - 1, n - 1)))
    df = df.withColumn("_fits", (end - window - 2 >= 0) & (F.size("_base") == n))
    places = F.sequence(F.lit(0), F.lit(n - 1))
    shuffles = [F.transform(ordered(("sh", g, F.lit(i)), places), lambda x: F.col("_base")[x]) for i in range(5)]
    df = df.withColumn("_other", F.coalesce(*[F.when(x != F.col("_base"), x) for x in shuffles]))
    far = F.greatest(F.col("_start") + window + 1, F.col("_start") + F.col("_base")[n - 2] + 1)
    df = df.withColumn("_far", F.when(F.col("_fits") & (far <= end - 1), far + whole(rnd("tm", g), end - far) - F.col("_start")))
    df = df.withColumn("_wide", F.concat(F.array(F.lit(0)), some(("in", g), F.col("_far") - 1, n - 2), F.array(F.col("_far"))))
    draw = rnd("way", g)
    case = F.when(~F.col("_real") | ~F.col("_fits"), 4).when(draw < 0.33, 1).when(draw < 0.66, F.when(F.size("_wide") == n, 2).otherwise(4)).otherwise(F.when(F.col("_other").isNotNull(), 3).otherwise(4))
    df = df.withColumn("assignment_case", case.cast("int"))
    if cases:
        return df.select("graph_id", "assignment_case")
    shape = F.when(F.col("assignment_case") == 1, F.col("_base")).when(F.col("assignment_case") == 2, F.col("_wide")).when(F.col("assignment_case") == 3, F.col("_other"))
    times = F.when(shape.isNotNull(), F.transform(shape, lambda x: (x + F.col("_start")).cast("int"))).otherwise(F.transform(places, lambda i: whole(rnd("any", g, i), end)))
    pairs = F.array(*[F.struct(F.lit(a).alias("u"), F.lit(b).alias("v")) for a in range(k) for b in range(a + 1, k)])
    chosen = F.slice(F.array_sort(F.transform(pairs, lambda p: F.struct(rnd("rp", g, p["u"], p["v"]).alias("r"), p["u"].alias("u"), p["v"].alias("v")))), 1, n)
    real = F.array(*[F.struct(F.col("_perm")[a].alias("u"), F.col("_perm")[b].alias("v")) for a, b in edges])
    links = F.when(F.col("_real"), real).otherwise(F.transform(chosen, lambda c: F.struct(c["u"].alias("u"), c["v"].alias("v"))))
    adds = df.select("graph_id", end.alias("end"), times.alias("_t"), F.posexplode(links).alias("i", "e")).select("graph_id", "end", "i", "e.u", "e.v", F.col("_t")[F.col("i")].alias("t"), F.lit("a").alias("op"))
    td = F.col("t") + 1 + whole(rnd("td", g, F.col("i")), F.col("end") - 1 - F.col("t"))
    deletes = adds.where((rnd("del", g, F.col("i")) < p_delete) & (F.col("t") < F.col("end") - 1)).select("graph_id", "u", "v", td.cast("int").alias("t"), F.lit("d").alias("op"))
    return _ordered(adds.drop("end", "i").unionByName(deletes), "t", "u", "v", "op")


def dispatch(params: DataFrame, task: str, motif: str | None = None, n_events: int = 20) -> DataFrame:
    """The generator of a task: for containment random logs where p is below 1, else p events with the motif (even seeds) or without."""
    if task == "judge_contain_motif" and motif:
        planned = params.where("p >= 1").withColumn("M", F.col("p").cast("int"))
        return er_events(params.where("p < 1")).unionByName(contain_task(planned, motif))
    if task == "judge_is_motif" and motif:
        return is_motif_task(params, motif)
    if task == "modify_motif" and motif:
        return modify_task(params, motif, n_events)[0]
    return er_events(params)


def first_seeds(grid: DataFrame, made: DataFrame, wanted: int) -> DataFrame:
    """Of every T, N and p the first ``wanted`` seeds that gave a log, among 5 * ``wanted`` + 10 tried (``param_grid`` with so many)."""
    tried = grid.where(F.col("seed") < 5 * wanted + 10).join(made.select("graph_id").distinct(), "graph_id", "left_semi")
    at = F.row_number().over(W.partitionBy("T", "N", "p").orderBy("seed"))
    return tried.withColumn("_at", at).where(F.col("_at") <= wanted).drop("_at")


def seeded(cells: DataFrame, generator: Callable[[DataFrame], DataFrame], wanted: int) -> tuple[DataFrame, DataFrame]:
    """(logs, frontier): of every cell (T, N, p) the logs of the first ``wanted`` seeds that give one, among 5 * ``wanted`` + 10.

    The same as ``first_seeds`` of all seeds, in rounds: the frontier has a row a cell, the next seed and how many were accepted.
    A round tries as many seeds of a cell as it still lacks, so none is generated that isn't looked at, and leaves tables.
    """
    most, lacking = 5 * wanted + 10, F.lit(wanted) - F.col("have")
    frontier = cut(cells.select("T", "N", "p").distinct().select("T", "N", "p", F.lit(0).alias("next"), F.lit(0).cast("bigint").alias("have")), "frontier")
    parts: list[DataFrame] = []
    while not (open_ := frontier.where((F.col("have") < wanted) & (F.col("next") < most))).isEmpty():
        upto = F.least(F.lit(most), F.col("next") + lacking)
        params = _named(open_.withColumn("seed", F.explode(F.sequence(F.col("next"), upto.cast("int") - 1))))
        parts.append(cut(generator(params), "seeded"))
        made = params.join(parts[-1].select("graph_id").distinct(), "graph_id", "left_semi").groupBy("T", "N", "p").agg(F.count("*").alias("found"))
        tried = F.when((F.col("have") < wanted) & (F.col("next") < most), upto.cast("int")).otherwise(F.col("next"))
        before, frontier = frontier, cut(frontier.join(made, ["T", "N", "p"], "left").select("T", "N", "p", tried.alias("next"), (F.col("have") + F.coalesce("found", F.lit(0))).alias("have")), "frontier")
        uncut(before)
    return reduce(DataFrame.unionByName, parts) if parts else generator(_named(cells.withColumn("seed", F.lit(0)).limit(0))), frontier


def _graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters T=15, N=20, p=0.3 for graphs numbered like the suppliers."""
    ids = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("graph_id"))
    return ids.select("graph_id", F.lit(15).alias("T"), F.lit(20).alias("N"), F.lit(0.3).alias("p"))


def _er_sql() -> str:
    r = lambda k: rnd_sql(f"'{k}'", "g", "u", "v")
    return f"""WITH pr AS (SELECT s_suppkey AS g, u, v FROM supplier, (SELECT unnest(range(0, 20)) AS u), (SELECT unnest(range(0, 20)) AS v) WHERE u < v),
k AS (SELECT g, u, v, CAST(floor({r('t')} * 15) AS INT) AS ta FROM pr WHERE {r('p')} < 0.3::DOUBLE),
e AS (SELECT g, u, v, ta AS t, 'a' AS op FROM k UNION ALL SELECT g, u, v, ta + 1 + CAST(floor({r('e')} * (14 - ta)) AS INT), 'd' FROM k WHERE {r('d')} < 0.5::DOUBLE AND ta < 14)
SELECT g AS graph_id, CAST(row_number() OVER (PARTITION BY g ORDER BY t, op, u, v) - 1 AS INT) AS seq, CAST(u AS INT) AS u, CAST(v AS INT) AS v, CAST(t AS INT) AS t, op FROM e"""


def _positive_sql(m: int, motif: str) -> str:
    """T=15, N=20; ``m`` events."""
    edges, window = catalog.EDGES[motif], catalog.WINDOWS["contain"][motif]
    k, n = catalog.n_nodes(edges), len(edges)
    more = 2 * (m - n) // 3
    r = lambda salt, *key: rnd_sql(f"'{salt}'", "g", *key)
    rows = " UNION ALL ".join(f"SELECT g, nodes[{a + 1}] AS u, nodes[{b + 1}] AS v, st + times[{i + 1}] AS t FROM pl" for i, (a, b) in enumerate(edges))
    return f"""WITH p0 AS (SELECT s_suppkey AS g, CAST(floor({rnd_sql("'s'", 's_suppkey')} * {max(0, 15 - window - 2) + 1}) AS INT) AS st FROM supplier),
nd AS (SELECT g, list(x ORDER BY {r('n', 'x')}, x) AS nodes FROM p0, (SELECT unnest(range(0, 20)) AS x) GROUP BY g), ts AS (SELECT g, list_sort(list(x ORDER BY {r('w', 'x')}, x)[1:{n}]) AS times FROM p0, (SELECT unnest(range(0, {window})) AS x) WHERE x < 15 - st GROUP BY g),
pl AS (SELECT g, st, nodes, times FROM p0 JOIN nd USING (g) JOIN ts USING (g) WHERE len(times) = {n}), pa AS (SELECT a.g, a.x AS u, b.x AS v FROM (SELECT g, unnest(nodes[{k + 1}:]) AS x FROM pl) a JOIN (SELECT g, unnest(nodes[{k + 1}:]) AS x FROM pl) b ON a.g = b.g AND a.x < b.x),
mo AS (SELECT g, u, v, CAST(floor({r('bt', 'u', 'v')} * 15) AS INT) AS t FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {r('bg', 'u', 'v')}, u, v) AS i FROM pa) WHERE i <= {more}), ad AS ({rows} UNION ALL SELECT * FROM mo),
dl AS (SELECT g, u, v, en + CAST(floor({r('dlt', 'u', 'v', 't')} * greatest(15 - en, 1)) AS INT) AS t FROM (SELECT *, max(t) OVER (PARTITION BY g) AS en, row_number() OVER (PARTITION BY g ORDER BY {r('dl', 'u', 'v', 't')}, t, u, v) AS i FROM ad) WHERE i <= {m - n - more}),
e AS (SELECT g, u, v, t, 'a' AS op FROM ad UNION ALL SELECT g, u, v, t, 'd' FROM dl)
SELECT g AS graph_id, CAST(row_number() OVER (PARTITION BY g ORDER BY t, op, u, v) - 1 AS INT) AS seq, CAST(u AS INT) AS u, CAST(v AS INT) AS v, CAST(t AS INT) AS t, op FROM e"""


def _negative_sql(m: int, motif: str, attempts: int = 24) -> str:
    edges, window = catalog.EDGES[motif], catalog.WINDOWS["contain"][motif]
    most = (2 * m + 2) // 3
    r = lambda salt, *key: rnd_sql(f"'{salt}'", "g", "k", *key)
    return f"""WITH pr AS (SELECT s_suppkey AS g, k, u, v FROM supplier, (SELECT unnest(range(0, {attempts})) AS k), (SELECT unnest(range(0, 20)) AS u), (SELECT unnest(range(0, 20)) AS v) WHERE u < v),
ad AS (SELECT g, k, u, v, CAST(floor({r('nt', 'u', 'v')} * 15) AS INT) AS t FROM (SELECT *, row_number() OVER (PARTITION BY g, k ORDER BY {r('ng', 'u', 'v')}, u, v) AS i FROM pr) WHERE i <= {most}),
te AS (SELECT g || ':' || k AS graph_id, u, v, t, 'a' AS op FROM ad), {DIRECTED_SQL}, ok AS (SELECT g, min(k) AS k FROM (SELECT DISTINCT g, k FROM ad) WHERE g || ':' || k NOT IN (SELECT graph_id FROM ({instances_sql(edges, window)})) GROUP BY g),
a1 AS (SELECT ad.* FROM ad JOIN ok USING (g, k)), dl AS (SELECT g, u, v, en + CAST(floor({r('ndt', 'u', 'v', 't')} * greatest(15 - en, 1)) AS INT) AS t FROM (SELECT *, max(t) OVER (PARTITION BY g) AS en, row_number() OVER (PARTITION BY g ORDER BY {r('nd', 'u', 'v', 't')}, t, u, v) AS i FROM a1) WHERE i <= {m - most}),
e AS (SELECT g, u, v, t, 'a' AS op FROM a1 UNION ALL SELECT g, u, v, t, 'd' FROM dl)
SELECT g AS graph_id, CAST(row_number() OVER (PARTITION BY g ORDER BY t, op, u, v) - 1 AS INT) AS seq, CAST(u AS INT) AS u, CAST(v AS INT) AS v, CAST(t AS INT) AS t, op FROM e"""


def _is_motif_sql(motif: str) -> str:
    """T=15, so a window of 15 and 30 steps."""
    edges = catalog.EDGES[motif]
    k, n = catalog.n_nodes(edges), len(edges)
    r = lambda salt, *key: rnd_sql(f"'{salt}'", "g", *key)
    by = lambda salt, items, *key: f"[z.x FOR z IN list_sort([struct_pack(r := {r(salt, *key, 'x')}, x := x) FOR x IN {items}])]"
    other = " ".join(f"WHEN {by('sh', f'range(0, {n})', str(i))} <> range(0, {n}) THEN [ba[y + 1] FOR y IN {by('sh', f'range(0, {n})', str(i))}]" for i in range(5))
    pairs = ", ".join(f"struct_pack(r := {r('rp', str(a), str(b))}, u := {a}, v := {b})" for a in range(k) for b in range(a + 1, k))
    real = ", ".join(f"struct_pack(u := pe[{a + 1}], v := pe[{b + 1}])" for a, b in edges)
    return f"""WITH a AS (SELECT s_suppkey AS g FROM supplier), b AS (SELECT g, {r('top')} < 0.75 AS re, CASE WHEN {r('pq')} < 0.5 THEN {by('pm', f'range(0, {k})')} ELSE range(0, {k}) END AS pe, CAST(floor({r('st')} * 14) AS INT) AS st, list_sort(list_concat([0], {by('bs', 'range(1, 15)')}[1:{n - 1}])) AS ba FROM a),
c AS (SELECT *, CASE {other} END AS ot, greatest(st + 16, st + ba[{n - 1}] + 1) AS fa FROM b), d AS (SELECT *, CASE WHEN fa <= 29 THEN fa + CAST(floor({r('tm')} * (30 - fa)) AS INT) - st END AS far FROM c),
f AS (SELECT *, list_concat([0], list_sort({by('in', 'range(1, greatest(coalesce(far, 1), 1))')}[1:{n - 2}]), [far]) AS wi FROM d),
h AS (SELECT *, CASE WHEN NOT re THEN 4 WHEN {r('way')} < 0.33 THEN 1 WHEN {r('way')} < 0.66 THEN CASE WHEN far IS NOT NULL AND len(wi) = {n} THEN 2 ELSE 4 END WHEN ot IS NOT NULL THEN 3 ELSE 4 END AS ca FROM f),
l AS (SELECT g, CASE ca WHEN 1 THEN [x + st FOR x IN ba] WHEN 2 THEN [x + st FOR x IN wi] WHEN 3 THEN [x + st FOR x IN ot] ELSE [CAST(floor({r('any', 'x')} * 30) AS INT) FOR x IN range(0, {n})] END AS ts, CASE WHEN re THEN [{real}] ELSE [struct_pack(u := z.u, v := z.v) FOR z IN list_sort([{pairs}])[1:{n}]] END AS li FROM h),
ad AS (SELECT g, i - 1 AS i, li[i].u AS u, li[i].v AS v, ts[i] AS t FROM l, (SELECT unnest(range(1, {n + 1})) AS i)),
e AS (SELECT g, u, v, t, 'a' AS op FROM ad UNION ALL SELECT g, u, v, t + 1 + CAST(floor({r('td', 'i')} * (29 - t)) AS INT), 'd' FROM ad WHERE {r('del', 'i')} < 0.5 AND t < 29)
SELECT g AS graph_id, CAST(row_number() OVER (PARTITION BY g ORDER BY t, u, v, op) - 1 AS INT) AS seq, CAST(u AS INT) AS u, CAST(v AS INT) AS v, CAST(t AS INT) AS t, op FROM e"""


def registered() -> list[tuple[str, Callable, str | None]]:
    grid = lambda spark, _: param_grid(spark, [5, 10], [10, 15], [0.3], 5).drop("graph_id")
    grid_sql = "SELECT CAST(T AS INT) AS T, CAST(N AS INT) AS N, 0.3::DOUBLE AS p, CAST(s AS INT) AS seed, 'T' || T || '_N' || N || '_p0.3_seed' || s AS folder FROM (SELECT unnest([5, 10]) AS T), (SELECT unnest([10, 15]) AS N), (SELECT unnest(range(0, 5)) AS s)"
    return [
        ("gen_param_grid", grid, grid_sql),
        ("gen_er_events", lambda s, d: er_events(_graphs(s, d)), _er_sql()),
        ("gen_contain_positive", lambda s, d: contain_positive(_graphs(s, d), "triangle", 20), _positive_sql(20, "triangle")),
        ("gen_contain_negative", lambda s, d: contain_negative(_graphs(s, d), "4-path", 20), _negative_sql(20, "4-path")),
        ("gen_is_motif", lambda s, d: is_motif_task(_graphs(s, d), "4-cycle"), _is_motif_sql("4-cycle")),
        ("gen_modify", lambda s, d: modify_task(_graphs(s, d), "4-cycle", 10)[0], None),
    ]


