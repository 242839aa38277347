"""Motif counts kept up to date over a log that grows: what new events change, without counting the old ones again.

An instance that a batch of events makes has at least one of them. It is counted at its first leg (in edge order) that is new:
for each leg in turn, that leg reads the new events, earlier legs the old ones, later legs both. So the joins begin or narrow
down at the new events, and only neighbours of theirs in the old log are read in order.

In the induced mode a new pair of nodes can also end old instances. Graphs in which the batch connects a pair for the first time
are therefore counted anew; the others, where only known pairs meet again, take the delta.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomotif.operators import motifs
from chronomotif.plans import catalog
from chronomotif.plans.motif import Prepared, adds_of, chain, loose_pair, prepare

EVENT = ["graph_id", "lo", "hi", "t"]


def _legs(k: int, n: int) -> list[str]:
    """Which events each of n legs reads when leg k is the first that is new."""
    return ["old" if i < k else "new" if i == k else "both" for i in range(n)]


def _delta(old: Prepared, new: Prepared, both: Prepared, edges: list[tuple[int, int]], window: int, window_op: str, mode: str) -> DataFrame:
    """(graph_id, n) of instances with a new event."""
    text, _, n = chain(edges, window, window_op, mode)
    parts = []
    for k in range(n):
        legs = _legs(k, n)
        sql = re.sub(r"\{directed\} e(\d+)", lambda m, legs=legs: f"{{{legs[int(m[1])]}}} e{m[1]}", text)
        tables = {"old": old.directed, "new": new.directed, "both": both.directed, "static": both.static}
        parts.append(both.directed.sparkSession.sql(sql, **{name: df for name, df in tables.items() if f"{{{name}}}" in sql}).groupBy("graph_id").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def count_change(log: DataFrame, batch: DataFrame, motif: str | list, window: int | None = None, window_op: str = "le", mode: str = "induced", which: str = "default") -> DataFrame:
    """(graph_id, change): by how much the counts of ``log`` change when ``batch`` is appended, without zeros.

    Events that the log has already change nothing. Patterns with a pair that nothing else joins are not supported.
    """
    edges = catalog.EDGES[motif] if isinstance(motif, str) else motif
    if loose_pair(edges):
        raise ValueError("a pattern with a pair apart from the others has no delta")
    w = window if window is not None else catalog.WINDOWS[which][motif]
    come = adds_of(batch).distinct().join(adds_of(log).select(*EVENT), EVENT, "left_anti")
    fresh = come.select("graph_id", F.col("lo").alias("u"), F.col("hi").alias("v"), "t", F.lit("a").alias("op"))
    columns = ["graph_id", "u", "v", "t", "op"]
    touched = log.select(*columns).join(fresh.select("graph_id").distinct(), "graph_id", "left_semi")  # graphs without new events stay as they are
    if mode != "induced":
        p = prepare(touched), prepare(fresh), prepare(touched.unionByName(fresh))
        change = _delta(*p, edges, w, window_op, mode)
    else:
        known = adds_of(touched).select("graph_id", "lo", "hi").distinct()
        anew = come.select("graph_id", "lo", "hi").distinct().join(known, ["graph_id", "lo", "hi"], "left_anti").select("graph_id").distinct()
        split = lambda df, how: df.join(anew, "graph_id", how)
        kept, more = split(touched, "left_anti"), split(fresh, "left_anti")
        p = prepare(kept), prepare(more), prepare(kept.unionByName(more))
        before, after = split(touched, "left_semi"), split(touched, "left_semi").unionByName(split(fresh, "left_semi"))
        counts = [motifs.found(df, edges, w, window_op, p=prepare(df)).groupBy("graph_id").agg((F.count("*") * sign).alias("n")) for df, sign in ((after, 1), (before, -1))]
        change = reduce(DataFrame.unionByName, [_delta(*p, edges, w, window_op, mode), *counts])
    return change.groupBy("graph_id").agg(F.sum("n").alias("change")).where("change <> 0")


def counts_after(counts: DataFrame, change: DataFrame) -> DataFrame:
    """(graph_id, n_instances) of ``motifs.count`` after a change, without zeros."""
    both = counts.select("graph_id", F.col("n_instances").alias("n")).unionByName(change.select("graph_id", F.col("change").alias("n")))
    return both.groupBy("graph_id").agg(F.sum("n").alias("n_instances")).where("n_instances <> 0")
