"""Operators on the event log itself: sorting, states, first link and unlink, reversal, replay, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pair() -> list[Column]:
    """The undirected pair of an event."""
    return [F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")]


def sort_edges(te: DataFrame) -> DataFrame:
    """Stable sort by time inside each graph: ``pos`` is the place."""
    return te.withColumn("pos", F.row_number().over(W.partitionBy("graph_id").orderBy("t", "seq")))


def edges_at(te: DataFrame, t: int | Column) -> DataFrame:
    """The events that keep an edge alive at time t: the last one of each pair, if it adds."""
    last = te.where(F.col("t") <= t).groupBy("graph_id", *pair()).agg(F.max(F.struct("t", "seq", "u", "v", "op")).alias("e"))
    return last.where("e.op = 'a'").select("graph_id", "e.u", "e.v", "e.t", "e.op")


def first_link_unlink(te: DataFrame) -> DataFrame:
    """Per directed pair as written: first add and first delete, whatever their order; null where there is none."""
    t = lambda op: F.min(F.when(F.col("op") == op, F.col("t")))
    return te.groupBy("graph_id", "u", "v").agg(t("a").alias("first_add"), t("d").alias("first_delete"))


def first_link_unlink_after(te: DataFrame) -> DataFrame:
    """Per undirected pair: first add and the first delete at or after it; only pairs with both."""
    pairs = te.select("graph_id", *pair(), "t", "op")
    first = F.min(F.when(F.col("op") == "a", F.col("t"))).over(W.partitionBy("graph_id", "lo", "hi"))
    out = pairs.withColumn("first_add", first).where("op = 'd' AND t >= first_add")
    return out.groupBy("graph_id", "lo", "hi", "first_add").agg(F.min("t").alias("first_delete"))


def eligible_edges(te: DataFrame) -> DataFrame:
    """Undirected pairs that are both added and deleted at some time."""
    both = te.groupBy("graph_id", *pair()).agg(F.bool_or(F.col("op") == "a").alias("a"), F.bool_or(F.col("op") == "d").alias("d"))
    return both.where("a AND d").select("graph_id", "lo", "hi")


def pick(df: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """One row a graph, chosen by a hash of ``keys``: the same on every run."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "graph_id", *keys))
    return df.withColumn("_o", order).groupBy("graph_id").agg(F.min(F.struct("_o", *keys)).alias("r")).select("graph_id", *[f"r.{k}" for k in keys])


def reverse_log(te: DataFrame) -> DataFrame:
    """Adds become deletes and the other way round, in reverse input order (``pos``); other operations go."""
    flipped = te.where("op IN ('a', 'd')").withColumn("op", F.when(F.col("op") == "a", "d").otherwise("a"))
    return flipped.withColumn("pos", F.row_number().over(W.partitionBy("graph_id").orderBy(F.desc("seq"))))


def replay_is_empty(te: DataFrame) -> DataFrame:
    """(graph_id, is_empty): nothing is left after replay by (t, adds first): every pair's last operation deletes."""
    last = te.groupBy("graph_id", *pair()).agg(F.max(F.struct("t", "op")).alias("e"))
    return last.groupBy("graph_id").agg(F.bool_and(F.col("e.op") == "d").alias("is_empty"))


def is_sorted(te: DataFrame, by: str = "seq") -> DataFrame:
    """(graph_id, is_sorted): times never fall in the given order."""
    prev = te.withColumn("_p", F.lag("t").over(W.partitionBy("graph_id").orderBy(by)))
    return prev.groupBy("graph_id").agg(F.bool_and(F.coalesce(F.col("t") >= F.col("_p"), F.lit(True))).alias("is_sorted"))


def alive_intervals(te: DataFrame) -> DataFrame:
    """(graph_id, lo, hi, t_from, t_to): each add and the pair's next event; t_to null while it lasts. The last event of a time counts."""
    last = te.groupBy("graph_id", *pair(), "t").agg(F.max(F.struct("seq", "op")).alias("e"))
    out = last.withColumn("t_to", F.lead("t").over(W.partitionBy("graph_id", "lo", "hi").orderBy("t")))
    return out.where("e.op = 'a'").select("graph_id", "lo", "hi", F.col("t").alias("t_from"), "t_to")


def alive_index(te: DataFrame, levels: int = 31) -> DataFrame:
    """(graph_id, level, block, u, v, t, op): when each connection is alive, for many questions of state; store it to ask again.

    The time from an add to the next event of its pair is cut into blocks of 2 ** level times, each at a multiple of its length
    and at most two a level, so a long life is few rows. All times are below 2 ** ``levels``. A pair that is never undone stays
    alive.
    """
    later = F.lead("t").over(W.partitionBy("graph_id", *pair()).orderBy("t", "seq"))
    lives = te.withColumn("_until", later).where("op = 'a'").select("graph_id", "u", "v", "t", "op", F.greatest("t", F.lit(0)).cast("bigint").alias("a"), F.coalesce(F.col("_until").cast("bigint"), F.lit(1 << levels)).alias("b"))
    at = lives.where("a < b").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    at = at.withColumn("lo", F.expr("shiftright(a + shiftleft(1L, level) - 1, level)")).withColumn("hi", F.expr("shiftright(b, level)")).where("lo < hi")
    first, last = F.when(F.expr("lo % 2 = 1"), F.col("lo")), F.when(F.expr("hi % 2 = 1 AND hi - 1 >= lo + lo % 2"), F.col("hi") - 1)
    return at.select("graph_id", "level", F.explode(F.array_compact(F.array(first, last))).alias("block"), "u", "v", "t", "op")


def alive_at(index: DataFrame, questions: DataFrame, levels: int = 31) -> DataFrame:
    """The connections alive at each question's time: all columns of ``questions`` (graph_id, at, ..) with u, v, t, op.

    One join: a question asks for the block of each level that holds its time, and a life has one of them at most.
    """
    asked = questions.where("at >= 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).withColumn("block", F.expr("shiftright(cast(at AS bigint), level)"))
    return asked.join(index, ["graph_id", "level", "block"]).select(*[F.col(c) for c in questions.columns], "u", "v", "t", "op")


def snapshots(te: DataFrame) -> DataFrame:
    """(graph_id, t, n_alive): alive pairs after each time of the log; interval ends are summed, no pair-by-time join."""
    spans = alive_intervals(te)
    steps = spans.select("graph_id", F.col("t_from").alias("t"), F.lit(1).alias("d")).unionByName(spans.where("t_to IS NOT NULL").select("graph_id", F.col("t_to").alias("t"), F.lit(-1).alias("d")))
    steps = steps.unionByName(te.select("graph_id", "t").distinct().withColumn("d", F.lit(0))).groupBy("graph_id", "t").agg(F.sum("d").alias("d"))
    return steps.select("graph_id", "t", F.sum("d").over(W.partitionBy("graph_id").orderBy("t")).alias("n_alive"))


def edge_status(te: DataFrame) -> DataFrame:
    """(graph_id, seq, lo, hi, t, status, alpha): after each event, green or red, and a fading weight since the pair's first add."""
    over = W.partitionBy("graph_id", "lo", "hi").orderBy("t", "seq").rowsBetween(W.unboundedPreceding, 0)
    first = F.min(F.when(F.col("op") == "a", F.col("t"))).over(over)
    df = te.select("graph_id", "seq", *pair(), "t", "op").withColumn("_f", first)
    alpha = F.greatest(F.lit(0.15), F.lit(1.0) - F.lit(0.1) * (F.col("t") - F.col("_f")))
    return df.select("graph_id", "seq", "lo", "hi", "t", F.when(F.col("op") == "a", "green").otherwise("red").alias("status"), F.round(alpha, 6).alias("alpha"))


def frames(te: DataFrame) -> DataFrame:
    """(graph_id, t, lo, hi, status, alpha): at each time of a log every pair seen so far. Green while it lasts; red after a delete, fading since its first add; else grey."""
    last = te.groupBy("graph_id", *pair(), "t").agg(F.max(F.struct("seq", "op")).alias("e"), F.min(F.when(F.col("op") == "a", F.col("t"))).alias("_a"))
    over = W.partitionBy("graph_id", "lo", "hi").orderBy("t")
    spans = last.select("graph_id", "lo", "hi", F.col("t").alias("_from"), F.lead("t").over(over).alias("_to"), F.col("e.op").alias("op"), F.min("_a").over(over.rowsBetween(W.unboundedPreceding, 0)).alias("_first"))
    at = te.select("graph_id", "t").distinct()
    shown = at.join(spans, "graph_id").where("t >= _from AND (_to IS NULL OR t < _to)")  # one row a time and pair: the size of the result
    fading = F.greatest(F.lit(0.15), F.lit(1.0) - F.lit(0.1) * (F.col("t") - F.coalesce("_first", "t")))
    status = F.when(F.col("op") == "a", "green").when(F.col("op") == "d", "red").otherwise("gray")
    alpha = F.when(F.col("op") == "a", 1.0).when(F.col("op") == "d", fading).otherwise(0.2)
    return shown.select("graph_id", "t", "lo", "hi", status.alias("status"), F.round(alpha, 6).alias("alpha"))


def shuffled(te: DataFrame, seed: int = 0) -> DataFrame:
    """The log in a seeded order (``pos``)."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "graph_id", "seq"))
    return te.withColumn("pos", F.row_number().over(W.partitionBy("graph_id").orderBy(order)))


def edge_timestamps(te: DataFrame) -> DataFrame:
    """(graph_id, lo, hi, times): sorted add times of each pair, duplicates kept, joined by commas."""
    adds = te.where("op = 'a'").groupBy("graph_id", *pair()).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return adds.select("graph_id", "lo", "hi", F.array_join(F.transform("ts", lambda x: x.cast("string")), ",").alias("times"))
