"""Scorers of answers (graph_id, response) against the log, and the aggregates over their metrics.

Metric codes: 1 right, 0 wrong, fractions in between, -1 unordered or unreadable, -2 incomplete, -3 unparsable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomotif.functions import parsing
from chronomotif.operators import logs, motifs
from chronomotif.sources.events import EDGES_SQL, temporal_edges

QUADS = "array<struct<u:int,v:int,t:int,op:string>>"


def _events(te: DataFrame) -> DataFrame:
    return te.groupBy("graph_id").agg(F.collect_set(F.struct("u", "v", "t", "op")).alias("_e"))


def _same(a: Column, b: Column) -> Column:
    clean = lambda x: F.array_sort(F.array_distinct(x.cast(QUADS)))
    return clean(a) == clean(b)


def _beside(responses: DataFrame, truth: DataFrame, parsed: Column) -> DataFrame:
    """Responses with their parsed events ``_q`` and the distinct true ones ``_e``."""
    df = responses.withColumn("_q", parsed).join(_events(truth), "graph_id", "left")
    return df.withColumn("_e", F.coalesce("_e", F.array().cast(QUADS)))


def score_sort(te: DataFrame, responses: DataFrame, agent: bool = False) -> DataFrame:
    """1 all events in order of time (repeats are no fault), -1 out of order, -2 other events, -3 none; an empty log and no events: 1."""
    df = _beside(responses, te, parsing.quads_sorted(F.col("response"), agent))
    ordered = F.aggregate("_q", F.struct(F.lit(True).alias("ok"), F.lit(-1).alias("t")), lambda a, q: F.struct((a["ok"] & (q["t"] >= a["t"])).alias("ok"), q["t"].alias("t")))["ok"]
    metric = F.when((F.size("_q") == 0) & (F.size("_e") == 0), 1).when(F.size("_q") == 0, -3).when(~_same(F.col("_q"), F.col("_e")), -2).when(~ordered, -1).otherwise(1)
    return df.select("graph_id", metric.cast("double").alias("metric"))


def score_set(truth: DataFrame, responses: DataFrame) -> DataFrame:
    """Set equality with ``truth`` (graph_id, u, v, t, op); an unreadable answer is the empty set."""
    df = _beside(responses, truth, parsing.quads_set(F.col("response")))
    return df.select("graph_id", _same(F.col("_q"), F.col("_e")).cast("double").alias("metric"))


def score_link(truth: DataFrame, responses: DataFrame, agent: bool = False) -> DataFrame:
    """``truth``: (graph_id, first_add, first_delete)."""
    df = responses.join(truth, "graph_id").withColumn("_p", parsing.two_ints(F.col("response"), agent))
    return df.select("graph_id", F.when(F.col("_p").isNull(), -1).otherwise((F.col("_p") == F.array("first_add", "first_delete")).cast("int")).cast("double").alias("metric"))


def _answered(te: DataFrame, responses: DataFrame, parsed: Column) -> DataFrame:
    """The logs of the responses with the answered events behind them."""
    extra = responses.select("graph_id", F.explode(parsed).alias("q")).select("graph_id", F.lit(1 << 30).alias("seq"), "q.u", "q.v", "q.t", "q.op")
    return te.join(responses.select("graph_id"), "graph_id", "left_semi").select("graph_id", "seq", "u", "v", "t", "op").unionByName(extra)


def score_reverse(te: DataFrame, responses: DataFrame) -> DataFrame:
    """1 if the log and the answer, replayed together by time, leave nothing; also where neither has events."""
    left = logs.replay_is_empty(_answered(te, responses, parsing.quads_reversed(F.col("response"))))
    return responses.select("graph_id").join(left, "graph_id", "left").select("graph_id", F.coalesce("is_empty", F.lit(True)).cast("double").alias("metric"))


def score_yes_no(truth: DataFrame, responses: DataFrame) -> DataFrame:
    df = responses.join(truth, "graph_id").withColumn("_a", parsing.yes_no(F.col("response")))
    return df.select("graph_id", F.when(F.col("_a").isNull(), -3).otherwise((F.col("_a") == F.lower("answer")).cast("int")).cast("double").alias("metric"))


def score_modify(te: DataFrame, responses: DataFrame, motif, window: int | None = None) -> DataFrame:
    """1 if there are answered events and the log with them contains the motif."""
    said = responses.select("graph_id", parsing.quads_answer(F.col("response")).alias("_q")).where(F.size("_q") > 0)
    yes = motifs.found(_answered(te, said, F.col("_q")), motif, window=window).select("graph_id").distinct().withColumn("_y", F.lit(1.0))
    return responses.select("graph_id").join(yes, "graph_id", "left").select("graph_id", F.coalesce("_y", F.lit(0.0)).alias("metric"))


def score_multi_judge(truth: DataFrame, responses: DataFrame, agent: bool = False) -> DataFrame:
    """(hits - false catalog names) / names in ``truth`` (graph_id, motifs); 0 without truth, without a marker or for an overlong answer."""
    real = F.filter(F.split("motifs", ","), lambda x: x != "")
    df = responses.join(truth, "graph_id").withColumn("_r", real).withColumn("_n", parsing.names(F.col("response"), agent))
    hits = F.size(F.array_intersect("_n", "_r"))
    metric = F.when((F.size("_r") == 0) | F.col("_n").isNull(), 0.0).otherwise((2 * hits - F.size("_n")) / F.size("_r"))
    return df.select("graph_id", metric.alias("metric"))


def score_multi_count(truth: DataFrame, responses: DataFrame, agent: bool = False) -> DataFrame:
    """Sum over the distinct answered pairs of answer / truth where the answer isn't above it, by the number of ``truth`` rows (graph_id, motif_name, n_instances).

    -1 unreadable or no truth.
    """
    read = responses.select("graph_id", parsing.name_counts(F.col("response"), agent).alias("_p"))
    got = read.select("graph_id", F.explode("_p").alias("p")).select("graph_id", F.col("p.name").alias("motif_name"), "p.n").distinct()
    credit = truth.join(got, ["graph_id", "motif_name"], "left").groupBy("graph_id", "motif_name").agg(F.sum(F.when(F.col("n") <= F.col("n_instances"), F.col("n") / F.col("n_instances"))).alias("c"))
    scored = credit.groupBy("graph_id").agg((F.sum(F.coalesce("c", F.lit(0.0))) / F.count("*")).alias("metric"))
    df = read.join(scored, "graph_id", "left")
    return df.select("graph_id", F.when(F.col("_p").isNull() | F.col("metric").isNull(), -1.0).otherwise(F.col("metric")).alias("metric"))


def score_first_time(truth: DataFrame, responses: DataFrame, agent: bool = False) -> DataFrame:
    """Share of ``truth`` (graph_id, motif_name, first_time) that the first pair of its name has exactly; 0 if nothing was read or true, -1 without a text."""
    read = responses.select("graph_id", parsing.name_times(F.col("response"), agent).alias("_p"))
    got = read.select("graph_id", F.posexplode("_p").alias("pos", "p")).groupBy("graph_id", F.col("p.name").alias("motif_name")).agg(F.min_by("p.n", "pos").alias("n"))
    hit = (F.col("n") == F.col("first_time")).cast("double")
    scored = truth.join(got, ["graph_id", "motif_name"], "left").groupBy("graph_id").agg((F.sum(F.coalesce(hit, F.lit(0.0))) / F.count("*")).alias("metric"))
    df = read.join(scored, "graph_id", "left")
    return df.select("graph_id", F.when(F.col("_p").isNull(), -1.0).otherwise(F.coalesce("metric", F.lit(0.0))).alias("metric"))


def result_rates(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Rates per ``keys`` of (metric): correct (sum of metrics in (0, 1]), error (0 or 2), failure (-1); -2 and -3 count in none."""
    m = F.col("metric")
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.sum(F.when((m > 0) & (m <= 1), m).otherwise(0.0)) / F.count("*"), 6).alias("correct_rate"),
        F.round(F.count_if((m == 0) | (m == 2)) / F.count("*"), 6).alias("error_rate"),
        F.round(F.count_if(m == -1) / F.count("*"), 6).alias("failure_rate"),
        F.count_if(m < 0).alias("n_failed"),
    )


def result_lists(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics and the ids of errors and failures, as sorted lists."""
    m = F.col("metric")
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("graph_id"))))
    return metrics.groupBy(*keys).agg(F.array_sort(F.collect_list("metric")).alias("metrics"), listed((m == 0) | (m == 2)).alias("error_graphs"), listed(m < 0).alias("failure_graphs"))


def token_stats(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and means of ``total_tokens``, nulls left out."""
    return answers.groupBy(*keys).agg(F.sum("total_tokens").alias("total_tokens"), F.round(F.avg("total_tokens"), 6).alias("average_tokens"), F.round(F.sum("total_tokens") / F.count("*"), 6).alias("tokens_per_instance"))


def to_run(instances: DataFrame, answers: DataFrame) -> DataFrame:
    """Instances without a readable answer."""
    return instances.join(answers.where("content IS NOT NULL").select("graph_id"), "graph_id", "left_anti")


def error_flags(instances: DataFrame, errors: DataFrame) -> DataFrame:
    """flag 0 for instances among the errors, else 1."""
    bad = errors.select("graph_id").distinct().withColumn("_b", F.lit(0))
    return instances.join(bad, "graph_id", "left").withColumn("flag", F.coalesce("_b", F.lit(1))).drop("_b")


def chunks_joined(chunks: DataFrame) -> DataFrame:
    """A streamed answer from its chunks (id, idx, delta, finish_reason): the text in order, the last reason."""
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "delta"))), lambda c: c["delta"]), "")
    return chunks.groupBy("id").agg(text_of.alias("content"), F.max_by("finish_reason", "idx").alias("finish_reason"))


def registered() -> list[tuple[str, Callable, str | None]]:
    te = f"WITH {EDGES_SQL} "
    metric = "CAST(CASE s_suppkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 0.5 WHEN 2 THEN 0 WHEN 3 THEN -1 WHEN 4 THEN 2 ELSE -3 END AS DOUBLE)"
    results = lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("model"), F.col("s_suppkey").alias("graph_id"), F.expr(metric).alias("metric"))
    talk = lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("role", F.when(F.col("turn") % 5 != 4, F.size(F.split("text", " "))).alias("total_tokens"))
    return [
        ("result_rates", lambda s, d: result_rates(results(s, d), ["model"]), f"SELECT model, count(*) AS n, round(sum(CASE WHEN m > 0 AND m <= 1 THEN m ELSE 0 END) / count(*), 6) AS correct_rate, round(count(*) FILTER (m IN (0, 2)) / count(*), 6) AS error_rate, round(count(*) FILTER (m = -1) / count(*), 6) AS failure_rate, count(*) FILTER (m < 0) AS n_failed FROM (SELECT s_nationkey AS model, {metric} AS m FROM supplier) GROUP BY model"),
        ("token_stats", lambda s, d: token_stats(talk(s, d), ["role"]), "SELECT role, sum(n)::BIGINT AS total_tokens, round(avg(n), 6) AS average_tokens, round(sum(n) / count(*), 6) AS tokens_per_instance FROM (SELECT role, CASE WHEN turn % 5 <> 4 THEN len(string_split(text, ' ')) END AS n FROM conversations) GROUP BY role"),
        ("to_run_antijoin", lambda s, d: to_run(temporal_edges(s, d).select("graph_id").distinct(), s.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") * 3).alias("graph_id"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("content"))), te + "SELECT DISTINCT graph_id FROM te WHERE graph_id NOT IN (SELECT s_suppkey * 3 FROM supplier WHERE s_suppkey % 4 <> 0)"),
        ("error_flag_join", lambda s, d: error_flags(temporal_edges(s, d).select("graph_id").distinct(), results(s, d).where("metric <= 0")), te + f"SELECT graph_id, CAST(CASE WHEN graph_id IN (SELECT s_suppkey FROM supplier WHERE {metric} <= 0) THEN 0 ELSE 1 END AS INT) AS flag FROM te GROUP BY graph_id"),
        ("stream_chunks_joined", lambda s, d: chunks_joined(s.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("id"), F.col("turn").alias("idx"), F.col("text").alias("delta"), F.col("role").alias("finish_reason"))), "SELECT conv_id AS id, string_agg(text, '' ORDER BY turn, text) AS content, arg_max(role, turn) AS finish_reason FROM conversations GROUP BY conv_id"),
    ]
