"""Temporal edges (graph_id, seq, u, v, t, op) from the driver's events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "graph_id bigint, seq int, u int, v int, t int, op string"
EVENTS_PER_GRAPH = 40

EDGES_SQL = """te AS (SELECT * FROM (SELECT event_id // 40 AS graph_id, CAST(event_id % 40 AS INT) AS seq, CAST(user_id % 12 AS INT) AS u,
 CAST(CAST(json_extract_string(props, '$.k') AS INT) % 12 AS INT) AS v, CAST((event_id % 40) // 2 AS INT) AS t,
 CASE WHEN event_type = 'error' THEN 'd' ELSE 'a' END AS op FROM events) WHERE u <> v)"""


def temporal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty events a graph on twelve nodes; two events share a time; errors are deletions."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "props")
    at = F.col("event_id") % EVENTS_PER_GRAPH
    return events.select(
        F.expr(f"event_id div {EVENTS_PER_GRAPH}").alias("graph_id"),
        at.cast("int").alias("seq"),
        (F.col("user_id") % 12).cast("int").alias("u"),
        (F.get_json_object("props", "$.k").cast("int") % 12).cast("int").alias("v"),
        F.expr(f"int((event_id % {EVENTS_PER_GRAPH}) div 2)").alias("t"),
        F.when(F.col("event_type") == "error", "d").otherwise("a").alias("op"),
    ).where("u <> v")
