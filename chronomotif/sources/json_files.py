"""JSON files of graphs, questions, answers and results: readers with explicit schemas, writers as Spark sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = "edge_index array<array<string>>, T int, N int, p double, seed bigint, M int, W int, num_nodes int, num_edges int, num_time int, motif_name string, motif_time_window int, is_motif_topology boolean, assignment_case int, answer_edge array<string>, target_motif array<array<string>>, _corrupt_record string"
QA = "context array<array<string>>, query string, answer string, task string, _corrupt_record string"
ANSWER = "content string, total_tokens bigint, prompt_tokens bigint, completion_tokens bigint, usage struct<total_tokens:bigint,prompt_tokens:bigint,completion_tokens:bigint>, tokens struct<total_tokens:bigint,prompt_tokens:bigint,completion_tokens:bigint,execution_time:double>, time double, _corrupt_record string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return df.where("_corrupt_record IS NULL").drop("_corrupt_record").withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """One row a graph file; ``folder`` is the name of its folder."""
    return _read(spark, path, GRAPH)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, QA)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers of any provider with token counts in one place."""
    df = _read(spark, path, ANSWER)
    for c in ("total_tokens", "prompt_tokens", "completion_tokens"):
        df = df.withColumn(c, F.coalesce(c, f"usage.{c}", f"tokens.{c}"))
    return df.select("folder", "content", "total_tokens", "prompt_tokens", "completion_tokens", "time")


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """(folder, place): the instances that list files name, in their order; unreadable files give none."""
    rows = spark.read.schema("instance_list array<string>, _corrupt_record string").option("multiLine", True).json(path).where("_corrupt_record IS NULL")
    return rows.select(F.posexplode("instance_list").alias("place", "folder")).select("folder", "place")


def write_instances(instances: DataFrame, path: str) -> None:
    """One JSON object with the list of the instances' folders, in the order of their place."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "folder"))), lambda x: x["folder"])
    instances.agg(listed.alias("instance_list")).coalesce(1).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of files, with the lists of folders in error and in failure."""
    schema = "task string, model string, correct_rate double, error_rate double, failure_rate double, average_tokens double, total_tokens bigint, metrics array<double>, error_folders array<string>, failure_folders array<string>, _corrupt_record string"
    return spark.read.schema(schema).option("multiLine", True).json(path).where("_corrupt_record IS NULL AND coalesce(task, model, string(correct_rate)) IS NOT NULL").drop("_corrupt_record")


def flagged(instances: DataFrame, results: DataFrame, first: int = 30) -> DataFrame:
    """(folder, flag) of the ``first`` instances by place: 0 for those that a result lists as errors or failures, else 1."""
    bad = results.select(F.explode(F.concat(F.coalesce("error_folders", F.array().cast("array<string>")), F.coalesce("failure_folders", F.array().cast("array<string>")))).alias("folder")).distinct()
    some = instances.where(F.col("place") < first)
    return some.join(bad.withColumn("_b", F.lit(0)), "folder", "left").select("folder", F.coalesce("_b", F.lit(1)).alias("flag"))


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """The arguments of a run as one JSON object."""
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str, key: str | None = None) -> None:
    """Adds rows to a log of JSON lines; those of a ``key`` replace what was written under it before, so a repeated run adds nothing twice."""
    if key is None:
        rows.write.mode("append").json(path)
    else:
        rows.write.mode("overwrite").json(f"{path}/run={key}")


def events_of(graphs: DataFrame, key: str = "folder", column: str = "edge_index") -> DataFrame:
    """Temporal edges of nested logs: entries that aren't four values with whole numbers are skipped."""
    rows = graphs.select(F.xxhash64(key).alias("graph_id"), F.col(key), F.posexplode(column).alias("seq", "e")).where(F.size("e") == 4)
    e = F.col("e")
    cast = rows.select("graph_id", key, "seq", e[0].try_cast("int").alias("u"), e[1].try_cast("int").alias("v"), e[2].try_cast("int").alias("t"), e[3].alias("op"))
    return cast.where("u IS NOT NULL AND v IS NOT NULL AND t IS NOT NULL")


def nested(te: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """One row a graph with ``edge_index`` in log order."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "u", "v", "t", "op")))
    out = F.transform(listed, lambda e: F.array(e["u"].cast("string"), e["v"].cast("string"), e["t"].cast("string"), e["op"]))
    return te.groupBy(*keys).agg(out.alias("edge_index"))


def write_json(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).json(path)


def write_features(df: DataFrame, path: str) -> None:
    """The feature table as JSON lines and as CSV with a header."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
