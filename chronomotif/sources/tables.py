"""Tables that cut lineage: written once to the folder that all machines share, read again, deleted when no longer needed."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local folder on a single machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def cut(df: DataFrame, name: str = "table", reader: SparkSession | None = None) -> DataFrame:
    """``df`` as written now; later readers don't compute it again, and a lost executor costs nothing of it. ``reader``: the session it is read in."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    back = (reader or spark).read.schema(df.schema).parquet(path)
    back._cut_at = path
    return back


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go when each ends, not when the driver happens to collect garbage; for results that ``cut`` keeps."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def uncut(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
