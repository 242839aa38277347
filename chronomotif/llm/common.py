"""What the corpus operators share: the shared folder, tables written there, what workers are sent."""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Python workers on any machine can import this package: Spark sends it as an archive, once a context."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    sources = [(f"{root.name}/{p.relative_to(root).as_posix()}", p.read_bytes()) for p in sorted(root.rglob("*.py"))]
    name = f"{root.name}-{hashlib.sha256(repr(sources).encode()).hexdigest()[:12]}.zip"
    if name in sc._python_includes:
        return
    path = os.path.join(tempfile.mkdtemp(), name)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for inner, content in sources:
            archive.writestr(inner, content)
    sc.addPyFile(path)


def ship_file(spark: SparkSession, path: str) -> None:
    """Workers find a file of the driver's machine by ``here(path)``: Spark sends it, once a context."""
    sc = spark.sparkContext
    if not any(f.rsplit("/", 1)[-1] == os.path.basename(path) for f in sc.listFiles):
        sc.addFile(path)


def here(path: str) -> str:
    """Where this process has a file of ``ship_file``: on the driver the file itself, in a worker the copy that Spark sent."""
    if SparkFiles._is_running_on_worker:
        sent = SparkFiles.get(os.path.basename(path))
        if os.path.exists(sent):
            return sent
    return path


_CACHES: list[Callable] = []


def tidy(run: Callable, *forget: Callable) -> Callable:
    """``run`` over Arrow batches. Before it, caches that another operator's task left in this worker are emptied, after it unused memory goes back.

    Python workers live on for tasks of other operators, so what each leaves behind would add up. ``forget`` empties the own
    caches, which tasks of the same operator share.
    """

    def tidied(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow

        from chronomotif.llm import common

        for empty in common._CACHES:
            if empty not in forget:
                empty()
        common._CACHES[:] = forget
        yield from run(batches)
        pyarrow.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one on a single machine, else an error."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (set_to or "/tmp/checkpoints").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go when each ends; for results that are kept elsewhere."""
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


ROWS_A_FILE = 500_000


def written(df: DataFrame, name: str, compression: str = "zstd", rows: int | None = None) -> DataFrame:
    """Cuts lineage: ``df`` written as Parquet in the shared folder and read again; survives lost executors. ``dropped`` deletes it.

    ``rows``: a known bound of the number of rows, so that small tables make few files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = fresh_path(spark, name)
    with shuffles_dropped(spark):
        df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package wrote, through Spark's own file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        removed(df.sparkSession, df._written_at)
