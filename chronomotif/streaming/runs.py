"""A run over the task rows that there are, which can be stopped anywhere and started again.

The run reads the folder of questions as a stream (``availableNow``) with a checkpoint. A batch asks for the pairs (task, graph)
that no earlier batch has answered, each once, and writes their answers to a folder of its own, ``batch=<number>``: all answers
so far are the ledger. A batch that was stopped before its commit runs again under the same number: if its folder is complete
it isn't asked again, else what there is of it is replaced. So every answer is there once, however often the run ends and begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.sources import providers

QUESTIONS = "task string, graph_id bigint, prompt string"
ANSWERS = f"task string, {providers.SCHEMA}, batch bigint"


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def answered(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of all complete batches; none before the first."""
    path = f"{folder}/answers"
    if not _there(spark, path):
        return spark.createDataFrame([], ANSWERS)
    return spark.read.schema(ANSWERS).option("basePath", path).parquet(f"{path}/batch=*")


def run(questions: str, folder: str, provider: Callable[[list[str]], list[str]], spark: SparkSession, files_a_batch: int = 8, committed: Callable[[int], None] | None = None) -> DataFrame:
    """Answers what is new in the folder ``questions`` (Parquet, ``QUESTIONS``) and gives all answers in ``folder``. ``committed`` hears of each batch that was written."""

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        path = f"{folder}/answers/batch={number}"
        if not _there(session, f"{path}/_SUCCESS"):
            new = rows.where("task IS NOT NULL AND graph_id IS NOT NULL").groupBy("task", "graph_id").agg(F.min("prompt").alias("prompt"))
            done = answered(session, folder).where(F.col("batch") < number).select("task", "graph_id")
            new = new.join(done, ["task", "graph_id"], "left_anti")
            providers.answers(new, provider, ("task",)).write.mode("overwrite").parquet(path)
        if committed:
            committed(number)

    stream = spark.readStream.schema(QUESTIONS).option("maxFilesPerTrigger", files_a_batch).parquet(questions)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return answered(spark, folder)


def left(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions without a readable answer, to be asked in another run."""
    done = answers.where("content IS NOT NULL").select("task", "graph_id").distinct()
    return questions.join(done, ["task", "graph_id"], "left_anti")
