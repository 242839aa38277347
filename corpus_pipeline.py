"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``, and rows pass unchanged, extra
columns too. Null or empty texts fail the quality rules and so end there; an empty table gives no rows in any stage; very long
texts are read whole. Each stage's operator states what it does with ties and repeated rows; ``near_copies`` adds its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.llm import decontaminate, jaccard_join, mixing, quality_rules, queries, token_files
from chronomotif.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality_rules.quality_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose 5-word shingles overlap to 0.8 or more, linked through any chain, one row stays: that of the least id.

    Null ids come first. Among rows of one id the least hash of the whole row decides, so each group leaves one row, also where
    ids or rows repeat, and texts that share an id but not a group are judged apart.
    """
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h")).alias("key"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    groups = written(jaccard_join.jaccard_components(keyed.select("key", "text"), id_col="key", k=5, percent=80), "groups")
    gone = groups.where(F.col("key") != F.col("component_id")).select("key")
    kept = keyed.select("key", "row").join(gone, "key", "left_anti")
    repeated = groups.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    if not repeated.isEmpty():  # equal in every column
        kept = kept.join(repeated, "key", "left_anti").unionByName(kept.join(repeated, "key", "left_semi").dropDuplicates(["key"]))
    return kept.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item (or a whole shorter item) go."""
    return decontaminate.drop_contaminated(docs, queries.read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the words stay, dealt to domains, languages and sources by weight; no document twice."""
    out = mixing.mix(docs, queries.mix_levels(), queries.MIX_WEIGHTS, F.expr("(_all * 9) div 10"), max_epochs=1, seed=queries.MIX_SEED)
    return out.select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; a row a document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    return token_files.token_digests(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", tokens),
]

#: Shingle components and byte-pair ids are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
