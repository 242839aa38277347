"""The queries of the corpus operators and their SQL; ``__spark_entry__`` adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.llm import decontaminate, filter_audit, fingerprints, jaccard_join, mixing, ngram_lm, quality_model, quality_rules, token_counts, token_files, toxicity, url_filter, url_labels, whitening
from chronomotif.llm.common import written


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


#: The tree of op3: a domain from the source's number, language, source; percent and unit weights.
MIX_WEIGHTS: list[dict[str, int]] = [{"bulk": 20, "web": 50, "curated": 30}, {"en": 60, "de": 15, "fr": 15, "es": 10}, {}]
MIX_DOMAIN_SQL = "CASE WHEN source = 'src0' THEN 'bulk' WHEN length(source) = 4 THEN 'web' ELSE 'curated' END"
MIX_SEED = 17


def mix_levels() -> dict:
    return {"domain": F.expr(MIX_DOMAIN_SQL), "lang": F.col("lang"), "source": F.col("source")}


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80 % of all words, each source at most twice."""
    docs = read(spark, sf_dir, "documents")
    out = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, F.expr("(_all * 8) div 10"), max_epochs=2, seed=MIX_SEED)
    return out.select("row.doc_id", "domain", "lang", "source", "tokens", "copies")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents")).drop("broken_rule")


# The rules of the contract (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(url_labels.rows(), "url string, label int")
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES, labelled)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = ngram_lm.held_out("doc_id", 7, 2)
    model = ngram_lm.train(docs.where(~held_out), order=3)
    scored = written(ngram_lm.score(docs, model, extra=[held_out.alias("held_out")]), "scored")  # numbers only
    ngram_lm.drop_model(spark, model)
    return scored.withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = ngram_lm.held_out("doc_id", 5, 0)
    scored = toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_token_counts, op3_source_mixing, op4_quality_rules, op5_url_filter, op6_jaccard_join, op7_lm_scoring, op8_quality_model, op9_decontamination, op10_toxicity, op11_fingerprints, op12_embedding_whitening, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_source_mixing": mixing.mix_sql("documents", {"domain": MIX_DOMAIN_SQL, "lang": "lang", "source": "source"}, MIX_WEIGHTS, "(_all * 8) // 10", 2, MIX_SEED),
        "op4_quality_rules": quality_rules.measures_sql(),
        "op11_fingerprints": fingerprints.edited_sql(),
        "op13_filter_audit": filter_audit.audit_sql(),
    }
