"""Filter interaction audit: what each of five filters removes in every order in which they can be applied.

``document_flags`` measures every document once: a bit for each filter that it fails, in one scan and one join. ``replay``
is direct and relational: the flags of every document meet the 120 orders, a broadcast table of fixed size, the five steps of
each order are exploded, the first step that fails is computed, and everything is counted with conditional sums that are
combined before the only shuffle, which holds a row a task for each part, order and step.

The fifth filter (a copy of a text with a smaller id) compares SHA-256 of whole texts: least id by digest, combined before the
shuffle, and joined back to the slim table of flags only where a digest occurs twice. The digest of a text that a third of all
rows share is one key on the large side of that join alone, which Spark's skew join splits. Flags are dealt anew by rows before
they meet the orders, so no task depends on how texts, ids or parts are spread.

Defined cases: a null text is empty (no words, and equal to other empty texts); a null language is the part ''; a null id has
no labels and is neither smaller nor greater than another; rows of one id aren't copies of each other, each counts; ids with
several label rows are good or toxic if one row says so; very long texts are measured whole; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronomotif.llm.common import written
from chronomotif.llm.quality_rules import SPACES

LETTERS = "ABCDE"
COPY = "E"
#: Documents that one task replays at least, 600 rows each.
ROWS_A_TASK = 20_000
MOST_TASKS = 1 << 14


def conditions(body: Column, words: Column) -> dict[str, Column]:
    """Failure conditions of the filters that one text decides, by letter."""
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.regexp_count(body, F.lit("[A-Z]")) * F.lit(100).cast("long") > F.length(body) * F.lit(10).cast("long"),
        "D": body.rlike(r"[#$%&*|]"),
    }


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def document_flags(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, mask): the bits of the filters that each document fails. Reads a table of ``written``, which holds no texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    split = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("_t"), words.alias("_w"))
    own = [F.when(fails, F.lit(bit(letter))).otherwise(F.lit(0)) for letter, fails in conditions(F.col("_t"), F.col("_w")).items()]
    facts = written(split.select("id", "part", sum(own[1:], own[0]).alias("own"), F.unhex(F.sha2("_t", 256)).alias("digest")), "flags")
    firsts = written(facts.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("_n")).where("_n > 1").select("digest", "first"), "first-ids")  # so the join below can be split
    copy = F.when(F.col("id") > F.col("first"), F.lit(bit(COPY))).otherwise(F.lit(0))
    return facts.join(firsts, "digest", "left").select("id", "part", (F.col("own") + copy).alias("mask"))


def with_labels(flags: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``flags`` with booleans good and toxic."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return flags.join(known, "id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def replay(flags: DataFrame, n_rows: int) -> DataFrame:
    """Counts for each (part, filter_order, step) of ``flags`` (part, mask, good, toxic); ``n_rows`` deals them to tasks."""
    spark = flags.sparkSession
    names = [f"b{k}" for k in range(1, len(LETTERS) + 1)]
    orders = spark.createDataFrame([("".join(p), *map(bit, p)) for p in permutations(LETTERS)], f"filter_order string, {', '.join(f'{b} int' for b in names)}")
    tasks = max(spark.sparkContext.defaultParallelism, min(MOST_TASKS, -(-n_rows // ROWS_A_TASK)))
    crossed = flags.repartition(tasks).crossJoin(F.broadcast(orders))  # 120 rows, always
    mask = F.col("mask")
    first = F.lit(len(LETTERS) + 1)
    for k, b in reversed(list(enumerate(names, 1))):
        first = F.when(mask.bitwiseAND(F.col(b)) != 0, F.lit(k)).otherwise(first)
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(b).alias("bit")) for k, b in enumerate(names, 1)]))
    rows = crossed.select("part", "filter_order", "mask", "good", "toxic", first.alias("first"), steps.alias("s")).select("*", "s.step", "s.bit")
    removed = F.col("first") == F.col("step")
    counts = rows.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if((mask.bitwiseAND(F.col("bit")) != 0) & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(mask == F.col("bit")).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return counts.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", letter)))  # 600 rows a part


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    flags = written(with_labels(document_flags(docs, id_col, text, part), labels, id_col), "labelled-flags")
    return replay(flags, flags.count())


def audit_sql(docs: str = "documents", labels: str = "labels") -> str:
    """DuckDB SQL with the same rows."""
    spaces = r"[^\x20\x09-\x0D]+"
    bits = ", ".join(f"('{x}', {bit(x)})" for x in LETTERS)
    return f"""
WITH bits(l, b) AS (VALUES {bits}),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM bits a, bits b, bits c, bits d, bits e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{spaces}') AS w FROM {docs}),
firsts AS (SELECT t, min(doc_id) AS f FROM t GROUP BY t),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM {labels} GROUP BY doc_id),
flags AS (SELECT part, (len(w) < 100)::INT * 1 + (100 * len(list_distinct(w)) < 80 * len(w))::INT * 2 + (100 * len(regexp_extract_all(t.t, '[A-Z]')) > 10 * length(t.t))::INT * 4
 + regexp_matches(t.t, '[#$%&*|]')::INT * 8 + coalesce(t.doc_id > f, false)::INT * 16 AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
 FROM t LEFT JOIN firsts ON firsts.t = t.t LEFT JOIN known ON known.doc_id = t.doc_id),
ordered AS (SELECT o, s.step, b AS bit FROM orders, (SELECT unnest(range(1, 6)) AS step) s, bits WHERE bits.l = substr(o, s.step, 1)),
before AS (SELECT x.o, x.step, x.bit, coalesce(sum(y.bit), 0)::INT AS earlier FROM ordered x LEFT JOIN ordered y ON y.o = x.o AND y.step < x.step GROUP BY ALL),
counts AS (SELECT part, o AS filter_order, CAST(step AS INT) AS step, bit, count(*) FILTER (mask & earlier = 0 AND mask & bit = 0) AS kept, count(*) FILTER (mask & earlier = 0 AND mask & bit <> 0) AS removed,
 count(*) FILTER (mask & earlier <> 0 AND mask & bit <> 0) AS redundant, count(*) FILTER (mask = bit) AS unique_fails, count(*) FILTER (mask & earlier = 0 AND mask & bit <> 0 AND good) AS good_lost,
 count(*) FILTER (mask & earlier = 0 AND mask & bit <> 0 AND toxic) AS toxic_lost FROM flags, before GROUP BY ALL)
SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counts"""
