"""Quality rules: a threshold table compiled into one native projection.

Every row of ``THRESHOLDS`` is a ratio of two measured integers with an allowed range in thousandths; the table is
compiled into one boolean expression (``compile_rules``), so a document passes or fails inside the scan stage: no
shuffle, no user function. Integer arithmetic keeps the verdict exact.

Defined cases: a null or empty text has no words, all measures 0, ``base_failed`` true, ``kept`` false. Very long texts
are measured whole (sorting is n log n within one row). Repeated rows are judged one by one. Extra columns pass through
``quality_filter`` untouched, even when they bear the name of a measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SPACES = " \t\n\x0b\x0c\r"

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to a in is that for it as was with be by on not this are or from at an".split(),
    "de": "der die und das in zu den von mit ist im nicht ein eine auf für sich des dem".split(),
    "fr": "le la les de des du et en un une que qui est pour dans par sur au".split(),
    "es": "el la los las de del y en un una que es por para con no se su al lo".split(),
}

#: name, measured part, measured whole, least and most of the ratio in thousandths (None: open).
THRESHOLDS = [
    ("word_length", "word_chars", "n_words", 2000, 14000),
    ("symbols", "n_symbols", "word_chars", None, 40),
    ("shouts", "n_marks", "n_words", None, 400),
    ("stop_words", "n_stop_words", "n_words", 10, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 500),
]


def _stop_forms() -> list[str]:
    forms = {f for words in STOP_WORDS.values() for w in words for f in (w, w.capitalize(), w.upper())}
    return sorted(forms)


def measure(docs: DataFrame, text: str = "text", out: str = "_m") -> DataFrame:
    """Adds one struct column ``out`` of all measures; the words are split once."""
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACES))
    df = docs.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    df = df.withColumn("_l", F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""))
    words, n = F.col("_w"), F.size("_w")
    # Windows sorted with their places: equal ones are neighbours.
    n_windows = n - 2
    windows = F.arrays_zip(F.slice(words, F.lit(1), n_windows).alias("a"), F.slice(words, F.lit(2), n_windows).alias("b"), F.slice(words, F.lit(3), n_windows).alias("c"), F.sequence(F.lit(0), n_windows - 1).alias("p"))
    fields = "array<struct<a:string,b:string,c:string,p:int>>"
    df = df.withColumn("_s", F.when(n >= 4, F.sort_array(windows.cast(fields))).otherwise(F.array().cast(fields)))
    s = F.col("_s")
    same = lambda i: (s[i]["a"] == s[i - 1]["a"]) & (s[i]["b"] == s[i - 1]["b"]) & (s[i]["c"] == s[i - 1]["c"])
    df = df.withColumn("_e", F.when(F.size(s) > 1, F.filter(F.sequence(F.lit(1), F.size(s) - 1), same)).otherwise(F.array().cast("array<int>")))
    e = F.col("_e")
    df = df.withColumn("_p", F.sort_array(F.concat(F.transform(e, lambda i: s[i]["p"]), F.transform(e, lambda i: s[i - 1]["p"]))))
    p, zero = F.col("_p"), F.lit(0).cast("long")
    covered = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), zero, lambda acc, i: acc + F.least(p[i] - p[i - 1], F.lit(3)))
    repeats = F.when(F.size(p) > 1, covered + 3).otherwise(zero)
    # explode(array(one)) keeps a later filter on a measure above it: pushed down, it would inline the sort into its own lambdas.
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array(
        F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(body, F.lit(r"[!?]")).cast("long").alias("n_marks"),
            F.size(F.filter(words, lambda w: w.isin(_stop_forms()))).cast("long").alias("n_stop_words"),
            F.size("_l").cast("long").alias("n_lines"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            repeats.alias("n_repeat_words"),
        ),
    )).alias(out))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def compile_rules(m: Column, table: list[tuple] = THRESHOLDS) -> Column:
    """The first rule of the table that a row breaks, or null."""
    broken = F.lit(None).cast("string")
    for name, part, whole, least, most in reversed(table):
        fails = F.lit(False)
        if least is not None:
            fails = fails | (m[part] * 1000 < m[whole] * least)
        if most is not None:
            fails = fails | (m[part] * 1000 > m[whole] * most)
        broken = F.when(fails, F.lit(name)).otherwise(broken)
    return broken


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, measures, base_failed, broken_rule, kept) of every row."""
    df = measure(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")), "_t")
    m = F.col("_m")
    df = df.withColumn("base_failed", base_failed(m)).withColumn("broken_rule", compile_rules(m))
    return df.select(F.col("_id").alias(id_col), "_m.*", "base_failed", "broken_rule", (~F.col("base_failed") & F.col("broken_rule").isNull()).alias("kept"))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, columns unchanged."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_t"))
    df = measure(inner, "_t")
    m = F.col("_m")
    return df.where(~base_failed(m) & compile_rules(m).isNull()).select("_row.*")


def rules_sql(table: list[tuple] = THRESHOLDS) -> str:
    """The table as an SQL condition that holds for rows that pass."""
    parts = []
    for _, part, whole, least, most in table:
        if least is not None:
            parts.append(f"{part} * 1000 >= {whole} * {least}")
        if most is not None:
            parts.append(f"{part} * 1000 <= {whole} * {most}")
    return " AND ".join(parts)


def measures_sql(source: str = "documents") -> str:
    """DuckDB SQL with the same columns as ``quality_rules`` (without broken_rule)."""
    stops = ", ".join("'" + w + "'" for w in _stop_forms())
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM {source}),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM base),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
keyed AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS k FROM win),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS c FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
 CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(t, '[!?]')) AS BIGINT) AS n_marks,
 CAST(len(list_filter(ws, lambda x: x IN ({stops}))) AS BIGINT) AS n_stop_words, CAST(len(ls) AS BIGINT) AS n_lines,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words
 FROM w LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {rules_sql(table=THRESHOLDS)} AS kept FROM v"""
