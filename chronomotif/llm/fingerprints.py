"""Document fingerprints: bottom-k sketches of word shingles, with functions of DataFrame and SQL only.

A sketch is the ``k`` smallest distinct hashes (the first 64 bits of MD5, as 16 hexadecimal digits) of a text's shingles of
``size`` words, ascending; the hashes in one string are its fingerprint. A text with fewer words is one shingle, a text without
words has none. Words are runs without white space, compared as written. A sketch of at most ``k`` shingles is the whole set.

Sketches merge: the ``k`` smallest of both are the sketch of the texts together (``merge`` for two columns, ``merged`` for the
rows of groups). ``resemblance`` is the share of the joint sketch that lies in both, ``containment`` the estimated share of one
set that the other holds, ``n_distinct`` the number of shingles: counted for small sets, else by the rank and value of the
largest hash kept. The standard error of a resemblance r is about sqrt(r * (1 - r) / k), 0.044 at most with k = 128.

``edited_fingerprints`` compares every document with its edited text, whose last quarter is replaced by the beginning of the
next document, and with that document. Documents are dealt once to ranges of consecutive ids: bounds are keys (id, hash of the
text) of the table itself, from a sample of bounded size, so that the first row of a range is known where it is read and is
sent to the range before it as well. One exchange of texts serves both looks at the next row; no range depends on how ids are
spread, and one id with many texts is cut too. Rows equal in id and text are one range's.

Defined cases: a null text is empty; two texts without words have resemblance and containment 1, an empty set is contained in
all; a single document is its own next one; null ids come first, rows of one id follow each other in the order of their texts'
hashes; very long texts are read whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronomotif.llm.quality_rules import SPACES

K = 128
SIZE = 5
DIGITS = 16
#: Rows of a range on average, ranges at most, keys in the sample for each and in all.
ROWS_A_RANGE = 500
MOST_RANGES = 1 << 16
SAMPLED = 16
MOST_SAMPLED = 1 << 18


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once a row."""
    return F.transform(F.array(value), of)[0]


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return _let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def sketch(text: Column, size: int = SIZE, k: int = K) -> Column:
    """The k smallest distinct shingle hashes of a text, ascending."""
    shingle = lambda w, i: F.substring(F.md5(F.array_join(F.slice(w, i, size), " ")), 1, DIGITS)
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: shingle(w, i))
    return _let(words(text), lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.slice(F.sort_array(F.array_distinct(hashes(w))), 1, k)))


def fingerprint(of: Column) -> Column:
    """A sketch as one string."""
    return F.array_join(of, "")


def from_fingerprint(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated size of the intersection over that of the union."""
    shared = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b)))
    return _let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(shared(u) / F.size(u)))


def n_distinct(of: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, as a double: (k - 1) over the part of all hash values up to the largest one kept."""
    largest = F.conv(F.substring(F.element_at(of, -1), 1, 13), 16, 10).cast("double") + 1.0
    return F.when(F.size(of) < k, F.size(of).cast("double")).otherwise(F.lit(float((k - 1) << 52)) / largest)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, 0 to 1."""
    both = resemblance(a, b, k) * n_distinct(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / n_distinct(a, k)))


def merged(sketches: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """(by, sketch): one sketch for the rows of each group.

    Hashes above the largest of any full sketch of the group can't be among its k smallest and go first. The others become
    distinct in tasks and by (group, hash); each task then passes on the k smallest of a group, so a group's last task reads k
    rows a task, whatever the group's size.
    """
    keys = [F.col(c) for c in by]
    full = F.when(F.size(column) >= k, F.element_at(column, k))
    bound = sketches.groupBy(*keys).agg(F.min(full).alias("_bound")).select(F.struct(*by).alias("_g"), "_bound")
    rows = sketches.select(F.struct(*by).alias("_k"), F.col(column).alias("_s")).join(bound, F.col("_k").eqNullSafe(F.col("_g")))
    hashes = rows.select("_g", F.explode_outer(F.filter("_s", lambda h: F.coalesce(h <= F.col("_bound"), F.lit(True)))).alias("_h")).distinct()
    least = hashes.withColumn("_n", F.row_number().over(W.partitionBy("_g").orderBy(F.col("_h").asc_nulls_last()))).where(F.col("_n") <= k)
    return least.groupBy("_g").agg(F.sort_array(F.collect_list("_h")).alias(column)).select("_g.*", column)


def _ranges(slim: DataFrame, rows_a_range: int) -> list[str]:
    """Ascending keys of ``slim`` (key) as JSON, the least first; each begins a range."""
    as_json = F.to_json("key", {"ignoreNullFields": "false"})
    n, least = slim.agg(F.count("*"), F.to_json(F.min("key"), {"ignoreNullFields": "false"})).first()
    if not n:
        return []
    sampled = max(1, min(MOST_RANGES, n // rows_a_range)) * SAMPLED
    some = slim.distinct().orderBy(F.xxhash64("key"), "key").limit(min(sampled, MOST_SAMPLED))
    found = [r[0] for r in some.orderBy("key").select(as_json).collect()]  # MOST_SAMPLED at most
    step = SAMPLED if sampled <= MOST_SAMPLED else -(-len(found) // (sampled // SAMPLED))
    return list(dict.fromkeys([least, *found[step::step]]))


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rows_a_range: int = ROWS_A_RANGE) -> tuple[DataFrame, W]:
    """(id, text, range, guest, h) with the first row of each range in the one before it too, as guest; and the window in which the next row leads."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    slim = own.select(F.struct("id", "h").alias("key"))
    bounds = _ranges(slim, rows_a_range)
    n = max(1, len(bounds))
    wide = max(1, int(n**0.5))
    kind = f"array<{slim.schema['key'].dataType.simpleString()}>"
    every = F.from_json(F.lit(f"[{','.join(bounds)}]"), kind)
    some = F.from_json(F.lit(f"[{','.join(bounds[::wide])}]"), kind)
    key = F.struct("id", "h")
    below = lambda keys: F.size(F.filter(keys, lambda b: b <= key))
    block = (F.greatest(below(some), F.lit(1)) - 1) * wide
    placed = own.withColumn("block", block).withColumn("range", F.col("block") + below(F.slice(every, F.col("block") + 1, wide)) - 1)
    first = F.get(every, F.col("range")).eqNullSafe(key)
    host, guest = (F.struct(r.cast("int").alias("range"), F.lit(g).alias("guest")) for r, g in ((F.col("range"), 0), (F.pmod(F.col("range") - 1, F.lit(n)), 1)))
    dealt = placed.select("id", "text", "h", F.explode(F.when(first, F.array(host, guest)).otherwise(F.array(host))).alias("to")).select("id", "text", "h", "to.*")
    return dealt, W.partitionBy("range").orderBy("guest", "id", "h")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, k: int = K, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_distinct, in_edited) of every document."""
    rows, w = with_next(docs, id_col, text, rows_a_range)
    rows = rows.withColumn("next", F.lead("text").over(w)).withColumn("n_chars", F.length("text").cast("long"))
    moved = F.expr("int(n_chars div 4)")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - moved), F.left(F.coalesce("next", F.lit("")), moved))
    rows = rows.select("id", "range", "guest", "h", "n_chars", "text", edited.alias("edited"))
    sketches = rows.select("id", "range", "guest", "h", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text"), size, k).alias("s"), sketch(F.col("edited"), size, k).alias("e"))
    found = sketches.withColumn("after", F.lead("s").over(w)).where("guest = 0")
    s, e = F.col("s"), F.col("e")
    return found.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint(s).alias("fingerprint"), fingerprint(e).alias("edited_fingerprint"),
        resemblance(s, e, k).alias("near_edited"), resemblance(s, F.col("after"), k).alias("near_next"), n_distinct(s, k).alias("n_distinct"), containment(s, e, k).alias("in_edited"),
    )


def edited_sql(docs: str = "documents", size: int = SIZE, k: int = K) -> str:
    """DuckDB SQL with the same rows, for tables with distinct ids."""
    ws = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
    hashes = f"list_sort(list_distinct(list_transform(range(1, greatest(len({{w}}) - {size - 1}, least(len({{w}}), 1)) + 1), lambda i: substr(md5(array_to_string({{w}}[i:i + {size - 1}], ' ')), 1, {DIGITS}))))[1:{k}]"
    distinct = f"CASE WHEN len({{s}}) < {k} THEN len({{s}})::DOUBLE ELSE {float((k - 1) << 52)!r} / (('0x' || substr({{s}}[-1], 1, 13))::BIGINT::DOUBLE + 1.0) END"
    near = "CASE WHEN len({u}) = 0 THEN 1.0 ELSE len(list_intersect({u}, list_intersect({a}, {b})))::DOUBLE / len({u}) END"
    union = f"list_sort(list_distinct(list_concat({{a}}, {{b}})))[1:{k}]"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM t),
e AS (SELECT doc_id, t, n, t[1:n - n // 4] || nt[1:n // 4] AS e FROM n),
w AS (SELECT doc_id, n, sha256(e) AS sha, {ws.format('t')} AS tw, {ws.format('e')} AS ew FROM e),
s AS (SELECT doc_id, n, sha, {hashes.format(w='tw')} AS s, {hashes.format(w='ew')} AS e FROM w),
a AS (SELECT *, coalesce(lead(s) OVER (ORDER BY doc_id), first_value(s) OVER (ORDER BY doc_id)) AS x FROM s),
u AS (SELECT *, {union.format(a='s', b='e')} AS se, {union.format(a='s', b='x')} AS sx FROM a),
r AS (SELECT *, {near.format(u='se', a='s', b='e')} AS near_edited, {near.format(u='sx', a='s', b='x')} AS near_next, {distinct.format(s='s')} AS n_distinct, {distinct.format(s='se')} AS n_union FROM u)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha AS edited_sha256, array_to_string(s, '') AS fingerprint, array_to_string(e, '') AS edited_fingerprint, near_edited, near_next, n_distinct,
 CASE WHEN len(s) = 0 THEN 1.0 ELSE least(1.0, near_edited * n_union / n_distinct) END AS in_edited FROM r"""
