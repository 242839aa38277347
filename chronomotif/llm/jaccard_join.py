"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, exact sorted-array intersection at the end.

A document's set: the distinct ``k``-word shingles of its text (A-Z lower-cased), as 64-bit hashes, sorted. Documents with
the same set form one class, so copies are never paired. Two classes link when 100 * |A & B| >= percent * |A | B|.

1. ``profiles``: one row a document: set size, class key (a hash of the sorted set) and a parity bitmap of four to eight bits
   a shingle. Each task also reports shingles that repeat among its documents; the most frequent (``hot_size`` at most)
   go last in the order of shingles, for every document alike. Any order gives the same result; this one keeps tiles small.
2. Tiles: each class emits its prefix in that order, the |A| - ceil(percent |A|) + 1 first shingles; linked classes share
   one of them. The classes of a shingle, sorted by size, are a tile. In small tiles all pairs within the size band are
   candidates. Of its large tiles each class first looks at the ``NEAR_TILES`` with the least shingles, the same ones for near
   copies: dealt into parts with common members, it takes its ``near`` nearest by bitmap among its neighbours in size there.
   Step 5 settles what that leaves. The most frequent shingles are dealt into parts from the start.
3. The bit counts of two bitmaps, folded to the narrower one, bound the overlap from above:
   |A & B| <= (|A| + |B| - popcount(A xor B)) / 2. What passes is a candidate pair.
4. Exact intersection: the components of the candidate pairs are dealt into blocks of bounded size, and the sets of two blocks
   with candidate pairs between them meet in one task, so a set is shipped once for each block that it has candidates in,
   nearly always once. There a pair whose ends are already linked through others is settled without intersection. Only classes
   in candidate pairs ship their sets, found by a fixed-size bit table.
5. Components by label passing and pointer jumping, in tables. Then the large tiles that hold several components again: block
   by block, pairs of *different* components within the size band that pass the bitmap bound are intersected as in 4. So no
   link between components is lost, and a large group of near copies costs no pair list: once linked, its pairs are skipped.

The operator returns components, not links. Its tables in the shared folder are deleted as soon as their successors are written.

Defined cases: null or empty texts have no shingles, size 0, and are components of their own; a text with fewer than
``k`` words is one shingle; very long texts are shingled whole; repeated rows and ids each get a row, in one class; an
empty table gives no rows; a null id is a row like any other and names no component that has other ids; ids of any type that can be
ordered do; extra columns are not read. Set equality and shingles rest on 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronomotif.llm.common import dropped, ship, tidy, written
from chronomotif.llm.components import components

SMALL = 8
BLOCK = 1024
PART = 2048
ANCHORS = 64
NEAR_TILES = 4
HOT = 50_000
SETS, SHINGLES = 256, 4_000_000
FILTER_BITS = 26
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xFF51AFD7ED558CCD)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    width = min(k, len(h))
    out = np.full(n, len(h) if len(h) < k else 0, np.uint64)
    for i in range(width):
        out = out * _P + h[i : i + n]
    out ^= out >> np.uint64(33)
    out *= _Q
    out ^= out >> np.uint64(29)
    return np.unique(out)


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit hash of the set."""
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles in each slot; as many bits as the next power of two from four times the size, 64 to 131072."""
    width = 1 << min(17, max(6, int(4 * len(s) - 1).bit_length()))
    counts = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(raw: bytes, words: int) -> np.ndarray:
    """A bitmap as ``words`` 64-bit words: halves are combined by xor, which keeps the parity of each slot."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, words), axis=0)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def may_link(na: np.ndarray, nb: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether the most overlap that bit counts allow could reach the threshold."""
    both = na + nb
    return (100 + percent) * (both - apart) >= 2 * percent * both


def _profiles(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(id, n, key, bits) of documents, and (null, count, shingle, null) of shingles that repeat in a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: list[np.ndarray] = []
        held, seen = 0, set()

        def repeats() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(low) if low else np.empty(0, np.uint64), return_counts=True)
            some = counts >= 3
            n = int(some.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(n, id_arrow), pa.array(counts[some].astype(np.int64)), pa.array(values[some].view(np.int64)), pa.nulls(n, pa.binary())], names=["id", "n", "key", "bits"])

        for batch in batches:
            sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary())], names=["id", "n", "key", "bits"])
            for s, key in zip(sets, keys, strict=True):
                if key not in seen:  # prefixes hold the lowest hashes
                    seen.add(key)
                    low.append(s[: np.searchsorted(s, np.uint64(1 << 62))])
                    held += len(low[-1])
            if held > 4_000_000:
                yield repeats()
                low, held = [], 0
        yield repeats()

    id_type = docs.schema[id_col].dataType
    id_arrow = to_arrow_type(id_type)
    return docs.select(id_col, text).mapInArrow(tidy(run), f"id {id_type.simpleString()}, n bigint, key bigint, bits binary")


def _prefixes(docs: DataFrame, text: str, k: int, percent: int, hot) -> DataFrame:
    """(s, part, key, n): a row for each prefix shingle of each class, once a task; part 0, from 1 on where the shingle is dealt into parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        late, parts = hot.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out: list[np.ndarray] = []
                part: list[np.ndarray] = []
                keys: list[int] = []
                sizes: list[int] = []
                for t in batch.column(0).slice(at, 500).to_pylist():
                    s = shingles(t, k)
                    if not len(s):
                        continue
                    key = set_key(s)
                    if key in seen:
                        continue
                    seen.add(key)
                    dealt = np.zeros(len(s), np.int64)
                    if len(late):
                        spot = np.minimum(np.searchsorted(late, s), len(late) - 1)
                        is_late = late[spot] == s
                        if is_late.any():
                            many = parts[spot[is_late]]
                            s = np.concatenate([s[~is_late], s[is_late]])
                            dealt[len(s) - len(many) :] = np.where(many > 1, key % many + 1, 0)
                    p = prefix_length(len(s), percent)
                    out.append(s[:p])
                    part.append(dealt[:p])
                    keys.append(key)
                    sizes.append(len(s))
                if out:
                    counts = [len(o) for o in out]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(part)), pa.array(np.repeat(np.array(keys, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int64), counts))], names=["s", "part", "key", "n"])

    return docs.select(text).mapInArrow(tidy(run), "s bigint, part bigint, key bigint, n bigint")


def whole_groups(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[list[pa.Array]]:
    """Columns of sorted rows, cut so that no group of ``column`` is split."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(column).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(g, g[-1], "left")) if g[0] != g[-1] else 0
        if held and held[-1].column(column)[-1].as_py() != g[0]:
            yield [c.combine_chunks() for c in pa.concat_tables(held).columns]
            held = []
        if cut:
            held.append(pa.Table.from_batches([batch.slice(0, cut)]))
            yield [c.combine_chunks() for c in pa.concat_tables(held).columns]
            held = []
        held.append(pa.Table.from_batches([batch.slice(cut)]))
    if held:
        yield [c.combine_chunks() for c in pa.concat_tables(held).columns]


def _runs(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal runs."""
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return starts, np.diff(np.append(starts, len(g)))


def _first_tiles(prefixes: DataFrame, percent: int) -> DataFrame:
    """(s, a, b, n): pairs a < b from small tiles (s null), members a of large tiles (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches):
            s, part, n, key = (c.to_numpy(zero_copy_only=False) for c in columns)
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (part[1:] != part[:-1])])
            fresh = new | np.concatenate([[True], key[1:] != key[:-1]])
            s, part, n, key, new = s[fresh], part[fresh], n[fresh], key[fresh], new[fresh]
            lengths = np.diff(np.append(np.flatnonzero(new), len(s)))
            size = np.repeat(lengths, lengths)
            large = (size > SMALL) | (part > 0)
            small = (size > 1) & ~large
            s2, n2, k2 = s[small], n[small], key[small]
            a, b = [], []
            for d in range(1, SMALL):
                if len(s2) > d:
                    ok = (s2[d:] == s2[:-d]) & (100 * n2[:-d] >= percent * n2[d:])
                    a.append(np.minimum(k2[:-d], k2[d:])[ok])
                    b.append(np.maximum(k2[:-d], k2[d:])[ok])
            if a:
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
                m = len(pairs)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(m, pa.int64())], names=["s", "a", "b", "n"])
            if large.any():
                m = int(large.sum())
                yield pa.RecordBatch.from_arrays([pa.array(s[large]), pa.array(key[large]), pa.nulls(m, pa.int64()), pa.array(n[large])], names=["s", "a", "b", "n"])

    return prefixes.select("s", "part", "n", "key").repartition("s", "part").sortWithinPartitions("s", "part", "n", "key").mapInArrow(tidy(run), "s bigint, a bigint, b bigint, n bigint")


def _apart(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """popcount(xor) of all bitmaps of x with all of y, folded to the narrowest of them."""
    words = min(map(len, (*x, *y)))
    fold = lambda rows: np.stack([np.bitwise_xor.reduce(r.reshape(-1, words), axis=0) for r in rows])
    rows, others = fold(x), fold(y)
    out = np.zeros((len(x), len(y)), np.int64)
    for w in range(words):
        out += np.bitwise_count(rows[:, w, None] ^ others[None, :, w])
    return out


def _pair_apart(x: np.ndarray, y: np.ndarray) -> int:
    """popcount(xor) of two bitmaps, the wider folded."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < len(y):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _passing(n: np.ndarray, bits: list[np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of places (x, y) may link by size and by their own bitmaps."""
    apart = np.fromiter((_pair_apart(bits[i], bits[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)), np.int64, len(x))
    return may_link(n[x], n[y], apart, percent) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))


def _pair_rows(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(key[x], key[y]), np.maximum(key[x], key[y])], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _near_pairs(tiles: DataFrame, classes: DataFrame, percent: int, near: int) -> DataFrame:
    """(a, b): of each member of a large tile the nearest by bitmap in its block and the one before it in size order.

    Tiles beyond ``PART`` members are dealt into parts by hash; about ``ANCHORS`` members go to all parts and tie them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches):
            s, part, n, key = (c.to_numpy(zero_copy_only=False) for c in columns[:4])
            bits = [np.frombuffer(b, np.uint64) for b in columns[4].to_pylist()]
            found = []
            starts = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (part[1:] != part[:-1])]))
            for at, end in zip(starts, np.append(starts[1:], len(s)), strict=True):
                for i in range(at, end, BLOCK):
                    lo, hi = max(at, i - 64), min(i + BLOCK, end)
                    apart = _apart(bits[lo:hi], bits[lo:hi])
                    ok = may_link(n[lo:hi, None], n[None, lo:hi], apart, percent)
                    apart = np.where(ok, apart, 1 << 40)
                    np.fill_diagonal(apart, 1 << 40)
                    kept = min(near, hi - lo - 1)
                    if kept:
                        nearest = np.argpartition(apart, kept - 1, axis=1)[:, :kept]
                        x = np.repeat(np.arange(hi - lo), kept)
                        y = nearest.reshape(-1)
                        good = apart[x, y] < 1 << 40
                        found.append(lo + np.sort(np.stack([x[good], y[good]], 1), axis=1))
            if found:
                x, y = np.unique(np.concatenate(found), axis=0).T
                good = _passing(n, bits, x, y, percent)
                yield _pair_rows(key, x[good], y[good])

    few = tiles.groupBy("key").agg(F.slice(F.array_sort(F.collect_set("s")), 1, NEAR_TILES).alias("s"), F.first("n").alias("n"))
    tiles = few.select(F.explode("s").alias("s"), "key", "n")
    sizes = tiles.groupBy("s").agg(F.count("*").alias("m")).where("m > 1")
    own = F.pmod(F.xxhash64("key"), F.col("parts"))
    anchor = F.pmod(F.xxhash64("key", F.lit(1)), F.col("m")) < ANCHORS
    dealt = tiles.join(sizes, "s").withColumn("parts", F.expr(f"(m + {PART - 1}) div {PART}"))
    dealt = dealt.withColumn("part", F.explode(F.when((F.col("parts") > 1) & anchor, F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).otherwise(F.array(own))))
    rows = dealt.select("s", "part", "n", "key").join(classes.select("key", "bits"), "key").select("s", "part", "n", "key", "bits")
    return rows.repartition("s", "part").sortWithinPartitions("s", "part", "n", "key").mapInArrow(tidy(run), "a bigint, b bigint")


def _cross_pairs(tiles: DataFrame, roots: DataFrame, classes: DataFrame, percent: int, known: DataFrame) -> DataFrame:
    """(a, b): pairs of different components in a large tile, within the size band and the bitmap bound, without those ``known``.

    Tiles of one component are left out by counts alone. Of the others, a component of more than ``BLOCK`` members makes blocks
    of its own, the rest are dealt into blocks by hash; every two blocks meet in one task, but not two of one component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches):
            unit, side, n, key, root = (c.to_numpy(zero_copy_only=False) for c in columns[:5])
            bits = [np.frombuffer(b, np.uint64) for b in columns[5].to_pylist()]
            starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            for at, end in zip(starts, np.append(starts[1:], len(unit)), strict=True):
                middle = at + int(np.searchsorted(side[at:end], 1))
                alone = middle == end
                for i in range(at, middle, 256):
                    x = np.arange(i, min(i + 256, middle))
                    for j in range(i if alone else middle, end, 256):
                        y = np.arange(j, min(j + 256, end))
                        if 100 * min(n[x[-1]], n[y[-1]]) < percent * max(n[x[0]], n[y[0]]) or root[x].min() == root[x].max() == root[y].min() == root[y].max():
                            continue
                        ok = (root[x, None] != root[None, y]) & may_link(n[x, None], n[None, y], _apart(bits[x[0] : x[-1] + 1], bits[y[0] : y[-1] + 1]), percent)
                        if alone and i == j:
                            ok &= np.tri(len(x), k=-1, dtype=bool)
                        p, q = np.nonzero(ok)
                        p, q = x[p], y[q]
                        good = _passing(n, bits, p, q, percent)
                        if good.any():
                            yield _pair_rows(key, p[good], q[good])

    rooted = tiles.join(roots.select("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    counts = rooted.groupBy("s", "root").agg(F.count("*").alias("m"))
    sizes = counts.groupBy("s").agg(F.count("*").alias("several"), F.sum(F.when(F.col("m") <= BLOCK, F.col("m")).otherwise(0)).alias("others")).where("several > 1")
    shares = counts.join(sizes, "s").select("s", "root", F.when(F.col("m") > BLOCK, F.col("root")).alias("own"), F.expr(f"(if(m > {BLOCK}, m, others) + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
    members = rooted.join(shares, ["s", "root"]).select("s", "key", "n", "root", "own", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("h")).persist()
    blocks = members.select("s", F.struct(F.col("own").isNotNull().alias("is"), F.coalesce("own", F.lit(0)).alias("own"), "h").alias("x")).distinct()
    both = blocks.join(blocks.withColumnRenamed("x", "y"), "s").where("x <= y and not (x.is and y.is and x.own = y.own)")
    units = both.withColumn("unit", F.xxhash64("s", "x", "y"))
    sides = units.select("s", F.col("x").alias("block"), "unit", F.lit(0).alias("side")).unionByName(units.where("x < y").select("s", F.col("y").alias("block"), "unit", F.lit(1).alias("side")))
    rows = members.withColumn("block", F.struct(F.col("own").isNotNull().alias("is"), F.coalesce("own", F.lit(0)).alias("own"), "h")).join(sides, ["s", "block"]).join(classes.select("key", "bits"), "key")
    found = rows.select("unit", "side", "n", "key", "root", "bits").repartition("unit").sortWithinPartitions("unit", "side", "n", "key").mapInArrow(tidy(run), "a bigint, b bigint")
    pairs = written(found.distinct().join(known, ["a", "b"], "left_anti"), "join-cross")
    members.unpersist()
    return pairs


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps leave the threshold possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_bits, b_bits = ([np.frombuffer(b, np.uint64) for b in batch.column(k).to_pylist()] for k in (4, 5))
            apart = np.fromiter(map(_pair_apart, a_bits, b_bits), np.int64, len(a_bits))
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(may_link(na, nb, apart, percent)))

    left = classes.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("bits").alias("abits"))
    right = classes.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bbits"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "abits", "bbits").mapInArrow(tidy(run), "a bigint, b bigint")


def _bit_table(ids: DataFrame) -> np.ndarray:
    """A fixed-size bit table (2 ** FILTER_BITS bits) of the ids' hashes, built in 1024 parts."""
    part_bits = FILTER_BITS - 10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches):
            part, slot = (c.to_numpy(zero_copy_only=False) for c in columns)
            for at, m in zip(*_runs(part), strict=True):
                bits = np.zeros(1 << part_bits, np.uint8)
                bits[slot[at : at + m]] = 1
                yield pa.RecordBatch.from_arrays([pa.array([part[at]], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    h = F.xxhash64("id")
    parts = ids.select(F.shiftrightunsigned(h, 54).alias("part"), F.shiftrightunsigned(h, 54 - part_bits).bitwiseAND((1 << part_bits) - 1).alias("slot")).distinct()
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    width = 1 << (part_bits - 3)
    for r in parts.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(run), "part bigint, bits binary").collect():
        table[r["part"] * width : (r["part"] + 1) * width] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return table


def _sets(docs: DataFrame, id_col: str, text: str, k: int, keys: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, members): the sorted sets of the classes in ``keys``; only their first documents are shingled again."""
    wanted = keys.join(classes.select("key", "rep"), "key")
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(wanted.select(F.col("rep").alias("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            slot = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            hit = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
            rows = batch.filter(pa.array(hit.astype(bool)))
            for at in range(0, rows.num_rows, 500):
                sets = [shingles(t, k) for t in rows.column(1).slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "members"])

    return docs.select(F.xxhash64(id_col).alias("h"), F.col(text)).mapInArrow(tidy(run), "key bigint, members binary")


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact: whether two sorted sets reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _links(pairs: DataFrame, docs: DataFrame, id_col: str, text: str, k: int, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join what the pairs that reach the threshold join, a table of ``written``.

    A component of the candidate pairs is dealt into blocks by hash, about ``SETS`` classes and ``SHINGLES`` shingles each; pairs
    meet their sets in a task for each two blocks that have any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, asked, sets = None, [], {}

        def settled() -> pa.RecordBatch:
            above = {x: x for x in sets}

            def top(x: int) -> int:
                while above[x] != x:
                    above[x] = x = above[above[x]]
                return x

            for a, b in asked:
                a_top, b_top = top(a), top(b)
                if a_top != b_top and _reaches(sets[a], sets[b], percent):
                    above[max(a_top, b_top)] = min(a_top, b_top)
            joined = [(top(x), x) for x in sets if above[x] != x]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in joined], pa.int64()), pa.array([x for _, x in joined], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *of, members, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != unit:
                    if asked:
                        yield settled()
                    unit, asked, sets = of, [], {}
                if members is None:
                    asked.append((a, b))
                else:
                    sets[a] = np.frombuffer(members, np.uint64)
        if asked:
            yield settled()

    roots = components(pairs)
    sized = roots.select("key", "root").join(classes.select("key", "n"), "key")
    parts = sized.groupBy("root").agg(F.expr(f"greatest((count(*) + {SETS - 1}) div {SETS}, (sum(n) + {SHINGLES - 1}) div {SHINGLES})").alias("parts"))
    placed = roots.select("key", "root").join(parts, "root").select("key", "root", F.pmod(F.xxhash64("key"), F.col("parts")).alias("block")).persist()
    ends = pairs.join(placed.select(F.col("key").alias("a"), "root", F.col("block").alias("x")), "a").join(placed.select(F.col("key").alias("b"), F.col("block").alias("y")), "b")
    asked = ends.select("root", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "a", "b").persist()
    needed = asked.select("root", "x", "y", F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = _sets(docs, id_col, text, k, placed.select("key"), classes)
    rows = needed.join(sets, "key").select("root", "x", "y", "members", F.col("key").alias("a"), F.lit(None).cast("bigint").alias("b"))
    rows = rows.unionByName(asked.withColumn("members", F.lit(None).cast("binary")))
    found = written(rows.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(tidy(run), "a bigint, b bigint"), "join-links")
    placed.unpersist()
    asked.unpersist()
    dropped(roots)
    return found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, hot_size: int = 200_000, near: int = 3) -> DataFrame:
    """(id, n_shingles, component_id) of every document; the component is named by its least id."""
    spark = docs.sparkSession
    ship(spark)
    both = written(_profiles(docs, id_col, text, k), "join-profiles")
    hot = both.where(F.col("bits").isNull()).groupBy("key").agg(F.sum("n").alias("n")).where("n >= 16").orderBy(F.desc("n"), "key").limit(hot_size)
    frequent = sorted((r["key"] % (1 << 64), -(-r["n"] // HOT)) for r in hot.collect())  # hot_size numbers at most
    late = np.array([x for x, _ in frequent], np.uint64), np.array([x for _, x in frequent], np.int64)
    profiles = both.where(F.col("bits").isNotNull())
    classes = written(profiles.where("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")), "join-classes")
    members = profiles.select("id", "n", "key")
    first = written(_first_tiles(_prefixes(docs, text, k, percent, spark.sparkContext.broadcast(late)), percent), "join-tiles")
    tiles = first.where("b is null").select("s", F.col("a").alias("key"), "n").distinct()
    pairs = first.where("b is not null").select("a", "b").distinct()
    pairs = written(_bounded(pairs, classes, percent).union(_near_pairs(tiles, classes, percent, near)).distinct(), "join-pairs")
    links = _links(pairs, docs, id_col, text, k, classes, percent)
    roots = components(links)
    rest = _cross_pairs(tiles, roots, classes, percent, pairs)
    dropped(pairs, first)
    if not rest.isEmpty():
        more = _links(rest, docs, id_col, text, k, classes, percent)
        dropped(roots)
        roots = components(links.unionByName(more))
        dropped(more)
    dropped(links, rest)
    of_root = roots.join(classes.select("key", "rep"), "key").groupBy("root").agg(F.min("rep").alias("least"))
    placed = classes.select("key", "rep").join(roots.select("key", "root"), "key", "left").join(of_root, "root", "left").select("key", F.coalesce("least", "rep").alias("component_id"))
    full = members.where("n > 0").join(placed, "key").select("id", F.col("n").alias("n_shingles"), "component_id")
    empty = members.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return full.unionByName(empty).withColumnRenamed("id", id_col)
