"""An interpolated modified Kneser-Ney model of two or three tokens, counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Tokens are 64-bit hashes. Each task counts the token pairs of its documents and ships them as compact arrays, one for
each shard (the top bits of the first token's hash). A shard's task adds them up and writes sorted arrays into the shared
folder: pair hash and count, context hash with its total and its numbers of followers seen once, twice and more
often. A second, smaller exchange by the second token gives continuation counts (in how many contexts a token occurs) and
plain counts.

A table file holds its hashes in order, cut in two: a directory of the first bits, and the next 32 bits of each hash. With the
shard's bits that tells apart as many bits as log2 of all entries plus about 30, in four and a half bytes an entry. Files are
written under a name of their own and then renamed, with the same content whenever a task runs again. The model lists the
shards that have tables; a listed file that is missing raises an error.

Workers open the files as memory maps and look up the sorted distinct pairs of a batch, so a batch reads each place once;
the model is never loaded whole, and its size may follow the corpus; ``MAPS`` files are open in a worker at most. The shared folder has to be a file system that
workers can open (spark.checkpoint.dir as a path or file: URI); for other stores ``train`` says so.

With ``order`` three, tasks count token triples, dealt by the middle token, so one shard has all triples of a pair and of
a history (the two tokens before). Triples around a hot token, one that would fill a quarter of a shard alone, are dealt by history over all
shards instead, and another exchange adds up the pairs of hot tokens. A shard writes triple hash and count, the totals of
histories seen more than once, and, in the pair and context tables, continuation counts (after how many tokens a pair occurs). A history without an entry was seen once
if its pair is known, never otherwise. A text begins with two begin tokens. Tasks ship tokens as numbers into a list of each
message's distinct hashes. Counting goes in ``rounds``, each over all documents for a share of the shards: a shuffle holds the
triples of one round and is deleted before the next.

Shards are as many as keep each at about ``SHARD_BYTES`` of input, so a task's memory does not follow the corpus; one task
merges several, one after another, where there are more than ``TASKS``. The pairs of one token are one shard, at most as many as
there are tokens; so are the triples of one history.

Defined cases: a null text is empty, one end token; very long texts are scored whole; repeated rows and ids are counted and
scored one by one; with nothing to train on every token has the uniform probability; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomotif.llm.common import dropped, fresh_path, removed, ship, shuffles_dropped, tidy, written
from chronomotif.llm.jaccard_join import whole_groups

NONE = np.empty(0, np.uint64)
BEGIN, END = np.uint64(0x51ED270B35A1C6E5), np.uint64(0xA24BAED4963EE407)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
FLUSH = 2_000_000
SHARD_BYTES = 8 << 20
TASKS = 1 << 13
#: Texts of the sample that finds hot tokens, and hot tokens at most.
SAMPLED, MOST_HOT = 20_000, 1 << 16
#: A token is hot if its triples would fill a shard's part of so many.
HOT_PART = 4
#: Table files that a worker has open at most.
MAPS = 96
#: Which characters ``str.split`` takes for spaces; none comes after these.
_SPACE = np.array([chr(i).isspace() for i in range(0x3002)])


def word_tokens(text: str | None) -> np.ndarray:
    """Hashes of the A-Z-lower-cased words and of the end."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def piece_tokens(text: str | None) -> np.ndarray:
    """Numbers of three-character pieces of each word, its first piece marked, and of the end."""
    return piece_lists([text])[0]


def piece_lists(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(pieces and ends of all texts, start of each text): what ``piece_tokens`` gives of each, one after another.

    A piece's number is a bijection of its characters, so different pieces have different numbers.
    """
    whole = "\n".join(["", *(t or "" for t in texts), "\n"])  # two spaces after the last word
    c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACE[np.minimum(c, len(_SPACE) - 1)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, length = edges[::2], edges[1::2] - edges[::2]
    n = length // 3 + 1  # with the mark
    after = np.cumsum(n)
    at = np.repeat(begin - 1 - 3 * (after - n), n)
    at += 3 * np.arange(len(at))
    x, y, z = (c[at + k].astype(np.uint64) + np.uint64(1) for k in range(3))
    x[after - n] = ord("^") + 1
    rest = length % 3  # characters of a word's last piece, but one
    y[after[rest == 0] - 1] = 0
    z[after[rest < 2] - 1] = 0
    x |= y << np.uint64(21)
    x |= z << np.uint64(42)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    ends = np.cumsum([len(t or "") + 1 for t in texts])  # of each text, after the space before the first
    ends = np.append(0, after)[np.searchsorted(begin, ends)] + np.arange(len(texts))
    out, inside = np.full(len(x) + len(texts), END), np.ones(len(x) + len(texts), bool)
    inside[ends] = False
    out[inside] = x
    return out, np.append(0, ends[:-1] + 1)


def pair_hash(v: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """A hash of the pair whose top ``bits`` are those of v, so pairs and contexts share shards."""
    h = v * _P + w
    h ^= h >> np.uint64(32)
    h *= _Q
    h ^= h >> np.uint64(31)
    if not bits:
        return h
    low = np.uint64(64 - bits)
    return (v >> low << low) | (h >> np.uint64(bits))


def is_hot(v: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which tokens are among the sorted ``hot`` ones."""
    return hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v if len(hot) else np.zeros(len(v), bool)


def place_hash(v: np.ndarray, u: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """``pair_hash``, but pairs of a hot v are spread over all shards."""
    h = pair_hash(v, u, bits)
    spread = is_hot(v, hot)
    if bits and spread.any():
        low = np.uint64(64 - bits)
        own = h[spread]
        h[spread] = (own * _Q >> low << low) | (own & ((np.uint64(1) << low) - np.uint64(1)))
    return h


def pairs_of(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(before, token) over all texts; each begins anew."""
    w = np.concatenate(tokens)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[np.cumsum([0] + [len(t) for t in tokens[:-1]])] = BEGIN
    return v, w


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return (keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values))


def _packed(c: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned type that holds them, its width in the first byte."""
    width = 1 if not len(c) or c.max() < 256 else 2 if c.max() < 65536 else 8
    return bytes([width]) + c.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _shards(h: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(shard, start, end) of the sorted hashes, by their top ``bits``."""
    return _slices((h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64))


def _slices(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, start, end) of runs of equal shards."""
    if not len(shard):
        return []
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    return list(zip(shard[starts].tolist(), starts.tolist(), np.append(starts[1:], len(shard)).tolist(), strict=True))


def _dealt(rows: DataFrame, bits: int) -> DataFrame:
    """Rows of a shard together and in order, in as many tasks as shards, ``TASKS`` at most."""
    some = min(bits, TASKS.bit_length() - 1)
    return rows.repartitionById(1 << some, F.shiftright("shard", bits - some)).sortWithinPartitions("shard")


def _count_pairs(docs: DataFrame, text: str, tokens: Callable, bits: int, part: int = 0, rounds: int = 1) -> DataFrame:
    """(shard, v, m, w, c): pair counts of each task's documents; followers m of each context v, tokens w, counts c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            v, w = pairs_of(held)
            order = np.lexsort((w, v))
            v, w = v[order], w[order]
            starts = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
            counts = np.diff(np.append(starts, len(v)))
            v, w = v[starts], w[starts]
            for s, a, b in _shards(v, bits):
                first = np.flatnonzero(np.concatenate([[True], v[a + 1 : b] != v[a : b - 1]]))
                row = (v[a:b][first].tobytes(), _packed(np.diff(np.append(first, b - a))), w[a:b].tobytes(), _packed(counts[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], names=["shard", "v", "m", "w", "c"])

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                held += [tokens(t) for t in batch.column(0).slice(at, 500).to_pylist()]
                size += sum(map(len, held[-500:]))
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select(text).mapInArrow(tidy(run), "shard int, v binary, m binary, w binary, c binary")


def _save(folder: str, name: str, shard: int, bits: int, keys: np.ndarray, values: np.ndarray) -> None:
    """Writes the table file of sorted 64-bit hashes that share their top ``bits``, and their values."""
    n = len(keys)
    k = max(0, min(n.bit_length() - 3, 32 - bits))
    first = (keys >> np.uint64(64 - bits - k)).astype(np.int64) & ((1 << k) - 1) if bits + k else np.zeros(n, np.int64)
    starts = np.searchsorted(first, np.arange((1 << k) + 1)).astype(np.uint32)
    rest = ((keys >> np.uint64(32 - bits - k)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    values = np.ascontiguousarray(values)
    path, own = f"{folder}/{name}-{shard}", f"{folder}/{name}-{shard}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(np.array([n, k, values.shape[1] if values.ndim > 1 else 1, ord(values.dtype.kind), values.dtype.itemsize, 0, 0, 0], np.int64).tobytes())
        for x in (starts, rest, values):
            f.write(x.tobytes())
            f.write(b"\0" * (-f.tell() % 8))
    os.replace(own, path)


class _Table:
    """A table file as a memory map."""

    def __init__(self, path: str, bits: int):
        raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
        self.n, self.k, self.width, kind, size = raw[:64].view(np.int64)[:5].tolist()
        self.bits, at = bits, 64
        part = lambda n, dtype: raw[at : at + n * np.dtype(dtype).itemsize].view(dtype)
        self.starts = part((1 << self.k) + 1, np.uint32)
        at += -(-self.starts.nbytes // 8) * 8
        self.rest = part(self.n, np.uint32)
        at += -(-self.rest.nbytes // 8) * 8
        self.values = part(self.n * self.width, f"<{chr(kind)}{size}").reshape(self.n, self.width)

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes of this shard are here, and the values of those."""
        if not self.n:
            return np.zeros(len(asked), bool), self.values[:0]
        shift = self.bits + self.k
        first = (asked >> np.uint64(64 - shift)).astype(np.int64) & ((1 << self.k) - 1) if shift else np.zeros(len(asked), np.int64)
        rest = ((asked >> np.uint64(32 - shift)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        low, high = self.starts[first].astype(np.int64), self.starts[first + 1].astype(np.int64)
        end = high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            less = open_ & (self.rest[np.minimum(middle, self.n - 1)] < rest)
            low = np.where(less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        hit = low < end
        hit[hit] = self.rest[low[hit]] == rest[hit]
        return hit, self.values[low[hit]]


def _narrow(c: np.ndarray) -> np.ndarray:
    """The same counts in the narrowest unsigned type."""
    return c.astype(np.min_scalar_type(int(c.max()) if c.size else 0))


def _counts_of(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _pair_arrays(folder: str, shard: int, bits: int, key: np.ndarray, v: np.ndarray, w: np.ndarray, counts: np.ndarray, plain: np.ndarray, more: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Writes the pair and context arrays of a shard's distinct pairs, by sorted key; gives the rows of the second exchange."""
    _save(folder, "pair", shard, bits, key, _narrow(counts))
    context, total, n1, n2, n3 = _summed(v, counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64))
    _save(folder, "context", shard, bits, context, _narrow(np.stack([total, n1, n2, n3], 1)))
    yield from _token_rows(shard, bits, w, counts, plain, more)


MERGED = "shard int, v binary, w binary, n binary, c binary"


def _rows(shard: int, *values: bytes | None) -> pa.RecordBatch:
    """One row of ``MERGED``."""
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in values)], names=["shard", "v", "w", "n", "c"])


def _token_rows(shard: int, bits: int, w: np.ndarray, counts: np.ndarray, plain: np.ndarray, more: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """For the exchange by token: in how many of a shard's distinct pairs each token is, and its count; and counts of counts."""
    sums = plain.sum()
    token, n, plain = _summed(w, np.ones(len(w), np.int64), plain)
    for s, a, b in _shards(token, bits):
        yield _rows(s, None, token[a:b].tobytes(), _packed(n[a:b]), _packed(plain[a:b]))
    yield _rows(shard, None, None, np.array([*_counts_of(counts), sums, len(counts), *(more or [0] * 4)], np.int64).tobytes(), None)


def _count_triples(docs: DataFrame, text: str, tokens: Callable, bits: int, part: int = 0, rounds: int = 1, hot: np.ndarray = NONE) -> DataFrame:
    """(shard, d, v, m, u, w, c): triple counts of each task's documents by place; d the message's distinct hashes, v (m triples each), u and w places in it, counts c.

    Only shards that leave ``part`` modulo ``rounds``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        spread = np.empty(0, bool)

        def shards(known: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
            of = (known >> np.uint64(64 - bits)).astype(np.int64)[v] if bits else np.zeros(len(v), np.int64)
            if bits and spread.any():
                some = spread[v]
                of[some] = (place_hash(known[v[some]], known[u[some]], bits, hot) >> np.uint64(64 - bits)).astype(np.int64)
            return of

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal spread
            known, at = np.unique(np.concatenate([np.array([BEGIN]), *held]), return_inverse=True)
            begin, w = at[0], at[1:]
            spread = is_hot(known, hot)
            first = np.cumsum([0] + [len(t) for t in held[:-1]])
            v = np.empty_like(w)
            v[1:], v[first] = w[:-1], begin
            u = np.empty_like(w)
            u[1:], u[first] = v[:-1], begin
            if rounds > 1:
                mine = shards(known, v, u) % rounds == part
                u, v, w = u[mine], v[mine], w[mine]
                if not len(v):
                    return
            wide = len(known).bit_length()
            if 3 * wide <= 63:
                packed, counts = _distinct(np.sort((v << (2 * wide)) | (u << wide) | w))
                v, u, w = packed >> (2 * wide), (packed >> wide) & ((1 << wide) - 1), packed & ((1 << wide) - 1)
            else:
                order = np.lexsort((w, u, v))
                v, u, w = v[order], u[order], w[order]
                starts = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
                counts = np.diff(np.append(starts, len(v)))
                v, u, w = v[starts], u[starts], w[starts]
            place = np.zeros(len(known), np.int64)
            shard = shards(known, v, u)
            if spread.any():
                order = np.argsort(shard, kind="stable")
                shard, v, u, w, counts = shard[order], v[order], u[order], w[order], counts[order]
            for s, a, b in _slices(shard):
                middle, m = _distinct(v[a:b])
                here = np.unique(np.concatenate([middle, u[a:b], w[a:b]]))
                place[here] = np.arange(len(here))
                row = (known[here].tobytes(), *map(_packed, (place[middle], m, place[u[a:b]], place[w[a:b]], counts[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], names=["shard", "d", "v", "m", "u", "w", "c"])

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                new = [tokens(t) for t in batch.column(0).slice(at, 500).to_pylist()]
                held += new
                size += sum(map(len, new))
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select(text).mapInArrow(tidy(run), "shard int, d binary, v binary, m binary, u binary, w binary, c binary")


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often they occur."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[starts], np.diff(np.append(starts, len(x)))


def _merge_triples(counted: DataFrame, folder: str, bits: int, hot: np.ndarray = NONE) -> DataFrame:
    """Writes the triple, history, pair and context arrays of each shard; gives what ``_merge_pairs`` gives and, with v, the pairs of hot tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches):
            shard, parts = columns[0][0].as_py(), []
            for d, v, m, u, w, c in zip(*(x.to_pylist() for x in columns[1:]), strict=True):
                d = np.frombuffer(d, np.uint64)
                parts.append((d[_unpacked(u)], np.repeat(d[_unpacked(v)], _unpacked(m)), d[_unpacked(w)], _unpacked(c)))
            u, v, w, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            key = pair_hash(place_hash(v, u, bits, hot), w, bits)
            order = np.argsort(key)
            key, u, v, w, c = key[order], u[order], v[order], w[order], c[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, u, v, w, c = key[starts], u[starts], v[starts], w[starts], np.add.reduceat(c, starts)
            _save(folder, "triple", shard, bits, key, _narrow(c))
            history = place_hash(v, u, bits, hot)
            order = np.argsort(history)
            history, sorted_c = history[order], c[order]
            starts = np.flatnonzero(np.concatenate([[True], history[1:] != history[:-1]]))
            totals = np.stack([np.add.reduceat(x, starts) for x in (sorted_c, *((sorted_c == k).astype(np.int64) for k in (1, 2)), (sorted_c > 2).astype(np.int64))], 1)
            more = (totals[:, 0] > 1) | (v[order[starts]] == BEGIN)
            _save(folder, "history", shard, bits, history[starts][more], _narrow(totals[more]))
            del history, sorted_c, totals, key
            triples = _counts_of(c)
            spread = is_hot(v, hot)
            if spread.any():
                for shard_of, *columns in _partial_pairs(v[spread], w[spread], c[spread], bits, hot):
                    yield _rows(shard_of, *columns)
                v, w, c = v[~spread], w[~spread], c[~spread]
            pair = pair_hash(v, w, bits)
            order = np.argsort(pair)
            pair = pair[order]
            starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
            at = order[starts]
            plain = np.add.reduceat(c[order], starts) if len(starts) else c
            yield from _pair_arrays(folder, shard, bits, pair[starts], v[at], w[at], np.diff(np.append(starts, len(pair))), plain, triples)

    return _dealt(counted, bits).mapInArrow(tidy(run), MERGED)


def _partial_pairs(v: np.ndarray, w: np.ndarray, c: np.ndarray, bits: int, hot: np.ndarray) -> Iterator[tuple]:
    """(shard, v, w, n, c): pairs of hot tokens with the numbers of tokens before them, and counts, of one shard's triples."""
    key = place_hash(v, w, bits, hot)
    order = np.argsort(key)
    key, v, w, c = key[order], v[order], w[order], c[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n, total = np.diff(np.append(starts, len(key))), np.add.reduceat(c, starts)
    for s, a, b in _shards(key[starts], bits):
        yield s, v[starts][a:b].tobytes(), w[starts][a:b].tobytes(), _packed(n[a:b]), _packed(total[a:b])


def _merge_hot_pairs(partial: DataFrame, folder: str, bits: int, hot: np.ndarray) -> DataFrame:
    """Writes the pair arrays of hot tokens; gives what ``_merge_pairs`` gives and, with v, each hot token's total and followers seen once, twice and more often in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches):
            shard = columns[0][0].as_py()
            v, w = (np.concatenate([np.frombuffer(x, np.uint64) for x in columns[k].to_pylist()]) for k in (1, 2))
            n, c = (np.concatenate([_unpacked(x) for x in columns[k].to_pylist()]) for k in (3, 4))
            key, n, c = _summed(place_hash(v, w, bits, hot), n, c)
            _, first = np.unique(place_hash(v, w, bits, hot), return_index=True)
            v, w = v[first], w[first]
            _save(folder, "hot", shard, bits, key, _narrow(n))
            context, total, n1, n2, n3 = _summed(v, n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))
            yield _rows(shard, context.tobytes(), None, np.stack([total, n1, n2, n3], 1).tobytes(), None)
            yield from _token_rows(shard, bits, w, n, c)

    return _dealt(partial, bits).mapInArrow(tidy(run), MERGED)


def _merge_pairs(counted: DataFrame, folder: str, bits: int) -> DataFrame:
    """Writes the pair and context arrays of each shard; gives (shard of w, null, w, n, c) for the second exchange and, without v and w, counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            v, w, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            key, at = np.unique(pair_hash(v, w, bits), return_index=True)
            _, counts = _summed(pair_hash(v, w, bits), c)
            yield from _pair_arrays(folder, shard, bits, key, v[at], w[at], counts, counts)

        for batch in batches:
            for k in range(batch.num_rows):
                s = batch.column(0)[k].as_py()
                if shard is not None and s != shard:
                    yield from finish()
                    parts = []
                shard = s
                v, m, w, c = (batch.column(j)[k].as_py() for j in range(1, 5))
                parts.append((np.repeat(np.frombuffer(v, np.uint64), _unpacked(m)), np.frombuffer(w, np.uint64), _unpacked(c)))
        if parts:
            yield from finish()

    return _dealt(counted, bits).mapInArrow(tidy(run), MERGED)


def _merge_tokens(merged: DataFrame, folder: str, bits: int) -> DataFrame:
    """Writes the token arrays of each shard; gives counts of continuation counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches):
            w, n, c = (columns[k].to_pylist() for k in (2, 3, 4))
            token, contexts, plain = _summed(np.concatenate([np.frombuffer(x, np.uint64) for x in w]), np.concatenate([_unpacked(x) for x in n]), np.concatenate([_unpacked(x) for x in c]))
            shard = columns[0][0].as_py()
            _save(folder, "token", shard, bits, token, _narrow(np.stack([contexts, plain], 1)))
            of = np.array([(contexts == k).sum() for k in (1, 2, 3, 4)] + [contexts.sum(), len(token), (contexts > 2).sum()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([of.tobytes()], pa.binary())], names=["shard", "n"])

    return _dealt(merged, bits).mapInArrow(tidy(run), "shard int, n binary")


def discounts(n: np.ndarray) -> np.ndarray:
    """Of counts 0, 1, 2 and more, from the numbers of types seen 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if min(n1, n2, n3) == 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


class LanguageModel:
    """The arrays of a trained model in the shared folder, opened where it is used."""

    def __init__(self, folder: str, bits: int, pair_stats: np.ndarray, token_stats: np.ndarray, order: int, shards: dict[str, frozenset[int]], hot: np.ndarray = NONE, hot_totals: np.ndarray | None = None):
        self.folder, self.bits, self.order, self.shards = folder, bits, order, shards
        self.hot, self.hot_totals = hot, np.zeros((len(hot), 4), np.int64) if hot_totals is None else hot_totals
        self.n_tokens, self.vocabulary = int(pair_stats[4]), int(token_stats[5])
        self.pair_discount, self.token_discount = discounts(pair_stats), discounts(token_stats)
        self.triple_discount = discounts(pair_stats[6:])
        self.continuations = float(token_stats[4])
        d = self.token_discount
        more = token_stats[6]
        self.token_backoff = float((d[1] * token_stats[0] + d[2] * token_stats[1] + d[3] * more) / self.continuations) if self.continuations else 1.0
        self._maps: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_maps": {}}

    def _find(self, name: str, asked: np.ndarray, width: int, kind: type = np.int64, bits: int | None = None) -> np.ndarray:
        """Values of the sorted hashes ``asked``; 0 where absent. A listed shard without its file is an error. ``bits``: those of the table's shards."""
        bits = self.bits if bits is None else bits
        out = np.zeros((len(asked), width), kind)
        for s, a, b in _shards(asked, bits):
            if s in self.shards[name]:
                hit, values = self._table(name, s, bits).find(asked[a:b])
                out[a:b][hit] = values
        return out

    def _table(self, name: str, shard: int, bits: int) -> _Table:
        """An open table; ``MAPS`` stay open at most, those that were used last."""
        table = self._maps.pop((name, shard), None) or _Table(f"{self.folder}/{name}-{shard}", bits)
        self._maps[name, shard] = table
        if len(self._maps) > MAPS:
            del self._maps[next(iter(self._maps))]  # nothing else holds its arrays: the map and its descriptor go
        return table

    def token_probability(self, contexts: np.ndarray) -> np.ndarray:
        """The lower order, from continuation counts, mixed with the uniform distribution over V + 1 tokens."""
        uniform = 1.0 / (self.vocabulary + 1)
        if not self.continuations:
            return np.full(len(contexts), uniform)
        return np.maximum(contexts - self.token_discount[np.minimum(contexts, 3)], 0) / self.continuations + self.token_backoff * uniform

    def _context(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(total count, share left to the lower order) of sorted contexts."""
        totals = self._find("context", context, 4)
        spread = is_hot(context, self.hot)
        totals[spread] = self.hot_totals[np.searchsorted(self.hot, context[spread])]
        whole = np.maximum(totals[:, 0], 1)
        return whole, np.where(totals[:, 0] > 0, (totals[:, 1:] * self.pair_discount[1:]).sum(1) / whole, 1.0)

    def _pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of pairs (in order three: after how many tokens they occur)."""
        out = np.zeros(len(v), np.int64)
        spread = is_hot(v, self.hot)
        for name, some in (("pair", ~spread), ("hot", spread)):
            if some.any():
                key, of = np.unique(place_hash(v[some], w[some], self.bits, self.hot), return_inverse=True)
                out[some] = self._find(name, key, 1)[:, 0][of]
        return out

    def pair_probability(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """p(w after v) of each pair."""
        token, t = np.unique(w, return_inverse=True)
        lower = self.token_probability(self._find("token", token, 2)[:, 0])
        context, c = np.unique(v, return_inverse=True)
        whole, backoff = self._context(context)
        count = self._pair_counts(v, w)
        return np.maximum(count - self.pair_discount[np.minimum(count, 3)], 0) / whole[c] + backoff[c] * lower[t]

    def _triples(self, v: np.ndarray, w: np.ndarray, first: np.ndarray, pair_of: np.ndarray, starts: np.ndarray, pair_p: np.ndarray) -> np.ndarray:
        """p(token after the two before it) at each place, from the distinct pairs (v, w)[first] and their lower order."""
        known = self._pair_counts(v[first], w[first]) > 0
        history = np.append(place_hash(w[first], v[first], self.bits, self.hot), pair_hash(BEGIN[None], BEGIN[None], self.bits))
        order = np.argsort(history)
        totals = np.empty((len(history), 4), np.int64)
        totals[order] = self._find("history", history[order], 4)
        totals[:-1][known & (totals[:-1, 0] == 0)] = (1, 1, 0, 0)
        whole = np.maximum(totals[:, 0], 1)
        backoff = np.where(totals[:, 0] > 0, (totals[:, 1:] * self.triple_discount[1:]).sum(1) / whole, 1.0)
        before = np.empty_like(pair_of)
        before[1:], before[starts] = pair_of[:-1], len(first)
        triple, of = np.unique(pair_hash(history[before], w, self.bits), return_inverse=True)
        count = self._find("triple", triple, 1)[:, 0][of]
        return np.maximum(count - self.triple_discount[np.minimum(count, 3)], 0) / whole[before] + backoff[before] * pair_p[pair_of]

    def score(self, tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, known tokens, log10 base probability) of each text."""
        v, w = pairs_of(tokens)
        token, token_of = np.unique(w, return_inverse=True)
        plain = self._find("token", token, 2)[:, 1]
        base = np.log10((plain + 1) / (self.n_tokens + self.vocabulary + 1))
        _, first, pair_of = np.unique(pair_hash(v, w, self.bits), return_index=True, return_inverse=True)
        p = self.pair_probability(v[first], w[first])
        starts = np.cumsum([0] + [len(x) for x in tokens[:-1]])
        known = (plain > 0).astype(np.int64)
        p = np.log10(p)[pair_of] if self.order == 2 else np.log10(self._triples(v, w, first, pair_of, starts, p))
        return np.add.reduceat(p, starts), np.add.reduceat(known[token_of], starts), np.add.reduceat(base[token_of], starts)


def shard_bits(docs: DataFrame) -> int:
    """So many bits that a shard has about ``SHARD_BYTES`` of the table that ``docs`` reads; 4 to 20. By partitions where Spark knows no size (then it takes a huge one, of which a projection is a share)."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shards = -(-size // SHARD_BYTES) if size < 1 << 50 else docs.rdd.getNumPartitions()
    return min(20, max(4, (shards - 1).bit_length()))


def _hot_totals(rows: DataFrame, hot: np.ndarray) -> np.ndarray:
    """Totals and followers seen once, twice and more often of each hot token, added up over shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(hot), 4), np.int64)
        for batch in batches:
            for v, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[np.searchsorted(hot, np.frombuffer(v, np.uint64))] += np.frombuffer(n, np.int64).reshape(-1, 4)
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(4))], names=["at", "n0", "n1", "n2", "n3"])

    out = np.zeros((len(hot), 4), np.int64)
    sums = rows.select("v", "n").mapInArrow(tidy(run), "at bigint, n0 bigint, n1 bigint, n2 bigint, n3 bigint").groupBy("at").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])
    for r in sums.collect():  # a row a hot token
        out[r["at"]] = [r[f"n{k}"] for k in range(4)]
    return out


def hot_tokens(docs: DataFrame, text: str, tokens: Callable, bits: int) -> np.ndarray:
    """Tokens that alone would fill a quarter (``HOT_PART``) of a shard, ``MOST_HOT`` at most, sorted. From a sample of about ``SAMPLED`` texts: it decides only where triples lie."""
    some = docs.select(text)
    n = some.count()
    if n > SAMPLED:
        some = some.sample(SAMPLED / n, 7)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                token, n = np.unique(np.concatenate([tokens(t) for t in batch.column(0).to_pylist()]), return_counts=True)
                often = n * (8 * HOT_PART << bits) > n.sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.append(token[often], np.uint64(0)).view(np.int64)), pa.array(np.append(n[often], n.sum()))], names=["token", "n"])

    counts = some.mapInArrow(tidy(count), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n")).limit(MOST_HOT + 1).collect()
    total = next((r["n"] for r in top if r["token"] == 0), 0)  # all tokens
    return np.sort(np.array([r["token"] for r in top if r["token"] and r["n"] * (HOT_PART << bits) > total and r["token"] != END.view(np.int64)], np.int64).view(np.uint64))


def train(docs: DataFrame, text: str = "text", tokens: Callable = word_tokens, bits: int | None = None, order: int = 2, rounds: int = 2) -> LanguageModel:
    """A model of ``order`` two or three. Counts ``docs`` into 2 ** bits shards in the shared folder; order three in ``rounds`` over ``docs``. ``drop_model`` deletes it."""
    spark = docs.sparkSession
    ship(spark)
    if order not in (2, 3):
        raise ValueError(f"order {order}: 2 or 3")
    if bits is None:
        bits = shard_bits(docs)
    path = fresh_path(spark, "lm")
    if "://" in path.replace("file://", "") or (":" in path.split("/")[0] and not path.startswith("file:")):
        raise ValueError(f"workers map the model's files: spark.checkpoint.dir must be a file system path, not {path}")
    folder = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(folder, exist_ok=True)
    count, merge = (_count_pairs, _merge_pairs) if order == 2 else (_count_triples, _merge_triples)
    rounds = 1 if order == 2 else max(1, min(rounds, 1 << bits))
    hot = hot_tokens(docs, text, tokens, bits) if order == 3 else NONE
    own = {"hot": hot} if order == 3 else {}
    parts = [written(merge(count(docs, text, tokens, bits, part, rounds, **own), folder, bits, **own), "lm-tokens") for part in range(rounds)]
    merged = functools.reduce(DataFrame.unionByName, parts)
    hot_totals, of_hot = np.zeros((len(hot), 4), np.int64), []
    if len(hot):
        parts.append(written(_merge_hot_pairs(merged.where("v is not null"), folder, bits, hot), "lm-hot"))
        merged = merged.where("v is null").unionByName(parts[-1].where("v is null"))
        of_hot = [r["shard"] for r in parts[-1].where("v is not null").select("shard").distinct().collect()]  # a row a shard
        hot_totals = _hot_totals(parts[-1].where("v is not null"), hot)
    pair_stats, token_stats = np.zeros(10, np.int64), np.zeros(7, np.int64)
    of_pairs = merged.where("w is null").select("shard", "n").collect()  # one row a shard
    for r in of_pairs:
        pair_stats += np.frombuffer(bytes(r["n"]), np.int64)
    with shuffles_dropped(spark):
        of_tokens = _merge_tokens(merged.where("w is not null"), folder, bits).collect()
    for r in of_tokens:
        token_stats += np.frombuffer(bytes(r["n"]), np.int64)
    dropped(*parts)
    by_pair, by_token = (frozenset(r["shard"] for r in rows) for rows in (of_pairs, of_tokens))
    names = ("pair", "context") if order == 2 else ("pair", "context", "triple", "history")
    return LanguageModel(folder, bits, pair_stats, token_stats, order, dict.fromkeys(names, by_pair) | {"token": by_token, "hot": frozenset(of_hot)}, hot, hot_totals)


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text", tokens: Callable = word_tokens, extra: list[Column] | None = None, step: int = 1000) -> DataFrame:
    """(id, extra columns, n_tokens, n_known, base_score, score, perplexity) of every document."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col), F.col(text).alias("_text"), *(extra or []))
    names = [c for c in picked.columns if c not in (id_col, "_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                lists = [tokens(t) for t in piece.column(1).to_pylist()]
                n = np.array([len(x) for x in lists], np.int64)
                total, known, base = model.score(lists)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *(piece.column(2 + k) for k in range(len(names))), pa.array(n), pa.array(known), pa.array(base), pa.array(total), pa.array(10 ** (-total / n))],
                    names=["id", *names, "n_tokens", "n_known", "base_score", "score", "perplexity"],
                )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields if f.name in names)
    id_type = docs.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(tidy(run), f"id {id_type}, {kinds}n_tokens bigint, n_known bigint, base_score double, score double, perplexity double").withColumnRenamed("id", id_col)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def drop_model(spark, model: LanguageModel) -> None:
    removed(spark, model.folder)
