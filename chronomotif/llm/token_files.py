"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

File format, a folder:

* ``ranks``: Parquet (rank, id); rank 0 is the most frequent id, ties by id.
* ``blocks``: Parquet rows of up to ``BLOCK`` ids: ``shard``, ``block``, ``start`` (ids of the shard before the block),
  ``tokens``, ``ids`` and ``counts`` (the documents and their id counts), ``control``, ``data``. Every id is coded as its
  rank in 1 to 4 little-endian bytes in ``data``; a control byte holds four 2-bit lengths less one. Each document begins
  at a new control byte. Shards are ranges of ascending document id, one file each, blocks in order inside.
* ``shards``: Parquet (shard, start): ids of all shards before.

Containers are Parquet since only Spark's writers reach every store that a cluster may use. Decoding looks lengths up in
a 256-row table and gathers unaligned 32-bit words under a mask.

The texts are encoded once; the ids wait in a table in the shared folder, two bytes each, while they are counted and
ranked, and go when the blocks are written. Words between blanks are encoded once a worker while its cache lasts, their
pre-tokens by the tokenizer's model alone where this module's pattern and the tokenizer's are known to agree, else by the
tokenizer. Ranges come from approximate quantiles of the id column alone, ``RANGES`` at most, each cut evenly where more shards
are wanted, so the shuffle carries coded bytes only.

Defined cases: a null text is empty and yields the end id alone; null ids come first; documents with the same id stand
in a fixed order of their coded bytes; very long texts are coded whole, as one block if need be; an empty table gives an
empty file set. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.llm.common import fresh_path, here, removed, ship, ship_file, tidy

BLOCK = 1 << 19
RANGES = 1024
CACHE = 700_000
_STATE: dict = {}

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def code(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    lengths = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = lengths - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The values of documents with these counts; each document began at a new control byte."""
    counts = np.asarray(counts, np.int64)
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    slots = -(-counts // 4) * 4
    if len(counts) and (slots != counts).any():
        within = np.arange(len(lengths)) - np.repeat(np.cumsum(slots) - slots, slots)
        lengths = lengths[within < np.repeat(counts, slots)]
    starts = np.cumsum(lengths) - lengths
    words = np.ndarray((len(data) + 1,), "<u4", data + b"\0" * 4, strides=(1,))
    return words[starts] & _MASKS[lengths]


def _byte_names() -> list[str]:
    """Byte-level names: a printable byte is itself, the others are numbered from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return [chr(b) if b in kept else chr(256 + rest.index(b)) for b in range(256)]


_NAMES = _byte_names()
#: UTF-8 bytes of words in which pre-tokens are found here: ASCII and letters below U+0280.
_KNOWN = bytes([*range(0x21, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
_PRE_TOKEN = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ɿ]+|[0-9]|[^a-zß-öø-ɿ0-9]+")


def _tokenizer(path: str):
    if _STATE.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(here(path))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _STATE.clear()
        _STATE.update(path=path, tokenizer=tokenizer, model=tokenizer.model, words=_Words(), wide="<u2" if (few := tokenizer.get_vocab_size() < 1 << 16) else "<u4", kind="H" if few else "I")
    return _STATE["tokenizer"]


class _Words(dict):
    """Ids of words and of their parts as bytes; a missing one is encoded when it is asked for."""

    def __missing__(self, word: str) -> bytes:
        lower = word.lower()
        if word.isascii() and word.isalpha():
            ids = self._model(word) if lower == word else self[lower]
        # some letters below U+0280 have lower-case forms above it
        elif "<|" in word or not (word.isascii() and word.isprintable()) and (word + lower).encode("utf-8", "surrogatepass").translate(None, _KNOWN):
            ids = array(_STATE["kind"], _STATE["tokenizer"].encode(word, add_special_tokens=False).ids).tobytes()
        else:
            parts = _PRE_TOKEN.findall(lower)
            ids = self._model(lower) if len(parts) == 1 else b"".join([self[p] for p in parts])
        self[word] = ids
        return ids

    @staticmethod
    def _model(part: str) -> bytes:
        """Ids of a lower-case pre-token by the model alone."""
        name = part if part.isascii() else "".join([_NAMES[b] for b in part.encode()])
        return array(_STATE["kind"], [t.id for t in _STATE["model"].tokenize(name)]).tobytes()


def forget() -> None:
    """Empties the cache of words; the tokenizer stays."""
    if _STATE:
        _STATE.update(words=_Words())


def encode_texts(texts: list[str | None], path: str, end_id: int) -> list[bytes]:
    """Ids of each text with the end id, as little-endian bytes. The tokenizer drops blanks between words, so words are encoded apart and remembered."""
    _tokenizer(path)
    if len(_STATE["words"]) > CACHE:
        _STATE["words"] = _Words()
    ids_of = _STATE["words"].__getitem__
    end = np.array([end_id], _STATE["wide"]).tobytes()
    return [b"".join(map(ids_of, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) + end if t else end for t in texts]


def _encoded(docs: DataFrame, path: str, id_col: str, text: str, end_id: int, step: int) -> DataFrame:
    """(id, ids): each document's ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(encode_texts(piece.column(1).to_pylist(), path, end_id), pa.binary())], names=["id", "ids"])

    return docs.select(id_col, text).mapInArrow(tidy(run, forget), f"id {docs.schema[id_col].dataType.simpleString()}, ids binary")


def id_counts(encoded: DataFrame, wide: str) -> DataFrame:
    """(id, n): how often each id occurs; each task sums its own part first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0)
            if len(ids):
                ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
                n = np.bincount(np.frombuffer(ids.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(wide))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return encoded.select("ids").mapInArrow(tidy(run), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1, shard_tokens: int = 64 << 20, step: int = 400) -> str:
    """Writes the file format into folder ``out``."""
    spark = docs.sparkSession
    ship(spark)
    ship_file(spark, path)
    _tokenizer(path)
    wide = _STATE["wide"]
    id_type = docs.schema[id_col].dataType.simpleString()
    waiting = f"{out}/waiting"
    _encoded(docs, path, id_col, text, end_id, step).write.option("compression", "zstd").parquet(waiting)
    stored = spark.read.schema(f"id {id_type}, ids binary").parquet(waiting)
    ranked = sorted((-r["n"], r["id"]) for r in id_counts(stored, wide).collect())  # no longer than the vocabulary
    total = -sum(n for n, _ in ranked)
    spark.createDataFrame([(k, i) for k, (_, i) in enumerate(ranked)], "rank bigint, id bigint").coalesce(1).write.parquet(f"{out}/ranks")
    rank = np.zeros(max([i for _, i in ranked], default=0) + 1, np.uint32)
    rank[[i for _, i in ranked]] = np.arange(len(ranked))
    shared = spark.sparkContext.broadcast(rank)
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_tokens))
    numeric = id_type in ("bigint", "int", "smallint", "tinyint")
    cuts = np.empty(0)
    if numeric and n_shards > 1:
        ranges = min(n_shards, RANGES)
        edges = np.array(stored.stat.approxQuantile("id", list(np.linspace(0, 1, ranges + 1)), 0.1 / ranges))  # none for an empty table
        steps = np.linspace(0, 1, -(-n_shards // ranges) + 1)[1:]
        cuts = np.unique((edges[:-1, None] + np.diff(edges)[:, None] * steps).ravel())[:-1]
        n_shards = len(cuts) + 1

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                ids = [np.frombuffer(x.as_buffer(), wide) for x in piece.column(1)]
                pairs = [code(ranks[x]) for x in ids]
                shard = np.zeros(piece.num_rows, np.int64)
                if numeric:
                    null = piece.column(0).is_null().to_numpy(zero_copy_only=False)
                    shard = np.where(null, 0, np.searchsorted(cuts, piece.column(0).fill_null(0).to_numpy(zero_copy_only=False), "right"))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(shard.astype(np.int32)), pa.array([len(x) for x in ids], pa.int64()), pa.array([c for c, _ in pairs], pa.binary()), pa.array([d for _, d in pairs], pa.binary())],
                    names=["id", "shard", "n", "control", "data"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_of: list[tuple] = []
        held = start = block = shard = 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()),
                    pa.array([[d[0] for d in docs_of]], pa.list_(id_arrow)), pa.array([[d[1] for d in docs_of]], pa.list_(pa.int64())),
                    pa.array([b"".join(d[2] for d in docs_of)], pa.binary()), pa.array([b"".join(d[3] for d in docs_of)], pa.binary()),
                ],
                names=["shard", "block", "start", "tokens", "ids", "counts", "control", "data"],
            )

        for batch in batches:
            for doc, s, n, control, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if docs_of and (held + n > BLOCK or s != shard):
                    yield emit()
                    start, block, held, docs_of = start + held, block + 1, 0, []
                if s != shard:
                    shard, start, block = s, 0, 0
                docs_of.append((doc, n, control, data))
                held += n
        if docs_of:
            yield emit()

    id_arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(id_type, pa.string())
    if not numeric:  # other ids are ranged by Spark itself, which samples the rows once more
        rows = stored.withColumn("id", F.col("id").cast("string")).mapInArrow(tidy(coded), "id string, shard int, n bigint, control binary, data binary")
        rows = rows.repartitionByRange(n_shards, "id").withColumn("shard", F.spark_partition_id())
    else:
        rows = stored.mapInArrow(tidy(coded), f"id {id_type}, shard int, n bigint, control binary, data binary").repartitionById(n_shards, F.col("shard"))
    kind = id_type if numeric else "string"
    schema = f"shard int, block int, start bigint, tokens bigint, ids array<{kind}>, counts array<bigint>, control binary, data binary"
    rows.sortWithinPartitions("shard", "id", "n", "data").mapInArrow(tidy(blocks), schema).write.option("compression", "zstd").parquet(f"{out}/blocks")
    removed(spark, waiting)
    totals = sorted((r["shard"], r["n"]) for r in spark.read.schema(schema).parquet(f"{out}/blocks").groupBy("shard").agg(F.sum("tokens").alias("n")).collect())
    before, rows_of = 0, []
    for s, n in totals:
        rows_of.append((s, before))
        before += n
    spark.createDataFrame(rows_of, "shard int, start bigint").coalesce(1).write.parquet(f"{out}/shards")
    return out


def read_tokens(spark: SparkSession, out: str, digest: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids) of every document, decoded from the files; with ``digest`` ids_crc32 in place of ids."""
    ship(spark)
    starts = {r["shard"]: r["start"] for r in spark.read.parquet(f"{out}/shards").collect()}  # one row a shard
    ids = np.array([r["id"] for r in spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()], "<u4")
    shared = spark.sparkContext.broadcast((starts, ids))
    blocks = spark.read.parquet(f"{out}/blocks")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_start, by_rank = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                shard, start, names, counts, control, data = (batch.column(j)[k] for j in range(6))
                n = np.array(counts.as_py(), np.int64)
                values = by_rank[decode(control.as_py(), data.as_py(), n)]
                ends = np.cumsum(n)
                if digest:
                    raw = values.astype("<u4").tobytes()
                    last = pa.array([zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), n.tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([names.values, pa.array(shard_start[shard.as_py()] + start.as_py() + ends - n), pa.array(n), last], names=["id", "start", "n_tokens", "x"])

    last = "ids_crc32 bigint" if digest else "ids array<bigint>"
    return blocks.select("shard", "start", "ids", "counts", "control", "data").mapInArrow(tidy(docs), f"id {kind}, start bigint, n_tokens bigint, {last}")


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """Writes the files into the shared folder, reads them back: (id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    out = write_tokens(docs, path, fresh_path(spark, "tokens"), id_col, text, end_id)
    return read_tokens(spark, out, digest=True).withColumnRenamed("id", id_col)
