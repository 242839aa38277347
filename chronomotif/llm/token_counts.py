"""Token counts: a map-side two-tier lookup of pre-token lengths, no shuffle of pre-tokens.

Tier one is a compact hash table of frequent pre-tokens, broadcast once: sorted 64-bit hashes, their token counts, and the
pre-tokens end to end, with which a find is confirmed (at most ``tier_size`` entries, so its size has a bound). Tier two is a
cache in each Python worker: pre-tokens that neither has are encoded in batches by the tokenizer itself and remembered, up
to ``CACHE`` entries, then forgotten. A text's count is the sum over its pre-tokens, which byte-level BPE makes exact.

The table is filled from the first rows of ``SEED_TASKS`` partitions spread over the input, ``seed_rows`` rows in all; each of
those tasks reports its pre-tokens' counts, the others end at once. It only decides which lookups are cheap, never a
result. Texts with characters outside the range in which this module's pattern and the tokenizer's are known to agree,
or with a special string, are encoded whole by the tokenizer.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); very long texts are counted whole; repeated rows and
ids are counted one by one; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomotif.llm.common import here, ship, ship_file, tidy

CACHE = 300_000
SEED_TASKS = 32
#: Byte-level pre-tokens over the code points below U+0280 that ``_OTHER`` admits.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɿ"
_PRE_TOKEN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \t\n\r{_LETTERS}0-9]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
#: Bytes of UTF-8 texts inside that range; what is left after deleting them asks for the tokenizer itself.
_KNOWN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
_STATE: dict = {}


def _tokenizer(path: str):
    if _STATE.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(here(path))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        _STATE.clear()
        _STATE.update(path=path, tokenizer=tokenizer, special=special, table={})
    return _STATE["tokenizer"]


def _lengths(tokenizer, texts: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _plain(text: str, raw: bytes) -> bool:
    return not raw.translate(None, _KNOWN) and not any(s in text for s in _STATE["special"])


class Tier:
    """Token counts of pre-tokens in sorted hash arrays."""

    def __init__(self, counts: dict[str, int]):
        import xxhash

        rows = sorted((xxhash.xxh3_64_intdigest(raw), raw, n) for p, n in counts.items() for raw in [p.encode("utf-8", "surrogatepass")])
        self.hashes = np.array([h for h, _, _ in rows], np.uint64)
        self.ends = np.cumsum([0, *(len(raw) for _, raw, _ in rows)]).astype(np.uint32)
        self.words = b"".join(raw for _, raw, _ in rows)
        self.counts = np.array([n for _, _, n in rows], np.min_scalar_type(max([n for _, _, n in rows], default=0)))

    def find(self, asked: list[str]) -> dict[str, int]:
        """The counts of those that are here."""
        import xxhash

        if not len(self.hashes) or not asked:
            return {}
        raw = [p.encode("utf-8", "surrogatepass") for p in asked]
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        return {asked[i]: int(self.counts[at[i]]) for i in hit.tolist() if self.words[self.ends[at[i]] : self.ends[at[i] + 1]] == raw[i]}


def count_texts(texts: list[str | None], path: str, tier: Tier | None = None) -> tuple[list[int], list[int]]:
    """(bytes, tokens) of each text."""
    tokenizer = _tokenizer(path)
    n_bytes, n_tokens = [0] * len(texts), [0] * len(texts)
    whole: list[int] = []
    parts: dict[int, list[str]] = {}
    for i, text in enumerate(texts):
        if text:
            raw = text.encode("utf-8", "surrogatepass")
            n_bytes[i] = len(raw)
            if _plain(text, raw):
                parts[i] = _PRE_TOKEN.findall(text)
            else:
                whole.append(i)
    asked = set().union(*parts.values())
    table = _STATE["table"]
    missing = list(asked - table.keys())
    if len(table) + len(missing) > CACHE:
        table = _STATE["table"] = {}
        missing = list(asked)
    if tier is not None:
        table.update(tier.find(missing))
        missing = [p for p in missing if p not in table]
    table.update(zip(missing, _lengths(tokenizer, missing), strict=True))
    for i, tokens in parts.items():
        n_tokens[i] = sum(map(table.__getitem__, tokens))
    for i, n in zip(whole, _lengths(tokenizer, [texts[i] for i in whole]), strict=True):
        n_tokens[i] = n
    return n_bytes, n_tokens


def forget() -> None:
    """Empties the worker's cache; the tokenizer stays."""
    if _STATE:
        _STATE.update(table={})


def frequent_tier(docs: DataFrame, path: str, text: str = "text", seed_rows: int = 2000, tier_size: int = 50_000) -> Tier:
    """The most frequent pre-tokens of ``seed_rows`` rows from partitions spread over ``docs``, with their token counts."""
    some = docs.select(text)
    n = some.rdd.getNumPartitions()
    tasks = sorted({i * n // SEED_TASKS for i in range(SEED_TASKS)}) if n else []
    rows = -(-seed_rows // max(len(tasks), 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() not in tasks:
            return
        seen: Counter = Counter()
        _tokenizer(path)
        left = rows
        for batch in batches:
            for t in batch.column(0).slice(0, left).to_pylist():
                if t and _plain(t, t.encode("utf-8", "surrogatepass")):
                    seen.update(_PRE_TOKEN.findall(t))
            left -= batch.num_rows
            if left <= 0:
                break
        top = [(p, n) for p, n in seen.most_common(tier_size // 4) if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["p", "n"])

    total: Counter = Counter()
    for r in some.mapInArrow(tidy(count, forget), "p string, n bigint").collect():  # SEED_TASKS * tier_size / 4 rows at most
        total[r["p"]] += r["n"]
    best = [p for p, _ in total.most_common(tier_size)]
    return Tier(dict(zip(best, _lengths(_tokenizer(path), best), strict=True)))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 1024, seed_rows: int = 2000, tier_size: int = 50_000, step: int = 400) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document."""
    spark = docs.sparkSession
    ship(spark)
    ship_file(spark, path)
    shared = spark.sparkContext.broadcast(frequent_tier(docs, path, text, seed_rows, tier_size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tier = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                n_bytes, n_tokens = count_texts(piece.column(1).to_pylist(), path, tier)
                tokens = np.array(n_tokens, np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(tidy(count, forget), f"id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
