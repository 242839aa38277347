"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, text scanned once.

Texts and items are normalised alike: A-Z lower-cased, words are runs of digits, letters a-z and non-ASCII characters.
A window is ``size`` consecutive item words (a shorter item is one window). The automaton runs over word numbers, not
characters, so a document costs one dictionary lookup and one automaton step a word; only documents with a match pay
for mapping words back to character offsets of the original text.

The benchmark is small by nature, and its size is measured before it is broadcast. Beyond ``max_bytes`` it is dealt into
parts by a hash of the item: each is read, broadcast, scanned in a pass of its own whose rows are written to the shared folder,
and taken back before the next, so the driver and the workers hold one part. Beyond ``max_windows`` windows a part is dealt
into blocks, and a worker scans ``CHUNK`` words of text at a time against one block's automaton after another. So memory stays
bounded and no item is dropped; all ways give the same result.

Defined cases: a null text has no words; a null item id is no item, a null or wordless item text has no window;
repeated items and windows count once; an empty benchmark hits nothing; very long texts are scanned whole; repeated rows
are scanned one by one; extra columns of ``drop_contaminated`` pass through unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronomotif.llm.common import dropped, ship, tidy, written

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
CHUNK = 4_000_000
_BUILT: dict = {}


def forget() -> None:
    """Empties the worker's automata."""
    _BUILT.clear()


def words_of(text: str | bytes | None) -> list[bytes]:
    """Normalised words of a text or of its UTF-8."""
    if not text:
        return []
    return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).translate(_CLEAN).split()


def item_blocks(items: list[tuple], size: int, max_windows: int) -> list[list[tuple]]:
    """[(item id, words)] dealt into blocks of at most ``max_windows`` windows (an item is never split)."""
    blocks: list[list[tuple]] = [[]]
    left = max_windows
    for item_id, text in items:
        words = words_of(text)
        if item_id is None or not words:
            continue
        n = max(1, len(words) - size + 1)
        if blocks[-1] and n > left:
            blocks.append([])
            left = max_windows
        blocks[-1].append((item_id, words))
        left -= n
    return blocks


def build(block: list[tuple], size: int):
    """(word numbers, automaton): a key of numbers leads to (window length, item ids)."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    windows: dict[tuple, set] = {}
    for item_id, words in block:
        seq = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words)
        for i in range(max(1, len(seq) - size + 1)):
            windows.setdefault(seq[i : i + size], set()).add(item_id)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for seq, ids in windows.items():
        automaton.add_word(seq, (len(seq), tuple(ids)))
    automaton.make_automaton()
    return numbers, automaton


def _scan(lists: list[list[bytes]], blocks: list[list[tuple]], size: int, key: str) -> list[dict]:
    """For each word list the hit word places and the item ids, only where something matched: {row: (places, ids)}."""
    found: dict[int, tuple[set, set]] = {}
    for k, block in enumerate(blocks):
        if not block:
            continue
        if (key, k) not in _BUILT:
            _BUILT.clear()
            _BUILT[key, k] = build(block, size)
        numbers, automaton = _BUILT[key, k]
        get = numbers.get
        for row, words in enumerate(lists):
            seq = tuple([get(w, 0) for w in words])
            if not any(seq):
                continue
            for end, (length, ids) in automaton.iter(seq):
                places, items = found.setdefault(row, (set(), set()))
                places.update(range(end - length + 1, end + 1))
                items.update(ids)
    return found


def spans_of(text: str, places: set[int]) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end) character offsets of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    spans: list[list[int]] = []
    before = -2
    for i, m in enumerate(_WORD.finditer(raw.lower())):
        if i in places:
            if before == i - 1:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
            before = i
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # characters that begin before each byte
    return [(int(chars[a]), int(chars[b])) for a, b in spans]


class Part:
    """One of ``n`` parts of the benchmark, broadcast as blocks of items while it is used."""

    def __init__(self, items: DataFrame, k: int, n: int, size: int, max_windows: int):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        blocks = item_blocks([(r[0], r[1]) for r in mine.collect()], size, max_windows)  # a part, by the size that was measured
        self.shared = items.sparkSession.sparkContext.broadcast(blocks)
        self.key = f"{k}-{self.shared._jbroadcast.id()}"


def _items(benchmark: DataFrame, item_col: str, item_text: str, max_bytes: int) -> tuple[DataFrame, int]:
    """Distinct (item, text), and the number of parts of about ``max_bytes`` bytes at most."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).distinct()
    return items, max(1, -(-(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // max_bytes))


def _passes(rows: DataFrame, items: DataFrame, n: int, size: int, max_windows: int, scan: Callable, name: str) -> tuple[DataFrame, Part]:
    """``rows`` after a pass ``scan(part)`` over each part but the last, and the last part. Each pass ends before the next part is read."""
    before = None
    for k in range(n - 1):
        part = Part(items, k, n, size, max_windows)
        rows = written(rows.mapInArrow(tidy(scan(part), forget), rows.schema), name)
        part.shared.destroy()
        if before is not None:
            dropped(before)
        before = rows
    return rows, Part(items, n - 1, n, size, max_windows)


def _chunks(batches: Iterator[pa.RecordBatch], column: int, blocks: list) -> Iterator[tuple[list[pa.RecordBatch], list[list[bytes]]]]:
    """Batches with their texts' words; several at once where several automata are built for them."""
    held: list[pa.RecordBatch] = []
    lists: list[list[bytes]] = []
    size = 0
    for batch in batches:
        held.append(batch)
        lists += [words_of(t) for t in batch.column(column).cast(pa.binary()).to_pylist()]
        size = size + sum(map(len, lists[-batch.num_rows :])) if batch.num_rows else size
        if len(blocks) < 2 or size > CHUNK:
            yield held, lists
            held, lists, size = [], [], 0
    if held:
        yield held, lists


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", size: int = 10, max_windows: int = 500_000, max_bytes: int = 64 << 20, item_text: str = "text"
) -> DataFrame:
    """(id, n_words, n_hit, items array, spans array of start and end) of every document."""
    ship(docs.sparkSession)
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    item_list = pa.list_(to_arrow_type(item_type))
    out = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast(f"array<{item_type.simpleString()}>").alias("items"))

    def scanned(part: Part) -> Callable:
        shared, key = part.shared, part.key

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held, lists in _chunks(batches, 1, shared.value):
                found = _scan(lists, shared.value, size, key)
                at = 0
                for batch in held:
                    places, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                    n = pa.array([len(x) for x in lists[at : at + batch.num_rows]], pa.int64())
                    for i in range(batch.num_rows):
                        if at + i in found:
                            more, names = found[at + i]
                            places[i] = sorted({*more, *(places[i] or ())})
                            items[i] = sorted({*names, *(items[i] or ())})
                    at += batch.num_rows
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(places, pa.list_(pa.int32())), pa.array(items, item_list)], names=["id", "text", "n", "places", "items"])

        return scan

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column(1), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(p or ()) for p in places], pa.int64()),
                    pa.array([x or [] for x in batch.column(4).to_pylist()], item_list),
                    pa.array([[{"start": a, "end": b} for a, b in spans_of(texts[i].as_py(), set(p))] if p else [] for i, p in enumerate(places)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["id", "n_words", "n_hit", "items", "spans"],
            )

    def both(scan):
        return lambda batches: spans(scan(batches))

    items, n = _items(benchmark, item_col, item_text, max_bytes)
    out, last = _passes(out, items, n, size, max_windows, scanned, "hits")
    result = f"id {id_type.simpleString()}, n_words bigint, n_hit bigint, items array<{item_type.simpleString()}>, spans array<struct<start:bigint,end:bigint>>"
    return out.mapInArrow(tidy(both(scanned(last)), forget), result).withColumnRenamed("id", id_col)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", size: int = 10, max_windows: int = 500_000, max_bytes: int = 64 << 20, item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of any item; columns unchanged."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def scanned(part: Part) -> Callable:
        shared, key = part.shared, part.key

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held, lists in _chunks(batches, at, shared.value):
                found = _scan(lists, shared.value, size, key)
                row = 0
                for batch in held:
                    yield batch.filter(pa.array([i not in found for i in range(row, row + batch.num_rows)], pa.bool_()))
                    row += batch.num_rows

        return scan

    items, n = _items(benchmark, item_col, item_text, max_bytes)
    docs, last = _passes(docs, items, n, size, max_windows, scanned, "clean")
    return docs.mapInArrow(tidy(scanned(last), forget), docs.schema)
