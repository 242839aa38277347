"""Quality classifier: a Kneser-Ney model of trusted text; sharded count joins give per-document perplexity.

The model (``ngram_lm``) is over three-character pieces of words, trained on all documents labelled good but a fold of a
quarter of them, by the id's hash; ids are joined, none pass the driver. (``max_trusted``, for callers that want a smaller
model, takes only so many of the labelled ids, those of least hash; the query doesn't.) Training counts are sharded by the
hash of the context, in shards whose number follows the input. Scoring is two sharded joins and no shuffle of texts:

1. each task over the corpus sends the distinct piece pairs of its documents to their shards, whose number follows the input.
   There they become distinct as they come in and meet the training counts: a merge join of sorted arrays that leaves, for
   every pair that the corpus has, its log10 probability;
2. the joined arrays, sorted, are read back as memory maps while the texts are scanned once more, and summed per document.

In both scans a task keeps a table of pairs that it met (``Places``, of bounded size, compared by their whole hash), so only pairs
that aren't there are sorted and sent, or looked up; look-ups wait until there are many, since each round of them may open every
shard.

Pairs never become rows, so the exchange holds each task's distinct pairs only, and all documents are scored whole.

Thresholds: from all trusted documents that training left out (the fold, and those beyond ``max_trusted``), the 5th, 50th and 95th percentile of log10 perplexity for each language, of values rounded to five decimals
so that their counts, not the documents, meet in a task; a document is kept between q05 - ``spread`` * (q50 - q05) and
q95 + ``spread`` * (q95 - q50), both widened by ``slack`` over the number of pieces, since means of short texts scatter
more. Languages with fewer than ``least`` such documents use the percentiles of all.

Defined cases: null or empty texts are one end token and are judged by its perplexity; a null language is a language of
its own; very long texts are read whole; repeated rows are judged one by one; an empty table gives no rows; without
trusted documents everything is kept, thresholds null; ids labelled both good and bad are not trusted; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomotif.llm import ngram_lm
from chronomotif.llm.common import dropped, ship, tidy, written
from chronomotif.llm.ngram_lm import BEGIN, LanguageModel, pair_hash, piece_lists, piece_tokens, shard_bits


def agreed(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the ids whose labels in the table agree, one row each; nulls are no labels."""
    both = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).alias("_least"), F.max(label).alias(label))
    return both.where(F.col("_least") == F.col(label)).select(id_col, label)


def trusted_ids(labels: DataFrame, max_trusted: int, id_col: str = "doc_id") -> list:
    """At most ``max_trusted`` ids of documents labelled good, by a hash of the id."""
    return [r[0] for r in agreed(labels, "quality", id_col).where("quality = 1").orderBy(F.xxhash64(id_col), id_col).limit(max_trusted).select(id_col).collect()]


def chosen(docs: DataFrame, ids: list, id_col: str = "doc_id") -> DataFrame:
    """The documents with these ids; the list has a bound, so it is broadcast."""
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], docs.select(F.col(id_col)).schema)
    return docs.join(F.broadcast(wanted), id_col, "left_semi").select(*docs.columns)


#: Characters of the texts that a task takes at a time, and places of its table of pairs (a power of two).
CHARACTERS, PLACES = 1 << 20, 1 << 20
#: Pairs of texts that wait at most before those that the table hasn't are looked up, and so many of the latter.
WAITING, ASKED = 8_000_000, 1_000_000


def slices(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first row, end, texts) of runs of rows with about ``CHARACTERS``."""
    begin, texts, size = 0, [], 0
    for at in range(0, len(column), 100):
        for text in column.slice(at, 100).to_pylist():
            texts.append(text)
            size += len(text or "") + 1
            if size > CHARACTERS or begin + len(texts) == len(column):
                yield begin, begin + len(texts), texts
                begin, texts, size = begin + len(texts), [], 0


def pairs_in(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, piece, start of each text) over all texts; each begins anew."""
    w, starts = piece_lists(texts)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[starts] = BEGIN
    return v, w, starts


class Places:
    """Pairs that a task has met lately, one at each place of a table by the low bits of its hash, with values if wanted.

    Most pairs of a text are common ones, so few are left to be sorted, sent or looked up in files.
    """

    def __init__(self, valued: bool = False):
        self.key = ~np.arange(PLACES, dtype=np.uint64)  # no hash with these low bits is the key of its place
        self.value = np.zeros(PLACES if valued else 0)

    def of(self, key: np.ndarray) -> np.ndarray:
        return (key & np.uint64(PLACES - 1)).astype(np.int64)

    def put(self, key: np.ndarray, value: np.ndarray | None = None) -> None:
        """Distinct hashes take their places; of those that share one, one does."""
        place = self.of(key)
        self.key[place] = key
        if value is not None:
            there = self.key[place] == key
            self.value[place[there]] = value[there]

    def new(self, key: np.ndarray) -> np.ndarray:
        """Where hashes that aren't here occur first; they are put here."""
        away = np.flatnonzero(self.key[self.of(key)] != key)
        distinct, first = np.unique(key[away], return_index=True)
        self.put(distinct)
        return away[first]

    def values(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the hashes, where they aren't here)."""
        place = self.of(key)
        return self.value[place], np.flatnonzero(self.key[place] != key)


def join_counts(docs: DataFrame, model: LanguageModel, bits: int, text: str = "text", flush: int = 1_500_000) -> DataFrame:
    """Writes, beside the model, the log10 probability of every pair of the corpus, in 2 ** bits shards; gives (shard, pairs)."""

    def distinct(parts: list[np.ndarray]) -> np.ndarray:
        """The pairs of all parts, each once, by sorted hash, whose top bits are the shard's."""
        both = np.concatenate(parts)
        _, first = np.unique(pair_hash(both[:, 0], both[:, 1], bits), return_index=True)
        return both[first]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[np.ndarray] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            pairs = distinct(known)
            for s, a, b in ngram_lm._shards(pairs[:, 0], bits):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pairs[a:b].tobytes()], pa.binary())], names=["shard", "pairs"])

        sent = Places()  # of this task alone: another one's rows may be lost and made again
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                v, w, _ = pairs_in(texts)
                first = sent.new(pair_hash(v, w, bits))
                known.append(np.stack([v[first], w[first]], 1))
                size += len(first)
                if size > flush:
                    known = [distinct(known)]
                    size = len(known[0])
                    if size > flush // 2:
                        yield from send()
                        known, size = [], 0
        if known:
            yield from send()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, size = None, [], 0

        def finish() -> Iterator[pa.RecordBatch]:
            both = distinct(parts)
            key = pair_hash(both[:, 0], both[:, 1], bits)
            ngram_lm._save(model.folder, "asked", shard, bits, key, np.log10(model.pair_probability(both[:, 0], both[:, 1])))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(key)], pa.int64())], names=["shard", "pairs"])

        for batch in batches:
            for s, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard is not None and s != shard:
                    yield from finish()
                    parts, size = [], 0
                shard = s
                parts.append(np.frombuffer(pairs, np.uint64).reshape(-1, 2))
                size += len(parts[-1])
                if size > 2 * flush:  # pairs that several tasks sent are one from here on
                    parts = [distinct(parts)]
                    size = len(parts[0])
        if parts:
            yield from finish()

    rows = docs.select(text).mapInArrow(tidy(asked), "shard int, pairs binary")
    return ngram_lm._dealt(rows, bits).mapInArrow(tidy(joined), "shard int, pairs bigint")


def score_joined(docs: DataFrame, model: LanguageModel, bits: int, id_col: str, text: str, lang: str) -> DataFrame:
    """(id, lang, n_pieces, score) from the joined arrays."""
    id_type, lang_type = (docs.schema[c].dataType.simpleString() for c in (id_col, lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Places(valued=True)
        waiting: list[tuple] = []  # (rows, values, start of each text, where values are missing, hashes of those)
        pairs = asked = 0

        def finish() -> Iterator[pa.RecordBatch]:
            key, at = np.unique(np.concatenate([x[-1] for x in waiting]), return_inverse=True)
            found = model._find("asked", key, 1, np.float64, bits)[:, 0]
            met.put(key, found)
            for rows, p, starts, away, _ in waiting:
                p[away], at = found[at[: len(away)]], at[len(away) :]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(np.diff(np.append(starts, len(p)))), pa.array(np.add.reduceat(p, starts))], names=["id", "lang", "n_pieces", "score"])

        for batch in batches:
            for begin, end, texts in slices(batch.column(2)):
                v, w, starts = pairs_in(texts)
                key = pair_hash(v, w, bits)
                p, away = met.values(key)
                waiting.append(([batch.column(k).slice(begin, end - begin) for k in (0, 1)], p, starts, away, key[away]))
                pairs, asked = pairs + len(p), asked + len(away)
                if pairs > WAITING or asked > ASKED:
                    yield from finish()
                    waiting, pairs, asked = [], 0, 0
        if waiting:
            yield from finish()

    return docs.select(F.col(id_col), F.col(lang).alias("_lang"), F.col(text)).mapInArrow(tidy(run), f"id {id_type}, lang {lang_type}, n_pieces bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", max_trusted: int | None = None, spread: float = 3.0, slack: float = 15.0, least: int = 30, bits: int | None = None, join_bits: int | None = None) -> DataFrame:
    """(id, lang, n_pieces, score, perplexity, low, high, kept) of every document."""
    ship(docs.sparkSession)
    training = ~ngram_lm.held_out(id_col, 4, 0)
    good = agreed(labels, "quality", id_col).where("quality = 1").select(id_col)
    learned = good.where(training)
    if max_trusted is not None:
        ids = trusted_ids(labels, max_trusted, id_col)
        learned = docs.sparkSession.createDataFrame([(i,) for i in ids], labels.select(id_col).schema).where(training)
    # A merge join at any size: the ids have no bound to be broadcast under. Training reads its rows once.
    trusted = docs.where(training).select(id_col, text).join(learned.hint("merge"), id_col, "left_semi").select(text)
    model = ngram_lm.train(trusted, text, piece_tokens, bits)
    join_bits = shard_bits(docs) if join_bits is None else join_bits
    model.shards["asked"] = frozenset(r["shard"] for r in join_counts(docs, model, join_bits, text).collect())  # a row a shard
    scored = written(score_joined(docs, model, join_bits, id_col, text, lang).withColumn("x", -F.col("score") / F.col("n_pieces")), "scored")
    ngram_lm.drop_model(docs.sparkSession, model)
    outside = good.where(~training) if max_trusted is None else good.join(F.broadcast(learned), id_col, "left_anti")  # at most max_trusted ids
    own = scored.join(outside.select(F.col(id_col).alias("_good")), F.col("id") == F.col("_good"), "left_semi").groupBy("lang", F.round("x", 5).alias("x")).agg(F.count("*").alias("n"))
    own = written(own, "trusted-scores")
    q = F.percentile("x", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)), F.col("n")).alias("q")
    cuts = {r["lang"]: r["q"] for r in own.groupBy("lang").agg(q, F.sum("n").alias("n")).where(F.col("n") >= least).collect()}  # a row a language
    whole = own.agg(q).first()["q"]
    dropped(own)

    def cut(pick) -> F.Column:
        out = F.lit(pick(whole) if whole else None).cast("double")
        for name, values in cuts.items():
            out = F.when(F.col("lang").eqNullSafe(F.lit(name)), F.lit(pick(values))).otherwise(out)
        return out

    out = scored.withColumn("low", cut(lambda v: v[0] - spread * (v[1] - v[0]))).withColumn("high", cut(lambda v: v[2] + spread * (v[2] - v[1])))
    room = F.lit(slack) / F.col("n_pieces")
    kept = F.coalesce((F.col("x") >= F.col("low") - room) & (F.col("x") <= F.col("high") + room), F.lit(True))
    ten = lambda c: F.pow(F.lit(10.0), F.col(c))
    return out.select(F.col("id").alias(id_col), "lang", "n_pieces", "score", ten("x").alias("perplexity"), ten("low").alias("low"), ten("high").alias("high"), kept.alias("kept"))
