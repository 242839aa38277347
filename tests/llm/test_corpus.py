"""The operators over whole corpora against brute force: links and components, language model, mixing, the pipeline."""

import collections
import math
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronomotif.llm import jaccard_join, mixing, ngram_lm, quality_model, queries, toxicity

SF = "/root/testdata/sf0.001"
words = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_components(rows, k, percent):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if (w := words(t)) else set() for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def near_copies():
    """Groups of copies with a few words changed, a chain whose ends don't link, a passage in many texts, and odd texts."""
    rng = random.Random(3)
    bank = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows, passage = [], " ".join(rng.choices(bank, k=40))
    base = rng.choices(bank, k=120)
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(bank)
        rows.append(" ".join(w))
    chain = rng.choices(bank, k=150)
    for i in range(12):
        chain = chain[:i * 3] + rng.choices(bank, k=3) + chain[i * 3 + 3 :]
        rows.append(" ".join(chain))
    rows += [passage + " " + " ".join(rng.choices(bank, k=rng.randrange(5, 80))) for _ in range(80)]
    rows += [None, "", "one", "One", "one two three", "one two three four", rows[0], rows[0].upper(), " ".join(rng.choices(bank, k=9000))]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, percent):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit("clash")).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, k=k, percent=percent).collect()}
    assert got == brute_components(rows, k, percent)
    assert len({c for _, c in got.values()}) < len(rows) - 30


def test_bitmaps_bound_from_above():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
        a, b = (np.unique(rng.choice(pool, rng.integers(10, 350))) for _ in range(2))
        x, y = jaccard_join.bitmap(a), jaccard_join.bitmap(b)
        w = min(len(x), len(y)) // 8
        apart = int(np.bitwise_count(jaccard_join.folded(x, w) ^ jaccard_join.folded(y, w)).sum())
        both = len(np.intersect1d(a, b))
        assert both <= (len(a) + len(b) - apart) / 2


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert jaccard_join.jaccard_components(none).count() == 0
    assert ngram_lm.score(none, ngram_lm.train(none)).count() == 0
    mixed = mixing.mix(none, queries.mix_levels(), queries.MIX_WEIGHTS, F.expr("_all"))
    assert mixed.count() == 0


def test_language_model(spark):
    rows = [(i, t) for i, t in near_copies()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = ngram_lm.held_out("doc_id", 7, 2)
    model = ngram_lm.train(docs.where(~out), bits=2)
    got = {r.doc_id: r for r in ngram_lm.score(docs, model).collect()}
    tokens = lambda t: [*words(t), "</s>"]
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))

    def discounts(counts):
        n = collections.Counter(counts)
        if min(n[1], n[2], n[3]) == 0:
            return [0, 0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate((1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]), 1))]

    contexts = collections.Counter(w for _, w in pairs)
    d2, d1, total = discounts(pairs.values()), discounts(contexts.values()), len(pairs)
    spare = sum(d1[min(x, 3)] for x in contexts.values()) / total
    whole, left = collections.Counter(), collections.Counter()
    for (v, _), n in pairs.items():
        whole[v] += n
        left[v] += d2[min(n, 3)]

    def p(v, w):
        low = max(contexts[w] - d1[min(contexts[w], 3)], 0) / total + spare / (len(c) + 1)
        return low if not whole[v] else max(pairs[v, w] - d2[min(pairs[v, w], 3)], 0) / whole[v] + left[v] / whole[v] * low

    for i, t in rows:
        w = tokens(t)
        assert got[i].n_tokens == len(w) and got[i].n_known == sum(c[x] > 0 for x in w)
        assert math.isclose(got[i].score, sum(math.log10(p(v, x)) for v, x in zip(["<s>", *w], w, strict=False)), rel_tol=1e-9)
        assert math.isclose(got[i].base_score, sum(math.log10((c[x] + 1) / (sum(c.values()) + len(c) + 1)) for x in w), rel_tol=1e-9)
    assert math.isclose(sum(p("abc", w) for w in c) + p("abc", "unseen"), 1, rel_tol=1e-9)


def test_language_model_of_order_three(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = ngram_lm.held_out("doc_id", 7, 2)
    model = ngram_lm.train(docs.where(~out), bits=2, order=3)
    got = {r.doc_id: r for r in ngram_lm.score(docs, model).collect()}
    tokens = lambda t: [*words(t), "</s>"]
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    vocabulary = {w for t in train for w in t}
    triples = collections.Counter(x for t in train for x in zip(["<s>", "<s>", *t], ["<s>", *t], t, strict=False))
    pairs = collections.Counter((v, w) for _, v, w in triples)
    singles = collections.Counter(w for _, w in pairs)

    def part(counts):
        n = collections.Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if min(n[1], n[2], n[3]) else None
        d = [0, 0.5, 0.75, 0.9] if y is None else [0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate((1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]), 1))]
        whole, left = collections.Counter(), collections.Counter()
        for x, c in counts.items():
            whole[x[:-1]] += c
            left[x[:-1]] += d[min(c, 3)]
        return lambda x, low: (max(counts[x] - d[min(counts[x], 3)], 0) + left[x[:-1]] * low) / whole[x[:-1]] if whole[x[:-1]] else low

    one, two, three = part(collections.Counter({(w,): c for w, c in singles.items()})), part(pairs), part(triples)
    p = lambda u, v, w: three((u, v, w), two((v, w), one((w,), 1 / (len(vocabulary) + 1))))
    for i, t in rows:
        w = tokens(t)
        assert math.isclose(got[i].score, sum(math.log10(p(*x)) for x in zip(["<s>", "<s>", *w], ["<s>", *w], w, strict=False)), rel_tol=1e-9), i
    u, v, _ = max(triples, key=triples.get)
    assert math.isclose(sum(p(u, v, w) for w in vocabulary) + p(u, v, "unseen"), 1, rel_tol=1e-9)
    assert model.n_tokens == sum(map(len, train))
    none = docs.limit(0)
    assert ngram_lm.score(none, ngram_lm.train(none, order=3)).count() == 0


def test_budgets_water_fill(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 100), ("b", "x", 1000), (None, "x", 5), ("z", "x", 50)], "k0 string, k1 string, tokens bigint")
    out = mixing.budgets(leaves, ["k0", "k1"], [{"a": 2, "b": 1, "z": 0}, {"x": 3, "y": 1}], F.lit(300), 1)
    got = {(r.k0, r.k1): r.budget for r in out.collect()}
    # null supplies 5; a is worth 2/3 of the other 295 but has 110, so b takes 185; inside a all is taken
    assert got == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 185, (None, "x"): 5, ("z", "x"): 0}
    tight = {(r.k0, r.k1): r.budget for r in mixing.budgets(leaves, ["k0", "k1"], [{"a": 2, "b": 1, "z": 0}, {"x": 3, "y": 1}], F.lit(40), 1).collect()}
    assert tight == {("a", "x"): 10, ("a", "y"): 13, ("b", "x"): 11, (None, "x"): 5, ("z", "x"): 0}  # y gets what its sibling lacks


def test_mixing_equals_sql(spark):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = db.execute(queries.oracle_sql()["op3_source_mixing"]).fetchall()
    columns = [c[0] for c in db.description]
    got = [tuple(r) for r in queries.op3_source_mixing(spark, SF).select(*columns).collect()]
    assert sorted(got) == sorted(want) and {r[columns.index("copies")] for r in want} >= {1, 2}


def test_quality_model_keeps_trusted_texts(spark):
    d = "/root/testdata/sf0.01"
    got = quality_model.quality_scores(queries.read(spark, d, "documents"), queries.read(spark, d, "labels")).join(queries.read(spark, d, "labels"), "doc_id")
    rates = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rates[1] > 0.97 and rates[0] < 0.5


def test_quality_thresholds_cover_all_trusted_texts(spark):
    """The bound on the training sample leaves every language its own percentiles, those of all rows outside training."""
    d = "/root/testdata/sf0.01"
    docs, labels = queries.read(spark, d, "documents"), queries.read(spark, d, "labels")
    got = quality_model.quality_scores(docs, labels, max_trusted=60).join(labels, "doc_id").toPandas()
    learned = {i for i in quality_model.trusted_ids(labels, 60) if zlib.crc32(str(i).encode()) % 4}
    held = got[(got.quality == 1) & ~got.doc_id.isin(learned)]
    assert held.lang.value_counts().min() >= 25 and got.low.nunique() == (held.lang.value_counts() >= 30).sum() + (held.lang.value_counts() < 30).any()
    for lang, rows in held.groupby("lang"):
        if len(rows) >= 30:
            q05, q50, _ = (-rows.score / rows.n_pieces).quantile([0.05, 0.5, 0.95])
            assert all(abs(math.log10(x) - (q05 - 3 * (q50 - q05))) < 1e-4 for x in got[got.lang == lang].low)


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op10_toxicity(spark, d).join(queries.read(spark, d, "labels"), "doc_id").where("held_out").toPandas()
    high, low = got[got.toxic == 1].score.mean(), got[got.toxic == 0].score.mean()
    assert high > low + 0.2
    assert toxicity.fit([], []).p["bias"][0] < -50


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stage = docs
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, stage, SF).collect()
        ids = {r.doc_id for r in out}
        if k == 1:
            parts = brute_components([(r.doc_id, r.text) for r in sorted(stage.collect())], 5, 80)
            assert ids == {i for i, (_, c) in parts.items() if i == c}
        if k < 4:
            assert [c for c in docs.columns] == f(spark, stage, SF).columns and len(out) == len(ids) and ids < set(rows)
            assert all(rows[r.doc_id] == r for r in out)
            stage = spark.createDataFrame(out, docs.schema)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids


def test_quality_model_learns_from_every_trusted_text(spark, monkeypatch):
    """More than 20 000 trusted documents: all outside the fold are learned from, by a join, and no ids are collected."""
    monkeypatch.setattr(quality_model, "trusted_ids", None)
    learned = []
    train = quality_model.ngram_lm.train
    monkeypatch.setattr(quality_model.ngram_lm, "train", lambda docs, *a: (learned.append(docs.count()), train(docs, *a))[1])
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word number "), F.col("id") % 50).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 20 != 0).cast("int").alias("quality"))
    got = quality_model.quality_scores(docs, labels)
    assert got.count() == 24_000 and got.select("low").distinct().count() == 1
    assert learned == [sum(i % 20 != 0 and zlib.crc32(str(i).encode()) % 4 != 0 for i in range(24_000))]
