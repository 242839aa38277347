"""Registered queries and whole operators against brute force, and their defined cases."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronomotif.llm import components, decontaminate, jaccard_join, mixing, ngram_lm, quality_model, queries, token_files, toxicity

SF = "/root/testdata/sf0.001"
words = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def kneser_ney(sequences, order):
    """p(token, the tokens before it) of an interpolated modified Kneser-Ney model, by dictionaries."""
    vocabulary = {w for t in sequences for w in t}
    top: collections.Counter = collections.Counter()
    for t in sequences:
        padded = ["<s>"] * (order - 1) + t
        for i in range(order - 1, len(padded)):
            top[tuple(padded[i - order + 1 : i + 1])] += 1
    levels = [top]
    for _ in range(order - 1):
        levels.append(collections.Counter(x[1:] for x in levels[-1]))

    def part(counts):
        n = collections.Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if min(n[1], n[2], n[3]) else None
        d = [0, 0.5, 0.75, 0.9] if y is None else [0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate((1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]), 1))]
        whole, left = collections.Counter(), collections.Counter()
        for x, c in counts.items():
            whole[x[:-1]] += c
            left[x[:-1]] += d[min(c, 3)]
        return lambda x, low: (max(counts[x] - d[min(counts[x], 3)], 0) + left[x[:-1]] * low) / whole[x[:-1]] if whole[x[:-1]] else low

    parts = [part(c) for c in reversed(levels)]

    def p(*x):
        low = 1 / (len(vocabulary) + 1)
        for k, f in enumerate(parts, 1):
            low = f(tuple(x[-k:]), low)
        return low

    return p


def test_lm_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.read(spark, SF, "documents").collect()]
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = {i: [*words(t), "</s>"] for i, t in rows}
    train = [tokens[i] for i, _ in rows if not out[i]]
    counts = collections.Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    p = kneser_ney(train, 3)
    got = queries.op7_lm_scoring(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(t), sum(w in counts for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        padded = ["<s>", "<s>", *t]
        assert math.isclose(r.score, sum(math.log10(p(*padded[i : i + 3])) for i in range(len(t))), rel_tol=1e-7), r.doc_id


def test_lost_model_files_are_an_error(spark):
    docs = spark.createDataFrame([(i, f"a b c d{i % 5} e") for i in range(40)], "doc_id bigint, text string")
    model = ngram_lm.train(docs, bits=2, order=3)
    ngram_lm.score(docs, model).count()
    import os

    for f in os.listdir(model.folder):
        if f.startswith(("pair-", "hot-")):  # pairs of frequent tokens lie in tables of their own
            os.remove(f"{model.folder}/{f}")
    model._maps.clear()
    with pytest.raises(Exception, match="No such file"):
        model.score([ngram_lm.word_tokens(f"a b c d{i} e") for i in range(5)])
    ngram_lm.drop_model(spark, model)
    assert not os.path.exists(model.folder)


def test_table_files():
    rng = np.random.default_rng(1)
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        for bits in (0, 3, 20):
            for n in (0, 1, 5, 4000):
                keys = rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)
                if bits:
                    keys = (keys >> np.uint64(bits)) | (np.uint64(2) << np.uint64(64 - bits))
                keys = np.unique(keys)
                values = rng.integers(0, 300, (len(keys), 2)).astype(np.uint16)
                ngram_lm._save(folder, "t", 2, bits, keys, values)
                table = ngram_lm._Table(f"{folder}/t-2", bits)
                others = np.setdiff1d(np.unique(keys ^ np.uint64(1 << 40)), keys)
                hit, found = table.find(keys)
                assert hit.all() and (found == values).all() and not table.find(others)[0].any()


def test_quality_model_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.read(spark, sf, "documents"), queries.read(spark, sf, "labels")
    got = {r.doc_id: r for r in quality_model.quality_scores(docs, labels).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    pieces = lambda t: [x for w in (t or "").split() for m in ["^" + w] for x in (m[i : i + 3] for i in range(0, len(m), 3))] + ["</s>"]
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & rows.keys()
    inside = [pieces(rows[i].text) for i in sorted(good) if zlib.crc32(str(i).encode()) % 4]
    p = kneser_ney(inside, 2)
    score = {}
    for i in [*sorted(rows)[::40], *sorted(good)[:20]]:
        t = ["<s>", *pieces(rows[i].text)]
        score[i] = sum(math.log10(p(*t[k : k + 2])) for k in range(len(t) - 1))
        assert got[i].n_pieces == len(t) - 1 and math.isclose(got[i].score, score[i], rel_tol=1e-7), i
        assert math.isclose(math.log10(got[i].perplexity), -score[i] / (len(t) - 1), rel_tol=1e-7)
    for r in got.values():
        x, room = math.log10(r.perplexity), 15 / r.n_pieces
        assert r.kept == (math.log10(r.low) - room <= x <= math.log10(r.high) + room)


def odd(spark, *extra):
    """Nulls, empties, repeated rows and ids, and names that operators use inside."""
    rows = [(1, "a b c d e f g h", "en", "s"), (1, "a b c d e f g h", "en", "s"), (1, "other words " * 30, None, None), (None, "a b c d e f g h", "en", "s"), (None, None, "de", "s"), (4, "", "fr", None), (5, "x" * 50_000, "en", "s"), (6, "word " * 20_000, "en", "t"), *extra]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.withColumn("id", F.lit(7)).withColumn("key", F.lit("k")).withColumn("n", F.lit(1)).withColumn("score", F.lit("s")).withColumn("_text", F.lit(0)).withColumn("row", F.lit(2)).withColumn("tokens", F.lit(3)).withColumn("n_words", F.lit(3)).repartition(3)


def test_odd_rows(spark):
    docs = odd(spark)
    none = docs.limit(0)
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 1), (6, 1, 0), (None, 1, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")
    groups = jaccard_join.jaccard_components(docs).collect()
    assert len(groups) == 8 and {(r.doc_id, r.n_shingles, r.component_id) for r in groups} >= {(None, 5, 1), (1, 5, 1), (4, 0, 4), (5, 1, 5)}
    texts = jaccard_join.jaccard_components(docs.withColumn("doc_id", F.concat(F.lit("x"), "doc_id"))).collect()
    assert {r.component_id for r in texts if r.doc_id == "x1"} == {"x1"}
    scored = ngram_lm.score(docs, ngram_lm.train(docs, order=3))
    assert scored.count() == 8 and sorted(r.n_tokens for r in scored.collect()) == [1, 1, 2, 9, 9, 9, 61, 20_001]
    kept = quality_model.quality_scores(docs, labels)
    assert kept.count() == 8 and kept.where("kept IS NULL").isEmpty() and {r.kept for r in quality_model.quality_scores(docs, labels.limit(0)).collect()} == {True}
    assert set(quality_model.trusted_ids(labels, 10)) == {1, 5}
    tox = toxicity.toxicity(docs, labels, F.lit(True)).collect()
    assert len(tox) == 8 and all(0 <= r.score <= 1 for r in tox) and len({r.score for r in tox if r.doc_id in (None, 4)}) <= 2
    assert all(r.score < 1e-20 for r in toxicity.toxicity(docs, labels.limit(0), F.lit(True)).collect())
    bench = spark.createDataFrame([("i", "c d e"), (None, "a b"), ("j", None), ("k", "")], "item string, body string")
    hits = decontaminate.contamination(docs, bench, item_col="item", item_text="body").collect()
    assert sorted(r.n_hit for r in hits) == [0] * 5 + [3] * 3 and {tuple(r["items"]) for r in hits} == {(), ("i",)}
    levels = queries.mix_levels()
    mixed = mixing.mix(docs, levels, queries.MIX_WEIGHTS, F.expr("_all"), max_epochs=1)
    rows = [r["row"] for r in mixed.collect()]
    assert len(rows) == 8 and set(mixed.select("row.*").columns) == set(docs.columns)
    path = queries.tokenizer_path("word_bpe_49k.json")
    digests = token_files.token_digests(docs, path).collect()
    assert [r.doc_id for r in sorted(digests, key=lambda r: r.start)] == [None, None, 1, 1, 1, 4, 5, 6] and sum(r.n_tokens for r in digests) == max(r.start + r.n_tokens for r in digests)
    for empty in (jaccard_join.jaccard_components(none), ngram_lm.score(none, ngram_lm.train(none)), quality_model.quality_scores(none, labels), toxicity.toxicity(none, labels, F.lit(True)), decontaminate.contamination(none, bench, item_col="item", item_text="body"), mixing.mix(none, levels, queries.MIX_WEIGHTS, F.expr("_all")), token_files.token_digests(none, path)):
        assert empty.count() == 0


def test_near_copies_leave_one_row(spark):
    docs = odd(spark, (2, "a b c d e f g h", "en", "s"), (9, "other words " * 30, "en", "z"))
    left = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id, (r.text or "")[:5]) for r in left if r.doc_id is not None) == [(False, 1, "other"), (False, 4, ""), (False, 5, "xxxxx"), (False, 6, "word ")]
    assert sorted((r.text or "")[:5] for r in left if r.doc_id is None) == ["", "a b c"]
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0


def test_large_tiles(spark, monkeypatch):
    """Groups beyond every limit: dealt into parts and blocks, the result is that of brute force."""
    import random

    monkeypatch.setattr(jaccard_join, "PART", 32)
    monkeypatch.setattr(jaccard_join, "ANCHORS", 4)
    rng = random.Random(4)
    bank = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    rows = []
    for g in range(3):
        base = rng.choices(bank, k=100)
        for _ in range(150):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(bank)
            rows.append(" ".join(w))
        half = base[:85] + rng.choices(bank, k=15)  # shares a lot, links with few
        rows += [" ".join(half[: rng.randrange(90, 100)]) for _ in range(20)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    from test_corpus import brute_components

    want = brute_components(rows, 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == want
    monkeypatch.setattr(jaccard_join, "SETS", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "HOT", 20)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, near=1).collect()} == want


def test_components(spark):
    import random

    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r.key: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: top(x) for x in got} and set(got) >= {x for a, b in links if a != b for x in (a, b)}


def test_toxicity_scoring_against_plain_recurrence():
    """The windows' scores by loops over words and gates, and the highest of them."""
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) * 3 for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    bank = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(60)]
    texts = [" ".join(rng.choice(bank, n)) for n in (1, 5, 48, 49, 80, 200)] + ["", None]
    sig = lambda x: 1 / (1 + np.exp(-x))
    h = toxicity.HIDDEN

    def window(ws):
        both = []
        for d in range(2):
            u, state, out = net.p["u"][d], np.zeros(h), {}
            for t in range(len(ws)) if d == 0 else reversed(range(len(ws))):
                x = net.inputs([ws[t]])[0].astype(np.float64)
                g = x @ net.p["w"][d] + net.p["b"][d]
                z, r = sig(g[:h] + state @ u[:, :h]), sig(g[h : 2 * h] + state @ u[:, h : 2 * h])
                state = state + z * (np.tanh(g[2 * h :] + (r * state) @ u[:, 2 * h :]) - state)
                out[t] = state
            both.append([out[t] for t in range(len(ws))])
        states = [np.concatenate(x) for x in zip(*both, strict=True)]
        if not states:
            return sig(net.p["bias"][0])
        a = np.exp([s @ net.p["att"] for s in states])
        return sig(sum(x * s for x, s in zip(a / a.sum(), states, strict=True)) @ net.p["out"] + net.p["bias"][0])

    got = toxicity.score_texts(net, texts, {})
    for t, score in zip(texts, got, strict=True):
        ws = toxicity.words_of(t)
        starts = range(0, max(1, -(-(len(ws) - toxicity.WINDOW) // toxicity.STRIDE) + 1) * toxicity.STRIDE, toxicity.STRIDE) if len(ws) > toxicity.WINDOW else [0]
        assert abs(score - max(window(ws[a : a + toxicity.WINDOW]) for a in starts)) < 1e-4


def test_pipeline_against_brute_force(spark):
    """run() on all documents, stage by stage by other means: SQL, loops over all pairs and windows, SQL again, the tokenizer."""
    import duckdb
    from test_corpus import brute_components
    from tokenizers import Tokenizer

    from chronomotif.llm import quality_rules

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    kept = {r[0] for r in db.execute(f"select doc_id from ({quality_rules.measures_sql()}) where kept").fetchall()}
    rows = [(r.doc_id, r.text) for r in queries.read(spark, SF, "documents").orderBy("doc_id").collect() if r.doc_id in kept]
    least = brute_components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if least[i][1] == i]
    clean = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in queries.read(spark, SF, "benchmark").collect():
        x = clean(r.text)
        windows |= {tuple(x[a : a + 10]) for a in range(max(1, len(x) - 9))} if x else set()
    sizes = {len(w) for w in windows}
    rows = [(i, t) for i, t in rows if not any(tuple(w[a : a + n]) in windows for w in [clean(t)] for n in sizes for a in range(len(w) - n + 1))]
    db.execute(f"create view left_ as select * from documents where doc_id in ({', '.join(str(i) for i, _ in rows)})")
    mixed = {r[0] for r in db.execute(mixing.mix_sql("left_", {"domain": queries.MIX_DOMAIN_SQL, "lang": "lang", "source": "source"}, queries.MIX_WEIGHTS, "(_all * 9) // 10", 1, queries.MIX_SEED)).fetchall()}
    assert 0 < len(mixed) < len(rows) < len(kept) < 200
    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    start, want = 0, {}
    for i, x in sorted(rows):
        if i in mixed:
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
            want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()} == want
