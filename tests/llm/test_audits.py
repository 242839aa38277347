"""Fingerprints, whitening and the filter audit against brute force and SQL, and their defined cases."""

import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronomotif.llm import filter_audit, fingerprints, queries, whitening

SF = "/root/testdata/sf0.001"
split = lambda t: re.findall("[^\x20\x09-\x0d]+", t or "")


def by_sql(name, **tables):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    for table, rows in tables.items():
        db.register(f"own_{table}", rows)
        db.execute(f"create or replace view {table} as select * from own_{table}")
    got = db.execute(queries.oracle_sql()[name])
    return [c[0] for c in got.description], sorted(map(repr, got.fetchall()))


@pytest.mark.parametrize("name", ["op11_fingerprints", "op13_filter_audit"])
def test_query_equals_sql(spark, name):
    columns, want = by_sql(name)
    got = getattr(queries, name)(spark, SF).select(*columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def odd_texts():
    rng = random.Random(4)
    bank = ["".join(rng.choices("abcdeé", k=5)) for _ in range(300)]
    long = " ".join(rng.choices(bank, k=12_000))
    some = [" ".join(rng.choices(bank, k=rng.randrange(1, 400))) for _ in range(30)]
    return [None, "", " \t\n", "one", "two  words", "a b c d", "a b c d e", "A B C D e" * 40, "x#y " * 120, long, long + "!", "é　😀 z", *some, some[0], some[0], some[1] + " end"]


def test_filter_audit_on_odd_rows(spark):
    texts = odd_texts()
    langs = ["en", None, "", "de"]
    rows = [(i if i % 9 else None, t, langs[i % 4], i, "x") for i, t in enumerate(texts * 2)]
    rows += rows[3:8]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, mask int, step string").repartition(3)
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (5, None, 1), (None, 1, 1), (7, 1, 0), (7, 1, 0), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")
    columns, want = by_sql("op13_filter_audit", documents=docs.toPandas().astype({"doc_id": "Int64"}), labels=labels.toPandas().astype("Int64"))
    got = filter_audit.audit(docs, labels).select(*columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert len(got) == 600 * 3 and {r.part for r in got} == {"", "en", "de"}
    for part in ("", "en", "de"):
        mine = [r for r in got if r.part == part]
        assert len({(r.filter_order, r.step) for r in mine}) == 600 and {r.filter_order for r in mine} == set(map("".join, itertools.permutations("ABCDE")))
        assert len({r.kept for r in mine if r.step == 5}) == 1
    assert filter_audit.audit(docs.limit(0), labels).count() == 0


def brute_sketch(text, k=fingerprints.K):
    w = split(text)
    found = {hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(1, len(w) - 4))} if w else set()
    return sorted(found)[:k], found


def likeness(a, b, k=fingerprints.K):
    union = sorted({*a, *b})[:k]
    return sum(h in a and h in b for h in union) / len(union) if union else 1.0


@pytest.mark.parametrize("rows_a_range", [1, 4, 1000])
def test_fingerprints_against_brute_force(spark, rows_a_range):
    rows = [(i * i - 40 if i % 7 else None, t) for i, t in enumerate(odd_texts())]
    rows += rows[:4] + [(-40, "another text of the same id"), (-40, "and one more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"range": F.lit("clash"), "guest": F.lit(1), "h": F.lit(2)}).repartition(5)
    got = fingerprints.edited_fingerprints(docs, rows_a_range=rows_a_range).collect()
    h = lambda t: (x := xxhash.xxh64((t or "").encode(), seed=42).intdigest()) - ((x >> 63) << 64)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h(r[1])))
    want = []
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[: n - n // 4] + following[: n // 4]
        (s, every), (e, _), (x, _) = brute_sketch(text), brute_sketch(edited), brute_sketch(following)
        size = len(every) if len(s) < fingerprints.K else None
        want.append((doc, n, hashlib.sha256(edited.encode()).hexdigest(), "".join(s), "".join(e), likeness(s, e), likeness(s, x), size))
    close = lambda r: (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, int(r.n_distinct) if len(r.fingerprint) < 16 * fingerprints.K else None)
    assert sorted(map(repr, map(close, got))) == sorted(map(repr, want))
    assert all(0 <= r.in_edited <= 1 and 0 <= r.near_edited <= 1 for r in got)


def test_fingerprints_of_one_document_and_none(spark):
    one = spark.createDataFrame([("key", "a b c d e f g h")], "doc_id string, text string")
    r = fingerprints.edited_fingerprints(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"a b c d e f a b").hexdigest()[:64] and r.near_next == 1.0 and r.n_chars == 15
    assert fingerprints.edited_fingerprints(one.limit(0)).count() == 0


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(8)
    bank = [f"w{i}" for i in range(4000)]
    base = rng.choices(bank, k=6000)
    rows = []
    for i in range(40):
        w = list(base[: 1500 + 100 * i])
        for _ in range(i * 6):
            w[rng.randrange(len(w))] = rng.choice(bank)
        rows.append((i, i % 3 if i % 10 else None, " ".join(w)))
    rows += [(100 + i, 1, rows[3][2]) for i in range(20)] + [(200, 5, "")]
    df = spark.createDataFrame(rows, "id int, g int, text string").repartition(6).withColumn("sketch", fingerprints.sketch(F.col("text")))
    for r in fingerprints.merged(df, ["g"]).collect():
        every = set().union(*(brute_sketch(t)[1] for _, g, t in rows if g == r.g))
        assert r.sketch == sorted(every)[: fingerprints.K]
    a, b = df.where("id = 0").select(F.col("sketch").alias("a")), df.where("id BETWEEN 1 AND 39").select("id", F.col("sketch").alias("b"), "text")
    out = b.crossJoin(F.broadcast(a)).select("id", fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.n_distinct(F.col("b")).alias("n"), F.size(fingerprints.from_fingerprint(fingerprints.fingerprint(F.col("b")))).alias("k"))
    first = brute_sketch(rows[0][2])[1]
    wrong = []
    for r in out.collect():
        x = brute_sketch(rows[r.id][2])[1]
        wrong.append((abs(r.r - len(x & first) / len(x | first)), abs(r.c - len(x & first) / len(first)), abs(r.n / len(x) - 1)))
        assert r.k == fingerprints.K
    worst, mean = np.max(wrong, 0), np.mean(wrong, 0)
    assert worst[0] < 0.2 and mean[0] < 0.06 and mean[1] < 0.15 and mean[2] < 0.15


def whitened_by_numpy(vectors, wanted=16):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    k = min(wanted, int((e > 1e-12 * e[-1]).sum()))
    e, v = e[::-1], v[:, ::-1]
    return n, [sum(int(n * a - b) ** 2 for a, b in zip(row, s.tolist(), strict=True)) for row in x.tolist()], (x - s / n) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check_whitening(got, ids, vectors, tolerance=1e-7):
    n, deviation, w, explained = whitened_by_numpy(vectors)
    table = {i: {} for i in ids}
    for r in got:
        assert r.n == n and r.deviation == deviation[ids.index(r.vec_id)] and r.identity_error < 1e-9 and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        table[r.vec_id][r.component] = r.whitened
    mine = np.array([[table[i][c] for c in sorted(table[i])] for i in ids])
    assert mine.shape == w.shape
    assert np.abs(np.abs(mine) - np.abs(w)).max() < tolerance
    assert np.abs(mine * np.sign((mine * w).sum(0)) - w).max() < tolerance


def test_whitening_query_against_numpy(spark):
    rows = queries.read(spark, SF, "embeddings").collect()
    check_whitening(queries.op12_embedding_whitening(spark, SF).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((80, 20)) * np.linspace(3, 0.2, 20)).round(3).astype(np.float32)
    vectors = [v.tolist() for v in good] + [good[0].tolist()] * 40
    ids = list(range(len(vectors)))
    rows = [(i, v, "c", 1) for i, v in zip(ids, vectors, strict=True)]
    bad = [None, [], [float("nan")] * 20, [1.0] * 19 + [None], [float("inf")] + [0.0] * 19, [1.0] * 3, [1.0] * 21]
    rows += [(1000 + i, v, "c", 1) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, x string, n int").repartition(4)
    check_whitening(whitening.whiten(df).collect(), ids, vectors)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id int, embedding array<double>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(5)], "vec_id int, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert len(got) == 5 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    huge = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 0.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect() if r.vec_id < 2} == {None}


def test_range_finder_without_the_full_dimension(spark):
    rng = np.random.default_rng(5)
    d = 120
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    spread = np.concatenate([2.0 ** -np.arange(16) * 4e5, np.full(d - 16, 1e-3)])
    vectors = (rng.standard_normal((400, d)) * spread @ basis).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<double>").repartition(3)
    model = whitening.fit(whitening.clean(df), passes=8, tolerance=1e-8)
    assert not model.full and len(model.values) == 16
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(model.values, e[::-1][:16], rtol=1e-6) and model.identity_error < 1e-6
    assert np.allclose(np.abs(np.sum(model.components * v[:, ::-1][:, :16].T, 1)), 1, atol=1e-6)
