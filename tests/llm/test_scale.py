"""What must hold when the input grows: hot tokens, many shards, several benchmark parts, odd tables through the pipeline."""

import collections
import math
import random
import resource
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import kneser_ney

import corpus_pipeline
from chronomotif.llm import common, decontaminate, ngram_lm, quality_model, queries

SF = "/root/testdata/sf0.001"


def hot_texts():
    rng = random.Random(6)
    bank = [f"w{i}" for i in range(400)]
    texts = [" ".join("the" if rng.random() < 0.34 else "of" if rng.random() < 0.1 else rng.choice(bank) for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    return [*texts, "", None, "the", "the the the the", texts[0]]


def test_hot_middle_tokens_are_spread(spark):
    """One word in a third of all places: no shard holds its triples alone, scores equal brute force."""
    rows = list(enumerate(hot_texts()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    bits = 5
    hot = ngram_lm.hot_tokens(docs, "text", ngram_lm.word_tokens, bits)
    assert set(hot.tolist()) >= {int(ngram_lm.word_tokens("the")[0]), int(ngram_lm.word_tokens("of")[0])} and len(hot) < 20
    counted = [r.shard for r in ngram_lm._count_triples(docs, "text", ngram_lm.word_tokens, bits, hot=hot).collect()]
    plain = ngram_lm._count_triples(docs, "text", ngram_lm.word_tokens, bits).select("shard", F.octet_length("u").alias("n")).groupBy("shard").sum("n").collect()
    spread = ngram_lm._count_triples(docs, "text", ngram_lm.word_tokens, bits, hot=hot).select("shard", F.octet_length("u").alias("n")).groupBy("shard").sum("n").collect()
    most = lambda rows: max(r[1] for r in rows) / sum(r[1] for r in rows)
    assert len(set(counted)) == 32 and most(spread) < 0.1 and most(plain) > 2 * most(spread)  # what is left are the histories "the the"
    model = ngram_lm.train(docs, bits=bits, order=3)
    got = {r.doc_id: r for r in ngram_lm.score(docs, model).collect()}
    tokens = {i: [*(t or "").split(), "</s>"] for i, t in rows}
    p = kneser_ney(list(tokens.values()), 3)
    counts = collections.Counter(w for t in tokens.values() for w in t)
    assert model.n_tokens == sum(counts.values()) and len(model.hot) == len(hot)
    for i, t in tokens.items():
        padded = ["<s>", "<s>", *t]
        assert math.isclose(got[i].score, sum(math.log10(p(*padded[k : k + 3])) for k in range(len(t))), rel_tol=1e-9), i
    other = ngram_lm.train(docs, bits=0, order=3)
    assert len(other.hot) <= 1
    assert {r.doc_id: round(r.score, 6) for r in ngram_lm.score(docs, other).collect()} == {i: round(r.score, 6) for i, r in got.items()}
    for m in (model, other):
        ngram_lm.drop_model(spark, m)


def test_many_shards_with_few_open_files(tmp_path):
    """2048 shards of five tables in a process that may open 256 files."""
    code = f"""
import resource, sys
sys.path.insert(0, {str(common.Path(common.__file__).resolve().parents[2])!r})
import numpy as np
from chronomotif.llm import ngram_lm
resource.setrlimit(resource.RLIMIT_NOFILE, (256, 256))
rng, bits = np.random.default_rng(0), 11
names = ("pair", "context", "triple", "history", "token")
keys = {{}}
for name in names:
    keys[name] = np.unique(rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) << np.uint64(1))
    for s, a, b in ngram_lm._shards(keys[name], bits):
        ngram_lm._save({str(tmp_path)!r}, name, s, bits, keys[name][a:b], (keys[name][a:b] % np.uint64(200)).astype(np.uint8))
model = ngram_lm.LanguageModel({str(tmp_path)!r}, bits, np.ones(10), np.ones(7), 3, {{n: frozenset(range(1 << bits)) for n in names}})
for _ in range(2):
    for name in names:
        assert (model._find(name, keys[name], 1)[:, 0] == (keys[name] % np.uint64(200)).astype(np.int64)).all()
print(len(model._maps))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.stdout.strip() == str(ngram_lm.MAPS), out.stderr
    assert resource.getrlimit(resource.RLIMIT_NOFILE)[0] >= 256


def test_quality_join_shards(spark):
    """The same scores with 64 join shards and with two, whatever a task sends, and with a column named id."""
    docs, labels = queries.read(spark, SF, "documents").repartition(6), queries.read(spark, SF, "labels")
    want = {r.doc_id: (r.score, r.kept) for r in quality_model.quality_scores(docs, labels, join_bits=1).collect()}
    renamed = quality_model.quality_scores(docs.withColumnRenamed("doc_id", "id"), labels.withColumnRenamed("doc_id", "id"), id_col="id", join_bits=6)
    assert {r.id: (r.score, r.kept) for r in renamed.collect()} == want
    model = ngram_lm.train(docs, tokens=ngram_lm.piece_tokens, bits=2)
    rows = quality_model.join_counts(docs, model, 6, flush=2_000).collect()
    assert len({r.shard for r in rows}) == len(rows) == 64
    scores = quality_model.score_joined  # the joined table answers every pair
    model.shards["asked"] = frozenset(r.shard for r in rows)
    direct = {r.doc_id: r.score for r in ngram_lm.score(docs, model, tokens=ngram_lm.piece_tokens).collect()}
    got = {r.id: r.score for r in scores(docs, model, 6, "doc_id", "text", "lang").collect()}
    assert got.keys() == direct.keys() and all(math.isclose(got[i], direct[i], rel_tol=1e-9) for i in got)
    ngram_lm.drop_model(spark, model)


class Captured:
    """Stands for a table; keeps what would run in tasks."""

    def __init__(self, schema):
        self.schema, self.runs = schema, []

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.runs.append(run)
        return self


def test_quality_looks_common_pairs_up_once(spark, monkeypatch):
    """The pairs of texts that came before are neither sent, sorted nor looked up again, and scores don't hang on what a task keeps."""
    docs = queries.read(spark, SF, "documents")
    model = ngram_lm.train(docs.where("doc_id % 3 > 0"), tokens=ngram_lm.piece_tokens, bits=2)
    shards = quality_model.join_counts(docs, model, 4).collect()
    model.shards["asked"] = frozenset(r.shard for r in shards)
    distinct = sum(r.pairs for r in shards)
    table = docs.select("doc_id", "lang", "text").toArrow()
    batches = [b for _ in range(20) for b in table.to_batches()]
    monkeypatch.setattr(ngram_lm, "_dealt", lambda rows, bits: rows)
    looked, find = [], ngram_lm.LanguageModel._find
    monkeypatch.setattr(ngram_lm.LanguageModel, "_find", lambda self, name, asked, *a: (looked.append(len(asked)), find(self, name, asked, *a))[1])

    def scored():
        stub = Captured(docs.schema)
        quality_model.score_joined(stub, model, 4, "doc_id", "text", "lang")
        return [r for b in stub.runs[0](iter(batches)) for r in b.to_pylist()]

    def sent():
        stub = Captured(docs.schema)
        quality_model.join_counts(stub, model, 4)
        return [np.frombuffer(r["pairs"], np.uint64).reshape(-1, 2).tolist() for b in stub.runs[0](iter([b.select(["text"]) for b in batches])) for r in b.to_pylist()]

    want, pairs = scored(), [tuple(p) for part in sent() for p in part]
    assert len(want) == 20 * table.num_rows and [r["id"] for r in want[: table.num_rows]] == table["doc_id"].to_pylist()
    assert distinct <= sum(looked) < 2 * distinct and len(pairs) == len(set(pairs)) == distinct
    for name, small in (("CHARACTERS", 90), ("PLACES", 64), ("WAITING", 5_000), ("ASKED", 700)):
        monkeypatch.setattr(quality_model, name, small)
    batches = table.to_batches()
    assert scored() == want[: table.num_rows] and {tuple(p) for part in sent() for p in part} == set(pairs)
    ngram_lm.drop_model(spark, model)


def test_pieces_against_plain_python():
    """Words and pieces as ``str.split`` and slices give them: every kind of space, marks, nulls, characters of any width."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("aab^ \n\x1c\u3000\x85\xe9\x00\U0001f600") for _ in range(rng.randrange(40))) for _ in range(2_000)]
    texts += [None, "", " ", "a", "ab", "abc", "abcd", "abcde ", "\ud800x"]
    plain = [[x for w in (t or "").split() for m in ["^" + w] for x in (m[i : i + 3] for i in range(0, len(m), 3))] + [None] for t in texts]
    out, starts = ngram_lm.piece_lists(texts)
    assert starts.tolist() == np.cumsum([0, *map(len, plain[:-1])]).tolist() and len(out) == sum(map(len, plain))
    both = set(zip([x for p in plain for x in p], out.tolist(), strict=True))
    assert len(both) == len({x for x, _ in both}) == len({h for _, h in both}) and (None, int(ngram_lm.END)) in both
    assert all((ngram_lm.piece_tokens(t) == out[a : a + len(p)]).all() for t, p, a in zip(texts, plain, starts, strict=True))
    assert not any(chr(i).isspace() for i in range(len(ngram_lm._SPACE), 0x110000))


def test_benchmark_in_parts_one_at_a_time(spark, monkeypatch):
    docs, benchmark = queries.read(spark, SF, "documents"), queries.read(spark, SF, "benchmark")
    rows = lambda **options: sorted((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), tuple(map(tuple, r.spans))) for r in decontaminate.contamination(docs, benchmark, **options).collect())
    want = rows()
    alive, most = set(), []
    made = decontaminate.Part.__init__

    def counted(part, *args):
        made(part, *args)
        alive.add(part.key)
        most.append(len(alive))
        destroy = part.shared.destroy
        monkeypatch.setattr(part.shared, "destroy", lambda: (alive.discard(part.key), destroy()))

    monkeypatch.setattr(decontaminate.Part, "__init__", counted)
    assert rows(max_bytes=2_000) == want and len(most) > 3 and max(most) == 1
    alive.clear()
    kept = decontaminate.drop_contaminated(docs, benchmark, max_bytes=2_000, max_windows=50)
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in want if not r[2]] and max(most) == 1


def test_workers_get_package_and_files_from_spark(spark):
    common.ship(spark)
    path = queries.tokenizer_path("word_bpe_49k.json")
    common.ship_file(spark, path)
    common.ship(spark)

    def run(batches):
        import pyarrow as pa

        import chronomotif
        from chronomotif.llm.common import here

        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([chronomotif.__file__]), pa.array([here(path)])], names=["package", "file"])

    row = spark.range(1).mapInArrow(run, "package string, file string").first()
    assert row.file != path and row.file.endswith("word_bpe_49k.json")
    assert sum(f.endswith("word_bpe_49k.json") for f in spark.sparkContext.listFiles) == 1


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null ids, repeated rows and columns named like those of the stages; and no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.withColumns({c: F.lit("own") for c in ("_row", "row", "key", "component_id", "tokens", "id", "_m", "copies")})
    some = odd.orderBy("doc_id").limit(12)
    odd = odd.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("bigint"))).unionByName(some.withColumn("text", F.lit(None).cast("string")))
    folder = str(tmp_path / "odd")
    odd.write.parquet(f"{folder}/documents.parquet")
    queries.read(spark, SF, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    stage = spark.read.parquet(f"{folder}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = common.written(f(spark, stage, folder), "odd-stage")
        assert out.columns == stage.columns, name
        assert out.where("_row <> 'own' or key <> 'own' or id <> 'own' or copies <> 'own'").count() == 0
        assert 0 < out.count() <= stage.count()
        stage = out
    assert stage.where("text is null").count() == 0 and stage.groupBy("text").count().where("count > 1").count() == 0
    got = corpus_pipeline.run(spark, folder)
    assert got.count() == stage.count() and got.agg(F.sum("n_tokens")).first()[0] > 0
    empty = str(tmp_path / "empty")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    queries.read(spark, SF, "benchmark").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_place_hash_keeps_pairs_apart():
    rng = np.random.default_rng(9)
    v, u = (rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) for _ in range(2))
    v[:9000] = v[0]
    hot = np.sort(v[:1])
    for bits in (0, 1, 8):
        h = ngram_lm.place_hash(v, u, bits, hot)
        assert len(np.unique(h)) == len(h)
        cool = ~ngram_lm.is_hot(v, hot)
        assert (h[cool] == ngram_lm.pair_hash(v, u, bits)[cool]).all()
        if bits == 8:
            per = np.bincount((h[~cool] >> np.uint64(56)).astype(int), minlength=256)
            assert per.max() < 3 * per.mean()


@pytest.mark.parametrize("order", [2, 3])
def test_model_of_one_word(spark, order):
    docs = spark.createDataFrame([(i, "a") for i in range(30)], "doc_id bigint, text string")
    model = ngram_lm.train(docs, bits=4, order=order)
    assert all(r.score < 0 for r in ngram_lm.score(docs, model).collect())
    ngram_lm.drop_model(spark, model)
