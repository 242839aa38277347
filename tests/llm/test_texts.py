"""The one-pass operators against plain Python, on awkward texts: null, empty, long, special strings, repeats, clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from chronomotif.llm import decontaminate, quality_rules, queries, token_counts, token_files, toxicity, url_filter, url_labels

WORD = re.compile("[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "word", "Don't stop, we've 3 DOGS!\n\nDon't stop", "Ünïcode straße ÀÉ × ÷ İstanbul ǰ ŉ", "日本語 テキスト mixed with english", "á ë combining ​ zero", "<|endoftext|> inside<|startoftext|>text <| no", "emoji 😀😀 tail\x1cctrl\x85next nbsp",
    "the cat sat on the mat. " * 40, "x" * 3000, " ".join(f"w{i % 97}" for i in range(30_000)), "the cat sat on the mat. " * 40, "tabs\there\r\nlines\r\n  two  spaces ", "''s 'S 'll'd '' ! ?? ...",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id string, n_words int").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def test_token_counts(spark, docs, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect()}
    want = {i: (len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in enumerate(TEXTS)}
    assert got == want
    assert token_counts.token_counts(none, path).count() == 0
    tier = token_counts.frequent_tier(docs, path)
    assert tier.find([" mat", "no such", " cat", "ß"]) == {" mat": len(t.encode(" mat").ids), " cat": len(t.encode(" cat").ids)} and len(tier.hashes) > 20
    assert token_counts.Tier({}).find(["x"]) == {} and token_counts.count_texts(TEXTS, path, tier) == token_counts.count_texts(TEXTS, path)


def test_token_files(spark, docs, none, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = token_files.write_tokens(docs, path, str(tmp_path / "tokens"))
    got = {r.id: (r.start, list(r.ids)) for r in token_files.read_tokens(spark, out).collect()}
    at = 0
    for i, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        assert got[i] == (at, ids), i
        at += len(ids)
    crc = {r.doc_id: r.ids_crc32 for r in token_files.token_digests(docs, path).collect()}
    assert crc == {i: zlib.crc32(np.array(ids, "<u4").tobytes()) for i, (_, ids) in got.items()}
    assert token_files.token_digests(none, path).count() == 0
    monkeypatch.setattr(token_files, "RANGES", 2)  # ranges cut further
    for shards in (4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", shards)
        assert {r.doc_id: (r.start, r.ids_crc32) for r in token_files.token_digests(docs, path).collect()} == {i: (start, crc[i]) for i, (start, _) in got.items()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_every_code_point_is_encoded_as_by_the_tokenizer():
    """Alone and inside words: all code points below U+0300, the rest of the plane by steps, and random mixes."""
    import random

    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    points = [c for c in [*range(1, 0x300), *range(0x300, 0x30000, 37)] if not 0xD800 <= c < 0xE000]
    texts = [x for c in map(chr, points) for x in (c, f"{c}x", f"a{c}b", f"1{c}'s {c}{c}")]
    rng = random.Random(5)
    texts += ["".join(chr(rng.choice(points[:0x2FF])) if rng.random() < 0.4 else rng.choice("abcXYZ '019.!") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    want = [e.ids + [1] for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in token_files.encode_texts(texts, path, 1)] == want


def test_coding_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.code(v)
        assert (token_files.decode(control, data, [n]) == v).all()
    parts = [rng.integers(0, 70_000, n).astype(np.uint32) for n in (5, 0, 3, 8)]
    coded = [token_files.code(p) for p in parts]
    assert (token_files.decode(b"".join(c for c, _ in coded), b"".join(d for _, d in coded), [len(p) for p in parts]) == np.concatenate(parts)).all()


def measures(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 3)} if len(w) < 2000 else None
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit) if hit is not None else len(w)


def test_quality_rules(spark, docs, none):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(TEXTS):
        r, m = got[i], measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, i
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and (not r.kept or not r.base_failed)
    assert quality_rules.quality_rules(none).count() == 0
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_decontamination(spark, docs, none):
    items = [(1, "the cat sat on"), (2, None), (None, "the mat"), (3, ""), (4, " ".join(f"W{i}" for i in range(20, 45))), (4, "3 dogs"), (5, "not there at all"), (1, "the cat sat on")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for limits in ({}, {"max_windows": 3}, {"max_bytes": 40}):  # one automaton, a block for each item, several parts
        got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, **limits).collect()}
        for i, t in enumerate(TEXTS):
            w, hit, names = words(t), set(), set()
            for k, x in items:
                x = words(x)
                n = min(10, len(x))
                for a in range(len(x) - n + 1) if k is not None and x else ():
                    for b in range(len(w) - n + 1):
                        if w[b : b + n] == x[a : a + n]:
                            hit.update(range(b, b + n))
                            names.add(k)
            assert (got[i].n_words, got[i].n_hit, got[i].items) == (len(w), len(hit), sorted(names)), i
            inside = [x for s in got[i].spans for x in words(t[s.start : s.end])]
            assert len(inside) == len(hit) and set(inside) <= {x for k, y in items if k is not None for x in words(y)}
        left = decontaminate.drop_contaminated(docs, bench, **limits)
        assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.n_hit}
    assert decontaminate.contamination(none, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


def brute_rule(host, path):
    fits = [(h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_url_filter(spark):
    """Odd URLs and all pages against plain Python: host, path, rule, the model's score and the verdict."""
    urls = ["http://WWW.Example.org/en/17?x#y", "https://a.example.org/es/", "https://example.com/de/x", "http://b.net/fr/", "nothing", None, "", "http://x.com?q", "http://notorg/x", "a://b://c.com/fr/", "://org", "http://ORG/", "x://com/fr", "http://com/fr/" * 2000, "http://b.net/fr/"]
    urls += ["http://Ünï.org/ß?", "http://x.net/" + "long/" * 30_000, "http://a.b?c/d", "http://a.b#c/d", "http://a.b/c#d?e", "http://É.COM/de/"]
    rows = [(i, u, "h", "p") for i, u in enumerate(urls)] + [(3, "http://b.net/fr/", "h", "p")]
    odd = spark.createDataFrame(rows, "page_id bigint, url string, host string, path string").repartition(3)
    labelled = spark.createDataFrame([*url_labels.rows(), (None, 1), ("http://x.y", None)], "url string, label int")
    model = url_filter.train(sorted(url_labels.rows()))
    for pages in (odd, queries.read(spark, "/root/testdata/sf0.01", "pages")):
        want = sorted((r.page_id, *url_filter.host_path(r.url)) for r in pages.select("page_id", "url").collect())
        got = sorted((r.page_id, r.host, r.path, r.rule, r.score, r.verdict) for r in url_filter.judge_urls(pages, queries.URL_RULES, labelled).collect())
        assert [x[:3] for x in got] == want
        for _, host, path, rule, score, verdict in got:
            by, says = brute_rule(host, path)
            assert rule == by and (score is None) == (by is not None)
            if by is None:
                assert abs(score - url_filter.score(host, path, model)) < 1e-9
                says = "block" if score >= 0.5 else "allow"
            assert verdict == says
    assert {x[5] for x in got if x[3] is None} == {"allow", "block"}
    assert url_filter.judge_urls(odd.limit(0), queries.URL_RULES, labelled).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(odd, [], labelled.limit(0)).collect()} == {"block"}
    with pytest.raises(ValueError, match="at most"):
        url_filter.judge_urls(odd, [], spark.range(url_filter.MAX_LABELLED + 1).selectExpr("'http://a.b' as url", "1 as label"))


def test_url_model_on_unseen_hosts():
    """Hosts are either trained on or tested, never both; and hosts whose words the table doesn't have."""
    rows = sorted(url_labels.rows())
    fold = lambda u: zlib.crc32(url_filter.host_path(u)[0].encode()) % 5
    right = []
    for k in range(5):
        model = url_filter.train([r for r in rows if fold(r[0]) != k])
        right += [(url_filter.score(*url_filter.host_path(u), model) >= 0.5) == bool(y) for u, y in rows if fold(u) == k]
    assert np.mean(right) > 0.75 and len(right) == len(rows)
    model = url_filter.train(rows)
    new = [("casinos4you", 1), ("pokerking", 1), ("loteries-jackpots", 1), ("pharmapill", 1), ("sexcam", 1), ("adclick", 1), ("freewinners", 1), ("bettingtips", 1)]
    new += [("newspapers", 0), ("librarians", 0), ("recipebook", 0), ("museums", 0), ("gardeners", 0), ("historians", 0), ("schoolbooks", 0), ("musicians", 0), ("plenk", 0), ("vostry", 0)]
    known = {w for u, _ in rows for w in re.split("[^a-z0-9]+", url_filter.host_path(u)[0])}
    assert not known & {w for h, _ in new for w in h.split("-")}
    assert np.mean([(url_filter.score(f"www.{h}.net", "/", model) >= 0.5) == bool(y) for h, y in new]) > 0.8


def test_toxicity_gradients_and_learning():
    net = toxicity.Network(1)
    rng = np.random.default_rng(0)
    rows = rng.integers(-1, 5, (3, toxicity.WINDOW))
    rows[0, 40:] = -1
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    gates = net.gates(rng.normal(size=(5, 2 * toxicity.WIDTH)))
    out, kept = net.forward(gates, rows, keep=True)
    grad, _ = net.backward(kept, rows, np.ones(3), 6)
    for key, at in (("u", (0, 1, 3)), ("u", (1, 2, 20)), ("att", (3,)), ("out", (9,))):
        old = net.p[key][at]
        net.p[key][at] = old + 1e-2
        up = net.forward(gates, rows).sum()
        net.p[key][at] = old - 1e-2
        down = net.forward(gates, rows).sum()
        net.p[key][at] = old
        assert abs((up - down) / 2e-2 - grad[key][at]) < 1e-4 * max(1, abs(grad[key][at]))
    bank = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    make = lambda bad: " ".join([*rng.choice(bank, 70), *(["nasty", "vile"] if bad else []), *rng.choice(bank, 70)])
    labels = [int(i % 4 == 0) for i in range(200)]
    net = toxicity.fit([make(x) for x in labels], labels)
    score = toxicity.score_texts(net, [make(x) for x in labels] + [None, "", "!!"], {})
    assert ((score[:200] >= 0.5) == np.array(labels)).mean() > 0.95 and score[200] == score[201] == score[202]
    assert len(toxicity.windows_of(np.arange(1000))) == 31 and set(toxicity.windows_of(np.arange(1000)).ravel()) >= set(range(1000))


def test_decontamination_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(r.item_id, words(r.text)) for r in queries.read(spark, sf, "benchmark").collect()]
    windows: dict = {}
    for k, x in items:
        n = min(10, len(x))
        for a in range(len(x) - n + 1) if x else ():
            windows.setdefault(tuple(x[a : a + n]), set()).add(k)
    sizes = {len(w) for w in windows}
    got = {r.doc_id: r for r in queries.op9_decontamination(spark, sf).collect()}
    rows = queries.read(spark, sf, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        w, hit, names = words(r.text), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    names |= found
        digest = hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == (len(w), len(hit), len(names), digest, bool(hit)), r.doc_id
    assert any(g.contaminated for g in got.values())
