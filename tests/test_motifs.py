import random

import pytest
from brute import EVENTS, instances
from pyspark.sql import functions as F

from chronomotif.operators import motifs
from chronomotif.plans import catalog
from chronomotif.plans.motif import loose_pair, prepare
from chronomotif.plans.motif import instances as planned

M1 = "0,1,0,a 1,3,1,a 3,0,2,a 3,2,3,a 2,4,4,a 2,1,5,a 2,0,6,a 4,5,7,a 0,1,8,d 5,0,9,a"
M2 = "0,1,0,a 1,3,1,a 3,0,2,a 3,2,4,a 3,4,4,a 2,4,4,a 2,1,5,a 4,1,5,a 2,0,6,a 4,5,7,a 0,1,8,d 5,0,9,a"


def parsed(s):
    return [(int(u), int(v), int(t), op) for u, v, t, op in (x.split(",") for x in s.split())]


def frame(spark, graphs):
    rows = [(g, i, *e) for g, events in graphs.items() for i, e in enumerate(events)]
    return spark.createDataFrame(rows, EVENTS)


@pytest.fixture(scope="module")
def graphs():
    rng = random.Random(5)
    out = {1: parsed(M1), 2: parsed(M2)}
    for g in range(3, 15):
        out[g] = [(rng.randrange(6), rng.randrange(6), rng.randrange(10), "d" if rng.random() < 0.15 else "a") for _ in range(24)]
    return out


@pytest.mark.parametrize("motif", catalog.NAMES)
@pytest.mark.parametrize("mode", ["induced", "monomorphism"])
def test_counts_match_brute_force(spark, graphs, motif, mode):
    te = frame(spark, graphs)
    for op in ("le", "lt"):
        got = {r[0]: r[1] for r in motifs.count(te, motif, mode=mode, window_op=op).collect()}
        want = {g: len(instances(e, catalog.EDGES[motif], catalog.WINDOWS["default"][motif], op == "lt", mode == "induced")) for g, e in graphs.items()}
        assert got == {g: n for g, n in want.items() if n}


def test_fixture_counts(spark):
    te = frame(spark, {1: parsed(M1), 2: parsed(M2)})
    mono = {m: {r[0]: r[1] for r in motifs.count(te, m, mode="monomorphism").collect()} for m in catalog.NAMES}
    assert {m: mono[m].get(1, 0) for m in mono} == {"3-star": 5, "triangle": 1, "4-path": 5, "4-cycle": 2, "4-chordalcycle": 1, "4-tailedtriangle": 2, "4-clique": 0, "bitriangle": 1, "butterfly": 2}
    assert {m: mono[m].get(2, 0) for m in mono} == {"3-star": 6, "triangle": 1, "4-path": 2, "4-cycle": 3, "4-chordalcycle": 1, "4-tailedtriangle": 3, "4-clique": 0, "bitriangle": 0, "butterfly": 3}


def test_window_and_order_edges(spark):
    base = [(0, 1, 0, "a"), (1, 2, 1, "a"), (2, 0, 3, "a")]
    te = frame(spark, {1: base, 2: [(u, v, min(t, 1), op) for u, v, t, op in base], 3: base + base, 4: base + [(0, 1, 1, "d")], 5: [(0, 1, 2, "d")], 6: [(1, 1, 0, "a")]})
    assert {r[0]: r[1] for r in motifs.count(te, "triangle").collect()} == {1: 1, 3: 1, 4: 1}  # ties never chain, copies count once, deletes are ignored
    assert motifs.count(te, "triangle", window_op="lt").count() == 0  # the span is exactly the window
    assert {r[0] for r in motifs.count(te, "triangle", window=0).collect()} == {1, 3, 4}
    assert {r[0]: r[1] for r in motifs.judge(te, "triangle").collect()} == {1: "Yes", 2: "No", 3: "Yes", 4: "Yes", 5: "No", 6: "No"}
    assert {r[0]: r[1] for r in motifs.first_time(te, "triangle", compat=True).collect()} == {1: 3, 2: motifs.NO_INSTANCE, 3: 3, 4: 3, 5: 0, 6: motifs.NO_INSTANCE}


def test_identity_needs_the_motifs_own_nodes(spark):
    own, other = [(0, 1, 0, "a"), (1, 2, 1, "a"), (2, 0, 2, "a")], [(5, 6, 0, "a"), (6, 7, 1, "a"), (7, 5, 2, "a")]
    got = {r[0]: r[1] for r in motifs.judge(frame(spark, {1: own, 2: other}), "triangle", window_op="lt", identity=True).collect()}
    assert got == {1: "Yes", 2: "No"}


def test_butterfly_is_four_cycle_and_relabelling(spark, graphs):
    te = frame(spark, graphs)
    assert sorted(motifs.count(te, "butterfly").collect()) == sorted(motifs.count(te, "4-cycle").collect())
    moved = te.withColumn("u", 50 - F.col("u")).withColumn("v", 50 - F.col("v")).withColumn("t", F.col("t") + 7)
    assert sorted(motifs.count(moved, "4-path").collect()) == sorted(motifs.count(te, "4-path").collect())


def test_modify_makes_the_motif(spark, graphs):
    te = frame(spark, graphs)
    for motif in ("triangle", "4-path", "4-cycle"):
        best = motifs.modify(te, motif)
        assert best.count()
        made = te.select("graph_id", "u", "v", "t", "op").unionByName(best.select("graph_id", F.col("lo").alias("u"), F.col("hi").alias("v"), F.col("t_add").alias("t"), F.lit("a").alias("op")))
        yes = {r[0] for r in motifs.judge(made, motif).where("answer = 'Yes'").collect()}
        assert {r[0] for r in best.collect()} <= yes


def test_few_shot_modifications(spark):
    """A labelled edge completes its motif."""
    te = frame(spark, {1: [(0, 1, 0, "a"), (1, 2, 1, "a"), (2, 3, 2, "a")]})
    got = {(r.lo, r.hi, r.t_add) for r in motifs.completions(te, "4-cycle").collect()}
    assert (0, 3, 3) in got


def test_user_motifs(spark, graphs):
    assert catalog.parse_motif([("u0", "u1", "t0", "a"), ("u1", "u2", "t1", "a")]) == [(0, 1), (1, 2)]
    edges = [(0, 1), (2, 3)]  # two loose pairs: the same events match in several ways
    assert loose_pair(edges)
    te = frame(spark, {g: graphs[g] for g in (3, 4)})
    got = {r[0]: r[1] for r in planned(prepare(te), edges, 4).groupBy("graph_id").count().collect()}
    assert got == {g: n for g in (3, 4) if (n := len(instances(graphs[g], edges, 4)))}


def test_no_events(spark):
    te = spark.createDataFrame([], EVENTS)
    assert motifs.count(te, "bitriangle").count() == 0 and motifs.judge(te, "triangle").count() == 0 and motifs.modify(te, "4-path").count() == 0


def test_large_graphs_and_pruning(spark):
    """Without a partitioning by graph, and without graphs that are too small, the counts are the same; rows with nulls go."""
    from chronomotif.operators import features
    from chronomotif.plans.motif import large_enough, prepare
    from chronomotif.sources.events import temporal_edges

    te = temporal_edges(spark, "/root/testdata/sf0.001")
    odd = te.unionByName(spark.createDataFrame([(None, 0, 1, 2, 3, "a"), (1, 0, 1, 2, None, "a"), (1, 0, None, 2, 3, "a")], te.schema))
    for motif in ("triangle", "4-cycle"):
        want = sorted(map(tuple, motifs.count(te, motif).collect()))
        assert sorted(map(tuple, motifs.count(te, motif, p=prepare(te, large_graphs=True)).collect())) == want
        assert sorted(map(tuple, motifs.count(te, motif, prune=True).collect())) == want
        assert sorted(map(tuple, motifs.count(odd, motif).collect())) == want
    small = spark.createDataFrame([(1, 0, 0, 1, 0, "a"), (1, 1, 1, 2, 1, "a"), (2, 0, 0, 1, 0, "a"), (2, 1, 1, 2, 1, "a"), (2, 2, 2, 0, 2, "a")], te.schema)
    assert [r.graph_id for r in large_enough(prepare(small), [(0, 1), (1, 2), (2, 0)]).collect()] == [2]
    assert sorted(map(tuple, features.components(te, large_graphs=True).collect())) == sorted(map(tuple, features.components(te).collect()))


def hub_log(spark, n, per, nodes, graph_id=1, seed=1):
    """``n`` events, ``per`` a time step, half of them at node 0, spread over the others by a hash."""
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed * 10 + k)), F.lit(m)).cast("int")
    return spark.range(n).select(F.lit(graph_id).cast("bigint").alias("graph_id"), F.col("id").cast("int").alias("seq"), F.when(draw(1, 2) == 0, 0).otherwise(draw(2, nodes)).alias("u"), (draw(3, nodes - 1) + 1).alias("v"), F.floor(F.col("id") / per).cast("int").alias("t"), F.lit("a").alias("op"))


@pytest.mark.parametrize("mode", ["induced", "monomorphism"])
def test_summed_and_first_plans_match_brute_force(spark, graphs, mode):
    te, op = frame(spark, graphs), "le" if mode == "induced" else "lt"
    want = {m: {g: found for g, e in graphs.items() if (found := instances(e, catalog.EDGES[m], catalog.WINDOWS["default"][m], op == "lt", mode == "induced"))} for m in catalog.NAMES}
    rows = motifs.multi_count(te, mode=mode, window_op=op).collect()
    assert {(r.graph_id, r.motif_name): r.n_instances for r in rows} == {(g, m): len(x) for m in want for g, x in want[m].items()}
    times = motifs.multi_first_time(te, mode=mode, window_op=op).collect()
    assert {(r.graph_id, r.motif_name): r.first_time for r in times} == {(g, m): min(max(t for _, _, t in i) for i in x) for m in want for g, x in want[m].items()}


@pytest.mark.parametrize(("motif", "options"), [("3-star", {"window": 5}), ("4-clique", {"mode": "monomorphism", "window_op": "lt"}), ("triangle", {"window": 0})])
def test_one_motif_in_every_plan(spark, graphs, motif, options):
    te = frame(spark, graphs)
    want = sorted(map(tuple, motifs.count(te, motif, **options).collect()))
    first = sorted(map(tuple, motifs.first_time(te, motif, **options).collect()))
    some = {"unit_events": 15, **options}  # graphs that fit, time bins, and bins that are too large
    assert sorted(map(tuple, motifs.count(te, motif, plan="summed", **some).collect())) == want
    assert sorted(map(tuple, motifs.count(te, motif, **some).collect())) == want
    assert sorted(map(tuple, motifs.first_time(te, motif, plan="first", **some).collect())) == first


def test_patterns_of_ones_own_share_a_plan(spark, graphs):
    te = frame(spark, graphs)
    own = {"wedge": ([(0, 1), (1, 2)], 4), "back": ([(0, 1), (1, 2), (1, 0)], 6), "apart": ([(0, 1), (2, 3)], 3), "square": (catalog.EDGES["4-cycle"], 0)}
    got = {(r.graph_id, r.motif_name): r.n_instances for r in motifs.multi_count(te, own).collect()}
    assert got == {(g, m): n for m, (edges, w) in own.items() for g, e in graphs.items() if (n := len(instances(e, edges, w)))}
    with pytest.raises(ValueError, match="connected"):
        motifs.count(te, [(0, 1), (2, 3)], plan="summed", window=3)


def test_nine_motifs_are_one_chain(spark, graphs):
    """Five joins by edge, twelve by absent edge, none for a single motif."""
    plan = motifs.multi_count(frame(spark, graphs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Left") + plan.count("Join Inner") <= 17


def test_summed_plan_has_fewer_rows(spark):
    """A pair that is connected again and again: instances are many more than open ends."""
    rows = [(1, 4 * t + k, k, (k + 1) % 4, t, "a") for t in range(120) for k in range(4)]
    te = spark.createDataFrame(rows, EVENTS)
    n = motifs.count(te, "4-cycle", window=60, mode="monomorphism").first().n_instances
    summed = motifs.count(te, "4-cycle", window=60, mode="monomorphism", plan="summed")
    assert summed.first().n_instances == n and n > 1_000_000
    judged = motifs.first_time(te, "4-cycle", window=60, mode="monomorphism", plan="first")

    def passed(df):
        """Rows out of each join of the plan that ran."""
        df.collect()
        plan, found = df._jdf.queryExecution().executedPlan(), []
        todo = [plan.executedPlan()]
        while todo:
            at = todo.pop()
            if "Join" in at.nodeName() and at.metrics().contains("numOutputRows"):
                found.append(at.metrics().apply("numOutputRows").value())
            if "QueryStage" in at.nodeName():
                todo.append(at.plan())
            todo += [at.children().apply(i) for i in range(at.children().size())]
        return sum(found)

    assert passed(summed) < n // 3 and passed(judged) < passed(summed)


def test_a_hub_over_a_long_log(spark):
    """A hub with 100 000 events: time bins, whose largest task has few of them, and the same counts as shorter logs put together."""
    from chronomotif.plans.motif import in_bins

    te = hub_log(spark, 100_000, 3, 300)
    p = in_bins(te, 3)
    assert p.directed.groupBy("graph_id", "bin").count().agg(F.max("count")).first()[0] < 60
    got = motifs.count(te, "triangle", unit_events=10_000).first().n_instances
    assert got == motifs.count(te, "triangle", plan="summed", unit_events=10_000).first().n_instances
    mono = lambda df, **options: sum(r.n_instances for r in motifs.count(df, "triangle", mode="monomorphism", **options).collect())
    width = 2_000  # instances inside pieces, and inside the pieces' seams, once
    pieces = te.withColumn("graph_id", F.floor(F.col("t") / width).cast("bigint"))
    seams = te.where(f"t % {width} < 3 or t % {width} >= {width - 3}").withColumn("graph_id", F.floor((F.col("t") + 3) / width).cast("bigint"))
    twice = seams.withColumn("graph_id", F.col("graph_id") * 2 + F.when(F.col("t") % width < 3, 1).otherwise(0))
    assert mono(te, unit_events=10_000) == mono(pieces) + mono(seams) - mono(twice)


def test_one_large_graph_among_small_ones(spark):
    """Measured routing: the same rows as every graph gets alone, in all forms, and components by either way."""
    from chronomotif.operators import features
    from chronomotif.plans.motif import routed
    from chronomotif.sources.events import temporal_edges

    small = temporal_edges(spark, "/root/testdata/sf0.001")
    te = small.unionByName(hub_log(spark, 3_000, 4, 80, graph_id=10_000)).unionByName(hub_log(spark, 900, 450, 60, graph_id=10_001, seed=2)).unionByName(hub_log(spark, 700, 4, 700, graph_id=10_002, seed=3))
    assert [p.binned for p in routed(te, 6, 300)] == [False, True, False] and len(routed(te, 6)) == len(routed(small, 6, 300)) == 1
    rows = lambda df: sorted(map(tuple, df.collect()))
    for motif in ("triangle", "4-tailedtriangle"):
        assert rows(motifs.count(te, motif, unit_events=300)) == rows(motifs.count(te, motif))
        assert rows(motifs.judge(te, motif, plan="first", unit_events=300)) == rows(motifs.judge(te, motif))
    some = te.where("graph_id > 20")
    assert rows(motifs.multi_count(some, ("triangle", "4-cycle", "4-path"), unit_events=300)) == rows(motifs.multi_count(some, ("triangle", "4-cycle", "4-path")))
    one = te.where("graph_id IN (1, 2, 3, 10001)")
    assert rows(motifs.modify(one, "triangle", unit_events=300)) == rows(motifs.modify(one, "triangle"))
    assert rows(features.profile(te, fold_edges=100)) == rows(features.profile(te))
    assert {r.graph_id for r in features.components(te, fold_edges=100).where("graph_id >= 10000").collect()} == {10_000, 10_001, 10_002}


def test_tasks_follow_the_log(spark, graphs, monkeypatch):
    """A log of many small graphs is dealt to as many tasks as its events need, whatever the session's number of partitions; branches of a union are tasks of their own."""
    from chronomotif.plans import motif as plans

    te = frame(spark, {g + 100 * k: e for k in range(10) for g, e in graphs.items()})
    want = sorted(map(tuple, motifs.completions(te, "4-cycle").collect()))
    monkeypatch.setattr(plans, "TASK_EVENTS", 200)
    n = te.where("op = 'a' and u <> v").count()
    (p,) = plans.routed(te, 6, 1000)
    assert p.directed.rdd.getNumPartitions() == p.static.rdd.getNumPartitions() == -(-n // 200) > 10
    got = motifs.completions(te, "4-cycle", unit_events=1000)
    assert got.rdd.getNumPartitions() == 4 * -(-n // 200)
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("name", ["score_multi_count", "score_first_time", "score_multi_judge", "parse_names", "parse_name_counts", "parse_name_times", "qa_multi_motif_judge", "qa_multi_motif_count", "qa_when_multi_motif_exist"])
def test_chains_of_questions_and_answers_shuffle_the_log_once(spark, monkeypatch, name):
    """No join of the chain deals its partial matches anew, and the scorers' truth is worked out once."""
    import re

    from chronomotif import answers, queries
    from chronomotif.sources.tables import cut

    plain = spark.newSession()
    plain.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen = []
    monkeypatch.setattr(answers, "cut", lambda df, *a: (seen.append(df), cut(df, *a))[1], raising=False)
    seen.append(queries.QUERIES[name](plain, "/root/testdata/sf0.001"))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert not [k for p in plans for k in re.findall(r"Exchange hashpartitioning\(([^)]*)", p) if re.search(r"\b(s|lo|f|n0|k)#", k)]
    assert len(plans) == 1 + name.startswith("score") and ("score" not in name or "Generate inline" not in plans[-1])


def test_sessions_keep_their_settings(spark):
    from chronomotif import queries
    from chronomotif.plans.motif import one_shuffle

    plain = spark.newSession()
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = plain.conf.get(key)
    queries.QUERIES["motif_count_triangle"](plain, "/root/testdata/sf0.001").count()
    assert plain.conf.get(key) == before == "true" and one_shuffle(plain).conf.get(key) == "false"


@pytest.mark.parametrize(("motif", "mode"), [("triangle", "induced"), ("4-path", "monomorphism")])
def test_counts_of_a_growing_log(spark, graphs, motif, mode):
    """Old count plus change equals a full count after each of five appends, events out of order and repeated ones among them."""
    from chronomotif.operators import increments
    from chronomotif.sources.tables import cut

    rng = random.Random(7)
    rows = [(g, i, *e) for g, events in graphs.items() for i, e in enumerate(events)]
    rng.shuffle(rows)
    parts = [rows[:150], *[rows[150 + 30 * k : 150 + 30 * (k + 1)] for k in range(4)], rows[270:] + rows[:20]]
    log = spark.createDataFrame(parts[0], EVENTS)
    counts = cut(motifs.count(log, motif, mode=mode))
    for part in parts[1:]:
        batch = spark.createDataFrame(part, EVENTS)
        counts = cut(increments.counts_after(counts, increments.count_change(log, batch, motif, mode=mode)))
        log = cut(log.unionByName(batch))
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, motifs.count(log, motif, mode=mode).collect()))
    assert counts.count()
