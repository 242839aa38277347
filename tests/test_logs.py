import pytest
from brute import EVENTS
from pyspark.sql import functions as F

from chronomotif.functions import parsing, text
from chronomotif.operators import features, generators, logs, motifs, scoring
from chronomotif.sources import json_files, providers
from chronomotif import tools


def frame(spark, events):
    return spark.createDataFrame([(1, i, *e) for i, e in enumerate(events)], EVENTS)


def test_edges_at_time(spark):
    log = [(0, 9, 0, "a"), (1, 9, 0, "a"), (2, 5, 0, "a"), (1, 2, 1, "a"), (2, 6, 1, "a"), (3, 7, 1, "a"), (1, 9, 2, "d"), (4, 5, 2, "a")]
    got = {(r.u, r.v, r.t) for r in logs.edges_at(frame(spark, log), 1).collect()}
    assert got == {e[:3] for e in log[:6]}
    assert (1, 9) not in {(r.u, r.v) for r in logs.edges_at(frame(spark, log), 2).collect()}


def test_ties_reversal_and_replay(spark):
    log = [(1, 2, 0, "a"), (1, 2, 1, "d"), (2, 3, 3, "a"), (0, 3, 4, "a"), (2, 3, 4, "d")]
    te = frame(spark, log)
    back = [(r.u, r.v, r.t, r.op) for r in logs.reverse_log(te).orderBy("pos").collect()]
    assert back == [(2, 3, 4, "a"), (0, 3, 4, "d"), (2, 3, 3, "d"), (1, 2, 1, "a"), (1, 2, 0, "d")]
    assert [r.is_empty for r in logs.replay_is_empty(te).collect()] == [False]
    both = te.unionByName(logs.reverse_log(te).drop("pos"))
    assert [r.is_empty for r in logs.replay_is_empty(both).collect()] == [True]
    same = frame(spark, [(0, 1, 2, "d"), (1, 0, 2, "a"), (0, 1, 5, "a")])  # a delete before any add; order decides at equal times
    assert [(r.u, r.v) for r in logs.edges_at(same, 3).collect()] == [(1, 0)]
    assert [(r.t, r.n_alive) for r in logs.snapshots(same).orderBy("t").collect()] == [(2, 1), (5, 1)]


def test_first_link_rules(spark):
    te = frame(spark, [(0, 5, 1, "d"), (5, 0, 2, "a"), (0, 5, 3, "a"), (0, 5, 6, "d")])
    assert {(r.u, r.v): (r.first_add, r.first_delete) for r in logs.first_link_unlink(te).collect()} == {(0, 5): (3, 1), (5, 0): (2, None)}
    assert [(r.first_add, r.first_delete) for r in logs.first_link_unlink_after(te).collect()] == [(2, 6)]


def test_profile(spark):
    te = spark.createDataFrame([(1, 0, 0, 1, 0, "a"), (1, 1, 0, 2, 0, "a"), (1, 2, 0, 3, 1, "a"), (1, 3, 4, 5, 1, "a"), (2, 0, 1, 2, 0, "d")], EVENTS)
    rows = {r.graph_id: r.asDict() for r in features.profile(te).collect()}
    assert rows[1]["num_nodes"] == 6 and rows[1]["cyclomatic_complexity"] == 0 and rows[1]["num_nodes_ge_3"] == 1 and rows[1]["temporal_clash_count"] == 1
    assert abs(rows[1]["edge_locality_score"] - (2 / 3) ** 0.5) < 1e-5
    assert rows[2]["cyclomatic_complexity"] == 1 and rows[2]["num_nodes"] == 0


def test_parsers(spark):
    df = spark.createDataFrame([("I say Yes, not no. Answer: (1, 2, 3, a), ['u4','u5','t6','d']", "{ 'u': 3, ' v ': 4 }")], "r string, j string")
    r = df.select(parsing.yes_no(F.col("r")).alias("y"), parsing.quads(parsing.after(F.col("r"))).alias("q"), parsing.tool_input(F.col("j")).alias("m")).first()
    assert r.y == "yes" and [tuple(x) for x in r.q] == [(1, 2, 3, "a"), (4, 5, 6, "d")] and r.m == {"u": "3", "v": "4"}


A, B = (1, 2, 3, "a"), (4, 5, 6, "d")


@pytest.mark.parametrize(
    ("parser", "cases"),
    [
        (parsing.quads_sorted, {"[(1, 2, 3, a)] then [(4, 5, 6, 'd')]": [B], "[(1 2 3 a)]": [A], "[1, 2, 3, a; 4, 5, 6, d]": [A, B], "(1, 2, 3, a)": [], "[(1, 2, 3, a), (1,2,3,a)]": [A, A], "none": []}),
        (lambda r: parsing.quads_sorted(r, True), {'[[1, 2, 3, "a"], [4, 5, 6, "d"]]': [A, B], "[1, 2, 3, a]": [A], "[1, 2, 3, 'a']": [A], "(1, 2, 3, a)": []}),
        (parsing.quads_set, {"Answer: (4, 5, 6, d)\n\n(1, 2, 3, a) (1, 2, 3, a)\n\n  ": [A], "The answer is: (1, 2, 3, a) The answer is: (4, 5, 6, d)": [B], "(1, 2, 3, a)": [A], "Answer: [1, 2, 3, a]": [], "Final answer: (1, 2, 3, a) Answer: none": []}),
        (parsing.quads_reversed, {"Answer: [[1, 2, 3, a], [4, 5, 6, 'd']]": [A, B], "(1, 2, 3, a) Answer: no": [A], "Answer: (4, 5, 6, d) or (1, 2, 3, a)": [B, A], "[1, 2, 3, a]": [], "[[1, 2, 3, a]] Answer: (4, 5, 6, d)": [B]}),
        (parsing.quads_answer, {"Answer: [(1, 2, 3, a)] (4, 5, 6, d)": [A], "Answer: [1, 2, 3, a]": [], "[1, 2, 3, a]": [A], "[1, 2, 3, a] (4, 5, 6, d)": [B], "Answer: (4, 5, 6, d)": [B], "Answer: none": []}),
    ],
)
def test_event_parsers(spark, parser, cases):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, r string").select("i", parser(F.col("r")).alias("q"))
    assert {r.i: [tuple(x) for x in r.q] for r in df.collect()} == dict(enumerate(cases.values()))


def test_name_parsers(spark):
    def run(parser, *texts):
        return [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, r string").select("i", parser(F.col("r")).alias("x")).orderBy("i").collect()]

    assert run(parsing.names, "Answer: Triangle, '3-star'. square", "triangle", "Answer: " + "triangle " * 30, "Answer:\n4-path\n(4-path)") == [["3-star", "triangle"], None, None, ["4-path"]]
    counts = run(parsing.name_counts, 'Answer: [("Triangle", 2), ["4-cycle", 3.7]]', "Answer: [(triangle, 2)]", "Answer: ```python\n[('x', 1)]\n``` [", 'Answer: [("a", 1)] yes', "Answer: []", '[("a", 1)]', "Answer: __import__('os')")
    assert [None if x is None else [tuple(p) for p in x] for x in counts] == [[("triangle", 2), ("4-cycle", 3)], None, [("x", 1)], None, [], None, None]
    times = run(parsing.name_times, "Answer: [('triangle', 2)]", "Answer:\n(triangle, 2)\n- 4-cycle: 5\n**3-star**: 7\n\"4-path\", 1\n\"x\": 3\ny: 4", "```\n[['a', 1]]\n``` Answer: 3", "Answer: <p>(a, 1)</p>", "Answer:", "nothing", "Answer: **a:** 4")
    assert [None if x is None else [tuple(p) for p in x] for x in times] == [[("triangle", 2)], [("triangle", 2), ("4-cycle", 5), ("3-star", 7), ("4-path", 1), ("x", 3)], [("a", 1)], [("a", 1)], None, None, []]


def test_two_ints_of_all_forms(spark):
    forms = [
        r"\boxed{2}, \boxed{5}", "nodes are first connected at time \\boxed{2} in 9 and disconnected at time \\boxed{5}", "First connection: 2\nFirst disconnection: 5", "first connection time: 2, 7 steps, first disconnection time: 5",
        "Nodes first connect at time 2 and disconnect at time 5", "connect time: 2\ndisconnect time: 5", "nodes are first connected at time 2 and disconnected at time 5", "**First Connected**: \\boxed{2}\n**First Disconnected**: \\boxed{5}",
        "first connected at t=2 (0, 7), first disconnected at t=5", "- first connected at time 2 (0, 7)\n- first disconnected at time 5", "2, 5. From (0, 7)", "**Answer:** 2, 5", "first connection: 2; first disconnect: 5", "The pair (0, 7) gives the times\n2, 5",
        "nodes first connect at time `2` and disconnect at time `5`", "nodes are first connected at timestamp 2, then disconnected at timestamp 5", "first connected at time `t = 2`, first disconnected at time `t = 5`",
    ]
    df = spark.createDataFrame([(i, "(3, 4) Answer: " + x) for i, x in enumerate(forms)], "i int, r string").select("i", parsing.two_ints(F.col("r")).alias("n"))
    assert {r.i: r.n for r in df.collect()} == dict.fromkeys(range(len(forms)), [2, 5])
    one = lambda s, agent=False: spark.createDataFrame([(s,)], "r string").select(parsing.two_ints(F.col("r"), agent)).first()[0]
    assert one("2, 5") is None and one("Answer: [2, 5]") is None and one("Answer: nodes (0, 7) are first connected at time 2 and disconnected at time 5") is None and one("Answer: soon") is None and one("[2, 5]", True) == [2, 5] and one("2, 5", True) == [2, 5]


def test_scores(spark):
    te = frame(spark, [(0, 1, 2, "a"), (1, 2, 1, "a")])
    said = lambda s: spark.createDataFrame([(1, s)], "graph_id bigint, response string")
    metric = lambda df: df.first().metric
    assert metric(scoring.score_sort(te, said("Answer: [(1, 2, 1, a), (0, 1, 2, a)]"))) == 1
    assert metric(scoring.score_sort(te, said("[(0, 1, 2, a), (1, 2, 1, a)]"))) == -1
    assert metric(scoring.score_sort(te, said("[(0, 1, 2, a)]"))) == -2
    assert metric(scoring.score_sort(te, said("?"))) == -3
    truth = spark.createDataFrame([(1, "4-cycle,triangle")], "graph_id bigint, motifs string")
    assert metric(scoring.score_multi_judge(truth, said("Answer: [triangle, 4-clique, square]"))) == 0
    assert metric(scoring.score_multi_judge(truth, said("Answer: 3-star 4-clique"))) == -1
    counts = spark.createDataFrame([(1, "triangle", 4), (1, "4-cycle", 2)], "graph_id bigint, motif_name string, n_instances bigint")
    assert metric(scoring.score_multi_count(counts, said('Answer: [["triangle", 2], ["4-cycle", 3]]'))) == 0.25
    assert metric(scoring.score_multi_count(counts, said("no"))) == -1


def test_generators(spark):
    params = generators.param_grid(spark, [15], [12], [0.3], 30)
    plain = params.select("graph_id", "T", "N", "p")
    te = generators.contain_positive(plain, "4-cycle", 20)
    assert motifs.judge(te, "4-cycle", which="contain").where("answer = 'No'").count() == 0
    without = generators.contain_negative(plain, "triangle", 18).persist()
    assert motifs.judge(without, "triangle", which="contain").where("answer = 'Yes'").count() == 0
    assert {(r.n, r.a) for r in without.groupBy("graph_id").agg(F.count("*").alias("n"), F.count_if(F.col("op") == "a").alias("a")).collect()} == {(18, 12)}
    assert without.select("graph_id").distinct().count() == plain.count()
    with pytest.raises(ValueError, match="attempts"):
        generators.contain_negative(plain.withColumn("N", F.lit(3)).withColumn("T", F.lit(4)), "triangle", 4, rounds=1, at_once=1).count()
    log, answers = generators.modify_task(plain, "triangle", 8)
    assert 0 < answers.count() == log.select("graph_id").distinct().count()
    assert scoring.score_modify(log, answers.select("graph_id", F.format_string("Answer: (%d, %d, %d, a)", "u", "v", "t").alias("response")), "triangle").where("metric = 1").count() == answers.count()
    both = {r[0] for r in motifs.judge(generators.is_motif_task(plain, "triangle"), "triangle", window=15, window_op="lt", identity=True).select("answer").collect()}
    assert both == {"Yes", "No"}
    assert sorted(generators.er_events(plain).collect()) == sorted(generators.er_events(plain.repartition(3)).collect())


def test_generator_dispatch(spark):
    grid = generators.param_grid(spark, [15], [14], [12.0], 30)
    log = generators.dispatch(grid, "judge_contain_motif", "4-path")
    yes = {r.graph_id: r.answer for r in motifs.judge(log, "4-path", which="contain").collect()}
    assert {(r.seed % 2, yes[r.graph_id]) for r in grid.collect()} == {(0, "Yes"), (1, "No")}
    few = grid.withColumn("p", F.lit(0.3))
    assert generators.dispatch(few, "judge_contain_motif", "4-path").exceptAll(generators.er_events(few)).isEmpty()
    cases = {r.assignment_case for r in generators.is_motif_task(grid, "4-cycle", cases=True).collect()}
    assert cases == {1, 2, 3, 4}
    log = generators.is_motif_task(grid, "4-cycle").where("op = 'a'").join(generators.is_motif_task(grid, "4-cycle", cases=True), "graph_id").toPandas()
    spans = log.groupby(["graph_id", "assignment_case"]).t.agg(lambda t: t.max() - t.min()).reset_index()
    assert spans[spans.assignment_case.isin([1, 3])].t.max() < 15 < spans[spans.assignment_case == 2].t.min()
    judged = {r.graph_id: r.answer for r in motifs.judge(log_of(spark, log), "4-cycle", window=15).collect()}
    assert all(judged[g] == "Yes" for g in log[log.assignment_case == 1].graph_id) and all(judged[g] == "No" for g in log[log.assignment_case == 2].graph_id)
    kept = generators.first_seeds(generators.param_grid(spark, [5, 6], [3], [0.3], 30), generators.er_events(generators.param_grid(spark, [5, 6], [3], [0.3], 30)), 4)
    assert {(r.T, r["count"]) for r in kept.groupBy("T").count().collect()} == {(5, 4), (6, 4)} and max(r.seed for r in kept.collect()) > 3


def test_yes_no_between_other_letters(spark):
    """As DuckDB reads them: letters beyond ASCII end a word."""
    import duckdb

    texts = ["noñdo yes", "yesóasga no", "éno yes", "\u0130no yes", "e\u0301no yes", "año noño", "no_yes", "no1 yes", "knows nothing", "NO\u00a0yes", None, ""]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(parsing.yes_no(F.col("x"))).collect()]
    want = [duckdb.execute(r"SELECT nullif(regexp_extract(lower(trim(?)), '\b(yes|no)\b', 1), '')", [x]).fetchall()[0][0] for x in texts]
    assert got == want and got[:5] == ["no", "yes", "no", "yes", "no"]


@pytest.mark.parametrize("name", ["contain_negative", "modify_task"])
def test_generated_logs_are_never_broadcast(spark, monkeypatch, name):
    """Spark takes a log for as small as the parameters that it explodes from; neither the plans of the tables nor that of the result may send one through the driver."""
    from chronomotif.sources.tables import cut

    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(generators, "cut", lambda df, *a: (plans.append(plan(df)), cut(df, *a))[1])
    params = generators.param_grid(spark, [15], [12], [0.3], 10).select("graph_id", "T", "N", "p")
    made = generators.contain_negative(params, "4-path", 12) if name == "contain_negative" else generators.modify_task(params, "4-cycle", 10)[0]
    plans.append(plan(made))
    assert len(plans) >= 4 and made.select("graph_id").distinct().count() == 10
    assert not any("Broadcast" in p for p in plans[1:]), [p for p in plans[1:] if "Broadcast" in p][0]


def test_component_labels_are_never_broadcast(spark, monkeypatch):
    """A pass's table has far smaller files than a broadcast of it; no pass may send one through the driver, and long ways and several graphs come out right."""
    from chronomotif.sources.tables import cut

    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(features, "cut", lambda df, *a: (plans.append(plan(df)), cut(df, *a))[1])
    way = [(1, i, 2 * i, 2 * i + 2, i, "a") for i in range(20)]  # even nodes in a line
    ring = [(1, 20 + i, 2 * i + 1, (2 * i + 3) % 20, i, "a") for i in range(10)]  # odd nodes
    te = spark.createDataFrame(way + ring + [(1, 30, 100, 101, 0, "a"), (1, 31, 101, 40, 0, "d"), (2, 0, 7, 3, 0, "a"), (2, 1, 5, 5, 0, "a")], EVENTS)
    labels = features.component_labels(te)
    plans.append(plan(labels))
    want = {(1, n): 0 for n in range(0, 41, 2)} | {(1, n): 1 for n in range(1, 20, 2)} | {(1, 100): 100, (1, 101): 100, (2, 3): 3, (2, 7): 3}
    assert sorted(map(tuple, labels.collect())) == sorted((g, n, root) for (g, n), root in want.items())
    assert len(plans) >= 6 and not any("Broadcast" in p for p in plans), [p for p in plans if "Broadcast" in p][0]


def test_label_passes_leave_no_shuffle_files(spark):
    """A pass's shuffle files go with the pass, without a collection of the driver's garbage; the session keeps its settings."""
    import re
    import time

    def kept():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return set(re.findall(r"shuffle_\d+", files))

    te = spark.createDataFrame([(1, i, i, i + 1, i, "a") for i in range(40)], EVENTS)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), kept()
    labels = features.component_labels(te)
    for _ in range(50):  # executors delete them in their own time
        if kept() <= before:
            break
        time.sleep(0.2)
    assert kept() <= before
    assert spark.conf.get(key) == setting and {r.root for r in labels.collect()} == {0}


def log_of(spark, frame):
    return spark.createDataFrame(frame[["graph_id", "seq", "u", "v", "t", "op"]])


def test_generated_graphs_have_all_events(spark):
    params = generators.param_grid(spark, [15], [20], [0.3], 40).select("graph_id", "T", "N", "p")
    pos = generators.contain_positive(params, "triangle", 20).groupBy("graph_id").agg(F.count("*").alias("n"), F.count_if(F.col("op") == "d").alias("d"), F.max("t").alias("t")).collect()
    assert {(r.n, r.d) for r in pos} == {(20, 6)} and max(r.t for r in pos) < 15 and len(pos) == 40
    log = generators.modify_task(params, "4-cycle", 10)[0].toPandas()
    assert set(log.groupby("graph_id").size()) == {10} and 0.2 < (log.op == "d").mean() < 0.5
    for _, one in log.groupby("graph_id"):
        adds = one[one.op == "a"].groupby(["u", "v"]).size()
        assert all(n <= adds.get((min(e), max(e)), 0) + adds.get((max(e), min(e)), 0) for e, n in one[one.op == "d"].groupby(["u", "v"]).size().items())
    parts = generators.is_motif_task(params, "4-cycle").toPandas()
    deletes = (parts.op == "d").sum()
    assert (parts.op == "a").sum() == 160 and 40 < deletes < 120 and parts.t.max() < 30


def test_tools(spark):
    rows = [(1, "{'edge_list': [(0, 1, 0, a), (1, 2, 1, a), (2, 0, 2, a), (0, 1, 5, d)], 'motif_list': ['triangle'], 'u': 0, 'v': 1, 'time_point': 1}")]
    inputs = spark.createDataFrame(rows, "id bigint, input string")
    got = {name: tools.call(name, inputs).first().result for name in tools.TOOLS}
    assert got["Judge_Is_Contain_Motif"] == '{"answer":"Yes"}' and got["Detect_Motifs_Counts"] == '{"triangle":1}' and got["Detect_Motifs_First_Time"] == '{"triangle":2}'
    assert got["Detect_First_Connected_And_Disconnected_Time"] == "[0,5]" and got["Detect_Edges_Existence_At_Time"] == '[["0","1","0","a"],["1","2","1","a"]]'
    assert got["Reverse_Dynamic_Graph"].startswith('[["0","1","5","a"]')


def test_json_and_providers(spark, tmp_path):
    folder = tmp_path / "T5_N3"
    folder.mkdir()
    (folder / "graph.json").write_text('{"edge_index": [[0, 1, 0, "a"], [1, 2, "x", "a"], [1, 2, 3, "d"]], "T": 5, "N": 3, "p": 0.3}')
    (tmp_path / "bad.json").write_text("{nothing")
    te = json_files.events_of(json_files.read_graphs(spark, str(tmp_path)))
    assert [(r.folder, r.seq, r.u, r.v, r.t, r.op) for r in te.orderBy("seq").collect()] == [("T5_N3", 0, 0, 1, 0, "a"), ("T5_N3", 2, 1, 2, 3, "d")]
    asked = text.prompts(te, "sort_edge")
    assert "(0, 1, 0, a)" in asked.first().prompt
    assert providers.answers(asked, providers.constant("Answer: yes")).first().content == "Answer: yes"


def test_lists_results_and_logs(spark, tmp_path):
    rows = spark.createDataFrame([(f"T5_N3_p0.3_seed{i}", i) for i in range(40)], "folder string, place int")
    json_files.write_instances(rows.repartition(4), str(tmp_path / "list"))
    back = json_files.read_instances(spark, str(tmp_path / "list"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "results.json").write_text('{"task": "sort_edge", "correct_rate": 0.5,\n "error_folders": ["T5_N3_p0.3_seed2"], "failure_folders": ["T5_N3_p0.3_seed4", "T5_N3_p0.3_seed39"]}')
    (tmp_path / "broken.json").write_text("{nothing")
    results = json_files.read_results(spark, str(tmp_path / "*.json"))
    assert results.count() == 1
    flags = {r.folder: r.flag for r in json_files.flagged(back, results).collect()}
    assert len(flags) == 30 and {f for f, x in flags.items() if not x} == {"T5_N3_p0.3_seed2", "T5_N3_p0.3_seed4"}
    for _ in range(2):
        json_files.append_log(rows.limit(3), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    json_files.write_settings(spark, {"T": [5], "model": "x"}, str(tmp_path / "args"))
    assert spark.read.json(str(tmp_path / "args")).first().model == "x"


def test_router_on_held_out_graphs(spark, tmp_path):
    """Trained on scored answers of other graphs; the stored trees decide like Spark's own model does."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from chronomotif.operators import routing
    from chronomotif.sources.events import temporal_edges
    from chronomotif.sources.tables import cut

    table = cut(routing.labelled(temporal_edges(spark, "/root/testdata/sf0.1").where("graph_id < 1500")), "router-test")
    own, held = table.where("NOT held_out"), table.where("held_out")
    assert own.count() > 900 and held.count() > 200 and own.join(held, "graph_id").count() == 0
    nodes = routing.train(own)
    routing.store(nodes, spark, str(tmp_path / "trees"))
    assert routing.load(spark, str(tmp_path / "trees")) == sorted(nodes)
    got = routing.predict(nodes, held).join(held.select("graph_id", "label"), "graph_id").toPandas()
    yes, no = got[got.label == 1].probability, got[got.label == 0].probability
    assert sum((x > no).mean() + 0.5 * (x == no).mean() for x in yes) / len(yes) > 0.53  # ranks unseen graphs better than chance
    vectors = VectorAssembler(inputCols=routing.FEATURES, outputCol="_x")
    model = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=5, maxDepth=3, seed=7).fit(vectors.transform(own))
    want = {r.graph_id: r.probability[1] for r in model.transform(vectors.transform(held)).collect()}
    assert all(abs(r.probability - want[r.graph_id]) < 1e-9 and r.predicted == (r.probability > 0.5) for r in got.itertuples())
    assert routing.predict([], held.limit(3)).where("predicted").count() == 0


def test_seeds_until_enough(spark):
    """In rounds that try what a cell lacks: the rows that all seeds would have given, with fewer of them generated."""
    cells = spark.createDataFrame([(9, 6, 0.3)], "T int, N int, p double")
    asked = []

    def make(params):
        asked.append(params.count())
        return generators.is_motif_task(params, "triangle").where(F.col("graph_id") % 3 != 0)  # a generator that fails for a third of the seeds

    got, frontier = generators.seeded(cells, make, 4)
    grid = generators.param_grid(spark, [9], [6], [0.3], 30)
    logs = generators.is_motif_task(grid, "triangle").where(F.col("graph_id") % 3 != 0)
    first = generators.first_seeds(grid, logs, 4)
    want = logs.join(first, "graph_id", "left_semi")
    rows = lambda df: sorted(map(tuple, df.select("graph_id", "seq", "u", "v", "t", "op").collect()))
    assert rows(got) == rows(want) and got.count()
    assert {(r.N, r.have) for r in frontier.collect()} == {(6, 4)}
    assert sum(asked) < 20 and sum(asked) == frontier.groupBy().sum("next").first()[0]
    assert generators.seeded(cells.limit(0), make, 4)[0].count() == 0
