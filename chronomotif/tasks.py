"""The ten tasks, each with its question and answer rows and its scorer; runs over them: what is left to do, averages, results.

A task's rows are (graph_id, task, context, query, answer): the log, what is asked and the truth, as JSON text. Everything is a
plan over all graphs at once; results join instances, questions, answers and graphs by graph_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomotif import answers
from chronomotif.functions import text
from chronomotif.operators import logs, motifs, scoring
from chronomotif.plans import catalog
from chronomotif.plans.motif import DIRECTED_SQL, instances_sql, one_shuffle
from chronomotif.sources import providers
from chronomotif.sources.events import EDGES_SQL, temporal_edges


def _quads(e: Column) -> Column:
    return F.transform(e, lambda q: F.array(q["u"].cast("string"), q["v"].cast("string"), q["t"].cast("string"), q["op"]))


def contexts(te: DataFrame, order: str = "seq") -> DataFrame:
    """(graph_id, context): the log as JSON lists of four texts, in the order of a column."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), "u", "v", "t", "op")))
    return te.groupBy("graph_id").agg(F.to_json(_quads(listed)).alias("context"))


def motif_query(motif: str, window: int) -> str:
    """JSON of a motif's events, its numbers of nodes and edges with the window, and its name."""
    edges = catalog.EDGES[motif]
    events = ",".join(f'["u{a}","u{b}","t{i}","a"]' for i, (a, b) in enumerate(edges))
    return f'[[{events}],[{catalog.n_nodes(edges)},{len(edges)},{window}],["{motif}"]]'


def picked_time(te: DataFrame, seed: int = 0) -> DataFrame:
    """(graph_id, t): one of each log's times, by a hash."""
    return logs.pick(te.select("graph_id", "t").distinct(), ["t"], seed)


def judged_within(te: DataFrame, motif: str, windows: DataFrame, identity: bool = True) -> DataFrame:
    """(graph_id, answer) where each graph has its own window (graph_id, window): the span stays below it; 0 and less: any."""
    edges = catalog.EDGES[motif]
    df = motifs.found(te, motif, window=0, identity=identity).join(windows, "graph_id")
    yes = df.where((F.col("window") <= 0) | (F.col(f"t{len(edges) - 1}") - F.col("t0") < F.col("window"))).select("graph_id").distinct().withColumn("_y", F.lit(True))
    return motifs.graphs(te).join(yes, "graph_id", "left").select("graph_id", F.when(F.col("_y"), "Yes").otherwise("No").alias("answer"))


def _what(te: DataFrame, **_) -> DataFrame:
    """The edges alive at a picked time of each log."""
    at = picked_time(te).withColumnRenamed("t", "at")
    alive = logs.edges_at(te.join(at, "graph_id"), F.col("at"))
    listed = alive.groupBy("graph_id").agg(F.to_json(_quads(F.array_sort(F.collect_list(F.struct("t", "u", "v", "op"))))).alias("answer"))
    return at.join(listed, "graph_id", "left").select("graph_id", F.col("at").cast("string").alias("query"), F.coalesce("answer", F.lit("[]")).alias("answer"))


def _link(te: DataFrame, **_) -> DataFrame:
    picked = logs.pick(logs.first_link_unlink_after(te), ["lo", "hi", "first_add", "first_delete"])
    return picked.select("graph_id", F.to_json(F.array("lo", "hi")).alias("query"), F.to_json(F.array("first_add", "first_delete")).alias("answer"))


def _judged(which: str, **options) -> Callable:
    def qa(te: DataFrame, motif: str) -> DataFrame:
        query = F.lit(motif_query(motif, catalog.WINDOWS[which][motif])).alias("query")
        return motifs.judge(te, motif, which=which, **options).select("graph_id", query, "answer")

    return qa


def _listed(rows: DataFrame, te: DataFrame, item: Column) -> DataFrame:
    """One JSON list a graph of items by catalog order; empty for graphs without any."""
    at = F.array_position(F.array(*[F.lit(m) for m in catalog.NAMES]), F.col("motif_name"))
    made = rows.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), item.alias("x")))).alias("xs"))
    text = F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["x"]), ","), F.lit("]"))
    return motifs.graphs(te).join(made.select("graph_id", text.alias("answer")), "graph_id", "left").select("graph_id", F.lit(None).cast("string").alias("query"), F.coalesce("answer", F.lit("[]")).alias("answer"))


def _pair(value: str) -> Column:
    return F.concat(F.lit('["'), "motif_name", F.lit('",'), F.col(value).cast("string"), F.lit("]"))


def _names(te: DataFrame, **_) -> DataFrame:
    rows = motifs.multi_first_time(te, window_op="lt")
    return _listed(rows, te, F.concat(F.lit('"'), "motif_name", F.lit('"')))


def _nothing(answer: str | None) -> Callable:
    return lambda te, **_: motifs.graphs(te).select("graph_id", F.lit(None).cast("string").alias("query"), F.lit(answer).cast("string").alias("answer"))


@dataclass(frozen=True)
class Task:
    """``qa`` gives (graph_id, query, answer) of logs, with ``motif`` where the task has one; ``score`` (te, responses, **) their metrics."""

    name: str
    qa: Callable[..., DataFrame]
    score: Callable[..., DataFrame]
    shuffled: bool = False

    def rows(self, te: DataFrame, **options) -> DataFrame:
        """(graph_id, task, context, query, answer)."""
        context = contexts(logs.shuffled(te), "pos") if self.shuffled else contexts(te)
        return context.join(self.qa(te, **options), "graph_id").select("graph_id", F.lit(self.name).alias("task"), "context", "query", "answer")


def _modify_rows(te: DataFrame, motif: str) -> DataFrame:
    """The answer is left empty: any change that completes the motif is right."""
    return motifs.graphs(te).select("graph_id", F.lit(motif_query(motif, catalog.WINDOWS["default"][motif])).alias("query"), F.lit("[]").alias("answer"))


def _score_what(te: DataFrame, responses: DataFrame, **_) -> DataFrame:
    return scoring.score_set(logs.edges_at(te.join(picked_time(te).withColumnRenamed("t", "at"), "graph_id"), F.col("at")), responses)


def _score_link(te: DataFrame, responses: DataFrame, agent: bool = False, **_) -> DataFrame:
    return scoring.score_link(logs.pick(logs.first_link_unlink_after(te), ["lo", "hi", "first_add", "first_delete"]), responses, agent)


TASKS: dict[str, Task] = {
    t.name: t
    for t in (
        Task("sort_edge", _nothing("[]"), lambda te, responses, agent=False, **_: scoring.score_sort(te, responses, agent), shuffled=True),
        Task("what_edges", _what, _score_what),
        Task("when_link_and_dislink", _link, _score_link),
        Task("reverse_graph", _nothing(None), lambda te, responses, **_: scoring.score_reverse(te, responses)),
        Task("judge_contain_motif", _judged("contain"), lambda te, responses, motif, **_: scoring.score_yes_no(motifs.judge(te, motif, which="contain"), responses)),
        Task("judge_is_motif", _judged("default", window_op="lt", identity=True), lambda te, responses, motif, **_: scoring.score_yes_no(motifs.judge(te, motif, window_op="lt", identity=True), responses)),
        Task("modify_motif", _modify_rows, lambda te, responses, motif, window=None, **_: scoring.score_modify(te, responses, motif, window)),
        Task("multi_motif_judge", _names, lambda te, responses, agent=False, **_: scoring.score_multi_judge(motifs.multi_judge(te), responses, agent)),
        Task("multi_motif_count", lambda te, **_: _listed(motifs.multi_count(te), te, _pair("n_instances")), lambda te, responses, agent=False, **_: scoring.score_multi_count(motifs.multi_count(te), responses, agent)),
        Task("when_multi_motif_exist", lambda te, **_: _listed(motifs.multi_first_time(te), te, _pair("first_time")), lambda te, responses, agent=False, **_: scoring.score_first_time(motifs.multi_first_time(te), responses, agent)),
    )
}


def graph_sizes(te: DataFrame) -> DataFrame:
    """(graph_id, num_nodes, num_edges, num_time): distinct nodes, events, distinct times."""
    sizes = te.groupBy("graph_id").agg(F.count("*").alias("num_edges"), F.countDistinct("t").alias("num_time"))
    nodes = te.select("graph_id", F.explode(F.array("u", "v")).alias("n")).groupBy("graph_id").agg(F.countDistinct("n").alias("num_nodes"))
    return sizes.join(nodes, "graph_id").select("graph_id", "num_nodes", "num_edges", "num_time")


def evaluated(instances: DataFrame, questions: DataFrame, answers: DataFrame, sizes: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row an instance that has a question, an answer, a graph and a metric."""
    asked = instances.join(questions.select("graph_id", "task"), "graph_id")
    said = answers.select("graph_id", "total_tokens", "prompt_tokens", "completion_tokens")
    return asked.join(said, "graph_id").join(sizes, "graph_id").join(metrics.select("graph_id", "metric"), "graph_id")


def results(rows: DataFrame, keys: list[str], lists: bool = False) -> DataFrame:
    """The result row of each key: rates of metrics, tokens, means and deviations of the evaluated graphs' sizes; with ``lists`` the lists by graph id.

    Rates 2, 3 and 4 are those of sorting answers told apart by kind.
    """
    m = F.col("metric")
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    of = lambda c, name: [F.round(F.avg(c), 6).alias(f"average_{name}"), F.round(F.stddev_pop(c), 6).alias(f"deviation_{name}")]
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("graph_id", F.col(c).alias("x")))), lambda x: x["x"])
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("graph_id"))))
    made = [
        F.count("*").alias("n"), F.round(F.sum(F.when((m > 0) & (m <= 1), m).otherwise(0.0)) / F.count("*"), 6).alias("correct_rate"),
        share((m == 0) | (m == 2)).alias("error_rate"), share(m == -1).alias("failure_rate"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.round(F.coalesce(F.avg("total_tokens"), F.lit(0.0)), 6).alias("average_tokens"),
        *of("num_time", "num_times"), *of("num_edges", "num_edges"), *of("num_nodes", "num_nodes"),
        share(m == 2).alias("complete_unsorted"), share(m == 3).alias("incomplete_sorted"), share(m == 4).alias("incomplete_unsorted"),
    ]
    if lists:
        made += [ordered(c).alias(f"{c}_list") for c in ("metric", "total_tokens", "prompt_tokens", "completion_tokens")]
        made += [ids((m == 0) | (m == 2)).alias("error_graphs"), ids(m < 0).alias("failure_graphs")]
    return rows.groupBy(*keys).agg(*made)


def status(instances: DataFrame, sizes: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: finished and to-run instances (no graph or no readable answer), and mean and deviation of the graphs' sizes."""
    done = answers.where("content IS NOT NULL").select("graph_id").distinct().withColumn("_d", F.lit(True))
    df = instances.select("graph_id").join(sizes, "graph_id", "left").join(done, "graph_id", "left")
    ended = F.col("_d").isNotNull() & F.col("num_edges").isNotNull()
    of = lambda c: [F.round(F.avg(c), 2).alias(f"average_{c}"), F.round(F.stddev_pop(c), 2).alias(f"deviation_{c}")]
    return df.agg(F.count_if(ended).alias("finished"), F.count_if(~ended).alias("to_run"), *of("num_edges"), *of("num_nodes"), *of("num_time"))


def run_averages(instances: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: time and tokens of a run over all instances, those that were skipped too."""
    df = instances.select("graph_id").join(answers.select("graph_id", "time", "total_tokens"), "graph_id", "left")
    return df.agg(F.round(F.coalesce(F.sum("time"), F.lit(0.0)) / F.count("*"), 6).alias("average_times"), F.round(F.coalesce(F.sum("total_tokens"), F.lit(0)) / F.count("*"), 6).alias("average_tokens"))


def error_graphs(result: DataFrame) -> DataFrame:
    """(graph_id) of the errors and failures that a result row lists."""
    return result.select(F.explode(F.concat("error_graphs", "failure_graphs")).alias("graph_id")).distinct()


def registered(sql: dict[str, str]) -> list[tuple[str, Callable, str | None]]:
    """Queries by name; ``sql`` has the SQL of queries registered before."""
    te, both = f"WITH {EDGES_SQL}", f"WITH {EDGES_SQL}, {DIRECTED_SQL}"
    quad = """'["' || u || '","' || v || '","' || t || '","' || op || '"]'"""
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    context = f"cx AS (SELECT graph_id, '[' || string_agg({quad}, ',' ORDER BY seq) || ']' AS context FROM te GROUP BY graph_id)"
    mixed = f"cx AS (SELECT graph_id, '[' || string_agg({quad}, ',' ORDER BY md5('0:' || graph_id || ':' || seq)) || ']' AS context FROM te GROUP BY graph_id)"

    def rows(name: str, qa: str, with_: str = te, cx: str = context) -> str:
        return f"{with_}, {cx}, qa AS ({qa}) SELECT graph_id, '{name}' AS task, context, query, answer FROM cx JOIN qa USING (graph_id)"

    def asked(name: str, **options) -> Callable:
        return lambda s, d: TASKS[name].rows(temporal_edges(one_shuffle(s), d), **options)

    no = "SELECT DISTINCT graph_id, CAST(NULL AS VARCHAR) AS query, {} AS answer FROM te"
    at = "picked AS (SELECT graph_id, t AS q FROM (SELECT graph_id, t, row_number() OVER (PARTITION BY graph_id ORDER BY md5('0:' || graph_id || ':' || t)) AS k FROM (SELECT DISTINCT graph_id, t FROM te)) WHERE k = 1)"
    alive = f"al AS (SELECT graph_id, '[' || string_agg({quad}, ',' ORDER BY t, u, v) || ']' AS a FROM (SELECT te.*, row_number() OVER (PARTITION BY graph_id, least(u, v), greatest(u, v) ORDER BY t DESC, seq DESC) AS k FROM te JOIN picked USING (graph_id) WHERE t <= q) WHERE k = 1 AND op = 'a' GROUP BY graph_id)"
    link = f"SELECT graph_id, '[' || lo || ',' || hi || ']' AS query, '[' || first_add || ',' || first_delete || ']' AS answer FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY md5('0:' || graph_id || ':' || lo || ':' || hi || ':' || first_add || ':' || first_delete)) AS k FROM ({sql['first_link_unlink_after']})) WHERE k = 1"
    order = "CASE motif_name " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(catalog.NAMES)) + " END"
    listed = lambda item, source: f"SELECT g.graph_id, CAST(NULL AS VARCHAR) AS query, '[' || coalesce(string_agg({item}, ',' ORDER BY {order}), '') || ']' AS answer FROM (SELECT DISTINCT graph_id FROM te) g LEFT JOIN ({source}) m ON m.graph_id = g.graph_id GROUP BY g.graph_id"
    strict = " UNION ALL ".join(f"SELECT DISTINCT graph_id, '{m}' AS motif_name FROM ({instances_sql(catalog.EDGES[m], catalog.WINDOWS['default'][m], 'lt')})" for m in catalog.NAMES)
    pair = lambda value: f"""'["' || motif_name || '",' || {value} || ']'"""

    def provided(log: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
        """Answers of a task's run over the whole log, read from the table of responses, and the metrics that its scorer gives them."""
        said, metrics = answers.RUNS[task][1](log)
        prompts = text.contexts(log).withColumnRenamed("context", "prompt")
        return providers.from_table(prompts, said.withColumnRenamed("response", "content"), words_a_second=100.0), metrics

    def tables(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The log; its graphs and twenty names without a graph; answers to the link task, which not every graph has."""
        log = temporal_edges(s, d)
        return log, motifs.graphs(log).unionByName(s.range(0, 20).select((-F.col("id") - 1).alias("graph_id"))), provided(log, "when_link_and_dislink")[0]

    def result(s, d, lists: bool = False) -> DataFrame:
        log, ids, _ = tables(s, d)
        sizes, parts = graph_sizes(log), []
        for task in answers.RUNS:
            got, metrics = provided(log, task)
            parts.append(evaluated(ids, TASKS[task].rows(log), got, sizes, metrics))
        return results(reduce(DataFrame.unionByName, parts), ["task"], lists)

    def lists(s, d) -> DataFrame:
        joined = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ",").alias(c)
        return result(s, d, True).select("task", joined("total_tokens_list"), joined("prompt_tokens_list"), joined("error_graphs"), joined("failure_graphs"))

    tokens = "len(regexp_split_to_array(trim(response), '\\s+'))"
    said = lambda task: f"SELECT graph_id, '{task}' AS task, n * 4 AS prompt_tokens, {tokens} AS completion_tokens, n * 4 + {tokens} AS total_tokens FROM ({answers.responses_sql(sql[answers.RUNS[task][0]])}) JOIN (SELECT graph_id, count(*) AS n FROM te GROUP BY graph_id) USING (graph_id)"
    ans = f"an AS (SELECT *, total_tokens / 100.0 AS time FROM ({said('when_link_and_dislink')}))"
    runs = " UNION ALL ".join(f"SELECT graph_id, task, prompt_tokens, total_tokens, metric FROM ({said(task)}) JOIN ({sql[name]}) USING (graph_id)" for task, (name, _) in answers.RUNS.items())
    sizes = "sz AS (SELECT graph_id, count(*) AS num_edges, count(DISTINCT t) AS num_time, (SELECT count(DISTINCT n) FROM (SELECT unnest([u, v]) AS n FROM te x WHERE x.graph_id = te.graph_id)) AS num_nodes FROM te GROUP BY graph_id)"
    ids = "id_ AS (SELECT DISTINCT graph_id FROM te UNION ALL SELECT -i - 1 FROM (SELECT unnest(range(0, 20)) AS i))"
    joined = f"{te}, {sizes}, ev AS (SELECT graph_id, task, metric AS m, prompt_tokens, total_tokens, num_nodes, num_edges, num_time FROM ({runs}) JOIN sz USING (graph_id))"
    of = lambda c, name: f"round(avg({c}), 6) AS average_{name}, round(stddev_pop({c}), 6) AS deviation_{name}"
    share = lambda c: f"round(count(*) FILTER ({c}) / count(*), 6)"
    two = lambda c: f"round(avg({c}), 2) AS average_{c}, round(stddev_pop({c}), 2) AS deviation_{c}"
    null = lambda c: f"string_agg(coalesce(CAST({c} AS VARCHAR), 'null'), ',' ORDER BY graph_id)"
    windows = lambda log: motifs.graphs(log).select("graph_id", (F.col("graph_id") % 6 - 1).cast("int").alias("window"))
    return [
        ("qa_sort_edge", asked("sort_edge"), rows("sort_edge", no.format("'[]'"), cx=mixed)),
        ("qa_what_edges", asked("what_edges"), rows("what_edges", "SELECT graph_id, CAST(q AS VARCHAR) AS query, coalesce(a, '[]') AS answer FROM picked LEFT JOIN al USING (graph_id)", f"{te}, {at}, {alive}")),
        ("qa_when_link_and_dislink", asked("when_link_and_dislink"), rows("when_link_and_dislink", link)),
        ("qa_reverse_graph", asked("reverse_graph"), rows("reverse_graph", no.format("CAST(NULL AS VARCHAR)"))),
        ("qa_judge_contain_motif", asked("judge_contain_motif", motif="4-cycle"), rows("judge_contain_motif", f"SELECT graph_id, {lit(motif_query('4-cycle', 6))} AS query, answer FROM ({sql['contain_judge_4_cycle']})")),
        ("qa_judge_is_motif", asked("judge_is_motif", motif="triangle"), rows("judge_is_motif", f"SELECT graph_id, {lit(motif_query('triangle', 3))} AS query, answer FROM ({sql['is_motif_identity_triangle']})")),
        ("qa_modify_motif", asked("modify_motif", motif="triangle"), rows("modify_motif", f"SELECT DISTINCT graph_id, {lit(motif_query('triangle', 3))} AS query, '[]' AS answer FROM te")),
        ("qa_multi_motif_judge", asked("multi_motif_judge"), rows("multi_motif_judge", listed("""'"' || motif_name || '"'""", strict), both)),
        ("qa_multi_motif_count", asked("multi_motif_count"), rows("multi_motif_count", listed(pair("n_instances"), sql["multi_motif_counts"]))),
        ("qa_when_multi_motif_exist", asked("when_multi_motif_exist"), rows("when_multi_motif_exist", listed(pair("first_time"), sql["multi_motif_first_time"]))),
        ("is_motif_own_windows", lambda s, d: judged_within(temporal_edges(s, d), "triangle", windows(temporal_edges(s, d)), identity=False),
         f"{both} SELECT g.graph_id, CASE WHEN y.graph_id IS NULL THEN 'No' ELSE 'Yes' END AS answer FROM (SELECT DISTINCT graph_id FROM te) g LEFT JOIN (SELECT DISTINCT graph_id FROM ({instances_sql(catalog.EDGES['triangle'], 0)}) WHERE graph_id % 6 - 1 <= 0 OR t2 - t0 < graph_id % 6 - 1) y ON y.graph_id = g.graph_id"),
        ("is_motif_own_windows_identity", lambda s, d: judged_within(temporal_edges(s, d), "triangle", windows(temporal_edges(s, d))),
         f"{both} SELECT g.graph_id, CASE WHEN y.graph_id IS NULL THEN 'No' ELSE 'Yes' END AS answer FROM (SELECT DISTINCT graph_id FROM te) g LEFT JOIN (SELECT DISTINCT graph_id FROM ({instances_sql(catalog.EDGES['triangle'], 0, identity=True)}) WHERE graph_id % 6 - 1 <= 0 OR t2 - t0 < graph_id % 6 - 1) y ON y.graph_id = g.graph_id"),
        ("eval_results", result, f"{joined} SELECT task, count(*) AS n, round(sum(CASE WHEN m > 0 AND m <= 1 THEN m ELSE 0 END) / count(*), 6) AS correct_rate, {share('m IN (0, 2)')} AS error_rate, {share('m = -1')} AS failure_rate, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, round(coalesce(avg(total_tokens), 0), 6) AS average_tokens, {of('num_time', 'num_times')}, {of('num_edges', 'num_edges')}, {of('num_nodes', 'num_nodes')}, {share('m = 2')} AS complete_unsorted, {share('m = 3')} AS incomplete_sorted, {share('m = 4')} AS incomplete_unsorted FROM ev GROUP BY task"),
        ("eval_result_lists", lists, f"{joined} SELECT task, {null('total_tokens')} AS total_tokens_list, {null('prompt_tokens')} AS prompt_tokens_list, coalesce(string_agg(CAST(graph_id AS VARCHAR), ',' ORDER BY graph_id) FILTER (m IN (0, 2)), '') AS error_graphs, coalesce(string_agg(CAST(graph_id AS VARCHAR), ',' ORDER BY graph_id) FILTER (m < 0), '') AS failure_graphs FROM ev GROUP BY task"),
        ("run_status", lambda s, d: (lambda log, ids, answers: status(ids, graph_sizes(log), answers))(*tables(s, d)), f"{te}, {ans}, {sizes}, {ids} SELECT count(*) FILTER (total_tokens IS NOT NULL AND num_edges IS NOT NULL) AS finished, count(*) FILTER (total_tokens IS NULL OR num_edges IS NULL) AS to_run, {two('num_edges')}, {two('num_nodes')}, {two('num_time')} FROM id_ LEFT JOIN an USING (graph_id) LEFT JOIN sz USING (graph_id)"),
        ("run_averages", lambda s, d: (lambda log, ids, answers: run_averages(ids, answers))(*tables(s, d)), f"{te}, {ans}, {ids} SELECT round(sum(time) / count(*), 6) AS average_times, round(sum(total_tokens) / count(*), 6) AS average_tokens FROM id_ LEFT JOIN an USING (graph_id)"),
    ]
