"""The registered queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif import answers, tasks, tools
from chronomotif.functions import text
from chronomotif.operators import features, generators, increments, logs, motifs, routing, scoring
from chronomotif.plans import catalog
from chronomotif.plans.motif import DIRECTED_SQL, completions_sql, instances_sql, one_shuffle
from chronomotif.sources.events import EDGES_SQL, temporal_edges

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def te_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_edges(one_shuffle(spark), sf_dir)


def add(name: str, over_te: Callable[[DataFrame], DataFrame], sql: str | None = None, directed: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: over_te(te_of(spark, sf_dir))
    if sql is not None:
        SQL[name] = f"WITH {EDGES_SQL}{', ' + DIRECTED_SQL if directed else ''}{',' if sql.lstrip().startswith(('+',)) else ''} {sql.lstrip().removeprefix('+')}"


def _motifs() -> None:
    graphs = "(SELECT DISTINCT graph_id FROM te)"
    few = "SELECT graph_id, count(*) AS n_instances FROM ({}) WHERE graph_id IN (SELECT graph_id FROM (SELECT graph_id, unnest([lo, hi]) AS n FROM (SELECT DISTINCT graph_id, least(u, v) AS lo, greatest(u, v) AS hi FROM te WHERE op = 'a')) GROUP BY graph_id HAVING count(DISTINCT n) >= 6 AND count(*) >= 12) GROUP BY graph_id"
    add("motif_count_pruned_bitriangle", lambda te: motifs.count(te, "bitriangle", mode="monomorphism", prune=True), few.format(instances_sql(catalog.EDGES["bitriangle"], 15, mode="monomorphism")), True)
    for m in catalog.NAMES:
        key, edges, w = m.replace("-", "_"), catalog.EDGES[m], catalog.WINDOWS["default"][m]
        last = f"t{len(edges) - 1}"
        inst, mono = instances_sql(edges, w), instances_sql(edges, w, mode="monomorphism")
        add(f"motif_count_{key}", lambda te, m=m: motifs.count(te, m), f"SELECT graph_id, count(*) AS n_instances FROM ({inst}) GROUP BY graph_id", True)
        add(f"motif_count_mono_{key}", lambda te, m=m: motifs.count(te, m, mode="monomorphism"), f"SELECT graph_id, count(*) AS n_instances FROM ({mono}) GROUP BY graph_id", True)
        yes = "SELECT g.graph_id, CASE WHEN i.graph_id IS NULL THEN 'No' ELSE 'Yes' END AS answer FROM {g} g LEFT JOIN (SELECT DISTINCT graph_id FROM ({i})) i ON g.graph_id = i.graph_id"
        add(f"motif_judge_{key}", lambda te, m=m: motifs.judge(te, m), yes.format(g=graphs, i=inst), True)
        add(f"contain_judge_{key}", lambda te, m=m: motifs.judge(te, m, which="contain"), yes.format(g=graphs, i=instances_sql(edges, catalog.WINDOWS["contain"][m])), True)
        add(f"motif_count_summed_{key}", lambda te, m=m: motifs.count(te, m, plan="summed"), f"SELECT graph_id, count(*) AS n_instances FROM ({inst}) GROUP BY graph_id", True)
        add(f"motif_judge_first_{key}", lambda te, m=m: motifs.judge(te, m, plan="first"), yes.format(g=graphs, i=inst), True)
        add(f"motif_first_time_{key}", lambda te, m=m: motifs.first_time(te, m), f"SELECT graph_id, min({last}) AS first_time FROM ({inst}) GROUP BY graph_id", True)
        add(f"motif_instances_{key}", lambda te, m=m: motifs.found(te, m), inst, True)
        same = instances_sql(edges, w, "lt", identity=True)
        add(f"is_motif_identity_{key}", lambda te, m=m: motifs.judge(te, m, window_op="lt", identity=True), yes.format(g=graphs, i=same), True)
    def grown(motif: str, mode: str) -> Callable[[DataFrame], DataFrame]:
        """The count of the first thirty events of every log, and what the others change."""
        old = lambda te: te.where("seq < 30")
        return lambda te: increments.counts_after(motifs.count(old(te), motif, mode=mode), increments.count_change(old(te), te.where("seq >= 30"), motif, mode=mode))

    for m, mode in (("triangle", "induced"), ("4-path", "monomorphism"), ("bitriangle", "monomorphism")):
        all_ = instances_sql(catalog.EDGES[m], catalog.WINDOWS["default"][m], mode=mode)
        add(f"motif_count_grown_{m.replace('-', '_')}", grown(m, mode), f"SELECT graph_id, count(*) AS n_instances FROM ({all_}) GROUP BY graph_id", True)
    strict = " UNION ALL ".join(f"SELECT DISTINCT graph_id, '{m}' AS motif_name FROM ({instances_sql(catalog.EDGES[m], catalog.WINDOWS['default'][m], 'lt')})" for m in catalog.NAMES)
    add("multi_motif_judge", motifs.multi_judge, f"SELECT g.graph_id, coalesce(string_agg(motif_name, ',' ORDER BY motif_name), '') AS motifs FROM {graphs} g LEFT JOIN ({strict}) s ON g.graph_id = s.graph_id GROUP BY g.graph_id", True)
    counts = " UNION ALL ".join(f"SELECT graph_id, '{m}' AS motif_name, count(*) AS n_instances FROM ({instances_sql(catalog.EDGES[m], catalog.WINDOWS['default'][m])}) GROUP BY graph_id" for m in catalog.NAMES)
    add("multi_motif_counts", motifs.multi_count, counts, True)
    firsts = " UNION ALL ".join(f"SELECT graph_id, '{m}' AS motif_name, min(t{len(catalog.EDGES[m]) - 1}) AS first_time FROM ({instances_sql(catalog.EDGES[m], catalog.WINDOWS['default'][m])}) GROUP BY graph_id" for m in catalog.NAMES)
    add("multi_motif_first_time", motifs.multi_first_time, firsts, True)
    add("motif_first_time_compat_triangle", lambda te: motifs.first_time(te, "triangle", compat=True), f"SELECT g.graph_id, CAST(CASE WHEN NOT g.a THEN 0 ELSE coalesce(i.ft, {motifs.NO_INSTANCE}) END AS INT) AS first_time FROM (SELECT graph_id, bool_or(op = 'a') AS a FROM te GROUP BY graph_id) g LEFT JOIN (SELECT graph_id, min(t2) AS ft FROM ({instances_sql(catalog.EDGES['triangle'], 3)}) GROUP BY graph_id) i ON g.graph_id = i.graph_id", True)
    for m in catalog.NAMES:
        key, every = m.replace("-", "_"), completions_sql(catalog.EDGES[m], catalog.WINDOWS["default"][m], longest=40)
        add(f"motif_completions_{key}", lambda te, m=m: motifs.completions(te, m), every, True)
        add(f"motif_modify_{key}", lambda te, m=m: motifs.modify(te, m), f"SELECT graph_id, missing, t_add, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY missing, t_add, lo, hi) AS r FROM ({every})) WHERE r = 1", True)


def _logs() -> None:
    pair = "least(u, v) AS lo, greatest(u, v) AS hi"
    add("sort_edges", logs.sort_edges, "SELECT *, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY t, seq) AS INT) AS pos FROM te")
    add("edges_at_time", lambda te: logs.edges_at(te, 9), f"SELECT graph_id, u, v, t, op FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, least(u, v), greatest(u, v) ORDER BY t DESC, seq DESC) AS r FROM te WHERE t <= 9) WHERE r = 1 AND op = 'a'")
    every = '(SELECT *, row_number() OVER (PARTITION BY graph_id, "at", least(u, v), greatest(u, v) ORDER BY t DESC, seq DESC) AS r FROM te JOIN (SELECT DISTINCT graph_id, CAST(unnest([t, t * 3 + 1]) AS INT) AS "at" FROM te) USING (graph_id) WHERE t <= "at")'
    times = lambda te: te.select("graph_id", F.explode(F.array("t", F.col("t") * 3 + 1)).alias("at")).distinct()
    add("edges_at_many_times", lambda te: logs.alive_at(logs.alive_index(te, 8), times(te), 8), f"SELECT graph_id, \"at\", u, v, t, op FROM {every} WHERE r = 1 AND op = 'a'")
    add("first_link_unlink", logs.first_link_unlink, "SELECT graph_id, u, v, min(t) FILTER (op = 'a') AS first_add, min(t) FILTER (op = 'd') AS first_delete FROM te GROUP BY graph_id, u, v")
    add("first_link_unlink_after", logs.first_link_unlink_after, f"+ p AS (SELECT graph_id, {pair}, t, op FROM te), f AS (SELECT graph_id, lo, hi, min(t) AS first_add FROM p WHERE op = 'a' GROUP BY ALL) SELECT f.graph_id, f.lo, f.hi, first_add, min(p.t) AS first_delete FROM f JOIN p ON f.graph_id = p.graph_id AND f.lo = p.lo AND f.hi = p.hi AND p.op = 'd' AND p.t >= first_add GROUP BY ALL")
    add("eligible_edges", logs.eligible_edges, f"SELECT graph_id, {pair} FROM te GROUP BY graph_id, lo, hi HAVING bool_or(op = 'a') AND bool_or(op = 'd')")
    add("picked_edge", lambda te: logs.pick(logs.eligible_edges(te), ["lo", "hi"]), f"SELECT graph_id, lo, hi FROM (SELECT graph_id, lo, hi, row_number() OVER (PARTITION BY graph_id ORDER BY md5('0:' || graph_id || ':' || lo || ':' || hi)) AS r FROM (SELECT graph_id, {pair} FROM te GROUP BY graph_id, lo, hi HAVING bool_or(op = 'a') AND bool_or(op = 'd'))) WHERE r = 1")
    add("reverse_log", logs.reverse_log, "SELECT graph_id, seq, u, v, t, CASE WHEN op = 'a' THEN 'd' ELSE 'a' END AS op, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY seq DESC) AS INT) AS pos FROM te WHERE op IN ('a', 'd')")
    add("replay_is_empty", logs.replay_is_empty, f"SELECT graph_id, bool_and(op = 'd') AS is_empty FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, least(u, v), greatest(u, v) ORDER BY t DESC, op DESC) AS r FROM te) WHERE r = 1 GROUP BY graph_id")
    add("is_sorted", logs.is_sorted, "SELECT graph_id, bool_and(coalesce(t >= p, true)) AS is_sorted FROM (SELECT *, lag(t) OVER (PARTITION BY graph_id ORDER BY seq) AS p FROM te) GROUP BY graph_id")
    add("edge_snapshots", logs.snapshots, f"+ x AS (SELECT DISTINCT graph_id, t FROM te), s AS (SELECT x.graph_id, x.t, e.op, row_number() OVER (PARTITION BY x.graph_id, x.t, least(u, v), greatest(u, v) ORDER BY e.t DESC, e.seq DESC) AS r FROM x JOIN te e ON e.graph_id = x.graph_id AND e.t <= x.t) SELECT graph_id, t, count(*) FILTER (r = 1 AND op = 'a') AS n_alive FROM s GROUP BY graph_id, t")
    add("edge_status_timeline", logs.edge_status, f"SELECT graph_id, seq, lo, hi, t, CASE WHEN op = 'a' THEN 'green' ELSE 'red' END AS status, round(greatest(0.15::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * (t - f)), 6) AS alpha FROM (SELECT *, {pair}, min(CASE WHEN op = 'a' THEN t END) OVER (PARTITION BY graph_id, least(u, v), greatest(u, v) ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS f FROM te)")
    add("edge_frames", logs.frames, f"+ x AS (SELECT DISTINCT graph_id, t FROM te), p AS (SELECT *, {pair} FROM te), s AS (SELECT x.graph_id, x.t, p.lo, p.hi, arg_max(p.op, p.seq + 1000 * p.t) AS op, min(p.t) FILTER (p.op = 'a') AS f FROM x JOIN p ON p.graph_id = x.graph_id AND p.t <= x.t GROUP BY x.graph_id, x.t, p.lo, p.hi) SELECT graph_id, t, lo, hi, CASE op WHEN 'a' THEN 'green' ELSE 'red' END AS status, round(CASE op WHEN 'a' THEN 1.0::DOUBLE ELSE greatest(0.15::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * (t - coalesce(f, t))) END, 6) AS alpha FROM s")
    add("shuffled_log", logs.shuffled, "SELECT *, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY md5('0:' || graph_id || ':' || seq)) AS INT) AS pos FROM te")
    add("edge_timestamps", logs.edge_timestamps, f"SELECT graph_id, {pair}, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS times FROM te WHERE op = 'a' GROUP BY graph_id, lo, hi")


STATIC_SQL = "st AS (SELECT DISTINCT graph_id, least(u, v) AS lo, greatest(u, v) AS hi FROM te WHERE op = 'a')"
DEGREE_SQL = f"{STATIC_SQL}, dg AS (SELECT graph_id, node, count(*) AS degree FROM (SELECT graph_id, lo AS node FROM st UNION ALL SELECT graph_id, hi FROM st) GROUP BY ALL)"
COMPONENT_SQL = "r AS (WITH RECURSIVE w(graph_id, node, root) AS (SELECT graph_id, node, node FROM dg UNION SELECT w.graph_id, CASE WHEN st.lo = w.node THEN st.hi ELSE st.lo END, w.root FROM w JOIN st ON st.graph_id = w.graph_id AND (st.lo = w.node OR st.hi = w.node)) SELECT graph_id, node, min(root) AS root FROM w GROUP BY ALL), co AS (SELECT graph_id, count(DISTINCT root) AS n_components FROM r GROUP BY graph_id)"
NODE_SQL = "ne AS (SELECT graph_id, pos, t, unnest([u, v]) AS node FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY seq) - 1 AS pos FROM te) WHERE op = 'a'), cn AS (SELECT ne.* FROM ne JOIN dg USING (graph_id, node) WHERE degree >= 3)"
LOCAL_SQL = "lo_ AS (SELECT graph_id, avg(s) AS edge_locality_score FROM (SELECT graph_id, node, stddev_pop(pos) AS s FROM cn GROUP BY ALL HAVING count(*) >= 2) GROUP BY graph_id), cl AS (SELECT graph_id, CAST(sum(c * (c - 1) // 2) AS BIGINT) AS temporal_clash_count FROM (SELECT graph_id, node, t, count(*) AS c FROM cn GROUP BY ALL) GROUP BY graph_id)"
PROFILE_SQL = f"""{DEGREE_SQL}, {COMPONENT_SQL}, {NODE_SQL}, {LOCAL_SQL},
d AS (SELECT graph_id, count(*) AS n, CAST(sum(degree) // 2 AS BIGINT) AS e, count(*) FILTER (degree >= 3) AS g3, count(*) FILTER (degree = 2) AS e2 FROM dg GROUP BY graph_id),
fe AS (SELECT g.graph_id, coalesce(n, 0) AS num_nodes, coalesce(e, 0) AS num_edges, round(CASE WHEN n > 1 THEN e / (n * (n - 1) / 2) ELSE 0 END, 6) AS edge_density, coalesce(g3, 0) AS num_nodes_ge_3, coalesce(e2, 0) AS num_nodes_eq_2,
 coalesce(e - n + n_components, 1) AS cyclomatic_complexity, round(coalesce(edge_locality_score, 0), 6) AS edge_locality_score, coalesce(temporal_clash_count, 0) AS temporal_clash_count, round(coalesce(g3 / n, 0), 6) AS ratio_nodes_ge_3, round(coalesce(e2 / n, 0), 6) AS ratio_nodes_eq_2
 FROM (SELECT DISTINCT graph_id FROM te) g LEFT JOIN d USING (graph_id) LEFT JOIN co USING (graph_id) LEFT JOIN lo_ USING (graph_id) LEFT JOIN cl USING (graph_id))"""


def _features() -> None:
    add("static_edges", features.static_edges, f"+ {STATIC_SQL} SELECT * FROM st")
    add("node_degree", features.degrees, f"+ {DEGREE_SQL} SELECT * FROM dg")
    add("graph_components", features.components, f"+ {DEGREE_SQL}, {COMPONENT_SQL} SELECT * FROM co")
    add("component_labels", features.component_labels, f"+ {DEGREE_SQL}, {COMPONENT_SQL} SELECT graph_id, node, root FROM r")
    add("edge_locality", lambda te: features.locality(te).select("graph_id", F.round("edge_locality_score", 6).alias("edge_locality_score")), f"+ {DEGREE_SQL}, {NODE_SQL}, {LOCAL_SQL} SELECT graph_id, round(edge_locality_score, 6) AS edge_locality_score FROM lo_")
    add("temporal_clash", features.clashes, f"+ {DEGREE_SQL}, {NODE_SQL}, {LOCAL_SQL} SELECT * FROM cl")
    add("graph_features", features.profile, f"+ {PROFILE_SQL} SELECT * FROM fe")
    long = "SELECT graph_id, 'edges' AS measure, count(*) AS x FROM te GROUP BY graph_id UNION ALL SELECT graph_id, 'timestamps', count(DISTINCT t) FROM te GROUP BY graph_id UNION ALL SELECT graph_id, 'nodes', count(DISTINCT n) FROM (SELECT graph_id, unnest([u, v]) AS n FROM te) GROUP BY graph_id"
    add("dataset_stats", features.dataset_stats, f"SELECT measure, count(*) AS n, min(x) AS least, max(x) AS most, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation FROM ({long}) GROUP BY measure")
    add("timestamp_histogram", features.timestamp_histogram, "SELECT t, count(*) AS n_events FROM te GROUP BY t")


_motifs()
_logs()
_features()
for found in (generators.registered, text.registered, lambda: answers.registered(SQL), lambda: tasks.registered(SQL), lambda: tools.registered(SQL), scoring.registered, routing.registered):
    for name, query, sql in found():  # later ones build on the SQL of earlier ones
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
