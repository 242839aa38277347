"""The callable tools: a table of (id, input text) to (id, result JSON), by tool name.

Inputs are loosely written JSON objects with edge_list, motif_list or motif_definitions, u, v, time_point. Every tool is a
DataFrame plan over all rows at once; the last motif given counts where one is asked for. ``motifs_asked`` names the motifs that
inputs may ask for, so no others are planned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomotif.functions import parsing
from chronomotif.operators import features, logs, motifs, routing
from chronomotif.plans import catalog

TOOLS = [
    "Judge_Is_Contain_Motif", "Modify_To_Contain_Motif", "Detect_Motifs_Presence", "Detect_Motifs_Counts", "Detect_Motifs_First_Time",
    "Sort_Edges_By_Time", "Detect_First_Connected_And_Disconnected_Time", "Detect_Edges_Existence_At_Time", "Reverse_Dynamic_Graph",
]


def events(inputs: DataFrame) -> DataFrame:
    """Temporal edges of every input; the place in the list is seq."""
    listed = F.regexp_extract(F.col("input"), r"""(?s)["']?edge_list["']?\s*:\s*(.*?)(?:["']?(?:motif_list|motif_definitions|u|v|time_point)["']?\s*:|\}\s*$)""", 1)
    quads = parsing.edge_list(F.when(listed != "", listed).otherwise(F.col("input")))
    return inputs.select(F.col("id").alias("graph_id"), F.posexplode(quads).alias("seq", "q")).select("graph_id", "seq", "q.u", "q.v", "q.t", "q.op")


def argument(name: str) -> Column:
    """An integer argument of the input."""
    return F.regexp_extract(F.col("input"), rf"""["']?\b{name}["']?\s*:\s*["']?[ut]?(\d+)""", 1).try_cast("int")


def asked_motifs(inputs: DataFrame) -> DataFrame:
    """(id, motif_name): catalog names that the input mentions after its edges, in order."""
    names = F.regexp_extract_all(F.col("input"), F.lit("(" + "|".join(sorted(catalog.NAMES, key=len, reverse=True)) + ")"), F.lit(1))
    return inputs.select("id", F.posexplode(names).alias("pos", "motif_name"))


def _quads(rows: DataFrame, order: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), "u", "v", "t", "op")))
    plain = F.transform(listed, lambda e: F.array(e["u"].cast("string"), e["v"].cast("string"), e["t"].cast("string"), e["op"]))
    return rows.groupBy("graph_id").agg(F.to_json(plain).alias("result")).withColumnRenamed("graph_id", "id")


def call(name: str, inputs: DataFrame, motifs_asked: tuple[str, ...] = tuple(catalog.NAMES)) -> DataFrame:
    """(id, result) of a tool for every input row; result null where nothing is found."""
    te = events(inputs)
    if name in TOOLS[:2]:
        last = asked_motifs(inputs).groupBy("id").agg(F.max_by("motif_name", "pos").alias("motif_name"))
        parts = []
        for m in motifs_asked:
            own = te.join(last.where(F.col("motif_name") == m).select(F.col("id").alias("graph_id")), "graph_id", "left_semi")
            if name == TOOLS[0]:
                parts.append(motifs.judge(own, m).select(F.col("graph_id").alias("id"), F.to_json(F.struct("answer")).alias("result")))
            else:
                best = motifs.modify(own, m)
                parts.append(best.select(F.col("graph_id").alias("id"), F.to_json(F.struct(F.array(F.col("lo").cast("string"), F.col("hi").cast("string"), F.col("t_add").cast("string"), F.lit("a")).alias("edge"))).alias("result")))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
    elif name in TOOLS[2:5]:
        asked = asked_motifs(inputs).select(F.col("id").alias("graph_id"), "motif_name").distinct()
        rows = motifs.multi_count(te, motifs_asked) if name == TOOLS[3] else motifs.multi_first_time(te, motifs_asked)
        value = rows.columns[-1]
        rows = rows.join(asked, ["graph_id", "motif_name"], "left_semi")
        if name == TOOLS[2]:
            out = F.to_json(F.array_sort(F.collect_list("motif_name")))
        else:
            out = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("motif_name", value)))))
        found = rows.groupBy("graph_id").agg(out.alias("result")).withColumnRenamed("graph_id", "id")
    elif name == "Sort_Edges_By_Time":
        found = _quads(logs.sort_edges(te), "pos")
    elif name == "Reverse_Dynamic_Graph":
        found = _quads(logs.reverse_log(te), "pos")
    elif name == "Detect_Edges_Existence_At_Time":
        at = inputs.select(F.col("id").alias("graph_id"), argument("time_point").alias("at"))
        found = _quads(logs.edges_at(te.join(at, "graph_id"), F.col("at")), "t")
    elif name == "Detect_First_Connected_And_Disconnected_Time":
        pair = inputs.select(F.col("id").alias("graph_id"), argument("u").alias("u"), argument("v").alias("v"))
        times = logs.first_link_unlink(te).join(pair, ["graph_id", "u", "v"])
        found = times.select(F.col("graph_id").alias("id"), F.to_json(F.array("first_add", "first_delete")).alias("result"))
    else:
        raise ValueError(f"no tool named {name}")
    return inputs.select("id").join(found, "id", "left")


def predict_strategy(inputs: DataFrame, nodes: list[tuple]) -> DataFrame:
    """The router as a tool, with a stored classifier's nodes: (id, strategy)."""
    out = routing.predict(nodes, features.profile(events(inputs)))
    return out.select(F.col("graph_id").alias("id"), routing.decide(F.col("predicted"), F.col("probability"), "tool").alias("strategy"))


ASKED = ("triangle", "4-cycle", "3-star")


def inputs_of(te: DataFrame) -> DataFrame:
    """(id, input): each log as a tool's input with three motifs, two nodes and a time."""
    from chronomotif.functions import text

    tail = F.concat(F.lit(", 'motif_list': ['3-star', \"4-cycle\", 'triangle'], 'u': "), F.col("graph_id") % 12, F.lit(", 'v': 'u"), (F.col("graph_id") * 5 + 1) % 12, F.lit("', 'time_point': "), F.col("graph_id") % 20, F.lit(" }"))
    return text.contexts(te).select(F.col("graph_id").alias("id"), F.concat(F.lit("{ 'edge_list': "), "context", tail).alias("input"))


def registered(sql: dict[str, str]) -> list[tuple[str, Callable, str | None]]:
    """Queries by name; ``sql`` has the SQL of queries registered before."""
    from chronomotif.sources.events import EDGES_SQL, temporal_edges

    te = f"WITH {EDGES_SQL}"
    ids = "(SELECT DISTINCT graph_id AS id FROM te)"
    left = lambda result, source: f"{te} SELECT g.id, result FROM {ids} g LEFT JOIN (SELECT graph_id, {result} AS result FROM ({source}) GROUP BY graph_id) r ON r.graph_id = g.id"
    quad = """'["' || u || '","' || v || '","' || t || '","' || op || '"]'"""
    some = "motif_name IN ('triangle', '4-cycle', '3-star')"
    pairs = lambda value: """'{' || string_agg('"' || motif_name || '":' || {}, ',' ORDER BY motif_name) || '}'""".replace("{}", value)
    alive = "(SELECT te.*, row_number() OVER (PARTITION BY graph_id, least(u, v), greatest(u, v) ORDER BY t DESC, seq DESC) AS k FROM te WHERE t <= graph_id % 20)"
    linked = "SELECT graph_id, min(t) FILTER (op = 'a') AS a, min(t) FILTER (op = 'd') AS d FROM te WHERE u = graph_id % 12 AND v = (graph_id * 5 + 1) % 12 GROUP BY graph_id"
    null = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'null')"
    queries = {
        "Judge_Is_Contain_Motif": f"SELECT graph_id AS id, '{{\"answer\":\"' || answer || '\"}}' AS result FROM ({sql['motif_judge_triangle']})",
        "Modify_To_Contain_Motif": left("""'{"edge":["' || any_value(lo) || '","' || any_value(hi) || '","' || any_value(t_add) || '","a"]}'""", sql["motif_modify_triangle"]),
        "Detect_Motifs_Presence": left("""'[' || string_agg('"' || motif_name || '"', ',' ORDER BY motif_name) || ']'""", f"SELECT * FROM ({sql['multi_motif_first_time']}) WHERE {some}"),
        "Detect_Motifs_Counts": left(pairs("n_instances"), f"SELECT * FROM ({sql['multi_motif_counts']}) WHERE {some}"),
        "Detect_Motifs_First_Time": left(pairs("first_time"), f"SELECT * FROM ({sql['multi_motif_first_time']}) WHERE {some}"),
        "Sort_Edges_By_Time": left(f"'[' || string_agg({quad}, ',' ORDER BY t, seq) || ']'", "SELECT * FROM te"),
        "Detect_First_Connected_And_Disconnected_Time": left(f"'[' || any_value({null('a')}) || ',' || any_value({null('d')}) || ']'", linked),
        "Detect_Edges_Existence_At_Time": left(f"'[' || string_agg({quad}, ',' ORDER BY t, u, v) || ']'", f"SELECT * FROM {alive} WHERE k = 1 AND op = 'a'"),
        "Reverse_Dynamic_Graph": left("""'[' || string_agg('["' || u || '","' || v || '","' || t || '","' || CASE WHEN op = 'a' THEN 'd' ELSE 'a' END || '"]', ',' ORDER BY seq DESC) || ']'""", "SELECT * FROM te"),
    }
    run = lambda name: lambda s, d: call(name, inputs_of(temporal_edges(s, d)), ("triangle",) if name in TOOLS[:2] else ASKED)
    return [(f"tool_{name.lower()}", run(name), queries[name]) for name in TOOLS]
