"""Queries over answers: right, partly right, wrong and unreadable texts for every graph, parsed and scored; with DuckDB SQL.

The answers are built from each graph's log and the task's truth by CASE expressions that Spark and DuckDB both read, so both
sides see the same text. The SQL parses that text with its own list functions and works the metric out from it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomotif.functions import parsing, text
from chronomotif.operators import logs, motifs, scoring
from chronomotif.plans import catalog
from chronomotif.plans.motif import DIRECTED_SQL, instances_sql, one_shuffle
from chronomotif.sources.events import EDGES_SQL, temporal_edges
from chronomotif.sources.tables import cut

NL = "chr(10)"
Q = "chr(39)"

#: What each graph's answer says; the pieces (s, b, ..) are rendered logs or lists, and differ by task.
SAID = {
    "sort": f"""CASE graph_id % 8 WHEN 0 THEN 'I think [1]. Answer: [' || s || ']' WHEN 1 THEN 'Answer: [' || b || ']' WHEN 2 THEN 'Answer: [' || h || ']' WHEN 3 THEN 'no idea'
 WHEN 4 THEN 'Answer: [' || replace(s, ', a)', ' a)') || ']' WHEN 5 THEN '[' || replace(replace(s, '(', ''), ')', '') || ']' WHEN 6 THEN 'Answer: [' || s || ',' || {NL} || s || ']' ELSE 'Answer: [' || s || '] or []' END""",
    "what": f"""CASE graph_id % 6 WHEN 0 THEN 'Answer: [' || s || ']' WHEN 1 THEN 'The answer is: nothing, (9, 9, 9, a)' || {NL} || {NL} || s || {NL} WHEN 2 THEN 'Final answer: ' || s || {NL} || {NL} || 'Done.'
 WHEN 3 THEN s || ', ' || s WHEN 4 THEN 'Answer: ' || h ELSE 'Answer: []' END""",
    "link": """CASE graph_id % 9 WHEN 0 THEN 'Answer: ' || x || ', ' || y WHEN 1 THEN 'Answer: [' || x || ', ' || y || ']' WHEN 2 THEN 'Answer: nodes (0, 7) are first connected at time ' || x || ' and disconnected at time ' || y
 WHEN 3 THEN 'Answer: First connection: ' || x || '; First disconnection: ' || (y + 1) WHEN 4 THEN x || ', ' || y WHEN 5 THEN 'Answer: 1, 2? No. Answer: **Answer:** ' || x || ', ' || y || '.'
 WHEN 6 THEN 'Answer: first connected at t=' || y || ', first disconnected at t=' || x WHEN 7 THEN 'Answer: - First connected: ' || x || ' - First disconnected: ' || y ELSE 'Answer: never' END""",
    "reverse": f"""CASE graph_id % 6 WHEN 0 THEN 'Answer: [' || s || ']' WHEN 1 THEN 'Answer: []' WHEN 2 THEN s || ' Answer: as above' WHEN 3 THEN 'Answer: [' || replace(replace(s, '(', '['), ')', ']') || ']'
 WHEN 4 THEN 'Answer: [' || h || ']' ELSE 'Answer: [[1, 2, 0, ' || {Q} || 'd' || {Q} || ']] and ' || s END""",
    "contain": """CASE graph_id % 6 WHEN 0 THEN 'Answer: ' || a WHEN 1 THEN CASE WHEN a = 'Yes' THEN 'No.' ELSE 'YES!' END WHEN 2 THEN 'Nobody knows, yesterday or today' WHEN 3 THEN 'I say ' || lower(a) || ', not the opposite (yes/no)' WHEN 4 THEN '' ELSE 'No? Yes.' END""",
    "modify": f"""CASE graph_id % 7 WHEN 0 THEN 'Answer: [(' || x || ', a)]' WHEN 1 THEN 'Answer: (' || x || ', a)' WHEN 2 THEN 'Answer: [' || x || ', ' || {Q} || 'a' || {Q} || ']' WHEN 3 THEN '[' || x || ', a]' WHEN 4 THEN 'Answer: [(' || x || ', d)]'
 WHEN 5 THEN 'Answer: [(30, 31, 99, a)]' ELSE 'Add an edge' END""",
    "judge": """CASE graph_id % 8 WHEN 0 THEN 'Answer: [' || a || ']' WHEN 1 THEN 'Answer: triangle, 4-clique' WHEN 2 THEN a WHEN 3 THEN 'Answer: Triangle 3-STAR (4-path); square; **butterfly**' WHEN 4 THEN 'Answer: none' WHEN 5 THEN 'Answer: ' || a || repeat(' because', 30)
 WHEN 6 THEN 'Answer: x Answer: "3-star", ' || a ELSE '**Answer:** ' || replace(a, ',', '. ') || ', bitriangle' END""",
    "count": f"""CASE graph_id % 9 WHEN 0 THEN 'Answer: [' || s || ']' WHEN 1 THEN 'Answer: [' || h || ']' WHEN 2 THEN 'Answer: ' || s WHEN 3 THEN s WHEN 4 THEN 'Answer: the list is [' || s || ', ("square", 3)]' WHEN 5 THEN 'Answer: ' || {NL} || '```python' || {NL} || '[' || replace(s, '"', {Q}) || ']' || {NL} || '```' || ' so'
 WHEN 6 THEN 'Answer: [' || s || '] I hope' WHEN 7 THEN 'Answer: [' || s || ', ' || h || ']' ELSE 'Answer: [' || replace(s, '"', '') || ']' END""",
    "time": f"""CASE graph_id % 9 WHEN 0 THEN 'Answer: [' || s || ']' WHEN 1 THEN 'Answer:' || {NL} || replace(replace(replace(replace(s, '), (', ')#('), '#', {NL}), '(', '- '), ',', ':') WHEN 2 THEN 'Answer: [' || h || ']' WHEN 3 THEN s WHEN 4 THEN '```' || {NL} || '[' || s || ']' || {NL} || '``` Answer: 1'
 WHEN 5 THEN '### Final Answer' || {NL} || replace(replace(replace(replace(replace(s, '), (', '#'), '#', {NL}), '(', ''), ')', ''), '",', '":') WHEN 6 THEN 'Answer: <b>' || replace(replace(s, '), (', ')#('), '#', {NL}) || '</b>' WHEN 7 THEN 'Answer: [' || h || ', ' || s || ']' ELSE 'Answer: none of them' END""",
}


#: Texts whose parse is known without a pattern: the SQL of their queries names it.
PAIR_FORMS = [
    r"\boxed{<x>}, \boxed{<y>}", "First connection: <x>\nFirst disconnection: <y>", "Nodes first connect at time <x> and disconnect at time <y>", "connect time: <x>\ndisconnect time: <y>", "first connected at t=<x> (0, 7), first disconnected at t=<y>",
    "<x>, <y>. From (0, 7)", "- first connected at time <x> (0, 7)\n- first disconnected at time <y>", "nodes first connect at time `<x>` and disconnect at time `<y>`", "soon", "<x>, <y>",
]
QUAD_FORMS = ["[(9, 9, 9, a)] then [(<u>, <v>, <t>, '<o>')]", "[(<u> <v> <t> <o>)]", "[<u>, <v>, <t>, <o>; <v>, <u>, <t>, <o>]", "(<u>, <v>, <t>, <o>)", "[(<u>, <v>, <t>, <o>), (<u>,<v>,<t>,<o>)]", "none"]
UNMARKED = {"<x>, <y>"}


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches_sql(source: str, pattern: str) -> str:
    """List of u,v,t,op texts of all matches."""
    groups = [f"regexp_extract_all({source}, {_lit(pattern)}, {k})" for k in (1, 2, 3, 4)]
    return "[" + " || ',' || ".join(f"{g}[i]" for g in groups) + f" FOR i IN range(1, len({groups[0]}) + 1)]"


def _after_sql(source: str, marker: str = "Answer:") -> str:
    """Behind the last marker; null without it."""
    return rf"CASE WHEN contains({source}, '{marker}') THEN regexp_replace(string_split({source}, '{marker}')[-1], '^\s+|\s+$', '', 'g') END"


def _strip_sql(source: str) -> str:
    return rf"regexp_replace({source}, '^\s+|\s+$', '', 'g')"


def rendered(te: DataFrame, name: str, *order: str) -> DataFrame:
    """(graph_id, name): the events of each graph as text without brackets, in an order."""
    keys = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    e = te.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(*keys, "u", "v", "t", "op"))).alias("e"))
    return e.select("graph_id", F.regexp_replace(text.render_events(F.col("e")), r"^\[|\]$", "").alias(name))


def _rendered_sql(order: str, name: str, where: str = "true") -> str:
    return f"coalesce(string_agg('(' || u || ', ' || v || ', ' || t || ', ' || op || ')', ', ' ORDER BY {order}) FILTER ({where}), '') AS {name}"


def _pieces(te: DataFrame, *parts: DataFrame) -> DataFrame:
    """One row a graph with all parts, empty texts where a part has none."""
    df = te.select("graph_id").distinct()
    for part in parts:
        df = df.join(part, "graph_id", "left")
    return df.fillna("")


def _said(task: str, pieces: DataFrame) -> DataFrame:
    return pieces.select("graph_id", F.expr(SAID[task]).alias("response"))


def sort_answers(te: DataFrame) -> DataFrame:
    return _said("sort", _pieces(te, rendered(te, "s", "t", "seq"), rendered(te, "b", "seq"), rendered(te.where("seq > 5"), "h", "t", "seq")))


def what_answers(te: DataFrame, truth: DataFrame) -> DataFrame:
    return _said("what", _pieces(te, rendered(truth, "s", "t", "u", "v"), rendered(truth.where("t < 6"), "h", "t", "u", "v")))


def link_truth(te: DataFrame) -> DataFrame:
    return logs.pick(logs.first_link_unlink_after(te), ["lo", "hi", "first_add", "first_delete"])


def link_answers(truth: DataFrame) -> DataFrame:
    return _said("link", truth.select("graph_id", F.col("first_add").alias("x"), F.col("first_delete").alias("y")))


def _what_run(te: DataFrame) -> tuple[DataFrame, DataFrame]:
    truth = logs.edges_at(te, 9)
    said = what_answers(te, truth)
    return said, scoring.score_set(truth, said)


def _sort_run(te: DataFrame) -> tuple[DataFrame, DataFrame]:
    said = sort_answers(te)
    return said, scoring.score_sort(te, said)


def _link_run(te: DataFrame) -> tuple[DataFrame, DataFrame]:
    truth = link_truth(te)
    said = link_answers(truth)
    return said, scoring.score_link(truth, said)


def _reverse_run(te: DataFrame) -> tuple[DataFrame, DataFrame]:
    said = reverse_answers(te)
    return said, scoring.score_reverse(te, said)


#: Tasks and the names of their scored queries; each gives (responses, their metrics) of a log.
RUNS = {"sort_edge": ("score_sort", _sort_run), "what_edges": ("score_what_edges", _what_run), "when_link_and_dislink": ("score_link", _link_run), "reverse_graph": ("score_reverse", _reverse_run)}


def responses_sql(scored: str) -> str:
    """The responses (graph_id, response) that a scored query's SQL reads."""
    return scored[: scored.rindex("\nSELECT")] + "\nSELECT graph_id, response FROM r"


def reverse_answers(te: DataFrame) -> DataFrame:
    back = logs.reverse_log(te)
    return _said("reverse", _pieces(te, rendered(back, "s", "pos"), rendered(back.where("seq < 20"), "h", "pos")))


def modify_answers(te: DataFrame, motif: str) -> DataFrame:
    return _said("modify", motifs.modify(te, motif).select("graph_id", F.concat_ws(", ", "lo", "hi", "t_add").alias("x")))


def _pairs(rows: DataFrame, value: str, less: int) -> DataFrame:
    """(graph_id, s, h): all pairs as text, and pairs of every other name with values lowered by ``less``."""
    one = F.concat(F.lit('("'), "motif_name", F.lit('", '), F.col(value).cast("string"), F.lit(")"))
    low = F.concat(F.lit('("'), "motif_name", F.lit('", '), F.greatest(F.col(value) - less, F.lit(0)).cast("string"), F.lit(")"))
    some = F.length("motif_name") % 2 == 0
    agg = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["x"]), ", ")
    return rows.groupBy("graph_id").agg(agg(F.struct("motif_name", one.alias("x"))).alias("s"), agg(F.when(some, F.struct("motif_name", low.alias("x")))).alias("h"))


def _pairs_sql(value: str, less: int) -> str:
    one = """'("' || motif_name || '", ' || {} || ')'"""
    return f"string_agg({one.format(value)}, ', ' ORDER BY motif_name) AS s, coalesce(string_agg({one.format(f'greatest({value} - {less}, 0)')}, ', ' ORDER BY motif_name) FILTER (length(motif_name) % 2 = 0), '') AS h"


def _sort_sql(te: str) -> str:
    tries = [_matches_sql("l", p) for p in (parsing.TUPLE, *parsing.LOOSE)]
    return te + rf""", p AS (SELECT graph_id, {_rendered_sql('t, seq', 's')}, {_rendered_sql('seq', 'b')}, {_rendered_sql('t, seq', 'h', 'seq > 5')}, list_sort(list(DISTINCT u || ',' || v || ',' || t || ',' || op)) AS real FROM te GROUP BY graph_id),
r AS (SELECT graph_id, real, {SAID['sort']} AS response FROM p), l AS (SELECT graph_id, real, coalesce(regexp_extract_all(response, '(?s)\[(.*?)\]', 1)[-1], '') AS l FROM r),
q AS (SELECT graph_id, real, {tries[0]} AS q0, {tries[1]} AS q1, {tries[2]} AS q2 FROM l), z AS (SELECT graph_id, real, CASE WHEN len(q0) > 0 THEN q0 WHEN len(q1) > 0 THEN q1 ELSE q2 END AS q FROM q),
o AS (SELECT *, [CAST(split_part(e, ',', 3) AS INT) FOR e IN q] AS ts FROM z)
SELECT graph_id, CAST(CASE WHEN len(q) = 0 THEN -3 WHEN list_sort(list_distinct(q)) <> real THEN -2 WHEN ts <> list_sort(ts) THEN -1 ELSE 1 END AS DOUBLE) AS metric FROM o"""


def _what_sql(te: str, alive: str) -> str:
    return te + rf""", a AS ({alive}), p AS (SELECT g.graph_id, coalesce(s, '') AS s, coalesce(h, '') AS h, coalesce(real, []) AS real FROM (SELECT DISTINCT graph_id FROM te) g LEFT JOIN (SELECT graph_id, {_rendered_sql('t, u, v', 's')}, {_rendered_sql('t, u, v', 'h', 't < 6')}, list_sort(list(DISTINCT u || ',' || v || ',' || t || ',' || op)) AS real FROM a GROUP BY graph_id) x USING (graph_id)),
r AS (SELECT graph_id, real, {SAID['what']} AS response FROM p), m AS (SELECT graph_id, real, coalesce({_after_sql('response')}, {_after_sql('response', 'The answer is:')}, {_after_sql('response', 'Final answer:')}, response) AS x FROM r),
l AS (SELECT graph_id, real, coalesce([y FOR y IN string_split(x, {NL} || {NL}) IF {_strip_sql('y')} <> ''][-1], x) AS x FROM m)
SELECT graph_id, CASE WHEN list_sort(list_distinct({_matches_sql('x', parsing.TUPLE)})) = real THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS metric FROM l"""


def _link_sql(pairs: str) -> str:
    forms = [p for p in (*parsing.TWO_INTS, parsing.LAST_TWO_INTS) if r"\1" not in p]  # the engine has no back references; no answer here needs that form
    tries = " ".join(f"WHEN regexp_extract(x, {_lit(p)}, 1) <> '' THEN regexp_extract(x, {_lit(p)}, 1) || ',' || regexp_extract(x, {_lit(p)}, 2)" for p in forms)
    return rf"""WITH a AS ({pairs}), f AS (SELECT graph_id, first_add AS x, first_delete AS y, row_number() OVER (PARTITION BY graph_id ORDER BY md5('0:' || graph_id || ':' || lo || ':' || hi || ':' || first_add || ':' || first_delete)) AS k FROM a),
r AS (SELECT graph_id, x || ',' || y AS real, {SAID['link']} AS response FROM f WHERE k = 1), l AS (SELECT graph_id, real, lower({_after_sql('response')}) AS x FROM r), z AS (SELECT graph_id, real, CASE WHEN x IS NULL THEN NULL {tries} END AS got FROM l)
SELECT graph_id, CAST(CASE WHEN got IS NULL THEN -1 WHEN got = real THEN 1 ELSE 0 END AS DOUBLE) AS metric FROM z"""


def _reverse_sql(te: str) -> str:
    op = "CASE WHEN op = 'a' THEN 'd' ELSE 'a' END"
    nested = f"regexp_extract(x, {_lit(parsing.NESTED)}, 0)"
    read = lambda src: f"CASE WHEN regexp_extract({src}, {_lit(parsing.NESTED)}, 0) <> '' THEN {_matches_sql(nested.replace('(x,', f'({src},'), parsing.LISTED)} ELSE {_matches_sql(src, parsing.TUPLE)} END"
    body = _rendered_sql("seq DESC", "s"), _rendered_sql("seq DESC", "h", "seq < 20")
    return te + rf""", p AS (SELECT graph_id, {body[0].replace('op ||', '(' + op + ') ||')}, {body[1].replace('op ||', '(' + op + ') ||')} FROM te GROUP BY graph_id), r AS (SELECT graph_id, {SAID['reverse']} AS response FROM p),
m AS (SELECT graph_id, response, coalesce({_after_sql('response')}, '') AS x FROM r), n AS (SELECT graph_id, response, {read('x')} AS q0 FROM m), q AS (SELECT graph_id, CASE WHEN len(q0) > 0 THEN q0 ELSE {read('response')} END AS q FROM n),
e AS (SELECT graph_id, u, v, t, op FROM te UNION ALL SELECT graph_id, CAST(split_part(e, ',', 1) AS INT), CAST(split_part(e, ',', 2) AS INT), CAST(split_part(e, ',', 3) AS INT), split_part(e, ',', 4) FROM (SELECT graph_id, unnest(q) AS e FROM q)),
w AS (SELECT graph_id, op, row_number() OVER (PARTITION BY graph_id, least(u, v), greatest(u, v) ORDER BY t DESC, op DESC) AS k FROM e)
SELECT graph_id, CASE WHEN bool_and(op = 'd') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS metric FROM w WHERE k = 1 GROUP BY graph_id"""


def _contain_sql(judged: str) -> str:
    return rf"""WITH j AS ({judged}), r AS (SELECT graph_id, answer AS a FROM j), s AS (SELECT graph_id, a, {SAID['contain']} AS response FROM r), x AS (SELECT graph_id, lower(a) AS a, regexp_extract(lower(response), '\b(yes|no)\b', 1) AS got FROM s)
SELECT graph_id, CAST(CASE WHEN got = '' THEN -3 WHEN got = a THEN 1 ELSE 0 END AS DOUBLE) AS metric FROM x"""


def _modify_sql(te: str, best: str, motif: str) -> str:
    bracket = r"regexp_extract(x, '(?s)\[(.*?)\]', 0)"
    free = lambda src: f"CASE WHEN len({_matches_sql(src, parsing.TUPLE)}) > 0 THEN {_matches_sql(src, parsing.TUPLE)} ELSE {_matches_sql(src, parsing.LISTED)} END"
    edges, w = catalog.EDGES[motif], catalog.WINDOWS["default"][motif]
    added = instances_sql(edges, w)
    return te.replace(", directed AS", ", directed_ AS") + rf""", b AS ({best}), y AS (SELECT graph_id, lo || ', ' || hi || ', ' || t_add AS x FROM b), r AS (SELECT graph_id, {SAID['modify']} AS response FROM y), m AS (SELECT graph_id, response, {_after_sql('response')} AS x FROM r),
q AS (SELECT graph_id, CASE WHEN x IS NULL THEN {free('response')} WHEN {bracket} <> '' THEN {_matches_sql(bracket, parsing.TUPLE)} ELSE {free('x')} END AS q FROM m), g AS (SELECT graph_id, q FROM q WHERE len(q) > 0),
e AS (SELECT te.graph_id, u, v, t, op FROM te WHERE graph_id IN (SELECT graph_id FROM g) UNION ALL SELECT graph_id, CAST(split_part(e, ',', 1) AS INT), CAST(split_part(e, ',', 2) AS INT), CAST(split_part(e, ',', 3) AS INT), split_part(e, ',', 4) FROM (SELECT graph_id, unnest(q) AS e FROM g)),
directed AS (SELECT DISTINCT graph_id, u AS s, v AS d, t FROM e WHERE op = 'a' UNION SELECT DISTINCT graph_id, v, u, t FROM e WHERE op = 'a')
SELECT r.graph_id, CASE WHEN i.graph_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS metric FROM r LEFT JOIN (SELECT DISTINCT graph_id FROM ({added})) i ON i.graph_id = r.graph_id"""


def _judge_sql(judged: str) -> str:
    clean = r"""lower(regexp_replace(y, '[()''".,;:\[\]{}]', '', 'g'))"""
    return rf"""WITH j AS ({judged}), r AS (SELECT graph_id, a, {SAID['judge']} AS response FROM (SELECT graph_id, motifs AS a FROM j)),
m AS (SELECT graph_id, a, coalesce({_after_sql('response')}, {_after_sql('response', '**Answer:**')}) AS x FROM r), l AS (SELECT graph_id, [y FOR y IN string_split(a, ',') IF y <> ''] AS real, x, list_distinct([{clean} FOR y IN regexp_split_to_array(x, '[,\s]+')]) AS said FROM m),
v AS (SELECT graph_id, real, x, [y FOR y IN said IF list_contains({list(catalog.NAMES)}, y)] AS said FROM l)
SELECT graph_id, CASE WHEN len(real) = 0 OR x IS NULL OR length(x) > {parsing.LONGEST_NAME_LIST} THEN 0.0::DOUBLE ELSE (2 * len([y FOR y IN said IF list_contains(real, y)]) - len(said)) / len(real)::DOUBLE END AS metric FROM v"""


def _pair_lists_sql(source: str) -> str:
    a, b = (f"regexp_extract_all({source}, {_lit(parsing.LITERAL_PAIR)}, {k})" for k in (1, 2))
    return f"[lower(trim({a}[i])) || '=' || {b}[i] FOR i IN range(1, len({a}) + 1)]"


def _count_sql(counts: str) -> str:
    fence = r"regexp_extract(x, '(?s)```(?:python)?\s*\n?(.*?)\n?```', 1)"
    cut = rf"regexp_replace(CASE WHEN {fence} <> '' THEN {fence} ELSE regexp_replace(x, '(?s)```.*$', '') END, '(?s)^[^\[]*\[', '[')"
    return rf"""WITH c AS ({counts}), p AS (SELECT graph_id, {_pairs_sql('n_instances', 1)} FROM c GROUP BY graph_id), r AS (SELECT graph_id, {SAID['count']} AS response FROM p), m AS (SELECT graph_id, coalesce({_after_sql('response')}, {_after_sql('response', '**Answer:**')}) AS x FROM r),
f AS (SELECT graph_id, {_strip_sql(cut)} AS x FROM m), l AS (SELECT graph_id, CASE WHEN regexp_matches(x, {_lit(parsing.LITERAL)}) THEN list_distinct({_pair_lists_sql('x')}) END AS said FROM f),
k AS (SELECT graph_id, split_part(y, '=', 1) AS motif_name, CAST(split_part(y, '=', 2) AS BIGINT) AS n FROM (SELECT graph_id, unnest(said) AS y FROM l)),
s AS (SELECT c.graph_id, sum(CASE WHEN n <= n_instances THEN n / n_instances ELSE 0 END) / count(DISTINCT c.motif_name) AS metric FROM c LEFT JOIN k USING (graph_id, motif_name) GROUP BY c.graph_id)
SELECT l.graph_id, CASE WHEN said IS NULL THEN -1.0::DOUBLE ELSE round(metric, 9) END AS metric FROM l JOIN s USING (graph_id)"""


def _time_sql(firsts: str) -> str:
    whole = r"regexp_matches({n}, '^[+-]?\d+$')"
    two = lambda body, by, name: f"CASE WHEN len(string_split({body}, '{by}')) = 2 AND {whole.format(n=_strip_sql(f'''string_split({body}, '{by}')[2]'''))} THEN lower({name(_strip_sql(f'''string_split({body}, '{by}')[1]'''))}) || '=' || {_strip_sql(f'''string_split({body}, '{by}')[2]''')} END"
    quotes = lambda x: f"""regexp_replace({x}, '^"+|"+$', '', 'g')"""
    stars = lambda x: _strip_sql(rf"regexp_replace({x}, '^\*+|\*+$', '', 'g')")
    dashed = "regexp_replace(y, '^[- ]+', '')"
    line = rf"""CASE WHEN starts_with(y, '(') AND ends_with(y, ')') THEN {two("regexp_replace(y, '^[()]+|[()]+$', '', 'g')", ',', quotes)} WHEN contains(y, '**') AND contains(y, ':') THEN {two(dashed, ':', stars)} WHEN contains(y, '"') AND contains(y, ',') THEN {two('y', ',', quotes)}
 WHEN starts_with(y, '"') AND contains(y, ':') THEN {two('y', ':', quotes)} WHEN starts_with(y, '-') AND contains(y, ':') THEN {two(dashed, ':', quotes)} END"""
    block = r"regexp_extract_all(response, '(?s)```(?:python)?\s*\n?(.*?)\n?```', 1)[-1]"
    return rf"""WITH c AS ({firsts}), p AS (SELECT graph_id, {_pairs_sql('first_time', 1)} FROM c GROUP BY graph_id), r AS (SELECT graph_id, {SAID['time']} AS response FROM p), m AS (SELECT graph_id, coalesce({_strip_sql(block)}, {_after_sql('response')}, {_after_sql('response', '**Answer:**')}, {_after_sql('response', '### Final Answer')}) AS x FROM r),
f AS (SELECT graph_id, x, {_strip_sql(r"regexp_replace(x, '</?\w+>', '', 'g')")} AS y0 FROM m), d AS (SELECT graph_id, x, CASE WHEN regexp_matches(replace(y0, chr(39), '"'), {_lit(parsing.LITERAL)}) THEN {_pair_lists_sql("replace(y0, chr(39), '\"')")} ELSE [] END AS listed, [{_strip_sql('w')} FOR w IN string_split(y0, {NL})] AS ls FROM f),
l AS (SELECT graph_id, x, CASE WHEN len(listed) > 0 THEN listed ELSE [z FOR z IN [{line} FOR y IN ls] IF z IS NOT NULL] END AS said FROM d), k AS (SELECT graph_id, split_part(y, '=', 1) AS motif_name, CAST(split_part(y, '=', 2) AS BIGINT) AS n, row_number() OVER (PARTITION BY graph_id, split_part(y, '=', 1) ORDER BY i) AS o FROM (SELECT graph_id, unnest(said) AS y, generate_subscripts(said, 1) AS i FROM l)),
s AS (SELECT c.graph_id, sum(CASE WHEN n = first_time THEN 1 ELSE 0 END) / count(*) AS metric FROM c LEFT JOIN (SELECT * FROM k WHERE o = 1) k USING (graph_id, motif_name) GROUP BY c.graph_id)
SELECT l.graph_id, CASE WHEN x IS NULL OR x = '' THEN -1.0::DOUBLE ELSE round(metric, 9) END AS metric FROM l JOIN s USING (graph_id)"""


def registered(sql: dict[str, str]) -> list[tuple[str, Callable, str | None]]:
    """Queries by name; ``sql`` has the truths' SQL of queries registered before."""
    te = f"WITH {EDGES_SQL}"
    near = lambda df: df.withColumn("metric", F.round("metric", 9))

    def on_log(run: Callable[[DataFrame], DataFrame]) -> Callable:
        return lambda s, d: run(temporal_edges(one_shuffle(s), d))

    def contain(te: DataFrame) -> DataFrame:
        truth = motifs.judge(te, "triangle")
        return scoring.score_yes_no(truth, _said("contain", truth.withColumnRenamed("answer", "a")))

    def judge(te: DataFrame) -> DataFrame:
        truth = cut(motifs.multi_judge(te), "truth")  # read by the answers and by the scorer
        return scoring.score_multi_judge(truth, _said("judge", truth.withColumnRenamed("motifs", "a")))

    def count(te: DataFrame) -> DataFrame:
        truth = cut(motifs.multi_count(te), "truth")
        return near(scoring.score_multi_count(truth, _said("count", _pairs(truth, "n_instances", 1))))

    def first(te: DataFrame) -> DataFrame:
        truth = cut(motifs.multi_first_time(te), "truth")
        return near(scoring.score_first_time(truth, _said("time", _pairs(truth, "first_time", 1))))

    flat = lambda c: F.array_join(F.transform(c, lambda q: F.concat_ws(",", q["u"].cast("string"), q["v"].cast("string"), q["t"].cast("string"), q["op"])), " ")
    pairs = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws("=", p["name"], p["n"].cast("string"))), " ")

    def read(answers: Callable[[DataFrame], DataFrame], parser: Callable, show: Callable = flat) -> Callable:
        return on_log(lambda te: answers(te).select("graph_id", show(parser(F.col("response"))).alias("parsed")))

    def instead(query: str, select: str) -> str:
        """The query's chain with another last SELECT: what was parsed in place of the metric."""
        return query[: query.rindex("\nSELECT")] + f"\nSELECT graph_id, {select}"

    def form(texts: list[str], marked: str = "") -> F.Column:
        """Each event's text, of the form that its place chooses; x, y, u, v, t and o are the event's numbers and letter."""
        choice = F.lit(None).cast("string")
        for k, text_ in reversed(list(enumerate(texts))):
            pieces = [F.lit(x) if i % 2 == 0 else F.col({"x": "t", "y": "_y", "o": "op"}.get(x, x)).cast("string") for i, x in enumerate(re.split(r"<(\w)>", text_))]
            choice = F.when(F.col("seq") % len(texts) == k, F.concat(F.lit(marked if text_ not in UNMARKED else ""), *pieces)).otherwise(choice)
        return choice

    def known(texts: list[str], parser: Callable, show: Callable, marked: str = "") -> Callable:
        return on_log(lambda te: te.withColumn("_y", F.col("t") + F.col("seq")).select("graph_id", "seq", show(parser(form(texts, marked))).alias("parsed")))

    both = f"WITH {EDGES_SQL}, {DIRECTED_SQL}"
    talk = lambda s, d: s.read.parquet(f"{d}/conversations.parquet")
    loose = lambda te: te.select("graph_id", "seq", F.concat(F.lit("Thought. Answer: ("), F.concat_ws(", ", "u", "v", "t", "op"), F.lit(") or ["), F.concat_ws(",", "v", "u", "t"), F.lit(",'d']")).alias("r"))
    return [
        ("parse_yes_no", lambda s, d: talk(s, d).select("conv_id", "turn", parsing.yes_no(F.concat(F.col("text"), F.when(F.col("turn") % 2 == 0, " Yes.").otherwise(" no way"))).alias("answer")),
         r"SELECT conv_id, turn, nullif(regexp_extract(lower(trim(text || CASE WHEN turn % 2 = 0 THEN ' Yes.' ELSE ' no way' END)), '\b(yes|no)\b', 1), '') AS answer FROM conversations"),
        ("parse_quads", on_log(lambda te: loose(te).select("graph_id", "seq", flat(parsing.quads(parsing.after(F.col("r")))).alias("quads"))), te + " SELECT graph_id, seq, u || ',' || v || ',' || t || ',' || op || ' ' || v || ',' || u || ',' || t || ',d' AS quads FROM te"),
        ("parse_quads_sorted", read(sort_answers, parsing.quads_sorted), instead(_sort_sql(te), "array_to_string(q, ' ') AS parsed FROM o")),
        ("parse_quads_set", read(lambda te: what_answers(te, logs.edges_at(te, 9)), lambda r: F.array_sort(F.transform(parsing.quads_set(r), lambda q: F.struct(q["u"].cast("string").alias("u"), q["v"].cast("string").alias("v"), q["t"].cast("string").alias("t"), q["op"].alias("op"))))),
         instead(_what_sql(te, sql["edges_at_time"]), f"array_to_string([e.x FOR e IN list_sort([struct_pack(u := split_part(y, ',', 1), v := split_part(y, ',', 2), t := split_part(y, ',', 3), op := split_part(y, ',', 4), x := y) FOR y IN list_distinct({_matches_sql('x', parsing.TUPLE)})])], ' ') AS parsed FROM l")),
        ("parse_two_ints", read(lambda te: link_answers(link_truth(te)), parsing.two_ints, lambda c: F.array_join(c.cast("array<string>"), ",")), instead(_link_sql(sql["first_link_unlink_after"]), "got AS parsed FROM z")),
        ("parse_names", read(lambda te: _said("judge", motifs.multi_judge(te).withColumnRenamed("motifs", "a")), parsing.names, lambda c: F.array_join(c, " ")),
         instead(_judge_sql(sql["multi_motif_judge"]), f"CASE WHEN length(x) <= {parsing.LONGEST_NAME_LIST} THEN array_to_string(list_sort(said), ' ') END AS parsed FROM v")),
        ("parse_name_counts", read(lambda te: _said("count", _pairs(motifs.multi_count(te), "n_instances", 1)), parsing.name_counts, lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: F.concat_ws("=", p["name"], p["n"].cast("string"))))), " ")),
         instead(_count_sql(sql["multi_motif_counts"]), "array_to_string(list_sort(said), ' ') AS parsed FROM l")),
        ("parse_name_times", read(lambda te: _said("time", _pairs(motifs.multi_first_time(te), "first_time", 1)), parsing.name_times, pairs), instead(_time_sql(sql["multi_motif_first_time"]), "CASE WHEN x <> '' THEN array_to_string(said, ' ') END AS parsed FROM l")),
        ("parse_two_ints_forms", known(PAIR_FORMS, parsing.two_ints, lambda c: F.array_join(c.cast("array<string>"), ","), "(3, 4) Answer: "), te + " SELECT graph_id, seq, CASE WHEN seq % 10 < 8 THEN t || ',' || (t + seq) END AS parsed FROM te"),
        ("parse_quads_forms", known(QUAD_FORMS, parsing.quads_sorted, flat),
         te + " SELECT graph_id, seq, CASE seq % 6 WHEN 2 THEN u || ',' || v || ',' || t || ',' || op || ' ' || v || ',' || u || ',' || t || ',' || op WHEN 3 THEN '' WHEN 4 THEN u || ',' || v || ',' || t || ',' || op || ' ' || u || ',' || v || ',' || t || ',' || op WHEN 5 THEN '' ELSE u || ',' || v || ',' || t || ',' || op END AS parsed FROM te"),
        ("score_sort", on_log(lambda te: RUNS["sort_edge"][1](te)[1]), _sort_sql(te)),
        ("score_what_edges", on_log(lambda te: RUNS["what_edges"][1](te)[1]), _what_sql(te, sql["edges_at_time"])),
        ("score_link", on_log(lambda te: RUNS["when_link_and_dislink"][1](te)[1]), _link_sql(sql["first_link_unlink_after"])),
        ("score_reverse", on_log(lambda te: RUNS["reverse_graph"][1](te)[1]), _reverse_sql(te)),
        ("score_contain", on_log(contain), _contain_sql(sql["motif_judge_triangle"])),
        ("score_modify", on_log(lambda te: scoring.score_modify(te, modify_answers(te, "triangle"), "triangle")), _modify_sql(both, sql["motif_modify_triangle"], "triangle")),
        ("score_multi_judge", on_log(judge), _judge_sql(sql["multi_motif_judge"])),
        ("score_multi_count", on_log(count), _count_sql(sql["multi_motif_counts"])),
        ("score_first_time", on_log(first), _time_sql(sql["multi_motif_first_time"])),
    ]
