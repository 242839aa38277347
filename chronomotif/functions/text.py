"""Text of questions: rendered logs and answers, prompts, folder and configuration names."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomotif.functions import parsing
from chronomotif.plans import catalog
from chronomotif.sources.events import EDGES_SQL, temporal_edges

#: What a motif is, how a log is written (by number), and for each task what is asked for and in which form.
ROLE = "You analyse dynamic graphs and know how their structure changes over time."
GRAPH_FORMATS = {
    0: "A dynamic graph is a list of 4-tuples: (u, v, t, a) connects nodes u and v at time t, (u, v, t, d) disconnects them.",
    1: "In an undirected dynamic graph (u, v, t, a) adds an edge between u and v at time t and (u, v, t, d) deletes it.",
    2: "In an undirected dynamic graph a quadruple (u, v, t, op) is an event of the edge between u and v at time t; op is a for adding it and d for deleting it.",
}
MOTIF_MEANING = "A k-node, l-edge temporal motif is a sequence of l edge additions with strictly rising times on k nodes in a given pattern, from first to last within a time window. Node numbers and exact times don't matter."
TASKS = {
    "sort_edge": ("Sort the edges by time from earliest to latest.", "Answer with a list of 4-tuples after 'Answer:'."),
    "what_edges": ("What edges exist at time {0}?", "Answer with a list of 4-tuples after 'Answer:'."),
    "when_link_and_dislink": ("When are node {0} and node {1} first connected, and after that first disconnected?", "Answer with two integers after 'Answer:'."),
    "reverse_graph": ("Which sequence of events takes the graph from its final state back to empty?", "Answer with a list of 4-tuples after 'Answer:'."),
    "judge_is_motif": ("Is the graph the temporal motif {0}?", "Answer Yes or No after 'Answer:'."),
    "judge_contain_motif": ("Does the graph contain the temporal motif {0}?", "Answer Yes or No after 'Answer:'."),
    "modify_motif": ("Which change makes the graph contain the temporal motif {0}?", "Answer with a list of 4-tuples after 'Answer:'."),
    "multi_motif_judge": ("Which of these temporal motifs are in the graph?", "Answer with their names after 'Answer:'."),
    "multi_motif_count": ("How often is each of these temporal motifs in the graph? Leave out those that aren't.", "Answer with a list of (name, number) after 'Answer:'."),
    "when_multi_motif_exist": ("At what time is each of these temporal motifs first complete in the graph? Leave out those that aren't.", "Answer with a list of (name, time) after 'Answer:'."),
}
STEPS = "Let's think step by step."
# The numbered hints of stored configurations.
IMPROVEMENTS = {
    0: "",
    24: "Pick time and then nodes.",
    25: "Pick nodes and then time.",
    26: "Take a deep breath and work on this problem step-by-step.",
    27: "Think nodes and then time.",
    28: "Think time and then nodes.",
}
# The keys of a configuration's suffix, in order, and their names in it.
CONFIG = {
    "add_cot": "cot", "add_role": "role", "k": "k", "dyg_type": "dyg", "edge_type": "edge", "imp": "imp", "short": "short", "temperature": "temperature",
    "max_tokens": "maxtokens", "motif_name": "motifname", "motif": "motif", "change": "change", "use_agent": "use_agent", "api": "api", "balance": "balance",
}


def render_events(events: Column) -> Column:
    """[(u, v, t, op), ...] of an array of structs."""
    one = lambda e: F.format_string("(%d, %d, %d, %s)", e["u"], e["v"], e["t"], e["op"])
    return F.concat(F.lit("["), F.array_join(F.transform(events, one), ", "), F.lit("]"))


def render_numbers(numbers: Column) -> Column:
    """[n, ...] of an array of integers."""
    return F.concat(F.lit("["), F.array_join(numbers.cast("array<string>"), ", "), F.lit("]"))


def contexts(te: DataFrame) -> DataFrame:
    """(graph_id, context): each graph's log as text, in log order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "u", "v", "t", "op")))
    return te.groupBy("graph_id").agg(ordered.alias("e")).select("graph_id", render_events(F.col("e")).alias("context"))


def motif_edges_text(motif: str) -> str:
    return "[" + ", ".join(f"(u{a}, u{b}, t{i}, a)" for i, (a, b) in enumerate(catalog.EDGES[motif])) + "]"


def motif_text(motif: str, window: int) -> str:
    edges = catalog.EDGES[motif]
    return f'"{motif}": a {catalog.n_nodes(edges)}-node, {len(edges)}-edge, {window}-temporal motif with the edges{motif_edges_text(motif)}'


def catalog_text(which: str = "default") -> str:
    return "\n".join(motif_text(m, catalog.WINDOWS[which][m]) for m in catalog.NAMES)


def examples(pairs: list[tuple[str, ...]], num: int | None = None, chain: bool = False) -> str:
    """Few-shot block of the first ``num`` (question, answer) or (question, answer, reasoning); with ``chain`` the reasoning stands before the answer."""
    some = list(pairs)[: len(pairs) if num is None else num]
    if not some:
        return ""
    head = "Here is an example: " if len(some) == 1 else f"Here are {len(some)} examples: "
    return head + "\n".join(f"Question: {q}\n{r[0]}\nAnswer: {a}\n" if chain and r else f"Question: {q} Answer: {a}\n" for q, a, *r in some)


def prompt_text(task: str, context: Column, arguments: list[Column | str] = (), improvement: int = 0, shots: list[tuple[str, ...]] = (), chain: bool = False, graph_format: int = 1, role: bool = False, with_motifs: bool = False) -> Column:
    """The prompt: eleven slots, a line each; blank lines squeezed, trimmed, one newline at the end. ``arguments`` fill the question's places."""
    if improvement not in IMPROVEMENTS:
        raise ValueError(f"no improvement text numbered {improvement}")
    if graph_format not in GRAPH_FORMATS:
        raise ValueError(f"no graph format numbered {graph_format}")
    ask, form = TASKS[task]
    question: list[Column] = []
    for i, piece in enumerate(re.split(r"\{\d\}", ask)):
        if i:
            question.append(arguments[i - 1].cast("string") if isinstance(arguments[i - 1], Column) else F.lit(arguments[i - 1]))
        question.append(F.lit(piece))
    slots = [ROLE if role else "", GRAPH_FORMATS[graph_format], MOTIF_MEANING if "motif" in task else "", catalog_text() if with_motifs else "", IMPROVEMENTS[improvement], form, examples(list(shots), chain=chain), "Here is what you need to answer:"]
    asked = F.concat(F.lit("Question: Given an undirected dynamic graph with the edges "), context, F.lit(". "), *question)
    body = F.concat_ws("\n", *[F.lit(x) for x in slots], asked, F.lit(STEPS if chain else ""), F.lit("Answer:"))
    return F.concat(F.regexp_replace(F.regexp_replace(body, r"\n\s*\n", "\n"), r"^\s+|\s+$", ""), F.lit("\n"))


def prompts(te: DataFrame, task: str, argument: str = "", **options) -> DataFrame:
    """(graph_id, prompt) of every log."""
    return contexts(te).select("graph_id", prompt_text(task, F.col("context"), [argument, argument], **options).alias("prompt"))


def config_suffix(options: dict[str, Column | str | float]) -> Column:
    """The suffix that names a configuration: all keys in their order, 0 where ``options`` lacks one."""
    value = lambda k: options[k].cast("string") if isinstance(options.get(k), Column) else F.lit(str(options.get(k, 0)))
    return F.concat(*[x for k, name in CONFIG.items() for x in (F.lit(f"_{name}"), value(k))])


def folder_name(times: Column, nodes: Column, p: Column, seed: Column, n_events: bool = False) -> Column:
    """T.._N.._p.._seed..; with ``n_events`` the third is a number of events: T.._N.._M.._seed..."""
    third = F.concat(F.lit("_M"), p.cast("int").cast("string")) if n_events else F.concat(F.lit("_p"), p.cast("string"))
    return F.concat(F.lit("T"), times.cast("string"), F.lit("_N"), nodes.cast("string"), third, F.lit("_seed"), seed.cast("string"))


def registered() -> list[tuple[str, Callable, str | None]]:
    ctx = "'[' || string_agg('(' || u || ', ' || v || ', ' || t || ', ' || op || ')', ', ' ORDER BY seq) || ']'"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    lead = " || chr(10) || ".join(quoted(x) for x in (GRAPH_FORMATS[1], TASKS["sort_edge"][1], "Here is what you need to answer:"))
    plain = f"SELECT graph_id, {lead} || chr(10) || 'Question: Given an undirected dynamic graph with the edges ' || {ctx} || '. ' || {quoted(TASKS['sort_edge'][0])} || chr(10) || 'Answer:' || chr(10) AS prompt FROM te GROUP BY graph_id"
    shots = [("one?", "[]", "because"), ("two?", "[1]", "so")]
    full = [ROLE, GRAPH_FORMATS[2], MOTIF_MEANING, *catalog_text().split("\n"), IMPROVEMENTS[26], TASKS["judge_contain_motif"][1], "Here are 2 examples: Question: one?", "because", "Answer: []", "Question: two?", "so", "Answer: [1]", "Here is what you need to answer:"]
    rich = f"SELECT graph_id, {' || chr(10) || '.join(quoted(x) for x in full)} || chr(10) || 'Question: Given an undirected dynamic graph with the edges ' || {ctx} || '. Does the graph contain the temporal motif triangle?' || chr(10) || {quoted(STEPS)} || chr(10) || 'Answer:' || chr(10) AS prompt FROM te GROUP BY graph_id"
    asked: dict[str, list[str]] = {"what_edges": ["graph_id % 20"], "when_link_and_dislink": ["graph_id % 12", "(graph_id * 5 + 1) % 12"]}  # what fills each question's places, as SQL
    asked |= {t: ["'4-cycle'"] for t in ("judge_is_motif", "judge_contain_motif", "modify_motif")}

    def task_prompts(task: str) -> Callable:
        return lambda s, d: contexts(temporal_edges(s, d)).select("graph_id", prompt_text(task, F.col("context"), list(map(F.expr, asked.get(task, []))), with_motifs=task.startswith(("multi", "when_multi"))).alias("prompt"))

    def task_sql(task: str) -> str:
        ask, form = TASKS[task]
        lines = [GRAPH_FORMATS[1], *([MOTIF_MEANING] if "motif" in task else []), *(catalog_text().split("\n") if task.startswith(("multi", "when_multi")) else []), form, "Here is what you need to answer:"]
        filled = quoted(ask)
        for i, value in enumerate(asked.get(task, [])):
            filled = filled.replace(f"{{{i}}}", f"' || {value} || '")
        return f"WITH {EDGES_SQL} SELECT graph_id, {' || chr(10) || '.join(map(quoted, lines))} || chr(10) || 'Question: Given an undirected dynamic graph with the edges ' || {ctx} || '. ' || {filled} || chr(10) || 'Answer:' || chr(10) AS prompt FROM te GROUP BY graph_id"

    suffix = lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", config_suffix({"add_cot": F.col("s_suppkey") % 2, "k": F.col("s_nationkey"), "temperature": "0.0", "motif_name": "triangle", "api": 1}).alias("suffix"))
    folders = lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", folder_name(F.lit(5), F.col("s_nationkey"), F.lit("0.3"), F.col("s_suppkey")).alias("by_p"), folder_name(F.lit(5), F.col("s_nationkey"), F.lit(20), F.col("s_suppkey"), True).alias("by_m"))
    return [
        *[(f"prompt_task_{t}", task_prompts(t), task_sql(t)) for t in TASKS],
        ("prompt_context", lambda s, d: contexts(temporal_edges(s, d)), f"WITH {EDGES_SQL} SELECT graph_id, {ctx} AS context FROM te GROUP BY graph_id"),
        ("prompt_question", lambda s, d: prompts(temporal_edges(s, d), "judge_contain_motif", "triangle", improvement=26, shots=shots, chain=True, role=True).select("graph_id", parsing.question(F.col("prompt")).alias("question")),
         f"WITH {EDGES_SQL} SELECT graph_id, 'Given an undirected dynamic graph with the edges ' || {ctx} || '. Does the graph contain the temporal motif triangle?' || chr(10) || {quoted(STEPS)} AS question FROM te GROUP BY graph_id"),
        ("prompt_full", lambda s, d: prompts(temporal_edges(s, d), "sort_edge"), f"WITH {EDGES_SQL} {plain}"),
        ("prompt_with_examples", lambda s, d: prompts(temporal_edges(s, d), "judge_contain_motif", "triangle", improvement=26, shots=shots, chain=True, graph_format=2, role=True, with_motifs=True), f"WITH {EDGES_SQL} {rich}"),
        ("prompt_config_suffix", suffix, "SELECT s_suppkey, '_cot' || s_suppkey % 2 || '_role0_k' || s_nationkey || '_dyg0_edge0_imp0_short0_temperature0.0_maxtokens0_motifnametriangle_motif0_change0_use_agent0_api1_balance0' AS suffix FROM supplier"),
        ("prompt_folder_names", folders, "SELECT s_suppkey, 'T5_N' || s_nationkey || '_p0.3_seed' || s_suppkey AS by_p, 'T5_N' || s_nationkey || '_M20_seed' || s_suppkey AS by_m FROM supplier"),
    ]
