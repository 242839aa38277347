"""Routing: a classifier on five structural features sends each graph to a cheap or an expensive answering strategy.

The classifier is a sum of boosted regression trees. It is trained by Spark on what a run's scorer said of the cheap strategy's
answers, judged on graphs that training left out, kept as a small table of nodes, and applied as one Catalyst expression (or SQL
text) over the features: no model object, no user function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.operators import features, motifs, scoring
from chronomotif.operators.router_model import TREES
from chronomotif.sources import providers
from chronomotif.sources.events import EDGES_SQL, temporal_edges
from chronomotif.sources.tables import cut

FEATURES = ["num_edges", "cyclomatic_complexity", "edge_locality_score", "ratio_nodes_ge_3", "ratio_nodes_eq_2"]
THRESHOLDS = {"runner": 0.70, "tool": 0.5}
NODES = "tree int, node int, weight double, feature string, threshold double, left int, right int, value double"
FOLDS = 5


def train(table: DataFrame, seed: int = 7, trees: int = 5, depth: int = 3) -> list[tuple]:
    """Nodes of a gradient-boosted classifier on ``table`` (features, label 1 where the cheap strategy suffices): rows of ``NODES``, at most trees * 2 ** (depth + 1)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed)]).fit(table).stages[-1]
    rows: list[tuple] = []

    def walk(node, tree: int, weight: float) -> int:
        at = sum(r[0] == tree for r in rows)
        rows.append(())
        place = len(rows) - 1
        rows[place] = (tree, at, weight, None, None, None, None, float(node.prediction()))
        if node.getClass().getSimpleName() == "InternalNode":
            left, right = walk(node.leftChild(), tree, weight), walk(node.rightChild(), tree, weight)
            rows[place] = (tree, at, weight, FEATURES[node.split().featureIndex()], float(node.split().threshold()), left, right, None)
        return at

    for k, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        walk(tree._call_java("rootNode"), k, float(weight))
    return rows


def store(nodes: list[tuple], spark: SparkSession, path: str) -> None:
    spark.createDataFrame(nodes, NODES).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> list[tuple]:
    return [tuple(r) for r in spark.read.schema(NODES).parquet(path).orderBy("tree", "node").collect()]  # a small table by construction


def margin_sql(nodes: list[tuple]) -> str:
    """The sum of all trees as SQL text that Spark and DuckDB read; above 0 the class is 1."""

    def walk(tree: int, at: int) -> str:
        _, _, _, feature, threshold, left, right, value = by[tree, at]
        if feature is None:
            return f"CAST({value!r} AS DOUBLE)"
        return f"CASE WHEN {feature} <= CAST({threshold!r} AS DOUBLE) THEN {walk(tree, left)} ELSE {walk(tree, right)} END"

    by = {(r[0], r[1]): r for r in nodes}
    return " + ".join(f"CAST({by[k, 0][2]!r} AS DOUBLE) * ({walk(k, 0)})" for k in sorted({r[0] for r in nodes})) or "CAST(0.0 AS DOUBLE)"


def predict(nodes: list[tuple], table: DataFrame) -> DataFrame:
    """(graph_id, predicted, probability) of ``table``'s features."""
    margin = F.expr(margin_sql(nodes))
    return table.select("graph_id", (margin > 0).alias("predicted"), (1.0 / (1.0 + F.exp(-2.0 * margin))).alias("probability"))


def outcomes(te: DataFrame, answers: DataFrame, motif: str = "4-cycle") -> DataFrame:
    """(graph_id, label): 1 where the answer (graph_id, content) to whether the log contains the motif was scored right, else 0."""
    scored = scoring.score_yes_no(motifs.judge(te, motif), answers.select("graph_id", F.col("content").alias("response")))
    return scored.select("graph_id", (F.col("metric") == 1).cast("double").alias("label"))


def cheap_answers(prompts: list[str]) -> list[str]:
    """A strategy that only looks at how long the question is."""
    return ["Answer: Yes" if p.count(", a)") > 33 else "Answer: No" for p in prompts]


def labelled(te: DataFrame) -> DataFrame:
    """Features with the outcome of the cheap strategy's answers, and whether the graph is held out: one in ``FOLDS``, by a hash of its id."""
    from chronomotif.functions import text

    said = providers.answers(text.prompts(te, "judge_contain_motif", "4-cycle"), cheap_answers)
    held_out = F.crc32(F.col("graph_id").cast("string")) % FOLDS == 0
    return features.profile(te).join(outcomes(te, said), "graph_id").withColumn("held_out", held_out)


def decide(predicted: Column, probability: Column, rule: str = "runner") -> Column:
    """LLM where the class holds with a probability above the threshold, else Agent (also for nulls)."""
    return F.when(predicted & (probability > THRESHOLDS[rule]), "LLM").otherwise("Agent")


def training_table(te: DataFrame, errors: DataFrame, first: int | None = None) -> DataFrame:
    """Features with flag: 0 for graphs among the errors, else 1; ``first`` keeps that many graphs by id."""
    table = features.profile(te)
    if first is not None:
        table = table.orderBy("graph_id").limit(first)
    bad = errors.select("graph_id").distinct().withColumn("_b", F.lit(0))
    return table.join(bad, "graph_id", "left").withColumn("flag", F.coalesce("_b", F.lit(1))).drop("_b")


def route(te: DataFrame, nodes: list[tuple], rule: str = "runner") -> DataFrame:
    return predict(nodes, features.profile(te)).select("graph_id", decide(F.col("predicted"), F.col("probability"), rule).alias("strategy"))


def registered() -> list[tuple[str, Callable, str | None]]:
    from chronomotif import tools
    from chronomotif.queries import PROFILE_SQL

    def trained(s, d):
        """Trained on the graphs that aren't held out, decided for those that are."""
        table = cut(labelled(temporal_edges(s, d)), "router")
        return predict(train(table.where("NOT held_out")), table.where("held_out")).select("graph_id", decide(F.col("predicted"), F.col("probability")).alias("strategy"))

    chosen = lambda rule, key="graph_id": f"SELECT graph_id AS {key}, CASE WHEN m > 0 AND 1.0 / (1.0 + exp(-2.0 * m)) > {THRESHOLDS[rule]} THEN 'LLM' ELSE 'Agent' END AS strategy FROM (SELECT graph_id, {margin_sql(TREES)} AS m FROM fe)"
    ruled = lambda s, d: features.profile(temporal_edges(s, d)).select("graph_id", decide(F.col("num_edges") < 25, F.col("ratio_nodes_ge_3")).alias("strategy"))
    return [
        ("route_features", lambda s, d: features.profile(temporal_edges(s, d)).select("graph_id", *FEATURES), f"WITH {EDGES_SQL}, {PROFILE_SQL} SELECT graph_id, {', '.join(FEATURES)} FROM fe"),
        ("route_rule", ruled, f"WITH {EDGES_SQL}, {PROFILE_SQL} SELECT graph_id, CASE WHEN num_edges < 25 AND ratio_nodes_ge_3 > 0.7 THEN 'LLM' ELSE 'Agent' END AS strategy FROM fe"),
        ("route_training_table", lambda s, d: training_table(temporal_edges(s, d), s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("graph_id"))), f"WITH {EDGES_SQL}, {PROFILE_SQL} SELECT fe.*, CAST(CASE WHEN graph_id IN (SELECT s_suppkey FROM supplier) THEN 0 ELSE 1 END AS INT) AS flag FROM fe"),
        ("route_decision", lambda s, d: route(temporal_edges(s, d), TREES), f"WITH {EDGES_SQL}, {PROFILE_SQL} {chosen('runner')}"),
        ("route_probability", lambda s, d: predict(TREES, features.profile(temporal_edges(s, d))).select("graph_id", "predicted", F.round("probability", 9).alias("probability")), f"WITH {EDGES_SQL}, {PROFILE_SQL} SELECT graph_id, m > 0 AS predicted, round(1.0 / (1.0 + exp(-2.0 * m)), 9) AS probability FROM (SELECT graph_id, {margin_sql(TREES)} AS m FROM fe)"),
        ("tool_predict_strategy", lambda s, d: tools.predict_strategy(tools.inputs_of(temporal_edges(s, d)), TREES), f"WITH {EDGES_SQL}, {PROFILE_SQL} {chosen('tool', 'id')}"),
        ("route_trained_decision", trained, None),
    ]
