"""The structural profile of each graph (add events only) and statistics of a set of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronomotif.plans.motif import is_small
from chronomotif.sources.tables import cut, shuffles_dropped, uncut


def static_edges(te: DataFrame) -> DataFrame:
    return te.where("op = 'a' AND u <> v").select("graph_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct()


def degrees(te: DataFrame) -> DataFrame:
    """(graph_id, node, degree) on the simple graph."""
    ends = static_edges(te).select("graph_id", F.explode(F.array("lo", "hi")).alias("node"))
    return ends.groupBy("graph_id", "node").agg(F.count("*").alias("degree"))


#: Connected pairs of a graph whose components are found by a fold in one row.
FOLD_EDGES = 1000


def components(te: DataFrame, large_graphs: bool = False, fold_edges: int | None = None) -> DataFrame:
    """(graph_id, n_components) of graphs of any size.

    A fold over a graph's edges merges labels in one row where it has at most ``fold_edges`` connected pairs; larger ones, and
    all with ``large_graphs``, pass labels along edges.
    """
    if large_graphs:
        return _components_by_labels(static_edges(te))
    if fold_edges is None:
        if is_small(te):
            return _components_by_fold(static_edges(te))
        fold_edges = FOLD_EDGES
    edges = cut(static_edges(te), "static-edges")
    large = edges.groupBy("graph_id").agg(F.count("*").alias("_n")).where(F.col("_n") > fold_edges).select("graph_id")
    folded = _components_by_fold(edges.join(large, "graph_id", "left_anti"))
    return folded if large.isEmpty() else folded.unionByName(_components_by_labels(edges.join(large, "graph_id", "left_semi")))


def _components_by_labels(edges: DataFrame) -> DataFrame:
    return _labels(edges).groupBy("graph_id").agg(F.count_distinct("root").alias("n_components"))


def _components_by_fold(edges: DataFrame) -> DataFrame:
    edges = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("e"))
    nodes = F.array_distinct(F.concat(F.transform("e", lambda x: x["lo"]), F.transform("e", lambda x: x["hi"])))
    merge = lambda m, x: F.transform_values(m, lambda k, v: F.when(v == m[x["hi"]], m[x["lo"]]).otherwise(v))
    labels = F.aggregate("e", F.map_from_arrays(nodes, nodes), merge)
    return edges.select("graph_id", F.size(F.array_distinct(F.map_values(labels))).cast("long").alias("n_components"))


def component_labels(te: DataFrame) -> DataFrame:
    """(graph_id, node, root): the least node of each node's component, by passing labels along edges and jumping to the label's label."""
    return _labels(static_edges(te))


def _labels(pairs: DataFrame) -> DataFrame:
    """Labels of ``static_edges``. Each pass is a table of its own and the one before it deleted, so neither lineage nor disk nor any row grows with the passes.

    A label table's files can be a hundredth of what a broadcast of it takes, so Spark takes it for small: merge joins keep it out of the driver.
    """
    ways = F.explode(F.array(F.struct("lo", "hi"), F.struct(F.col("hi").alias("lo"), F.col("lo").alias("hi"))))
    with shuffles_dropped(pairs.sparkSession):
        edges = cut(pairs.select("graph_id", ways.alias("e")).select("graph_id", F.col("e.lo").alias("node"), F.col("e.hi").alias("other")), "edges")
        table = cut(edges.groupBy("graph_id", "node").agg(F.least("node", F.min("other")).alias("root")).withColumn("old", F.lit(None).cast(edges.schema["node"].dataType)), "labels")
        while True:
            labels = table.select("graph_id", "node", "root")
            heard = edges.join(labels.withColumnRenamed("node", "other").hint("merge"), ["graph_id", "other"]).groupBy("graph_id", "node").agg(F.min("root").alias("heard"))
            lower = labels.join(heard.hint("merge"), ["graph_id", "node"]).select("graph_id", "node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
            jump = labels.select("graph_id", F.col("node").alias("root"), F.col("root").alias("further"))
            new = cut(lower.join(jump.hint("merge"), ["graph_id", "root"]).select("graph_id", "node", "old", F.least("root", "further").alias("root")), "labels")
            uncut(table)
            table = new
            if new.where("root <> old").isEmpty():
                uncut(edges)
                return new.select("graph_id", "node", "root")


def core_nodes(te: DataFrame) -> DataFrame:
    """Nodes with three neighbours or more."""
    return degrees(te).where("degree >= 3").select("graph_id", "node")


def node_events(te: DataFrame) -> DataFrame:
    """(graph_id, node, seq, t): an add event for each of its ends; seq counts all events of the log."""
    placed = te.withColumn("pos", F.row_number().over(W.partitionBy("graph_id").orderBy("seq")) - 1)
    return placed.where("op = 'a' AND u <> v").select("graph_id", "pos", "t", F.explode(F.array("u", "v")).alias("node"))


def locality(te: DataFrame) -> DataFrame:
    """(graph_id, edge_locality_score): mean over core nodes with two add events or more of the deviation of their places."""
    spread = node_events(te).join(core_nodes(te), ["graph_id", "node"], "left_semi").groupBy("graph_id", "node").agg(F.stddev_pop("pos").alias("s"), F.count("*").alias("n"))
    return spread.where("n >= 2").groupBy("graph_id").agg(F.avg("s").alias("edge_locality_score"))


def clashes(te: DataFrame) -> DataFrame:
    """(graph_id, temporal_clash_count): pairs of add events of a core node at the same time."""
    same = node_events(te).join(core_nodes(te), ["graph_id", "node"], "left_semi").groupBy("graph_id", "node", "t").agg(F.count("*").alias("c"))
    return same.groupBy("graph_id").agg(F.sum(F.expr("c * (c - 1) div 2")).alias("temporal_clash_count"))


def profile(te: DataFrame, fold_edges: int | None = None) -> DataFrame:
    """The ten features of every graph, of any size (``components``); without add events all 0 but cyclomatic_complexity, which is 1."""
    deg = degrees(te).groupBy("graph_id").agg(
        F.count("*").alias("num_nodes"), (F.sum("degree") / 2).cast("long").alias("num_edges"),
        F.count_if(F.col("degree") >= 3).alias("num_nodes_ge_3"), F.count_if(F.col("degree") == 2).alias("num_nodes_eq_2"),
    )
    df = te.select("graph_id").distinct()
    for part in (deg, components(te, fold_edges=fold_edges), locality(te), clashes(te)):
        df = df.join(part, "graph_id", "left")
    n, e = F.col("num_nodes"), F.col("num_edges")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.select(
        "graph_id",
        zero(n).alias("num_nodes"),
        zero(e).alias("num_edges"),
        F.round(F.when(n > 1, e / (n * (n - 1) / 2)).otherwise(0.0), 6).alias("edge_density"),
        zero(F.col("num_nodes_ge_3")).alias("num_nodes_ge_3"),
        zero(F.col("num_nodes_eq_2")).alias("num_nodes_eq_2"),
        F.coalesce(e - n + F.col("n_components"), F.lit(1)).alias("cyclomatic_complexity"),
        F.round(F.coalesce("edge_locality_score", F.lit(0.0)), 6).alias("edge_locality_score"),
        zero(F.col("temporal_clash_count")).alias("temporal_clash_count"),
        F.round(F.coalesce(F.col("num_nodes_ge_3") / n, F.lit(0.0)), 6).alias("ratio_nodes_ge_3"),
        F.round(F.coalesce(F.col("num_nodes_eq_2") / n, F.lit(0.0)), 6).alias("ratio_nodes_eq_2"),
    )


def dataset_stats(te: DataFrame) -> DataFrame:
    """One row a measure (nodes, edges, timestamps): count, min, max, mean and population deviation over graphs."""
    per = te.groupBy("graph_id").agg(F.count("*").alias("edges"), F.countDistinct("t").alias("timestamps"))
    nodes = te.select("graph_id", F.explode(F.array("u", "v")).alias("n")).groupBy("graph_id").agg(F.countDistinct("n").alias("nodes"))
    long = per.join(nodes, "graph_id").select(F.expr("stack(3, 'nodes', nodes, 'edges', edges, 'timestamps', timestamps) AS (measure, x)"))
    return long.groupBy("measure").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("deviation"))


def timestamp_histogram(te: DataFrame) -> DataFrame:
    return te.groupBy("t").agg(F.count("*").alias("n_events"))
