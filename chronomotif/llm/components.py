"""Connected components of a link table, in tables: label passing with pointer jumping.

Each pass gives every node the least label among itself and its neighbours, then the label of its label. Every pass is
written to the shared folder and the one before it deleted, so lineage stays short and a lost executor costs one pass.
Least labels are taken map-side before the shuffle. Joins meet a hub's links, or a giant component's members, as one key on
their large side only, the other side has one row a key: Spark's skew join splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomotif.llm.common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every node of ``links`` (a, b); root is the least key of the component. A table of ``written``."""
    rows = 2 * links.count()
    edges = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
    edges = written(edges, "links-both", rows=rows)
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.lit(None).cast("bigint").alias("old"), F.least("a", "m").alias("root")), "labels", rows=rows)
    while True:
        now = labels.select("key", "root")
        heard = edges.join(now.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("heard"))
        lower = now.join(heard, "key").select("key", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = now.select(F.col("key").alias("root"), F.col("root").alias("further"))
        new = written(lower.join(jump, "root").select("key", "old", F.least("root", "further").alias("root")), "labels", rows=rows)
        done = new.where("root <> old").isEmpty()
        dropped(labels)
        labels = new
        if done:
            dropped(edges)
            return labels
