"""Mixing sources to target weights: hierarchical budgets, then a seeded token prefix of every leaf. Native only.

A tree of levels (say domain, language, source) has a weight for every node among its siblings. The token budget flows
down: at each node it is shared among the children in proportion to their weights, no child above what it can supply
(its leaves' tokens times ``max_epochs``); what a child can't supply goes to its siblings, in proportion again, and only
what all siblings together can't supply is left to the parent's siblings. As a node's capacity is the sum of its
leaves', the shares top-down are exactly that. Sharing with capacities is water filling: children sorted by
capacity / weight, the saturated ones are a prefix, found with running sums. Sums are exact decimals. Children of equal
capacity / weight are added up first, and running sums go in two steps, over the ratios inside a power of 2 ** (1 / 64) and
over those powers, so a parent of very many children (hosts, say) is no single task. Shares are rounded down: at a node with
m unsaturated children, up to m - 1 tokens of its budget stay undealt.

A leaf's budget buys whole epochs (every document once) and then a prefix of one more epoch, in which the leaf's documents
stand in an order seeded by ``seed`` and the epoch's number. Documents are taken while their running token sum
stays within the rest. To find the prefix without sorting a leaf in one task, documents fall into ``buckets`` ranges of
their order hash: bucket sums tell which buckets are wholly in; only the bucket where the budget ends is sorted. That
holds for a leaf with a third of all rows. The leaf table joins as Spark's size check allows (broadcast below
spark.sql.autoBroadcastJoinThreshold, else a skew-split sort-merge join).

Defined cases: null level values are nodes of their own; values without a weight get ``default_weight``; a weight of 0
gets nothing; documents without words have 0 tokens and cost nothing, so they are taken when their place in the order
is within the prefix; an empty table
gives no rows; documents with the same id stand or fall together; extra columns pass through ``mix`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronomotif.llm.common import dropped, written

BIG = "decimal(38,0)"


def word_tokens(text: Column) -> Column:
    """The default measure of a document: its words."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+"))).cast("long")


def _weight(level: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, weight in table.items():
        out = F.when(level == name, F.lit(weight)).otherwise(out)
    return out.cast(BIG)


def _same(left: list[str], right: list[str]) -> Column:
    """Whether columns agree, nulls too."""
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def _renamed(names: list[str], to: str) -> tuple[list[Column], list[str]]:
    new = [f"{to}{i}" for i in range(len(names))]
    return [F.col(c).alias(n) for c, n in zip(names, new, strict=True)], new


def _shares(nodes: DataFrame, path: list[str]) -> DataFrame:
    """(path as _k0.., _share): the budget ``_nb`` of each parent dealt to its children by weight ``_w``, none above its capacity ``_nc``. ``path`` ends with the children's level."""
    parent = path[:-1]
    nodes = nodes.withColumn("_r", F.when(F.col("_w") > 0, F.col("_nc").cast("double") / F.col("_w").cast("double")).otherwise(F.lit(float("inf"))))
    power = F.when(F.col("_r") == 0, -100_000).when(F.col("_r") == float("inf"), 100_000).otherwise(F.floor(F.log2("_r") * 64)).cast("int")
    groups = nodes.groupBy(*parent, "_r").agg(F.sum("_nc").cast(BIG).alias("_gc"), F.sum("_w").cast(BIG).alias("_gw"), F.first("_nb").alias("_nb")).withColumn("_q", power)
    inside = W.partitionBy(*parent, "_q").orderBy("_r")
    groups = groups.withColumn("_c", F.coalesce(F.sum("_gc").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast(BIG))
    groups = groups.withColumn("_v", F.sum("_gw").over(inside.rowsBetween(0, W.unboundedFollowing)).cast(BIG))
    powers = groups.groupBy(*parent, "_q").agg(F.sum("_gc").cast(BIG).alias("_pc"), F.sum("_gw").cast(BIG).alias("_pw"))
    over = W.partitionBy(*parent).orderBy("_q")  # some thousands of powers at most
    shown, names = _renamed(parent, "_p")
    powers = powers.select(
        *shown, F.col("_q").alias("_pq"), F.coalesce(F.sum("_pc").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast(BIG).alias("_before"),
        F.coalesce(F.sum("_pw").over(over.rowsBetween(1, W.unboundedFollowing)), F.lit(0)).cast(BIG).alias("_after"),
    )
    full = F.col("_gc") * (F.col("_v") + F.col("_after")) <= (F.col("_nb") - F.col("_before") - F.col("_c")) * F.col("_gw")
    judged = groups.join(powers, _same([*parent, "_q"], [*names, "_pq"])).select(*parent, "_r", "_gc", "_gw", full.alias("_full"))
    totals = judged.groupBy(*parent).agg(F.coalesce(F.sum(F.when(F.col("_full"), F.col("_gc"))), F.lit(0)).cast(BIG).alias("_cf"), F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_gw"))), F.lit(0)).cast(BIG).alias("_wf"))
    totals = totals.select(*_renamed(parent, "_t")[0], "_cf", "_wf")
    judged = judged.select(*_renamed(parent, "_j")[0], F.col("_r").alias("_jr"), "_full")
    out = nodes.join(judged, _same([*parent, "_r"], [*_renamed(parent, "_j")[1], "_jr"])).join(totals, _same(parent, _renamed(parent, "_t")[1]))
    share = F.when(F.col("_full"), F.col("_nc")).when(F.col("_wf") > 0, F.expr("((_nb - _cf) * _w) div _wf")).otherwise(F.lit(0))
    return out.select(*_renamed(path, "_k")[0], F.greatest(share, F.lit(0)).cast(BIG).alias("_share"))


def budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], budget: Column, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """``leaves`` (levels, tokens) with a ``budget`` column; one row a leaf. ``budget`` may use the column ``_all`` (all tokens)."""
    open_ = F.lit(True)  # below a weight of 0 nothing can be used
    for level, table in zip(levels, weights, strict=True):
        open_ = open_ & (_weight(F.col(level), table, default_weight) > 0)
    df = leaves.withColumn("_cap", F.when(open_, F.col("tokens") * max_epochs).otherwise(0).cast(BIG))
    df = written(df, "mix-leaves")
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("all")).first()
    df, last = df.withColumn("_root", F.lit(0)).withColumn("_all", F.lit(size["all"]).cast("long")), df
    df = df.withColumn("_b0", F.least(budget.cast(BIG), (F.col("_all") * max_epochs).cast(BIG)))
    for k, level in enumerate(levels):
        path = ["_root", *levels[: k + 1]]
        w = _weight(F.col(level), weights[k], default_weight)
        nodes = df.groupBy(*path).agg(F.sum("_cap").cast(BIG).alias("_nc"), F.first("_b0").alias("_nb")).withColumn("_w", w)
        nodes = nodes.withColumn("_nc", F.when(F.col("_w") > 0, F.col("_nc")).otherwise(F.lit(0).cast(BIG)))
        names = _renamed(path, "_k")[1]
        df = written(df.join(_shares(nodes, path), _same(path, names)).withColumn("_b0", F.col("_share")).drop("_share", *names), "mix-level", rows=size["n"])
        dropped(last)
        last = df
    return df.select(*levels, "tokens", F.col("_b0").cast("long").alias("budget"))


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]], budget: Column, max_epochs: int = 1, seed: int = 0, tokens: Column | None = None, id_col: str = "doc_id", text: str = "text", buckets: int = 4096, default_weight: int = 1) -> DataFrame:
    """The chosen documents: column ``row`` (the input row as a struct), the level columns, ``tokens`` and ``copies``.

    ``levels`` names the tree's levels from the root and how to compute them; ``weights`` holds one table a level.
    """
    names = list(levels)
    keys = [f"_l{i}" for i in range(len(names))]
    shown = [c.alias(k) for k, c in zip(keys, levels.values(), strict=True)]
    size = word_tokens(F.col(text)) if tokens is None else tokens
    narrow = written(docs.select(*shown, size.alias("_n"), F.col(id_col).alias("_id")), "mix-sizes")  # the texts are read once here and once at the end
    plan = budgets(narrow.groupBy(*keys).agg(F.sum("_n").alias("tokens")), keys, weights, budget, max_epochs, default_weight)
    plan = plan.withColumn("_whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0).cast("long")))
    plan = plan.withColumn("_rest", F.col("budget") - F.col("_whole") * F.col("tokens"))
    plan = plan.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)], "_whole", "_rest")

    def join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_p{i}"))
        return left.join(right, on, how).drop(*[f"_p{i}" for i in range(len(keys))])

    def order(whole: Column) -> Column:
        """60 bits, of the epoch after the whole ones."""
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), whole.cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
        return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")

    bits = (buckets - 1).bit_length()
    placed = join(narrow, plan).withColumn("_o", order(F.col("_whole"))).withColumn("_b", F.shiftright("_o", 60 - bits))
    # where each leaf's rest ends: running sums over the buckets of its order, then over the one bucket of the end
    sums = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_s"), F.first("_rest").alias("_r"))
    sums = sums.withColumn("_to", F.sum("_s").over(W.partitionBy(*keys).orderBy("_b")))
    ends = sums.where(F.col("_to") > F.col("_r")).groupBy(*keys).agg(F.min(F.struct("_b", (F.col("_to") - F.col("_s")).alias("_from"))).alias("_end"))
    ends = ends.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)], F.col("_end._b").alias("_eb"), F.col("_end._from").alias("_ef"))
    edge = join(placed, ends).where(F.col("_b") == F.col("_eb")).groupBy(*keys, "_o").agg(F.sum("_n").alias("_s"), F.first("_ef").alias("_ef"), F.first("_rest").alias("_rest"), F.first("_eb").alias("_eb"))
    edge = edge.withColumn("_c", F.col("_ef") + F.sum("_s").over(W.partitionBy(*keys).orderBy("_o")))
    floor = F.shiftleft(F.col("_eb"), 60 - bits) - 1  # just below the end's bucket
    cuts = edge.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_c") <= F.col("_rest"), F.col("_o"))), F.first(floor)).alias("_cut"))
    cuts = cuts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_cut")
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"_p{i}").eqNullSafe(F.col(f"_k{i}"))
    leaves = written(plan.join(cuts, on, "left").select(*[f"_p{i}" for i in range(len(keys))], "_whole", "_cut"), "mix-cuts", rows=plan.count())

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *shown, size.alias("_n"), F.col(id_col).alias("_id"))
    rows = join(rows, leaves)
    taken = F.col("_cut").isNull() | (order(F.col("_whole")) <= F.col("_cut"))
    out = rows.withColumn("copies", F.col("_whole") + taken.cast("long")).where(F.col("copies") > 0)
    return out.select(F.col("_row").alias("row"), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_n").alias("tokens"), "copies")


def mix_sql(source: str, levels: dict[str, str], weights: list[dict[str, int]], budget: str, max_epochs: int, seed: int, default_weight: int = 1) -> str:
    """DuckDB SQL for (doc_id, levels, tokens, copies) of ``mix``; ``levels`` and ``budget`` are SQL here, running sums are plain."""
    keys = list(levels)
    weight = lambda k: "CASE " + " ".join(f"WHEN {keys[k]} = '{n}' THEN {v}" for n, v in weights[k].items()) + f" ELSE {default_weight} END" if weights[k] else str(default_weight)
    usable = " AND ".join(f"{weight(k)} > 0" for k in range(len(keys)))
    out = [
        "WITH m AS (SELECT doc_id, " + ", ".join(f"{sql} AS {k}" for k, sql in levels.items()) + rf", CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM {source})",
        f"f AS (SELECT {', '.join(keys)}, CAST(sum(tokens) AS HUGEINT) AS t, CASE WHEN {usable} THEN CAST(sum(tokens) AS HUGEINT) * {max_epochs} ELSE 0 END AS cap FROM m GROUP BY {', '.join(keys)})",
        f"d0 AS (SELECT f.*, least(CAST({budget} AS HUGEINT), _all * {max_epochs}) AS b FROM f, (SELECT CAST(sum(tokens) AS HUGEINT) AS _all FROM m))",
    ]
    for k, level in enumerate(keys):
        path, parent = ", ".join(keys[: k + 1]), ", ".join(keys[:k]) or "1"
        w = weight(k)
        over = f"OVER (PARTITION BY {parent} ORDER BY CASE WHEN w > 0 THEN CAST(nc AS DOUBLE) / w ELSE CAST('inf' AS DOUBLE) END, {level} NULLS FIRST"
        on = " AND ".join(f"d{k}.{c} IS NOT DISTINCT FROM s{k}.{c}" for c in keys[: k + 1])
        out += [
            f"n{k} AS (SELECT {path}, CAST(sum(cap) AS HUGEINT) AS c0, any_value(b) AS nb, CAST({w} AS HUGEINT) AS w FROM d{k} GROUP BY {path})",
            f"c{k} AS (SELECT *, CASE WHEN w > 0 THEN c0 ELSE 0 END AS nc FROM n{k})",
            f"r{k} AS (SELECT *, coalesce(sum(nc) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb, sum(w) {over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wr FROM c{k})",
            f"u{k} AS (SELECT *, min(CASE WHEN nc * wr <= (nb - cb) * w THEN 1 ELSE 0 END) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fu FROM r{k})",
            f"v{k} AS (SELECT *, coalesce(sum(nc) FILTER (fu = 1) OVER (PARTITION BY {parent}), 0) AS cf, coalesce(sum(w) FILTER (fu = 0) OVER (PARTITION BY {parent}), 0) AS wf FROM u{k})",
            f"s{k} AS (SELECT {path}, greatest(CASE WHEN fu = 1 THEN nc WHEN wf > 0 THEN ((nb - cf) * w) // wf ELSE 0 END, 0) AS share FROM v{k})",
            f"d{k + 1} AS (SELECT d{k}.* EXCLUDE (b), share AS b FROM d{k} JOIN s{k} ON {on})",
        ]
    on = " AND ".join(f"m.{c} IS NOT DISTINCT FROM p.{c}" for c in keys)
    out += [
        f"p AS (SELECT {', '.join(keys)}, CASE WHEN t > 0 THEN b // t ELSE 0 END AS whole, b - CASE WHEN t > 0 THEN b // t ELSE 0 END * t AS rest FROM d{len(keys)})",
        f"o AS (SELECT m.*, whole, rest, CAST('0x' || substr(md5('{seed}:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS o FROM m JOIN p ON {on})",
        f"q AS (SELECT *, sum(tokens) OVER (PARTITION BY {', '.join(keys)} ORDER BY o) AS c FROM o)",
    ]
    return ",\n".join(out) + f"\nSELECT doc_id, {', '.join(keys)}, tokens, CAST(whole + CASE WHEN c <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM q WHERE whole + CASE WHEN c <= rest THEN 1 ELSE 0 END > 0"
