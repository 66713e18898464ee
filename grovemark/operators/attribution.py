"""Where a pair loses its score: each node's share of the deficit, as a query over the node table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.rows import spread

GRANULARITIES = ("leaf", "subtree", "all")


def attribution(nodes: DataFrame, granularity: str = "leaf", include_empty: bool = False) -> DataFrame:
    """pair_id, rank, path, score, weight, contribution, gold, pred, is_leaf, leaf_kind, node_kind, part, by pair.

    Leaves' contributions sum to 1 - score. rank: largest contribution first, in the order of the walk among equals. Nodes without
    weight are left out unless they are empty places and wanted. Invalid pairs have no entries.
    """
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}, not {granularity!r}")
    rows = nodes.where("valid")
    if granularity == "leaf":
        rows = rows.where("is_leaf")
    elif granularity == "subtree":
        rows = rows.where("NOT is_leaf OR parent_id IS NULL")
    rows = rows.where("weight > 0 OR kind = 'absent'" if include_empty else "weight > 0 AND (has_gold OR has_pred)")
    rows = rows.withColumn("contribution", F.col("weight") * (1 - F.col("score")))
    order = Window.partitionBy("pair_id").orderBy(F.desc("contribution"), "node_id")
    return spread(rows, "pair_id").select(
        "pair_id", F.row_number().over(order).alias("rank"), "path", "score", "weight", "contribution", "gold", "pred", "is_leaf",
        F.when(F.col("is_leaf"), F.col("kind")).alias("leaf_kind"), "node_type", F.when(~F.col("is_leaf"), F.col("kind")).alias("node_kind"), "part",
    )


def attribution_summary(nodes: DataFrame) -> DataFrame:
    """pair_id, score, explained, residual: what the leaves explain of the deficit; -1 as residual of an invalid pair."""
    leaf = F.col("is_leaf") & F.col("valid")
    out = nodes.groupBy("pair_id").agg(F.max("total").alias("score"), F.sum(F.when(leaf, F.col("weight") * (1 - F.col("score"))).otherwise(0.0)).alias("explained"), F.min("valid").alias("valid"))
    return out.select("pair_id", "score", "explained", F.when(F.col("valid"), F.col("explained") - (1 - F.col("score"))).otherwise(F.lit(-1.0)).alias("residual"))
