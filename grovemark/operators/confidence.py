"""Pairing confidence over the similarity table (container, i, j, score), as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def margin_confidence(sims: DataFrame, keys: list[str]) -> DataFrame:
    """Adds confidence to every cell: its score less the best other score in its row or column, cut to [0, 1]."""
    out = sims
    for side in ("i", "j"):
        own = Window.partitionBy(*keys, side)
        out = out.withColumn(f"_top_{side}", F.max("score").over(own))
        out = out.withColumn(f"_ties_{side}", F.sum((F.col("score") == F.col(f"_top_{side}")).cast("int")).over(own))
        out = out.withColumn(f"_next_{side}", F.max(F.when(F.col("score") < F.col(f"_top_{side}"), F.col("score"))).over(own))
        best_other = F.when((F.col("score") < F.col(f"_top_{side}")) | (F.col(f"_ties_{side}") > 1), F.col(f"_top_{side}")).otherwise(F.col(f"_next_{side}"))
        out = out.withColumn(f"_other_{side}", F.coalesce(best_other, F.lit(0.0)))
    out = out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") - F.greatest("_other_i", "_other_j"))))
    return out.drop(*(f"_{n}_{s}" for n in ("top", "ties", "next", "other") for s in "ij"))


def entropy_confidence(sims: DataFrame, keys: list[str], temperature: float = 8.0) -> DataFrame:
    """One row per (keys, i): one less the normalised entropy of the softmax of the row's scores; 1 for a single cell."""
    own = Window.partitionBy(*keys, "i")
    w = F.exp(temperature * (F.col("score") - F.max("score").over(own)))
    p = sims.withColumn("_w", w).withColumn("_p", F.col("_w") / F.sum("_w").over(own))
    out = p.groupBy(*keys, "i").agg(F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.ln("_p")).otherwise(0.0)).alias("_h"), F.count(F.lit(1)).alias("_m"))
    return out.select(*keys, "i", F.when(F.col("_m") < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide("_h", F.ln("_m")))).alias("confidence"))
