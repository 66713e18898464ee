"""Rows from arrays, and how rows are shared out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, values: Column, out: str) -> DataFrame:
    """``df`` with a row for each of ``values`` (an array that may be computed from its columns) as ``out``; nulls in it have none.

    The array stays a column that the rows' filter reads: the optimizer notes columns that only a generator reads by position, and
    rules that later reorder the columns below a generator (windows whose keys turn out constant) make it drop others instead.
    """
    df = df.withColumn("_values", values)
    return df.select("*", F.explode("_values").alias(out)).where(F.array_contains("_values", F.col(out))).drop("_values")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` among as many tasks as the session's shuffles have, and at least four for each core.

    Files of few row groups, or an exchange whose rows are small but dear, would else leave the work to a few tasks: adaptive
    execution merges parts by their bytes, but not those whose number is given.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)
