"""Records that refer to one another, as tables: definers (pair_id, scope, id, props...), references (pair_id, scope, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def duplicate_ids(definers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, n of identifiers that a document defines more than once."""
    return definers.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling_refs(refs: DataFrame, definers: DataFrame, keys: list[str]) -> DataFrame:
    """References of documents that define no such identifier; a null reference is not one."""
    known = definers.select(*keys, "id").distinct()
    return refs.where("id IS NOT NULL").join(known, [*keys, "id"], "left_anti")


def first_definers(definers: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each identifier, as a tolerant reader takes it."""
    first = Window.partitionBy(*keys, "id").orderBy(order)
    return definers.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def bijection(gold: DataFrame, pred: DataFrame, keys: list[str], props: list[str]) -> DataFrame:
    """keys, gold_id, pred_id where identifying properties are exact: an equi-join, unmatched gold identifiers with null.

    Twins (equal properties) pair by rank of identifier, so that the result stays one-to-one.
    """
    twin = lambda df: df.withColumn("_t", F.row_number().over(Window.partitionBy(*keys, *props).orderBy("id")))
    g, p = twin(gold).withColumnRenamed("id", "gold_id"), twin(pred).withColumnRenamed("id", "pred_id").select(*keys, *props, "_t", "pred_id")
    return g.join(p, [*keys, *props, "_t"], "left").select(*keys, "gold_id", "pred_id")


def score_refs(refs: DataFrame, id_map: DataFrame, pred_definers: DataFrame, keys: list[str]) -> DataFrame:
    """Adds mapped_pred and score to (keys..., gold_ref, pred_ref): 1 where the counterpart of gold is pred and exists there."""
    there = pred_definers.select(*keys, F.col("id").alias("mapped_pred"), F.lit(True).alias("_there")).distinct()
    out = refs.join(id_map.select(*keys, F.col("gold_id").alias("gold_ref"), F.col("pred_id").alias("mapped_pred")), [*keys, "gold_ref"], "left").join(there, [*keys, "mapped_pred"], "left")
    right = F.col("_there") & (F.col("mapped_pred") == F.col("pred_ref"))
    return out.withColumn("score", F.when(right, 1.0).otherwise(0.0)).drop("_there")


def wl_colors(edges: DataFrame, vertices: DataFrame, keys: list[str], rounds: int, seed: Column | None = None, checkpoint=None) -> DataFrame:
    """keys, vertex, color: 1-WL colours after so many rounds, equal across all graphs that are refined together.

    edges: keys, src, dst, role, label. A colour is the hash of its signature: the old colour and the sorted colours around with
    direction, role and label. Signatures gather a vertex's edges; hubs are hashed in pre-sorted parts of their own
    multiset only through sums of hashes, which are the same in any order and combine before their exchange.
    """
    both = edges.select(*keys, F.col("src").alias("vertex"), F.col("dst").alias("near"), F.xxhash64(F.lit("out"), "role", "label").alias("_e")).union(
        edges.select(*keys, F.col("dst").alias("vertex"), F.col("src").alias("near"), F.xxhash64(F.lit("in"), "role", "label").alias("_e"))
    )
    colors = vertices.select(*keys, "vertex", F.xxhash64(F.lit("seed") if seed is None else seed).alias("color"))
    for _ in range(rounds):
        seen = both.join(colors.withColumnRenamed("vertex", "near"), [*keys, "near"])
        mark = F.xxhash64("_e", "color")
        # Order-free digest of the multiset of marks: two sums of independent hashes, in decimals that cannot overflow.
        around = seen.groupBy(*keys, "vertex").agg(F.sum(F.xxhash64(mark, F.lit(1)).cast("decimal(38,0)")).alias("_a"), F.sum(F.xxhash64(mark, F.lit(2)).cast("decimal(38,0)")).alias("_b"), F.count(F.lit(1)).alias("_n"))
        colors = colors.join(around, [*keys, "vertex"], "left").select(*keys, "vertex", F.xxhash64("color", "_a", "_b", "_n").alias("color"))
        if checkpoint is not None:
            colors = checkpoint(colors)
    return colors


def color_classes(colors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, class_size, n_classes: how fine the partition is, whatever the colours are called."""
    return colors.groupBy(*keys, "color").agg(F.count(F.lit(1)).alias("class_size")).groupBy(*keys, "class_size").agg(F.count(F.lit(1)).alias("n_classes"))


def ambiguous_records(records: DataFrame, keys: list[str], props: list[str]) -> DataFrame:
    """keys, props, n: records of a document that nothing tells apart."""
    return records.groupBy(*keys, *props).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
