"""Optimal pairing of records as tables, for documents with more records than one call should hold.

Likenesses are rows (pair_id, i, j, s). Cells without likeness add nothing, so the best pairing is found for each connected
component of the others on its own: components of one cell are pairs as they are, the rest are solved in batches of equal size. Only
records that are linked by likeness, directly or not, meet in a task; a component must fit there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import Node
from ..plans.text import text_likeness
from ..sources.stored import stored
from .batch import CELLS, assign_all
from .kernel import Comparison, _schema_at
from .reference_graph import definers, graph_colors

PAIRS = "pair_id string, i string, j string, s double"


def components(edges: DataFrame) -> DataFrame:
    """(pair_id, v, c) of the ends of ``edges`` (pair_id, a, b), c the least end that edges reach; rounds that double their reach."""
    both = stored(edges.select("pair_id", "a", "b").union(edges.select("pair_id", F.col("b"), F.col("a"))).distinct())
    now = stored(both.groupBy("pair_id", F.col("a").alias("v")).agg(F.min("b").alias("m")).select("pair_id", "v", F.least("v", "m").alias("c")))
    while True:
        near = both.join(now.withColumnRenamed("v", "b"), ["pair_id", "b"]).groupBy("pair_id", F.col("a").alias("v")).agg(F.min("c").alias("near"))
        step = stored(now.join(near, ["pair_id", "v"]).select("pair_id", "v", F.col("c").alias("was"), F.least("c", "near").alias("c")))
        up = step.select("pair_id", F.col("v").alias("c"), F.col("c").alias("above"))
        new = stored(step.join(up, ["pair_id", "c"], "left").select("pair_id", "v", "was", F.least("c", F.coalesce("above", "c")).alias("c")))
        if not new.where("c < was").limit(1).count():
            return new.select("pair_id", "v", "c")
        now = new.select("pair_id", "v", "c")


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells sorted by component, of components with several cells, to the best pairs."""
    held: dict[tuple[str, str], list[tuple[str, str, float]]] = {}
    size = 0

    def out(parts: list[tuple[tuple[str, str], list[tuple[str, str, float]]]]) -> pa.RecordBatch:
        by_size: dict[int, list] = {}
        for (pair_id, _), cells in parts:
            rows, cols = (list(dict.fromkeys(sorted(c[k] for c in cells))) for k in (0, 1))
            by_size.setdefault(max(len(rows), len(cols)), []).append((pair_id, rows, cols, cells))
        found: list[tuple[str, str, str, float]] = []
        for n, group in by_size.items():
            for lo in range(0, len(group), max(1, CELLS // (n * n))):
                some = group[lo : lo + max(1, CELLS // (n * n))]
                sims = np.zeros((len(some), n, n))
                for k, (_, rows, cols, cells) in enumerate(some):
                    at, to = ({x: p for p, x in enumerate(names)} for names in (rows, cols))
                    for i, j, s in cells:
                        sims[k, at[i], to[j]] = s
                for (pair_id, rows, cols, _), own, col in zip(some, sims, assign_all(sims).tolist(), strict=True):
                    found += [(pair_id, rows[i], cols[j], float(own[i, j])) for i, j in enumerate(col) if i < len(rows) and j < len(cols) and own[i, j] > 0]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, [pa.string()] * 3 + [pa.float64()], strict=True)], ["pair_id", "i", "j", "s"])

    for batch in batches:
        for pair_id, c, i, j, s in zip(*(batch.column(x).to_pylist() for x in ("pair_id", "c", "i", "j", "s")), strict=True):
            if (pair_id, c) not in held and size >= CELLS:
                yield out(list(held.items()))
                held, size = {}, 0
            held.setdefault((pair_id, c), []).append((i, j, s))
            size += 1
    if held:
        yield out(list(held.items()))


def best_pairs(cells: DataFrame) -> DataFrame:
    """PAIRS of the one-to-one pairing with the largest sum of each pair_id: of ``cells`` (pair_id, i, j, s; each cell once) with s above 0.

    Among equal sums, records in the order of their names are settled as in the kernel.
    """
    some = stored(cells.where("s > 0").select("pair_id", "i", "j", "s"))
    found = components(some.select("pair_id", F.concat(F.lit("g"), "i").alias("a"), F.concat(F.lit("p"), "j").alias("b")))
    own = some.withColumn("v", F.concat(F.lit("g"), "i")).join(found, ["pair_id", "v"]).drop("v")
    sizes = own.groupBy("pair_id", "c").agg(F.count(F.lit(1)).alias("n"), F.first("i").alias("i"), F.first("j").alias("j"), F.first("s").alias("s"))
    alone = sizes.where("n = 1").select("pair_id", "i", "j", "s")
    rest = own.join(sizes.where("n > 1").select("pair_id", "c"), ["pair_id", "c"], "left_semi")
    return alone.unionByName(rest.repartition("pair_id", "c").sortWithinPartitions("pair_id", "c", "i", "j").mapInArrow(_solved, PAIRS))


def folded(cells: DataFrame, colors: DataFrame, blend: float | None = None) -> DataFrame:
    """``cells`` with what the reference graph says: records with equal colours are likelier.

    By default by less than the least gap between a pair's likenesses, over all its cells, so that nothing but ties is decided; with
    ``blend`` by that share. colors: (pair_id, side, id, color), as ``graph_colors`` has them. Cells that only colours make are added.
    """
    side = lambda s, name: colors.where(F.col("side") == s).select("pair_id", F.col("id").alias(name), "color")
    same = side("gold", "i").join(side("pred", "j"), ["pair_id", "color"]).select("pair_id", "i", "j", F.lit(1.0).alias("w"))
    both = cells.join(same, ["pair_id", "i", "j"], "full").select("pair_id", "i", "j", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("w", F.lit(0.0)).alias("w"))
    if blend is not None:
        return both.select("pair_id", "i", "j", ((1 - blend) * F.col("s") + blend * F.col("w")).alias("s"))
    levels = cells.select("pair_id", "s").union(cells.select("pair_id", F.lit(0.0))).distinct()
    gaps = levels.withColumn("gap", F.col("s") - F.lag("s").over(Window.partitionBy("pair_id").orderBy("s")))
    counts = colors.groupBy("pair_id").agg(F.count_if(F.col("side") == "gold").alias("n"), F.count_if(F.col("side") == "pred").alias("m"))
    eps = counts.join(gaps.groupBy("pair_id").agg(F.min("gap").alias("gap")), "pair_id", "left").select("pair_id", (F.coalesce("gap", F.lit(1.0)) / (F.col("n") * F.col("m") + 1)).alias("eps"))
    return both.join(eps, "pair_id").select("pair_id", "i", "j", (F.col("s") + F.col("eps") * F.col("w")).alias("s"))


def definer_cells(pairs: DataFrame, plan: Comparison, scope: str, by: str | None = None) -> DataFrame:
    """(pair_id, i, j, s): how alike the records of a scope are, identifiers and references to it left out; JSON texts.

    ``by``: a property whose equality is needed for any likeness, so that records meet by it; without one all records of a pair's
    two texts meet.
    """
    node: Node = _schema_at(plan.schema, plan.ids[scope].record)
    sides = []
    for side, name in (("gold", "i"), ("pred", "j")):
        one = definers(pairs, plan, scope, side).groupBy("pair_id", F.col("id").alias(name)).agg(F.first("record").alias(f"_{side[0]}"))
        sides.append(one if by is None else one.withColumn("_by", F.to_json(F.try_variant_get(f"_{side[0]}", f"$['{by}']", "variant"))))
    met = sides[0].join(sides[1], ["pair_id"] if by is None else ["pair_id", "_by"])
    return text_likeness(met, node, {scope}).where("s > 0").select("pair_id", "i", "j", "s")


def identity_table(pairs: DataFrame, plan: Comparison, scope: str, by: str | None = None) -> DataFrame:
    """pair_id, gold_id, pred_id (JSON texts) of every record of gold in a scope: its counterpart by likeness and graph, null without one.

    Unlike the kernel's, records without any likeness stay without counterpart.
    """
    cells = stored(definer_cells(pairs, plan, scope, by))
    opt = plan.options
    if opt.disambiguation == "wl" and not plan.degraded:
        blend = opt.wl_lambda if opt.wl_fold == "blend" else None
        cells = folded(cells, stored(graph_colors(pairs, plan, scope, blend=blend is not None, rounds=opt.wl_rounds)), blend)
    found = best_pairs(cells).select("pair_id", F.col("i").alias("gold_id"), F.col("j").alias("pred_id"))
    own = definers(pairs, plan, scope, "gold").select("pair_id", F.col("id").alias("gold_id")).distinct()
    return own.join(found, ["pair_id", "gold_id"], "left")
