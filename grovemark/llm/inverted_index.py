"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in halves, each half has a codebook of its own (k-means on a bounded sample), and the product of the
codebooks is a grid of cells. A vector lies in the cell of its nearest centroids; as a query it visits cells in the order
of their distance by the multi-sequence traversal, as many as a target recall needs. How many is measured: on sample
vectors with drawn neighbours whose cosines lie between the threshold and 1. Pairs in visited cells are verified by their
cosine in double precision. Equal vectors are one class with a multiplicity. Hot cells are dealt out in pairs of blocks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

#: Vectors that codebooks and calibration read at most.
SAMPLE = 20_000
BLOCK, RECALL, PER_CELL = 1024, 0.995, 200
#: Centroids of a codebook at most (the square of it bounds the cells whose counts are broadcast), grids visited whole, and calibration draws.
CENTROIDS, FEW_CELLS, DRAWS = 1024, 16, 2000


def traversal(first: np.ndarray, second: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The ``most`` cells with the smallest first[i] + second[j], nearest first: a heap over two sorted sequences."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(float(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, []
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append((int(a[i]), int(b[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (float(first[a[x]] + second[b[y]]), x, y))
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin(distances(x, c), axis=1)
        for j in range(len(c)):
            own = x[near == j]
            c[j] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))


@dataclass
class Grid:
    """Codebooks of both halves, and how many cells a query visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    @property
    def cut(self) -> int:
        return self.first.shape[1]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return np.argmin(distances(unit[:, : self.cut], self.first), axis=1) * len(self.second) + np.argmin(distances(unit[:, self.cut :], self.second), axis=1)

    def visited(self, unit: np.ndarray, most: int | None = None) -> list[list[int]]:
        a, b = distances(unit[:, : self.cut], self.first), distances(unit[:, self.cut :], self.second)
        return [[i * len(self.second) + j for i, j in traversal(x, y, most or self.visits)] for x, y in zip(a, b, strict=True)]


def fit(sample: np.ndarray, n_vectors: int, least: float, recall: float = RECALL, seed: int = 3) -> Grid:
    """Codebooks for ``n_vectors`` vectors from unit vectors of the sample, and the visits that reach the recall.

    Calibration makes DRAWS neighbours of sample vectors, which repeat in a small sample, at cosines uniform in [least, 1] and
    takes the number of visits after which the one in the lower cell finds the other in all but 1 - recall of the pairs.
    """
    rng = np.random.default_rng(seed)
    k = int(min(CENTROIDS, max(2, round((n_vectors / PER_CELL) ** 0.5))))
    cut = sample.shape[1] // 2
    grid = Grid(k_means(sample[:, :cut], k), k_means(sample[:, cut:], k), 0)
    if len(grid.first) * len(grid.second) <= FEW_CELLS:
        grid.visits = len(grid.first) * len(grid.second)
        return grid
    x = sample[rng.choice(len(sample), DRAWS, replace=len(sample) < DRAWS)]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    cos = rng.uniform(least, 1, len(x))[:, None]
    y = cos * x + np.sqrt(1 - cos**2) * noise
    whole = len(grid.first) * len(grid.second)
    far = min(whole, 2048)
    steps = []
    for px, cx, py, cy in zip(grid.visited(x, far), grid.cells(x), grid.visited(y, far), grid.cells(y), strict=True):
        path, cell = (px, cy) if cx <= cy else (py, cx)
        steps.append((path.index(cell) if cell in path else whole - 1) + 1)
    grid.visits = int(np.sort(steps)[min(len(steps) - 1, int(np.ceil(recall * len(steps))))])
    return grid


def unit_rows(column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """(rows that are valid vectors, those as unit vectors in double precision), of any width."""
    good, rows = [], []
    for k, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.array(v, dtype=np.float64)
            size = np.linalg.norm(x) if np.isfinite(x).all() else 0.0
            if size > 0 and np.isfinite(size):
                good.append(k)
                rows.append(x / size)
    return good, rows


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good, rows = unit_rows(b.column("embedding"))
        cls: list[int | None] = [None] * b.num_rows
        unit: list[bytes | None] = [None] * b.num_rows
        for k, x in zip(good, rows, strict=True):
            unit[k] = (x + 0.0).tobytes()
            cls[k] = int.from_bytes(hashlib.blake2b(unit[k], digest_size=8).digest(), "little", signed=True)
        yield pa.record_batch([b.column("vec_id"), pa.array(cls, pa.int64()), pa.array(unit, pa.binary())], ["vec_id", "cls", "unit"])


def _celled(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid: Grid = shared.value
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("unit").to_pylist()), dtype=np.float64).reshape(b.num_rows, -1)
                own = grid.cells(x).tolist()
                visits = [[c for c in path if c >= cell] for path, cell in zip(grid.visited(x), own, strict=True)]
                yield pa.record_batch([b.column("cls"), b.column("copies"), b.column("unit"), pa.array(own, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], ["cls", "copies", "unit", "cell", "visits"])

    return run


def _linked(least: float):
    """Rows of one (cell, query block, index block) after another; index rows have side 0, queries side 1."""

    def group(rows: pa.Table) -> pa.RecordBatch | None:
        side = rows["side"].to_numpy()
        if side.min() == side.max():
            return None
        cls, copies, cell = rows["cls"].to_numpy(), rows["copies"].to_numpy(), rows["cell"].to_numpy()
        x = np.frombuffer(b"".join(rows["unit"].to_pylist()), dtype=np.float64).reshape(len(cls), -1)
        index, query = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hit = (x[query] @ x[index].T >= least) & (cls[query][:, None] != cls[index])
        if not hit.any():
            return None
        counts = np.zeros(len(cls), dtype=np.int64)
        counts[query] += hit @ copies[index]
        counts[index] += (hit & (cell[query][:, None] != cell[index])).T @ copies[query]  # within a cell both are queries
        label = cls.copy()
        a, b = label[query], label[index]
        top = np.iinfo(np.int64).max
        while True:  # smallest class of each connected part
            na = np.minimum(a, np.where(hit, b, top).min(1))
            nb = np.minimum(b, np.where(hit, na[:, None], top).min(0))
            if (na == a).all() and (nb == b).all():
                break
            a, b = na, nb
        label[query], label[index] = a, b
        some = np.concatenate([query[hit.any(1)], index[hit.any(0)]])
        return pa.record_batch([pa.array(cls[some]), pa.array(label[some]), pa.array(counts[some])], ["cls", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keys = np.stack([batch.column(c).to_numpy() for c in ("at", "qb", "ib")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(lo, hi - lo)
                if held and lo == 0 and any(held[-1][c][-1].as_py() != part[c][0].as_py() for c in ("at", "qb", "ib")) or held and lo:
                    if (out := group(pa.concat_tables(held).combine_chunks())) is not None:
                        yield out
                    held = []
                held.append(part)
        if held and (out := group(pa.concat_tables(held).combine_chunks())) is not None:
            yield out

    return run


def _links(scratch: Scratch, classes: DataFrame, n: int, least: float, recall: float, sample: int) -> DataFrame:
    """(cls, root, links) of the ``n`` classes (cls, copies, unit), whose vectors have one width."""
    picked = np.array([np.frombuffer(r[0], np.float64) for r in classes.orderBy(F.xxhash64("cls")).limit(sample).select("unit").collect()])
    grid = fit(picked, n, least, recall)
    placed = scratch.save(classes.mapInArrow(_celled(classes.sparkSession.sparkContext.broadcast(grid)), "cls long, copies long, unit binary, cell int, visits array<int>"))
    queries = placed.select("*", F.explode("visits").alias("at"))
    blocks = queries.groupBy("at").agg(F.count(F.lit(1)).alias("q"), F.count_if(F.col("at") == F.col("cell")).alias("i")).where("i > 0")
    blocks = F.broadcast(blocks.select("at", F.ceil(F.col("q") / BLOCK).cast("int").alias("nq"), F.ceil(F.col("i") / BLOCK).cast("int").alias("ni")))  # CENTROIDS ** 2 cells at most
    own = F.xxhash64("cls")
    left = placed.withColumn("at", F.col("cell")).join(blocks, "at").select("*", F.pmod(own, "ni").cast("int").alias("ib"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), F.lit(0).alias("side"))
    right = queries.join(blocks, "at").select("*", F.pmod(own, "nq").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("ib"), F.lit(1).alias("side"))
    keep = ["at", "qb", "ib", "side", "cls", "copies", "unit", "cell"]
    dealt = left.select(*keep).union(right.select(*keep)).repartition("at", "qb", "ib").sortWithinPartitions("at", "qb", "ib")
    return scratch.save(dealt.mapInArrow(_linked(least), "cls long, root long, links long"))


def near_vectors(vectors: DataFrame, least: float = 0.9, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding).

    Rows link if found with a cosine of at least ``least``; equal vectors always are found. n_links: other rows linked directly.
    component_id: the smallest vec_id that links reach. Null, zero, or empty vectors, those with null or non-finite
    components link with nothing and are kept. Vectors link with those of their width alone, each width having an index of its own. Rows that repeat
    a vec_id are vectors of their own. Other columns are ignored. No rows, no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_classed, "vec_id long, cls long, unit binary"))
    classes = scratch.save(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")))
    widths = classes.groupBy((F.length("unit") / 8).cast("int").alias("width")).count().orderBy("width").collect()
    if widths:
        one = len(widths) == 1
        found = reduce(DataFrame.union, [_links(scratch, classes if one else classes.where(F.length("unit") == 8 * w), n, least, recall, sample) for w, n in widths])
        labels = scratch.save(components(scratch, found.select(F.col("cls").alias("a"), F.col("root").alias("b")).distinct()))
        links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    else:
        labels = spark.createDataFrame([], "id long, component long")
        links = spark.createDataFrame([], "cls long, links long")
    about = classes.select("cls", "copies").join(links, "cls", "left").join(labels.withColumnRenamed("id", "cls"), "cls", "left")
    about = about.select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("group"))
    own_rows = rows.select("vec_id", "cls").join(about, "cls", "left")
    low = own_rows.where("group IS NOT NULL").groupBy("group").agg(F.min("vec_id").alias("low"))
    out = own_rows.join(low, "group", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("group").isNull(), F.col("vec_id")).otherwise(F.col("low")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
