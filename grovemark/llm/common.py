"""What several corpus operators share: scratch tables, native word columns, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: white space as the contracts define it.
SPACE = "\\x20\\x09-\\x0D"
#: Links that a task of ``components`` should handle, so that few links don't cost many small tasks and files.
PER_TASK = 200_000
#: Hot keys that ``meet`` broadcasts, with what their rows say: some ten bytes to a hundred each.
MOST_HOT = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none and the master is local (tests on one machine), one is made and set for this context; on a
    cluster a folder of the driver's would be invisible to executors, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = tempfile.mkdtemp(prefix="grovemark-")
        spark.sparkContext.setCheckpointDir(held)
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000, size: int | None = None) -> None:
    """Rows hold whole texts, so fewer go into an Arrow batch than Spark's default of 10,000, and where they hold whole blocks no
    more than ``size`` bytes or one row: batches lie outside the heap, at both ends of the pipe."""
    if size is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a re-read and no recomputation.

    ``save`` writes a frame as Parquet and returns it as read back; ``drop`` deletes a table that no
    later step reads. What is left is deleted when the process ends.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.base = spark, f"{shared_dir(spark)}/grovemark-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self.close)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.made}"
        self.made += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df.scratch_path)

    def _delete(self, path: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        if self.made and self.spark.sparkContext._jsc is not None:
            try:
                self._delete(self.base)
            except Exception:  # the JVM may be gone when the process ends
                return


def meet(left: DataFrame, right: DataFrame, key: str, n: str = "n", hot: int = 10_000) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has one row a key and in column n the number of left's rows with it.

    Keys with more than ``hot`` of these are sent to every task, since at most one left row in ``hot`` can be such a key; their
    rows stay where they are. All others meet by an exchange, in which no key has more than ``hot`` rows. With more than
    MOST_HOT hot keys, counted first, all meet by an exchange, and adaptive execution splits the hot ones. ``right`` should be stored.
    """
    if right.where(F.col(n) > hot).limit(MOST_HOT + 1).count() > MOST_HOT:
        return left.join(right, key)
    few = F.broadcast(right.where(F.col(n) > hot))
    rest = left.join(few.select(key), key, "left_anti").join(right.where(F.col(n) <= hot), key)
    return rest.unionByName(left.join(few, key))


def words(text: Column, lower: bool = True) -> Column:
    """Native array of the words of ``text``; null and blank texts give an empty array."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", "")
    trimmed = F.lower(trimmed) if lower else trimmed
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def unit_draw(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on the parts alone: 52 bits of an MD5 digest.

    Other engines compute the same number, so results can be compared row by row.
    """
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (id, component), component the smallest id.

    Each round hangs every node under its smallest neighbour, follows these links to their ends by doubling, and contracts the
    edges to the ends: what is left are edges between different trees, at most half as many nodes, so that a hub's or a
    group's edges are read once and not in every round. All steps are joins and aggregations with partial sums before
    their exchanges. Null ends and loops are ignored; an empty table gives an empty table.
    """

    def contracted(pairs: DataFrame) -> DataFrame:
        return scratch.save(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    now, labels = contracted(edges.where("a IS NOT NULL AND b IS NOT NULL")), None
    for _ in range(rounds):
        n = now.count()
        if labels is not None and not n:
            break
        parts = max(4, n // PER_TASK)
        ends = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = scratch.save(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")).coalesce(parts))
        while True:
            above = tree.select(F.col("id").alias("at"), F.col("label").alias("above"))
            moved = scratch.save(tree.join(above, tree["label"] == above["at"]).select("id", F.col("above").alias("label"), (F.col("above") < F.col("label")).alias("on")).coalesce(parts))
            scratch.drop(tree)
            tree = moved
            if not tree.where("on").limit(1).count():
                break
        root = tree.select("id", F.col("label").alias("root"))
        left = now.join(root, now["a"] == root["id"]).select(F.col("root").alias("a"), "b")
        new = contracted(left.join(root, left["b"] == root["id"]).select("a", F.col("root").alias("b")))
        if labels is None:
            labels = tree
        else:
            further = labels.join(root.withColumnRenamed("id", "at"), labels["label"] == F.col("at"), "left")
            own = scratch.save(further.select("id", F.coalesce("root", "label").alias("label")).coalesce(max(4, parts)))
            scratch.drop(labels, tree)
            labels = own
        scratch.drop(now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    scratch.drop(now)
    return labels.select("id", F.col("label").alias("component"))
