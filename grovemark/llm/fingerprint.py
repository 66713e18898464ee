"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame expressions alone.

A sketch is the k smallest distinct hashes of a document's word shingles, sorted. Sketches of parts merge into the
sketch of the whole; two of them estimate resemblance, containment and the distinct shingle count. A document
with fewer than k shingles is held exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import words

K, SHINGLE = 128, 5


def _shingle_hashes(w: Column, n: int) -> Column:
    """w: a column (not an expression to repeat) of words. Fewer than n words make one shingle; none make none."""
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<long>"))
    many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(n))))
    return F.when(F.size(w) < n, whole).otherwise(many)


def add_sketch(df: DataFrame, text: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Adds ``out``, array<long>: the sketch of column ``text``. Null, empty and blank texts give an empty sketch."""
    df = df.withColumn("_w", words(F.col(text)))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(_shingle_hashes(F.col("_w"), shingle))), 1, k)).drop("_w")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike (1)."""
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th smallest hash as a share of all."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a is contained (1)."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def printable(a: Column) -> Column:
    """The sketch as text: base64 of its hashes, 8 bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def merge_sketches(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group of parts, as an aggregation that drops all but the k smallest in each exchange.

    Hashes are deduplicated before they meet; a hot group's hashes are cut to k in each of 64 salts first.
    """
    each = df.select(*keys, F.explode(sketch).alias("_h")).distinct()
    salted = each.groupBy(*keys, F.pmod(F.col("_h"), F.lit(64)).alias("_s")).agg(F.slice(F.sort_array(F.collect_set("_h")), 1, k).alias("_p"))
    return salted.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("_p"))), 1, k).alias(sketch))


def _in_blocks(docs: DataFrame, per_block: int) -> tuple[DataFrame, int]:
    """Adds _block: contiguous ranges of doc_id of about ``per_block`` rows, at most 65,536 ranges.

    Bounds are approximate quantiles, found on the executors; null ids are in block 0. A binary search
    over the array of bounds, unrolled by ``aggregate``, finds a row's range.
    """
    n = docs.count()
    blocks = max(1, min(65_536, -(-n // per_block)))
    bounds: list[float] = []
    if blocks > 1:
        bounds = sorted(set(docs.where("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 1 / (4 * blocks))))
    if not bounds:
        return docs.withColumn("_block", F.lit(0)), 1
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.array(*(F.lit(int(b)) for b in bounds))
    find = F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= F.col("doc_id"), at + s).otherwise(at))
    return docs.withColumn("_block", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(find)), len(bounds) + 1


def edited_fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE, per_block: int = 2000) -> DataFrame:
    """doc_id, n_chars, edited_text, sketch, edited_sketch, near_edited, near_next for every row of ``docs``.

    The edited text: the last floor(n_chars / 4) code points replaced by the first as many, or all, of the next
    document's text in the order of doc_id, then text; after the last comes the first. One document alone is its own
    next. Null texts count as empty; null ids come first; rows that repeat an id are each other's next.
    Other columns are ignored. An empty table gives an empty table.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain, _ = _in_blocks(plain, per_block)
    ids = plain.select("_block", "doc_id").groupBy("_block").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")).alias("low"))
    ids = ids.select("_block", "low.doc_id")
    firsts = plain.join(ids.withColumnRenamed("_block", "_b").withColumnRenamed("doc_id", "_id"), (F.col("_block") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    firsts = firsts.groupBy("_block").agg(F.min("text").alias("first_text"))
    around = Window.orderBy("_block")  # one row a block: at most 65,536
    order = ids.select("_block").withColumn("_to", F.coalesce(F.lead("_block").over(around), F.min("_block").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    firsts = order.join(firsts.withColumnRenamed("_block", "_to"), "_to").select(F.col("_block").alias("_b"), "first_text")
    firsts = add_sketch(firsts, "first_text", "first_sketch", k, shingle)

    run = Window.partitionBy("_block").orderBy("doc_id", "text")
    df = plain.withColumn("_next", F.lead("text").over(run))
    df = add_sketch(df, "text", "sketch", k, shingle)  # after the exchange, which need not carry it
    df = df.withColumn("_next_sketch", F.lead("sketch").over(run))
    df = df.join(firsts, df["_block"] == firsts["_b"], "left")
    df = df.withColumn("_next_sketch", F.when(F.col("_next").isNull(), F.col("first_sketch")).otherwise(F.col("_next_sketch")))
    df = df.withColumn("n_chars", F.length("text").cast("long")).withColumn("_m", F.floor(F.col("n_chars") / 4).cast("int"))
    cut = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - F.col("_m")).cast("int")), F.substr(F.coalesce("_next", "first_text"), F.lit(1), F.col("_m")))
    df = df.select("doc_id", "n_chars", "sketch", "_next_sketch", cut.alias("edited_text"))
    df = add_sketch(df, "edited_text", "edited_sketch", k, shingle)
    return df.select("doc_id", "n_chars", "edited_text", "sketch", "edited_sketch", resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("_next_sketch"), k).alias("near_next"))


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """``edited_fingerprints`` with sketches as text and the edited text as its SHA-256: a row for every row, null texts as empty ones, null ids first,
    rows that repeat an id next to each other, no rows for none."""
    df = edited_fingerprints(docs)
    return df.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), printable(F.col("sketch")).alias("fingerprint"), printable(F.col("edited_sketch")).alias("edited_fingerprint"), F.col("near_edited").cast("double"), F.col("near_next").cast("double"))
