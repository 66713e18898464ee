"""Ranked lexical search by a bit-sliced impact index.

Documents are dealt to blocks of consecutive rows, wherever they lie: no text is exchanged. Of a block, each term has one
bitmap for each bit of its impact (the whole number that the term adds to a document's score); a query's scores are the sum of
its terms' slices, added for all documents of the block at once by bitwise carries, and its best documents are read off
the sum's slices from the most significant one down. Each block sends its best for each query, and a window keeps the best of all.

Impacts need the corpus' counts, so blocks first keep bare postings (term, document, occurrences) of the queries'
terms in a table of the shared folder; counts are sums over that table. Queries are taken in groups of bounded size.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch
from .packing import slices

#: Fixed value: what no term holds.
BREAKS = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_TO_TERMS = bytes(0x20 if BREAKS.match(bytes([b])) and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Documents and postings of a block at most; bytes of queries in one pass over the documents.
DOCS, POSTINGS, GROUP = 8192, 1 << 19, 4 << 20
NO_ID = 2**63 - 1
BLOCKS = "ids binary, n_terms binary, terms array<int>, df array<long>, docs binary, tf binary, n long, l long"
FOUND = "item int, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, A-Z lower-cased, as UTF-8; bytes beyond ASCII are never breaks."""
    return (text or "").encode().translate(_TO_TERMS).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def add(total: list[int], slices_: list[int], shift: int = 0) -> None:
    """Adds the numbers in ``slices_`` (bitmap of bit 0, of bit 1, ...), times 2**shift, to those in ``total``."""
    carry = 0
    for b, x in enumerate(slices_, shift):
        while len(total) <= b:
            total.append(0)
        t = total[b]
        either = t ^ x
        total[b] = either ^ carry
        carry = (t & x) | (either & carry)
    b = shift + len(slices_)
    while carry:
        if b == len(total):
            total.append(0)
        total[b], carry = total[b] ^ carry, total[b] & carry
        b += 1


def best(total: list[int], k: int) -> list[int]:
    """Places of the k largest numbers above 0 in ``total``, equal ones from the lowest place; in no order."""
    sure, open_ = 0, 0
    for x in total:
        open_ |= x
    for x in reversed(total):
        taken = sure | (open_ & x)
        n = taken.bit_count()
        if n > k:
            open_ &= x
        else:
            sure, open_ = taken, open_ & ~x
            if n == k:
                break
    out = []
    for rest in (sure, open_):
        while rest and len(out) < k:
            low = rest & -rest
            out.append(low.bit_length() - 1)
            rest ^= low
    return out


def impact_slices(docs: np.ndarray, impacts: np.ndarray, size: int) -> list[int]:
    """One bitmap for each bit of the impacts: bit d of it is that of document d."""
    out = []
    for b in range(int(impacts.max()).bit_length()):
        row = np.zeros(size, dtype=bool)
        row[docs[(impacts >> b) & 1 == 1]] = True
        out.append(int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little"))
    return out


class Postings:
    """The postings of a block's documents under known terms."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.l = array("q"), array("q"), 0
        self.term, self.doc, self.tf = array("i"), array("i"), array("q")

    def full(self) -> bool:
        return len(self.ids) >= DOCS or len(self.term) >= POSTINGS

    def add(self, doc_id: int | None, found: list[bytes], known: dict[bytes, int]) -> None:
        """A document with at least one term."""
        at = len(self.ids)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(len(found))
        self.l += len(found)
        for t, n in Counter(x for t in found if (x := known.get(t)) is not None).items():
            self.term.append(t)
            self.doc.append(at)
            self.tf.append(n)

    def row(self) -> tuple:
        """One of BLOCKS: documents by ascending id, postings by term."""
        ids, term = np.frombuffer(self.ids, np.int64), np.frombuffer(self.term, np.int32)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        docs = rank[np.frombuffer(self.doc, np.int32)]
        by = np.lexsort((docs, term))
        distinct, df = np.unique(term, return_counts=True)
        return ids[order].tobytes(), np.frombuffer(self.sizes, np.int64)[order].tobytes(), distinct.tolist(), df.tolist(), docs[by].tobytes(), np.frombuffer(self.tf, np.int64)[by].tobytes(), len(ids), self.l


def _index(known):
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = known.value, Postings()
        batch_of = lambda row: pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if found := terms(text):
                        held.add(doc_id, found, ids)
                        if held.full():
                            yield batch_of(held.row())
                            held = Postings()
        if held.ids:
            yield batch_of(held.row())

    return run


def answer(block: dict, items: list[dict[int, int]], weights: dict[int, int], n: int, l: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(item, doc_id, score) of the k best documents of the block for each item, an item being the repeats of its terms."""
    ids, sizes = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["n_terms"], np.int64)
    docs, tf = np.frombuffer(block["docs"], np.int32), np.frombuffer(block["tf"], np.int64)
    m = 100 - 75 + (75 * sizes * n) // l
    ends = np.cumsum([0, *block["df"]])
    index = {}
    for t, lo, hi in zip(block["terms"], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own = docs[lo:hi]
        impacts = weights[t] * ((1_000_000_000 * tf[lo:hi]) // (1000 * tf[lo:hi] + 8 * m[own]))
        if impacts.any():
            index[t] = impact_slices(own, impacts, len(ids))
    for item, repeats in enumerate(items):
        total: list[int] = []
        for t, times in repeats.items():
            if t in index:
                for b in range(times.bit_length()):
                    if times >> b & 1:
                        add(total, index[t], b)
        for at in best(total, k):
            yield item, int(ids[at]), sum((x >> at & 1) << b for b, x in enumerate(total))


def _answers(asked, n: int, l: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = asked.value
        for batch in batches:
            for i in range(batch.num_rows):
                if found := list(answer(batch.slice(i, 1).to_pylist()[0], items, weights, n, l, k)):
                    item, ids, score = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(item, pa.int32()), pa.array([None if x == NO_ID else x for x in ids], pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def _group(scratch: Scratch, docs: DataFrame, asked: list, k: int) -> DataFrame:
    """The answers to ``asked``, (item_id, text) rows of bounded size."""
    spark = docs.sparkSession
    counted = [Counter(terms(x["text"])) for x in asked]
    known = {t: i for i, t in enumerate(dict.fromkeys(t for c in counted for t in c))}
    blocks = scratch.save(docs.mapInArrow(_index(spark.sparkContext.broadcast(known)), BLOCKS))
    n, l = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    df = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect()  # a row for each asked term at most
    weights = {t: weight(n, x) for t, x in df}
    items = [{known[t]: times for t, times in c.items()} for c in counted]
    found = blocks.mapInArrow(_answers(spark.sparkContext.broadcast((items, weights)), n, l, k), FOUND)
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    names = spark.createDataFrame([(i, x["item_id"]) for i, x in enumerate(asked)], "item int, item_id long")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, group: int = GROUP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Only scores above 0 count; equal scores go by doc_id, null ids last. A null or empty text has no terms: as a document it
    is never found and not counted, as an item it has no rows. Rows that repeat, in either table, are taken each: repeated
    items have their answers as often. No documents or no items: no rows. Other columns are ignored.

    Items are asked in groups of about ``group`` bytes, each of which is held by the driver and every task; each group is a
    pass over the documents.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    passes = max(1, -(-size // group))
    out = None
    for g in range(passes):
        asked = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == g).orderBy("item_id").collect()
        found = _group(scratch, docs, asked, k)
        out = found if out is None else out.unionByName(found)
    return out


#: The same scores by joins, for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM s),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM s) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * max(nn) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, total WHERE term IN (SELECT term FROM i) GROUP BY term),
score AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll)))))::BIGINT AS score FROM i JOIN w USING (term) JOIN p USING (term), total GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 10
"""
