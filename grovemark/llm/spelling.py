"""Grouping spelling variants: words one edit apart, each led to its most frequent near word.

The vocabulary is counted by native expressions. Its words, in code-point order, are cut into shards, each a compact trie: a
string of edge labels and arrays of first children and counts, with the rest of a word that is alone below its node kept as one
string. Shards are broadcast in groups of bounded size; every word's Levenshtein automaton of distance one is intersected with
every shard of a group depth-first. What a word meets there is reduced at once to a count and its best neighbour.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Letters of a run, and which occurrences lose a letter.
LETTERS, LOSES = "A-Za-zÀ-ÿ", 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LENGTH, TIMES, RATIO = 6, 5, 5
#: Words of a shard, shards of a group (about 6 MB each in a task), words that a task looks up.
SHARD, GROUP, PER_TASK = 1 << 16, 16, 1 << 13
TRIE = "labels string, first binary, counts binary, tails string"
NEAR = "word string, n long, n_near long, form_n long, form string"


class Trie:
    """Words with counts. Node 0 is the root; the children of node x are the nodes first[x] to first[x + 1] - 1, labels[y] is the letter
    that leads to y, and counts[y] is above 0 where a word ends at y or, where tails[y] isn't empty, after that tail below y."""

    def __init__(self, labels: str, first: array, counts: array, tails: list[str]):
        self.labels, self.first, self.counts, self.tails = labels, first, counts, tails

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        """``words`` ascend and are distinct."""
        labels, first, ends, tails = ["\0"], array("i"), array("q"), []
        level = [(0, len(words), 0)]
        for lo, hi, depth in level:  # grows while it is read: nodes in breadth-first order
            first.append(len(labels))
            if hi - lo == 1:
                ends.append(counts[lo])
                tails.append(words[lo][depth:])
                continue
            tails.append("")
            own = lo < hi and len(words[lo]) == depth
            ends.append(counts[lo] if own else 0)
            at = lo + own
            while at < hi:
                letter, start = words[at][depth], at
                while at < hi and words[at][depth] == letter:
                    at += 1
                labels.append(letter)
                level.append((start, at, depth + 1))
        first.append(len(labels))
        return cls("".join(labels), first, ends, tails)

    def row(self) -> tuple[str, bytes, bytes, str]:
        return self.labels, self.first.tobytes(), self.counts.tobytes(), "\n".join(self.tails)

    @classmethod
    def read(cls, labels: str, first: bytes, counts: bytes, tails: str) -> Trie:
        a, b = array("i"), array("q")
        a.frombytes(first)
        b.frombytes(counts)
        return cls(labels, a, b, tails.split("\n"))

    def exact(self, x: int, rest: str) -> int:
        """The count of the word that ``rest`` spells from node x on, 0 if none."""
        find, first, tails = self.labels.find, self.first, self.tails
        for i, letter in enumerate(rest):
            if tails[x]:
                return self.counts[x] if tails[x] == rest[i:] else 0
            x = find(letter, first[x], first[x + 1])
            if x < 0:
                return 0
        return 0 if tails[x] else self.counts[x]

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Each word of the trie that is one edit from ``word``, once, with its count.

        The automaton's states are (letters read, edits made). At a node reached without an edit every edit is tried; after it
        the rest has to be spelled exactly. Of a run of equal letters only the last is deleted and only its end is lengthened,
        so that no word is met twice.
        """
        labels, first, counts, x = self.labels, self.first, self.counts, 0
        for i in range(len(word) + 1):
            if tail := self.tails[x]:
                if one_edit(word[i:], tail):
                    yield word[:i] + tail, counts[x]
                return
            letter, rest = word[i : i + 1], word[i + 1 :]
            if letter and letter != word[i + 1 : i + 2] and (n := self.exact(x, rest)):
                yield word[:i] + rest, n
            for y in range(first[x], first[x + 1]):
                if (other := labels[y]) != letter:
                    if letter and (n := self.exact(y, rest)):
                        yield word[:i] + other + rest, n
                    if n := self.exact(y, word[i:]):
                        yield word[:i] + other + word[i:], n
            x = labels.find(letter, first[x], first[x + 1]) if letter else -1
            if x < 0:
                return


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: list[str] = []
    counts: list[int] = []

    def out() -> pa.RecordBatch:
        row = Trie.of(words, counts).row()
        return pa.record_batch([pa.array([x]) for x in row], ["labels", "first", "counts", "tails"])

    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            words.append(word)
            counts.append(n)
            if len(words) == SHARD:
                yield out()
                words, counts = [], []
    if words:
        yield out()


def _lookup(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [Trie.read(*row) for row in sent.value]
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                met, best_n, best = 0, 0, None
                for trie in tries:
                    for other, times in trie.near(word):
                        met += 1
                        if times > best_n or times == best_n and other < best:
                            best_n, best = times, other
                if met:
                    rows.append((word, n, met, best_n, best))
            if rows:
                word, n, met, best_n, best = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(word), pa.array(n, pa.int64()), pa.array(met, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best)], [x.split()[0] for x in NEAR.split(", ")])

    return run


def vocabulary(docs: DataFrame, length: int = LENGTH, times: int = TIMES, loses: int = LOSES) -> DataFrame:
    """(word, n): the words of all whole texts with at least ``length`` letters and ``times`` occurrences.

    A word is a run of letters, A-Z lower-cased; where ``loses`` divides the crc32 of ``<doc_id>:<run>``, without the letter
    at that number modulo the run's length. A null text has no runs; a null doc_id counts as an empty one.
    """
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{length},}}"), 0)  # shorter runs make no word
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    hashed = each.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at: Column = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % loses == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def near_words(scratch: Scratch, words: DataFrame, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """NEAR: of each of ``words`` (word, n; distinct) that has near words, their number and the most frequent, ties by code points."""
    spark = words.sparkSession
    total = words.count()
    by_word = words.repartitionByRange(max(1, -(-total // shard)), "word").sortWithinPartitions("word")
    shards = scratch.save(by_word.mapInArrow(_tries, TRIE).withColumn("shard", F.monotonically_increasing_id()))
    names = [r[0] for r in shards.select("shard").orderBy("shard").collect()]
    asked = words.repartition(max(8, total // PER_TASK), "word")
    found = []
    for lo in range(0, len(names), group):
        rows = shards.where(F.col("shard").isin(names[lo : lo + group])).drop("shard").collect()  # ``group`` shards at most
        found.append(asked.mapInArrow(_lookup(spark.sparkContext.broadcast([tuple(r) for r in rows])), NEAR))
    if not found:
        return spark.createDataFrame([], NEAR)
    if len(found) == 1:
        return found[0]
    best = F.min_by(F.struct("form_n", "form"), F.struct(-F.col("form_n"), F.col("form")))
    return reduce(DataFrame.unionAll, found).groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n", "n_near", "x.form_n", "x.form")


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms that begins at each row of ``forms`` (word, form; acyclic) ends. Each round doubles the steps."""
    now = scratch.save(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        new = scratch.save(now.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        scratch.drop(now)
        now = new
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame, ratio: int = RATIO, group: int = GROUP, shard: int = SHARD, **limits: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text) that ``vocabulary`` counts.

    A word's form is its most frequent near word (ties: the least in code-point order) if that is at least ``ratio`` times as
    frequent, else null; its root is the last form of the chain, or the word itself. Null and empty texts have no words; rows
    that repeat count each; no words, no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.save(vocabulary(docs, **limits))
    near = near_words(scratch, words, group, shard)
    led = F.col("form_n") >= ratio * F.col("n")
    near = scratch.save(near.select("word", "n_near", F.when(led, F.col("form")).alias("form"), F.when(led, F.col("form_n")).alias("form_n")))
    last = roots(scratch, near.where("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
