"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of trigrams, bigrams, unigrams and an even share for unknown words are mixed with weights that
depend on how often the context was seen: buckets of powers of two of the two words before, or of the one before where these two
were not seen together. The weights are learned by expectation-maximisation on held-out counts: a tenth of the training
documents is deleted from the counts, and the weights that make it likeliest are kept for the counts of all training documents.

Counts are gathered over the whole corpus by ``exchange``: blocks of documents send their distinct n-grams, buckets add
them up and answer. Every step reads tables in the shared folder, so that a lost executor costs a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .exchange import bucket_bits, cut, grouped, packed, packed_keys, unpacked, unpacked_keys
from .minhash import mixed, word_hashes
from .packing import blocks_of

#: Hashes that no word has but by chance: a text's end, and what stands before its first word.
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SIZES, ROUNDS, DELETED = 22, 12, 10
#: Contexts of two words by size, then those of one word for which two were not seen.
BUCKETS = 2 * SIZES
TEXT = 8 << 20
HELD, KEPT, DEV = 0, 1, 2
BLOCKS = "block long, ids array<long>, folds array<int>, edges array<long>, words binary, tokens binary, n long"
ANSWERS = "kind int, block long, gram int, bucket int, totals binary, dev binary, v long, n long, v_kept long, n_kept long"


def fold(doc_id: int | None) -> int:
    """Held out by crc32 mod 7 = 2; of the rest, each tenth by the quotient is deleted to learn the weights."""
    crc = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    return HELD if crc % 7 == 2 else DEV if crc // 7 % DELETED == 0 else KEPT


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    for rows in blocks_of(batches, TEXT):
        h, edges = word_hashes(rows.column("text"))
        whole = np.insert(h, edges[1:], END)  # an end after each text's words
        edges = edges + np.arange(len(edges))
        words, tokens = np.unique(whole, return_inverse=True)
        ids = rows.column("doc_id").to_pylist()
        yield pa.record_batch(
            [pa.array([(part << 24) + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([[fold(i) for i in ids]], pa.list_(pa.int32())), pa.array([edges.tolist()], pa.list_(pa.int64())), pa.array([packed_keys(words)]), pa.array([packed(tokens)]), pa.array([len(whole)])],
            [x.split()[0] for x in BLOCKS.split(", ")],
        )
        made += 1


def key_mask(n_tokens: int) -> int:
    """Which top bits of the keys of bigrams and trigrams are kept: 22 more than number the corpus's tokens, at most 64.

    Of 4 million such n-grams about one shares its key with another and is counted with it; words have all 64 bits.
    """
    kept = min(64, max(1, n_tokens).bit_length() + 22)
    return ((1 << kept) - 1) << (64 - kept)


def _grams(row: dict, mask: int, only: int | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(keys of each token as unigram, bigram and trigram, fold of each token, edges of the documents), of one fold if asked."""
    tokens = unpacked_keys(row["words"])[unpacked(row["tokens"])]
    edges, folds = np.array(row["edges"]), np.array(row["folds"])
    sizes = np.diff(edges)
    each = np.repeat(folds, sizes)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[edges[:-1]] = START
    earlier = np.empty_like(tokens)
    earlier[1:] = before[:-1]
    earlier[edges[:-1]] = START
    two = mixed(before + np.uint64(2))
    keys = [mixed(tokens + np.uint64(1)), mixed(two + tokens), mixed(mixed(mixed(earlier + np.uint64(3)) + two) + tokens)]
    keys = [keys[0], *(k & np.uint64(mask) for k in keys[1:])]
    if only is not None:
        keys, sizes, each = [k[each == only] for k in keys], sizes[folds == only], each[each == only]
        edges = np.concatenate([[0], np.cumsum(sizes)])
    return keys, each, edges


def _ask(bits: int, mask: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, folds, _ = _grams(row, mask)
                out = []
                for gram, own in enumerate(keys, 1):
                    distinct, at = np.unique(own, return_inverse=True)
                    kept, dev = (np.bincount(at[folds == f], minlength=len(distinct)) for f in (KEPT, DEV))
                    for bucket, where in cut(distinct, bits):
                        out.append((gram, bucket, row["block"], packed_keys(distinct[where]), packed(kept[where]), packed(dev[where])))
                kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["gram", "bucket", "block", "keys", "kept", "dev"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ANSWERS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
    for rows in grouped(batches, "gram", "bucket"):
        keys = [unpacked_keys(r["keys"]) for r in rows]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        devs = [unpacked(r["dev"]) for r in rows]
        kept = np.bincount(at, weights=np.concatenate([unpacked(r["kept"]) for r in rows]), minlength=len(distinct)).astype(np.int64)
        total = kept + np.bincount(at, weights=np.concatenate(devs), minlength=len(distinct)).astype(np.int64)
        gram, bucket = rows[0]["gram"], rows[0]["bucket"]
        out: list[tuple] = []
        if gram == 1:
            out.append((0, None, 1, bucket, None, None, int((total > 0).sum()), int(total.sum()), int((kept > 0).sum()), int(kept.sum())))
        lo = 0
        for r, k, d in zip(rows, keys, devs, strict=True):
            own = at[lo : lo + len(k)]
            lo += len(k)
            out.append((1, r["block"], gram, bucket, packed(total[own]), packed(kept[own[d > 0]]), None, None, None, None))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _counts(row: dict, answers: list[dict], column: str, only: int | None, mask: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(counts of each token of a block as unigram, bigram and trigram; edges of the documents)."""
    keys, _, edges = _grams(row, mask, only)
    found = []
    for gram, own in enumerate(keys, 1):
        distinct, at = np.unique(own, return_inverse=True)
        parts = [unpacked(a[column]) for a in sorted((a for a in answers if a["gram"] == gram), key=lambda a: a["bucket"])]
        table = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if len(table) != len(distinct):
            raise RuntimeError("a block's answers do not match its n-grams")
        found.append(table[at])
    return found, edges


def _deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their deleted documents alone."""
    for batch in batches:
        for row in batch.to_pylist():
            edges, folds = np.array(row["edges"]), np.array(row["folds"])
            tokens = unpacked(row["tokens"])[np.repeat(folds, np.diff(edges)) == DEV]
            used, tokens = np.unique(tokens, return_inverse=True)
            row |= {
                "ids": [i for i, f in zip(row["ids"], row["folds"], strict=True) if f == DEV], "folds": [DEV] * int((folds == DEV).sum()), "edges": np.concatenate([[0], np.cumsum(np.diff(edges)[folds == DEV])]).tolist(),
                "words": packed_keys(unpacked_keys(row["words"])[used]), "tokens": packed(tokens),
            }
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            yield pa.record_batch([pa.array([row[c]], t) for c, t in zip(names, kinds, strict=True)], names)


def _seen(counts: np.ndarray, edges: np.ndarray, n_docs: int) -> np.ndarray:
    """How often the words before each token were seen: the count of the n-gram that ends there, for a text's first token all texts."""
    seen = np.empty_like(counts)
    seen[1:] = counts[:-1]
    seen[edges[:-1]] = n_docs
    return seen


def _size(seen: np.ndarray) -> np.ndarray:
    return np.minimum(SIZES - 1, np.where(seen > 0, np.log2(np.maximum(seen, 1)).astype(np.int64) + 1, 0))


def _estimates(counts: list[np.ndarray], edges: np.ndarray, n: int, v: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, tokens x 4: trigram, bigram, unigram, even share; context bucket)."""
    one, two, three = counts
    pair, word = _seen(two, edges, n_docs), _seen(one, edges, n_docs)
    bucket = np.where(pair > 0, _size(pair), SIZES + _size(word))
    return np.stack([three / np.maximum(pair, 1), two / np.maximum(word, 1), one / max(1, n), np.full(len(one), 1 / (v + 1))], axis=1), bucket


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    for rows in grouped(batches, "block"):
        yield next(r for r in rows if r["kind"] == 0), [r for r in rows if r["kind"] == 1]


def _dev_rows(about: tuple[int, ...], mask: int):
    v, n, n_docs = about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, answers in _joined(batches):
            counts, edges = _counts(row, answers, "dev", DEV, mask)
            if len(counts[0]):
                f, bucket = _estimates(counts, edges, n, v, n_docs)
                yield pa.record_batch([pa.array([bucket.astype(np.uint8).tobytes()]), pa.array([f[:, :3].astype("<f4").tobytes()])], ["bucket", "f"])

    return run


def _shares(weights: np.ndarray, even: float):
    """Expectation: the share of each estimate in the likelihood, summed by context bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, 4))
        for batch in batches:
            for b, f in zip(batch.column("bucket").to_pylist(), batch.column("f").to_pylist(), strict=True):
                bucket = np.frombuffer(b, np.uint8)
                f3 = np.frombuffer(f, "<f4").reshape(-1, 3)
                parts = np.concatenate([f3, np.full((len(f3), 1), even, np.float32)], axis=1) * weights[bucket]
                parts /= parts.sum(1, keepdims=True)
                for k in range(4):
                    sums[:, k] += np.bincount(bucket, weights=parts[:, k], minlength=BUCKETS)
        yield pa.record_batch([pa.array(np.arange(BUCKETS)), *(pa.array(sums[:, k]) for k in range(4))], ["bucket", "s3", "s2", "s1", "s0"])

    return run


def learn(dev: DataFrame, even: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (context bucket x 4) by EM over the deleted documents; each keeps a floor of 1e-6. The driver gets BUCKETS rows a round."""
    start = np.tile([0.4, 0.3, 0.2, 0.1], (BUCKETS, 1))
    start[SIZES:] = [0.0, 0.5, 0.4, 0.1]
    start[[0, SIZES]] = [0.0, 0.0, 0.9, 0.1]
    weights = start.copy()
    for _ in range(rounds):
        got = dev.mapInArrow(_shares(weights, even), "bucket long, s3 double, s2 double, s1 double, s0 double").groupBy("bucket").agg(*(F.sum(f"s{k}") for k in (3, 2, 1, 0))).collect()
        sums = np.zeros((BUCKETS, 4))
        for b, *s in got:
            sums[b] = s
        whole = sums.sum(1, keepdims=True)
        weights = np.where(whole > 0, sums / np.maximum(whole, 1e-300), start)
        weights = np.maximum(weights, 1e-6)
        weights /= weights.sum(1, keepdims=True)
    return weights


def _scored(weights: np.ndarray, v: int, n: int, n_docs: int, mask: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, answers in _joined(batches):
            counts, edges = _counts(row, answers, "totals", None, mask)
            one = counts[0]
            f, bucket = _estimates(counts, edges, n, v, n_docs)
            p = np.log10((f * weights[bucket]).sum(1))
            base = np.log10((one + 1) / (n + v + 1))
            starts = edges[:-1]
            add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)  # noqa: E731  every text has its end
            yield pa.record_batch(
                [pa.array(row["ids"], pa.int64()), pa.array([x == HELD for x in row["folds"]], pa.bool_()), pa.array(np.diff(edges)), pa.array(add((one > 0).astype(np.int64)).astype(np.int64)), pa.array(np.full(len(starts), n)), pa.array(add(base)), pa.array(add(p))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def interpolated_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of (doc_id, text).

    Scores are sums of log10 probabilities over a text's words and its end; held_out rows are not counted. Null, empty and blank
    texts have their end alone. Rows that repeat count and score each; a null id hashes as an empty text. Other columns are
    ignored. Without training rows every word has the share of the unknown, 1. No rows, no rows.
    """
    scratch = Scratch(docs.sparkSession)
    blocks = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks, BLOCKS))
    train, kept = F.filter("folds", lambda f: f != HELD), F.filter("folds", lambda f: f == KEPT)
    n_tokens, n_blocks, n_docs, n_kept_docs = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.size(train)), F.lit(0)), F.coalesce(F.sum(F.size(kept)), F.lit(0))).first()
    bits, mask = bucket_bits(2 * n_tokens), key_mask(n_tokens)
    asked = blocks.mapInArrow(_ask(bits, mask), "gram int, bucket int, block long, keys binary, kept binary, dev binary")
    answers = scratch.save(asked.repartitionById(3 << bits, F.col("bucket") * 3 + F.col("gram") - 1).sortWithinPartitions("gram", "bucket").mapInArrow(_answer, ANSWERS))
    v, n, v_kept, n_kept = (int(x or 0) for x in answers.where("kind = 0").agg(F.sum("v"), F.sum("n"), F.sum("v_kept"), F.sum("n_kept")).first())

    def met(own: DataFrame, column: str) -> DataFrame:
        """Each block beside its answers."""
        told = answers.where("kind = 1").select("kind", "block", "gram", "bucket", column)
        own = own.select(F.lit(0).alias("kind"), "block", "ids", "folds", "edges", "words", "tokens")
        return own.unionByName(told, allowMissingColumns=True).repartition(max(1, n_blocks), "block").sortWithinPartitions("block")

    weights = np.tile([0.0, 0.0, 0.0, 1.0], (BUCKETS, 1))
    if n:
        dev = scratch.save(met(blocks.mapInArrow(_deleted, BLOCKS), "dev").mapInArrow(_dev_rows((v_kept, n_kept, n_kept_docs), mask), "bucket binary, f binary"))
        weights = learn(dev, 1 / (v_kept + 1))
        scratch.drop(dev)
    return met(blocks, "totals").mapInArrow(_scored(weights, v, n, n_docs, mask), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
