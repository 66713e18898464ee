"""Removal of repeated 100-byte strings by a common-prefix-aware distributed merge sort of suffixes.

Suffixes are sampled where a repeat must have one: among the 61 places of a 100-byte string, those whose 40 bytes have the
smallest hash (anchors, one place in 31). Anchors whose hash occurs once in the corpus can't be in a repeat; a first
exchange finds them. The others' suffixes, 100 bytes from the anchor on, are sorted in blocks of documents, front-coded
(each by the length that it shares with the one before) and exchanged as runs together with the 60 bytes to the
anchor's left. A bucket merges its runs by a loser tree that keeps how much each player shares with the last winner and
never compares those bytes again. Suffixes that share an anchor come out side by side, with their common prefixes; with
common left parts these tell, for every string around an anchor, whether an earlier one equals it. The bytes
decide, not hashes: what is removed occurs earlier, byte for byte.

A hot passage is sent once by each block (equal surroundings are settled within blocks), and groups are swept once for
each of the 61 places in time m log m, so that no pairs of a group are listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .exchange import cut, cut_at, grouped, packed, packed_keys, unpacked, unpacked_keys
from .minhash import mixed
from .packing import blocks_of

LENGTH, GRAM = 100, 40
PLACES = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
TEXT, SEGMENT, BATCH = 4 << 20, 1 << 18, 4 << 20
#: Anchors that a bucket should hold about, over all blocks, and tasks among which buckets are dealt: a task takes its buckets one by one.
PER_BUCKET, TASKS = 250_000, 4096
#: Groups up to so many distinct surroundings are compared pairwise, larger ones are swept.
FEW = 16

_B = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_POWERS = np.ones(SEGMENT + LENGTH + 1, dtype=np.uint64)
_POWERS[1:] = _B
_POWERS = np.multiply.accumulate(_POWERS)
_BACK = np.ones(SEGMENT + LENGTH + 1, dtype=np.uint64)
_BACK[1:] = _INVERSE
_BACK = np.multiply.accumulate(_BACK)

BLOCKS = "block long, rest binary, edges binary, text binary, n_anchors long"
SPANS = "block long, spans binary"


def _zip(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def _unzip(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) over every run of ``width`` values, by doubling."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(text: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes of their GRAM bytes) of all anchors of documents ``edges`` cuts ``text`` into; places rise."""
    places, hashes = [], []
    for lo in range(0, max(0, len(text) - LENGTH + 1), SEGMENT):
        part = text[lo : lo + SEGMENT + LENGTH - 1]
        n = len(part)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWERS[:n], out=sums[1:])
        h = mixed((sums[GRAM:] - sums[:-GRAM]) * _BACK[: n - GRAM + 1])
        least = _slide(h, PLACES, np.minimum)  # of each string of LENGTH bytes
        starts = np.arange(lo, lo + len(least))
        doc = np.searchsorted(edges, starts, side="right")
        least[edges[np.minimum(doc, len(edges) - 1)] < starts + LENGTH] = 0  # it would cross into the next document
        padded = np.zeros(len(least) + 2 * (PLACES - 1), dtype=np.uint64)
        padded[PLACES - 1 : PLACES - 1 + len(least)] = least
        chosen = np.flatnonzero(_slide(padded, PLACES, np.maximum) == h)
        places.append(chosen + lo)
        hashes.append(h[chosen])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, own = np.concatenate(places), np.concatenate(hashes)
    at, first = np.unique(at, return_index=True)
    return at, own[first]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    for rows in blocks_of(batches, TEXT):
        at = rows.schema.get_field_index("text")
        texts = [(t or "").encode() for t in rows.column(at).to_pylist()]
        edges = np.cumsum([0, *map(len, texts)])
        sink = pa.BufferOutputStream()
        rest = pa.record_batch([c for k, c in enumerate(rows.columns) if k != at], [n for k, n in enumerate(rows.schema.names) if k != at])
        with pa.ipc.new_stream(sink, rest.schema) as w:
            w.write_batch(rest)
        joined = b"".join(texts)
        yield pa.record_batch([pa.array([(part << 24) + made]), pa.array([_zip(sink.getvalue().to_pybytes())]), pa.array([packed(edges)]), pa.array([_zip(joined)]), pa.array([2 * len(joined) // PLACES])], [x.split()[0] for x in BLOCKS.split(", ")])
        made += 1


def _opened(row: dict) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(text, edges, anchors, their keys) of a block. Anchors' hashes are minima, so all small; keys are those hashes mixed again, and buckets fill alike."""
    text, edges = _unzip(row["text"]), unpacked(row["edges"])
    at, hashes = anchors(np.frombuffer(text, np.uint8), edges)
    return text, edges, at, mixed(hashes)


def _ask(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                keys, counts = np.unique(_opened(row)[3], return_counts=True)
                out = [(bucket, row["block"], packed_keys(keys[w]), packed(np.minimum(counts[w], 2))) for bucket, w in cut(keys, bits)]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)], ["bucket", "block", "keys", "counts"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in grouped(batches, "bucket"):
        keys = [unpacked_keys(r["keys"]) for r in rows]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        again = np.bincount(at, weights=np.concatenate([unpacked(r["counts"]) for r in rows]), minlength=len(distinct)) > 1
        lo, out = 0, []
        for r, k in zip(rows, keys, strict=True):
            out.append((r["block"], r["bucket"], packed(again[at[lo : lo + len(k)]])))
            lo += len(k)
        yield pa.record_batch([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["block", "bucket", "again"])


def shared_prefix(a: bytes, b: bytes) -> int:
    """How many bytes a and b have in common from their start."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return n if not x else ((x & -x).bit_length() - 1) >> 3


class LoserTree:
    """Merges front-coded sorted runs; yields (string, its common prefix with the string before, run, index in the run).

    Each player holds its string and how much of it the last winner shares. Of two players, the one that shares more
    is smaller; only where they share alike are bytes compared, from there on. Runs give what a string shares with the one
    before it, which was the winner when it enters: no known prefix is compared again. Equal strings come in the order of runs.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs = runs
        size = 1
        while size < len(runs):
            size *= 2
        self.size = size
        self.text: list[bytes | None] = [None] * size
        self.lcp = [0] * size
        self.index = [-1] * size
        for k in range(len(runs)):
            self._next(k, b"")
        self.losers = [0] * size
        self.winner = self._play(1)

    def _next(self, k: int, before: bytes) -> None:
        got = next(self.runs[k], None)
        if got is None:
            self.text[k] = None
        else:
            self.lcp[k], tail = got
            self.text[k] = before[: got[0]] + tail
            self.index[k] += 1

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        s, t = self.text[a], self.text[b]
        if t is None or s is None:
            return (a, b) if t is None else (b, a)
        p, q = self.lcp[a], self.lcp[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        h = p + shared_prefix(s[p:], t[p:])
        smaller = h == len(s) or h < len(t) and s[h] < t[h]
        if h == len(s) == len(t):
            smaller = a < b
        if smaller:
            self.lcp[b] = h
            return a, b
        self.lcp[a] = h
        return b, a

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._match(self._play(2 * node), self._play(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[bytes, int, int, int]]:
        while (text := self.text[self.winner]) is not None:
            w = self.winner
            yield text, self.lcp[w], w, self.index[w]
            self._next(w, text)
            node = (w + self.size) >> 1
            while node:
                w, self.losers[node] = self._match(w, self.losers[node])
                node >>= 1
            self.winner = w


def front_coded(sorted_texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(lengths shared with the string before, lengths of the rest, the rests)."""
    shared = [0, *(shared_prefix(a, b) for a, b in pairwise(sorted_texts))] if sorted_texts else []
    tails = [t[s:] for t, s in zip(sorted_texts, shared, strict=True)]
    return np.array(shared, np.uint8), np.array([len(t) for t in tails], np.uint8), b"".join(tails)


def decoded(shared: np.ndarray, rests: np.ndarray, tails: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    for s, n in zip(shared.tolist(), rests.tolist(), strict=True):
        yield s, tails[at : at + n]
        at += n


def _runs(bits: int):
    """A block beside its answers becomes one sorted run for each bucket (kind 1) and the spans that it settles itself (kind 0)."""
    names = ["kind", "bucket", "block", "shared", "rests", "tails", "lefts", "left_sizes", "docs", "places", "spans"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "block"):
            row = next(r for r in rows if r["kind"] == 0)
            told = sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["bucket"])
            text, edges, at, keys = _opened(row)
            if not told:
                continue
            distinct, inverse = np.unique(keys, return_inverse=True)
            again = np.concatenate([unpacked(r["again"]) for r in told]) > 0
            kept = np.flatnonzero(again[inverse])
            at, bucket = at[kept], (keys[kept] >> np.uint64(64 - bits)).astype(np.int64)
            doc = np.searchsorted(edges, at, side="right") - 1
            ids = _doc_ids(row)[doc]
            lo, hi = np.maximum(edges[doc], at - LEFT), np.minimum(edges[doc + 1], at + LENGTH)
            order = np.lexsort((at, ids, bucket))
            spans: list[tuple[int, int]] = []
            out = []
            for b, where in cut_at(bucket[order]):  # equal surroundings share an anchor and so a bucket: one bucket's strings are held at a time
                first: dict[tuple[bytes, bytes], int] = {}
                for k in order[where].tolist():  # the earliest of equal surroundings speaks for the block
                    a, i, j = int(at[k]), int(lo[k]), int(hi[k])
                    if first.setdefault((text[a:j], text[i:a]), k) != k and j - i >= LENGTH:
                        spans.append((i, j))
                items = sorted(first.items())
                ks = np.array([k for _, k in items])
                shared, rests, tails = front_coded([right for (right, _), _ in items])
                lefts = b"".join(left for (_, left), _ in items)
                out.append((1, b, row["block"], _zip(shared.tobytes()), _zip(rests.tobytes()), _zip(tails), _zip(lefts), packed(at[ks] - lo[ks]), _zip(ids[ks].astype("<i8").tobytes()), _zip((at[ks] | (edges[doc[ks]] << 32)).astype("<i8").tobytes()), None))
            home = int(mixed(np.array([row["block"]], np.uint64))[0] >> np.uint64(64 - bits))  # what a block settles itself needs no particular bucket
            out.append((0, home, row["block"], *[None] * 7, packed(np.array(spans, np.int64).ravel())))
            yield pa.record_batch([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)], names)

    return run


def _doc_ids(row: dict) -> np.ndarray:
    """A block's doc_ids; null is before all."""
    batch = pa.ipc.open_stream(_unzip(row["rest"])).read_all()
    return batch["doc_id"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()


def _repeats(members: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(block, from, to) of what earlier members of a group have.

    members: (right, left, doc_id, start in the document, place in the block, block), which share an anchor, in the
    order of right. Equal surroundings are settled at once; of the others, the strings at each distance are told apart.
    """
    members.sort(key=lambda m: (m[2], m[3]))
    first: dict[tuple[bytes, bytes], tuple] = {}
    for m in members:
        if first.setdefault((m[0], m[1]), m) is not m and len(m[0]) + len(m[1]) >= LENGTH:
            yield m[5], m[4] - len(m[1]), m[4] + len(m[0])
    some = list(first.values())
    # All that is found of a member holds its anchor, so it is one span.
    if len(some) <= FEW:
        for k, m in enumerate(some):
            near = [(shared_prefix(m[1][::-1], e[1][::-1]), shared_prefix(m[0], e[0])) for e in some[:k]]
            if near := [(left, right) for left, right in near if left + right >= LENGTH]:
                yield m[5], m[4] - max(x for x, _ in near), m[4] + max(y for _, y in near)
        return
    rights, lefts = [m[0] for m in some], [m[1][::-1] for m in some]
    classes = []
    for texts in (rights, lefts):
        order = sorted(range(len(some)), key=texts.__getitem__)
        shared = np.array([0, *(shared_prefix(texts[a], texts[b]) for a, b in pairwise(order))])
        classes.append((np.array(order), shared, np.array([len(t) for t in texts])))
    least, most = np.full(len(some), LEFT + 1), np.full(len(some), -1)
    for d in range(LEFT + 1):
        names = []
        for (order, shared, sizes), need in zip(classes, (LENGTH - d, d), strict=True):
            own = np.empty(len(some), np.int64)
            own[order] = np.cumsum(shared < need) if need else 0
            names.append((own, sizes >= need))
        ok = np.flatnonzero(names[0][1] & names[1][1])
        key = names[0][0][ok] * (len(some) + 2) + names[1][0][ok]
        later = np.ones(len(ok), bool)
        later[np.unique(key, return_index=True)[1]] = False  # members are in the order of their places
        least[ok[later]] = np.minimum(least[ok[later]], d)
        most[ok[later]] = d
    for k in np.flatnonzero(most >= 0).tolist():
        yield some[k][5], some[k][4] - int(most[k]), some[k][4] - int(least[k]) + LENGTH


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in grouped(batches, "bucket"):
        if own := [r for r in rows if r["kind"] == 0]:  # settled in their blocks
            yield pa.record_batch([pa.array([r["block"] for r in own], pa.int64()), pa.array([r["spans"] for r in own], pa.binary())], ["block", "spans"])
        about, players = [], []
        for r in (r for r in rows if r["kind"] == 1):
            sizes = unpacked(r["left_sizes"])
            ends = np.cumsum(sizes)
            place = np.frombuffer(_unzip(r["places"]), "<i8")
            about.append((_unzip(r["lefts"]), memoryview(ends - sizes), memoryview(ends), memoryview(np.frombuffer(_unzip(r["docs"]), "<i8")), memoryview(place & 0xFFFFFFFF), memoryview(place >> 32), r["block"]))
            players.append(decoded(np.frombuffer(_unzip(r["shared"]), np.uint8), np.frombuffer(_unzip(r["rests"]), np.uint8), _unzip(r["tails"])))
        found: dict[int, list[int]] = {}
        group: list[tuple] = []

        def settle(found=found) -> None:
            for block, lo, hi in _repeats(group):
                found.setdefault(block, []).extend((lo, hi))

        for text, shared, run, k in LoserTree(players) if players else ():
            if shared < GRAM and group:
                if len(group) > 1:
                    settle()
                group.clear()
            lefts, los, his, docs, places, starts, block = about[run]
            group.append((text, lefts[los[k] : his[k]], docs[k], places[k] - starts[k], places[k], block))
        if len(group) > 1:
            settle()
        if found:
            yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array([packed(np.array(x, np.int64)) for x in found.values()], pa.binary())], ["block", "spans"])


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint, non-touching spans (n x 2) that cover the same places."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > ends[:-1]])
    return np.stack([spans[new, 0], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]], axis=1)


def _kept(columns: list[str], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "block"):
            row = next(r for r in rows if r["kind"] == 0)
            text, edges = _unzip(row["text"]), unpacked(row["edges"])
            every = [unpacked(r["spans"]).reshape(-1, 2) for r in rows if r["kind"] == 1]
            spans = np.concatenate([*every, np.zeros((0, 2), np.int64)])
            doc = np.searchsorted(edges, spans[:, 0], side="right") - 1
            order = np.argsort(doc, kind="stable")
            spans, bounds = spans[order], np.searchsorted(doc[order], np.arange(len(edges)))
            rest = pa.ipc.open_stream(_unzip(row["rest"])).read_all().combine_chunks()
            left, removed, cuts = [], [], []
            for k in range(len(edges) - 1):
                own = merged_spans(spans[bounds[k] : bounds[k + 1]])
                at, pieces = int(edges[k]), []
                for lo, hi in own.tolist():
                    pieces.append(text[at:lo])
                    at = hi
                pieces.append(text[at : int(edges[k + 1])])
                left.append(b"".join(pieces))
                removed.append(int((own[:, 1] - own[:, 0]).sum()))
                cuts.append(len(own))
            if digest:
                yield pa.record_batch([rest["doc_id"].combine_chunks().cast(pa.int64()), pa.array(np.diff(edges)), pa.array(removed, pa.int64()), pa.array(cuts, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                continue
            texts = [x.decode("utf-8", "ignore") for x in left]
            made = {n: rest[n].combine_chunks() for n in rest.schema.names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in made:
                made["n_chars"] = pa.array([len(t) for t in texts], pa.int64()).cast(made["n_chars"].type)
            yield pa.record_batch([made[c] for c in columns], columns)

    return run


def _cut(docs: DataFrame, digest: bool) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    small_batches(docs.sparkSession, size=BATCH)
    blocks = scratch.save(docs.mapInArrow(_blocks, BLOCKS))
    n_anchors, n_blocks = blocks.agg(F.coalesce(F.sum("n_anchors"), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(2, (n_anchors // PER_BUCKET).bit_length())
    asked = blocks.select("block", "edges", "text").mapInArrow(_ask(bits), "bucket int, block long, keys binary, counts binary")
    tasks, dealt = min(1 << bits, TASKS), F.expr(f"shiftright(bucket, {max(0, bits - TASKS.bit_length() + 1)})")  # neighbouring buckets share a task
    answers = scratch.save(asked.repartitionById(tasks, dealt).sortWithinPartitions("bucket").mapInArrow(_answer, "block long, bucket int, again binary"))
    n_parts = max(1, n_blocks)

    def beside(own: DataFrame, told: DataFrame) -> DataFrame:
        both = own.withColumn("kind", F.lit(0)).unionByName(told.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        return both.repartition(n_parts, "block").sortWithinPartitions("block")

    names = "kind int, bucket int, block long, shared binary, rests binary, tails binary, lefts binary, left_sizes binary, docs binary, places binary, spans binary"
    runs = beside(blocks.drop("n_anchors"), answers).mapInArrow(_runs(bits), names)
    spans = scratch.save(runs.repartitionById(tasks, dealt).sortWithinPartitions("bucket", "block").mapInArrow(_merged, SPANS))
    scratch.drop(answers)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else docs.schema
    return beside(blocks.drop("n_anchors"), spans).mapInArrow(_kept(docs.columns, digest), kind)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every byte taken out of text that a 100-byte string covers which also starts earlier.

    Earlier: in a smaller doc_id, or in the same at a smaller start, as the input has it; rows that repeat a doc_id count
    as one document here, and a null id is before all. Null texts are empty, and no row is dropped, whatever is left of it. Where
    a cut falls into a character, its other bytes go too, so that text stays valid; n_chars, where there is one, is counted
    anew. Other columns stay. No rows, no rows.
    """
    return _cut(docs, False)


def repeat_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and the SHA-256 of the remaining bytes for every row of (doc_id, text).

    Nulls, empty texts, repeated ids and empty tables as in ``remove_repeats``: a null text has no bytes, a null id is before all.
    """
    return _cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), True)
