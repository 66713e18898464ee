"""Sums by 64-bit key over a whole corpus, and back to the blocks that asked.

A block is some megabytes of documents. It sends each of its distinct keys once, sorted, packed and cut into buckets by
the keys' top bits, with its own counts; a bucket adds up and answers every block with the totals of that block's keys
in their order. Hot keys are combined in their blocks before they travel, so that no bucket gets more than a row of a
key from each block. The number of buckets follows the number of keys; each bucket holds a bounded share of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard

#: Keys that a bucket should hold about, over all blocks.
PER_BUCKET = 4_000_000


def bucket_bits(n_keys: int) -> int:
    """The number of top bits that name a bucket."""
    return max(2, (max(1, n_keys) // PER_BUCKET).bit_length())


def packed(x: np.ndarray) -> bytes:
    """Small non-negative integers, compressed."""
    top = int(x.max()) if len(x) else 0
    kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"
    return kind[1:].encode() + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(kind)).tobytes())


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b[2:]), dtype="<" + b[:2].decode()).astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences, bytes of one place together, which leaves their leading zeros to the compressor."""
    steps = np.diff(keys, prepend=np.zeros(1, np.uint64))
    planes = np.ascontiguousarray(steps.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked_keys(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def cut(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(bucket, where its keys are) of sorted keys; the work follows the keys, not the number of buckets."""
    yield from cut_at(keys >> np.uint64(64 - bits))


def cut_at(own: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, where it is) of a sorted array."""
    if not len(own):
        return
    edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
    for lo, hi in pairwise(edges):
        yield int(own[lo]), slice(lo, hi)


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Runs of rows with equal keys, from sorted batches; a run must fit in memory."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and any(held[0][k] != row[k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held
