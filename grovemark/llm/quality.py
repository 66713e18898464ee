"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its hashed lower-cased words (log counts, scaled to unit length), the bins that its
structure statistics fall into, and the bin of its stated length. The score is the logistic of
``w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]``: all pairwise interactions in linear time.
The machine is fitted on the driver from a bounded sample of labelled rows; every text is scored on the executors.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WORD_BITS, BINS, RANK = 14, 10, 8
#: Rows that the fit reads at most; a bound that a caller may raise with the driver's memory (some 2 kB a row).
SAMPLE = 12_000
STATS = ("upper", "digit", "mark", "space", "other", "distinct", "top_word", "repeat", "word_length", "line_length", "line_copies", "marked_ends", "lone_marks", "words")
FEATURES = (1 << WORD_BITS) + (len(STATS) + 1) * BINS

_KIND = np.full(256, 5, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 mark, 4 space, 5 beyond ASCII
for _c in range(128):
    _s = chr(_c)
    _KIND[_c] = 0 if _s.islower() else 1 if _s.isupper() else 2 if _s.isdigit() else 4 if _s.isspace() else 3


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """The values of STATS, each scaled to 0 .. 1."""
    kinds = np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)], minlength=6)
    n, w = max(1, int(kinds.sum())), max(1, len(words))
    letters = max(1, int(kinds[0] + kinds[1]))
    lines = [x for x in text.split("\n") if x]
    repeats = sum(map(str.__eq__, words, words[1:])) if len(words) > 1 else 0
    marked = [(x, c) for x, c in Counter(words).items() if not x[-1].isalnum()]
    ends = sum(c for _, c in marked) / w
    lone = sum(c for x, c in marked if not any(map(str.isalnum, x))) / w
    return [
        kinds[1] / letters, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n,
        len(counts) / w, max(counts.values(), default=0) / w, repeats / w, min(1.0, n / w / 20),
        min(1.0, w / max(1, len(lines)) / 200), 1 - len(set(lines)) / max(1, len(lines)), ends, lone, min(1.0, np.log1p(len(words)) / 12),
    ]


def features(text: str | None, n_chars: int | None, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted feature numbers, values) of one text; an empty text has its statistics alone."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    base = 1 << WORD_BITS
    stats = statistics(text, text.split(), counts)
    at = [base + k * BINS + min(BINS - 1, int(v * BINS)) for k, v in enumerate(stats)]
    stated = len(text) if n_chars is None else max(0, n_chars)
    at.append(base + len(STATS) * BINS + min(BINS - 1, int(np.log1p(stated) * BINS / 14)))
    if len(cache) > 200_000:
        cache.clear()
    hashed = []
    for word in counts:
        if (h := cache.get(word)) is None:
            h = cache[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & (base - 1)
        hashed.append(h)
    tf = np.bincount(hashed, weights=np.fromiter(counts.values(), float, len(counts)), minlength=0) if hashed else np.zeros(0)
    where = np.flatnonzero(tf)
    x = np.log1p(tf[where])
    norm = np.sqrt((x * x).sum()) or 1.0
    return np.concatenate([where, np.array(at)]).astype(np.int32), np.concatenate([x / norm, np.full(len(at), 0.5)]).astype(np.float32)


@dataclass
class Machine:
    """bias, weights (n), factors (n x rank)."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[at] * x[:, None]
        s = vx.sum(0)
        return float(self.bias + self.weights[at] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(at, x), -35, 35))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 12, rate: float = 0.08, decay: float = 1e-5, batch: int = 32, seed: int = 5) -> Machine:
    """AdaGrad on the logistic loss; classes weigh alike. No rows, or one class alone: the score that fits it without features."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=float)
    m = Machine(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, RANK)).astype(np.float32))
    if not len(y) or y.min() == y.max():
        m.bias, m.factors = (0.0 if not len(y) else 4.0 if y[0] > 0.5 else -4.0), m.factors * 0
        return m
    weight = np.where(y > 0.5, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    gb, gw, gv = 1e-6, np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, RANK), 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            ids = order[lo : lo + batch]
            at = np.concatenate([rows[i][0] for i in ids])
            x = np.concatenate([rows[i][1] for i in ids])
            starts = np.cumsum([0, *(len(rows[i][0]) for i in ids[:-1])])
            own = np.repeat(np.arange(len(ids)), [len(rows[i][0]) for i in ids])
            v = m.factors[at]
            vx = v * x[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            z = m.bias + np.add.reduceat(m.weights[at] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            g = ((1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[ids]) * weight[ids] / len(ids)).astype(np.float32)
            used, inverse = np.unique(at, return_inverse=True)
            dw = np.bincount(inverse, weights=g[own] * x, minlength=len(used)).astype(np.float32) + decay * m.weights[used]
            each = (g[own] * x)[:, None] * (s[own] - vx)
            dv = np.zeros((len(used), RANK), np.float32)
            for f in range(RANK):
                dv[:, f] = np.bincount(inverse, weights=each[:, f], minlength=len(used))
            dv += decay * m.factors[used]
            db = float(g.sum())
            gb += db * db
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.bias -= rate * db / np.sqrt(gb)
            m.weights[used] -= rate * dw / np.sqrt(gw[used])
            m.factors[used] -= 0.5 * rate * dv / np.sqrt(gv[used])
    return m


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for b in batches:
        made = [features(t, n, cache) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), strict=True)]
        yield pa.record_batch([b.column("doc_id"), b.column("quality"), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary())], ["doc_id", "quality", "at", "x"])


def _columns(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", stated.alias("n_chars"))


def is_held_out(doc_id) -> object:
    """Column: crc32 of doc_id as text leaves 1 when divided by 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits on at most ``sample`` labelled rows that are not held out: those with the smallest hashes of doc_id.

    Rows without a label or id are passed over; a doc_id with several labels gives a row for each. Of documents that repeat an
    id the smallest text is learnt from, so that the driver gets ``sample`` rows at most.
    """
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~is_held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).selectExpr("doc_id AS _id", "quality")
    found = _columns(docs).join(F.broadcast(chosen.distinct()), F.col("doc_id") == F.col("_id"))
    found = found.groupBy("doc_id", "quality").agg(F.min(F.struct("text", "n_chars")).alias("x")).select("doc_id", "quality", "x.*").repartition(64, "doc_id")  # features cost more than the move
    got = sorted(found.mapInArrow(_featured, "doc_id long, quality int, at binary, x binary").collect(), key=lambda r: (r[0], r[1]))
    return fit([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in got], [r[1] for r in got])


def _scorer(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = machine.value, {}
        for b in batches:
            scores = [m.score(*features(t, n, cache)) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), strict=True)]
            yield pa.record_batch([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "quality_score"])

    return run


def score_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """All columns of ``docs`` and quality_score, 0 to 1. Needs text and n_chars; a null text is empty, a null n_chars its length.

    A column named quality_score is replaced. Rows are neither dropped nor merged; no rows, no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.drop("quality_score")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scorer(shared), f"{kind}, quality_score double")


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; nulls and empty texts as in ``score_quality``, no rows, no rows."""
    scored = score_quality(_columns(docs), train(docs, labels))
    score = F.col("quality_score")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, in their own columns, quality_score included where they have one."""
    if "quality_score" not in docs.columns:
        return score_quality(docs, machine).where(F.col("quality_score") >= least).select(*docs.columns)
    own = docs.withColumnRenamed("quality_score", "_own_score")
    return score_quality(own, machine).where(F.col("quality_score") >= least).drop("quality_score").withColumnRenamed("_own_score", "quality_score").select(*docs.columns)
