"""Scoring a stream of predictions against a table of gold: a stateless join on the pair's key and the schema's expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.engine import Aligner


def score_stream(preds: DataFrame, gold: DataFrame, aligner: Aligner, key: str = "pair_id") -> DataFrame:
    """pair_id, score of streamed (key, pred) rows whose key the static (key, gold) table has. No state, no watermark."""
    pairs = preds.join(gold, key).select(F.col(key).alias("pair_id"), "gold", "pred")
    return aligner.score(pairs)


def windowed_scores(scores: DataFrame, time: str, length: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean score and count by event-time windows, closed when no earlier row may still come."""
    return scores.withWatermark(time, late).groupBy(F.window(time, length)).agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))
