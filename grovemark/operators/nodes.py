"""The node table: one row for each key and value of an alignment, in the order of a walk from the root.

Scores come with the share that each node has in the root's score (weight), so that what is asked of an alignment
later is a filter, a window or an aggregation over this table, and nothing is aligned twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat
from json.encoder import encode_basestring
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import spread
from ..plans.columns import plain
from .kernel import ABSENT, Comparison, Match, escaped
from .validate import first_error, json_text

NODES = (
    "pair_id string, valid boolean, total double, node_id int, parent_id int, depth int, path string, part string, node_type string, kind string, parent_kind string, list_path string, score double, confidence double, parent_confidence double,"
    " weight double, is_leaf boolean, has_gold boolean, has_pred boolean, gold string, pred string, target string, has_target boolean, gold_key string, pred_key string,"
    " renamed int, n_gold int, n_pred int, at string, list_at string, key_score double, key_weight double, key_confidence double, error_path string, error string"
)
COLUMNS = [c.split()[0] for c in NODES.split(", ")]
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}
KINDS = [_ARROW[c.split()[1]] for c in NODES.split(", ")]
LONGEST = 80
#: Pairs of a batch that are Python values at once, and rows that are gathered before they are sent on.
HELD, ROWS = 256, 10_000
#: The only row of a pair whose pred breaks the schema, beside its values and error.
INVALID = {"node_id": 0, "depth": 0, "path": "/", "part": "value", "node_type": "item", "kind": "invalid", "parent_kind": "root", "score": 0.0, "confidence": 1.0, "parent_confidence": 1.0, "weight": 1.0, "is_leaf": True, "has_gold": True, "has_pred": True}


def shown(value: Any) -> str:
    """Python's spelling of a value, cut to 80 characters."""
    text = "None" if value is ABSENT else repr(value)
    return text if len(text) <= LONGEST else text[: LONGEST - 1] + "…"


def spelling(formatter: Callable[[Any], str] | None = None) -> Callable[[Column], Column]:
    """Column function of JSON texts: Python's spelling of their values, or what ``formatter`` makes of them. A null text is None."""
    told = formatter or shown

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([told(None if t is None else json.loads(t)) for t in texts], dtype=object)

    return lambda c: run(c)


_encoded = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def _text(value: Any) -> str | None:
    kind = type(value)
    if kind is str:
        return encode_basestring(value)
    if kind is int:
        return repr(value)
    return None if value is ABSENT else _encoded(value)


@lru_cache(10_000)
def _key_text(key: str) -> str:
    return encode_basestring(key)


def node_rows(root: Match, pair_id: str | None = None) -> list[tuple]:
    """Rows of a tree in the order of COLUMNS, each node before its children, each child's key before its value."""
    rows: list[tuple] = []
    total = float(root.score)

    def walk(m: Match, parent: int | None, depth: int, path: str, kind: str, list_path: str, weight: float, renamed: int | None, key: Match | None, at: str, list_at: str, held: float, key_weight: float | None) -> None:
        gold, pred, sure, me, is_list = m.gold, m.pred, float(m.confidence), len(rows), m.node_type == "list"
        leaf = m.node_type == "item" or not m.children or not any(a > 0 for a in (*m.alphas, *m.key_alphas))
        gold_key = pred_key = key_score = key_sure = None
        if key is not None:
            gold_key, pred_key, key_score, key_sure = None if key.gold is ABSENT else key.gold, None if key.pred is ABSENT else key.pred, float(key.score), float(key.confidence)
        rows.append((
            pair_id, True, total, me, parent, depth, path or "/", "value", m.node_type, m.kind, kind, list_path or "/", float(m.score), sure, held,
            weight, leaf, gold is not ABSENT, pred is not ABSENT, _text(gold), _text(pred), None if m.target is None else json.dumps(m.target), m.target is not None, gold_key, pred_key,
            renamed, len(gold) if is_list and isinstance(gold, list) else None, len(pred) if is_list and isinstance(pred, list) else None, at or "/", list_at or "/", key_score, key_weight, key_sure, None, None,
        ))
        for k, child in enumerate(m.children):
            below, place, own, held_key, share = f"{path}/{child.step}", f"{at}/{child.at}", renamed, child.key, None
            if held_key is not None:
                g, p = held_key.gold, held_key.pred
                has_gold, has_pred = g is not ABSENT, p is not ABSENT
                count, share = len(rows), weight * m.key_alphas[k]
                if own is None and has_gold and has_pred and g != p:
                    own = count
                rows.append((
                    pair_id, True, total, count, me, depth + 1, below, "key", "item", held_key.kind, m.kind, path or "/", float(held_key.score), float(held_key.confidence), sure,
                    share, True, has_gold, has_pred, _key_text(g) if has_gold else None, _key_text(p) if has_pred else None, None, False, g if has_gold else None, p if has_pred else None,
                    own, None, None, place, at or "/", None, None, None, None, None,
                ))
            walk(child, me, depth + 1, below, m.kind, path, weight * m.alphas[k], own, held_key, place, at, sure, share)

    walk(root, None, 0, "", "root", "", 1.0, None, None, "", "", 1.0, None)
    return rows


def flatten(root: Match) -> Iterator[dict]:
    """``node_rows`` by name, without what is the same for all of a pair."""
    for row in node_rows(root):
        yield {c: v for c, v in zip(COLUMNS, row, strict=True) if c not in ("pair_id", "valid", "total", "error_path", "error")}


def with_json(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Typed gold and pred columns as JSON text; text columns stay. Null fields are kept as nulls."""

    def text(c: str) -> Column:
        kind = df.schema[c].dataType
        return F.col(c) if isinstance(kind, T.StringType) else json_text(F.col(c), kind)

    return df.withColumn("_gold", text(gold)).withColumn("_pred", text(pred))


def kernel_input(pairs: DataFrame, dealt: bool = False) -> DataFrame:
    """(pair_id, _gold, _pred, and _likeness if there): structs, lists and numbers go to Python as they are, others as JSON text.

    Pairs are shared out among all cores, however few splits their files have: Python takes far longer over one than its exchange.
    Those that are ``dealt`` already stay where they are.
    """
    more = ["_likeness"] if "_likeness" in pairs.columns else []
    spelt = with_json(pairs)
    for c in ("gold", "pred"):
        kind = pairs.schema[c].dataType
        if not isinstance(kind, T.StringType) and plain(kind):
            spelt = spelt.withColumn(f"_{c}", F.col(c))
    rows = spelt.select(F.col("pair_id").cast("string").alias("pair_id"), "_gold", "_pred", *more)
    return rows if dealt else spread(rows, "pair_id", "_gold")


def values(batch: pa.RecordBatch, column: str) -> Iterator[Any]:
    """A column of ``kernel_input`` as Python values, one at a time; JSON text is parsed, null is null."""
    data = batch.column(column)
    text = pa.types.is_string(data.type) or pa.types.is_large_string(data.type)
    for start in range(0, len(data), HELD):
        for x in data.slice(start, HELD).to_pylist():
            yield _read(x) if text and x is not None else x


def _read(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return Broken()


def parsed(batch: pa.RecordBatch) -> Iterator[tuple[str, Any, Any, dict | None]]:
    """(pair_id, gold, pred, likenesses) of a batch of ``kernel_input``."""
    known = values(batch, "_likeness") if "_likeness" in batch.schema.names else repeat(None)
    for pair_id, gold, pred, own in zip(batch.column("pair_id").to_pylist(), values(batch, "_gold"), values(batch, "_pred"), known):  # noqa: B905  the last may have no end
        yield pair_id, gold, pred, None if own is None else dict(own)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(COLUMNS)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], COLUMNS)


def invalid_row(pair_id: str | None, wrong: tuple[str, str], gold: str | None, pred: str | None) -> tuple:
    """The row of a pair whose pred breaks the schema, in the order of COLUMNS."""
    row = {"pair_id": pair_id, "valid": False, "total": 0.0, "error_path": wrong[0], "error": wrong[1], "gold": gold, "pred": pred, **INVALID}
    return tuple(row.get(c) for c in COLUMNS)


def node_table(pairs: DataFrame, plan: Comparison, raw_schema: dict, skip_validation: bool = False) -> DataFrame:
    """NODES of every row of (pair_id, gold, pred), both JSON text or structs; pair_id becomes text.

    An invalid pred gives one row: valid false, score 0, and where and why it breaks the schema. An invalid gold raises. Pairs are
    compared in Arrow batches, after an exchange that shares them out. A column _likeness (map of a pair of texts' key to their
    likeness), if there, serves the metrics that compare embeddings. No rows, no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for pair_id, gold, pred, known in parsed(batch):
                if wrong := breach_of(raw_schema, skip_validation, pair_id, gold, pred):
                    rows.append(invalid_row(pair_id, wrong, _text(gold), None if isinstance(pred, Broken) else _text(pred)))
                else:
                    rows += node_rows(plan.compare(gold, pred, known)[0], pair_id)
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return kernel_input(pairs).mapInArrow(run, NODES)


class Broken:
    """Stands for a text that is no JSON."""


def breach_of(raw_schema: dict, skip_validation: bool, pair_id: str, gold: Any, pred: Any) -> tuple[str, str] | None:
    """Where and why pred breaks the schema; a gold that does raises. Texts that are no JSON break every schema."""
    if isinstance(gold, Broken):
        raise ValueError(f"gold of pair {pair_id} breaks the schema at /: not JSON")
    if isinstance(pred, Broken):
        return "/", "not JSON"
    if skip_validation:
        return None
    if wrong := first_error(raw_schema, gold):
        raise ValueError(f"gold of pair {pair_id} breaks the schema at {wrong[0]}: {wrong[1]}")
    return first_error(raw_schema, pred)


def kernel_scores(pairs: DataFrame, plan: Comparison, raw_schema: dict, skip_validation: bool = False, dealt: bool = False) -> DataFrame:
    """pair_id, score as ``node_table`` finds them, without its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores = [], []
            for pair_id, gold, pred, known in parsed(batch):
                ids.append(pair_id)
                scores.append(0.0 if breach_of(raw_schema, skip_validation, pair_id, gold, pred) else float(plan.compare(gold, pred, known)[0].score))
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(scores, pa.float64())], ["pair_id", "score"])

    return kernel_input(pairs, dealt).mapInArrow(run, "pair_id string, score double")


__all__ = ["COLUMNS", "INVALID", "NODES", "escaped", "flatten", "kernel_input", "kernel_scores", "node_rows", "node_table", "parsed", "shown", "spelling", "with_json"]
