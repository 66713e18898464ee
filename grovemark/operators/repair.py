"""Repairs as JSON Patch operations: one projection of the node table, and their application."""

from __future__ import annotations

import copy
import json
from collections.abc import Iterable
from functools import lru_cache
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.rows import exploded, spread

RANKS = ("score_delta", "expected_gain", "confidence")
OPS = ["pair_id", "rank", "op", "kind", "path", "list_path", "key", "pred_key", "gold_path", "pred_path", "score_delta", "value", "gold", "pred", "rename_group", "confidence", "total", "n_gold", "n_pred", "at"]
#: Kinds whose path names a list in any order: items are found by value.
BY_VALUE = ("primitive_replace_reorder", "list_item_missing", "list_item_excess")


def _join(parent: Column, key: Column) -> Column:
    return F.concat(F.when(parent == "/", "").otherwise(parent), F.lit("/"), F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def repairs(nodes: DataFrame, granularity: str = "leaf", min_contribution: float = 0.0, rank_by: str = "score_delta", include_ambiguous: bool = False, ambiguity_threshold: float = 0.5) -> DataFrame:
    """OPS of every valid pair, ranked from 1. Without renames inside one another, deltas sum to the deficit.

    min_contribution: renames stay or go with both halves. Diagnostic ``pairing_ambiguous`` rows have delta 0 and are kept
    whatever the filter. Identifiers need no repair. Aligned items, not places, give the values of added keys. What has no
    partner is as sure as its container.
    """
    if granularity not in ("leaf", "subtree", "all"):
        raise ValueError(f"granularity must be 'leaf', 'subtree' or 'all', not {granularity!r}")
    if rank_by not in RANKS:
        raise ValueError(f"rank_by must be one of {RANKS}, not {rank_by!r}")
    c = F.col
    delta = F.when(c("is_leaf"), c("weight") * (1 - c("score"))).otherwise(F.lit(0.0))
    key_delta = F.coalesce(c("key_weight") * (1 - c("key_score")), F.lit(0.0))
    # What is right and lies under no rename has no repair, and no window looks at it. One exchange by pair serves all windows here and
    # those over the result; a task sorts no more rows than the session's partitions leave to it.
    wrong = (c("score") < 1) | (c("kind") == "unmatched")
    wanted = c("renamed").isNotNull() | (c("is_leaf") & wrong if granularity == "leaf" else wrong)
    if include_ambiguous:
        wanted = wanted | (c("confidence") < ambiguity_threshold)
    v = spread(nodes.where("valid AND part = 'value'").where(wanted), "pair_id").withColumns({"delta": delta, "loss": c("weight") * (1 - c("score")), "whole": delta + key_delta})
    # A renamed key carries its own gain and all gains below; its head is the value right after the key's row.
    below = Window.partitionBy("pair_id", "renamed")
    v = v.withColumn("gain", F.sum("whole").over(below)).withColumn("sure", F.coalesce(F.try_divide(F.sum(c("whole") * c("confidence")).over(below), c("gain")), c("key_confidence")))

    path, list_path, gold, none = c("path"), c("list_path"), c("gold"), F.lit(None).cast("string")
    above = F.when(F.regexp_replace(path, "/[^/]*$", "") == "", F.lit("/")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))
    gold_path, pred_path = _join(above, c("gold_key")), _join(above, c("pred_key"))
    holder = F.regexp_replace(c("at"), "/[^/]*$", "")

    in_dict, reorder, lacking, alone = c("parent_kind") == "object", c("parent_kind") == "reorder", c("score") < 1, c("kind") == "unmatched"
    kind = (
        F.when(c("renamed").isNotNull() | ~c("is_leaf") | c("kind").isin("id", "absent"), F.lit(None).cast("string"))
        .when(alone & in_dict, F.when(c("has_gold"), "key_add").otherwise("key_remove"))
        .when(alone & reorder, F.when(c("has_gold"), "list_item_missing").otherwise("list_item_excess"))
        .when(alone, F.when(c("has_gold"), "list_item_add").otherwise("list_item_remove"))
        .when(~lacking, F.lit(None).cast("string"))
        .when(c("kind") == "ref", F.when(c("has_target"), "ref_fix").otherwise("ref_fix_no_target"))
        .when(c("kind") == "null", "null_value_replace")
        .when(reorder, "primitive_replace_reorder")
        .otherwise("primitive_replace")
    )
    kinds = [F.when(c("renamed") == c("node_id") - 1, "key_rename_remove").otherwise(kind), F.when(c("renamed") == c("node_id") - 1, "key_rename_add")]
    if granularity == "subtree":  # stops at the first inner node; a bare leaf keeps its own repair
        kinds = [F.when(c("parent_id").isNull(), k) for k in kinds]
    if granularity != "leaf":
        kinds.append(F.when(~c("is_leaf") & lacking & (c("parent_id").isNull() if granularity == "subtree" else F.lit(True)), "subtree_replace"))
    if include_ambiguous:
        kinds.append(F.when(((c("node_type") == "dict") | (c("kind") == "reorder")) & (c("confidence") < ambiguity_threshold), "pairing_ambiguous"))
    ops = exploded(v, F.array(*kinds), "op_kind")
    k = c("op_kind")
    name = F.when(k.isin("key_add", "key_rename_add", "list_item_add", "list_item_missing"), "add").when(k.isin("key_remove", "key_rename_remove", "list_item_remove", "list_item_excess"), "remove").when(k == "pairing_ambiguous", "describe").otherwise("replace")
    ops = ops.select(
        "pair_id", "node_id", "list_path", "pred_key", "gold", "pred", "total", "n_gold", "n_pred", F.coalesce("gold_key", "pred_key").alias("key"), gold_path.alias("gold_path"), pred_path.alias("pred_path"),
        name.alias("op"), k.alias("kind"), F.when(k.isin(*BY_VALUE), list_path).when(k == "key_rename_remove", pred_path).when(k == "key_rename_add", gold_path).otherwise(path).alias("path"),
        F.when(k.isin(*BY_VALUE), c("list_at")).when(k == "key_rename_add", _join(F.when(holder == "", "/").otherwise(holder), c("gold_key"))).otherwise(c("at")).alias("at"),
        F.when(k.isin("key_rename_remove", "pairing_ambiguous"), 0.0).when(k == "key_rename_add", c("gain")).when(k.isin("key_add", "key_remove"), c("whole")).when(k == "subtree_replace", c("loss")).otherwise(c("delta")).alias("score_delta"),
        F.when((name == "remove") | (name == "describe"), none).when(k == "ref_fix", c("target")).otherwise(gold).alias("value"),
        F.when(k.startswith("key_rename"), F.concat(F.lit("rename-"), c("renamed").cast("string"))).alias("rename_group"), F.when(k.startswith("key_rename"), c("sure")).when(alone, c("parent_confidence")).otherwise(c("confidence")).alias("confidence"),
    )
    bound = F.when(F.col("rename_group").isNotNull(), F.max("score_delta").over(Window.partitionBy("pair_id", "rename_group"))).otherwise(F.col("score_delta"))
    ops = ops.withColumn("_b", bound).where((F.col("_b") >= min_contribution) | (F.col("kind") == "pairing_ambiguous")).drop("_b")
    first = {"score_delta": [F.desc("score_delta")], "expected_gain": [F.desc(F.col("score_delta") * F.col("confidence")), F.desc("score_delta")], "confidence": [F.desc("confidence"), F.desc("score_delta")]}[rank_by]
    order = Window.partitionBy("pair_id").orderBy(*first, "path", "op", "kind", "node_id")
    return ops.withColumn("rank", F.row_number().over(order)).select(*OPS)


def repair_notes(nodes: DataFrame) -> DataFrame:
    """pair_id, note of the pairs with a list in any order: how its repairs name their items."""
    some = nodes.where("valid AND node_type = 'list' AND kind IN ('reorder', 'combined')").select("pair_id").distinct()
    return some.withColumn("note", F.lit("Repairs of lists with order 'align' have the list as their path; items are found by value, not by index."))


def error_breakdown(ops: DataFrame) -> DataFrame:
    """pair_id, kind, delta: what each kind of repair would recover."""
    return ops.where("kind <> 'pairing_ambiguous'").groupBy("pair_id", "kind").agg(F.sum("score_delta").alias("delta"))


@lru_cache(10_000)
def _steps(path: str) -> tuple[str, ...]:
    return tuple(t.replace("~1", "/").replace("~0", "~") for t in path.split("/")[1:]) if path not in ("", "/") else ()


def _index(items: list, step: str, adds: bool = False) -> int:
    """A list's index by its text; '-' is the end, where something is added."""
    if step == "-" and adds:
        return len(items)
    at = int(step)  # ValueError for other texts, '-' included
    if not 0 <= at < len(items) + adds:
        raise IndexError(f"index {at} lies outside a list of {len(items)} items")
    return at


def _child(node: Any, step: str) -> Any:
    if isinstance(node, list):
        return node[_index(node, step)]
    if not isinstance(node, dict):
        raise TypeError(f"step {step!r} leads through a {type(node).__name__}")
    return node[step]


def apply_operation(target: Any, op: str, kind: str, path: str, value: Any, old: Any) -> Any:
    """One repair on a parsed document, which is changed and returned. Diagnostics change nothing.

    Paths must lead somewhere: KeyError, IndexError, TypeError or ValueError for those that don't, and nothing is changed instead.
    """
    if op == "describe":
        return target
    steps = _steps(path)
    if kind in BY_VALUE:
        items = target
        for s in steps:
            items = _child(items, s)
        if not isinstance(items, list):
            raise TypeError(f"{path} is no list")
        if kind == "list_item_missing":
            items.append(value)
        elif kind == "list_item_excess":
            items.remove(old)
        else:
            items[items.index(old)] = value
        return target
    if not steps:
        if op != "replace":
            raise ValueError(f"the root can't be the place to {op}")
        return value
    holder = target
    for s in steps[:-1]:
        holder = _child(holder, s)
    last = steps[-1]
    if isinstance(holder, list):
        at = _index(holder, last, op == "add")
        if op == "add":
            holder.insert(at, value)
        elif op == "remove":
            del holder[at]
        else:
            holder[at] = value
    elif not isinstance(holder, dict):
        raise TypeError(f"{path} leads through a {type(holder).__name__}")
    elif op == "remove":
        del holder[last]
    elif op == "replace" and last not in holder:
        raise KeyError(last)
    else:
        holder[last] = value
    return target


@lru_cache(10_000)
def _place(op: str, kind: str, path: str) -> tuple:
    """Where a repair stands among those of its pair."""
    steps = _steps(path)
    at = tuple(int(s) if s.isdigit() else -1 for s in steps)
    return -len(steps) - (kind in BY_VALUE), {"replace": 0, "remove": 1, "add": 2}.get(op, 3), tuple(-x for x in at) if op == "remove" else at if op == "add" else ()


def _changed(out: Any, ops: Iterable[tuple]) -> Any:
    """``out``, changed by repairs (op, kind, at, value, pred)."""
    for op, kind, at, value, old in sorted(ops, key=lambda o: _place(*o[:3])):
        old = json.loads(old) if old is not None and kind in BY_VALUE else None
        out = apply_operation(out, op, kind, at, None if value is None else json.loads(value), old)
    return out


def apply_repairs(pred: Any, ops: list[dict]) -> Any:
    """All repairs on a copy: inner ones first, so that their places still hold; at one depth replacements, then
    removals from the back of lists, then additions from the front."""
    return _changed(copy.deepcopy(pred), [(o["op"], o["kind"], o["at"], o["value"], o["pred"]) for o in ops])


_encoded = json.JSONEncoder(ensure_ascii=False).encode


def repaired(pairs: DataFrame, ops: DataFrame, *kept: str) -> DataFrame:
    """pair_id, repaired: each pred (JSON text in _pred) with its repairs applied, and columns of ``pairs`` that are kept. A pair's repairs meet in one row.

    Pairs are shared out as their repairs are, so that the two meet, and go to Python, where they are.
    """
    old = F.when(F.col("kind").isin(*BY_VALUE), F.col("pred")).alias("pred")  # others are found by their place
    listed = ops.groupBy(F.col("pair_id").alias("_pair")).agg(F.sort_array(F.collect_list(F.struct("rank", "op", "kind", "at", "value", old))).alias("_ops"))

    @F.arrow_udf("string")
    def run(pred: pa.Array, given: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in given.flatten().flatten()[1:]), strict=True)  # of all pairs, one after another
        out = []
        for text, n in zip(pred.to_pylist(), given.value_lengths().to_pylist(), strict=True):
            out.append(_encoded(_changed(json.loads(text), islice(rows, n))) if n else text)
        return pa.array(out, pa.string())

    own = spread(pairs.select(F.col("pair_id").cast("string").alias("pair_id"), "_pred", *kept), "pair_id")
    return own.join(listed, F.col("pair_id") == F.col("_pair"), "left").select("pair_id", run("_pred", "_ops").alias("repaired"), *kept)
