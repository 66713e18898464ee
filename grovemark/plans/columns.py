"""Schemas as single Column expressions over typed columns: no shuffle, no Python, one projection.

What expressions can say: leaves; objects whose gold and pred are structs (a field that one side's struct lacks is an absent key);
positional lists; lists in any order with exact leaves (multiset intersection over union). ``score_column`` raises
``Unsupported`` for the rest, which Arrow batches or the pair kernel do. ``ordered_score`` is a fold for short lists.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.leaf import COMPARATORS, DEFAULTS, null_aware, threshold
from ..operators.kernel import ABSENT, Context, Options, escaped, pair_keys
from .schema import Node


class Unsupported(ValueError):
    """This schema or these types need the kernel."""


Custom = Mapping[str, Mapping[str, Callable]]


def custom_column(name: str, fn: Callable, whole: bool = False) -> Callable[[Column, Column], Column]:
    """A custom comparator of two values as a column function, in Arrow batches; repeated pairs of a batch are computed once.

    Only the two columns go to Python, not the whole documents. Its result must be a number from 0 to 1.
    """
    if getattr(fn, "wants_context", False) or hasattr(fn, "by_likeness"):
        raise Unsupported("a comparator that sees more than two values")

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if x is None or y is None or x != x or y != y:
                out.append(None)
                continue
            if whole:  # nulls in a batch make its integers floats
                x, y = int(x), int(y)
            if (x, y) not in known:
                got = fn(x, y)
                if isinstance(got, bool) or not isinstance(got, (int, float)) or not 0 <= got <= 1:
                    raise ValueError(f"comparator {name!r} gave {got!r}, not a number from 0 to 1")
                known[x, y] = float(got)
            out.append(known[x, y])
        return pd.Series(out, dtype="float64")

    return lambda a, b: run(a, b)


@dataclass(frozen=True)
class Around:
    """Where a value stands: the columns of the objects around it and of the documents, with their types, and its path."""

    parents: tuple[Column, Column] | None
    roots: tuple[Column, Column]
    types: tuple[T.DataType, ...]  # of the parents, if any, and of the roots
    path: str = ""

    def below(self, gold: Column, pred: Column, gold_type: T.DataType, pred_type: T.DataType, key: str) -> Around:
        return Around((gold, pred), self.roots, (gold_type, pred_type, *self.types[-2:]), f"{self.path}/{escaped(key)}")


def plain(kind: T.DataType) -> bool:
    """Types that Arrow hands over as the values that JSON has."""
    if isinstance(kind, T.StructType):
        return all(plain(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return plain(kind.elementType)
    return isinstance(kind, (T.StringType, T.IntegralType, T.DoubleType, T.BooleanType))


def context_column(name: str, fn: Callable, around: Around) -> Callable[[Column, Column], Column]:
    """A comparator that sees its surroundings as a column function in Arrow batches: only the values, the objects around them and,
    if it wants them, the documents leave the JVM."""
    if not all(map(plain, around.types)):
        raise Unsupported("surroundings that JSON spells otherwise than Arrow")
    with_parents, with_roots, path = around.parents is not None, getattr(fn, "wants_roots", True), around.path

    @F.arrow_udf("double")
    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for g, p, *more in zip(*(c.to_pylist() for c in columns), strict=True):
            if g is None or p is None:
                out.append(None)
                continue
            parents = more[:2] if with_parents else (None, None)
            got = fn(g, p, Context(*parents, *(more[-2:] if with_roots else (None, None)), path))
            if isinstance(got, bool) or not isinstance(got, (int, float)) or not 0 <= got <= 1:
                raise ValueError(f"comparator {name!r} gave {got!r}, not a number from 0 to 1")
            out.append(float(got))
        return pa.array(out, pa.float64())

    return lambda a, b: run(a, b, *(around.parents or ()), *(around.roots if with_roots else ()))


def leaf_column(node: Node, gold: Column, pred: Column, custom: Custom | None = None, around: Around | None = None) -> Column:
    kind = node.type
    if kind not in COMPARATORS:
        raise Unsupported(f"no single primitive type in {node.types}")
    name = node.score or DEFAULTS[kind]
    own = (custom or {}).get(kind, {}).get(name) or ((custom or {}).get("number", {}).get(name) if kind == "integer" else None)
    if own is not None:
        seeing = getattr(own, "wants_context", False) and around is not None
        compare = context_column(name, own, around) if seeing else custom_column(name, own, kind == "integer")
        if kind in ("integer", "number"):
            gold, pred = gold.cast("long" if kind == "integer" else "double"), pred.cast("long" if kind == "integer" else "double")
    elif name in COMPARATORS[kind]:
        compare = COMPARATORS[kind][name]
    else:
        raise Unsupported(f"no expression for comparator {name!r}")
    return null_aware(gold, pred, threshold(compare(gold, pred), node.threshold), node.null_score)


def bag_score(gold: Column, pred: Column, ignore_excess: bool = False, ignore_missing: bool = False, floating: bool = False) -> Column:
    """Multisets without nulls: common items over all rows of the best pairing. Both empty: 1; nothing counted: 1.

    Counts are taken in the row, from the distinct common values: lists must fit in a row, as they do in their column. floating:
    items may be NaN, which has nothing in common with itself.
    """
    if floating:  # array functions tell zeros of different signs apart
        gold, pred = (F.transform(x, lambda v: v + F.lit(0.0)) for x in (gold, pred))
    shared = F.array_intersect(gold, pred)
    common = F.aggregate(
        F.filter(shared, lambda v: ~F.isnan(v)) if floating else shared, F.lit(0), lambda n, v: n + F.least(F.size(F.filter(gold, lambda x: x == v)), F.size(F.filter(pred, lambda x: x == v)))
    )
    rows = F.size(gold) if ignore_excess else F.size(pred) if ignore_missing else F.size(gold) + F.size(pred) - common
    return F.coalesce(F.try_divide(common.cast("double"), rows.cast("double")), F.lit(1.0))


def ordered_score(gold: Column, pred: Column, leaf=None) -> Column:
    """Best order-preserving pairing of lists without nulls, over its rows; ``leaf`` scores items (exact by default).

    Each cell of the programme carries (value, pairs, rows left without a partner); ties prefer a pair, then leaving out a
    gold item, so that the number of rows is that of the alignment.
    """
    leaf = leaf or (lambda a, b: (a == b).cast("double"))

    def cell(value: Column, pairs: Column, alone: Column) -> Column:
        return F.struct(value.cast("double").alias("v"), pairs.cast("int").alias("m"), alone.cast("int").alias("a"))

    def row(before: Column, g: Column) -> Column:
        start = F.struct(F.array(cell(F.lit(0.0), F.lit(0), before[0]["a"] + 1)).alias("done"), F.lit(1).alias("j"))

        def step(acc: Column, p: Column) -> Column:
            s = leaf(g, p)
            j, left, up, corner = acc["j"], F.element_at(acc["done"], -1), F.get(before, acc["j"]), F.get(before, acc["j"] - 1)
            by_pair = corner["v"] + s
            pair = cell(by_pair, corner["m"] + (s > 0).cast("int"), corner["a"] + F.when(s > 0, 0).otherwise(2))
            best = (
                F.when((by_pair >= up["v"]) & (by_pair >= left["v"]), pair)
                .when(up["v"] >= left["v"], cell(up["v"], up["m"], up["a"] + 1))
                .otherwise(cell(left["v"], left["m"], left["a"] + 1))
            )
            return F.struct(F.concat(acc["done"], F.array(best)).alias("done"), (j + 1).alias("j"))

        return F.aggregate(pred, start, step, lambda acc: acc["done"])

    first = F.transform(F.sequence(F.lit(0), F.size(pred)), lambda j: cell(F.lit(0.0), F.lit(0), j))
    last = F.element_at(F.aggregate(gold, first, row), -1)
    return F.coalesce(F.try_divide(last["v"], (last["m"] + last["a"]).cast("double")), F.lit(1.0))


def score_column(node: Node, gold: Column, pred: Column, gold_type: T.DataType, pred_type: T.DataType, custom: Custom | None = None, around: Around | None = None) -> Column:
    """The score of gold against pred as one expression. ``around``: what comparators that want a context see, if they may."""
    if node.id_scope or node.ref:
        raise Unsupported("identifiers need all records of a pair")
    if isinstance(gold_type, T.StructType):
        if not isinstance(pred_type, T.StructType) or node.type != "object":
            raise Unsupported("an object needs structs on both sides")
        return null_aware(gold, pred, _object(node, gold, pred, gold_type, pred_type, custom, around), node.null_score)
    if isinstance(gold_type, T.ArrayType):
        if not isinstance(pred_type, T.ArrayType) or node.type != "array":
            raise Unsupported("a list needs arrays on both sides")
        return null_aware(gold, pred, _list(node, gold, pred, gold_type, pred_type, custom), node.null_score)
    return leaf_column(node, gold, pred, custom, around)


def object_terms(node: Node, gold_type: T.StructType, pred_type: T.StructType, options: Options | None = None) -> list[tuple[Any, Any, float, float, float]]:
    """(gold key, pred key, likeness, confidence, weight of the value) of every row of an object's alignment: types name the keys."""
    rows = pair_keys(node, tuple(gold_type.fieldNames()), tuple(pred_type.fieldNames()), options or Options())
    both = lambda g, p: g is not ABSENT and p is not ABSENT and g in node.properties  # noqa: E731  undeclared keys count as 0
    return [(g, p, s, sure, node.properties[g].weight if both(g, p) else 1.0) for g, p, s, sure in rows]


def _object(node: Node, gold: Column, pred: Column, gold_type: T.StructType, pred_type: T.StructType, custom: Custom | None, around: Around | None = None) -> Column:
    rows = object_terms(node, gold_type, pred_type)
    if not rows:
        return F.lit(1.0)
    weights = sum(w for *_, w in rows)
    keys = sum(s for _, _, s, _, _ in rows) / len(rows)
    values = F.lit(0.0)
    for g, p, _, _, w in rows:
        if g is not ABSENT and p is not ABSENT and g in node.properties and w:  # values without weight are not computed
            inside = None if around is None else around.below(gold, pred, gold_type, pred_type, g)
            values = values + F.lit(w) * score_column(node.properties[g], gold[g], pred[p], gold_type[g].dataType, pred_type[p].dataType, custom, inside)
    values = values / F.lit(weights) if weights else F.lit(0.0)
    whole = node.key_importance + node.value_importance
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(node.key_importance / whole * keys) + F.lit(node.value_importance / whole) * values))


def prefix_score(node: Node, gold: Column, pred: Column, gold_type: T.ArrayType, pred_type: T.ArrayType, custom: Custom | None = None) -> Column:
    above, below = F.lit(0.0), F.lit(0.0)
    for k, (child, w) in enumerate(zip(node.prefix, node.prefix_weights, strict=True)):
        has_g, has_p = F.size(gold) > k, F.size(pred) > k
        s = score_column(child, F.get(gold, F.lit(k)), F.get(pred, F.lit(k)), gold_type.elementType, pred_type.elementType, custom)
        above = above + F.when(has_g & has_p, F.lit(w) * s).otherwise(F.lit(0.0))
        below = below + F.when(has_g | has_p, F.lit(w)).otherwise(F.lit(0.0))
    return F.coalesce(F.try_divide(above, below), F.lit(1.0))


def _list(node: Node, gold: Column, pred: Column, gold_type: T.ArrayType, pred_type: T.ArrayType, custom: Custom | None) -> Column:
    if node.prefix is None:
        return _pairs(node, gold, pred, gold_type, pred_type)
    first = prefix_score(node, gold, pred, gold_type, pred_type, custom)
    if node.items is None:
        return first
    if node.prefix_importance is None or node.rest_importance is None:
        raise ValueError("prefixItems beside items need prefixImportance and restImportance")
    k = len(node.prefix)
    rest = _pairs(node, F.slice(gold, k + 1, 1 << 30), F.slice(pred, k + 1, 1 << 30), gold_type, pred_type)
    whole = node.prefix_importance + node.rest_importance
    return F.lit(node.prefix_importance / whole) * first + F.lit(node.rest_importance / whole) * rest


def _pairs(node: Node, gold: Column, pred: Column, gold_type: T.ArrayType, pred_type: T.ArrayType) -> Column:
    if node.items is None:
        raise ValueError("an array needs items or prefixItems")
    if gold_type.containsNull and node.items.nullable:
        raise Unsupported("lists with null items")
    exact = node.items.score == "exact" and node.items.type in ("string", "integer", "number") and node.items.threshold <= 1
    if node.order == "align":
        if not exact:
            raise Unsupported("pairing in any order by likeness")
        floating = isinstance(gold_type.elementType, (T.DoubleType, T.FloatType))
        return bag_score(gold, pred, node.ignore_excess, node.ignore_missing, floating)
    raise Unsupported("lists in order: a programme over cells, which arrays in rows would copy for each cell")
