"""The node table of typed pairs as expressions: where types fix the shape of the alignment, no pair goes to Python.

Objects and leaves have a fixed place each, so a pair's rows are known before its data: leaves are compared in one projection,
objects' scores follow from them, and one generator makes the rows. Every column picks its value by the row's number, so that
columns nobody asks for are never computed. Lists of plain values are aligned for whole Arrow batches, only their two columns and
the alignment's numbers pass; their rows come from the same generator. Lists of lists or objects, identifiers and references
need the kernel (``Unsupported``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_type

from ..functions.rows import exploded
from ..operators import batch
from ..operators.kernel import ABSENT, Comparison, Options, escaped
from ..operators.nodes import COLUMNS, INVALID, NODES
from ..operators.validate import Breaches, breached, first_breach, first_path, json_text
from .columns import Custom, Unsupported, leaf_column, object_terms
from .schema import Node

_TYPES = dict(c.split() for c in NODES.split(", "))


#: Numbers of nodes that the rows of a list take, and rows of fixed places that a schema may have.
LIST_ROWS, PLACES = 1 << 20, 1 << 16


@dataclass
class Row:
    """One row of the node table: plain values where they are the same for all pairs, columns where not."""

    values: dict[str, Any]
    there: Column | None = None  # whether a pair has it; None: every valid pair
    items: ListItems | None = None  # the rows below it, if it is a list


@dataclass
class ListItems:
    """The rows of a list's alignment: the column that has them, and each column's value by (row, its number)."""

    rows: Column
    values: Callable[[Column, Column], dict[str, Any]]


class _Walk:
    def __init__(self, options: Options, custom: Custom | None):
        self.options, self.custom = options, custom
        self.rows: list[Row] = []
        self.next_id = 0
        self.levels: dict[int, dict[str, Column]] = {}  # scores by how deep their inputs lie: leaves first

    def _named(self, level: int, c: Column) -> Column:
        name = f"_s{sum(map(len, self.levels.values()))}"
        self.levels.setdefault(level, {})[name] = c
        return F.col(name)

    def _row(self, there: Column | None, **values: Any) -> Row:
        base = {c: None for c in COLUMNS} | {"node_id": self.next_id, "confidence": 1.0, "parent_confidence": 1.0, "has_target": False}
        self.rows.append(Row(base | values, there))
        self.next_id += 1
        if len(self.rows) >= PLACES or self.next_id > 2**31 - 2 * LIST_ROWS:
            raise Unsupported("more places than numbers of nodes")
        return self.rows[-1]

    def walk(self, node: Node, gold: Column | None, pred: Column | None, gold_type: T.DataType | None, pred_type: T.DataType | None, there: Column | None, about: dict[str, Any]) -> tuple[Any, Any, int]:
        """Adds the rows of a value and below; (its score, its confidence, the level of its score)."""
        if node.id_scope or node.ref:
            raise Unsupported("identifiers need all records of a pair")
        text = {"gold": json_text(gold, gold_type), "pred": json_text(pred, pred_type)}
        text = {k: F.coalesce(v, F.lit("null")) for k, v in text.items()}
        own = self._row(there, part="value", has_gold=True, has_pred=True, **text, **about)
        if isinstance(gold_type, T.StructType) and isinstance(pred_type, T.StructType) and node.type == "object":
            return self._object(node, gold, pred, gold_type, pred_type, there, own)
        if isinstance(gold_type, T.ArrayType) and isinstance(pred_type, T.ArrayType) and node.type == "array":
            return self._list(node, gold, pred, gold_type, pred_type, there, own)
        if isinstance(gold_type, (T.StructType, T.ArrayType)) or isinstance(pred_type, (T.StructType, T.ArrayType)):
            raise Unsupported("lists and objects beside other values have rows that depend on data")
        score = self._named(0, leaf_column(node, gold, pred, self.custom))
        own.values |= {"node_type": "item", "kind": F.when(gold.isNull() | pred.isNull(), "null").otherwise("score"), "score": score, "is_leaf": True}
        return score, 1.0, 1

    def _list(self, node: Node, gold: Column, pred: Column, gold_type: T.ArrayType, pred_type: T.ArrayType, there: Column | None, own: Row) -> tuple[Any, Any, int]:
        inner = gold_type.elementType, pred_type.elementType
        if self.options.compute_confidence or any(isinstance(t, (T.StructType, T.ArrayType)) for t in inner):
            raise Unsupported("lists of lists or objects, and how sure pairings are")
        plan = Comparison(node, self.options, {k: dict(v) for k, v in (self.custom or {}).items()})
        batch.BatchScorer(plan).check(node, to_arrow_type(gold_type), to_arrow_type(pred_type))
        found = self._named(0, F.arrow_udf(batch.aligned_lists(plan), batch.ALIGNED)(gold, pred))
        about, both = own.values, gold.isNotNull() & pred.isNotNull()
        kind = ("reorder" if node.order == "align" else "fixed") if node.prefix is None else "prefix" if node.items is None else "combined"
        null = F.when(gold.isNull() & pred.isNull(), F.lit(1.0)).when(~both, F.lit(float(node.null_score)))
        score = self._named(1, null.otherwise(found["score"]))
        rows = F.when(both if there is None else there & both, found["rows"])
        about |= {"node_type": F.when(both, "list").otherwise("item"), "kind": F.when(both, kind).otherwise("null"), "score": score, "is_leaf": ~both | ~F.exists(F.coalesce(rows, F.array().cast("array<struct<step:int,at:int,g:int,p:int,s:double,a:double>>")), lambda r: r["a"] > 0), "n_gold": F.when(both, F.size(gold)), "n_pred": F.when(both, F.size(pred))}
        path, at = ("" if about["path"] == "/" else about["path"]), ("" if about["at"] == "/" else about["at"])
        base = {c: None for c in COLUMNS} | {"parent_id": about["node_id"], "depth": about["depth"] + 1, "part": "value", "node_type": "item", "parent_kind": kind, "list_path": path or "/", "list_at": at or "/", "confidence": 1.0, "parent_confidence": 1.0, "is_leaf": True, "has_target": False, "renamed": about["renamed"]}
        first, weight = self.next_id, about["weight"]
        self.next_id += LIST_ROWS

        def values(r: Column, k: Column) -> dict[str, Any]:
            g, p = r["g"], r["p"]
            mine, theirs = F.get(gold, g), F.get(pred, p)
            told = F.when(g.isNull() & p.isNull(), "absent").when(g.isNull() | p.isNull(), "unmatched").when(mine.isNull() | theirs.isNull(), "null").otherwise("score")
            text = lambda i, v, t: F.when(i.isNotNull(), F.coalesce(json_text(v, t), F.lit("null")))
            return base | {
                "node_id": F.lit(first) + k, "path": F.concat(F.lit(f"{path}/"), r["step"].cast("string")), "at": F.concat(F.lit(f"{at}/"), r["at"].cast("string")), "kind": told, "score": r["s"], "weight": r["a"] * F.lit(weight),
                "has_gold": g.isNotNull(), "has_pred": p.isNotNull(), "gold": text(g, mine, inner[0]), "pred": text(p, theirs, inner[1]),
            }

        own.items = ListItems(rows, values)
        return score, 1.0, 2

    def _object(self, node: Node, gold: Column, pred: Column, gold_type: T.StructType, pred_type: T.StructType, there: Column | None, own: Row) -> tuple[Any, Any, int]:
        about = own.values
        both = gold.isNotNull() & pred.isNotNull()
        below = both if there is None else there & both
        terms = object_terms(node, gold_type, pred_type, self.options)
        whole = node.key_importance + node.value_importance
        total = sum(w for *_, w in terms)
        key_share = node.key_importance / whole / len(terms) if terms else 0.0
        score, keys_sure, values_sure, deepest = F.lit(0.0), [], F.lit(0.0), 0
        shares = []
        path, at = ("" if about["path"] == "/" else about["path"]), ("" if about["at"] == "/" else about["at"])
        first = len(self.rows)
        for g, p, likeness, sure, w in terms:
            share = node.value_importance / whole * w / total if total else 0.0
            shares += [share, key_share]
            name, place = escaped(g if g is not ABSENT else p), escaped(p if p is not ABSENT else g)
            keys = {"gold_key": None if g is ABSENT else g, "pred_key": None if p is ABSENT else p}
            has = {"has_gold": g is not ABSENT, "has_pred": p is not ABSENT}
            renamed = about["renamed"]
            if renamed is None and g is not ABSENT and p is not ABSENT and g != p:
                renamed = self.next_id
            of = {"parent_id": about["node_id"], "depth": about["depth"] + 1, "path": f"{path}/{name}", "parent_kind": "object", "list_path": path or "/", "at": f"{at}/{place}", "list_at": at or "/", "renamed": renamed} | keys
            quoted = {s: None if k is None else F.substring(json_text(F.array(F.lit(k)), T.ArrayType(T.StringType())), 2, 1 << 30) for s, k in (("gold", keys["gold_key"]), ("pred", keys["pred_key"]))}
            quoted = {s: None if q is None else q.substr(F.lit(1), F.length(q) - 1) for s, q in quoted.items()}
            self._row(below, part="key", node_type="item", kind="key", score=likeness, confidence=sure, weight=about["weight"] * key_share, is_leaf=True, **quoted, **has, **of)
            of |= {"weight": about["weight"] * share, "key_score": likeness, "key_weight": about["weight"] * key_share, "key_confidence": sure}
            score = score + F.lit(likeness * key_share)
            if g is ABSENT or p is ABSENT or g not in node.properties:
                sides = {"gold": None if g is ABSENT else F.coalesce(json_text(gold[g], gold_type[g].dataType), F.lit("null")), "pred": None if p is ABSENT else F.coalesce(json_text(pred[p], pred_type[p].dataType), F.lit("null"))}
                alone = g is ABSENT or p is ABSENT
                self._row(below, part="value", node_type="item", kind="unmatched" if alone else "undeclared", score=0.0, is_leaf=True, **has, **sides, **of)
                values_sure = values_sure + F.lit(float(w))
                if not alone:
                    keys_sure.append(sure)
                continue
            keys_sure.append(sure)
            row = len(self.rows)
            s, c, level = self.walk(node.properties[g], gold[g], pred[p], gold_type[g].dataType, pred_type[p].dataType, below, of)
            child = self.rows[row].values
            if isinstance(child["node_type"], str):
                c = child["confidence"] = min(c, sure) if not isinstance(c, Column) else c
            else:  # an item where one side is null
                c = child["confidence"] = F.when(child["node_type"] == "item", F.lit(sure)).otherwise(c)
            score, deepest = score + F.lit(share) * s, max(deepest, level)
            values_sure = values_sure + F.lit(float(w)) * (c if isinstance(c, Column) else F.lit(c))
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)) if terms else F.lit(1.0)
        null = F.when(gold.isNull() & pred.isNull(), F.lit(1.0)).when(~both, F.lit(float(node.null_score)))
        made = self._named(deepest, null.otherwise(score))
        sure: Any = 1.0
        if self.options.compute_confidence and keys_sure:
            mean = sum(keys_sure) / len(keys_sure)
            values = values_sure / F.lit(float(total)) if total else F.lit(1.0)
            sure = (F.lit(node.key_importance * mean) + F.lit(node.value_importance) * values) / F.lit(whole)
        for r in self.rows[first:]:
            if r.values["parent_id"] == about["node_id"]:
                r.values["parent_confidence"] = sure
        flat = not terms or not any(x > 0 for x in shares)
        about |= {"node_type": F.when(both, "dict").otherwise("item"), "kind": F.when(both, "object").otherwise("null"), "score": made, "is_leaf": F.lit(True) if flat else ~both, "confidence": sure}
        return made, sure, deepest + 1


def typed_nodes(pairs: DataFrame, node: Node, kinds: dict[str, T.DataType], options: Options, custom: Custom | None, errors: Callable[[DataFrame], tuple[Breaches, Breaches]]) -> DataFrame:
    """NODES of (pair_id, gold, pred) with struct or primitive columns, without leaving the JVM but for comparators that it lacks.

    The rows are those of ``node_table``; where an object is null on one side, numbers of nodes are passed over. ``errors``: how
    gold and pred can break the schema.
    """
    walk = _Walk(options, custom)
    walk.walk(node, F.col("gold"), F.col("pred"), kinds["gold"], kinds["pred"], None, {"depth": 0, "path": "/", "parent_kind": "root", "list_path": "/", "at": "/", "list_at": "/", "weight": 1.0, "renamed": None})
    bad_gold, bad_pred = errors(pairs)
    df = pairs.select(F.col("pair_id").cast("string").alias("pair_id"), "gold", "pred")
    if bad_gold or bad_pred:
        df = df.withColumn("_valid", validity(F.col("pair_id"), bad_gold, bad_pred))
    for level in sorted(walk.levels):
        df = df.withColumns(walk.levels[level])
    valid = F.col("_valid")
    strict = bool(bad_gold or bad_pred)
    rows = walk.rows
    lists = [(k, r.items) for k, r in enumerate(rows) if r.items is not None]
    if all(r.there is None for r in rows):
        numbers = F.lit(list(range(len(rows))))
    else:
        numbers = F.array(*(F.lit(k) if r.there is None else F.when(r.there, F.lit(k)) for k, r in enumerate(rows)))
    if lists:  # row i of a list in place k has the number k + (i + 1) * PLACES
        of = lambda k, items: F.transform(items.rows, lambda _, i: (i.cast("long") + 1) * PLACES + k)
        numbers = F.concat(numbers.cast("array<long>"), *(F.coalesce(of(k, items), F.array().cast("array<long>")) for k, items in lists))
    numbers = F.when(valid, numbers).otherwise(F.array(F.lit(-1)).cast("array<long>" if lists else "array<int>")) if strict else numbers
    df = exploded(df, numbers, "_n")
    n = F.col("_n")
    below = {}
    if lists:
        df = df.withColumns({"_i": F.when(F.col("_n") >= PLACES, F.floor(F.col("_n") / PLACES).cast("int") - 1), "_n": F.when(F.col("_n") < 0, F.col("_n")).otherwise(F.col("_n") % PLACES).cast("int")})
        i = F.col("_i")
        below = {k: items.values(F.get(items.rows, i), i) for k, items in lists}

    def column(name: str) -> Column:
        if name == "valid":
            return n >= 0
        if name == "total":
            return F.when(n >= 0, rows[0].values["score"]).otherwise(F.lit(0.0))
        if name in ("error_path", "error"):
            return (F.when(n < 0, first_breach(bad_pred)["path" if name == "error_path" else "message"]) if bad_pred else F.lit(None)).cast("string")
        kind, values = _TYPES[name], [r.values[name] for r in rows]
        odd: Any = INVALID.get(name)
        if name in ("gold", "pred"):
            odd = values[0]
        if not any(isinstance(v, Column) for v in values):
            got = F.lit(values[0]).cast(kind) if all(v == values[0] for v in values) else F.get(F.array(*(F.lit(v).cast(kind) for v in values)), n)
        else:  # a branch only for what is computed: the JVM leaves methods beyond 8,000 bytes of code uncompiled
            plain = [None if isinstance(v, Column) else v for v in values]
            got = F.get(F.array(*(F.lit(v).cast(kind) for v in plain)), n) if any(v is not None for v in plain) else F.lit(None).cast(kind)
            branches = [(k, v.cast(kind)) for k, v in enumerate(values) if isinstance(v, Column)]
            chosen = F.when(n == branches[0][0], branches[0][1])
            for k, v in branches[1:]:
                chosen = chosen.when(n == k, v)
            got = chosen.otherwise(got)
        for k, about in below.items():
            v = about[name]
            got = F.when((n == k) & F.col("_i").isNotNull(), (v if isinstance(v, Column) else F.lit(v)).cast(kind)).otherwise(got)
        return F.when(n >= 0, got).otherwise((odd if isinstance(odd, Column) else F.lit(odd)).cast(kind)) if strict else got

    return df.select("pair_id", *(column(c).alias(c) for c in COLUMNS if c != "pair_id"))


def validity(pair_id: Column, bad_gold: Breaches, bad_pred: Breaches) -> Column:
    """Whether pred keeps the schema; a gold that breaks it raises. The error names the place alone: its code is in every row's way."""
    valid = ~breached(bad_pred)
    if not bad_gold:
        return valid
    said = F.concat_ws(" ", F.lit("gold of pair"), pair_id.cast("string"), F.lit("breaks the schema at"), first_path(bad_gold))
    return F.when(breached(bad_gold), F.raise_error(said).cast("boolean")).otherwise(valid)


def losses(pairs: DataFrame, node: Node, kinds: dict[str, T.DataType], options: Options, custom: Custom | None) -> tuple[DataFrame, list[Row]]:
    """(pairs with their scores' columns, the rows) for what needs no row of its own, such as the leaf that costs most."""
    walk = _Walk(options, custom)
    walk.walk(node, F.col("gold"), F.col("pred"), kinds["gold"], kinds["pred"], None, {"depth": 0, "path": "/", "parent_kind": "root", "list_path": "/", "at": "/", "list_at": "/", "weight": 1.0, "renamed": None})
    if any(r.items is not None for r in walk.rows):
        raise Unsupported("rows of lists are no places")
    for level in sorted(walk.levels):
        pairs = pairs.withColumns(walk.levels[level])
    return pairs, walk.rows
