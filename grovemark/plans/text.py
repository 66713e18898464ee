"""JSON texts as VARIANT columns: validation and scores of text pairs under static schemas, without leaving the JVM.

A text is parsed once; the schema's places are taken out of it as variants beside tags of their JSON types. An absent key is SQL
null, a null value a variant null. What depends on keys that only data has (fuzzy keys of unequal objects) is told by a
condition, so that only those pairs go to the kernel. ``Unsupported``: identifiers and references, choices of schemas, several types
for one place, and lists that are paired by likeness.

JSON as VARIANT reads it: a text with a key that repeats within an object, or with NaN, is no JSON.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.leaf import COMPARATORS, DEFAULTS, threshold
from ..functions.strings import SIMILARITIES
from .columns import Custom, Unsupported, bag_score, custom_column, ordered_score
from .schema import Node

Breaches = list[tuple[Column, Column, Column]]


def variant_path(key: str | int) -> str:
    """The path of one step for ``variant_get``."""
    if isinstance(key, int):
        return f"$[{key}]"
    if "'" in key and '"' in key:
        raise Unsupported(f"key {key!r} holds both kinds of quotes")
    return f"$['{key}']" if "'" not in key else f'$["{key}"]'


def part(v: Column, key: str | int) -> Column:
    """A variant's value at a key or index, SQL null where there is none."""
    return F.try_variant_get(v, variant_path(key), "variant")


def value_at(text: Column, pointer: str) -> Column:
    """The value of a JSON text at a JSON pointer as JSON text; null where the pointer leads nowhere. A step of digits is also an index."""
    v = F.try_parse_json(text)
    for step in (t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:] if pointer not in ("", "/")):
        by_key = part(v, step)
        v = F.coalesce(by_key, part(v, int(step))) if step.isdigit() else by_key
    return F.to_json(v)


def schema_edges(node: Node, pointer: str) -> list[tuple[str, str | int, Node]]:
    """(edge, key, node) of each step of a JSON pointer through a schema: 'property', 'prefix' or 'item'; ends where the schema does."""
    out: list[tuple[str, str | int, Node]] = []
    for step in (t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:] if pointer not in ("", "/")):
        index = int(step) if step.isdigit() else None
        if step in node.properties:
            out.append(("property", step, node.properties[step]))
        elif index is not None and node.prefix and index < len(node.prefix):
            out.append(("prefix", index, node.prefix[index]))
        elif index is not None and node.items is not None:
            out.append(("item", index, node.items))
        else:
            break
        node = out[-1][2]
    return out


#: JSON's type by the name of a variant's, integers and numbers told apart; integers beyond 64 bits are decimals of 19 digits or more.
_TAGS = {"BIGINT": "integer", "INT": "integer", "SMALLINT": "integer", "TINYINT": "integer", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "ARRAY": "array", "OBJECT": "object", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number"}
_TAGS |= {f"DECIMAL({n},0)": "integer" for n in range(19, 39)}


def tag(v: Column) -> Column:
    """The JSON type of a variant; SQL null for SQL null."""
    name = F.regexp_extract(F.schema_of_variant(v), "^(?:DECIMAL\\((?:19|[23][0-9]),0\\)|[A-Z]+)", 0)
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in _TAGS.items() for x in pair)), name)


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _keys(v: Column) -> Column:
    return F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))


Keep = Callable[[int, Column], Column]


def text_breaches(schema: dict, v: Column, path: Column | str = "", keep: Keep | None = None, level: int = 0) -> Breaches:
    """(condition, path, message) of each way in which a variant can break the schema, in the order of ``first_error``.

    ``v`` is never SQL null where it is looked at. Messages spell values as JSON. ``keep`` may store what several conditions read:
    it is given the level at which a column's inputs can be read.
    """
    hold = keep or (lambda _, column: column)
    if "oneOf" in schema:
        raise Unsupported("choices of schemas in texts")
    path = F.lit(path) if isinstance(path, str) else path
    at = F.when(path == "", F.lit("/")).otherwise(path)
    out: Breaches = []

    def breach(condition: Column, *message: Column | str) -> None:
        out.append((condition, at, F.concat(*(F.lit(m) if isinstance(m, str) else m for m in message))))

    kind, spelt = hold(level, tag(v)), F.to_json(v)
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else list(kinds or ())
    if kinds:
        fits = kind.isin([*kinds, *(["integer"] if "number" in kinds else [])])
        if "integer" in kinds and "number" not in kinds:
            number = F.try_variant_get(v, "$", "double")
            fits = fits | ((kind == "number") & (number == F.floor(number)))
        breach(~fits, spelt, f" is not of type {', '.join(kinds)}")
    if "enum" in schema:
        among = F.lit(False)
        for x in schema["enum"]:
            if x is None:
                among = among | (kind == "null")
            elif isinstance(x, bool):
                among = among | ((kind == "boolean") & (F.try_variant_get(v, "$", "boolean") == x))
            elif isinstance(x, (int, float)):
                among = among | (kind.isin("integer", "number") & (F.try_variant_get(v, "$", "double") == float(x)))
            elif isinstance(x, str):
                among = among | ((kind == "string") & (F.try_variant_get(v, "$", "string") == x))
            else:
                raise Unsupported("enumerated lists or objects")
        breach(~F.coalesce(among, F.lit(False)), spelt, f" is not one of {schema['enum']!r}")
    known, required = schema.get("properties", {}), schema.get("required", ())
    is_object = kind == "object"
    for key in required:
        breach(is_object & part(v, key).isNull(), f"{key!r} is required")
    if schema.get("additionalProperties") is False:
        extra = F.array_except(_keys(v), F.array(*map(F.lit, known)).cast("array<string>"))
        breach(is_object & (F.size(extra) > 0), "'", F.coalesce(F.get(extra, F.lit(0)), F.lit("")), "' is not allowed")
    for key, inner in known.items():
        got = hold(level, part(v, key))
        found = text_breaches(inner, got, F.concat(path, F.lit("/" + key.replace("~", "~0").replace("/", "~1"))), keep, level + 1)
        out += [(is_object & got.isNotNull() & condition, *told) for condition, *told in found]
    first, rest = schema.get("prefixItems", []), schema.get("items")
    if first or isinstance(rest, dict) or "minItems" in schema or "maxItems" in schema:
        is_array, items = kind == "array", hold(level, _items(v))
        if schema.get("minItems", 0) > 0:
            breach(is_array & (F.size(items) < schema["minItems"]), f"fewer than {schema['minItems']} items")
        if "maxItems" in schema:
            breach(is_array & (F.size(items) > schema["maxItems"]), f"more than {schema['maxItems']} items")
        for k, inner in enumerate(first):
            found = text_breaches(inner, hold(level + 1, F.get(items, F.lit(k))), F.concat(path, F.lit(f"/{k}")), keep, level + 2)
            out += [(is_array & (F.size(items) > k) & condition, *told) for condition, *told in found]
        if isinstance(rest, dict) and text_breaches(rest, v):
            others = F.slice(items, len(first) + 1, 1 << 30) if first else items
            of = lambda x, i: text_breaches(rest, x, F.concat(path, F.lit("/"), (i + len(first)).cast("string")))
            told = F.get(F.array_compact(F.transform(others, lambda x, i: first_of(of(x, i)))), F.lit(0))
            out.append((is_array & F.exists(others, lambda x: any_of(of(x, F.lit(0)))), told["path"], told["message"]))
    return out


def any_of(found: Breaches) -> Column:
    out = F.lit(False)
    for condition, *_ in found:
        out = out | F.coalesce(condition, F.lit(False))
    return out


def first_of(found: Breaches) -> Column:
    """struct(path, message) of the first breach, null without one."""
    if not found:
        return F.lit(None).cast("struct<path:string,message:string>")
    return F.coalesce(*(F.when(condition, F.struct(path.alias("path"), said.alias("message"))) for condition, path, said in found))


def first_place(found: Breaches) -> Column:
    """The path of the first breach: the message's code isn't in every row's way."""
    return F.coalesce(*(F.when(condition, path) for condition, path, _ in found)) if found else F.lit(None).cast("string")


class _Scorer:
    """Scores by levels: a level's columns are stored before those that read them, so that nothing is computed twice."""

    def __init__(self, custom: Custom | None, masked: set[str] | None = None):
        self.custom, self.masked = custom, masked  # masked: identifiers, and references to these scopes, count as right
        self.levels: list[dict[str, Column]] = []
        self.known: dict[str, Column] = {}
        self.odd: list[Column] = []  # conditions under which a pair needs the kernel

    def named(self, level: int, c: Column) -> Column:
        """A stored column; one that is there already is read again."""
        if (found := self.known.get(str(c))) is not None:
            return found
        while len(self.levels) <= level:
            self.levels.append({})
        name = f"_v{sum(map(len, self.levels))}"
        self.levels[level][name] = c
        self.known[str(c)] = F.col(name)
        return F.col(name)

    def leaf(self, node: Node, g: Column, p: Column, tags: tuple[Column, Column] | None) -> Column:
        """The score of two values that the schema fits and that aren't null."""
        kind, name = node.type, node.score or DEFAULTS.get(node.type)
        if kind not in COMPARATORS:
            raise Unsupported(f"no single primitive type in {node.types}")
        of = {"string": "string", "boolean": "boolean"}.get(kind, "double")
        a, b = (F.try_variant_get(x, "$", of) for x in (g, p))
        own = (self.custom or {}).get(kind, {}).get(name) or ((self.custom or {}).get("number", {}).get(name) if kind == "integer" else None)
        if own is not None:
            if tags is None:
                raise Unsupported("a custom comparator inside a list")
            if kind == "integer":
                a, b = a.cast("long"), b.cast("long")
            return threshold(custom_column(name, own, kind == "integer")(a, b), node.threshold)
        if name not in COMPARATORS[kind]:
            raise Unsupported(f"no expression for comparator {name!r}")
        if tags is None and kind == "string" and name in SIMILARITIES and name not in ("exact", "levenshtein"):
            raise Unsupported("a Python comparator inside a list")
        score = COMPARATORS[kind][name](a, b)
        if name == "exact" and of == "double" and tags is not None:  # doubles lose digits of large integers
            whole = [F.try_variant_get(x, "$", "decimal(38,0)") for x in (g, p)]
            score = F.when((tags[0] == "integer") & (tags[1] == "integer"), whole[0].eqNullSafe(whole[1]).cast("double")).otherwise(score)
        return threshold(score, node.threshold)

    def score(self, node: Node, g: Column, p: Column, there: Column, level: int, in_object: bool) -> tuple[Column, int]:
        """(score, the level it can be read at) of two places; ``there``: both have a value. g and p can be read at ``level``."""
        if self.masked is not None and (node.id_scope or node.ref in self.masked):
            return F.when(there, F.lit(1.0)), level
        if node.id_scope or node.ref:
            raise Unsupported("identifiers need all records of a pair")
        if node.type is None:
            raise Unsupported(f"no single type in {node.types}")
        tags = self.named(level, tag(g)), self.named(level, tag(p))
        both = there & (tags[0] != "null") & (tags[1] != "null")
        if node.type == "object":
            score, level = self.object(node, g, p, both, level + 1)
        elif node.type == "array":
            score, level = self.list(node, g, p, both, level + 1)
        else:
            score, level = self.leaf(node, g, p, tags), level + 1
        if in_object:  # values of other kinds are compared to nothing
            score = F.when(tags[0] == tags[1], score).otherwise(F.lit(0.0))
        nulls = F.when((tags[0] == "null") & (tags[1] == "null"), F.lit(1.0)).when((tags[0] == "null") | (tags[1] == "null"), F.lit(float(node.null_score)))
        return self.named(level, F.when(there, nulls.otherwise(score))), level + 1

    def object(self, node: Node, g: Column, p: Column, both: Column, level: int) -> tuple[Column, int]:
        if node.key_score not in ("jaro", "exact"):
            raise ValueError(f"keyScore must be 'jaro' or 'exact', not {node.key_score!r}")
        one = lambda c: F.when(c, 1).otherwise(0)
        paired, alone, values, weights = F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0)
        if node.raw.get("additionalProperties") is not False:
            declared = F.array(*map(F.lit, node.properties)).cast("array<string>")
            mine, theirs = (self.named(level, F.array_except(_keys(x), declared)) for x in (g, p))
            paired = F.size(F.array_intersect(mine, theirs))
            alone = F.size(mine) + F.size(theirs) - 2 * paired
            weights = (paired + alone).cast("double")
        parts = {key: (self.named(level, part(g, key)), self.named(level, part(p, key))) for key in node.properties}
        deepest = level + 1
        for key, (a, b) in parts.items():
            here, some = a.isNotNull() & b.isNotNull(), a.isNotNull() | b.isNotNull()
            w = node.properties[key].weight
            paired, alone = paired + one(here), alone + one(some & ~here)
            weights = weights + F.when(here, F.lit(w)).when(some, F.lit(1.0)).otherwise(F.lit(0.0))
            if w:
                score, ready = self.score(node.properties[key], a, b, both & here, level + 1, True)
                values, deepest = values + F.when(here, F.lit(w) * score).otherwise(F.lit(0.0)), max(deepest, ready)
        if node.key_score == "jaro":
            self.odd.append(both & (alone > 0))
        whole = node.key_importance + node.value_importance
        keys = F.lit(node.key_importance / whole) * paired / (paired + alone)
        score = keys + F.lit(node.value_importance / whole) * F.coalesce(F.try_divide(values, weights), F.lit(0.0))
        return F.when(paired + alone > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(F.lit(1.0)), deepest

    def list(self, node: Node, g: Column, p: Column, both: Column, level: int) -> tuple[Column, int]:
        mine, theirs = (self.named(level, _items(x)) for x in (g, p))
        if node.prefix is None:
            return self.pairing(node, mine, theirs), level + 1
        k, deepest = len(node.prefix), level + 2
        above, below = F.lit(0.0), F.lit(0.0)
        for n, (child, w) in enumerate(zip(node.prefix, node.prefix_weights, strict=True)):
            has_g, has_p = F.size(mine) > n, F.size(theirs) > n
            a, b = (self.named(level + 1, F.get(x, F.lit(n))) for x in (mine, theirs))
            score, ready = self.score(child, a, b, both & has_g & has_p, level + 2, False)
            deepest = max(deepest, ready)
            above = above + F.when(has_g & has_p, F.lit(w) * score).otherwise(F.lit(0.0))
            below = below + F.when(has_g | has_p, F.lit(w)).otherwise(F.lit(0.0))
        first = F.coalesce(F.try_divide(above, below), F.lit(1.0))
        if node.items is None:
            return first, deepest
        if node.prefix_importance is None or node.rest_importance is None:
            raise ValueError("prefixItems beside items need prefixImportance and restImportance")
        rest = self.pairing(node, *(F.slice(x, k + 1, 1 << 30) for x in (mine, theirs)))
        whole = node.prefix_importance + node.rest_importance
        return F.lit(node.prefix_importance / whole) * first + F.lit(node.rest_importance / whole) * rest, deepest

    def pairing(self, node: Node, g: Column, p: Column) -> Column:
        if node.items is None:
            raise ValueError("an array needs items or prefixItems")
        if node.order not in ("fixed", "align"):
            raise ValueError(f"order must be 'fixed' or 'align', not {node.order!r}")
        item = node.items
        if item.nullable or item.type not in ("string", "integer", "number", "boolean"):
            raise Unsupported("lists of lists, objects or nulls")
        if node.order == "align":
            if item.score != "exact" or item.type == "boolean" or item.threshold > 1:
                raise Unsupported("pairing in any order by likeness")
            of = "string" if item.type == "string" else "double"
            plain = lambda x: F.transform(x, lambda v: F.try_variant_get(v, "$", of))
            return bag_score(plain(g), plain(p), node.ignore_excess, node.ignore_missing, of == "double")
        if node.ignore_excess or node.ignore_missing:
            raise Unsupported("ordered lists with ignored rows")
        return ordered_score(g, p, lambda a, b: self.leaf(item, a, b, None))


def text_likeness(pairs: DataFrame, node: Node, masked: set[str], custom: Custom | None = None) -> DataFrame:
    """``pairs`` of variants _g and _p, both there, with s, their score under ``node`` with identifiers and references to ``masked`` scopes as right.

    Unsupported where objects' keys are matched by likeness and can differ.
    """
    scorer = _Scorer(custom, masked)
    score, _ = scorer.score(node, F.col("_g"), F.col("_p"), F.lit(True), 0, False)
    if scorer.odd:
        raise Unsupported("keys that are matched by likeness")
    for stored in scorer.levels:
        if stored:
            pairs = pairs.withColumns(stored)
    return pairs.withColumn("s", score)


def text_scores(pairs: DataFrame, node: Node, raw: dict, custom: Custom | None) -> tuple[DataFrame, Column | None]:
    """(``pairs`` with a column _score, the condition under which a pair's _score doesn't count because it needs the kernel).

    gold and pred are JSON texts, a null text is the value null. A pred that breaks the schema, or is no JSON, scores 0; a gold
    that does raises.
    """
    for c in ("gold", "pred"):
        pairs = pairs.withColumn(f"_{c[0]}", F.try_parse_json(F.coalesce(c, F.lit("null"))))
    scorer, bad = _Scorer(custom), {}
    for side in ("g", "p"):
        found = text_breaches(raw, F.col(f"_{side}"), "", scorer.named)
        broken = F.col(f"_{side}").isNull()
        bad[side] = broken | any_of(found)
        if side == "g":
            place = F.when(broken, F.lit("/: not JSON")).otherwise(first_place(found))
    told = F.concat_ws(" ", F.lit("gold of pair"), F.col("pair_id").cast("string"), F.lit("breaks the schema at"), place)
    level = len(scorer.levels)
    ok = scorer.named(level, F.when(bad["g"], F.raise_error(told).cast("boolean")).otherwise(~bad["p"]))
    score, _ = scorer.score(node, F.col("_g"), F.col("_p"), ok, level + 1, False)
    for stored in scorer.levels:
        if stored:
            pairs = pairs.withColumns(stored)
    odd: Any = None
    for condition in scorer.odd:
        odd = condition if odd is None else odd | condition
    return pairs.withColumn("_score", F.when(ok, score).otherwise(F.lit(0.0))), None if odd is None else ok & F.coalesce(odd, F.lit(False))
