"""Validation against the used part of JSON Schema: on Python values, and as Column predicates on typed columns."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.columns import Unsupported
from ..plans.text import first_of, text_breaches

_TYPES = {
    "null": lambda v: v is None,
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "string": lambda v: isinstance(v, str),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
}


def first_error(schema: dict, value: Any, path: str = "") -> tuple[str, str] | None:
    """(path, message) of the first breach of type, enum, required, additionalProperties, lengths, oneOf or of an inner schema."""
    at = path or "/"
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return at, f"{value!r} is not of type {', '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return at, f"{value!r} is not one of {schema['enum']!r}"
    if "oneOf" in schema and sum(first_error(s, value, path) is None for s in schema["oneOf"]) != 1:
        return at, f"{value!r} does not fit exactly one of the choices"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for key in schema.get("required", ()):
            if key not in value:
                return at, f"{key!r} is required"
        if schema.get("additionalProperties") is False and (extra := [k for k in value if k not in known]):
            return at, f"{extra[0]!r} is not allowed"
        for key, item in value.items():
            if key in known and (wrong := first_error(known[key], item, f"{path}/{key.replace('~', '~0').replace('/', '~1')}")):
                return wrong
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            return at, f"fewer than {schema['minItems']} items"
        if "maxItems" in schema and len(value) > schema["maxItems"]:
            return at, f"more than {schema['maxItems']} items"
        first = schema.get("prefixItems", [])
        for k, item in enumerate(value):
            inner = first[k] if k < len(first) else schema.get("items")
            if isinstance(inner, dict) and (wrong := first_error(inner, item, f"{path}/{k}")):
                return wrong
    return None


def json_errors(df: DataFrame, column: str, schema: dict) -> DataFrame:
    """Adds valid, error_path and error for a JSON text column, as expressions alone.

    Text that is no JSON, or null, is invalid at the root. The first breach in the order of ``first_error`` is told.
    """
    v = F.try_parse_json(F.col(column))
    first = F.when(v.isNull(), F.struct(F.lit("/").alias("path"), F.lit("not JSON").alias("message"))).otherwise(first_of(text_breaches(schema, v)))
    return df.withColumn("_e", first).withColumns({"valid": F.col("_e").isNull(), "error_path": F.col("_e.path"), "error": F.col("_e.message")}).drop("_e")


def checked(pairs: DataFrame, schema: dict) -> DataFrame:
    """``pairs`` (gold, pred: both JSON text or both typed) with side, error_path and error of the first breach, gold's before pred's; all null for pairs
    that keep the schema. Expressions where the schema allows it, Arrow batches where it has choices or lists of values."""
    told = {}
    for c in ("gold", "pred"):
        kind = pairs.schema[c].dataType
        try:
            if isinstance(kind, T.StringType):
                v = F.try_parse_json(F.coalesce(c, F.lit("null")))
                found = text_breaches(schema, v)
                said = F.when(v.isNull(), F.struct(F.lit("/").alias("path"), F.lit("not JSON").alias("message"))).otherwise(first_of(found))
            else:
                found = typed_breaches(schema, F.col(c), kind)
                said = first_breach(found) if found else F.lit(None).cast("struct<path:string,message:string>")
        except Unsupported:
            said = _python_breach(schema)(F.col(c) if isinstance(kind, T.StringType) else json_text(F.col(c), kind))
        told[c] = said
    out = pairs.withColumns({"_gold_error": told["gold"], "_pred_error": told["pred"]})
    side = F.when(F.col("_gold_error").isNotNull(), "gold").when(F.col("_pred_error").isNotNull(), "pred")
    first = F.coalesce("_gold_error", "_pred_error")
    return out.withColumns({"side": side, "error_path": first["path"], "error": first["message"]}).drop("_gold_error", "_pred_error")


def _python_breach(schema: dict):
    """struct(path, message) of a JSON text's first breach, null without one."""

    @F.arrow_udf("struct<path:string,message:string>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                wrong = first_error(schema, None if text is None else json.loads(text))
            except ValueError:
                wrong = ("/", "not JSON")
            out.append(None if wrong is None else {"path": wrong[0], "message": wrong[1]})
        return pa.array(out, pa.struct([("path", pa.string()), ("message", pa.string())]))

    return run


#: Conditions with the path and the message of what they find.
Breaches = list[tuple[Column, Column, Column]]


def typed_breaches(schema: dict, value: Column, kind: T.DataType, path: Column | str = "") -> Breaches:
    """(condition, path, message) of each way in which a typed column can break the schema; none where its type leaves none open.

    The order of ``first_error``; messages spell values as JSON. Conditions need no message, so that who asks for validity alone
    pays for no text. Unsupported for oneOf, for enumerated lists or objects, and for types that JSON spells otherwise.
    """
    if "oneOf" in schema:
        raise Unsupported("choices of schemas on typed columns")
    path = F.lit(path) if isinstance(path, str) else path
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else list(kinds or ())
    at = F.when(path == "", F.lit("/")).otherwise(path)
    out: Breaches = []

    def breach(condition: Column, *message: Column | str) -> None:
        said = F.concat(*(F.lit(m) if isinstance(m, str) else m for m in message))
        out.append((condition, at, said))

    own, there = json_kind(kind), value.isNotNull()
    spelt = F.coalesce(json_text(value, kind), F.lit("null"))
    if kinds:
        wrong: list[Column] = [] if "null" in kinds else [~there]
        if own == "number" and "integer" in kinds and "number" not in kinds:
            wrong.append(there & (value != F.floor(value)))
        elif own != "null" and own not in kinds and not (own == "integer" and "number" in kinds):
            wrong.append(there)
        for condition in wrong:
            breach(condition, spelt, f" is not of type {', '.join(kinds)}")
    if "enum" in schema:
        same = {"string": (str,), "integer": (int, float), "number": (int, float), "boolean": (bool,)}.get(own, ())
        if not same and own != "null":
            raise Unsupported("enumerated lists or objects")
        among = F.lit(False)
        for x in schema["enum"]:
            if isinstance(x, same) and (own == "boolean" or not isinstance(x, bool)):
                among = among | (value == F.lit(x))
        breach(F.when(there, ~among).otherwise(F.lit(None not in schema["enum"])), spelt, f" is not one of {schema['enum']!r}")
    if isinstance(kind, T.StructType):
        known = schema.get("properties", {})
        for key in schema.get("required", ()):
            if key not in kind.fieldNames():
                breach(there, f"{key!r} is required")
        if schema.get("additionalProperties") is False and (extra := [k for k in kind.fieldNames() if k not in known]):
            breach(there, f"{extra[0]!r} is not allowed")
        for f in kind.fields:
            if f.name in known:
                inner = typed_breaches(known[f.name], value[f.name], f.dataType, F.concat(path, F.lit("/" + f.name.replace("~", "~0").replace("/", "~1"))))
                out += [(there & condition, *told) for condition, *told in inner]
    if isinstance(kind, T.ArrayType):
        if schema.get("minItems", 0) > 0:
            breach(there & (F.size(value) < schema["minItems"]), f"fewer than {schema['minItems']} items")
        if "maxItems" in schema:
            breach(there & (F.size(value) > schema["maxItems"]), f"more than {schema['maxItems']} items")
        first = schema.get("prefixItems", [])
        for k, item in enumerate(first):
            inner = typed_breaches(item, F.get(value, F.lit(k)), kind.elementType, F.concat(path, F.lit(f"/{k}")))
            out += [(there & (F.size(value) > k) & condition, *told) for condition, *told in inner]
        if isinstance(item := schema.get("items"), dict) and typed_breaches(item, F.lit(None).cast(kind.elementType), kind.elementType):
            rest = F.slice(value, len(first) + 1, 1 << 30) if first else value
            of = lambda x, i: typed_breaches(item, x, kind.elementType, F.concat(path, F.lit("/"), (i + len(first)).cast("string")))
            told = F.get(F.array_compact(F.transform(rest, lambda x, i: first_breach(of(x, i)))), F.lit(0))
            out.append((F.coalesce(F.exists(rest, lambda x: breached(of(x, F.lit(0)))), F.lit(False)), told["path"], told["message"]))
    return out


def breached(found: Breaches) -> Column:
    out = F.lit(False)
    for condition, *_ in found:
        out = out | condition
    return F.coalesce(out, F.lit(False))


def first_breach(found: Breaches) -> Column:
    """struct(path, message) of the first breach, null without one."""
    return F.coalesce(*(F.when(condition, F.struct(path.alias("path"), said.alias("message"))) for condition, path, said in found))


def first_path(found: Breaches) -> Column:
    return F.coalesce(*(F.when(condition, path) for condition, path, _ in found))


def json_kind(kind: T.DataType) -> str:
    """What JSON has of a column's type."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "number"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, T.StructType):
        return "object"
    if isinstance(kind, T.NullType):
        return "null"
    raise Unsupported(f"columns of type {kind.simpleString()}")


def json_text(value: Column, kind: T.DataType) -> Column:
    """A typed column as JSON text; null for null."""
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return value.cast("string")
    whole = F.to_json(F.array(value))
    if isinstance(kind, (T.StringType, T.NumericType)):  # neither begins or ends with a bracket as JSON
        return F.when(value.isNotNull(), F.btrim(whole, F.lit("[]")))
    return F.when(value.isNotNull(), F.substring(whole, 2, 1 << 30).substr(F.lit(1), F.length(whole) - 2))
