"""What wrong references should have pointed to, in words: the properties of records instead of their identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import exploded, spread
from ..plans.text import part, tag
from ..sources.templates import feedback_templates, fill
from .kernel import Comparison, Match, _records, _schema_at, escaped
from .nodes import breach_of, kernel_input, parsed, spelling
from .reference_graph import definers

_TOLD = "pair_id string, path string, scope string, target string, used string, relation string, certain boolean"
COLUMNS = ["pair_id", "path", "scope", "target", "used", "relation", "certain"]


def _told(plan: Comparison, scope: str, record: Any) -> dict[str, Any]:
    """A record's own scalar properties, without identifiers and references."""
    if not isinstance(record, dict):
        return {}
    hidden = {p.steps[-1] for p in (*plan.ids.values(), *plan.refs) if p.steps and p.steps[-1] != "*"}
    return {k: v for k, v in record.items() if k not in hidden and isinstance(v, (str, int, float, bool))}


def _wrong(match: Match, path: str = "", carrier: Any = None) -> Iterator[tuple[str, Match, Any]]:
    """(path, reference, the object around it) of every wrong reference."""
    if match.kind == "ref" and match.score < 1:
        yield path or "/", match, carrier
    for child in match.children:
        yield from _wrong(child, f"{path}/{child.step}", match.gold if match.node_type == "dict" else carrier)


def describe_references(plan: Comparison, gold: Any, pred: Any, texts: Mapping[str, str], known: dict | None = None) -> Iterator[dict]:
    """One row for each wrong reference whose gold record has a property to tell it by."""
    match, _ = plan.compare(gold, pred, known)
    said = lambda props: ", ".join(texts["feedback.refsem.prop"].format(key=k, value=repr(v)) for k, v in props.items())
    for path, ref, carrier in _wrong(match):
        mine = [(i, _told(plan, ref.scope, r)) for i, r in _records(gold, plan.ids[ref.scope])]
        theirs = [(i, _told(plan, ref.scope, r)) for i, r in _records(pred, plan.ids[ref.scope])]
        props = next((p for i, p in mine if i == ref.gold), {})
        if not props:
            continue
        certain = sum(p == props for _, p in mine) == 1
        used = next((p for i, p in theirs if i == ref.pred), None)
        label = next((v for v in _told(plan, ref.scope, carrier).values() if isinstance(v, str)), None)
        yield {
            "path": path, "scope": ref.scope, "certain": certain,
            "target": texts["feedback.refsem.target" if certain else "feedback.refsem.target_ambiguous"].format(scope=ref.scope, gold_props=said(props)),
            "used": texts["feedback.refsem.used_dangling"] if used is None else texts["feedback.refsem.used"].format(scope=ref.scope, pred_props=said(used)) if used else "",
            "relation": texts["feedback.refsem.relation"].format(relation_label=repr(label)) if label else "",
        }


def reference_descriptors(pairs: DataFrame, plan: Comparison, raw_schema: dict, templates: Mapping[str, str] | None = None, skip_validation: bool = False) -> DataFrame:
    """pair_id, path, scope, target, used, relation, certain for feedback's ``references``; pairs as for the node table.

    Preds that break the schema have no rows.
    """
    texts = feedback_templates("full", templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pair_id, gold, pred, known in parsed(batch):
                if not breach_of(raw_schema, skip_validation, pair_id, gold, pred):
                    rows += [{"pair_id": pair_id, **r} for r in describe_references(plan, gold, pred, texts, known)]
            kinds = [*[pa.string()] * 6, pa.bool_()]
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in zip(COLUMNS, kinds, strict=True)], COLUMNS)

    return kernel_input(pairs).mapInArrow(run, _TOLD)


def descriptors_of_nodes(nodes: DataFrame, pairs: DataFrame, plan: Comparison, templates: Mapping[str, str] | None = None) -> DataFrame:
    """What ``reference_descriptors`` tells, by joins: the wrong references of a node table with both texts' records, nothing is aligned again.

    pairs are JSON texts. Properties stand in the schema's order, others are left out. A record is told with certainty if no other of its text
    says the same, counted by a window over the scope's records.
    """
    refs = list({p.steps: p for p in plan.refs}.values())
    if not refs:
        return nodes.sparkSession.createDataFrame([], _TOLD)
    texts = feedback_templates("full", templates)
    hidden = {p.steps[-1] for p in (*plan.ids.values(), *plan.refs) if p.steps and p.steps[-1] != "*"}
    spelt = spelling()

    # All references are told in one pass of the node table, which may have to align the pairs.
    marks: list[list[str]] = []
    for ref in refs:
        carrier = _schema_at(plan.schema, ref.steps[:-1]) if ref.steps[-1] != "*" else None
        marks.append([k for k in (carrier.properties if carrier else ()) if k not in hidden])
    is_ref = (F.col("kind") == "ref") & (F.col("score") < 1)
    if any(marks):
        is_carrier = F.col("node_type") == "dict"
        held = F.max(F.when(is_carrier, F.col("gold"))).over(Window.partitionBy("pair_id", "_holder"))
        rows = spread(nodes.where("valid").where(is_ref | is_carrier).withColumn("_holder", F.when(is_carrier, F.col("node_id")).otherwise(F.col("parent_id"))), "pair_id")
        wrong = rows.withColumn("carrier", held).where(is_ref).select("pair_id", "path", "gold", "pred", "carrier")
    else:
        wrong = nodes.where("valid").where(is_ref).select("pair_id", "path", "gold", "pred", F.lit(None).cast("string").alias("carrier"))
    shapes = ["^/" + "/".join("[0-9]+" if s == "*" or isinstance(s, int) else re.escape(escaped(s)) for s in r.steps) + "$" for r in refs]
    own = exploded(wrong, F.array_compact(F.array(*(F.when(F.col("path").rlike(shape), F.lit(k)) for k, shape in enumerate(shapes)))), "_ref")
    label = F.lit(None).cast("string")
    for k, keys in enumerate(marks):
        values = [F.when(tag(part(F.col("_held"), key)) == "string", spelt(F.to_json(part(F.col("_held"), key)))) for key in keys]
        label = F.when(F.col("_ref") == k, F.coalesce(*values)).otherwise(label) if values else label
    own = own.withColumns({"scope": F.get(F.lit([r.scope for r in refs]), F.col("_ref")), "_held": F.try_parse_json("carrier")}).withColumn("relation_label", label).drop("_held", "carrier")

    def said(record: Column, about: Mapping) -> Column:
        told = []
        for key in (k for k in about if k not in hidden):
            value = part(record, key)
            plain = tag(value).isin("string", "integer", "number", "boolean")
            told.append(F.when(plain, fill(texts["feedback.refsem.prop"], {"key": F.lit(key), "value": spelt(F.to_json(value))})))
        return F.array_join(F.array_compact(F.array(*told, F.lit(None).cast("string"))), ", ")

    mine: DataFrame | None = None
    theirs: DataFrame | None = None
    for scope in dict.fromkeys(r.scope for r in refs):
        about, of = _schema_at(plan.schema, plan.ids[scope].record).properties, F.lit(scope).alias("scope")
        golds = definers(pairs, plan, scope, "gold").select("pair_id", of, F.col("id").alias("gold"), said(F.col("record"), about).alias("gold_props")).where("gold_props <> ''")
        preds = definers(pairs, plan, scope, "pred").groupBy("pair_id", F.col("id").alias("pred")).agg(F.first("record").alias("record"))
        preds = preds.select("pair_id", of, "pred", said(F.col("record"), about).alias("pred_props"))
        mine, theirs = (golds, preds) if mine is None else (mine.unionByName(golds), theirs.unionByName(preds))
    mine = mine.withColumn("twins", F.count(F.lit(1)).over(Window.partitionBy("pair_id", "scope", "gold_props")))
    rows = own.join(mine, ["pair_id", "scope", "gold"]).join(theirs, ["pair_id", "scope", "pred"], "left")
    named = {c: F.col(c) for c in ("scope", "gold_props", "pred_props", "relation_label")}
    return rows.select(
        "pair_id", "path", "scope", F.when(F.col("twins") == 1, fill(texts["feedback.refsem.target"], named)).otherwise(fill(texts["feedback.refsem.target_ambiguous"], named)).alias("target"),
        F.when(F.col("pred_props").isNull(), F.lit(texts["feedback.refsem.used_dangling"])).when(F.col("pred_props") == "", F.lit("")).otherwise(fill(texts["feedback.refsem.used"], named)).alias("used"),
        F.when(F.col("relation_label").isNull(), F.lit("")).otherwise(fill(texts["feedback.refsem.relation"], named)).alias("relation"), (F.col("twins") == 1).alias("certain"),
    )


__all__ = ["describe_references", "descriptors_of_nodes", "reference_descriptors"]
