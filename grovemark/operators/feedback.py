"""Feedback for a prompt optimiser: the top repairs of each pair as text, by expressions and windows over repairs."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.templates import choose, feedback_templates, fill
from .nodes import spelling

STYLES = ("full", "gepa", "compact", "json")
#: The kinds of errors that kinds of repairs are told as.
HUMAN = {
    "primitive_replace": "primitive-value",
    "primitive_replace_reorder": "list-item-value",
    "key_add": "missing-key",
    "key_remove": "extraneous-key",
    "key_rename_add": "key-rename",
    "key_rename_remove": "key-rename",
    "list_item_add": "missing-list-item",
    "list_item_remove": "extraneous-list-item",
    "list_item_missing": "missing-list-item",
    "list_item_excess": "extraneous-list-item",
    "ref_fix": "reference",
    "ref_fix_no_target": "unresolved-reference",
    "subtree_replace": "subtree",
    "null_value_replace": "null-value",
}


def human(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in HUMAN.items() for x in (k, v))), kind)


def _values(rank: Column) -> dict[str, Column]:
    c = F.col
    return {
        "rank": rank, "path": c("path"), "list_path": c("list_path"), "gold": c("_gold"), "pred": c("_pred"), "value": c("_value"), "key": c("key"), "gold_key": c("key"), "pred_key": c("pred_key"),
        "gold_path": c("gold_path"), "pred_path": c("pred_path"), "score_delta": c("score_delta"), "score_delta_pct": 100 * c("score_delta"), "confidence": c("confidence"), "confidence_pct": 100 * c("confidence"), "score": c("total"), "score_pct": 100 * c("total"),
    }


def _spelt(ops: DataFrame, formatter: Callable[[Any], str] | None) -> DataFrame:
    """Adds the texts' spellings of values: of the repairs that are told alone, in Arrow batches."""
    told = spelling(formatter)
    return ops.withColumns({"_gold": told(F.col("gold")), "_pred": told(F.col("pred")), "_value": told(F.coalesce("value", "gold"))})


def feedback_entries(ops: DataFrame, top_k: int | None = 5, min_score_delta: float = 0.0, style: str = "full", templates: Mapping[str, str] | None = None, references: DataFrame | None = None, value_formatter: Callable[[Any], str] | None = None) -> DataFrame:
    """pair_id, rank, seq, op_kind, op, path, score_delta, score_delta_pct, gold, pred, text, rename_group, confidence, n_total, truncated.

    top_k: repairs kept (None: all; both halves of a rename count); min_score_delta: a rename stays or goes whole. Silent texts take
    no rank; the silent half of a rename has its partner's. references: pair_id, path, text of what a reference should point to.
    value_formatter: spells values in texts; the default is Python's spelling, cut to 80 characters.
    """
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}, not {style!r}")
    if top_k is not None and top_k < 0:
        raise ValueError("top_k must not be negative")
    texts = feedback_templates(style, templates)
    pair = Window.partitionBy("pair_id")
    rows = ops.where("kind <> 'pairing_ambiguous'").withColumn("n_total", F.count(F.lit(1)).over(pair))
    bound = F.when(F.col("rename_group").isNotNull(), F.max("score_delta").over(Window.partitionBy("pair_id", "rename_group"))).otherwise(F.col("score_delta"))
    rows = rows.withColumn("_b", bound).where(F.col("_b") >= min_score_delta).withColumn("seq", F.row_number().over(pair.orderBy("rank")))
    if top_k is not None:
        rows = rows.where(F.col("seq") <= top_k)
    silent = [k for k in HUMAN if not texts[f"feedback.op.{k}"].strip()] if style != "json" else ["key_rename_remove"]
    heard = F.when(F.col("kind").isin(silent), 0).otherwise(1) if silent else F.lit(1)
    rows = rows.withColumn("_heard", heard).withColumn("_r", F.sum("_heard").over(pair.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("pair_id", F.coalesce("rename_group", F.col("seq").cast("string")))
    rows = rows.withColumn("shown_rank", F.when(F.col("_heard") == 1, F.col("_r")).otherwise(F.coalesce(F.max(F.when(F.col("_heard") == 1, F.col("_r"))).over(group), F.lit(0))))
    text = F.lit("")
    if style != "json":
        rows = _spelt(rows, value_formatter)
        values = _values(F.col("shown_rank"))
        cases = [(F.col("kind") == kind, fill(texts[f"feedback.op.{kind}"], values)) for kind in HUMAN if texts[f"feedback.op.{kind}"].strip()]
        if references is not None:
            rows = rows.join(references.select(F.col("pair_id").alias("_pair"), F.col("path").alias("_path"), "scope", "target", "used", "relation"), (F.col("pair_id") == F.col("_pair")) & (F.col("path") == F.col("_path")), "left")
            told = values | {k: F.col(k) for k in ("scope", "target", "used", "relation")}
            cases = [((F.col("kind") == kind) & F.col("target").isNotNull(), fill(texts[f"feedback.op.{kind}.semantic"], told)) for kind in ("ref_fix", "ref_fix_no_target")] + cases
        text = choose(cases)
    kept = F.count(F.lit(1)).over(pair)
    return rows.select(
        "pair_id", F.col("shown_rank").cast("int").alias("rank"), "seq", F.col("kind").alias("op_kind"), "op", "path", "score_delta", (100 * F.col("score_delta")).alias("score_delta_pct"), "gold", "pred", text.alias("text"), "rename_group", "confidence", "n_total", (kept < F.col("n_total")).alias("truncated"), "total",
    )


def feedback_text(nodes: DataFrame, ops: DataFrame, top_k: int | None = 5, min_score_delta: float = 0.0, style: str = "full", templates: Mapping[str, str] | None = None, synthesis: bool = True, dominant: float = 0.6, diagnostics: bool = True, references: DataFrame | None = None, value_formatter: Callable[[Any], str] | None = None, metadata: bool = False, plain: bool = False) -> DataFrame:
    """pair_id, score, text, n_total_ops, truncated for every pair; an invalid pair's text says where it breaks the schema.

    metadata: also error_breakdown, a map from kinds of repairs to what all of a kind would recover, told or not.
    plain: ``ops`` are ``repairs`` without diagnostics, thus none is below 0: they are found once, not again for diagnostics and
    for their number, which the entries know wherever each pair with repairs has one.
    """
    texts = feedback_templates(style, templates)
    counted = plain and not metadata and min_score_delta <= 0 and (top_k is None or top_k > 0)
    diagnostics = diagnostics and not plain
    entries = feedback_entries(ops, top_k, min_score_delta, style, templates, references, value_formatter)
    told = entries.select("pair_id", F.lit(0).alias("note"), "seq", "text", human(F.col("op_kind")).alias("human"), "score_delta", "n_total", "truncated")
    if diagnostics:
        notes = _spelt(ops.where("kind = 'pairing_ambiguous'"), value_formatter).select("pair_id", F.lit(1).alias("note"), F.col("rank").alias("seq"), fill(texts["feedback.op.pairing_ambiguous"], _values(F.lit(0))).alias("text"), F.lit(None).cast("string").alias("human"), F.lit(0.0).alias("score_delta"), F.lit(None).cast("long").alias("n_total"), F.lit(None).cast("boolean").alias("truncated"))
        told = told.union(notes)
    # A pair has few entries: its texts, its kinds' sums and its notes come from one sorted list.
    listed = told.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("note", "seq", "text", "human", "score_delta"))).alias("all"), F.max("n_total").alias("n_kept"), F.max("truncated").alias("truncated"))
    own = listed.withColumn("own", F.filter("all", lambda x: x["note"] == 0)).withColumn("doubts", F.array_join(F.transform(F.filter("all", lambda x: x["note"] == 1), lambda x: x["text"]), "\n"))
    own = own.withColumn("heard", F.filter("own", lambda x: x["text"] != ""))
    own = own.withColumn("lines", F.array_join(F.transform("heard", lambda x: x["text"]), "\n")).withColumn("n_shown", F.size("heard"))
    names = F.array_distinct(F.transform("own", lambda x: x["human"]))
    summed = F.transform(names, lambda h, k: F.struct((-F.aggregate(F.filter("own", lambda x: x["human"] == h), F.lit(0.0), lambda s, x: s + x["score_delta"])).alias("less"), k.alias("k"), h.alias("human")))
    own = own.withColumn("sums", F.slice(F.sort_array(summed), 1, 3)).withColumn("whole", F.aggregate("own", F.lit(0.0), lambda s, x: s + x["score_delta"]))
    own = own.select("pair_id", "doubts", "lines", "n_shown", "truncated", "n_kept", F.get("sums", F.lit(0))["human"].alias("dominant"), F.try_divide(-F.get("sums", F.lit(0))["less"], F.col("whole")).alias("fraction"), F.array_join(F.transform("sums", lambda x: x["human"]), ", ").alias("kinds"))
    roots = nodes.where("parent_id IS NULL").select("pair_id", "valid", F.col("total").alias("score"), "error_path", "error")
    out = roots.join(own, "pair_id", "left")
    if counted:
        out = out.withColumn("n_total_ops", F.col("n_kept"))
    else:
        sums = ops.where("kind <> 'pairing_ambiguous'").groupBy("pair_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("score_delta").alias("delta"))
        totals = sums.groupBy("pair_id").agg(F.sum("n").alias("n_total_ops"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "delta")))).alias("error_breakdown"))
        out = out.join(totals, "pair_id", "left")
    score, deficit = F.col("score"), 1 - F.col("score")
    n_total, n_shown = F.coalesce("n_total_ops", F.lit(0)), F.coalesce("n_shown", F.lit(0))
    values = {"score": score, "score_pct": 100 * score, "deficit": deficit, "deficit_pct": 100 * deficit, "n_shown": n_shown, "n_total": n_total, "dominant_kind": F.col("dominant"), "dominant_kind_human": F.col("dominant"), "dominant_fraction": F.col("fraction"), "dominant_fraction_pct": 100 * F.col("fraction"), "top_kinds": F.col("kinds"), "path": F.col("error_path"), "message": F.col("error")}
    focus = F.when(F.col("fraction") >= dominant, fill(texts["feedback.synthesis.single_dominant"], values)).otherwise(fill(texts["feedback.synthesis.mixed"], values)) if synthesis else F.lit("")
    body = F.concat(fill(texts["feedback.intro.imperfect"], values), F.col("lines"), F.when(F.col("fraction").isNotNull(), focus).otherwise(F.lit("")))
    notes = F.when(F.col("doubts") != "", F.concat(F.lit(texts["feedback.diagnostics.intro"] + "\n"), F.col("doubts"))).otherwise(F.lit("")) if diagnostics else F.lit("")
    text = (
        F.when(~F.col("valid"), fill(texts["feedback.validation_error"], values))
        .when((score >= 1) & (n_total == 0), F.concat(fill(texts["feedback.intro.perfect"], values), notes))
        .when(n_shown == 0, F.concat(fill(texts["feedback.empty"], values), notes))
        .otherwise(F.concat(body, notes))
    )
    more = [F.coalesce("error_breakdown", F.create_map().cast("map<string,double>")).alias("error_breakdown")] if metadata else []
    return out.select("pair_id", "score", (F.lit("") if style == "json" else text).alias("text"), n_total.cast("int").alias("n_total_ops"), (F.coalesce("truncated", F.lit(False)) | ((n_total > 0) & F.col("n_kept").isNull())).alias("truncated"), *more)


def feedback_json(nodes: DataFrame, ops: DataFrame, top_k: int | None = 5, min_score_delta: float = 0.0, style: str = "full", **options) -> DataFrame:
    """pair_id, result: all that is said of a pair as one JSON text: score, text, entries in their order, style, truncated, n_total_ops, error_breakdown."""
    told = {k: options[k] for k in ("templates", "references", "value_formatter") if k in options}
    entries = feedback_entries(ops, top_k, min_score_delta, style, **told)
    listed = entries.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("seq", "rank", "op_kind", "op", "path", "score_delta", "score_delta_pct", "gold", "pred", "text", "rename_group", "confidence"))).alias("entries"))
    out = feedback_text(nodes, ops, top_k, min_score_delta, style, metadata=True, **options).join(listed, "pair_id", "left")
    return out.select("pair_id", F.to_json(F.struct("score", "text", F.coalesce("entries", F.array()).alias("entries"), F.lit(style).alias("style"), "truncated", "n_total_ops", "error_breakdown")).alias("result"))
