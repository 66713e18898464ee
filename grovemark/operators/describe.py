"""Plain-language descriptions of alignments: a text for each node, joined in the order of the walk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.templates import choose, describe_templates, fill


def percent(c: Column) -> Column:
    return F.concat(F.bround(100 * c, 0).cast("int").cast("string"), F.lit("%"))


def description_entries(nodes: DataFrame, templates: Mapping[str, str] | None = None, show_confidence: bool = False, include_ambiguous: bool = False, ambiguity_threshold: float = 0.5) -> DataFrame:
    """pair_id, node_id, path, depth, match_kind, outcome, score, text, confidence for nodes of valid pairs that have a text."""
    texts = describe_templates(templates)
    rows = nodes.where("valid AND (has_gold OR has_pred)").where("NOT (part = 'value' AND kind = 'unmatched' AND parent_kind = 'object')")
    plain = lambda c: F.when(F.col(c).startswith('"'), F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "string"), F.col(c))).otherwise(F.col(c))
    right = F.col("score") >= 1
    indent = F.repeat(F.lit("  "), F.col("depth"))
    values = {
        "indent": indent, "gold": F.when(F.col("part") == "key", F.col("gold_key")).otherwise(plain("gold")), "pred": F.when(F.col("part") == "key", F.col("pred_key")).otherwise(plain("pred")), "value": plain("target"), "score": F.col("score"), "score_pct": percent(F.col("score")),
        "confidence": F.col("confidence"), "confidence_pct": percent(F.col("confidence")), "n_gold": F.col("n_gold"), "n_pred": F.col("n_pred"), "path": F.col("path"),
    }
    group = F.when(F.col("part") == "key", "dict.key").when(F.col("node_type") != "item", F.col("node_type")).when(F.col("kind").isin("ref", "id", "null"), F.col("kind")).otherwise("item")
    outcome = (
        F.when((F.col("kind") == "unmatched") & (F.col("parent_kind") != "object"), F.when(F.col("has_gold"), "missing").otherwise("excess"))
        .when(right, "match")
        .when((F.col("kind") == "ref") & ~F.col("has_target"), "no_target")
        .otherwise("mismatch")
    )
    rows = rows.withColumn("match_kind", F.when(outcome.isin("missing", "excess"), "list").otherwise(group)).withColumn("outcome", outcome)
    cases = []
    for key, template in texts.items():
        kind, _, end = key.removeprefix("describe.").rpartition(".")
        if template and kind in ("item", "ref", "id", "null", "list", "dict", "dict.key") and end in ("match", "mismatch", "missing", "excess", "no_target"):
            cases.append(((F.col("match_kind") == kind) & (F.col("outcome") == end), fill(template, values)))
    text = choose(cases)
    text = F.when((F.col("part") == "value") & (F.col("parent_kind") == "object") & (text != ""), F.concat(fill(texts["describe.dict.value.prefix"], values), F.ltrim(text))).otherwise(text)
    if show_confidence:
        mark = F.when(F.col("confidence") >= 0.7, "").when(F.col("confidence") >= 0.4, F.format_string(" (confidence %.2f)", "confidence")).otherwise(F.format_string(" (low confidence %.2f)", "confidence"))
        text = F.when(text != "", F.concat(F.rtrim(text, F.lit("\n")), mark, F.lit("\n"))).otherwise(text)
    if include_ambiguous:
        for kind in ("list", "dict"):
            doubt = (F.col("node_type") == kind) & (F.col("part") == "value") & (F.col("confidence") < ambiguity_threshold)
            text = F.when(doubt, F.concat(fill(texts[f"describe.{kind}.ambiguous"], values), text)).otherwise(text)
    # A filter over the text would be pushed below, with all that the text is made of spelt out for each use; a generator isn't.
    heard = F.explode(F.filter(F.array(text), lambda t: t != ""))
    return rows.select("pair_id", "node_id", "path", "depth", "match_kind", "outcome", "score", heard.alias("text"), "confidence")


def description_json(nodes: DataFrame, templates: Mapping[str, str] | None = None, **options) -> DataFrame:
    """pair_id, result: score and entries of each pair as one JSON text, in the order of the walk; a perfect or invalid pair has no entries."""
    texts = description_entries(nodes, templates, **options)
    listed = texts.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "path", "depth", "match_kind", "outcome", "score", "text", "confidence"))).alias("entries"))
    roots = nodes.where("parent_id IS NULL").select("pair_id", "valid", F.col("total").alias("score"), "error_path", "error").join(listed, "pair_id", "left")
    told = F.when(F.col("valid") & (F.col("score") < 1), F.col("entries"))
    return roots.select("pair_id", F.to_json(F.struct("score", F.lit("json").alias("style"), F.coalesce(told, F.array()).alias("entries"), "error_path", "error")).alias("result"))


def description_text(nodes: DataFrame, templates: Mapping[str, str] | None = None, **options) -> DataFrame:
    """pair_id, score, text for every pair; a perfect pair has one sentence."""
    texts = describe_templates(templates)
    body = description_entries(nodes, templates, **options).groupBy("pair_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "").alias("body"))
    roots = nodes.where("parent_id IS NULL").select("pair_id", "valid", F.col("total").alias("score"), "error_path", "error").join(body, "pair_id", "left")
    values = {"score": F.col("score"), "score_pct": percent(F.col("score")), "path": F.col("error_path"), "message": F.col("error")}
    text = F.when(~F.col("valid"), fill(texts["describe.validation_error"], values)).when(F.col("score") >= 1, F.lit(texts["describe.intro.perfect"])).otherwise(F.concat(fill(texts["describe.intro.imperfect"], values), F.coalesce("body", F.lit(""))))
    return roots.select("pair_id", "score", text.alias("text"))
