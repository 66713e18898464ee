"""The entry point: one schema, tables of pairs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.errors import PySparkTypeError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import leaf
from ..operators import attribution, batch, describe, feedback, reference_text, repair, validate
from ..operators.kernel import Comparison, Options, values_at
from ..operators.nodes import ROWS, breach_of, kernel_input, kernel_scores, node_table, parsed, values, with_json
from ..operators.semantic import CosineMetric, likeness_key
from ..operators.validate import Breaches, typed_breaches
from ..sources.stored import stored
from .columns import Around, Unsupported, score_column
from .schema import compile_schema
from .text import text_scores
from .tree import losses, typed_nodes, validity


def _kinds(pairs: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in pairs.schema.fields}


class Aligner:
    """Compares the gold and pred columns of tables (pair_id, gold, pred), structs or JSON text, under an annotated schema.

    Where the schema and the columns' types allow it, scores and the node table are expressions; scores of lists are found for whole
    Arrow batches; otherwise pairs go through the kernel one by one. All validate alike. Persist ``nodes`` to ask several things of one alignment.
    """

    def __init__(self, schema: dict, *, custom_metrics: Mapping[str, Mapping[str, Callable]] | None = None, templates: Mapping[str, str] | None = None, description_templates: Mapping[str, str] | None = None, skip_validation: bool = False, **options):
        self.raw, self.node = schema, compile_schema(schema)
        self.options = Options(**options)
        self.plan = Comparison(self.node, self.options, {k: dict(v) for k, v in (custom_metrics or {}).items()})
        self.custom, self.templates, self.description_templates, self.skip_validation = custom_metrics, templates, description_templates, skip_validation
        feedback.feedback_templates("full", templates)
        describe.describe_templates(description_templates)

    def score(self, pairs: DataFrame, dealt: bool = False) -> DataFrame:
        """pair_id, score. A pred that breaks the schema scores 0, a gold that does raises, unless validation is skipped.

        Pairs for the kernel are shared out among all cores first, but for those that are ``dealt`` already, as ``apply`` leaves them.
        """
        kinds = _kinds(pairs)
        if kinds["gold"].typeName() != "string":
            try:
                gold, pred = F.col("gold"), F.col("pred")
                around = Around(None, (gold, pred), (kinds["gold"], kinds["pred"]))
                score = score_column(self.node, gold, pred, kinds["gold"], kinds["pred"], self.custom, around)
                bad_gold, bad_pred = self._errors(pairs)
                if bad_gold or bad_pred:
                    score = F.when(validity(F.col("pair_id"), bad_gold, bad_pred), score).otherwise(F.lit(0.0))
                return pairs.select(F.col("pair_id").cast("string").alias("pair_id"), score.alias("score"))
            except Unsupported:
                pass
            try:
                return self._by_batches(pairs, kinds)
            except Unsupported:
                pass
        elif kinds["pred"].typeName() == "string" and not self.skip_validation:
            try:
                return self._by_variants(pairs)
            except Unsupported:
                pass
        return kernel_scores(self._with_likenesses(pairs), self.plan, self.raw, self.skip_validation, dealt)

    def _by_variants(self, pairs: DataFrame) -> DataFrame:
        """pair_id, score of JSON texts by expressions; only pairs whose objects have unequal keys to be matched by likeness go to the kernel."""
        pairs = pairs.select("pair_id", "gold", "pred")
        scored, odd = text_scores(pairs, self.node, self.raw, self.custom)
        own = lambda df: df.select(F.col("pair_id").cast("string").alias("pair_id"), F.col("_score").alias("score"))
        if odd is None:
            return own(scored)
        return own(scored.where(~odd)).unionByName(kernel_scores(scored.where(odd).select("pair_id", "gold", "pred"), self.plan, self.raw))

    def _by_batches(self, pairs: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
        """pair_id, score of typed pairs whose lists are paired by likeness or in order: columns in, columns out."""
        try:
            types = [to_arrow_type(kinds[c]) for c in ("gold", "pred")]
        except PySparkTypeError as e:
            raise Unsupported(str(e)) from e
        batch.BatchScorer(self.plan).check(self.node, *types)
        ok = validity(F.col("pair_id"), *self._errors(pairs))
        return pairs.select(F.col("pair_id").cast("string").alias("pair_id"), ok.alias("_ok"), "gold", "pred").mapInArrow(batch.scores(self.plan), "pair_id string, score double")

    def nodes(self, pairs: DataFrame) -> DataFrame:
        """The node table: by expressions where types fix its shape, else by the kernel. Metrics by embedding get their likenesses first."""
        kinds = _kinds(pairs)
        if kinds["gold"].typeName() != "string":
            try:
                return typed_nodes(pairs, self.node, kinds, self.options, self.custom, self._errors)
            except Unsupported:
                pass
        return node_table(self._with_likenesses(pairs), self.plan, self.raw, self.skip_validation)

    def _errors(self, pairs: DataFrame) -> tuple[Breaches, Breaches]:
        """How typed gold and pred can break the schema; nothing where validation is skipped."""
        if self.skip_validation:
            return [], []
        kinds = _kinds(pairs)
        return typed_breaches(self.raw, F.col("gold"), kinds["gold"]), typed_breaches(self.raw, F.col("pred"), kinds["pred"])

    def quarantine(self, pairs: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame, Observation]:
        """(pairs that keep the schema, those that break it with side, error_path and error, counts n, n_gold and n_pred).

        In place of failing a job at its first bad gold: a row is rejected for its gold before its pred. With ``path`` the pairs are read
        and checked once and written there as one table with a part for each outcome, which both results read; the counts
        are there when that is done. Without it both are filters, and the counts come with the first that is run to its end.
        """
        seen = Observation()
        checked = validate.checked(pairs, self.raw).observe(
            seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == "gold").alias("n_gold"), F.count_if(F.col("side") == "pred").alias("n_pred")
        )
        if path is not None:
            checked.withColumn("rejected", F.col("side").isNotNull()).write.partitionBy("rejected").parquet(path)
            checked = pairs.sparkSession.read.schema(checked.schema.add("rejected", T.BooleanType())).parquet(path)
            return checked.where("NOT rejected").select(*pairs.columns), checked.where("rejected").select(*pairs.columns, "side", "error_path", "error"), seen
        return checked.where("side IS NULL").select(*pairs.columns), checked.where("side IS NOT NULL"), seen

    def worst(self, pairs: DataFrame) -> DataFrame:
        """pair_id, score, worst_path, contribution: the leaf of each valid pair that costs most, the first by path among equals to 9 places.

        Where types fix the shape it is found in one projection; contributions are compared by struct order, not by rows.
        """
        kinds = _kinds(pairs)
        if kinds["gold"].typeName() != "string":
            try:
                df, rows = losses(pairs, self.node, kinds, self.options, self.custom)
                bad_gold, bad_pred = self._errors(pairs)
            except Unsupported:
                pass
            else:
                valid = validity(F.col("pair_id"), bad_gold, bad_pred)
                found = []
                for r in rows:
                    lost = F.lit(r.values["weight"]) * (1 - (F.lit(r.values["score"]) if isinstance(r.values["score"], float) else r.values["score"]))
                    leaf = F.lit(r.values["is_leaf"]) if isinstance(r.values["is_leaf"], bool) else r.values["is_leaf"]
                    if r.values["weight"] > 0:
                        found.append(F.when(leaf if r.there is None else leaf & r.there, F.struct((-F.round(lost, 9)).alias("less"), F.lit(r.values["path"]).alias("path"), lost.alias("lost"))))
                low = F.array_min(F.array_compact(F.array(*found)))
                df = df.where(valid).withColumn("_low", low)
                return df.select(F.col("pair_id").cast("string").alias("pair_id"), rows[0].values["score"].alias("score"), F.col("_low.path").alias("worst_path"), F.col("_low.lost").alias("contribution"))
        nodes = self.nodes(pairs).where("valid AND is_leaf AND weight > 0").withColumn("lost", F.col("weight") * (1 - F.col("score")))
        low = nodes.groupBy("pair_id").agg(F.max("total").alias("score"), F.min(F.struct((-F.round("lost", 9)).alias("less"), "path", "lost")).alias("low"))
        return low.select("pair_id", "score", F.col("low.path").alias("worst_path"), F.col("low.lost").alias("contribution"))

    def identities(self, pairs: DataFrame) -> DataFrame:
        """pair_id, scope, gold_id, pred_id (JSON texts), ambiguous: what each gold identifier stands for, null where it has no counterpart.

        ambiguous: the record can't be told from another by its likenesses, structure included. Pairs whose gold breaks its own
        references raise; preds that break the schema are passed over.
        """
        plan, raw, skip = self.plan, self.raw, self.skip_validation

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string()] * 4 + [pa.bool_()]
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["pair_id", "scope", "gold_id", "pred_id", "ambiguous"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[tuple] = []
                for pair_id, gold, pred, known in parsed(batch):
                    if not breach_of(raw, skip, pair_id, gold, pred):
                        rows += [(pair_id, s, json.dumps(i), None if j is None else json.dumps(j), twin) for s, i, j, twin in plan.identities(gold, pred, known)]
                    if len(rows) >= ROWS:
                        yield out(rows)
                        rows = []
                yield out(rows)

        return kernel_input(self._with_likenesses(pairs)).mapInArrow(run, "pair_id string, scope string, gold_id string, pred_id string, ambiguous boolean")

    # Metrics by embedding.

    def semantic_paths(self) -> list[tuple[tuple[str | int, ...], CosineMetric]]:
        """(steps from the root, metric) of every string that a metric by embedding compares; '*' is every item."""
        known = {k: m for k, m in (self.custom or {}).get("string", {}).items() if isinstance(m, CosineMetric)}
        return [(steps, known[node.score]) for steps, node in self.node.places() if "string" in node.types and node.score in known]

    def semantic_texts(self, pairs: DataFrame) -> DataFrame:
        """pair_id, model_id, text, distinct: what the metrics by embedding will compare, gathered by the schema's paths."""
        paths = [(steps, m.store.embedder.model_id) for steps, m in self.semantic_paths()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = set()
                for pair_id, *sides in zip(batch.column("pair_id").to_pylist(), values(batch, "_gold"), values(batch, "_pred"), strict=True):
                    for data in sides:
                        rows |= {(pair_id, model, text) for steps, model in paths for text, _ in values_at(data, steps, ()) if isinstance(text, str)}
                yield pa.record_batch([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 3, ["pair_id", "model_id", "text"])

        return kernel_input(pairs).mapInArrow(run, "pair_id string, model_id string, text string").distinct()

    def prewarm(self, *tables: DataFrame) -> dict[str, int]:
        """Embeds, once each, the texts of tables of pairs that the metrics by embedding will compare; {model_id: distinct texts}."""
        stores = {m.store.embedder.model_id: m.store for _, m in self.semantic_paths()}
        if not stores or not tables:
            return {}
        texts = reduce(DataFrame.union, [self.semantic_texts(t).select("model_id", "text") for t in tables]).distinct()
        report = {r.model_id: r["count"] for r in texts.groupBy("model_id").count().collect()}  # a row a model
        for model in report:
            stores[model].warm((texts.where(F.col("model_id") == model), "text"))
        return report

    def semantic_pairs(self, pairs: DataFrame) -> DataFrame:
        """pair_id, kind, a, b, distinct: the texts of gold and pred that metrics by embedding may compare with one another, by the schema's places."""
        paths = [(steps, m.kind) for steps, m in self.semantic_paths()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(rows: set) -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                return pa.record_batch([pa.array(list(c), pa.string()) for c in columns], ["pair_id", "kind", "a", "b"])

            for one in batches:
                rows: set[tuple] = set()
                for pair_id, gold, pred in zip(one.column("pair_id").to_pylist(), values(one, "_gold"), values(one, "_pred"), strict=True):
                    for steps, kind in paths:
                        mine, theirs = ({t for t, _ in values_at(data, steps, ()) if isinstance(t, str)} for data in (gold, pred))
                        for a in mine:
                            rows |= {(pair_id, kind, a, b) for b in theirs}
                            if len(rows) >= 50_000:
                                yield out(rows)
                                rows = set()
                yield out(rows)

        return kernel_input(pairs).mapInArrow(run, "pair_id string, kind string, a string, b string").distinct()

    def _with_likenesses(self, pairs: DataFrame) -> DataFrame:
        """Pairs with _likeness, a map from pairs of texts to their likeness, where the schema compares by embedding.

        Each distinct pair of texts of all documents meets its vectors and is compared once; what travels to the documents are
        numbers. A text that many pairs have is looked up for each, and adaptive execution splits it when hot.
        """
        stores = {m.store.embedder.model_id: m.store for _, m in self.semantic_paths()}
        if not stores:
            return pairs
        self.prewarm(pairs)
        held = reduce(DataFrame.unionByName, [s.vectors() for s in stores.values()])
        asked = stored(self.semantic_pairs(pairs))
        own = F.split("kind", "\x1f")
        apart = asked.select("kind", "a", "b").distinct().withColumns({"model_id": own[0], "mapping": own[1]})
        for side in ("a", "b"):
            apart = apart.join(held.select("model_id", F.col("text").alias(side), F.col("vec").alias(f"_{side}")), ["model_id", side])
        alike = F.when(F.col("mapping") == "clip", leaf.cosine(F.col("_a"), F.col("_b"))).otherwise(leaf.cosine(F.col("_a"), F.col("_b"), "affine"))
        alike = apart.select("kind", "a", "b", F.greatest(F.lit(0.0), F.least(F.lit(1.0), alike)).alias("_s"))
        entry = F.struct(likeness_key(F.col("kind"), F.col("a"), F.col("b")), "_s")
        maps = asked.join(alike, ["kind", "a", "b"]).groupBy(F.col("pair_id").alias("_pair")).agg(F.map_from_entries(F.collect_list(entry)).alias("_likeness"))
        out = pairs.join(maps, F.col("pair_id").cast("string").eqNullSafe(F.col("_pair")), "left").drop("_pair")
        return out.withColumn("_likeness", F.coalesce("_likeness", F.create_map().cast("map<string,double>")))

    def attribute(self, nodes: DataFrame, **options) -> DataFrame:
        return attribution.attribution(nodes, **options)

    def repair(self, nodes: DataFrame, **options) -> DataFrame:
        return repair.repairs(nodes, **options)

    def feedback_json(self, nodes: DataFrame, ops: DataFrame | None = None, **options) -> DataFrame:
        """pair_id, result: feedback with its entries and sums as JSON text."""
        return feedback.feedback_json(nodes, self.repair(nodes) if ops is None else ops, templates=self.templates, **options)

    def apply(self, pairs: DataFrame, ops: DataFrame, *kept: str) -> DataFrame:
        """pair_id, repaired: preds (JSON text) with their repairs; and columns of ``pairs`` to be kept beside them."""
        return repair.repaired(with_json(pairs), ops, *kept)

    def feedback(self, nodes: DataFrame, ops: DataFrame | None = None, **options) -> DataFrame:
        return feedback.feedback_text(nodes, self.repair(nodes) if ops is None else ops, templates=self.templates, plain=ops is None, **options)

    def references(self, pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
        """What wrong references should point to, for ``feedback(..., references=...)``. Given the ``nodes`` of pairs of JSON text it is found by
        joins; else pairs are aligned again."""
        if nodes is not None and pairs.schema["gold"].dataType == pairs.schema["pred"].dataType == T.StringType():
            return reference_text.descriptors_of_nodes(nodes, pairs, self.plan, self.templates)
        return reference_text.reference_descriptors(self._with_likenesses(pairs), self.plan, self.raw, self.templates, self.skip_validation)

    def describe(self, nodes: DataFrame, style: str = "default", **options) -> DataFrame:
        """pair_id, score, text; with style "json" pair_id, result: score and entries as JSON text. ``describe_entries`` has them as rows."""
        if style not in ("default", "json"):
            raise ValueError(f"style must be 'default' or 'json', not {style!r}")
        told = describe.description_json if style == "json" else describe.description_text
        return told(nodes, self.description_templates, **options)

    def describe_entries(self, nodes: DataFrame, **options) -> DataFrame:
        """A row for each node that has a text, for sinks of tables."""
        return describe.description_entries(nodes, self.description_templates, **options)

    def metric(self, gold, pred) -> float:
        """The score of one pair of parsed values, on the driver."""
        return self.plan.compare(gold, pred)[0].score


def debug_tree(nodes: DataFrame) -> DataFrame:
    """pair_id, tree: every pair's nodes as one JSON text, in the order of the walk."""
    rows = F.collect_list(F.struct("node_id", "parent_id", "path", "part", "node_type", "kind", "score", "confidence", "gold", "pred"))
    return nodes.groupBy("pair_id").agg(F.to_json(F.sort_array(rows)).alias("tree"))


def corpus_rollup(scores: DataFrame, *by: str) -> DataFrame:
    """Mean, least, and median score with counts, for each group and all groups above it."""
    return scores.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.min("score").alias("least_score"), F.percentile_approx("score", 0.5).alias("median_score"))
