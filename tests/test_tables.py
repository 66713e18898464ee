"""Queries over the node table, stores, streams, and every query's SQL on the smallest tables."""

from __future__ import annotations

import itertools
import json
import math
import random
import warnings

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from grovemark.operators import semantic
from grovemark.operators.attribution import attribution_summary
from grovemark.operators.repair import apply_operation
from grovemark.plans import catalogue
from grovemark.plans.columns import bag_score, ordered_score
from grovemark.plans.engine import Aligner, debug_tree
from grovemark.sources.templates import fill, merged
from grovemark.streaming.scoring import score_stream
from test_kernel import GRAPH, OWN_PAIRS, graph

SF = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(str(k), json.dumps(g), json.dumps(p)) for k, (g, p) in enumerate(rows)], "pair_id string, gold string, pred string")


@pytest.mark.parametrize(("schema", "gold", "pred"), OWN_PAIRS)
def test_repairs_explain_and_mend(spark, schema, gold, pred):
    aligner = Aligner(schema)
    pairs = table(spark, [(gold, pred), (gold, gold)])
    nodes = aligner.nodes(pairs).persist()
    ops = aligner.repair(nodes).collect()
    scores = {r.pair_id: r.score for r in aligner.score(pairs).collect()}
    assert scores["1"] == 1.0 and not [r for r in ops if r.pair_id == "1"]
    assert sum(r.score_delta for r in ops) == pytest.approx(1 - scores["0"])
    assert [r.rank for r in sorted(ops, key=lambda r: r["rank"])] == list(range(1, len(ops) + 1))
    fixed = aligner.apply(pairs, aligner.repair(nodes)).join(pairs.select("pair_id", "gold"), "pair_id").withColumnRenamed("repaired", "pred")
    assert {r.score for r in aligner.score(fixed).collect()} == {1.0}
    assert all(abs(r.residual) < 1e-9 for r in attribution_summary(nodes).collect())
    nodes.unpersist()


def test_feedback_and_description_texts(spark):
    schema = {"type": "object", "keyScore": "exact", "properties": {"a": {"type": "string", "score": "exact"}, "b": {"type": ["integer", "null"], "score": "exact"}}}
    aligner = Aligner(schema, compute_confidence=True)
    pairs = table(spark, [({"a": "x", "b": 1}, {"a": "y", "b": None}), ({"a": "x", "b": 1}, {"a": "x", "b": 1}), ({"a": "x", "b": 1}, {"a": 5})])
    nodes = aligner.nodes(pairs).persist()
    text = {r.pair_id: r for r in aligner.feedback(nodes).collect()}
    assert text["0"].n_total_ops == 2 and "'x'" in text["0"].text and "null" in text["0"].text and not text["0"].truncated
    assert text["1"].text.startswith("Nothing to fix") and "schema at /a" in text["2"].text
    short = {r.pair_id: r for r in aligner.feedback(nodes, top_k=1, style="compact").collect()}
    assert short["0"].truncated and short["0"].text.count("\n") >= 1
    assert {r.text for r in aligner.feedback(nodes, style="json").collect()} == {""}
    told = {r.pair_id: r.text for r in aligner.describe(nodes, show_confidence=True).collect()}
    assert told["1"] == "The prediction equals the gold." and '"y" should be "x"' in told["0"]
    assert json.loads(debug_tree(nodes).where("pair_id = '0'").first().tree)
    for bad in (dict(top_k=-1), dict(style="x")):
        with pytest.raises(ValueError):
            aligner.feedback(nodes, **bad)
    with pytest.raises(ValueError):
        Aligner(schema, templates={"feedback.op.key_add": "{nonsense}"})
    with pytest.raises(ValueError):
        aligner.repair(nodes, rank_by="x")
    nodes.unpersist()


def test_reference_repairs(spark):
    aligner = Aligner(GRAPH)
    gold = graph("abc", ["ab", "bc"], ["Ann", "Bob", "Cyd"])
    pred = graph("zyx", ["xy", "yx"], ["Cyd", "Bob", "Ann"])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ops = aligner.repair(aligner.nodes(table(spark, [(gold, pred)]))).collect()
        assert [(r.kind, r.value) for r in ops] == [("ref_fix", '"z"')]
        pairs = table(spark, [(gold, pred)])
        text = aligner.feedback(aligner.nodes(pairs), references=aligner.references(pairs)).first().text
    assert "the person with name 'Cyd'" in text and "'Ann'" in text


def test_expressions_equal_the_kernel(spark):
    schema = {"type": "array", "items": {"type": "number"}}
    rows = [([1.0, 2.0, 5.0], [2.0, 5.5]), ([], [1.0]), ([], []), ([3.0], [3.0]), ([1.0, 1.0, 2.0], [2.0, 1.0, 1.0, 9.0])]
    typed = spark.createDataFrame([(str(k), g, p) for k, (g, p) in enumerate(rows)], "pair_id string, gold array<double>, pred array<double>")
    by_column = {r.pair_id: r.score for r in Aligner(schema).score(typed).collect()}
    by_kernel = {r.pair_id: r.score for r in Aligner(schema).score(table(spark, rows)).collect()}
    assert by_column == pytest.approx(by_kernel)
    bag = {"type": "array", "order": "align", "items": {"type": "number", "score": "exact"}}
    assert {r.pair_id: r.score for r in Aligner(bag).score(typed).collect()} == pytest.approx({r.pair_id: r.score for r in Aligner(bag).score(table(spark, rows)).collect()})
    assert bag_score is not None and ordered_score is not None


def test_scores_stay_in_one_stage(spark):
    plan = Aligner(catalogue.ORDER_SCHEMA).score(catalogue.order_structs(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema" in plan


def test_embedding_store(spark, tmp_path):
    store = semantic.EmbeddingStore(spark, f"{tmp_path}/store", semantic.HashEmbedder(8))
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    assert store.warm((texts, "t")) == 2 and store.warm((texts, "t")) == 0
    assert store.contains(texts.select(F.col("t").alias("text"))).count() == 3
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "zz")], "x string, y string")
    got = {(r.x, r.y): r.score for r in semantic.similarity(pairs, store.vectors(), "x", "y").collect()}
    assert got["a", "a"] == pytest.approx(1.0) and 0 <= got["a", "b"] < 1 and got["a", "zz"] is None
    store.clear()
    assert store.vectors().count() == 0
    asked = []
    http = semantic.HttpEmbedder("m", "http://h/v1", lambda url, payload, key: asked.append(payload) or {"data": [{"index": k, "embedding": [1.0]} for k, _ in enumerate(payload["input"])]}, max_batch_size=2)
    assert len(http.embed_many(["a", "b", "c"])) == 3 and [len(p["input"]) for p in asked] == [2, 1] and http.model_id == "h::m::d=None"
    with pytest.raises(KeyError):
        semantic.DictEmbedder({"a": [1.0]}).embed_one("b")


def test_streamed_scores_equal_batch(spark, tmp_path):
    aligner = Aligner(catalogue.ORDER_SCHEMA)
    pairs = catalogue.order_structs(spark, SF)
    pairs.select("pair_id", "pred").write.parquet(f"{tmp_path}/preds")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/preds").schema).parquet(f"{tmp_path}/preds")
    q = score_stream(stream, pairs.select("pair_id", "gold"), aligner).writeStream.format("memory").queryName("streamed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("streamed").collect())) == sorted(map(tuple, aligner.score(pairs).collect()))


def test_templates(spark):
    assert merged({"a": "{x}"}, {"a": "{path} {x:.2f}"}) == {"a": "{path} {x:.2f}"}
    with pytest.raises(ValueError):
        merged({"a": ""}, {"b": ""})
    assert spark.range(1).select(fill("{{}} {x:.2f} {y}", {"x": F.lit(1.005), "y": F.lit(None)})).first()[0].startswith("{} 1.0")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_match_their_sql(spark, name):
    import duckdb

    df = contract.queries()[name](spark, SF)
    got = df.select(*sorted(df.columns)).collect()
    assert got
    if name in catalogue.ORACLES:
        c = duckdb.connect()
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        r = c.sql(catalogue.ORACLES[name])
        assert sorted(r.columns) == sorted(df.columns)
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, r.select(*sorted(r.columns)).fetchall()))


def test_optimal_pairing_takes_orders_of_any_size(spark, tmp_path):
    rng = random.Random(3)
    orders = {k: [float(rng.randint(1, 50)) for _ in range(n)] for k, n in enumerate([1, 1, 2, 3, 3, 4, 5, 6, 7])}
    spark.createDataFrame([(k, q) for k, x in orders.items() for q in x], "l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {k: max(sum(1 / (1 + abs(a - b)) for a, b in zip(x, p, strict=True)) for p in itertools.permutations([q * 2 % 7 for q in x])) / len(x) for k, x in orders.items()}
    got = {r.k: r.score for r in contract.queries()["list_align_general"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    assert contract.queries()["list_align_general"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()


def test_confidence_scores_all_cells_of_all_orders(spark):
    orders = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").collect():
        orders.setdefault(r.l_orderkey, []).append(r.l_quantity)
    assert max(map(len, orders.values())) > 3
    want = {}
    for k, x in orders.items():
        for i, a in enumerate(x, 1):
            e = [math.exp(8 / (1 + abs(a - b * 2 % 11))) for b in x]
            want[k, i] = 1.0 if len(x) < 2 else 1 + sum(v / sum(e) * math.log(v / sum(e)) for v in e) / math.log(len(x))
    assert {(r.k, r.i): r.confidence for r in contract.queries()["confidence_entropy"](spark, SF).collect()} == pytest.approx(want, abs=2e-6)
    assert contract.queries()["confidence_margin"](spark, SF).count() == sum(len(x) ** 2 for x in orders.values())


def test_core_queries_load_without_what_the_corpus_operators_need(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m.startswith("grovemark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    assert set(contract.queries()) == set(catalogue.QUERIES) and set(contract.oracle_sql()) == set(catalogue.ORACLES)


def test_values_are_spelt_by_the_caller(spark):
    aligner = Aligner({"type": "object", "keyScore": "exact", "properties": {"a": {"type": "string", "score": "exact"}}})
    pairs = table(spark, [({"a": "x"}, {"a": "y"}), ({"a": "x"}, {"a": "x"})])
    nodes = aligner.nodes(pairs).persist()
    told = {r.pair_id: r for r in aligner.feedback(nodes, value_formatter=lambda v: f"<{v}>", metadata=True).collect()}
    assert "should be <x>, is <y>" in told["0"].text and told["0"].error_breakdown == {"primitive_replace": 1.0} and told["1"].error_breakdown == {}
    sunk = {r.pair_id: json.loads(r.result) for r in aligner.feedback_json(nodes).collect()}
    assert sunk["0"]["entries"][0]["op_kind"] == "primitive_replace" and sunk["0"]["n_total_ops"] == 1 and sunk["1"]["entries"] == [] and sunk["1"]["style"] == "full"
    nodes.unpersist()


def test_pointers_must_lead_somewhere():
    for doc, op, kind, path in (([1], "remove", "list_item_remove", "/5"), ([1], "add", "list_item_add", "/3"), ({"a": 1}, "remove", "key_remove", "/b"), ({"a": 1}, "replace", "primitive_replace", "/b"), ({"a": 1}, "replace", "primitive_replace", "/a/b"), ([1], "replace", "primitive_replace", "/-"), ([1], "remove", "list_item_excess", "/")):
        with pytest.raises((IndexError, KeyError, TypeError, ValueError)):
            apply_operation(doc, op, kind, path, 7, 9)
    assert apply_operation([1], "add", "list_item_add", "/-", 2, None) == [1, 2]


def test_stores_of_a_session_and_prewarming(spark, tmp_path):
    store = semantic.SessionStore(spark, semantic.DictEmbedder({"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [1.0, 1.0]}))
    other = semantic.EmbeddingStore(spark, f"{tmp_path}/v", semantic.HashEmbedder(4, "other:model/1"))
    schema = {"type": "object", "keyScore": "exact", "properties": {"x": {"type": "array", "order": "align", "items": {"type": "string", "score": "near"}}, "y": {"type": "string", "score": "far"}, "z": {"type": "string"}}}
    aligner = Aligner(schema, custom_metrics={"string": {"near": semantic.CosineMetric(store), "far": semantic.CosineMetric(other, "affine")}})
    assert [s for s, _ in aligner.semantic_paths()] == [("x", "*"), ("y",)]
    pairs = table(spark, [({"x": ["a", "b"], "y": "q", "z": "zz"}, {"x": ["b", "c"], "y": "q", "z": "zz"})])
    assert aligner.prewarm(pairs) == {"dict-mock": 3, "other:model/1": 1} and len(store) == 3 and "a" in store and "zz" not in store
    assert aligner.score(pairs).first().score == pytest.approx((((1 + 2**-0.5) / 2) + 1 + 1) / 3)
    assert aligner.metric({"x": ["a"], "y": "q", "z": ""}, {"x": ["c"], "y": "q", "z": ""}) == pytest.approx((2**-0.5 + 2) / 3)
    assert store.get_one("c").tolist() == [1.0, 1.0]
    again = semantic.EmbeddingStore(spark, f"{tmp_path}/v", semantic.HashEmbedder(4, "kept"))
    again.warm((spark.createDataFrame([("q",)], "t string"), "t"))
    other.clear()
    assert len(other) == 0 and len(again) == 1
    store.clear()
    assert len(store) == 0
    tries = []
    flaky = semantic.HttpEmbedder("m", "http://h", lambda url, payload, key: tries.append(1) or ({"data": [{"index": 0, "embedding": [1.0]}]} if len(tries) > 1 else (_ for _ in ()).throw(TimeoutError())), max_retries=1)
    assert len(flaky.embed_many(["a"])) == 1 and len(tries) == 2


def test_hash_vectors_follow_their_recipe():
    import hashlib

    import numpy as np

    seed = int.from_bytes(hashlib.blake2b(b"hello", digest_size=8).digest(), "little")
    want = np.random.default_rng(seed).standard_normal(8).astype(np.float32)
    assert np.allclose(semantic.HashEmbedder(8).embed_one("hello"), want / np.linalg.norm(want))


def test_entry(spark):
    assert contract.entry(spark).count() > 0
