"""What only large tables show: large keys, many pairs in one split, and what a task holds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as contract
from grovemark.operators import nodes, repair
from grovemark.operators.reference_graph import refined
from grovemark.plans import catalogue_documents as documents
from grovemark.plans.engine import Aligner
from grovemark.sources.stored import stored

SMALL = "/root/testdata/sf0.001"


def large_orders(spark, folder, keys) -> str:
    """Orders with these keys in one file of one row group, as large tables' files have few."""
    rows = [(k, "FOP"[k % 3], "1-URGENT", 100.0 + k % 7, k % 11) for k in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double, o_custkey long").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_values_of_large_keys_are_written_out(spark, tmp_path):
    keys = [9, 10, 99_999, 100_000, 123_456_789_000, 123_456_789_001]
    rows = contract.queries()["repair_any_order_ops"](spark, large_orders(spark, tmp_path, keys)).collect()
    assert {r.k: r.value for r in rows} == {k: None if k % 3 == 2 else f"{k * 100 + 50}.0" for k in keys}


def parts(df) -> int:
    """How many tasks end the job of ``df``, as adaptive execution leaves them."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


TEXT = {"type": "object", "properties": {"a": {"type": "integer"}}}


def test_pairs_of_one_split_are_shared_out_to_the_kernel(spark):
    pairs = spark.range(2_000).coalesce(1).select(F.col("id").alias("pair_id"), F.concat(F.lit('{"a": '), "id", F.lit("}")).alias("gold"), F.lit('{"a": 7, "b": 1}').alias("pred"))
    cores = spark.sparkContext.defaultParallelism
    people = pairs.select("pair_id", F.lit('{"people": [{"id": 1, "name": "x"}], "links": []}').alias("gold")).withColumn("pred", F.col("gold"))
    for rows in (Aligner(TEXT).nodes(pairs), Aligner(TEXT, skip_validation=True).score(pairs), Aligner(documents.GRAPH).identities(people)):
        assert parts(rows) >= 4 * cores


def test_windows_over_repairs_keep_their_parts(spark):
    pairs = spark.range(2_000).select(F.col("id").alias("pair_id"), F.struct(F.col("id").alias("a")).alias("gold"), F.struct((F.col("id") + 1).alias("a")).alias("pred"))
    aligner = Aligner(TEXT)
    assert parts(aligner.repair(aligner.nodes(pairs))) >= 4 * spark.sparkContext.defaultParallelism


def test_repairs_are_applied_in_as_many_parts_as_they_are_found(spark):
    pairs = spark.range(2_000).coalesce(1).select(F.col("id").alias("pair_id"), F.struct(F.col("id").alias("a")).alias("gold"), F.struct((F.col("id") + 1).alias("a")).alias("pred"))
    aligner = Aligner(TEXT)
    assert parts(aligner.apply(pairs, aligner.repair(aligner.nodes(pairs)))) >= 4 * spark.sparkContext.defaultParallelism


def test_pairs_are_read_twice_and_joined_once_to_apply_repairs(spark):
    plan = contract.queries()["repair_apply"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("Relation ["), plan.count("Join "), plan.count("RepartitionByExpression")) == (2, 1, 2)


def test_what_is_right_is_not_exchanged_for_repairs(spark, monkeypatch):
    """Only the value that is wrong, or both values of a pair under a renamed key."""
    seen = []
    monkeypatch.setattr(repair, "spread", lambda df, *keys: seen.append(df.count()) or df)
    value = {"type": "object", "properties": {"ab": {"type": "integer"}, "cd": {"type": "integer"}}}
    pairs = spark.range(100).select(F.col("id").alias("pair_id"), F.struct(F.col("id").alias("ab"), F.lit(1).alias("cd")).alias("gold"), F.struct(F.floor(F.col("id") / 2).alias("ab"), F.lit(1).alias("cd")).alias("pred"))
    aligner = Aligner({"type": "object", "properties": {"in": value}})
    whole = pairs.select("pair_id", F.struct(F.col("gold").alias("in")).alias("gold"), F.struct(F.col("pred").alias("in")).alias("pred"))
    assert aligner.repair(aligner.nodes(whole)).count() == seen.pop() == 99
    renamed = whole.withColumn("pred", F.struct(F.col("pred.in").alias("inn")))
    found = aligner.repair(aligner.nodes(renamed)).where("rank = 1").select("kind", F.round("score_delta", 9)).distinct().collect()
    assert seen.pop() == 300 and len(found) > 1 and {r.kind for r in found} == {"key_rename_add"}


def test_code_of_rows_of_nodes_stays_compilable(spark):
    """HotSpot interprets methods of more than 8,000 bytes, many times slower."""
    pairs = contract.catalogue.order_structs(spark, SMALL)
    aligner = Aligner(contract.catalogue.ORDER_SCHEMA, skip_validation=True)
    debug = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.debug.package$").getField("MODULE$").get(None)
    ops = aligner.repair(aligner.nodes(pairs)).select("pair_id", "rank", "op", "kind", "at", "value", "pred")
    ops.collect()  # fixes its plan
    code = debug.codegenStringSeq(ops._jdf.queryExecution().executedPlan())
    assert code.size() and all(code.apply(k)._3().maxMethodCodeSize() < 8_000 for k in range(code.size()))


def test_cells_of_orders_keep_their_parts(spark):
    for name in ("confidence_margin", "confidence_entropy"):
        assert parts(contract.queries()[name](spark, SMALL)) >= 4 * spark.sparkContext.defaultParallelism


def test_references_are_told_in_one_pass_of_the_nodes(spark):
    rows = contract.queries()["reference_lines"](spark, SMALL)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_a_batch_is_parsed_bit_by_bit(monkeypatch):
    seen = []
    monkeypatch.setattr(nodes, "_read", lambda text: seen.append(text))
    batch = pa.record_batch([pa.array([str(k) for k in range(10_000)])], ["_gold"])
    next(iter(nodes.values(batch, "_gold")))
    assert 0 < len(seen) <= nodes.HELD


def test_feedback_finds_repairs_once(spark):
    """Pairs are read for their scores and once for their repairs, and texts are those of repairs that are given."""
    pairs = contract.catalogue.order_structs(spark, SMALL)
    aligner = Aligner(contract.catalogue.ORDER_SCHEMA, skip_validation=True)
    table = aligner.nodes(pairs)
    given, own = (aligner.feedback(table, ops, top_k=1) for ops in (aligner.repair(table), None))
    reads = [df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for df in (given, own)]
    assert reads == [4, 2]
    assert sorted(map(tuple, given.collect())) == sorted(map(tuple, own.collect()))
    for options in ({"min_score_delta": 0.1}, {"top_k": 0}, {"metadata": True}):
        told = [sorted(map(str, aligner.feedback(table, ops, **options).collect())) for ops in (aligner.repair(table), None)]
        assert told[0] == told[1]


def test_rounds_of_colours_join_once_and_by_numbers(spark):
    """Chains of six, one of them turned round, and a vertex with many others around it, next to brute force."""
    plans = []

    def store(df):
        plans.append((df._jdf.queryExecution().optimizedPlan().toString().count("Join "), {kind for _, kind in df.dtypes}))
        return stored(df)

    chains = [(g, f"v{a}", f"v{a + 1}", "r", "") for g in ("a", "b") for a in range(5)] + [("c", f"v{a + 1}", f"v{a}", "r", "") for a in range(5)]
    edges = chains + [("hub", f"v{a}", "hub:0", "r", "odd" if a == 7 else "") for a in range(50)] + [("loop", "v0", "v0", "r", "")]
    names = {(g, v) for g, *ends, _, _ in edges for v in ends if not v.startswith("hub:")} | {("alone", "v0"), ("alone", "v1")}
    seeds = {(g, v): "said" if (g, v) == ("alone", "v1") else None for g, v in names}
    found = refined(spark.createDataFrame(edges, "g string, src string, dst string, role string, label string"), spark.createDataFrame([(*k, s) for k, s in seeds.items()], "g string, vertex string, seed string"), ["g"], store=store)
    colors = {(r.g, r.vertex): r.color for r in found.collect()}
    expected = dict.fromkeys(names | {("hub", "hub:0")}, "") | {k: s or "" for k, s in seeds.items()}
    for _ in range(52):
        around = {k: sorted([("out", lab, expected[g, d]) for g, s, d, _, lab in edges if (g, s) == k] + [("in", lab, expected[g, s]) for g, s, d, _, lab in edges if (g, d) == k]) for k in expected}
        kinds = {x: n for n, x in enumerate(sorted({repr((expected[k], around[k])) for k in expected}))}
        new = {k: str(kinds[repr((expected[k], around[k]))]) for k in expected}
        if len(set(new.values())) == len(set(expected.values())):
            break
        expected = new
    assert colors.keys() == expected.keys()
    assert len(set(colors.values())) == len(set(expected.values())) == len({(colors[k], expected[k]) for k in expected})
    assert plans[-1] == (1, {"bigint"})
