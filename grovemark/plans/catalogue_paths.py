"""Queries that hold the ways to one answer against SQL: texts as variants, odd numbers, rows of lists, quarantine, table functions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import spread
from ..operators import assignment, reference_graph, referential, table_functions
from ..operators.nodes import node_table
from . import catalogue as c
from . import catalogue_documents as d
from .engine import Aligner

query, table, six = c.query, c.table, c.six

# Texts.

TEXT = {
    "type": "object", "keyScore": "exact", "required": ["price"],
    "properties": {
        "status": {"type": "string", "score": "exact"}, "price": {"type": "number", "score": "relative", "valueWeight": 2},
        "prio": {"type": "string", "score": "levenshtein", "threshold": 0.5}, "cust": {"type": ["integer", "null"], "score": "exact", "nullScore": 0.5},
    },
}


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON text. Of pred, each sixth has a key too many, each thirteenth lacks one, each seventeenth has a number for a text,
    each nineteenth is no JSON; the customer may be null."""
    key = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    text = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    k = F.col("k")
    cust = lambda v: F.coalesce(v.cast("string"), F.lit("null"))
    whole = lambda *parts: F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    gold = whole(key("status", text(F.col("g_status"))), key("price", F.col("g_price").cast("string")), key("prio", text(F.col("g_prio"))), key("cust", cust(F.col("g_cust"))))
    pred = whole(
        key("cust", cust(F.col("p_cust"))), F.when(k % 13 != 0, key("prio", text(F.col("p_prio")))), key("price", F.col("p_price").cast("string")),
        key("status", F.when(k % 17 == 0, F.lit("7")).otherwise(text(F.col("p_status")))), F.when(k % 6 == 0, key("more", F.lit("[1, {}]"))),
    )
    return c.order_pairs(spark, sf_dir).select(k.alias("pair_id"), gold.alias("gold"), F.when(k % 19 == 0, F.lit('{"price": ')).otherwise(pred).alias("pred"))


TEXT_SQL = f"""{c.SCORED_SQL}, texts AS (SELECT k, CASE WHEN k % 19 = 0 OR k % 17 = 0 THEN 0 ELSE (s_status + 2 * s_price + CASE WHEN k % 13 = 0 THEN 0 ELSE s_prio END + s_cust) / (5 + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END) END AS score FROM scored)"""


@query(f"{TEXT_SQL} SELECT k, round(score, 6)::DOUBLE AS score FROM texts")
def score_text_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts scored without leaving the JVM: absent, null, additional and wrong-typed keys, and texts that are no JSON."""
    return c._keyed(Aligner(TEXT).score(order_texts(spark, sf_dir))).withColumn("score", six(F.col("score")))


@query(f"{TEXT_SQL} SELECT k, round(score, 6)::DOUBLE AS score FROM texts")
def score_text_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the kernel's nodes."""
    nodes = Aligner(TEXT).nodes(order_texts(spark, sf_dir)).where("parent_id IS NULL")
    return c._keyed(nodes.select("pair_id", six(F.col("total")).alias("score")))


@query(c.ORACLES["list_bag_exact"])
def list_bag_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in JSON text, in any order."""
    bags = c.item_bags(spark, sf_dir).select(F.col("k").alias("pair_id"), F.to_json("g").alias("gold"), F.to_json("p").alias("pred"))
    return c._keyed(Aligner(c.BAG).score(bags)).withColumn("score", six(F.col("score")))


@query("""WITH v AS (SELECT event_id AS k, value, event_type AS t, props FROM events), o AS (SELECT *, CASE WHEN k % 7 = 0 THEN '/v' WHEN k % 5 = 0 THEN '/tags/1' WHEN k % 3 = 0 THEN '/n' END AS error_path FROM v)
SELECT k, error_path IS NULL AS valid, error_path FROM o""")
def validate_text_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first breach of texts with lists: a wrong type, an item that isn't allowed, and a key too many, looked for in this order."""
    from ..operators.validate import json_errors

    schema = {"type": "object", "required": ["v", "tags"], "properties": {"v": {"type": "number"}, "tags": {"type": "array", "maxItems": 3, "items": {"type": "string", "enum": [*"abcde"]}}, "n": {"type": "object", "additionalProperties": False, "properties": {"k": {"type": "integer"}}}}}
    k = F.col("event_id")
    tags = F.to_json(F.array(F.lit("a"), F.when(k % 5 == 0, "zz").otherwise("b")))
    value = F.when(k % 7 == 0, F.lit('"none"')).otherwise(F.col("value").cast("string"))
    inner = F.when(k % 3 == 0, F.lit('{"k": 1, "l": 2}')).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select(k.alias("k"), F.concat(F.lit('{"v": '), value, F.lit(', "tags": '), tags, F.lit(', "n": '), inner, F.lit("}")).alias("text"))
    return json_errors(rows, "text", schema).select("k", "valid", "error_path")


# Numbers that aren't.

ODD_SQL = """WITH odd AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 AS nothing, CASE WHEN o_orderkey % 7 = 0 THEN 'nan' WHEN o_orderkey % 11 = 0 THEN 'inf' WHEN o_orderkey % 13 = 0 THEN '-inf' WHEN o_orderkey % 17 = 0 THEN '0' ELSE 'n' END AS g,
  CASE WHEN o_orderkey % 5 = 0 THEN 'nan' WHEN o_orderkey % 3 = 0 THEN 'inf' WHEN o_orderkey % 17 = 0 THEN '0' ELSE 'n' END AS p, o_totalprice AS x FROM orders),
told AS (SELECT *, CASE WHEN nothing THEN 0 WHEN g = p THEN 1 WHEN g IN ('inf', '-inf') OR p IN ('inf', '-inf') THEN 0 END AS s, CASE WHEN g = '0' THEN 0 ELSE x END AS a, CASE WHEN p = '0' THEN 0 ELSE x END AS b FROM odd)"""


@query(f"""{ODD_SQL}, each AS (SELECT k, coalesce(s, CASE WHEN a = b THEN 1 ELSE 0 END) AS e, coalesce(s, 1 / (1 + abs(a - b))) AS i, coalesce(s, CASE WHEN a = b THEN 1 ELSE greatest(0, 1 - abs(a - b) / greatest(abs(a), abs(b))) END) AS r FROM told)
SELECT k, round((e + i + r) / 3, 6)::DOUBLE AS by_columns, round((e + i + r) / 3, 6)::DOUBLE AS by_nodes, round((e + i + r) / 3, 6)::DOUBLE AS by_kernel, round((e + i + r) / 3, 6)::DOUBLE AS by_batches FROM each""")
def score_odd_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN, infinities and zeros of both signs score alike by expressions, by typed nodes, by the kernel and by Arrow batches."""
    k, x, number = F.col("o_orderkey"), F.col("o_totalprice"), lambda s: F.lit(float(s))
    g = F.when(k % 7 == 0, number("nan")).when(k % 11 == 0, number("inf")).when(k % 13 == 0, number("-inf")).when(k % 17 == 0, number("0")).otherwise(x)
    p = F.when(k % 5 == 0, number("nan")).when(k % 3 == 0, number("inf")).when(k % 17 == 0, number("-0.0")).otherwise(x)
    metrics = ("exact", "invdiff", "relative")
    side = lambda v: F.struct(*(v.alias(m) for m in metrics))
    schema = {"type": "object", "keyScore": "exact", "properties": {m: {"type": "number", "score": m} for m in metrics}}
    pairs = table(spark, sf_dir, "orders").select(k.alias("pair_id"), side(g).alias("gold"), side(p).alias("pred"))
    lists = pairs.select("pair_id", *(F.array(s).alias(s) for s in ("gold", "pred")))
    aligner, listed = Aligner(schema), Aligner({"type": "array", "items": schema})
    root = lambda n: n.where("parent_id IS NULL").select("pair_id", F.col("total").alias("score"))
    ways = {"by_columns": aligner.score(pairs), "by_nodes": root(aligner.nodes(pairs)), "by_kernel": root(node_table(pairs, aligner.plan, aligner.raw)), "by_batches": listed.score(lists)}
    out = None
    for name, scored in ways.items():
        # a pair without likeness falls apart into two rows, both 0
        one = scored.select("pair_id", six(F.col("score")).alias(name))
        out = one if out is None else out.join(one, "pair_id")
    return c._keyed(out)


# Rows of lists, over the items of all orders.

BAG_ROWS_SQL = """WITH g AS (SELECT l_orderkey AS k, l_partkey % 5 AS v, count(*) AS a FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey AS k, l_suppkey % 5 AS v, count(*) AS b FROM lineitem GROUP BY ALL),
sides AS (SELECT k, v, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM g FULL JOIN p USING (k, v)), whole AS (SELECT k, sum(greatest(a, b)) AS n FROM sides GROUP BY k)"""


@query(f"""{BAG_ROWS_SQL} SELECT sides.k, v::VARCHAR AS item, sum(least(a, b))::BIGINT AS n_right, sum(greatest(0, a - b))::BIGINT AS n_missing, sum(greatest(0, b - a))::BIGINT AS n_excess, round(sum(abs(a - b)) / max(n), 6)::DOUBLE AS lost
FROM sides JOIN whole USING (k) GROUP BY sides.k, v""")
def attribution_item_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of item costs its order: the rows of lists in any order, as columns and generated rows."""
    aligner = Aligner(c.BAG)
    bags = c.item_bags(spark, sf_dir).select(F.col("k").alias("pair_id"), F.col("g").alias("gold"), F.col("p").alias("pred"))
    rows = aligner.attribute(aligner.nodes(bags))
    kind = lambda right, gold: F.count_if((F.col("score") >= 1) == right if gold is None else (F.col("score") < 1) & F.col("gold").isNotNull() if gold else (F.col("score") < 1) & F.col("gold").isNull())
    found = rows.groupBy("pair_id", F.coalesce("gold", "pred").alias("item")).agg(kind(True, None).alias("n_right"), kind(False, True).alias("n_missing"), kind(False, False).alias("n_excess"), F.sum("contribution").alias("lost"))
    return c._keyed(found).withColumn("lost", six(F.col("lost")))


@query(f"""{BAG_ROWS_SQL} SELECT k, 'list_item_missing' AS kind, 'add' AS op, v::VARCHAR AS item, (a - b)::BIGINT AS n, round((a - b) / n, 6)::DOUBLE AS score_delta FROM sides JOIN whole USING (k) WHERE a > b
UNION ALL SELECT k, 'list_item_excess', 'remove', v::VARCHAR, (b - a)::BIGINT, round((b - a) / n, 6)::DOUBLE FROM sides JOIN whole USING (k) WHERE b > a""")
def repair_item_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items lack and which are too many."""
    aligner = Aligner(c.BAG)
    bags = c.item_bags(spark, sf_dir).select(F.col("k").alias("pair_id"), F.col("g").alias("gold"), F.col("p").alias("pred"))
    ops = aligner.repair(aligner.nodes(bags)).where("path = '/'")
    return c._keyed(ops.groupBy("pair_id", "kind", "op", F.coalesce("gold", "pred").alias("item")).agg(F.count(F.lit(1)).alias("n"), six(F.sum("score_delta")).alias("score_delta")))


@query(f"""{c.LISTS_SQL}, {c._lcs_sql("marks", "k")}, sized AS (SELECT k, a + b - n AS whole, a - n AS lacks, b - n AS more FROM longest)
SELECT k, 'list_item_add' AS kind, lacks::BIGINT AS n, round(lacks / whole, 6)::DOUBLE AS score_delta FROM sized WHERE lacks > 0 UNION ALL SELECT k, 'list_item_remove', more::BIGINT, round(more / whole, 6)::DOUBLE FROM sized WHERE more > 0""")
def repair_ordered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to add to and to remove from lists in order."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id")).agg(c._sorted_list(F.col("l_partkey") % 4).alias("gold"), c._sorted_list(F.col("l_suppkey") % 4).alias("pred"))
    aligner = Aligner({"type": "array", "items": {"type": "integer", "score": "exact"}})
    ops = aligner.repair(aligner.nodes(items))
    return c._keyed(ops.groupBy("pair_id", "kind").agg(F.count(F.lit(1)).alias("n"), six(F.sum("score_delta")).alias("score_delta")))


@query(f"""{c.LISTS_SQL} SELECT k, (i - 1)::INTEGER AS place, g[i] AS gold, q[i] AS pred, round(CASE WHEN i <= len(g) AND i <= len(q) THEN 1 / (1 + abs(g[i] - q[i])) ELSE 0 END, 6)::DOUBLE AS score,
  round(CASE i WHEN 1 THEN 3 ELSE 1 END / (3 + CASE WHEN greatest(len(g), len(q)) > 1 THEN 1 ELSE 0 END), 6)::DOUBLE AS weight FROM lists, (VALUES (1), (2)) AS places(i) WHERE i <= greatest(len(g), len(q))""")
def attribution_item_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the first two items of each order, the first three times as much."""
    aligner = Aligner({"type": "array", "prefixItems": [c.NUMBER, c.NUMBER], "prefixWeights": [3, 1]})
    lists = c.item_lists(spark, sf_dir).select(F.col("k").alias("pair_id"), F.col("g").alias("gold"), F.col("p").alias("pred"))
    rows = aligner.attribute(aligner.nodes(lists)).where("path <> '/'")
    return c._keyed(rows.select("pair_id", F.substring("path", 2, 1).cast("int").alias("place"), F.col("gold").cast("double").alias("gold"), F.col("pred").cast("double").alias("pred"), six(F.col("score")).alias("score"), six(F.col("weight")).alias("weight")))


# Attribution of keys, repairs of subtrees and references.


@query(f"""{c.PARTS_SQL} SELECT k, 'value' AS part, path, round(s, 6) AS score, round(0.75 * w, 6) AS weight FROM parts UNION ALL SELECT k, 'key', path, 1::DOUBLE, 0.0625::DOUBLE FROM parts""")
def attribution_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that count have rows of their own."""
    aligner = Aligner(c.KEYS, skip_validation=True)
    rows = aligner.attribute(aligner.nodes(c.order_structs(spark, sf_dir)))
    return c._keyed(rows.select("pair_id", "part", "path", six(F.col("score")).alias("score"), six(F.col("weight")).alias("weight")))


@query(f"{c.SCORED_SQL} SELECT k, 'subtree_replace' AS kind, '/' AS path, round(1 - {c.TOTAL_SQL}, 6) AS score_delta FROM scored WHERE {c.TOTAL_SQL} < 1")
def repair_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One replacement of all of a prediction that isn't right."""
    aligner = Aligner(c.ORDER_SCHEMA, skip_validation=True)
    rows = aligner.repair(aligner.nodes(c.order_structs(spark, sf_dir)), granularity="subtree")
    return c._keyed(rows.select("pair_id", "kind", "path", six(F.col("score_delta")).alias("score_delta")))


@query(f"{c.PAIRS_SQL} SELECT k, g_status AS status, round(g_price, 6) AS price, g_prio AS prio, g_cust AS cust FROM pairs")
def repair_apply_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all repairs make of each prediction: its gold, value by value."""
    aligner, pairs = Aligner(c.ORDER_SCHEMA, skip_validation=True), c.order_structs(spark, sf_dir)
    fixed = aligner.apply(pairs, aligner.repair(aligner.nodes(pairs)))
    whole = F.from_json("repaired", "status string, price double, prio string, cust bigint")
    return c._keyed(fixed.select("pair_id", whole.alias("x")).select("pair_id", "x.status", six(F.col("x.price")).alias("price"), "x.prio", "x.cust"))


@query("SELECT (c_custkey // 10)::BIGINT AS k, c_custkey::VARCHAR AS gold_id, (c_custkey * 7 + 13)::VARCHAR AS pred_id FROM customer")
def wl_blend_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that only their places in chains tell apart, by likenesses that the graph's say is blended into."""
    found = Aligner(d.GRAPH, wl_fold="blend").identities(d._texts(d._graphs(spark, sf_dir, False, False)))
    return c._keyed(found.select("pair_id", "gold_id", "pred_id"))


CHAIN_SQL = """WITH p AS (SELECT (c_custkey // 10)::BIGINT AS k, c_custkey AS id, c_name, row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey DESC) AS r, count(*) OVER (PARTITION BY c_custkey // 10) AS n FROM customer),
wrong AS (SELECT last.k, last.n, last.id, last.c_name AS meant, before.c_name AS used FROM p last JOIN p before ON before.k = last.k AND before.r = 2 WHERE last.r = 1 AND last.k % 3 = 0)"""


@query(f"{CHAIN_SQL} SELECT k, 'ref_fix' AS kind, 'replace' AS op, '/links/' || (n - 2) || '/target' AS path, (id * 7 + 13)::VARCHAR AS value, round(0.25 / (n - 1), 6)::DOUBLE AS score_delta FROM wrong")
def repair_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A redirected reference is repaired in the prediction's own identifiers."""
    aligner = Aligner(d.GRAPH)
    rows = aligner.repair(aligner.nodes(d._texts(d._graphs(spark, sf_dir, True, True))))
    return c._keyed(rows.select("pair_id", "kind", "op", "path", "value", six(F.col("score_delta")).alias("score_delta")))


REFERENCES = {"feedback.refsem.prop": "{key}={value}", "feedback.refsem.target": "{scope} {gold_props}", "feedback.refsem.used": "{scope} {pred_props}"}


@query(f"""{CHAIN_SQL} SELECT k, '/links/' || (n - 2) || '/target' AS path, 'person' AS scope, 'person name=''' || meant || '''' AS target, 'person name=''' || used || '''' AS used, true AS certain FROM wrong""")
def reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a redirected reference should have pointed to and what it does, told by the records' names."""
    aligner, pairs = Aligner(d.GRAPH, templates=REFERENCES), d._texts(d._graphs(spark, sf_dir, True, True))
    rows = aligner.references(pairs, aligner.nodes(pairs))
    return c._keyed(rows.select("pair_id", "path", "scope", "target", "used", "certain"))


@query("SELECT c_nationkey AS nation, c_custkey AS id, c_name AS name FROM customer")
def tolerant_definers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of records that define an identifier twice the first counts, as for a reader that doesn't raise."""
    own = c._gold_defs(spark, sf_dir)
    double = own.withColumn("place", F.lit(1)).union(own.where("id % 50 = 0").withColumns({"name": F.lit("again"), "place": F.lit(2)}))
    return referential.first_definers(double, ["nation"], "place").drop("place")


CHAINS_SQL = "WITH g AS (SELECT (c_custkey // 10)::BIGINT AS k, count(*) AS n FROM customer GROUP BY ALL)"


@query(f"{CHAINS_SQL} SELECT k, side, (n - 1)::BIGINT AS n_edges, CASE WHEN side = 'pred' AND k % 3 = 0 AND n > 1 THEN 1 ELSE 0 END::BIGINT AS n_loops FROM g, (VALUES ('gold'), ('pred')) AS sides(side) WHERE n > 1")
def ref_graph_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of texts as edges: a redirected link leads back to where it begins."""
    plan, pairs = Aligner(d.GRAPH).plan, d._texts(d._graphs(spark, sf_dir, False, True))
    out = None
    for side in ("gold", "pred"):
        edges = reference_graph.reference_edges(reference_graph.reference_ends(pairs, plan, "person", side), reference_graph.definers(pairs, plan, "person", side), ["pair_id"])
        one = edges.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("src") == F.col("dst")).alias("n_loops")).withColumn("side", F.lit(side))
        out = one if out is None else out.unionByName(one)
    return c._keyed(out)


@query(f"{CHAINS_SQL} SELECT k, n AS n_colors, CASE WHEN k % 3 = 0 AND n > 1 THEN 0 ELSE n END::BIGINT AS n_shared FROM g")
def wl_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of records that only their places tell apart: all colours differ, and a redirected link changes all of them."""
    found = reference_graph.graph_colors(d._texts(d._graphs(spark, sf_dir, False, True)), Aligner(d.GRAPH).plan, "person")
    sides = found.groupBy("pair_id", "color").agg(F.count_if(F.col("side") == "gold").alias("g"), F.count_if(F.col("side") == "pred").alias("p"))
    return c._keyed(sides.groupBy("pair_id").agg(F.count_if(F.col("g") > 0).alias("n_colors"), F.count_if((F.col("g") > 0) & (F.col("p") > 0)).alias("n_shared")))


@query("SELECT c_nationkey::VARCHAR AS k, c_custkey::VARCHAR AS gold_id, CASE WHEN c_custkey % 19 <> 0 THEN (c_custkey * 7 + 13)::VARCHAR END AS pred_id FROM customer")
def definer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a nation, all its customers: what each stands for, by tables alone. Every nineteenth has no counterpart."""
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("pair_id"), "c_custkey", "c_name")
    new = F.when(F.col("c_custkey") % 19 != 0, F.struct((F.col("c_custkey") * 7 + 13).alias("id"), F.col("c_name").alias("name")))
    docs = people.groupBy("pair_id").agg(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("g"), F.collect_list(new).alias("p"))
    text = lambda x: F.to_json(F.struct(F.col(x).alias("people"), F.array().cast("array<struct<source:long,target:long>>").alias("links")))
    pairs = docs.select("pair_id", text("g").alias("gold"), text("p").alias("pred"))
    found = assignment.identity_table(pairs, Aligner(d.GRAPH, disambiguation="none").plan, "person", by="name")
    return found.select(F.col("pair_id").alias("k"), "gold_id", "pred_id")


# Rejected rows, entries as rows, SQL.


@query(f"""{c.PAIRS_SQL}, told AS (SELECT k, CASE WHEN k % 23 = 0 THEN 'gold' WHEN p_status NOT IN ('F', 'O', 'P') OR p_cust IS NULL THEN 'pred' END AS side, CASE WHEN k % 23 = 0 THEN '/prio' WHEN p_status NOT IN ('F', 'O', 'P') THEN '/status' WHEN p_cust IS NULL THEN '/cust' END AS error_path FROM pairs)
SELECT k, side IS NULL AS kept, side, error_path FROM told""")
def gold_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs set aside for a bad gold or pred, in place of a failed job."""
    pairs = c.order_structs(spark, sf_dir)
    pairs = pairs.withColumn("gold", F.when(F.col("pair_id") % 23 == 0, F.col("gold").withField("prio", F.lit(None).cast("string"))).otherwise(F.col("gold")))
    valid, rejected, _ = Aligner(d.STRICT).quarantine(pairs)
    none = F.lit(None).cast("string")
    return c._keyed(valid.select("pair_id", F.lit(True).alias("kept"), none.alias("side"), none.alias("error_path")).union(rejected.select("pair_id", F.lit(False), "side", "error_path")))


@query(f"""{c.PARTS_SQL} SELECT k, 'dict' AS match_kind, 'mismatch' AS outcome, count(*)::BIGINT AS n FROM (SELECT k, {c.TOTAL_SQL} AS t FROM scored) WHERE t < 1 GROUP BY k
UNION ALL SELECT k, 'dict.key', 'match', 4 FROM scored WHERE {c.TOTAL_SQL} < 1
UNION ALL SELECT k, kind, outcome, count(*) FROM (SELECT parts.k, CASE WHEN path = '/cust' AND (g_cust IS NULL OR p_cust IS NULL) THEN 'null' ELSE 'item' END AS kind, CASE WHEN s >= 1 THEN 'match' ELSE 'mismatch' END AS outcome FROM parts JOIN scored USING (k) WHERE {c.TOTAL_SQL} < 1) GROUP BY ALL""")
def describe_entry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description's entries as a table: what was said of each pair, by kind and outcome."""
    aligner = Aligner(c.ORDER_SCHEMA, skip_validation=True)
    rows = aligner.describe_entries(aligner.nodes(c.order_structs(spark, sf_dir)).where("total < 1"))
    return c._keyed(rows.groupBy("pair_id", "match_kind", "outcome").agg(F.count(F.lit(1)).alias("n")))


@query(f"{TEXT_SQL} SELECT k, round(score, 6)::DOUBLE AS score, CASE WHEN k % 19 = 0 OR k % 17 = 0 THEN 1 ELSE 9 + CASE WHEN k % 6 = 0 THEN 2 ELSE 0 END END::BIGINT AS n_nodes FROM texts")
def nodes_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment as a table function of SQL."""
    table_functions.register(spark)
    spread(order_texts(spark, sf_dir), "pair_id").createOrReplaceTempView("_text_pairs")
    schema = json.dumps(TEXT)
    return spark.sql(f"SELECT p.pair_id AS k, round(max(n.total), 6) AS score, count(*) AS n_nodes FROM _text_pairs p, LATERAL alignment_nodes(p.gold, p.pred, '{schema}') n GROUP BY p.pair_id")


c.ORACLES["leaf_context_metric"] = f"{c.SCORED_SQL} SELECT k, round((2 * s_status + s_prio + s_cust) / 4, 6) AS score FROM scored"  # the price has the default weight

#: The programme of lists in order cell by cell: its rows before and so far, a cell being (value, pairs); ties prefer a pair, then the gold item left out.
CELLS_SQL = """, cells AS (SELECT k, g, q, 1 AS i, 1 AS j, list_transform(range(len(q) + 1), lambda x: {'v': 0::DOUBLE, 'n': 0}) AS above, [{'v': 0::DOUBLE, 'n': 0}] AS line FROM lists
  UNION ALL SELECT k, g, q, CASE WHEN j = len(q) THEN i + 1 ELSE i END, CASE WHEN j = len(q) THEN 1 ELSE j + 1 END, CASE WHEN j = len(q) THEN whole ELSE above END, CASE WHEN j = len(q) THEN [{'v': 0::DOUBLE, 'n': 0}] ELSE whole END
  FROM (SELECT *, list_append(line, CASE WHEN above[j].v + s >= above[j + 1].v AND above[j].v + s >= line[j].v THEN {'v': above[j].v + s, 'n': above[j].n + 1} WHEN above[j + 1].v >= line[j].v THEN above[j + 1] ELSE line[j] END) AS whole
    FROM (SELECT *, 1 / (1 + abs(g[i] - q[j])) AS s FROM cells WHERE i <= len(g) AND len(q) > 0)))"""
c.ORACLES["list_ordered_numeric"] = f"""{c.LISTS_SQL}{CELLS_SQL} SELECT k, round(above[len(q) + 1].v / (len(g) + len(q) - above[len(q) + 1].n), 6)::DOUBLE AS score FROM cells WHERE i > len(g) OR len(q) = 0"""
_SWAPS = d.OSA_SQL.format(head=c.LETTERS_SQL.partition(", lcs AS")[0]).replace("SELECT x AS a, y AS b, round", "SELECT k, x AS a, y AS b, round").replace("FROM osa WHERE i = len(g)", "FROM osa JOIN changed ON changed.a = x AND changed.b = y WHERE i = len(g)")
c.ORACLES["leaf_osa"] = _SWAPS
