"""Queries over pairs of whole documents: what only the node table, the kernel and the identity maps can say, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import similarity
from ..operators import semantic
from . import catalogue as c
from .engine import Aligner

query, table, six = c.query, c.table, c.six


def _texts(df: DataFrame) -> DataFrame:
    """(k, gold, pred structs) as (pair_id, gold, pred) in JSON text; null fields are absent keys."""
    return df.select(F.col("k").alias("pair_id"), F.to_json("gold").alias("gold"), F.to_json("pred").alias("pred"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")


# Validation.

STRICT = {
    "type": "object", "keyScore": "exact", "required": ["status", "price", "prio", "cust"], "additionalProperties": False,
    "properties": {
        "status": {"type": "string", "score": "exact", "enum": ["F", "O", "P"]}, "price": {"type": "number", "score": "relative", "valueWeight": 2},
        "prio": {"type": "string", "score": "levenshtein", "threshold": 0.5}, "cust": {"type": "integer", "score": "exact"},
    },
}


@query(f"""{c.SCORED_SQL}, told AS (SELECT *, CASE WHEN p_status NOT IN ('F', 'O', 'P') THEN '/status' WHEN p_cust IS NULL THEN '/cust' END AS error_path FROM scored)
SELECT k, round(CASE WHEN error_path IS NULL THEN {c.TOTAL_SQL} ELSE 0 END, 6) AS score, round(CASE WHEN error_path IS NULL THEN {c.TOTAL_SQL} ELSE 0 END, 6) AS by_nodes,
  round(CASE WHEN error_path IS NULL THEN {c.TOTAL_SQL} ELSE 0 END, 6) AS by_text, error_path IS NULL AS valid, error_path FROM told""")
def score_invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that break the schema score 0 on all paths: one expression, node table of typed pairs, kernel on JSON text."""
    from ..operators.nodes import with_json

    aligner, pairs = Aligner(STRICT), c.order_structs(spark, sf_dir)
    text = with_json(pairs).select("pair_id", F.col("_gold").alias("gold"), F.col("_pred").alias("pred"))
    nodes = aligner.nodes(pairs).where("parent_id IS NULL").select("pair_id", six(F.col("total")).alias("by_nodes"), "valid", "error_path")
    out = aligner.score(pairs).withColumn("score", six(F.col("score"))).join(nodes, "pair_id").join(aligner.score(text).select("pair_id", six(F.col("score")).alias("by_text")), "pair_id")
    return c._keyed(out)


# Repairs of keys and lists.

KEYS = {"type": "object", "keyScore": "exact", "properties": {"status": {"type": "string", "score": "exact"}, "prio": {"type": "string", "score": "exact"}}}
KEYS_SQL = "(2 + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END)::DOUBLE"


def _op_rows(aligner: Aligner, pairs: DataFrame, **options) -> DataFrame:
    rows = aligner.repair(aligner.nodes(pairs), **options)
    return c._keyed(rows.select("pair_id", "op", "kind", "path", "value", six(F.col("score_delta")).alias("score_delta")))


@query(f"""SELECT o_orderkey AS k, 'replace' AS op, 'primitive_replace' AS kind, '/status' AS path, '"' || o_orderstatus || '"' AS value, round(1 / {KEYS_SQL}, 6) AS score_delta FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'add', 'key_add', '/prio', '"' || o_orderpriority || '"', round(1 / {KEYS_SQL}, 6) FROM orders WHERE o_orderkey % 13 = 0
UNION ALL SELECT o_orderkey, 'remove', 'key_remove', '/more', NULL, round(1 / {KEYS_SQL}, 6) FROM orders WHERE o_orderkey % 6 = 0""")
def repair_key_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that lack, keys too many, and wrong values."""
    o = _orders(spark, sf_dir)
    pred = F.struct(F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(F.col("k") % 13 != 0, F.col("o_orderpriority")).alias("prio"), F.when(F.col("k") % 6 == 0, F.lit("x")).alias("more"))
    pairs = o.select("k", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio")).alias("gold"), pred.alias("pred"))
    return _op_rows(Aligner(KEYS), _texts(pairs))


def _lists(spark: SparkSession, sf_dir: str, gold: Column, pred: Column) -> DataFrame:
    """Pairs of arrays made from each order's key."""
    return _orders(spark, sf_dir).select(F.col("k").alias("pair_id"), gold.alias("gold"), pred.alias("pred"))


K = F.col


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'add' ELSE 'remove' END AS op, CASE WHEN o_orderkey % 2 = 0 THEN 'list_item_add' ELSE 'list_item_remove' END AS kind,
  CASE WHEN o_orderkey % 2 = 0 THEN '/1' ELSE '/3' END AS path, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey + 1)::VARCHAR END AS value, round(1 / CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 4 END::DOUBLE, 6) AS score_delta FROM orders""")
def repair_ordered_list_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item that lacks in the middle, or one too many at the end, of lists in order."""
    k = K("k")
    pred = F.when(k % 2 == 0, F.array(k, k + 2)).otherwise(F.array(k, k + 1, k + 2, k + 3))
    return _op_rows(Aligner({"type": "array", "items": {"type": "integer", "score": "exact"}}), _lists(spark, sf_dir, F.array(k, k + 1, k + 2), pred))


ANY_ORDER = {"type": "array", "order": "align", "items": {"type": "number"}}


@query("""SELECT o_orderkey AS k, 'replace' AS op, 'primitive_replace_reorder' AS kind, '/' AS path, (o_orderkey * 100 + 50)::DOUBLE::VARCHAR AS value, round((1 - 1 / 2.0) / 2, 6)::DOUBLE AS score_delta FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'add', 'list_item_missing', '/', (o_orderkey * 100 + 50)::DOUBLE::VARCHAR, 0.5 FROM orders WHERE o_orderkey % 3 = 1
UNION ALL SELECT o_orderkey, 'remove', 'list_item_excess', '/', NULL, round(1 / 3::DOUBLE, 6) FROM orders WHERE o_orderkey % 3 = 2""")
def repair_any_order_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of lists in any order that are a little wrong, missing, or too many."""
    a, b = (K("k") * 100).cast("double"), (K("k") * 100 + 50).cast("double")
    pred = F.when(K("k") % 3 == 0, F.array(b + 1, a)).when(K("k") % 3 == 1, F.array(a)).otherwise(F.array(b, a + 7000, a))
    rows = _op_rows(Aligner(ANY_ORDER), _lists(spark, sf_dir, F.array(a, b), pred))
    # written out: from 10^7 on a double's text has an exponent
    return rows.withColumn("value", F.col("value").cast("double").cast("decimal(38,1)").cast("string"))


PLACES = {"type": "array", "prefixItems": [{"type": "integer"}, {"type": "integer"}], "prefixWeights": [3, 1], "items": {"type": "integer", "score": "exact"}, "prefixImportance": 3, "restImportance": 1}


@query("""SELECT o_orderkey AS k, path, round(CASE WHEN path = '/1' THEN 1 / (1 + o_orderkey % 4) ELSE s END::DOUBLE, 6) AS score, w AS weight FROM orders,
  (VALUES ('/0', 1, 0.5625::DOUBLE), ('/1', 0, 0.1875::DOUBLE), ('/2', 1, 0.125::DOUBLE), ('/3', 0, 0.125::DOUBLE)) AS v(path, s, w)""")
def attribution_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of weighted places and of the rest after them."""
    k = K("k")
    pairs = _lists(spark, sf_dir, F.array(k, k, k + 1, k + 2), F.array(k, k + k % 4, k + 1))
    aligner = Aligner(PLACES)
    rows = aligner.attribute(aligner.nodes(pairs))
    return c._keyed(rows.select("pair_id", "path", six(F.col("score")).alias("score"), "weight"))


@query("""SELECT o_orderkey AS k, path, s::DOUBLE AS score, round(1 / 3::DOUBLE, 6) AS weight FROM orders, (VALUES ('/0', 1), ('/1', 0), ('/2', 1)) AS v(path, s)""")
def attribution_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a list's rows, by alignment index."""
    k = K("k")
    aligner = Aligner({"type": "array", "items": {"type": "integer", "score": "exact"}})
    rows = aligner.attribute(aligner.nodes(_lists(spark, sf_dir, F.array(k, k + 1, k + 2), F.array(k, k + 2))))
    return c._keyed(rows.select("pair_id", "path", six(F.col("score")).alias("score"), six(F.col("weight")).alias("weight")))


# Gold [a, a + 3] against [a, a + 3 + r, a + 9], r = k % 3: pairs keep their places. Margins over rows and columns of the likenesses.
SURE_SQL = """WITH s AS (SELECT o_orderkey AS k, o_orderkey % 3 AS r FROM orders), m AS (SELECT k, r, 1 - greatest(1 / (4.0 + r), 0.25, 0.1) AS m1, greatest(0, 1 / (1.0 + r) - greatest(0.25, 1 / 7.0, 1 / (4.0 + r))) AS m2 FROM s),
ops AS (SELECT k, 'list_item_excess' AS kind, 1 / 3.0 AS delta, (m1 + m2) / 2 AS sure FROM m UNION ALL SELECT k, 'primitive_replace_reorder', (1 - 1 / (1.0 + r)) / 3, m2 FROM m WHERE r > 0)"""


def _sure_ops(spark: SparkSession, sf_dir: str, rank_by: str) -> DataFrame:
    a = (K("k") * 100).cast("double")
    pairs = _lists(spark, sf_dir, F.array(a, a + 3), F.array(a, a + 3 + K("k") % 3, a + 9))
    aligner = Aligner(ANY_ORDER, compute_confidence=True)
    rows = aligner.repair(aligner.nodes(pairs), rank_by=rank_by)
    return c._keyed(rows.select("pair_id", "rank", "kind", six(F.col("score_delta")).alias("score_delta"), six(F.col("confidence")).alias("confidence")))


@query(f"{SURE_SQL} SELECT k, (row_number() OVER (PARTITION BY k ORDER BY sure DESC, delta DESC))::INTEGER AS rank, kind, round(delta, 6)::DOUBLE AS score_delta, round(sure, 6)::DOUBLE AS confidence FROM ops")
def repair_rank_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs by how sure their pairing is; what has no partner is as sure as its list."""
    return _sure_ops(spark, sf_dir, "confidence")


@query(f"{SURE_SQL} SELECT k, (row_number() OVER (PARTITION BY k ORDER BY delta * sure DESC, delta DESC))::INTEGER AS rank, kind, round(delta, 6)::DOUBLE AS score_delta, round(sure, 6)::DOUBLE AS confidence FROM ops")
def repair_rank_expected_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sure_ops(spark, sf_dir, "expected_gain")


# Texts.

TOLD = {"feedback.intro.perfect": "right", "feedback.intro.imperfect": "{score:.6f} {n_shown}/{n_total}|", "feedback.op.primitive_replace": "{rank} {path} +{score_delta:.6f}", "feedback.op.null_value_replace": "{rank} {path} null", "feedback.synthesis.single_dominant": "|{dominant_kind_human}", "feedback.synthesis.mixed": "|{top_kinds}"}


@query(f"""{c.OPS_SQL}, lines AS (SELECT k, count(*) AS n, sum(delta) AS whole, sum(CASE WHEN kind = 'primitive_replace' THEN delta ELSE 0 END) AS plain, sum(CASE WHEN kind <> 'primitive_replace' THEN delta ELSE 0 END) AS nulls,
  string_agg(CASE WHEN kind = 'primitive_replace' THEN rank || ' ' || path || ' +' || printf('%.6f', delta) ELSE rank || ' ' || path || ' null' END, chr(10) ORDER BY rank) AS body FROM ranked GROUP BY k)
SELECT s.k, round({c.TOTAL_SQL}, 6) AS score, coalesce(n, 0)::INTEGER AS n_ops, CASE WHEN n IS NULL THEN 'right' ELSE printf('%.6f', {c.TOTAL_SQL}) || ' ' || n || '/' || n || '|' || body ||
  CASE WHEN plain / whole >= 0.6 THEN '|primitive-value' WHEN nulls / whole >= 0.6 THEN '|null-value' WHEN plain >= nulls THEN '|primitive-value, null-value' ELSE '|null-value, primitive-value' END END AS text FROM scored s LEFT JOIN lines USING (k)""")
def feedback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback in texts of the caller's, so that SQL can write them too."""
    aligner = Aligner(c.ORDER_SCHEMA, skip_validation=True, templates=TOLD)
    rows = aligner.feedback(aligner.nodes(c.order_structs(spark, sf_dir)), top_k=None)
    return c._keyed(rows.select("pair_id", six(F.col("score")).alias("score"), F.col("n_total_ops").alias("n_ops"), "text"))


SAID = {k: "" for k in ("describe.dict.key.match", "describe.dict.key.mismatch", "describe.dict.match", "describe.dict.mismatch", "describe.null.match")} | {"describe.intro.imperfect": "score {score_pct}:", "describe.item.match": " {path} right;", "describe.item.mismatch": " {path} {score_pct};", "describe.null.mismatch": " {path} null;", "describe.dict.value.prefix": " "}


def _said(path: str, score: str, null: bool = False) -> str:
    other = f"CASE WHEN {score} >= 1 THEN ' {path} right;' ELSE ' {path} ' || round_even(100 * {score}, 0)::INTEGER || '%;' END"
    return f"CASE WHEN p_cust IS NULL OR g_cust IS NULL THEN ' {path} null;' ELSE {other} END" if null else other


@query(f"""{c.SCORED_SQL} SELECT k, round({c.TOTAL_SQL}, 6) AS score, CASE WHEN {c.TOTAL_SQL} >= 1 THEN 'The prediction equals the gold.' ELSE 'score ' || round_even(100 * ({c.TOTAL_SQL}), 0)::INTEGER || '%:' ||
  {_said("/status", "s_status")} || {_said("/price", "s_price")} || {_said("/prio", "s_prio")} || {_said("/cust", "s_cust", True)} END AS text FROM scored""")
def describe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligner = Aligner(c.ORDER_SCHEMA, skip_validation=True, description_templates=SAID)
    return c._keyed(aligner.describe(aligner.nodes(c.order_structs(spark, sf_dir)))).withColumn("score", six(F.col("score")))


# Records that refer to one another, a document for each ten customers.

PERSON = {"type": "array", "order": "align", "items": {"type": "object", "keyScore": "exact", "properties": {"id": {"type": "integer", "idScope": "person"}, "name": {"type": "string", "score": "exact"}}}}
LINKS = {"type": "array", "order": "align", "items": {"type": "object", "keyScore": "exact", "properties": {"source": {"type": "integer", "ref": "person"}, "target": {"type": "integer", "ref": "person"}}}}
GRAPH = {"type": "object", "keyScore": "exact", "properties": {"people": PERSON, "links": LINKS}}


def _graphs(spark: SparkSession, sf_dir: str, named: bool, redirect: bool) -> DataFrame:
    """Ten customers in a chain; the prediction renumbers them and turns all lists round. redirect: every third's last link goes back to its start."""
    people = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 10).cast("long").alias("k"), F.col("c_custkey").alias("id"), "c_name")
    ids = people.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("id", "c_name"))).alias("p"))
    new = lambda i: i * 7 + 13
    name = lambda x: [x["c_name"].alias("name")] if named else []
    last = F.size("p") - 1

    def side(number, flip) -> Column:
        order = F.reverse if flip else (lambda a: a)
        records = order(F.transform("p", lambda x: F.struct(number(x["id"]).alias("id"), *name(x))))
        to = lambda i: F.when(F.lit(redirect and flip) & (K("k") % 3 == 0) & (i == last), F.get("p", i - 1)["id"]).otherwise(F.get("p", i)["id"])
        links = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(number(F.get("p", i - 1)["id"]).alias("source"), number(to(i)).alias("target")))
        return F.struct(records.alias("people"), order(F.when(F.size("p") > 1, links).otherwise(F.slice(links, 1, 0))).alias("links"))

    return ids.select("k", F.size("p").alias("n"), side(lambda i: i, False).alias("gold"), side(new, True).alias("pred"))


@query("""WITH g AS (SELECT (c_custkey // 10)::BIGINT AS k, count(*) AS n FROM customer GROUP BY ALL)
SELECT k, round(CASE WHEN k % 3 = 0 AND n > 1 THEN (1 + (n - 1.5) / (n - 1)) / 2 ELSE 1 END, 6)::DOUBLE AS score FROM g""")
def ref_graph_redirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renumbering costs nothing; a reference to another record costs its half of a link."""
    return c._keyed(Aligner(GRAPH).score(_texts(_graphs(spark, sf_dir, True, True)))).withColumn("score", six(F.col("score")))


@query("SELECT (c_custkey // 10)::BIGINT AS k, 1::DOUBLE AS score FROM customer GROUP BY ALL")
def ref_graph_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without any property of their own are told apart by the reference graph alone."""
    return c._keyed(Aligner(GRAPH).score(_texts(_graphs(spark, sf_dir, False, False)))).withColumn("score", six(F.col("score")))


@query("SELECT (c_custkey // 10)::BIGINT AS k, 1::DOUBLE AS score FROM customer GROUP BY ALL")
def wl_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the graph's say blended into the likenesses."""
    return c._keyed(Aligner(GRAPH, wl_fold="blend").score(_texts(_graphs(spark, sf_dir, False, False)))).withColumn("score", six(F.col("score")))


@query("SELECT (c_custkey // 10)::BIGINT AS k, 'person' AS scope, c_custkey::VARCHAR AS gold_id, (c_custkey * 7 + 13)::VARCHAR AS pred_id, false AS ambiguous FROM customer")
def definer_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each identifier stands for, by the records' properties and their places in the graph."""
    return c._keyed(Aligner(GRAPH).identities(_texts(_graphs(spark, sf_dir, True, False))))


@query("SELECT (c_custkey // 10)::BIGINT AS k, count(*) AS n, count(*) FILTER (WHERE false) AS n_paired_wrong, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS n_ambiguous FROM customer GROUP BY ALL")
def ambiguous_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the graph, records without properties can't be told apart: all are reported."""
    pairs = _graphs(spark, sf_dir, False, False)
    found = c._keyed(Aligner(GRAPH, disambiguation="none").identities(_texts(pairs)))
    return found.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred_id").isNull()).alias("n_paired_wrong"), F.count_if("ambiguous").alias("n_ambiguous"))


PAPER = {"type": "array", "order": "align", "items": {"type": "object", "keyScore": "exact", "properties": {"id": {"type": "string", "idScope": "work"}, "title": {"type": "string", "score": "exact"}}}}
REVIEW = {"type": "array", "order": "align", "items": {"type": "object", "keyScore": "exact", "properties": {"paper": {"type": "string", "ref": "work"}, "by": {"type": "integer", "ref": "person"}}}}


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN round(2.75 / 3, 6) ELSE 1 END::DOUBLE AS score FROM customer")
def ref_cross_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two papers of one title are told apart by their reviewers, whose scope is paired before by its name; in every fourth pair a review names no paper that is known."""
    k = K("k")
    people = lambda a, b: F.array(F.struct(a.alias("id"), F.lit("Ann").alias("name")), F.struct(b.alias("id"), F.lit("Bob").alias("name")))
    papers = lambda a, b: F.array(*(F.struct(F.lit(x).alias("id"), F.lit("One title").alias("title")) for x in (a, b)))
    review = lambda p, by: F.struct(p.alias("paper"), by.alias("by"))
    gold = F.struct(people(k, k + 1).alias("people"), papers("p", "q").alias("papers"), F.array(review(F.lit("p"), k), review(F.lit("q"), k + 1)).alias("reviews"))
    second = F.when(k % 4 == 0, "zz").otherwise("x")
    pred = F.struct(people(k * 3 + 5, k * 3 + 9).alias("people"), papers("x", "y").alias("papers"), F.array(review(second, k * 3 + 9), review(F.lit("y"), k * 3 + 5)).alias("reviews"))
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select("k", gold.alias("gold"), pred.alias("pred"))
    schema = {"type": "object", "keyScore": "exact", "properties": {"people": PERSON, "papers": PAPER, "reviews": REVIEW}}
    return c._keyed(Aligner(schema).score(_texts(pairs))).withColumn("score", six(F.col("score")))


# Metrics by embedding.

MEANING = {"AUTOMOBILE": [1.0, 0.0], "BUILDING": [0.0, 2.0], "FURNITURE": [3.0, 3.0], "HOUSEHOLD": [-1.0, 0.0], "MACHINERY": [0.0, -5.0]}
ANGLE = {"AUTOMOBILE": 0, "BUILDING": 90, "FURNITURE": 45, "HOUSEHOLD": 180, "MACHINERY": 270}
COS_SQL = "cos(radians(a - b))"
ANGLES_SQL = "WITH angles AS (SELECT c_custkey AS k, " + ", ".join(f"CASE {col} {' '.join(f'WHEN {chr(39)}{s}{chr(39)} THEN {d}' for s, d in ANGLE.items())} END AS {name}" for name, col in (("a", "c_mktsegment"), ("b", "CASE WHEN c_custkey % 3 = 0 THEN 'FURNITURE' ELSE c_mktsegment END"))) + " FROM customer)"


@query(f"{ANGLES_SQL} SELECT k, round((greatest(0, {COS_SQL}) + ({COS_SQL} + 1) / 2) / 2, 6)::DOUBLE AS score FROM angles")
def semantic_schema_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings inside documents compared by meaning, in a list and in a key: vectors come from a store that is filled first."""
    store = semantic.SessionStore(spark, semantic.DictEmbedder(MEANING))
    schema = {
        "type": "object", "keyScore": "exact",
        "properties": {"all": {"type": "array", "order": "align", "items": {"type": "string", "score": "clipped"}}, "one": {"type": "string", "score": "mapped"}},
    }
    aligner = Aligner(schema, custom_metrics={"string": {"clipped": semantic.CosineMetric(store), "mapped": semantic.CosineMetric(store, "affine")}})
    seg, other = F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "FURNITURE").otherwise(F.col("c_mktsegment"))
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), *(F.struct(F.array(s).alias("all"), s.alias("one")).alias(n) for n, s in (("gold", seg), ("pred", other))))
    return c._keyed(aligner.score(_texts(pairs))).withColumn("score", six(F.col("score")))


# Strings.

#: Edits with swaps of neighbours: a row of the programme from the two before; a row's cells are prefix minima.
OSA_SQL = """{head}, osa AS (SELECT x, y, g, q, 0 AS i, list_transform(range(0, len(q) + 1), lambda j: j) AS line, list_transform(range(0, len(q) + 1), lambda j: 1000000) AS older FROM lists
  UNION ALL SELECT x, y, g, q, i + 1, list_transform(range(1, len(q) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda t: j - t + CASE WHEN t = 1 THEN i + 1 ELSE
    least(line[t] + 1, line[t - 1] + CASE WHEN g[i + 1] = q[t - 1] THEN 0 ELSE 1 END, CASE WHEN t > 2 AND i > 0 AND g[i + 1] = q[t - 2] AND g[i] = q[t - 1] THEN older[t - 2] + 1 ELSE 1000000 END) END))), line FROM osa WHERE i < len(g))
SELECT x AS a, y AS b, round(1 - line[len(q) + 1]::DOUBLE / greatest(len(g), len(q)), 6) AS score FROM osa WHERE i = len(g)"""
EDITED_SQL = """WITH RECURSIVE names AS (SELECT DISTINCT p_name AS a FROM part), pairs AS (SELECT a, substr(a, 2, 1) || substr(a, 1, 1) || substr(a, 4) AS b FROM names UNION ALL SELECT a, reverse(a) FROM names UNION ALL SELECT a, a FROM names),
lists AS (SELECT a AS x, b AS y, string_split(a, '') AS g, string_split(b, '') AS q FROM pairs)"""


def edited_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct part name (some 64 at any scale) against itself with its first letters swapped and the third left out, turned round, and as it is."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    a = F.col("a")
    return names.select("a", F.explode(F.array(F.concat(F.substring(a, 2, 1), F.substring(a, 1, 1), a.substr(F.lit(4), F.length(a))), F.reverse(a), a)).alias("b"))


@query(OSA_SQL.format(head=EDITED_SQL))
def leaf_osa_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_names(spark, sf_dir).select("a", "b", six(similarity("osa")(F.col("a"), F.col("b"))).alias("score"))


@query("SELECT o_orderkey AS k, round(CASE WHEN o_orderpriority = p THEN 1 ELSE jaro_similarity(o_orderpriority, p) END::DOUBLE, 6) AS score FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN substr(o_orderpriority, 2) ELSE o_orderpriority END AS p FROM orders)")
def leaf_jaro_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparator that leaves the JVM, computed once for each distinct pair of values and joined back."""
    from ..functions.strings import with_similarity

    pairs = c.order_pairs(spark, sf_dir).select("k", "g_prio", "p_prio")
    return with_similarity(pairs, "g_prio", "p_prio", "jaro", "score").select("k", six(F.col("score")).alias("score"))
