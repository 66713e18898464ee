"""All queries over the shared tables, by name, with their SQL: gold rows against deterministic perturbations of themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import leaf
from ..functions.rows import spread
from ..functions.strings import similarity, with_similarity
from ..operators import attribution, confidence, referential, repair, semantic, validate
from .columns import bag_score, ordered_score
from .engine import Aligner, corpus_rollup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


# Orders against their perturbation; the same expressions in both engines.

ORDER_PAIRS = [
    "o_orderkey AS k",
    "o_orderstatus AS g_status",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS p_status",
    "o_totalprice AS g_price",
    "o_totalprice * (CAST(1 AS DOUBLE) + CAST(o_orderkey % 7 - 3 AS DOUBLE) / CAST(100 AS DOUBLE)) AS p_price",
    "o_orderpriority AS g_prio",
    "CASE WHEN o_orderkey % 4 = 0 THEN substr(o_orderpriority, 2) ELSE o_orderpriority END AS p_prio",
    "o_custkey AS g_cust",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS p_cust",
]
PAIRS_SQL = f"WITH pairs AS (SELECT {', '.join(ORDER_PAIRS)} FROM orders)"
LEV = "CASE WHEN g_prio = p_prio THEN 1::DOUBLE ELSE 1 - levenshtein(g_prio, p_prio)::DOUBLE / greatest(length(g_prio), length(p_prio)) END"
S_STATUS = "CASE WHEN g_status = p_status THEN 1::DOUBLE ELSE 0::DOUBLE END"
S_PRICE = "CASE WHEN g_price = p_price THEN 1::DOUBLE ELSE greatest(0::DOUBLE, 1 - abs(g_price - p_price) / greatest(abs(g_price), abs(p_price))) END"
S_PRIO = f"CASE WHEN {LEV} < 0.5 THEN 0::DOUBLE ELSE {LEV} END"
S_CUST = "CASE WHEN g_cust IS NULL AND p_cust IS NULL THEN 1::DOUBLE WHEN g_cust IS NULL OR p_cust IS NULL THEN 0.5::DOUBLE WHEN g_cust = p_cust THEN 1::DOUBLE ELSE 0::DOUBLE END"
SCORED_SQL = f"{PAIRS_SQL}, scored AS (SELECT *, {S_STATUS} AS s_status, {S_PRICE} AS s_price, {S_PRIO} AS s_prio, {S_CUST} AS s_cust FROM pairs)"
TOTAL_SQL = "(s_status + 2 * s_price + s_prio + s_cust) / 5"

ORDER_SCHEMA = {
    "type": "object",
    "keyScore": "exact",
    "properties": {
        "status": {"type": "string", "score": "exact"},
        "price": {"type": "number", "score": "relative", "valueWeight": 2},
        "prio": {"type": "string", "score": "levenshtein", "threshold": 0.5},
        "cust": {"type": ["integer", "null"], "score": "exact", "nullScore": 0.5},
    },
}


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*ORDER_PAIRS)


def order_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda s: F.struct(*(F.col(f"{s}_{c}").alias(c) for c in ("status", "price", "prio", "cust")))
    return order_pairs(spark, sf_dir).select(F.col("k").alias("pair_id"), side("g").alias("gold"), side("p").alias("pred"))


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(F.col("pair_id").cast("long").alias("k"), *(c for c in df.columns if c != "pair_id"))


# Leaves.


@query(f"{PAIRS_SQL} SELECT k, CASE WHEN g_status = p_status THEN 1::DOUBLE ELSE 0::DOUBLE END AS score FROM pairs")
def leaf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_pairs(spark, sf_dir).select("k", leaf.exact(F.col("g_status"), F.col("p_status")).alias("score"))


@query(f"{PAIRS_SQL} SELECT k, CASE WHEN (g_price > 100000) = (p_price > 100000) THEN 1::DOUBLE ELSE 0::DOUBLE END AS score FROM pairs")
def leaf_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_pairs(spark, sf_dir).select("k", leaf.exact(F.col("g_price") > 100000, F.col("p_price") > 100000).alias("score"))


@query("SELECT p_partkey AS k, round(1 / (1 + abs(p_size - (p_size + p_partkey % 5 - 2)))::DOUBLE, 6) AS score FROM part")
def leaf_invdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), six(leaf.invdiff(F.col("p_size"), F.col("p_size") + F.col("p_partkey") % 5 - 2)).alias("score"))


@query(f"{PAIRS_SQL} SELECT k, round({S_PRICE}, 6) AS score FROM pairs")
def leaf_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_pairs(spark, sf_dir).select("k", six(leaf.relative(F.col("g_price"), F.col("p_price"))).alias("score"))


@query(f"{SCORED_SQL} SELECT k, s_cust AS score FROM scored")
def leaf_null_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = F.col("g_cust"), F.col("p_cust")
    return order_pairs(spark, sf_dir).select("k", leaf.null_aware(g, p, leaf.exact(g, p), 0.5).alias("score"))


@query(f"{SCORED_SQL} SELECT k, round(s_prio, 6) AS score FROM scored")
def leaf_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_pairs(spark, sf_dir).select("k", six(leaf.threshold(similarity("levenshtein")(F.col("g_prio"), F.col("p_prio")), 0.5)).alias("score"))


NAMES_SQL = """WITH changed AS (SELECT p_partkey AS k, p_name AS a, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN reverse(p_name) WHEN 2 THEN p_brand || ' ' || p_name
  WHEN 3 THEN replace(p_name, 'e', '') ELSE substring(p_name, 1 + p_size % 5) || lower(p_type) END AS b FROM part), pairs AS (SELECT DISTINCT a, b FROM changed)"""


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against a changed one: the same, reversed, longer, without a letter, and another's beginning and end."""
    name, turn = F.col("p_name"), F.col("p_partkey") % 5
    other = F.substring(name, 1 + F.col("p_size") % 5, F.length(name))
    changed = F.when(turn == 0, name).when(turn == 1, F.reverse(name)).when(turn == 2, F.concat_ws(" ", "p_brand", "p_name"))
    changed = changed.when(turn == 3, F.replace(name, F.lit("e"), F.lit(""))).otherwise(F.concat(other, F.lower("p_type")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), name.alias("a"), changed.alias("b"))


def _string_query(name: str, metric: str, sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return with_similarity(name_pairs(spark, sf_dir), "a", "b", metric, "score").select("k", "a", "b", six(F.col("score")).alias("score"))

    run.__name__ = name
    query(f"{NAMES_SQL} SELECT k, a, b, round((CASE WHEN a = b THEN 1 ELSE {sql} END)::DOUBLE, 6) AS score FROM changed" if sql else None)(run)


_string_query("leaf_levenshtein", "levenshtein", "1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))")
_string_query("leaf_jaro", "jaro", "jaro_similarity(a, b)")
_string_query("leaf_jaro_winkler", "jaro_winkler", "jaro_winkler_similarity(a, b)")
_string_query("leaf_damerau", "damerau_levenshtein", "1 - damerau_levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))")
_string_query("leaf_osa", "osa", None)

#: Longest common subsequence: a step a row of the programme; a row's cells are prefix maxima.
LCS_STEP = """SELECT {keys}, i + 1, list_transform(range(1, len(q) + 2), lambda j: CASE WHEN j = 1 THEN 0 ELSE
  list_max(list_transform(range(2, j + 1), lambda x: greatest(line[x], line[x - 1] + CASE WHEN g[i + 1] = q[x - 1] THEN 1 ELSE 0 END))) END), g, q
  FROM lcs WHERE i < len(g)"""


def _lcs_sql(source: str, keys: str) -> str:
    return f"""lcs AS (SELECT {keys}, 0 AS i, list_transform(range(0, len(q) + 1), lambda x: 0) AS line, g, q FROM {source}
  UNION ALL {LCS_STEP.format(keys=keys)}), longest AS (SELECT {keys}, line[len(q) + 1] AS n, len(g) AS a, len(q) AS b FROM lcs WHERE i = len(g))"""


LETTERS_SQL = NAMES_SQL.replace("WITH changed", "WITH RECURSIVE changed") + ", lists AS (SELECT a AS x, b AS y, string_split(a, '') AS g, string_split(b, '') AS q FROM pairs), " + _lcs_sql("lists", "x, y")
_string_query("leaf_indel", "indel", None)
_string_query("leaf_lcsseq", "lcsseq", None)
ORACLES["leaf_indel"] = LETTERS_SQL + " SELECT k, x AS a, y AS b, round((2 * n)::DOUBLE / (longest.a + longest.b), 6) AS score FROM longest JOIN changed c ON c.a = x AND c.b = y"
ORACLES["leaf_lcsseq"] = LETTERS_SQL + " SELECT k, x AS a, y AS b, round(n::DOUBLE / greatest(longest.a, longest.b), 6) AS score FROM longest JOIN changed c ON c.a = x AND c.b = y"


@query(None)
def leaf_context_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparator that sees its surroundings: a price counts as right where the statuses agree."""
    from ..operators.kernel import context_metric

    @context_metric(roots=False)
    def by_status(gold, pred, ctx):
        return 1.0 if ctx.gold_parent["status"] == ctx.pred_parent["status"] else 0.0

    schema = {**ORDER_SCHEMA, "properties": {**ORDER_SCHEMA["properties"], "price": {"type": "number", "score": "by_status"}}}
    scored = Aligner(schema, custom_metrics={"number": {"by_status": by_status}}).score(order_structs(spark, sf_dir))
    return _keyed(scored).withColumn("score", six(F.col("score")))


# Objects.


@query(f"{SCORED_SQL} SELECT k, round({TOTAL_SQL}, 6) AS score FROM scored")
def object_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(Aligner(ORDER_SCHEMA).score(order_structs(spark, sf_dir))).withColumn("score", six(F.col("score")))


PARTS_SQL = f"""{SCORED_SQL}, parts AS (
  SELECT k, '/status' AS path, s_status AS s, 0.2::DOUBLE AS w, 1 AS o FROM scored UNION ALL SELECT k, '/price', s_price, 0.4::DOUBLE, 2 FROM scored
  UNION ALL SELECT k, '/prio', s_prio, 0.2::DOUBLE, 3 FROM scored UNION ALL SELECT k, '/cust', s_cust, 0.2::DOUBLE, 4 FROM scored)"""


@query(f"""{PARTS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(w * (1 - s), 9) DESC, path) AS r FROM parts)
SELECT p.k, round({TOTAL_SQL}, 6) AS score, p.path AS worst_path, round(w * (1 - s), 6) AS contribution FROM ranked p JOIN scored USING (k) WHERE r = 1""")
def order_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's score and the leaf that costs most, in one projection: the schema is the plan, weights included."""
    rows = Aligner(ORDER_SCHEMA).worst(order_structs(spark, sf_dir))
    return _keyed(rows).select("k", six(F.col("score")).alias("score"), "worst_path", six(F.col("contribution")).alias("contribution"))


KEYS = {**ORDER_SCHEMA, "keyImportance": 1.0, "valueImportance": 3.0}


@query(f"""{SCORED_SQL} SELECT k, round(CASE WHEN k % 13 = 0 THEN (3::DOUBLE / 4 + 3 * (s_status + 2 * s_price + s_cust) / 5) / 4 ELSE (1 + 3 * {TOTAL_SQL}) / 4 END, 6) AS score FROM scored""")
def object_key_value_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys count too, and every thirteenth prediction lacks one: rows of one shape each, so that presence is part of the type."""
    pairs = order_structs(spark, sf_dir)
    lacking = pairs.where("pair_id % 13 = 0").withColumn("pred", F.col("pred").dropFields("prio"))
    aligner = Aligner(KEYS)
    return _keyed(aligner.score(pairs.where("pair_id % 13 <> 0")).union(aligner.score(lacking))).withColumn("score", six(F.col("score")))


FUZZY = {"type": "object", "keyScore": "jaro", "keyThreshold": 0.5, "keyImportance": 1, "valueImportance": 1, "properties": {"c_name": {"type": "string", "score": "jaro"}, "c_acctbal": {"type": "number", "score": "relative"}}}


@query("""WITH pairs AS (SELECT c_custkey AS k, c_name, s_name, c_acctbal, s_acctbal FROM customer JOIN supplier ON s_suppkey = c_custkey % 10 + 1),
scored AS (SELECT k, jaro_similarity('c_name', 's_name') AS kn, jaro_similarity('c_acctbal', 's_acctbal') AS kb, CASE WHEN c_name = s_name THEN 1::DOUBLE ELSE jaro_similarity(c_name, s_name) END AS vn,
  CASE WHEN c_acctbal = s_acctbal THEN 1::DOUBLE ELSE greatest(0::DOUBLE, 1 - abs(c_acctbal - s_acctbal) / greatest(abs(c_acctbal), abs(s_acctbal))) END AS vb FROM pairs)
SELECT k, round((kn + kb) / 4 + (vn + vb) / 4, 6) AS score FROM scored""")
def object_fuzzy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against suppliers, whose keys are spelt otherwise."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    pairs = c.join(s, F.col("s_suppkey") == F.col("c_custkey") % 10 + 1).select(F.col("c_custkey").alias("pair_id"), F.struct("c_name", "c_acctbal").alias("gold"), F.struct("s_name", "s_acctbal").alias("pred"))
    return _keyed(Aligner(FUZZY, skip_validation=True).score(pairs)).withColumn("score", six(F.col("score")))


# Lists.

ITEM_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
LISTS_SQL = f"""WITH RECURSIVE items AS (SELECT l_orderkey AS k, list(l_quantity ORDER BY {ITEM_ORDER}) AS g,
  list(l_quantity + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END ORDER BY {ITEM_ORDER}) FILTER (WHERE l_partkey % 5 <> 0) AS q FROM lineitem GROUP BY l_orderkey),
lists AS (SELECT k, g, coalesce(q, []) AS q FROM items),
bags AS (SELECT l_orderkey AS k, list(l_partkey % 5) AS g, list(l_suppkey % 5) AS q FROM lineitem GROUP BY l_orderkey),
marks AS (SELECT l_orderkey AS k, list(l_partkey % 4 ORDER BY {ITEM_ORDER}) AS g, list(l_suppkey % 4 ORDER BY {ITEM_ORDER}) AS q FROM lineitem GROUP BY l_orderkey)"""


def _sorted_list(value: Column, keep: Column | None = None) -> Column:
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", value.alias("v"))
    return F.transform(F.sort_array(F.collect_list(row if keep is None else F.when(keep, row))), lambda x: x["v"])


def item_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of each order's items, against those with a fifth dropped and a seventh raised by one."""
    items = table(spark, sf_dir, "lineitem")
    raised = F.col("l_quantity") + F.when(F.col("l_partkey") % 7 == 0, 1.0).otherwise(0.0)
    return items.groupBy(F.col("l_orderkey").alias("k")).agg(_sorted_list(F.col("l_quantity")).alias("g"), _sorted_list(raised, F.col("l_partkey") % 5 != 0).alias("p"))


def item_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.col("l_partkey") % 5).alias("g"), F.collect_list(F.col("l_suppkey") % 5).alias("p"))


def _lists(df: DataFrame, schema: dict) -> DataFrame:
    return _keyed(Aligner(schema).score(df.select(F.col("k").alias("pair_id"), F.col("g").alias("gold"), F.col("p").alias("pred")))).withColumn("score", six(F.col("score")))


def _place(i: int) -> str:
    return f"CASE WHEN len(g) >= {i} AND len(q) >= {i} THEN 1 / (1 + abs(g[{i}] - q[{i}])) ELSE 0 END"


FIRST_SQL = f"CASE WHEN len(g) + len(q) = 0 THEN 1 ELSE (3 * {_place(1)} + {_place(2)}) / (3 + CASE WHEN len(g) >= 2 OR len(q) >= 2 THEN 1 ELSE 0 END) END"
NUMBER = {"type": "number"}


@query(f"{LISTS_SQL} SELECT k, round(({FIRST_SQL})::DOUBLE, 6) AS score FROM lists")
def list_prefix_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(item_lists(spark, sf_dir), {"type": "array", "prefixItems": [NUMBER, NUMBER], "prefixWeights": [3, 1]})


REST_SQL = """rest AS (SELECT k, g[3:] AS g, q[3:] AS q FROM lists), counted AS (SELECT k, len(g) AS a, len(q) AS b,
  coalesce(list_sum(list_transform(list_distinct(g), lambda v: least(len(list_filter(g, lambda x: x = v)), len(list_filter(q, lambda x: x = v))))), 0) AS n FROM rest)"""


@query(f"{LISTS_SQL}, {REST_SQL} SELECT k, round((3 * ({FIRST_SQL}) + CASE WHEN a + b = 0 THEN 1 ELSE n / (a + b - n) END)::DOUBLE / 4, 6) AS score FROM lists JOIN counted USING (k)")
def list_prefix_plus_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(item_lists(spark, sf_dir), {"type": "array", "prefixItems": [NUMBER, NUMBER], "prefixWeights": [3, 1], "items": {"type": "number", "score": "exact"}, "order": "align", "prefixImportance": 3, "restImportance": 1})


BAG_SQL = f"""{LISTS_SQL}, counted AS (SELECT k, len(g) AS a, len(q) AS b,
  list_sum(list_transform(list_distinct(g), lambda v: least(len(list_filter(g, lambda x: x = v)), len(list_filter(q, lambda x: x = v))))) AS n FROM bags)"""
BAG = {"type": "array", "order": "align", "items": {"type": "integer", "score": "exact"}}


@query(f"{BAG_SQL} SELECT k, round(n::DOUBLE / (a + b - n), 6) AS score FROM counted")
def list_bag_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(item_bags(spark, sf_dir), BAG)


@query(f"{BAG_SQL} SELECT k, round(n::DOUBLE / a, 6) AS score FROM counted")
def list_bag_ignore_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(item_bags(spark, sf_dir), BAG | {"ignoreExcess": True})


@query(f"{BAG_SQL} SELECT k, round(n::DOUBLE / b, 6) AS score FROM counted")
def list_bag_ignore_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(item_bags(spark, sf_dir), BAG | {"ignoreMissing": True})


@query(f"{LISTS_SQL}, {_lcs_sql('marks', 'k')} SELECT k, round(n::DOUBLE / (a + b - n), 6) AS score FROM longest")
def list_ordered_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(_sorted_list(F.col("l_partkey") % 4).alias("g"), _sorted_list(F.col("l_suppkey") % 4).alias("p"))
    return _lists(items, {"type": "array", "items": {"type": "integer", "score": "exact"}})


@query(None)
def list_ordered_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(item_lists(spark, sf_dir), {"type": "array", "items": NUMBER})


ALIGN = {"type": "array", "order": "align", "items": NUMBER}


def _align_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_quantity").alias("g"), F.collect_list((F.col("l_quantity") * 2) % 7).alias("p"))


#: Best total of each set of taken items after the first i items, for all orders: every pairing is weighed.
PAIRINGS_SQL = """WITH RECURSIVE items AS (SELECT l_orderkey AS k, list(l_quantity) AS g, list((l_quantity * 2) % 7) AS q FROM lineitem GROUP BY l_orderkey),
best AS (SELECT k, 0 AS i, 0::BIGINT AS taken, 0::DOUBLE AS total, g, q FROM items
  UNION ALL SELECT k, i + 1, taken + (1::BIGINT << j), max(total + 1 / (1 + abs(g[i + 1] - q[j + 1]))), any_value(g), any_value(q)
  FROM (SELECT *, unnest(range(len(q))) AS j FROM best WHERE i < len(g)) WHERE (taken >> j) % 2 = 0 GROUP BY k, i, taken + (1::BIGINT << j))"""


@query(f"{PAIRINGS_SQL} SELECT k, round(total / len(g), 6) AS score FROM best WHERE i = len(g)")
def list_align_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimal pairing by likeness of the items of all orders."""
    return _lists(_align_items(spark, sf_dir), ALIGN)


EVENTS_SQL = """WITH RECURSIVE lists AS (SELECT user_id AS k, coalesce(list(event_type ORDER BY ts, event_id) FILTER (WHERE event_id % 2 = 0), []) AS g,
  coalesce(list(event_type ORDER BY ts, event_id) FILTER (WHERE event_id % 2 = 1), []) AS q FROM events GROUP BY user_id)"""


@query(f"{EVENTS_SQL}, {_lcs_sql('lists', 'k')} SELECT k, round(CASE WHEN a + b = 0 THEN 1::DOUBLE ELSE n::DOUBLE / (a + b - n) END, 6) AS score FROM longest")
def event_sequence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's even events against the odd ones, in order."""
    half = lambda r: F.transform(F.sort_array(F.collect_list(F.when(F.col("event_id") % 2 == r, F.struct("ts", "event_id", "event_type")))), lambda x: x["event_type"])
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(half(0).alias("g"), half(1).alias("p"))
    return users.select(F.col("user_id").alias("k"), six(ordered_score(F.col("g"), F.col("p"))).alias("score"))


NESTED = {
    "type": "object",
    "keyScore": "exact",
    "properties": {"order": {**ORDER_SCHEMA, "valueWeight": 2}, "items": {"type": "array", "order": "align", "items": {"type": "integer", "score": "exact"}}},
}


@query(f"""{SCORED_SQL}, bags AS (SELECT l_orderkey AS k, list(l_partkey % 5) AS g, list(l_suppkey % 5) AS q FROM lineitem GROUP BY l_orderkey), counted AS (SELECT k, len(g) AS a, len(q) AS b,
  list_sum(list_transform(list_distinct(g), lambda v: least(len(list_filter(g, lambda x: x = v)), len(list_filter(q, lambda x: x = v))))) AS n FROM bags)
SELECT k, round((2 * {TOTAL_SQL} + n::DOUBLE / (a + b - n)) / 3, 6) AS score FROM scored JOIN counted USING (k)""")
def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their items in one document."""
    pairs = order_structs(spark, sf_dir).join(item_bags(spark, sf_dir), F.col("pair_id") == F.col("k"))
    both = pairs.select("pair_id", F.struct(F.col("gold").alias("order"), F.col("g").alias("items")).alias("gold"), F.struct(F.col("pred").alias("order"), F.col("p").alias("items")).alias("pred"))
    return _keyed(Aligner(NESTED).score(both)).withColumn("score", six(F.col("score")))


# Attribution, repair, feedback, description.


def _order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Aligner(ORDER_SCHEMA, skip_validation=True).nodes(order_structs(spark, sf_dir))


@query(f"{PARTS_SQL} SELECT k, path, round(s, 6) AS score, w AS weight, round(w * (1 - s), 6) AS contribution, row_number() OVER (PARTITION BY k ORDER BY w * (1 - s) DESC, o)::INTEGER AS rank FROM parts")
def attribution_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attribution.attribution(_order_nodes(spark, sf_dir))
    return _keyed(rows.select("pair_id", "path", six(F.col("score")).alias("score"), "weight", six(F.col("contribution")).alias("contribution"), "rank"))


@query(f"{SCORED_SQL} SELECT k, '/' AS path, round({TOTAL_SQL}, 6) AS score, round(1 - {TOTAL_SQL}, 6) AS contribution FROM scored")
def attribution_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attribution.attribution(_order_nodes(spark, sf_dir), "subtree")
    return _keyed(rows.select("pair_id", "path", six(F.col("score")).alias("score"), six(F.col("contribution")).alias("contribution")))


@query(f"{SCORED_SQL} SELECT k, round({TOTAL_SQL}, 6) AS score, round(1 - {TOTAL_SQL}, 6) AS explained, 0::DOUBLE AS residual FROM scored")
def attribution_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attribution.attribution_summary(_order_nodes(spark, sf_dir))
    return _keyed(rows.select("pair_id", six(F.col("score")).alias("score"), six(F.col("explained")).alias("explained"), (F.round("residual", 6) + F.lit(0.0)).alias("residual")))


OPS_SQL = f"""{PARTS_SQL}, ops AS (SELECT p.k, path, o, w * (1 - s) AS delta, CASE WHEN path = '/cust' AND (g_cust IS NULL OR p_cust IS NULL) THEN 'null_value_replace' ELSE 'primitive_replace' END AS kind
  FROM parts p JOIN scored USING (k) WHERE s < 1), ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY delta DESC, path) AS rank FROM ops)"""


@query(f"{OPS_SQL} SELECT k, rank::INTEGER AS rank, 'replace' AS op, kind, path, round(delta, 6) AS score_delta FROM ranked")
def repair_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.repairs(_order_nodes(spark, sf_dir))
    return _keyed(rows.select("pair_id", "rank", "op", "kind", "path", six(F.col("score_delta")).alias("score_delta")))


@query(f"{OPS_SQL}, kept AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank) AS seq FROM ranked WHERE delta >= 0.01) SELECT k, seq::INTEGER AS rank, kind, path, round(delta, 6) AS score_delta FROM kept WHERE seq <= 2")
def repair_ranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest repairs of at least a hundredth: a top-k report."""
    from ..operators.feedback import feedback_entries

    rows = feedback_entries(repair.repairs(_order_nodes(spark, sf_dir)), top_k=2, min_score_delta=0.01)
    return _keyed(rows.select("pair_id", "rank", F.col("op_kind").alias("kind"), "path", six(F.col("score_delta")).alias("score_delta")))


@query(f"{OPS_SQL} SELECT k, kind, round(sum(delta), 6) AS delta FROM ops GROUP BY k, kind")
def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(repair.error_breakdown(repair.repairs(_order_nodes(spark, sf_dir)))).withColumn("delta", six(F.col("delta")))


def _fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, F.col("s_suppkey") == F.col("c_custkey") % 10 + 1).select(F.col("c_custkey").alias("pair_id"), F.struct("c_name", "c_acctbal").alias("gold"), F.struct("s_name", "s_acctbal").alias("pred"))


@query("""SELECT c_custkey AS k, op, kind, path FROM customer JOIN supplier ON s_suppkey = c_custkey % 10 + 1, (VALUES ('remove', 'key_rename_remove', '/s_name'), ('add', 'key_rename_add', '/c_name'), ('remove', 'key_rename_remove', '/s_acctbal'), ('add', 'key_rename_add', '/c_acctbal')) AS o(op, kind, path)""")
def repair_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.repairs(Aligner(FUZZY, skip_validation=True).nodes(_fuzzy_pairs(spark, sf_dir)))
    return _keyed(rows.select("pair_id", "op", "kind", "path"))


@query(f"{SCORED_SQL} SELECT k, 1::DOUBLE AS score FROM scored")
def repair_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repairs applied: every repaired prediction equals its gold."""
    from ..operators.nodes import with_json

    aligner = Aligner(ORDER_SCHEMA, skip_validation=True)
    pairs = order_structs(spark, sf_dir)
    fixed = aligner.apply(with_json(pairs), aligner.repair(aligner.nodes(pairs)), "_gold")
    return _keyed(aligner.score(fixed.select("pair_id", F.col("_gold").alias("gold"), F.col("repaired").alias("pred")), dealt=True))


@query(None)
def feedback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligner = Aligner(ORDER_SCHEMA, skip_validation=True)
    return _keyed(aligner.feedback(aligner.nodes(order_structs(spark, sf_dir)), top_k=3))


@query(None)
def describe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligner = Aligner(ORDER_SCHEMA, skip_validation=True)
    return _keyed(aligner.describe(aligner.nodes(order_structs(spark, sf_dir))))


# Records that refer to one another.


@query("""WITH defs AS (SELECT c_nationkey AS nation, c_custkey AS id FROM customer UNION ALL SELECT c_nationkey, c_custkey FROM customer WHERE c_custkey % 50 = 0),
refs AS (SELECT c_nationkey AS nation, CASE WHEN o_orderkey % 17 = 0 THEN -o_custkey ELSE o_custkey END AS id FROM orders JOIN customer ON o_custkey = c_custkey),
double AS (SELECT nation, count(*) AS n_double FROM (SELECT nation, id FROM defs GROUP BY ALL HAVING count(*) > 1) GROUP BY nation),
lost AS (SELECT nation, count(*) AS n_dangling FROM refs WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.nation = refs.nation AND d.id = refs.id) GROUP BY nation)
SELECT n_nationkey AS nation, coalesce(n_double, 0) AS n_double, coalesce(n_dangling, 0) AS n_dangling FROM nation LEFT JOIN double ON double.nation = n_nationkey LEFT JOIN lost ON lost.nation = n_nationkey""")
def ref_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a nation: customers are defined (some twice), orders refer to them (some to none)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))
    defs = c.union(c.where("id % 50 = 0"))
    refs = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("id")).select("nation", F.when(F.col("o_orderkey") % 17 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("id"))
    double = referential.duplicate_ids(defs, ["nation"]).groupBy("nation").agg(F.count(F.lit(1)).alias("n_double"))
    lost = referential.dangling_refs(refs, defs, ["nation"]).groupBy("nation").agg(F.count(F.lit(1)).alias("n_dangling"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    return nations.join(double, "nation", "left").join(lost, "nation", "left").fillna(0)


def _gold_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def _pred_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold_defs(spark, sf_dir).where("id % 19 <> 0").withColumn("id", F.col("id") * 7 + 13)


@query("SELECT c_nationkey AS nation, c_custkey AS gold_id, CASE WHEN c_custkey % 19 <> 0 THEN c_custkey * 7 + 13 END AS pred_id FROM customer")
def id_bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referential.bijection(_gold_defs(spark, sf_dir), _pred_defs(spark, sf_dir), ["nation"], ["name"])


@query("""SELECT o_orderkey AS k, (CASE WHEN o_custkey % 19 <> 0 AND o_orderkey % 17 <> 0 THEN 1 ELSE 0 END)::DOUBLE AS score, CASE WHEN o_custkey % 19 <> 0 THEN o_custkey * 7 + 13 END AS mapped_pred FROM orders""")
def ref_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' references under the renumbering, one in seventeen redirected."""
    gold, pred = _gold_defs(spark, sf_dir), _pred_defs(spark, sf_dir)
    refs = table(spark, sf_dir, "orders").join(gold, F.col("o_custkey") == F.col("id")).select("nation", F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("gold_ref"), (F.col("o_custkey") * 7 + 13 + F.when(F.col("o_orderkey") % 17 == 0, 7).otherwise(0)).alias("pred_ref"))
    return referential.score_refs(refs, referential.bijection(gold, pred, ["nation"], ["name"]), pred, ["nation"]).select("k", "score", "mapped_pred")


@query("""WITH edges AS (SELECT o_custkey % 23 AS g, o_custkey AS src, o_custkey + 23 AS dst FROM orders GROUP BY ALL), vs AS (SELECT g, src AS v FROM edges UNION SELECT g, dst FROM edges),
near AS (SELECT g, src AS v, dst AS u, 'o' AS d FROM edges UNION ALL SELECT g, dst, src, 'i' FROM edges),
one AS (SELECT vs.g, vs.v, coalesce(string_agg(d, '' ORDER BY d), '') AS c FROM vs LEFT JOIN near USING (g, v) GROUP BY ALL),
two AS (SELECT one.g, one.v, one.c || '|' || coalesce(string_agg(d || x.c, ',' ORDER BY d || x.c), '') AS c FROM one LEFT JOIN near USING (g, v) LEFT JOIN one x ON x.g = near.g AND x.v = near.u GROUP BY one.g, one.v, one.c)
SELECT g, class_size, count(*) AS n_classes FROM (SELECT g, c, count(*) AS class_size FROM two GROUP BY g, c) GROUP BY g, class_size""")
def wl_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of colours on graphs of customers with orders, each linked to the next of its class."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 23).alias("g"), F.col("o_custkey").alias("src"), (F.col("o_custkey") + 23).alias("dst")).distinct()
    edges = o.select("g", "src", "dst", F.lit("next").alias("role"), F.lit("").alias("label"))
    vertices = o.select("g", F.explode(F.array("src", "dst")).alias("vertex")).distinct()
    return referential.color_classes(referential.wl_colors(edges, vertices, ["g"], 2), ["g"])


@query("SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def ambiguity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return referential.ambiguous_records(c, ["nation"], ["segment"])


# Confidence.

SIMS_SQL = f"""WITH numbered AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ITEM_ORDER}) AS i, l_quantity AS q FROM lineitem),
sims AS (SELECT a.k, a.i::INTEGER AS i, b.i::INTEGER AS j, 1 / (1 + abs(a.q - (b.q * 2) % 11)) AS score FROM numbered a JOIN numbered b ON a.k = b.k)"""


def _sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of each order's items with changed ones: cells are made after the exchange of the items, so its parts' number is given, not left to their bytes."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    items = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"), "l_orderkey")
    rows = items.select(F.col("l_orderkey").alias("k"), F.row_number().over(w).alias("i"), F.col("l_quantity").alias("q"))
    lists = rows.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("x"))
    cells = lists.select("k", "x", F.explode("x").alias("a")).select("k", "a", F.explode("x").alias("b"))
    return cells.select("k", F.col("a.i").alias("i"), F.col("b.i").alias("j"), leaf.invdiff(F.col("a.q"), (F.col("b.q") * 2) % 11).alias("score"))


@query(f"""{SIMS_SQL} SELECT s.k, s.i, s.j, round(greatest(0::DOUBLE, least(1::DOUBLE, s.score - coalesce(max(o.score), 0))), 6) AS confidence
FROM sims s LEFT JOIN sims o ON o.k = s.k AND ((o.i = s.i AND o.j <> s.j) OR (o.j = s.j AND o.i <> s.i)) GROUP BY s.k, s.i, s.j, s.score""")
def confidence_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence.margin_confidence(_sims(spark, sf_dir), ["k"]).select("k", "i", "j", six(F.col("confidence")).alias("confidence"))


@query(f"""{SIMS_SQL}, w AS (SELECT k, i, exp(8 * (score - max(score) OVER (PARTITION BY k, i))) AS w FROM sims), p AS (SELECT k, i, w / sum(w) OVER (PARTITION BY k, i) AS p FROM w)
SELECT k, i, round(CASE WHEN count(*) < 2 THEN 1::DOUBLE ELSE greatest(0::DOUBLE, 1 - sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(count(*))) END, 6) AS confidence FROM p GROUP BY k, i""")
def confidence_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence.entropy_confidence(_sims(spark, sf_dir), ["k"]).select("k", "i", six(F.col("confidence")).alias("confidence"))


# Embeddings.

VECTORS_SQL = "WITH pairs AS (SELECT vec_id AS k, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), cosines AS (SELECT k, list_cosine_similarity(a, b) AS c FROM pairs WHERE b IS NOT NULL)"


def _vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").alias("a"), F.lead("embedding").over(after).alias("b")).where("b IS NOT NULL")


@query(f"{VECTORS_SQL} SELECT k, round(greatest(0::DOUBLE, least(1::DOUBLE, c)), 6) AS score FROM cosines")
def semantic_cosine_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_pairs(spark, sf_dir).select("k", six(leaf.cosine(F.col("a"), F.col("b"))).alias("score"))


@query(f"{VECTORS_SQL} SELECT k, round((c + 1) / 2, 6) AS score FROM cosines")
def semantic_cosine_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_pairs(spark, sf_dir).select("k", six(leaf.cosine(F.col("a"), F.col("b"), "affine")).alias("score"))


@query("SELECT DISTINCT 'hash-mock' AS model_id, source AS text, 32::INTEGER AS dim FROM documents WHERE source IS NOT NULL")
def semantic_prewarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct source is embedded once."""
    return semantic.embed(table(spark, sf_dir, "documents"), semantic.HashEmbedder(), "source").select("model_id", "text", F.size("vec").alias("dim"))


# Corpora and validation.


@query(f"""{SCORED_SQL}, total AS (SELECT c_mktsegment AS segment, n_name AS nation, {TOTAL_SQL} AS score FROM scored JOIN customer ON c_custkey = g_cust JOIN nation ON n_nationkey = c_nationkey)
SELECT segment, nation, count(*) AS n, round(avg(score), 6) AS mean_score, round(min(score), 6) AS least_score FROM total GROUP BY ROLLUP (segment, nation)""")
def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = Aligner(ORDER_SCHEMA).score(order_structs(spark, sf_dir)).select(F.col("pair_id").cast("long").alias("k"), "score")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c_custkey"))
    about = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))
    out = corpus_rollup(scores.join(orders, "k").join(about, "c_custkey"), "segment", "nation")
    return out.select("segment", "nation", "n", six(F.col("mean_score")).alias("mean_score"), six(F.col("least_score")).alias("least_score"))


PROPS = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}
PROPS_SQL = "WITH texts AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN replace(props, '\"k\"', '\"j\"') WHEN 2 THEN '[1]' ELSE '{\"k\": \"x\"}' END AS props FROM events)"


@query(f"""{PROPS_SQL} SELECT event_id, CASE event_id % 4 WHEN 0 THEN true ELSE false END AS valid, CASE event_id % 4 WHEN 1 THEN '/' WHEN 2 THEN '/' WHEN 3 THEN '/k' END AS error_path FROM texts""")
def schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as they are, with another key, as a list, and with text for the number."""
    r = F.col("event_id") % 4
    text = F.when(r == 0, F.col("props")).when(r == 1, F.replace(F.col("props"), F.lit('"k"'), F.lit('"j"'))).when(r == 2, F.lit("[1]")).otherwise(F.lit('{"k": "x"}'))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("props"))
    return validate.json_errors(rows, "props", PROPS).select("event_id", "valid", "error_path")


@query(f"{BAG_SQL} SELECT k, n::INTEGER AS common FROM counted")
def list_bag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exploded form of the multiset intersection, for lists that are tables of their own."""
    items = table(spark, sf_dir, "lineitem")
    g = items.groupBy(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 5).alias("v")).agg(F.count(F.lit(1)).alias("a"))
    p = items.groupBy(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 5).alias("v")).agg(F.count(F.lit(1)).alias("b"))
    return g.join(p, ["k", "v"], "left").groupBy("k").agg(F.sum(F.least("a", F.coalesce("b", F.lit(0)))).cast("int").alias("common"))


from . import catalogue_documents, catalogue_paths  # noqa: E402, F401  their queries register themselves

__all__ = ["ORACLES", "QUERIES", "bag_score"]
