"""Node tables and validation by expressions against the kernel, on the same pairs as JSON text."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from grovemark.operators.nodes import with_json
from grovemark.plans import catalogue
from grovemark.plans.engine import Aligner

INNER = {"type": ["object", "null"], "keyScore": "exact", "nullScore": 0.25, "keyImportance": 1, "valueImportance": 2, "properties": {"u": {"type": "string", "score": "exact"}, "v": {"type": "number", "score": "relative"}}}
SCHEMA = {
    "type": "object", "keyImportance": 1, "valueImportance": 3, "keyThreshold": 0.4,
    "properties": {"name": {"type": "string", "score": "levenshtein"}, "size": {"type": ["integer", "null"], "nullScore": 0.5, "valueWeight": 2}, "part": {**INNER, "valueWeight": 3}, "a/b~c": {"type": "boolean"}},
}
GOLD = "struct<name:string,size:bigint,part:struct<u:string,v:double>,`a/b~c`:boolean,only:string>"
PRED = "struct<nam:string,size:bigint,part:struct<u:string,v:double,w:double>,`a/b~c`:boolean,other:double>"
ROWS = [
    (("Ann \"x\"", 3, ("k", 1.5), True, "o"), ("Anna", 4, ("k", 3.0, 0.0), True, 2.0)),
    (("Bob", None, None, None, None), ("Bob", 1, None, None, None)),
    (("Cyd", 7, ("a", 2.0), False, "é"), ("Dyd", None, None, True, 1.0)),
    (("Eve", 7, ("a", 2.0), False, "\n"), ("Eve", 7, (None, 2.0, None), False, None)),
]
STATIC = ["pair_id", "valid", "depth", "path", "part", "node_type", "kind", "parent_kind", "list_path", "at", "list_at", "is_leaf", "has_gold", "has_pred", "gold_key", "pred_key", "has_target"]
NUMBERS = ["total", "score", "weight", "confidence", "parent_confidence", "key_score", "key_weight", "key_confidence"]


def both(spark, rows, gold, pred):
    typed = spark.createDataFrame([(k, g, p) for k, (g, p) in enumerate(rows)], f"pair_id long, gold {gold}, pred {pred}")
    return typed, with_json(typed).select("pair_id", F.col("_gold").alias("gold"), F.col("_pred").alias("pred"))


@pytest.mark.parametrize("options", [{}, {"compute_confidence": True}, {"compute_confidence": True, "confidence_method": "entropy"}])
def test_rows_are_those_of_the_kernel(spark, options):
    aligner = Aligner(SCHEMA, skip_validation=True, **options)
    typed, text = both(spark, ROWS, GOLD, PRED)
    plan = aligner.nodes(typed)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Exchange" not in plan
    mine, theirs = (sorted(aligner.nodes(x).collect(), key=lambda r: (r.pair_id, r.node_id)) for x in (typed, text))
    assert len(mine) == len(theirs) > 30
    renames = []
    for a, b in zip(mine, theirs, strict=True):
        assert [a[c] for c in STATIC] == [b[c] for c in STATIC]
        assert [a[c] for c in NUMBERS] == pytest.approx([b[c] for c in NUMBERS])
        assert all((a[c] is None) == (b[c] is None) and (a[c] is None or json.loads(a[c]) == json.loads(b[c])) for c in ("gold", "pred"))
        renames.append((a.renamed is None) == (b.renamed is None))
    assert all(renames) and any(r.renamed is not None for r in mine)
    assert {r.pair_id: r.score for r in aligner.score(typed).collect()} == pytest.approx({r.pair_id: r.score for r in aligner.score(text).collect()})
    for ask in (lambda n: aligner.repair(n), lambda n: aligner.attribute(n)):
        got = [sorted((r.pair_id, r["rank"], r.path, round(r[c], 9)) for r in ask(aligner.nodes(x)).collect() for c in r.asDict() if c in ("score_delta", "contribution")) for x in (typed, text)]
        assert got[0] == got[1] and got[0]


def test_the_worst_leaf_is_that_of_the_attribution(spark):
    aligner = Aligner(SCHEMA, skip_validation=True)
    typed, text = both(spark, ROWS, GOLD, PRED)
    one, two = ({r.pair_id: (round(r.score, 9), r.worst_path, round(r.contribution, 9)) for r in aligner.worst(x).collect()} for x in (typed, text))
    assert one == two and len(one) == len(ROWS)


STRICT = {
    "type": "object", "required": ["a", "b"], "additionalProperties": False,
    "properties": {"a": {"type": "string", "enum": ["x", "y"]}, "b": {"type": "string"}, "n": {"type": ["integer", "null"]}, "f": {"type": "integer"}, "l": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string"}}},
}
KIND = "struct<a:string,b:string,n:bigint,f:double,l:array<string>>"
FINE = ("x", "s", 1, 2.0, ["p"])
WRONG = [("q", "s", 1, 2.0, ["p"]), ("x", None, 1, 2.0, ["p"]), ("x", "s", None, 2.5, ["p"]), ("x", "s", 1, 2.0, []), ("x", "s", 1, 2.0, ["p", "q", "r"]), ("x", "s", 1, 2.0, ["p", None]), ("y", "s", None, 3.0, ["p", "q"]), None]


def test_invalid_rows_are_told_alike_on_both_paths(spark):
    leaf = {"type": "object", "keyScore": "exact", "required": ["a", "b"], "properties": {k: STRICT["properties"][k] for k in ("a", "b", "n")}}
    for schema, cut in ((STRICT, 5), (leaf, 3)):
        aligner = Aligner(schema)
        kind = KIND if cut == 5 else "struct<a:string,b:string,n:bigint>"
        rows = [(FINE[:cut], None if w is None else w[:cut]) for w in WRONG]
        typed, text = both(spark, rows, kind, kind)
        assert {r.pair_id: r.score for r in aligner.score(typed).collect()} == pytest.approx({r.pair_id: r.score for r in aligner.score(text).collect()})
        one, two = ({r.pair_id: (r.valid, r.total, r.error_path) for r in aligner.nodes(x).where("parent_id IS NULL").collect()} for x in (typed, text))
        assert one == two and sum(not v[0] for v in one.values()) >= 3
        bad = typed.select("pair_id", F.col("pred").alias("gold"), "pred")
        for ask in (aligner.score, aligner.nodes, aligner.worst):
            with pytest.raises(Exception, match="breaks the schema"):
                ask(bad).collect()


def test_custom_comparators_stay_columns(spark):
    aligner = Aligner({"type": "object", "properties": {"n": {"type": "integer", "score": "half"}}}, custom_metrics={"number": {"half": lambda a, b: 1.0 if a == b else 0.5}})
    typed, text = both(spark, [((1,), (2,)), ((1,), (1,))], "struct<n:bigint>", "struct<n:bigint>")
    plan = aligner.score(typed)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Exchange" not in plan
    assert [r.score for r in aligner.score(typed).orderBy("pair_id").collect()] == [r.score for r in aligner.score(text).orderBy("pair_id").collect()] == [0.5, 1.0]
    wrong = Aligner({"type": "object", "properties": {"n": {"type": "integer", "score": "half"}}}, custom_metrics={"integer": {"half": lambda a, b: 7}})
    with pytest.raises(Exception, match="half"):
        wrong.score(typed).collect()


def test_unasked_columns_are_not_computed(spark):
    nodes = Aligner(catalogue.ORDER_SCHEMA, skip_validation=True).nodes(catalogue.order_structs(spark, "/root/testdata/sf0.001"))
    plan = nodes.select("pair_id", "path", "weight")._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan.lower() and "structstojson" not in plan.lower()
