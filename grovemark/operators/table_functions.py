"""The alignment of JSON texts as a table function of SQL, for LATERAL use.

    SELECT p.pair_id, n.* FROM pairs p, LATERAL alignment_nodes(p.gold, p.pred, '{"type": "object", ...}') n

gives each pair's nodes; with the pair_id these rows are a node table, and ``attribution``, ``repairs`` and the texts take them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..plans.schema import compile_schema
from .kernel import Comparison
from .nodes import COLUMNS, NODES, invalid_row, node_rows
from .validate import first_error

assert COLUMNS[0] == "pair_id"  # rows leave it out


class AlignmentNodes:
    """alignment_nodes(gold, pred, schema): the node table of one pair of JSON texts. The schema must be a constant, and is
    checked when the query is analysed. A null text is the value null; a pred that breaks the schema or is no JSON has one
    row, a gold that does raises."""

    def __init__(self) -> None:
        self.plans: dict[str, tuple[dict, Comparison]] = {}

    @staticmethod
    def analyze(gold: AnalyzeArgument, pred: AnalyzeArgument, schema: AnalyzeArgument) -> AnalyzeResult:
        for name, argument in (("gold", gold), ("pred", pred)):
            if not isinstance(argument.dataType, (T.StringType, T.NullType)):
                raise ValueError(f"alignment_nodes: {name} must be JSON text, not {argument.dataType.simpleString()}")
        if not isinstance(schema.value, str):
            raise ValueError("alignment_nodes: the schema must be a constant text")
        compile_schema(json.loads(schema.value))
        kinds = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "double": T.DoubleType()}  # no session here to read them
        return AnalyzeResult(T.StructType([T.StructField(c, kinds[kind]) for c, kind in map(str.split, NODES.split(", ")) if c != "pair_id"]))

    def eval(self, gold: str | None, pred: str | None, schema: str) -> Iterator[tuple]:
        if schema not in self.plans:
            raw = json.loads(schema)
            self.plans[schema] = raw, Comparison(compile_schema(raw))
        raw, plan = self.plans[schema]
        mine = None if gold is None else json.loads(gold)
        if wrong := first_error(raw, mine):
            raise ValueError(f"gold breaks the schema at {wrong[0]}: {wrong[1]}")
        try:
            theirs = None if pred is None else json.loads(pred)
            wrong = first_error(raw, theirs)
        except ValueError:
            wrong = ("/", "not JSON")
        if wrong:
            yield invalid_row(None, wrong, gold, pred)[1:]
            return
        for row in node_rows(plan.compare(mine, theirs)[0]):
            yield row[1:]


def register(spark: SparkSession) -> None:
    """Makes ``alignment_nodes`` known to the session's SQL."""
    spark.udtf.register("alignment_nodes", udtf(AlignmentNodes))
