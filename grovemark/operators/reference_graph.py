"""The reference graph of JSON texts as tables, and its colours: documents of any size, since no document meets in one task.

A schema's identifiers and references are taken out of the texts as variants, a row each. References that one carrier holds (the
outermost object of a list that leads to them) join their records: one tags its record, two in different roles are an edge, any
other number meet in a vertex of their own. Colours are refined round by round until there are no more of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import Place
from ..plans.text import part, tag
from ..sources.stored import stored
from .kernel import Comparison, _carrier, _schema_at

EDGES = ["src", "dst", "role", "label"]


def _led(df: DataFrame, steps: tuple, value: str, place: str) -> DataFrame:
    """Rows of ``df`` with its variant column ``value`` replaced by what ``steps`` lead to, a row for each item of lists, whose indices
    are added to the text ``place``. What isn't there is left out."""
    for s in steps:
        if s == "*":
            items = F.try_variant_get(F.col(value), "$", "array<variant>")
            rest = [c for c in df.columns if c != value]
            df = df.select(*rest, F.posexplode(items).alias("_at", value)).withColumn(place, F.concat_ws("/", place, F.col("_at").cast("string"))).drop("_at")
        else:
            df = df.withColumn(value, part(F.col(value), s))
    return df.where(F.col(value).isNotNull())


def _documents(pairs: DataFrame, side: str) -> DataFrame:
    return pairs.select(F.col("pair_id").cast("string").alias("pair_id"), F.try_parse_json(side).alias("v"), F.lit("").alias("place"))


def definers(pairs: DataFrame, plan: Comparison, scope: str, side: str) -> DataFrame:
    """(pair_id, id, record): the records of a scope on one side ('gold' or 'pred'), id as JSON text, record a variant. Null identifiers are left out."""
    at: Place = plan.ids[scope]
    records = _led(_documents(pairs, side), at.record, "v", "place").withColumn("record", F.col("v"))
    return _led(records, at.steps[len(at.record) :], "v", "place").where(tag(F.col("v")) != "null").select("pair_id", F.to_json("v").alias("id"), "record")


def _scalars(node, record: Column) -> list[Column]:
    """A record's own comparable values, as texts: those that the schema calls string, integer, boolean or enumerated; null where there are none."""
    plain = [k for k, n in node.properties.items() if not n.id_scope and not n.ref and ("enum" in n.raw or n.raw.get("type") in ("string", "integer", "boolean"))]
    return [F.when(~tag(part(record, k)).isin("object", "array"), F.concat(F.lit(f"{k}="), F.to_json(part(record, k)))) for k in plain]


def _canonical(parts: list[Column]) -> Column:
    return F.array_join(F.sort_array(F.array_compact(F.array(*parts, F.lit(None).cast("string")))), "|") if parts else F.lit("")


def labels(plan: Comparison, scope: str, record: Column) -> Column:
    """What a scope's record says of itself: the seed of its colour where graph and likeness are blended."""
    return _canonical(_scalars(_schema_at(plan.schema, plan.ids[scope].record), record))


def reference_ends(pairs: DataFrame, plan: Comparison, scope: str, side: str, mapped: DataFrame | None = None) -> DataFrame:
    """(pair_id, carrier, role, id, label): a row for each reference to a scope, with its carrier and what the carrier says.

    ``mapped`` (pair_id, scope, gold_id, pred_id: JSON texts): identifiers of scopes that are paired already; references that the
    carrier holds to these are part of its label, those of gold by their counterparts.
    """
    groups: dict[tuple, list[tuple]] = {}
    for ref in plan.refs:
        if ref.scope == scope:
            depth = _carrier(plan, ref)
            groups.setdefault(ref.steps[:depth], []).append(ref.steps[depth:])
    out: DataFrame | None = None
    for k, (at, roles) in enumerate(groups.items()):
        carriers = _led(_documents(pairs, side), at, "v", "place").withColumn("carrier", F.concat(F.lit(f"{k}:"), "place"))
        carriers = carriers.withColumn("label", _canonical(_scalars(_schema_at(plan.schema, at), F.col("v"))))
        others = [(r.scope, r.steps[len(at) :]) for r in plan.refs if r.scope != scope and len(r.steps) > len(at) and r.steps[: len(at)] == at]
        if mapped is not None and others:
            across: DataFrame | None = None
            for n, (other, steps) in enumerate(others):
                found = _led(carriers.select("pair_id", "carrier", "v", "place"), steps, "v", "place").select("pair_id", "carrier", F.lit(other).alias("scope"), F.lit(n).alias("n"), F.to_json("v").alias("gold_id"))
                across = found if across is None else across.unionByName(found)
            known = across.join(mapped.select("pair_id", "scope").distinct(), ["pair_id", "scope"], "left_semi")
            if side == "gold":
                known = known.join(mapped.select("pair_id", "scope", "gold_id", "pred_id"), ["pair_id", "scope", "gold_id"], "left").withColumn("to", F.coalesce("pred_id", F.lit("null")))
            else:
                known = known.withColumn("to", F.col("gold_id"))
            told = known.groupBy("pair_id", "carrier").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "scope", "n", "to"))), "|").alias("_across"))
            carriers = carriers.join(told, ["pair_id", "carrier"], "left").withColumn("label", F.concat_ws("|", "label", F.coalesce("_across", F.lit("")))).drop("_across")
        for role in roles:
            ends = _led(carriers, role, "v", "place").select("pair_id", "carrier", F.lit(repr(role)).alias("role"), F.to_json("v").alias("id"), "label")
            out = ends if out is None else out.unionByName(ends)
    return pairs.sparkSession.createDataFrame([], "pair_id string, carrier string, role string, id string, label string") if out is None else out


def reference_edges(ends: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, role, label) of ``ends`` (keys, carrier, role, id, label) whose id ``known`` (keys, id) has.

    Carriers are told apart by sums over their ends, so that one with a million members is combined before it is exchanged;
    vertices of carriers are named 'hub:' and the carrier.
    """
    own = ends.join(known.select(*keys, "id").distinct(), [*keys, "id"], "left_semi")
    end = F.struct("role", "id")
    sizes = own.groupBy(*keys, "carrier").agg(F.count(F.lit(1)).alias("n"), F.min(end).alias("a"), F.max(end).alias("b"), F.first("label").alias("label"))
    two = (F.col("n") == 2) & (F.col("a.role") != F.col("b.role"))
    small = sizes.where((F.col("n") == 1) | two).select(*keys, F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.when(F.col("n") == 1, F.concat(F.lit("one "), F.col("a.role"))).otherwise(F.concat_ws(" ", F.lit("edge"), "a.role", "b.role")).alias("role"), "label")
    large = sizes.where((F.col("n") > 1) & ~two).select(*keys, "carrier")
    members = own.join(large, [*keys, "carrier"]).select(*keys, F.col("id").alias("src"), F.concat(F.lit("hub:"), "carrier").alias("dst"), F.concat(F.lit("member "), "role").alias("role"), "label")
    return small.unionByName(members)


def refined(edges: DataFrame, vertices: DataFrame, keys: list[str], rounds: int | None = None, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(keys, vertex, color) once refining finds no more colours, or after ``rounds``; equal over all graphs that are refined together.

    vertices: (keys, vertex, seed); ends of edges that it lacks have the seed ''. A colour is the hash of the one before and of sums of
    hashes over the edges around, which are the same in any order. Each round's table is stored, and the number of its colours compared
    with that before; at most as many rounds as the largest graph has vertices.

    Vertices are numbered once, so that rounds handle numbers alone, and join once: the colour before comes by an edge of its own.
    """
    said = lambda way: F.xxhash64(F.lit(way), "role", "label")
    edges = store(edges.select(*keys, "src", "dst", said("out").alias("_out"), said("in").alias("_in")))
    ends = [edges.select(*keys, F.col(end).alias("vertex"), F.lit("").alias("seed")) for end in ("src", "dst")]
    known = vertices.select(*keys, "vertex", F.coalesce("seed", F.lit("")).alias("seed")).unionByName(ends[0]).unionByName(ends[1])
    named = store(known.groupBy(*keys, "vertex").agg(F.max("seed").alias("seed")).withColumn("id", F.monotonically_increasing_id()))
    most = rounds if rounds is not None else named.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    both = edges
    for end in ("src", "dst"):
        both = both.join(named.select(*keys, F.col("vertex").alias(end), F.col("id").alias(f"_{end}")), [*keys, end])
    way = lambda a, b, e: F.struct(F.col(a).alias("vertex"), F.col(b).alias("near"), F.col(e).alias("_e"))
    both = both.select(F.inline(F.array(way("_src", "_dst", "_out"), way("_dst", "_src", "_in"))))
    # a vertex is near itself, by an edge that says nothing: it brings the colour before
    both = store(both.unionByName(named.select(F.col("id").alias("vertex"), F.col("id").alias("near"), F.lit(None).cast("long").alias("_e"))))
    colors = store(named.select("id", F.xxhash64("seed").alias("color")))
    count = lambda c: c.agg(F.count_distinct("color")).first()[0]
    found = count(colors)
    # sums of halves can't overflow
    half = lambda k: (F.xxhash64("_m", F.lit(k)).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(F.xxhash64("_m", F.lit(k)), 32))
    sums = [F.sum(h).alias(f"_{k}{n}") for k in (1, 2) for n, h in enumerate(half(k))]
    for _ in range(most):
        seen = both.join(colors, F.col("near") == F.col("id"))
        seen = seen.select("vertex", F.when(F.col("_e").isNull(), F.col("color")).alias("_own"), F.when(F.col("_e").isNotNull(), F.xxhash64("_e", "color")).alias("_m"))
        around = seen.groupBy("vertex").agg(F.max("_own").alias("_own"), F.count("_m").alias("_n"), *sums)
        new = store(around.select(F.col("vertex").alias("id"), F.xxhash64("_own", "_n", "_10", "_11", "_20", "_21").alias("color")))
        more = count(new)
        if more == found:
            break
        colors, found = new, more
    return named.join(colors, "id").select(*keys, "vertex", "color")


def graph_colors(pairs: DataFrame, plan: Comparison, scope: str, mapped: DataFrame | None = None, blend: bool = False, rounds: int | None = None) -> DataFrame:
    """(pair_id, side, id, color) of a scope's records in both texts of each pair, refined together: equal colours, equal surroundings.

    blend: records start from what they say of themselves, not all alike. A pair whose texts lack the scope has no rows; null ids
    have none; an id that a text defines twice has one.
    """
    edges, vertices = None, None
    for side in ("gold", "pred"):
        records = definers(pairs, plan, scope, side)
        own = records.groupBy("pair_id", "id").agg(F.min(labels(plan, scope, F.col("record")) if blend else F.lit("")).alias("seed"))
        links = reference_edges(reference_ends(pairs, plan, scope, side, mapped), own, ["pair_id"]).withColumn("side", F.lit(side))
        own = own.select("pair_id", F.lit(side).alias("side"), F.col("id").alias("vertex"), "seed")
        edges, vertices = (links, own) if edges is None else (edges.unionByName(links), vertices.unionByName(own))
    colors = refined(edges, vertices, ["pair_id", "side"], rounds)
    return colors.where(~F.col("vertex").startswith("hub:")).withColumnRenamed("vertex", "id")
