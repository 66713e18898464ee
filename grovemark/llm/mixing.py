"""Mixing sources to target weights by Poisson replication.

Every source gets a repetition rate: the mass it should have in the mixture over the mass it has. A document's
number of copies is a Poisson draw with that mean, by inversion of a uniform number hashed from seed and doc_id
(for a rate above MAX_RATE the sum of several such draws, each with a number of its own, which is Poisson too):
the same documents give the same mixture whatever the partitioning, and a lost task repeats its draws. Copies
are then ordered by a second hash over the whole corpus. The main path is DataFrame expressions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unit_draw

#: The largest rate of one draw: exp(-rate) underflows soon after. Larger rates are sums of draws of equal rates below it.
MAX_RATE = 500.0
#: Copies that one array lists.
CHUNK = 1000


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, size: float = 1.0) -> DataFrame:
    """One row per source: (source, n_docs, mass, target, rate). Mass is code points of text.

    ``weights`` are targets by source, normalised here; sources it lacks get rate 0. Without it, targets follow
    mass ** ``power`` (1: as found, 0: all alike). ``size``: mass of the mixture over mass of the input.
    The null source is a source of its own. A source of mass 0 keeps its documents once (rate 1).
    """
    by = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("mass"))
    if weights is None:
        want = F.when(F.col("mass") > 0, F.pow(F.col("mass").cast("double"), F.lit(float(power)))).otherwise(F.lit(0.0))
    else:
        want = F.lit(0.0)
        for name, w in weights.items():
            want = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(want)
    by = by.withColumn("want", want)
    whole = by.agg(F.sum("want").alias("all_want"), F.sum("mass").alias("all_mass"))
    rate = F.when(F.col("mass") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("want") * F.col("all_mass") * F.lit(float(size)), F.col("all_want") * F.col("mass")))
    rate = F.coalesce(rate, F.lit(0.0))
    return by.crossJoin(F.broadcast(whole)).select("source", "n_docs", "mass", F.try_divide("want", "all_want").alias("target"), rate.alias("rate"))  # whole: one row


def poisson_steps(rate: Column) -> Column:
    """Cumulative Poisson probabilities for 0, 1, ... up to where the rest is below 2**-53."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, size: float = 1.0, seed: int = 17, most_sources: int = 10_000) -> DataFrame:
    """All columns of ``docs``, then copy (int, from 1) and place (long): the mixture in order of place.

    Null or empty texts and null sources take part. Rows with equal doc_id (null included) draw alike; each is
    replicated on its own. Columns that are named copy or place in the input are replaced. An empty table gives
    an empty table. Any rate is drawn exactly; copy being an int, 2**31 copies of one row are an error. The rates' table is broadcast only while it has at most ``most_sources`` rows (of some 500 bytes);
    beyond that, documents meet it in a join that AQE may split where a source is hot.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE).cast("int"))
    rates = source_rates(docs, weights, power, size).select(F.col("source").alias("_source"), parts.alias("_parts"), poisson_steps(F.col("rate") / parts).alias("_cdf"))
    n_sources = docs.select("source").distinct().limit(most_sources + 1).count()
    rates = F.broadcast(rates) if n_sources <= most_sources else rates
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("copy", "place", "_source", "_parts", "_cdf", "_u", "_n", "_c")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    first = F.array(unit_draw(F.lit(str(seed)), key))
    draws = F.when(F.col("_parts") > 1, F.concat(first, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_parts") - 1)), lambda i: unit_draw(F.lit(str(seed)), i.cast("string"), key)))).otherwise(first)
    drawn = docs.join(rates, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_u", draws)
    copies = drawn.withColumn("_n", F.aggregate("_u", F.lit(0), lambda n, u: n + F.size(F.filter("_cdf", lambda c: c <= u)))).where("_n > 0")
    copies = copies.drop("_source", "_parts", "_cdf", "_u").withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK).cast("int"))))
    out = copies.withColumn("copy", F.explode(F.sequence(F.col("_c") * CHUNK + 1, F.least(F.col("_n"), F.lit(CHUNK) + F.col("_c") * CHUNK)))).drop("_n", "_c")
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed + 1)), key, F.col("copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    return out.withColumn("place", place).orderBy("place", "doc_id", "copy")


#: The same rows by DuckDB.
SQL = """
WITH RECURSIVE by_source AS (
  SELECT source, sum(coalesce(length(text), 0)) AS mass FROM documents GROUP BY source
), wanted AS (
  SELECT source, mass::DOUBLE AS mass, CASE WHEN mass > 0 THEN pow(mass::DOUBLE, 0.5::DOUBLE) ELSE 0::DOUBLE END AS want FROM by_source
), rates AS (
  SELECT source, CASE WHEN mass = 0 THEN 1::DOUBLE ELSE want * (sum(mass) OVER ()) * 1::DOUBLE / ((sum(want) OVER ()) * mass) END AS rate FROM wanted
), steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 24)
), cdfs AS (
  SELECT source, list(cdf) AS cdf FROM steps GROUP BY source
), drawn AS (
  SELECT d.*, ('0x' || md5('17:' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT / 4503599627370496::DOUBLE AS u, c.cdf
  FROM documents d JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source
), copies AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(1, len(list_filter(cdf, lambda x: x <= u)) + 1))::INTEGER AS copy FROM drawn
)
SELECT *, ('0x' || md5('18:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR)[1:15])::BIGINT AS place FROM copies
"""
