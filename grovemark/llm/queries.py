"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, interpolation, inverted_index, lexical_search, license_scan, minhash, mixing, packing, quality, spelling, suffix_dedup, warc, wrapper_induction


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_factorisation_machine": lambda spark, sf_dir: quality.quality_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op2_window_packing": _over("documents", packing.packing_digest),
    "op3_poisson_mix": _over("documents", mixing.mix_sources),
    "op4_deleted_interpolation": _over("documents", interpolation.interpolated_scores),
    "op5_bbit_minhash": _over("documents", minhash.near_duplicate_digest),
    "op6_inverted_multi_index": _over("embeddings", inverted_index.near_vectors),
    "op7_suffix_merge": _over("documents", suffix_dedup.repeat_digest),
    "op8_warc_bundles": _over("pages", warc.warc_digest),
    "op9_bottom_k": _over("documents", fingerprint.fingerprint_digest),
    "op10_license_scan": _over("documents", license_scan.scan_licenses),
    "op11_levenshtein_tries": _over("documents", spelling.variants),
    "op12_wrapper_induction": _over("pages", wrapper_induction.extract),
    "op13_bit_sliced_search": lambda spark, sf_dir: lexical_search.search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
}

ORACLES: dict[str, str] = {
    "op3_poisson_mix": mixing.SQL,
    "op8_warc_bundles": warc.SQL,
    "op12_wrapper_induction": _over("pages", wrapper_induction.extract),
    "op13_bit_sliced_search": lexical_search.SQL,
}
