"""The stages of the pipeline, each against what it should leave."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from grovemark.llm import minhash, packing, quality
from test_corpus_operators import DOCS, removed_by_hand

SF = "/root/testdata/sf0.001"


def drawn(rows) -> Counter:
    """How often mixing repeats each document, by the inversion of a Poisson distribution."""
    mass = Counter()
    for r in rows:
        mass[r.source] += len(r.text or "")
    want = {s: math.sqrt(m) for s, m in mass.items()}
    out = Counter()
    for r in rows:
        rate = want[r.source] * sum(mass.values()) / (sum(want.values()) * mass[r.source]) if mass[r.source] else 0.0
        u = int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        p = cdf = math.exp(-rate)
        k = 0
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        out[r.doc_id] += k
    return +out


def test_stages_of_empty_and_odd_tables(spark, tmp_path):
    for n, rows in enumerate(([], [(None, None, "en", None, None, 0, "x"), (None, "a b c", "en", "s", 5, 0, "x"), (4, "", "en", "s", 0, 0, "x"), (4, "w " * 400, "en", "s", 800, 0, "x")])):
        docs = spark.createDataFrame(rows, DOCS)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}-{k}")
            after = spark.read.parquet(f"{tmp_path}/{n}-{k}")
            assert name == "packing" or after.columns == docs.columns
            docs = after
        assert (docs.count() > 0) == bool(rows)


def test_stages_hand_on_their_columns_and_keep_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert after.columns == first.columns and after.dtypes == first.dtypes
        if name == "quality_classifier":
            machine = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            scores = {r.doc_id: r.quality_score for r in quality.score_quality(docs, machine).collect()}
            assert {r.doc_id for r in after.collect()} == {k for k, s in scores.items() if s >= 0.5}
            good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
            assert len(good & set(scores) - {r.doc_id for r in after.collect()}) <= 0.02 * len(good)
        if name == "near_dedup":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in minhash.near_duplicates(docs, 5).where("kept").collect()}
        if name == "passage_dedup":
            want = removed_by_hand(sorted((r.doc_id, r.text or "") for r in docs.collect()))
            assert {r.doc_id: r.text for r in after.collect()} == {k: v[3].decode("utf-8", "ignore") for k, v in want.items()}
        if name == "source_mix":
            assert Counter(r.doc_id for r in after.collect()) == drawn(docs.collect())
        if name == "packing":
            whole = Tokenizer.from_file(packing.vocabulary_file())
            tokens = Counter()
            for r in docs.collect():
                tokens[r.doc_id] += len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1
            packed, filled = Counter(), Counter()
            for r in after.collect():
                packed[r.doc_id] += r.length
                filled[r.sequence_id] += r.length
            assert packed == tokens and max(filled.values()) <= 4096
        docs = after
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
