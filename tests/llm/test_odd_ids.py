"""Repeated and null identifiers, and what scores must not depend on."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grovemark.llm import fingerprint, interpolation, inverted_index, minhash, packing, quality, suffix_dedup
from test_corpus_operators import DOCS, labelled, removed_by_hand

TEXTS = [(1, "one two three four"), (1, "one two three four"), (1, "another text of the same id"), (None, "one two three four"), (None, None), (None, ""), (5, "z " * 300), (7, "one two three five")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "", "s", 0, i, "") for i, (k, t) in enumerate(TEXTS)], DOCS).repartition(3).persist()


def test_scores_see_no_held_out_labels_languages_or_sources(spark):
    docs, labels = labelled(spark)
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    turned = spark.createDataFrame([(r.doc_id, 1 - r.quality if held(r.doc_id) and r.quality is not None else r.quality) for r in labels.collect()], "doc_id long, quality int")
    other = docs.withColumn("lang", F.lit("qq")).withColumn("source", F.concat(F.lit("other "), F.col("doc_id").cast("string")))
    one, two = ({r.doc_id: r.score for r in quality.quality_digest(d, x).collect()} for d, x in ((docs, labels), (other, turned)))
    assert one == two and sum(map(held, one)) > 50 and len(set(one.values())) > 50


def test_packing_keeps_every_row(odd):
    got = packing.pack(odd, packing.vocabulary_file(), size=64).collect()
    whole = Counter()
    for r in got:
        whole[r.doc_id] += r.length
    sizes = {r.doc_id: r.doc_tokens for r in got}
    assert set(sizes) == {1, None, 5, 7}
    starts = Counter((r.doc_id, r.start) for r in got)
    assert starts[1, 0] == 3 and starts[None, 0] == 3  # each row is packed
    by_sequence = Counter()
    for r in got:
        by_sequence[r.sequence_id] += r.length
    assert max(by_sequence.values()) <= 64 and sum(by_sequence.values()) == sum(whole.values())


def test_interpolation_scores_every_row(odd):
    got = interpolation.interpolated_scores(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in TEXTS)
    train = sum(len((t or "").split()) + 1 for k, t in TEXTS if interpolation.fold(k) != interpolation.HELD)
    assert {r.train_tokens for r in got} == {train} and all(r.held_out == (interpolation.fold(r.doc_id) == interpolation.HELD) and math.isfinite(r.score) for r in got)
    alike = [(r.doc_id, r.score) for r in got if r.n_tokens == 5 and r.doc_id != 7]
    assert len({round(s, 9) for _, s in alike}) == 1  # equal texts score alike, whatever their ids


def test_near_duplicates_of_odd_ids(odd):
    got = minhash.near_duplicates(odd, 2).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in TEXTS)
    linked = [r for r in got if r.n_shingles == 3 and r.doc_id in (1, None)]
    assert len(linked) == 3 and {r.component_id for r in linked} == {1}
    empty = [r for r in got if r.n_shingles == 0]
    assert len(empty) == 2 and all(r.kept for r in empty)
    kept = minhash.drop_near_duplicates(odd, 2).collect()
    assert Counter(r.text for r in kept)["one two three four"] == 1 and sum(not (r.text or "").strip() for r in kept) == 2


def test_repeats_under_one_id(spark):
    a, b = "abcdefghij" * 15, "0123456789" * 20
    rows = [(3, a), (3, a), (None, b), (9, b), (9, "x" + b), (11, None)]
    docs = spark.createDataFrame([(k, t, "", "", 0, 0, "") for k, t in rows], DOCS).repartition(2)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.repeat_digest(docs).collect())
    # null is before all; which of two equal rows under one id keeps its bytes is not told
    alone = removed_by_hand([(1, a)])[1][1], removed_by_hand([(1, b)])[1][1]
    assert sum(n for (k, *_), n in got.items() if k == 3) == 2 and got[3, 150, alone[0]] + got[3, 150, 150] == 2 and got[3, 150, alone[0]] >= 1
    assert got[None, 200, alone[1]] == 1 and got[9, 200, 200] == 1 and got[9, 201, 200] == 1 and got[11, 0, 0] == 1


def test_vectors_under_one_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0]), (2, None), (None, [1.0, 0.02]), (4, [float("nan"), 1.0])]
    got = inverted_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert Counter(r.vec_id for r in got) == Counter(k for k, _ in rows)
    assert sorted(r.n_links for r in got) == [0, 0, 0, 2, 2, 2]


def test_fingerprints_of_every_row(odd):
    got = fingerprint.fingerprint_digest(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in TEXTS)
    assert len({r.fingerprint for r in got if r.n_chars == 18 and r.doc_id != 7}) == 1 and all(0 <= r.near_next <= 1 for r in got)
