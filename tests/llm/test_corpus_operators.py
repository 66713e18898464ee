"""Operators of the corpus subpackage against brute force on small tables with nulls, ties, repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovemark.llm import fingerprint, interpolation, inverted_index, license_scan, minhash, mixing, packing, quality, suffix_dedup, warc
from grovemark.llm.common import Scratch, meet

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy int, place string"


def vocabulary(rng: random.Random, n: int = 300) -> list[str]:
    return ["".join(rng.choices("abcdefghiklmnoprstuvwéßñ", k=rng.randint(1, 9))) for _ in range(n)]


def texts(seed: int, n: int) -> list[str | None]:
    """Invented texts with copies, near copies, shared passages, nulls, blanks, and one long text."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    passage = " ".join(rng.choices(words, k=60))
    out: list[str | None] = [None, "", " \t\n", "one", "One ", "one two", "a a a a a a a"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and len(out) > 10:
            out.append(rng.choice(out))
        elif kind < 0.35 and len(out) > 10 and (base := rng.choice(out)):
            ws = base.split(" ")
            for _ in range(max(1, len(ws) // 25)):
                ws[rng.randrange(len(ws))] = rng.choice(words)
            out.append(" ".join(ws))
        else:
            t = " ".join(rng.choices(words, k=rng.randint(1, 120)))
            out.append(f"{t}\n{passage} {t[:30]}." if kind > 0.8 else t)
    out.append(" ".join(rng.choices(words, k=6000)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3 + 1, t, "xx", None if k % 7 == 0 else f"s{k % 3}", None if k % 5 == 0 else len(t or ""), k, "p") for k, t in enumerate(texts(1, 160))]
    return spark.createDataFrame(rows, DOCS).repartition(5).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingles(text: str, n: int) -> frozenset:
    w = tokens(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


# Quality.


def labelled(spark, n=400):
    rng = random.Random(4)
    words = vocabulary(rng)
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        ws = rng.choices(words, k=rng.randint(20, 150))
        t = " ".join(w.upper() + "!!" for w in ws) if bad and k % 8 else " ".join([ws[0]] * len(ws)) if bad else " ".join(ws) + "."
        rows.append((k, t, "xx", "s", len(t), 0, ""))
        labels.append((k, None if k % 50 == 49 else int(not bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_scores_held_out_rows_well(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.quality_digest(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    assert len(got) == 400
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for k, r in got.items())
    held = [k for k in truth if got[k].held_out]
    assert sum(got[k].predicted == truth[k] for k in held) / len(held) > 0.95


def test_quality_identity_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    at, x = np.array([3, 9, 20, 41]), np.array([0.5, 1.0, -2.0, 0.1], np.float32)
    pairs = sum(float(m.factors[a] @ m.factors[b]) * x[i] * x[j] for i, a in enumerate(at) for j, b in enumerate(at) if i < j)
    assert m.raw(at, x) == pytest.approx(0.3 + float(m.weights[at] @ x) + pairs, rel=1e-4)


def test_quality_on_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_digest(empty, none).count() == 0
    got = quality.quality_digest(docs, none).collect()  # no labels: an even score for all
    assert {r.score for r in got} == {0.5}
    machine = quality.train(*labelled(spark))
    kept = quality.keep_quality(docs, machine, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()


# Packing.


def test_quality_with_repeated_ids_long_texts_and_clashing_columns(spark):
    rows = [(k % 4, f"word{k % 3} text {k}", "", "", 5, 0, "") for k in range(40)] + [(7, "long " * 200_000, "", "", 1_000_000, 0, ""), (None, None, "", "", None, 0, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("quality_score", F.lit("clash"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)] + [(0, 1), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality.quality_digest(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    again = quality.quality_digest(docs.union(docs), labels).collect()  # rows that repeat are learnt once
    assert {(r.doc_id, round(r.score, 12)) for r in got} == {(r.doc_id, round(r.score, 12)) for r in again}
    kept = quality.keep_quality(docs, quality.train(docs, labels), 0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows) and kept.first().quality_score == "clash"


def test_packing_is_a_round_trip_with_little_padding(docs, rows):
    from tokenizers import Tokenizer

    file = packing.vocabulary_file()
    whole = Tokenizer.from_file(file)
    got = packing.pack(docs.coalesce(1), file, size=256).collect()
    want = {k: [*whole.encode(t, add_special_tokens=False).ids, 2] for k, t in rows}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) > 0 and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for k, ids in want.items():
        pieces = sorted(by_doc[k], key=lambda r: r.start)
        assert [i for r in pieces for i in r.ids] == ids
        assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces[:-1])]))
    sizes = []
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces[:-1])]))
        sizes.append(sum(r.length for r in pieces))
    assert max(sizes) <= 256
    padding = sum(256 - s for s in sizes if s & (s - 1))
    assert padding < 0.1 * sum(sizes)


def test_cuts_are_cheapest():
    rng = random.Random(2)
    for _ in range(200):
        pos = [0]
        while len(pos) < 12:
            pos.append(pos[-1] + rng.randint(1, 9))
        cost = [0.0] + [float(rng.choice([0, 4, 32])) for _ in pos[1:]]
        best = [0.0] + [math.inf] * (len(pos) - 1)
        for j in range(1, len(pos)):
            best[j] = min(best[i] + 20 - (pos[j] - pos[i]) + cost[j] for i in range(j) if pos[j] - pos[i] <= 20)
        cuts = packing.cut_points(pos, cost, 20)
        assert cuts[-1] == pos[-1] and all(b - a <= 20 for a, b in zip([0, *cuts], cuts, strict=False))
        assert sum(20 - (b - a) + cost[pos.index(b)] for a, b in zip([0, *cuts], cuts, strict=False)) == pytest.approx(best[-1])


def test_words_have_the_tokenizer_s_ids():
    import pyarrow as pa

    t = packing.WordTokenizer(packing.vocabulary_file())
    rng = random.Random(3)
    letters = [*"aAbsStÉéeΣσςIİi12 \n\t\r\x0b\x85’'.!?-中文ß½", "<|endoftext|>", "'ll", "́"]
    xs = [None, *("".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(3000))]
    ids, counts = t.encode(pa.array(xs, pa.string()).slice(1000, 1500))
    ends = np.cumsum([0, *counts])
    for x, a, b in zip(xs[1000:2500], ends[:-1], ends[1:], strict=True):
        assert t.whole.encode(x or "", add_special_tokens=False).ids == ids[a:b].tolist()


def test_packing_streams_in_parts():
    ends = np.zeros(10, bool)
    ends[3] = True
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 10, rng.integers(1, 90)).astype("<u4") for _ in range(60)]
    p = packing.Packer(ends, 5, size=64, horizon=300)
    pieces = [x for k, d in enumerate(docs) for x in p.add(k, d)]
    pieces += p.close()
    for k, d in enumerate(docs):
        assert np.concatenate([x[2] for x in pieces if x[0] == k]).tolist() == d.tolist()
    assert packing.pack is not None and p.held == 0 or not p.docs


def test_packing_of_nothing(empty):
    assert packing.pack(empty, packing.vocabulary_file()).count() == 0


def test_structure_statistics_see_every_word():
    words = (["ab", "cd.", "--", "ef"] * 400)[:1536]
    got = dict(zip(quality.STATS, quality.statistics(" ".join(words), words, Counter(words)), strict=True))
    assert got["marked_ends"] == 0.5 and got["lone_marks"] == 0.25


# Mixing.


def test_mixing_follows_the_poisson_inversion(docs, rows):
    got = mixing.mix_sources(docs, seed=17)
    assert set(got.columns) == set(docs.columns)
    mass = Counter()
    for r in docs.collect():
        mass[r.source] += len(r.text or "")
    want = {s: math.sqrt(m) for s, m in mass.items()}
    rate = {s: want[s] * sum(mass.values()) / (sum(want.values()) * mass[s]) for s in mass}
    expected = Counter()
    for r in docs.collect():
        u = int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        p = cdf = math.exp(-rate[r.source])
        k = 0
        while cdf <= u:
            k += 1
            p *= rate[r.source] / k
            cdf += p
        expected[r.doc_id] = k
    found = Counter(r.doc_id for r in got.collect())
    assert found == Counter({k: v for k, v in expected.items() if v})
    places = [r.place for r in got.collect()]
    assert places == sorted(places)


def test_mixing_weights_and_odd_tables(spark, docs, empty):
    assert mixing.mix_sources(empty).count() == 0
    only = mixing.mix_sources(docs, weights={"s1": 1.0})
    assert {r.source for r in only.select("source").collect()} == {"s1"}
    rates = {r.source: r for r in mixing.source_rates(docs, {"s1": 1, "s2": 3}).collect()}
    assert rates["s2"].target == 0.75 and rates[None].rate == 0
    blank = spark.createDataFrame([(1, None, "x", "s", 0, 0, "")], DOCS)
    assert mixing.source_rates(blank).first().rate == 1.0


def test_mixing_draws_large_rates(spark):
    rows = [(0, "x" * 4_000_000, "", "huge", 0, 0, ""), *((k, "y", "", "tiny", 0, 0, "") for k in range(1, 5))]
    docs = spark.createDataFrame(rows, DOCS)
    rate = math.sqrt(4) * 4_000_004 / (2002 * 4)
    assert {r.source: r.rate for r in mixing.source_rates(docs).collect()}["tiny"] == pytest.approx(rate) and 500 < rate < 1000
    got = mixing.mix_sources(docs).where("source = 'tiny'").select("doc_id", "copy").collect()
    for k in range(1, 5):
        want = 0
        for name in (f"17:{k}", f"17:1:{k}"):
            u = int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2**52
            p = cdf = math.exp(-rate / 2)
            n = 0
            while cdf <= u:
                n += 1
                p *= rate / 2 / n
                cdf += p
            want += n
        assert sorted(r.copy for r in got if r.doc_id == k) == list(range(1, want + 1)) and abs(want - rate) < 6 * math.sqrt(rate)


# Language model.


def test_interpolation_counts_and_probabilities(docs, rows):
    got = {r.doc_id: r for r in interpolation.interpolated_scores(docs).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    seen = Counter(t for k, x in rows if not held[k] for t in [*tokens(x), None])
    n, v = sum(seen.values()), len(seen)
    assert len(got) == len(rows)
    for k, x in rows:
        ts = [*tokens(x), None]
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ts), sum(seen[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((seen[t] + 1) / (n + v + 1)) for t in ts))
        assert r.score < 0
    trained = [r for r in got.values() if not r.held_out]
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)


def test_interpolation_sums_to_one():
    """Over all words and one unknown, the mixture after a context is a distribution."""
    train = [["a", "b", None], ["a", "c", None], ["b", None]]
    one, two, three = Counter(t for d in train for t in d), Counter(), Counter()
    for d in train:
        two.update(zip(["<s>", *d], d, strict=False))
        three.update(zip(["<s>", "<s>", *d], ["<s>", *d], d, strict=False))
    n, v = sum(one.values()), len(one)
    weights = np.tile([0.4, 0.3, 0.2, 0.1], (interpolation.BUCKETS, 1))
    total = 0.0
    for w in [*one, "unknown"]:
        counts = [np.array([one["a"], one[w]]), np.array([two["<s>", "a"], two["a", w]]), np.array([0, three["<s>", "a", w]])]
        f, b = interpolation._estimates(counts, np.array([0, 2]), n, v, 3)
        total += float(f[1] @ weights[b[1]])
    assert total == pytest.approx(1.0)


def test_interpolated_scores_match_brute_force(docs, rows, monkeypatch):
    """With given weights, every score by counts in plain dictionaries."""
    rng = np.random.default_rng(4)
    weights = rng.random((interpolation.BUCKETS, 4))
    weights /= weights.sum(1, keepdims=True)
    monkeypatch.setattr(interpolation, "learn", lambda dev, even, rounds=0: weights)
    monkeypatch.setattr(interpolation, "TEXT", 20_000)
    got = {r.doc_id: r.score for r in interpolation.interpolated_scores(docs).collect()}
    seen: list[Counter] = [Counter(), Counter(), Counter()]
    n_docs = 0
    for k, x in rows:
        if interpolation.fold(k) != interpolation.HELD:
            n_docs += 1
            t = ["<s>", "<s>", *tokens(x), None]
            for i in range(2, len(t)):
                for g in range(3):
                    seen[g][tuple(t[i - g : i + 1])] += 1
    n, v = sum(seen[0].values()), len(seen[0])
    size = lambda c: min(interpolation.SIZES - 1, c.bit_length())
    for k, x in rows:
        t, want = ["<s>", "<s>", *tokens(x), None], 0.0
        for i in range(2, len(t)):
            pair = n_docs if i == 2 else seen[1][t[i - 2], t[i - 1]]
            word = n_docs if i == 2 else seen[0][(t[i - 1],)]
            w = weights[size(pair) if pair else interpolation.SIZES + size(word)]
            f = [seen[2][tuple(t[i - 2 : i + 1])] / max(1, pair), seen[1][tuple(t[i - 1 : i + 1])] / max(1, word), seen[0][(t[i],)] / n, 1 / (v + 1)]
            want += math.log10(float(np.dot(w, f)))
        assert got[k] == pytest.approx(want)


def test_expectation_maximisation_raises_likelihood(spark):
    rng = np.random.default_rng(0)
    bucket, f = rng.integers(0, 4, 500).astype(np.uint8), rng.random((500, 3)).astype("<f4") ** 4
    dev = spark.createDataFrame([(bytearray(bucket.tobytes()), bytearray(f.tobytes()))], "bucket binary, f binary")

    def likelihood(w):
        return np.log((np.concatenate([f, np.full((500, 1), 0.01)], axis=1) * w[bucket]).sum(1)).sum()

    steps = [likelihood(interpolation.learn(dev, 0.01, r)) for r in (0, 1, 6)]
    assert steps[0] < steps[1] < steps[2]
    assert interpolation.learn(dev, 0.01, 3).sum(1) == pytest.approx(np.ones(interpolation.BUCKETS))


def test_interpolation_of_odd_tables(spark, empty):
    assert interpolation.interpolated_scores(empty).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = interpolation.interpolated_scores(spark.createDataFrame([(held, "x y", "", "", 0, 0, "")], DOCS)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


# MinHash.


@pytest.mark.parametrize(("n", "block"), [(2, 512), (5, 3)])
def test_near_duplicates_match_brute_force(docs, rows, n, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    sets = {k: shingles(t, n) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, n).collect()}
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


def test_members_far_from_their_leader_still_link(spark):
    """A chain whose ends differ: every link must come from some pair of members, not from the leader alone."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 120]), "", "", 0, 0, "") for k in range(30)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect()
    assert {r.component_id for r in got} == {0}


def test_links_between_far_members_of_a_group(spark):
    """Copies with a tenth of their words changed, some of which are close to each other: all links of the group count."""
    rng = random.Random(21)
    words = vocabulary(rng, 3000)
    base = rng.choices(words, k=100)
    rows = []
    for k in range(70):
        ws = list(base)
        for _ in range(rng.choice([2, 6, 9, 12])):
            ws[rng.randrange(len(ws))] = rng.choice(words)
        rows.append((k, " ".join(ws)))
    sets = {k: shingles(t, 2) for k, t in rows}
    label = {k: k for k in sets}
    for _ in range(70):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame([(k, t, "", "", 0, 0, "") for k, t in rows], DOCS), 2).collect()}
    assert got == label and len(set(label.values())) > 1


def test_blocks_cover_all_pairs_between_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    members = spark.createDataFrame([(7, k, 0, 0, 12, 0, 0, 0) for k in range(12)], "key long, cls long, b0 long, b1 long, n long, leader long, l0 long, l1 long")
    labels = spark.createDataFrame([(k, 0) for k in range(5)], "id long, component long")
    got = minhash.between_components(Scratch(spark), members, labels).collect()
    root = list(range(12))
    for _ in range(12):
        for r in got:
            root[r.a] = root[r.b] = min(root[r.a], root[r.b])
    assert set(root) == {0}


@pytest.mark.parametrize("hot", [2, 10_000])
def test_hot_keys_meet_their_rows_by_a_broadcast(spark, hot):
    left = spark.createDataFrame([(k % 4 if k < 30 else k, k) for k in range(40)], "key long, v long")
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low")).where("n > 1")
    got = sorted((r.key, r.v, r.low) for r in meet(left, right, "key", hot=hot).collect())
    assert got == sorted((k % 4, k, k % 4) for k in range(30))


def test_kept_bits_estimate_similarity():
    rng = np.random.default_rng(5)
    shared, a, b = (rng.integers(0, 2**63, m, dtype=np.uint64) for m in (800, 100, 100))
    _, bits = minhash.signature(minhash.minima([np.unique(np.concatenate([shared, x])) for x in (a, b)]))
    agree = minhash.MINIMA - sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64))
    assert (agree / minhash.MINIMA - 0.5) * 2 == pytest.approx(0.8, abs=0.25)


def test_dropping_near_duplicates(spark, docs, empty):
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
    twice = spark.createDataFrame([(1, "a b c d e f", "", "", 0, 0, ""), (1, "a b c d e f", "", "", 0, 0, ""), (None, "q r s t u v", "", "", 0, 0, "")], DOCS)
    assert sorted((r.doc_id or -1) for r in minhash.drop_near_duplicates(twice).collect()) == [-1, 1]


def test_unlike_texts_under_one_id_stay(spark):
    a, b, c, d = ("a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z a b")
    found = [(5, a), (5, b), (3, a), (None, a), (None, c), (None, c), (None, d), (7, b), (8, None), (8, None), (9, d), (4, "r s t u v w x"), (None, "")]
    docs = spark.createDataFrame([(k, t, "", "", i, 0, "") for i, (k, t) in enumerate(found)], DOCS).repartition(3)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([(5, b), (3, a), (None, c), (9, d), (8, None), (8, None), (4, "r s t u v w x"), (None, "")])


# Vectors.


def test_vectors_link_within_each_width(spark):
    rng = np.random.default_rng(8)
    wide, narrow = rng.normal(size=(20, 8)), rng.normal(size=(20, 5))
    found = [(0, [None]), (1, [1.0, 2.0]), (2, [2.0])]
    for k, x in enumerate([*wide, *narrow]):
        found += [(10 + 2 * k, x.tolist()), (11 + 2 * k, (x * 3 + 1e-6).tolist())]
    docs = spark.createDataFrame(found, "vec_id long, embedding array<double>").coalesce(1)
    got = {r.vec_id: r for r in inverted_index.near_vectors(docs, 0.999).collect()}
    assert [got[k].n_links for k in range(3)] == [0, 0, 0] and all(got[k].kept for k in range(3))
    assert all(got[k].n_links == 1 and got[k].component_id == k - k % 2 for k in range(10, 90))


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = [*base, *(base[:20] + 0.05 * rng.normal(size=(20, 16))), *base[:5], *(3 * base[:5])]
    rows = [(k * 2, [float(v) for v in row], 1) for k, row in enumerate(x)]
    rows += [(1001, None, 1), (1003, [], 1), (1005, [0.0] * 16, 1), (1007, [float("nan")] * 16, 1), (1009, [None, *[1.0] * 15], 1)]
    got = {r.vec_id: r for r in inverted_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(20):
        label = np.minimum(label, np.where(link, label, 10**6).min(1))
    for k in range(len(x)):
        assert (got[2 * k].n_links, got[2 * k].component_id) == (link[k].sum(), 2 * label[k])
    assert all(got[k].n_links == 0 and got[k].kept for k in (1001, 1003, 1005, 1007, 1009))


@pytest.mark.parametrize("n", [2, 3, 5, 50, 20_000])
def test_links_of_tables_of_any_size(spark, n):
    """Half of the vectors are neighbours of the others at cosines over 0.9; links and components against brute force."""
    rng = np.random.default_rng(n)
    base = rng.normal(size=((n + 1) // 2, 16))
    x = np.concatenate([base, base[: n - len(base)] + 0.35 * rng.random((n - len(base), 1)) * rng.normal(size=(n - len(base), 16)), base[:1]])[:n]
    if n == 2:
        x = np.array([[1.0, 0.0, 0.0, 0.0], [1.0, 0.01, 0.0, 0.0]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got = {r.vec_id: r for r in inverted_index.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)).collect()}
    want = np.concatenate([(u[lo : lo + 2000] @ u.T >= 0.9).sum(1) - 1 for lo in range(0, n, 2000)])
    found = np.array([got[k].n_links for k in range(n)])
    assert len(got) == n and want.sum() > 0 and (found <= want).all()
    assert found.sum() >= 0.99 * want.sum() and (n > 3000 or (found == want).all())
    assert all(got[k].component_id <= k and (got[k].component_id < k) <= (want[k] > 0) for k in range(n))


def test_traversal_visits_nearest_cells_first():
    rng = np.random.default_rng(1)
    a, b = rng.random(9), rng.random(7)
    got = inverted_index.traversal(a, b, 63)
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and len(set(got)) == 63


def test_recall_of_the_index_reaches_its_target():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * noise
    grid = inverted_index.fit(x, 20_000, 0.9)
    cells, queries = grid.cells(y), grid.visited(x)
    back, own = grid.visited(y), grid.cells(x)
    assert np.mean([c in q if o <= c else o in r for c, q, o, r in zip(cells, queries, own, back, strict=True)]) >= 0.97


def test_no_vectors(spark):
    assert inverted_index.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert inverted_index.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first().kept


# Suffixes.


def removed_by_hand(rows):
    seen, out = set(), {}
    for k, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(w)
        out[k] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, y in zip(b, gone, strict=True) if not y))
    return out


def test_repeats_match_brute_force(docs, rows):
    want = removed_by_hand(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digest(docs).collect()}
    assert got == {k: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for k, v in want.items()}
    assert sum(v[1] for v in want.values()) > 1000
    cut = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(docs).collect()}
    assert cut == {k: v[3].decode("utf-8", "ignore") for k, v in want.items()}


def test_buckets_fill_alike(spark):
    got = [t.encode() for (t,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text IS NOT NULL").collect()]
    row = {"text": suffix_dedup._zip(b"".join(got)), "edges": suffix_dedup.packed(np.cumsum([0, *map(len, got)]))}
    keys = np.unique(suffix_dedup._opened(row)[3])
    sizes = [w.stop - w.start for _, w in suffix_dedup.cut(keys, 5)]
    assert len(keys) > 10_000 and len(sizes) == 32 and max(sizes) <= 2 * len(keys) / 32


def test_large_groups_are_swept_alike(spark, monkeypatch):
    rng = random.Random(9)
    words = vocabulary(rng)
    passage = " ".join(rng.choices(words, k=50))
    rows = [(k, f"{' '.join(rng.choices(words, k=12))} {passage[: rng.randint(90, len(passage))]} {' '.join(rng.choices(words, k=12))}") for k in range(80)] + [(200, "x" * 3000)]
    docs = spark.createDataFrame([(k, t, "", "", 0, 0, "") for k, t in rows], DOCS).repartition(4)
    want = removed_by_hand(rows)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.repeat_digest(docs).collect()}
    assert got == {k: v[1:3] for k, v in want.items()}


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(6)
    runs = [sorted("".join(rng.choices("ab", k=rng.randint(0, 8))).encode() for _ in range(rng.randint(0, 40))) for _ in range(7)]
    tree = suffix_dedup.LoserTree([suffix_dedup.decoded(*suffix_dedup.front_coded(r)) for r in runs])
    got = list(tree)
    assert [x[0] for x in got] == sorted(x for r in runs for x in r)
    assert all(runs[run][k] == text for text, _, run, k in got)
    for (a, *_), (b, shared, *_) in zip(got[:-1], got[1:], strict=True):
        assert shared == suffix_dedup.shared_prefix(a, b)


def test_repeats_in_odd_tables(spark, empty):
    assert suffix_dedup.repeat_digest(empty).count() == 0
    out = suffix_dedup.remove_repeats(spark.createDataFrame([(None, None, "", "", None, 1, "x"), (5, "é" * 300, "", "", 300, 1, "y")], DOCS)).collect()
    assert {r.doc_id for r in out} == {None, 5} and all(r.n_chars == len(r.text) for r in out)


# WARC.


def test_archives_round_trip(spark, tmp_path):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 70_000, "<p>z</p>", "", "\r\n\r\nWARC/1.1\r\n"]
    rows = [(k, None if k == 3 else f"http://h/{k}\r\n", t, "extra") for k, t in enumerate(html)] + [(None, "u", "<p>z</p>", "e"), (2, "again", "<p>é</p>", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    bundles = warc.write_bundles(pages, frame_bytes=200, bundle_bytes=60_000).persist()
    got = warc.read_bundles(bundles).collect()
    assert len(got) == len(rows)
    for r in got:
        first = min((k for k, _, t, _ in rows if (t or "") == (dict((a, c or "") for a, _, c, _ in rows)[r.page_id]) and k is not None), default=None)
        if r.page_id is not None:
            text = (html[r.page_id] or "").encode()
            assert (r.payload_bytes, r.payload_digest) == (len(text), warc.digest(text))
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
            assert bytes(r.payload) == (text if r.record_type == "response" else b"")
    for b in bundles.collect():
        for entry in b["index"]:
            head, _ = warc.lookup(bytes(b["content"]), [tuple(x) for x in b["index"]], entry.record_id)
            assert head["WARC-Record-ID"] == entry.record_id
    heads = [warc.parse(warc.frame(bytes(b["content"]), e.frame), e.offset)[0] for b in bundles.collect() for e in b["index"]]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(set(ids)) == len(rows)
    for h in heads:  # a target that rows repeat is named by its page alone
        assert ("WARC-Refers-To" in h) == (h["WARC-Type"] == "revisit" and h["WARC-Refers-To-Page"] != "2")
        assert h.get("WARC-Refers-To", ids[0]) in ids
    assert warc.export(bundles, f"file://{tmp_path}/out") == bundles.count()
    for f in (tmp_path / "out").iterdir():  # frames stand alone, one after another
        content = f.read_bytes()
        frames = warc.seek_table(content)
        assert [x[0] for x in frames] == list(np.cumsum([0, *(x[1] for x in frames[:-1])]))
        assert all(warc.frame(content, k).startswith(b"WARC/1.1") and len(warc.frame(content, k)) == x[2] for k, x in enumerate(frames))


def test_hot_payloads_meet_their_target_by_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 3)
    pages = spark.createDataFrame([(k, "u", "hot" if k % 2 else f"cold {k % 4}") for k in range(20)], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.read_bundles(warc.write_bundles(pages)).collect()}
    assert got == {k: None if k in (0, 1, 2) else 1 if k % 2 else k % 4 for k in range(20)}


def test_damaged_archives_and_none(spark):
    assert warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    content, _ = warc.bundle([warc.record(1, "u", b"abc", warc.digest(b"abc"), None)])
    with pytest.raises(ValueError):
        warc.seek_table(content[:-1] + b"\0")


# Fingerprints.


def test_fingerprints_against_true_resemblance(docs, rows):
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs, per_block=20).collect()}
    full = fingerprint.fingerprint_digest(docs)
    assert full.count() == len(rows)
    errors = []
    for (k, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        r = got[k]
        assert (r.n_chars, r.edited_text) == (len(t), edited)
        for x, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for w in (s.lower().split() for s in (t, x)))
            errors.append(abs(near - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.02


def test_sketches_merge(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(0, 3000))), (1, " ".join(f"w{i}" for i in range(1500, 4500)))], "g int, text string")
    parts = fingerprint.add_sketch(df, "text", "sketch", shingle=1)
    whole = fingerprint.add_sketch(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(4500)))], "g int, text string"), "text", "whole", shingle=1)
    both = fingerprint.merge_sketches(parts, ["g"]).join(whole, "g").select("sketch", "whole", fingerprint.distinct_count(F.col("sketch")).alias("n"), fingerprint.containment(F.col("sketch"), F.col("whole")).alias("c")).first()
    assert both.sketch == both.whole and both.n == pytest.approx(4500, rel=0.3) and both.c == 1.0


def test_fingerprints_of_odd_tables(spark, empty):
    assert fingerprint.fingerprint_digest(empty).count() == 0
    r = fingerprint.fingerprint_digest(spark.createDataFrame([(None, None, "", "", 0, 0, "")], DOCS)).first()
    assert (r.n_chars, r.near_edited, r.near_next, r.fingerprint) == (0, 1.0, 1.0, "")


# Licences.


def test_licence_scan_matches_brute_force(spark):
    rng = random.Random(12)
    words = vocabulary(rng)
    names = list(license_scan.NOTICES)
    rows = [(900, None), (901, ""), (902, "mit"), (903, "Released under the MIT License.")]
    for k in range(120):
        before, after = (" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(2))
        notice = license_scan.tokens(license_scan.NOTICES[rng.choice(names)])
        if k % 3 == 1 and len(notice) > 20:
            notice[rng.randrange(len(notice))] = "qqq"
        rows.append((k, before + " " + (" ".join(notice) if k % 4 else "") + " " + after))
    docs = spark.createDataFrame([(k, t, "", "", 0, 0, "") for k, t in rows], DOCS)
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan_licenses(docs).collect()}
    want = {}
    for k, t in rows:
        have = license_scan.tokens(t or "")
        for name, text in license_scan.NOTICES.items():
            w = license_scan.tokens(text)
            known = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            length, stride = license_scan.window_of(license_scan.size_class(len(known)))
            best = 0.0
            for s in range(-length, len(have)):
                if s % stride == 0:
                    lo, hi = max(0, s), s + length
                    best = max(best, len(known & {tuple(have[i : i + 5]) for i in range(lo, min(hi, len(have) - 4))}) / len(known))
            if best >= 0.8:
                want[k, name] = best
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want) and len(want) > 60


def test_licence_scan_misses_no_offset(spark, monkeypatch):
    """Windows at every offset, not those of the operator's grid, tell what must be found; small passes find the same as one."""
    rng = random.Random(21)
    words = vocabulary(rng)
    templates = {f"t{k}": " ".join(rng.choices(words, k=rng.randint(8, 70))) for k in range(6)}
    rows = []
    for k in range(90):
        part = license_scan.tokens(templates[f"t{k % 6}"])
        cut = part[: math.ceil(len(part) * rng.choice([0.7, 0.85, 0.95, 1.0]))]
        rows.append((k, " ".join([*rng.choices(words, k=rng.randint(0, 90)), *cut, *rng.choices(words, k=rng.randint(0, 40))])))
    rows.append((500, " ".join(rng.choices(words, k=40_000)) + " " + templates["t0"]))
    docs = spark.createDataFrame([(k, t, "", "", 0, 0, "") for k, t in rows], DOCS)
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs, templates).collect()}
    sure, possible = set(), set()
    for k, t in rows:
        have = license_scan.tokens(t)
        hashed = [tuple(have[i : i + 5]) for i in range(len(have) - 4)]
        for name, text in templates.items():
            w = license_scan.tokens(text)
            known = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            places = [i for i, x in enumerate(hashed) if x in known]
            cls = license_scan.size_class(len(known))
            for length, out in ((cls, sure), (license_scan.window_of(cls)[0], possible)):
                if any(len({hashed[j] for j in places if i <= j < i + length}) / len(known) >= 0.8 for i in places):
                    out.add((k, name))
    assert sure <= got <= possible and len(sure) > 40 and (500, "t0") in got
    monkeypatch.setattr(license_scan, "MOST_SHINGLES", 60)
    assert {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs, templates).collect()} == got


def test_templates_are_read_from_files(tmp_path):
    (tmp_path / "x.txt").write_text("some words of a licence")
    assert license_scan.read_templates(str(tmp_path)) == {"x": "some words of a licence"}


def test_licence_scan_of_odd_tables(spark, empty, docs):
    assert license_scan.scan_licenses(empty).count() == 0
    assert license_scan.scan_licenses(docs, {"short": "too few words"}).count() == 0
    twice = docs.select("doc_id", F.lit(license_scan.NOTICES["isc"]).alias("text"), F.lit("x").alias("license")).where("doc_id = 4")
    assert [(r.doc_id, r.license) for r in license_scan.scan_licenses(twice.union(twice)).collect()] == [(4, "isc")]
