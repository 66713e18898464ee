"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct word shingles, hashed to 64 bits. Equal sets are one class from the start. A class has
128 minima: 32 bands of 4 rows find candidates (a pair of similarity 0.8 shares a band but for 5 in 10**8), and the
lowest kept bit of each minimum, packed into two longs, estimates similarity, corrected for chance collisions, by a bit
count. Estimates under 0.48 (six standard deviations below 0.8) need no confirmation; all others are confirmed on full sets.

Large groups are not compared pair by pair. First each band's members meet the band's smallest class alone; confirmed
links make components. Only where a band still holds several components are members of different ones compared, by
bit counts in blocks of bounded size that never hold a whole hot band. What these find near is written as a spanning forest,
no more rows than members; its trees are the groups within which full sets are compared, block by block, where estimates
and sizes allow a link and the two sides are not joined yet. Links found there are a spanning forest again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, meet, small_batches
from .exchange import grouped
from .packing import slices

BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Of 128 kept bits, so many must agree: (95 / 128 - 1 / 2) / (1 - 1 / 2) = 0.48.
AGREE = 95
BLOCK, BATCH = 512, 4 << 20
#: Ids are broadcast up to so many (8 bytes each); beyond, they are joined by an exchange.
MOST_SENT = 1_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**64, MINIMA, dtype=np.uint64)
_ODD = _rng.integers(0, 2**64, MINIMA, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, edges of the texts in them); A-Z are lower-cased, null is empty."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = parts.flatten()
    words = flat.dictionary_encode()
    names = words.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w.encode().lower()) for w in names), dtype=np.uint64, count=len(names))  # bytes lower A-Z alone
    edges = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    hashes = table[words.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    if "" in names:  # what stands beside white space at a text's ends
        real = hashes != xxhash.xxh3_64_intdigest("")
        edges = np.concatenate([[0], np.cumsum(real)])[edges]
        hashes = hashes[real]
    return hashes, edges


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; with fewer than n words the whole sequence is one."""
    h, edges = word_hashes(texts)
    each = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for j in range(n):
        each = mixed(each + h[j : len(h) - n + 1 + j] + np.uint64(j + 1)) if len(each) else each
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi - lo >= n:
            yield np.unique(each[lo : hi - n + 1])
        elif hi > lo:
            short = np.uint64(hi - lo)
            for x in h[lo:hi]:
                short = mixed(np.array([short * _M1 + x]))[0]
            yield np.array([short])
        else:
            yield h[:0]


def set_class(shingles: np.ndarray) -> int | None:
    """64 bits that stand for a set; none for an empty one."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of MINIMA minima; the sets must not be empty."""
    out = np.empty((len(sets), MINIMA), dtype=np.uint64)
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= 1 << 15):
            size += len(sets[hi])
            hi += 1
        x = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        v = np.empty_like(x)
        for k in range(MINIMA):
            np.bitwise_xor(x, _XOR[k], out=v)
            np.multiply(v, _ODD[k], out=v)
            out[lo:hi, k] = np.minimum.reduceat(v, starts)
        lo = hi
    return out


def signature(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, n x BANDS; kept bits, n x 2), signed 64-bit."""
    keys = np.zeros((len(low), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys + low[:, r::ROWS] + np.uint64(r + 1))
    keys = mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64))
    bits = (low >> np.uint64(32)) & np.uint64(1)
    packed = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8")
    return keys.view(np.int64), packed.view(np.int64)


def agreement(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """How many of the kept bits agree."""
    return F.lit(MINIMA) - F.bit_count(a[0].bitwiseXOR(b[0])) - F.bit_count(a[1].bitwiseXOR(b[1]))


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch):
                    sets = list(shingle_sets(part.column("text"), n))
                    full = [k for k, s in enumerate(sets) if len(s)]
                    keys, bits = signature(minima([sets[k] for k in full])) if full else (np.zeros((0, BANDS), np.int64), np.zeros((0, 2), np.int64))
                    at = np.full(len(sets), -1)
                    at[full] = np.arange(len(full))
                    rows = pa.array(np.where(at < 0, 0, at), mask=at < 0)
                    bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64())) if full else pa.array([], pa.list_(pa.int64()))
                    yield pa.record_batch(
                        [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_class(s) for s in sets], pa.int64()), bands.take(rows), pa.array(bits[:, 0]).take(rows), pa.array(bits[:, 1]).take(rows)],
                        ["doc_id", "n_shingles", "cls", "bands", "b0", "b1"],
                    )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch):
                    found = [(c.as_py(), s) for c, s in zip(part.column("cls"), shingle_sets(part.column("text"), n), strict=True)]
                    found = [(c, s) for c, s in found if set_class(s) == c]  # else another row with the same doc_id
                    yield pa.record_batch([pa.array([c for c, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["cls", "items"])

    return run


def full_sets(scratch: Scratch, docs: DataFrame, where: DataFrame, n: int) -> DataFrame:
    """(cls, items: sorted hashes, 8 bytes each) of the classes in ``where`` (cls, _id: a document that has it), from their whole texts."""
    sent = F.broadcast(where) if where.count() <= MOST_SENT else where
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sent, F.col("doc_id").eqNullSafe(F.col("_id"))).select("cls", "text")
    return scratch.save(texts.mapInArrow(_sets(n), "cls long, items binary").groupBy("cls").agg(F.first("items").alias("items")))


def confirmed(scratch: Scratch, docs: DataFrame, rows: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have 100 * intersection >= percent * union."""
    wanted = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    where = scratch.save(rows.join(wanted, "cls").groupBy("cls").agg(F.min("doc_id").alias("_id")))
    sets = full_sets(scratch, docs, where, n)
    one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a")
    two = one.join(sets.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
    out = scratch.save(two.mapInArrow(_tested(percent), "a long, b long"))
    scratch.drop(wanted, where, sets)
    return out


def _tested(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append((a, b))
            yield _pairs(kept)

    return run


class _Sets:
    """Disjoint sets; ``join`` tells whether two were apart."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.above.get(root, root)) != root:
            root = up
        while self.above.get(x, x) != root:
            self.above[x], x = root, self.above[x]
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.above[max(x, y)] = min(x, y)
        return True


def _pairs(a: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x for x, _ in a], pa.int64()), pa.array([y for _, y in a], pa.int64())], ["a", "b"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, half, cls, comp, b0, b1), sorted by (key, part): a spanning forest of each part's near pairs.

    Pairs are between different components; half 0 and 1: only between the halves; half 2: all.
    """
    held: list[np.ndarray] = []

    def near(rows: np.ndarray) -> list[tuple[int, int]]:
        left, right = (rows[rows["half"] == 0], rows[rows["half"] == 1]) if rows["half"][0] < 2 else (rows, rows)
        n, m = len(left), len(right)
        if not n or not m:
            return []
        own = np.concatenate([left["cls"], right["cls"]])
        label, forest = own.copy(), []
        differ = np.bitwise_count(left["b0"][:, None] ^ right["b0"]) + np.bitwise_count(left["b1"][:, None] ^ right["b1"])
        ok = (differ <= MINIMA - AGREE) & (left["comp"][:, None] != right["comp"])
        if not ok.any():
            return []
        top = np.iinfo(np.int64).max
        while True:  # each class takes the smallest label among its near ones
            a = np.minimum(label[:n], np.where(ok, label[n:], top).min(1))
            b = np.minimum(label[n:], np.where(ok, a[:, None], top).min(0))
            new = np.concatenate([a, b])
            if (new == label).all():
                break
            label = new
        forest = {(min(x, y), max(x, y)) for x, y in zip(own.tolist(), label.tolist(), strict=True) if x != y}
        return sorted(forest)

    def runs(rows: np.ndarray) -> Iterator[np.ndarray]:
        cut = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["part"][1:] != rows["part"][:-1])) + 1
        yield from np.split(rows, cut)

    kind = [("key", "i8"), ("part", "i8"), ("half", "i4"), ("cls", "i8"), ("comp", "i8"), ("b0", "i8"), ("b1", "i8")]
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.empty(batch.num_rows, dtype=kind)
        for name, _ in kind:
            rows[name] = batch.column(name).to_numpy()
        *done, last = runs(np.concatenate([*held, rows]))
        held = [last]
        if pairs := sorted({p for r in done for p in near(r)}):
            yield _pairs(pairs)
    if pairs := sorted({p for r in held for p in near(r)}):
        yield _pairs(pairs)


def _linked(percent: int):
    """Rows (key, part, half, cls, comp, b0, b1, items), sorted by (key, part): links that join components, found on full sets."""

    def links(rows: list[dict]) -> list[tuple[int, int]]:
        left, right = ([r for r in rows if r["half"] == 0], [r for r in rows if r["half"] == 1]) if rows[0]["half"] < 2 else (rows, rows)
        if not left or not right:
            return []
        sets = _Sets()
        for r in rows:
            sets.join(r["cls"], r["comp"])
        bits = [[np.array([r[c] for r in side], np.int64) for c in ("b0", "b1")] for side in (left, right)]
        items = [[np.frombuffer(r["items"], np.uint64) for r in side] for side in (left, right)]
        sizes = [np.array([len(x) for x in side]) for side in items]
        differ = np.bitwise_count(bits[0][0][:, None] ^ bits[1][0]) + np.bitwise_count(bits[0][1][:, None] ^ bits[1][1])
        small, large = np.minimum(sizes[0][:, None], sizes[1]), np.maximum(sizes[0][:, None], sizes[1])
        i, j = np.nonzero((differ <= MINIMA - AGREE) & (100 * small >= percent * large))
        out = []
        for k in np.argsort(differ[i, j], kind="stable").tolist():  # the likeliest first: what they join needs no more tests
            a, b = left[i[k]]["cls"], right[j[k]]["cls"]
            if a == b or sets.find(a) == sets.find(b):
                continue
            x, y = items[0][i[k]], items[1][j[k]]
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if 100 * both >= percent * (len(x) + len(y) - both):
                sets.join(a, b)
                out.append((min(a, b), max(a, b)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "key", "part"):
            if found := links(rows):
                yield _pairs(found)

    return run


def links_within(scratch: Scratch, docs: DataFrame, rows: DataFrame, labels: DataFrame, forest: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that join components within the trees of ``forest``: every pair of a tree whose estimate allows it is tested.

    Trees are dealt out in pairs of blocks; a block's classes bring their sets.
    """
    trees = scratch.save(components(scratch, forest))
    bits = rows.select("doc_id", "cls", "b0", "b1").join(trees.select(F.col("id").alias("cls"), F.col("component").alias("key")), "cls")
    about = scratch.save(bits.groupBy("cls").agg(F.min("doc_id").alias("_id"), F.first("key").alias("key"), F.first("b0").alias("b0"), F.first("b1").alias("b1")))
    sets = full_sets(scratch, docs, about.select("cls", "_id"), n)
    sizes = about.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_o"))
    known = about.join(sizes, "key").join(labels.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).withColumn("own", F.pmod(F.xxhash64("cls"), "_o").cast("int"))
    place = F.transform(F.sequence(F.lit(0), F.col("_o") - 1), lambda j: _block_pair(F.col("own"), j))
    dealt = known.join(sets, "cls").select("key", "cls", "comp", "b0", "b1", "items", F.explode(place).alias("_p")).select("key", "_p.part", "_p.half", "cls", "comp", "b0", "b1", "items")
    out = scratch.save(dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_linked(percent), "a long, b long").distinct())
    scratch.drop(trees, about, sets)
    return out


def _block_pair(own: Column, j: Column) -> Column:
    """Where a member of block ``own`` goes to meet block j: all pairs of blocks i <= j, each once."""
    return F.struct((F.least(j, own) * F.lit(2**31) + F.greatest(j, own)).cast("long").alias("part"), F.when(j == own, 2).when(j > own, 0).otherwise(1).cast("int").alias("half"))


def between_components(scratch: Scratch, members: DataFrame, labels: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the near pairs of different components that share a band, for bands with several components.

    The leader's component of a band, dealt out in blocks, meets every other member; the others meet among themselves in
    pairs of blocks. A band with one component yields nothing and costs nothing.
    """
    known = members.where("n > 2").select("key", "cls", "b0", "b1", (F.col("cls") == F.col("leader")).alias("leads")).join(labels.withColumnRenamed("id", "cls"), "cls", "left")
    known = scratch.save(known.withColumn("comp", F.coalesce("component", "cls")).drop("component"))
    parts = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("leads").alias("leads"))
    counts = parts.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("leads"), F.col("c"))).alias("mains"), F.max(F.when(F.col("leads"), F.col("comp"))).alias("lead"))
    counts = counts.withColumn("others", F.col("n") - F.col("mains")).where("others > 0")
    known = meet(known, scratch.save(counts), "key").withColumn("main", F.col("comp") == F.col("lead")).withColumn("_m", F.ceil(F.col("mains") / (2 * BLOCK)).cast("int")).withColumn("_o", F.ceil(F.col("others") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("cls"), F.when(F.col("main"), F.col("_m")).otherwise(F.col("_o"))).cast("int")

    def placed(part: Column, half: Column) -> Column:
        return F.struct(part.cast("long").alias("part"), half.cast("int").alias("half"))

    # Part -1 - k: block k of the leader's component against all others. Part i * 2**31 + j: blocks i <= j of the others.
    mains = F.array(placed(-1 - own, F.lit(0)))
    others = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda k: placed(-1 - k, F.lit(1))),
        F.transform(F.sequence(F.lit(0), F.col("_o") - 1), lambda j: _block_pair(own, j)),
    )
    dealt = known.withColumn("_p", F.explode(F.when(F.col("main"), mains).otherwise(others))).select("key", "_p.part", "_p.half", "cls", "comp", "b0", "b1")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_across, "a long, b long").distinct()


def _groups(scratch: Scratch, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, cls, group for every row of ``docs``: cls its set's class, group that of its links; both null without a set."""
    small_batches(docs.sparkSession, size=BATCH)  # rows with whole sets
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.save(plain.mapInArrow(_signed(n), "doc_id long, n_shingles long, cls long, bands array<long>, b0 long, b1 long"))
    classes = scratch.save(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.first(F.struct("bands", "b0", "b1")).alias("s")).select("cls", "s.*"))
    banded = classes.select("cls", F.explode("bands").alias("key"), "b0", "b1")
    leads = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("leader")).where("n > 1")  # a hot band's members are combined before they meet
    leads = scratch.save(leads.join(classes.select(F.col("cls").alias("leader"), F.col("b0").alias("l0"), F.col("b1").alias("l1")), "leader"))
    members = scratch.save(meet(banded, leads, "key"))
    scratch.drop(classes, leads)
    near = agreement((F.col("b0"), F.col("b1")), (F.col("l0"), F.col("l1"))) >= AGREE
    pairs = scratch.save(members.where((F.col("cls") != F.col("leader")) & near).select(F.col("leader").alias("a"), F.col("cls").alias("b")).distinct())
    links = confirmed(scratch, plain, rows, pairs, n, percent)
    labels = scratch.save(components(scratch, links))
    more = scratch.save(between_components(scratch, members, labels))
    if more.limit(1).count():
        links = links.union(links_within(scratch, plain, rows, labels, more, n, percent))
        labels = scratch.save(components(scratch, links))
    scratch.drop(members, pairs, more)
    return rows.select("doc_id", "n_shingles", "cls").join(labels.withColumnRenamed("id", "cls"), "cls", "left").select("doc_id", "n_shingles", "cls", F.coalesce("component", "cls").alias("group"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text).

    Rows link where 100 * intersection >= percent * union of their sets of n-word shingles; component_id is the smallest
    doc_id that links reach, kept marks the row that has it. Null, empty and blank texts have no set: n_shingles 0, linked with
    nothing, kept. Rows that repeat a doc_id are documents of their own. Null ids are never the smallest unless alone.
    Other columns are ignored. No rows, no rows.
    """
    own = _groups(Scratch(docs.sparkSession), docs, n, percent)
    low = own.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("low"))
    out = own.join(low, "group", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _with_class(n: int):
    """All columns, and the class of each text's set as a last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch):
                    classes = pa.array([set_class(s) for s in shingle_sets(part.column("text"), n)], pa.int64())
                    yield pa.record_batch([*part.columns, classes], [*part.schema.names, "_cls"])

    return run


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, in its own columns: that with the smallest doc_id (null the last), then the smallest class.

    Rows that repeat an id, null included, are documents of their own: what is decided for one text leaves other texts under
    its id alone, and of rows with equal ids and equal sets one stays. Texts without a set all stay.
    """
    scratch = Scratch(docs.sparkSession)
    own = scratch.save(_groups(scratch, docs, n, percent))
    first = own.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")).alias("low"))
    found = own.join(first, "group", "left").select("doc_id", "cls", (F.col("group").isNull() | (F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("cls") == F.col("low.cls")))).alias("stays"))
    found = scratch.save(found)
    ids = scratch.save(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("stays").alias("stays")).where("n > 1 OR NOT stays").select(F.col("doc_id").alias("_gone"), (F.col("n") > 1).alias("_twice")))
    small = ids.limit(MOST_SENT + 1).count() <= MOST_SENT
    sent = lambda x: F.broadcast(x) if small else x
    by_id = F.col("doc_id").cast("long").eqNullSafe(F.col("_gone"))
    out = docs.join(sent(ids.select("_gone")), by_id, "left_anti")
    twice = ids.where("_twice").select("_gone")
    if not twice.limit(1).count():
        return out
    kept = found.where("stays AND cls IS NOT NULL").join(twice, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_semi").select(F.col("doc_id").alias("_id"), F.col("cls").alias("_kept")).distinct()
    rows = docs.join(sent(twice), by_id, "left_semi")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = rows.mapInArrow(_with_class(n), f"{kind}, _cls long")
    rows = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_cls") == F.col("_kept")), "left").where("_cls IS NULL OR _kept IS NOT NULL")
    rows = rows.withColumn("_row", F.when(F.col("_cls").isNull(), F.monotonically_increasing_id())).dropDuplicates(["doc_id", "_cls", "_row"])
    return out.union(rows.select(*docs.columns))


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` by two-word shingles, with its results for nulls, empty texts and repeated rows."""
    return near_duplicates(docs, n=2)
