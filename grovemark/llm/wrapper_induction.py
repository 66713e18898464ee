"""Main texts of web pages by wrapper induction.

Each page is a tree of blocks. The trees of a host's pages are aligned by simple tree matching, one after the other, into the host's
wrapper: a tree of slots, each with the number of pages that have it, its most frequent texts, and how much of it is links. Slots
whose text is the same on most pages are template, varying ones are content; lists of links outside an article are not.
Markup tells the rest: menus, forms, notices, adverts and comments vary from page to page but are named by their tags and classes.

Tasks align the pages they read and send one wrapper a host, so that a host with a third of all pages is no hot group;
wrappers of a host are aligned with one another in rounds of bounded groups. Each page is then aligned with its host's wrapper.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .dom import BLOCK, HARD, HEADER, KEEP, SOFT, Element, main_roots, parse
from .packing import slices

#: Slots of a wrapper: beyond these, the rarest go (they vary, as slots that no wrapper has). Texts counted for a slot.
SLOTS, TEXTS = 512, 3
#: Pages that make a wrapper; shares of the pages, of the slot's texts, and of its letters in links that make a template.
PAGES, OFTEN, SAME, LINKS = 5, 0.5, 0.5, 0.5
#: Hosts that a task holds, wrappers of a host that one group aligns, bytes of wrappers that are broadcast.
HOSTS, FAN, BROADCAST = 2000, 64, 8 << 20
#: Blocks of an article that are never template, even if all pages have them.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
PARTIAL = "host string, part long, n long, wrapper string"


class Slot:
    """A block of a page or wrapper, without what markup drops. Adjacent blocks without blocks inside are one slot if they have one signature."""

    __slots__ = ("sig", "kids", "n", "votes", "chars", "linked", "shape", "elements", "fixed")

    def __init__(self, sig: str, n: int = 1):
        self.sig, self.n, self.kids, self.votes, self.chars, self.linked, self.elements, self.fixed = sig, n, [], {}, 0, 0, [], False

    def seal(self) -> Slot:
        self.shape = hash((self.sig, *[k.shape for k in self.kids]))
        return self


def own_text(x: Element) -> tuple[str, int]:
    """(what a block says outside the blocks in it, letters of it in links)."""
    parts: list[str] = []
    linked = 0

    def walk(y: Element, in_link: bool) -> None:
        nonlocal linked
        for kid in y.kids:
            if isinstance(kid, str):
                parts.append(kid)
                linked += in_link * len(kid.strip())
            elif kid is None:
                parts.append(" ")
            elif kid.tag not in BLOCK and kid.seen == KEEP:
                walk(kid, in_link or kid.tag == "a")

    walk(x, False)
    return " ".join("".join(parts).split()), linked


def skeleton(root: Element) -> Slot:
    """The page as slots."""

    def blocks(x: Element, in_article: bool) -> Iterator[tuple[Element, bool]]:
        for kid in x.kids:
            if isinstance(kid, Element):
                if kid.tag in BLOCK:
                    yield kid, in_article
                elif kid.seen == KEEP:
                    yield from blocks(kid, in_article)

    def slot(x: Element, in_article: bool) -> Slot:
        out = Slot(x.sig)
        out.elements.append(x)
        if x.seen == HARD or x.seen == SOFT or x.seen == HEADER and not in_article:
            return out.seal()
        in_article = in_article or x.part != ""
        out.fixed = in_article and x.tag in PROSE
        text, out.linked = own_text(x)
        if text:
            out.chars, out.votes = len(text), {zlib.crc32(text.encode("utf-8", "replace")): 1}
        for kid, inside in blocks(x, in_article):
            new = slot(kid, inside)
            last = out.kids[-1] if out.kids else None
            if last is not None and last.sig == new.sig and not last.kids and not new.kids:
                last.elements += new.elements
                last.chars += new.chars
                last.linked += new.linked
                if new.votes:
                    last.votes = {zlib.crc32(repr((*last.votes, *new.votes)).encode()): 1}
            else:
                out.kids.append(new)
        return out.seal()

    return slot(root, False)


_scores: dict[tuple[int, int], int] = {}
_pairs: dict[tuple, list[tuple[int, int]]] = {}


def _score(a: Slot, b: Slot) -> int:
    """Simple tree matching: the most nodes that two trees share if matched nodes have matched parents and keep their order."""
    if a.sig != b.sig:
        return 0
    key = (a.shape, b.shape)
    if (found := _scores.get(key)) is None:
        if len(_scores) > 100_000:
            _scores.clear()
        found = _scores[key] = 1 + int(_table(a.kids, b.kids)[-1][-1])
    return found


def _table(left: list[Slot], right: list[Slot]) -> np.ndarray:
    """Best matches of all beginnings of two lists of trees; equal trees are compared once."""
    best = np.zeros((len(left) + 1, len(right) + 1), np.int64)
    rows: dict[int, np.ndarray] = {}
    for i, a in enumerate(left, 1):
        if a.shape not in rows:
            seen = {b.shape: _score(a, b) for b in {b.shape: b for b in right}.values()}
            rows[a.shape] = np.fromiter((seen[b.shape] for b in right), np.int64, len(right))
        best[i, 1:] = np.maximum.accumulate(np.maximum(best[i - 1, 1:], best[i - 1, :-1] + rows[a.shape]))
    return best


def matched(left: list[Slot], right: list[Slot]) -> list[tuple[int, int]]:
    """The pairs (place in left, place in right) of a best matching, ascending."""
    key = (tuple(a.shape for a in left), tuple(b.shape for b in right))
    if key[0] == key[1]:
        return [(i, i) for i in range(len(left))]
    if (found := _pairs.get(key)) is None:
        if len(_pairs) > 5_000:
            _pairs.clear()
        best, found = _table(left, right), []
        i, j = len(left), len(right)
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i, j))
        found.reverse()
        _pairs[key] = found
    return found


def join(a: Slot, b: Slot) -> Slot:
    """Aligns ``b`` with ``a``, into ``a``: counts of matched slots add up, the others keep their places between them."""
    a.n, a.chars, a.linked = a.n + b.n, a.chars + b.chars, a.linked + b.linked
    votes = dict(a.votes)
    for k, v in b.votes.items():
        votes[k] = votes.get(k, 0) + v
    if len(votes) > TEXTS:  # a summary of frequent texts that can be added to others
        top = sorted(votes.items(), key=lambda x: (-x[1], x[0]))
        votes = {k: v - top[TEXTS][1] for k, v in top[:TEXTS] if v > top[TEXTS][1]}
    a.votes = votes
    kids, i, j = [], 0, 0
    for x, y in [*matched(a.kids, b.kids), (len(a.kids), len(b.kids))]:
        kids += a.kids[i:x] + b.kids[j:y]
        if x < len(a.kids):
            kids.append(join(a.kids[x], b.kids[y]))
        i, j = x + 1, y + 1
    a.kids, a.elements = kids, []
    return a.seal()


def prune(root: Slot, most: int = SLOTS) -> Slot:
    """Without the slots that fewest pages have, if there are more than ``most``; a slot goes with what is in it."""
    sizes: list[int] = []

    def count(x: Slot) -> None:
        sizes.append(x.n)
        for k in x.kids:
            count(k)

    count(root)
    if len(sizes) > most:
        least = sorted(sizes, reverse=True)[most]

        def cut(x: Slot) -> Slot:
            x.kids = [cut(k) for k in x.kids if k.n > least]
            return x.seal()

        cut(root)
    return root


def written(x: Slot) -> str:
    plain = lambda s: [s.sig, s.n, s.chars, s.linked, list(s.votes.items()), [plain(k) for k in s.kids]]
    return json.dumps(plain(x))


def read(s: str) -> Slot:
    def slot(x: list) -> Slot:
        out = Slot(x[0], x[1])
        out.chars, out.linked, out.votes, out.kids = x[2], x[3], dict(map(tuple, x[4])), [slot(k) for k in x[5]]
        return out.seal()

    return slot(json.loads(s))


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId() << 24, 0
    held: dict[str, Slot] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, part + made, w.n, written(prune(w))) for h, w in sorted(held.items())]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True)], ["host", "part", "n", "wrapper"])

    for batch in batches:
        for rows in slices(batch):
            for host, text in zip(rows.column("host").to_pylist(), rows.column("text").to_pylist(), strict=True):
                page = skeleton(parse(text))
                known = held.get(host)
                held[host] = page if known is None else join(known, page)
                if known is not None and known.n % 64 == 0:
                    prune(held[host], 2 * SLOTS)
            if len(held) > HOSTS:
                yield out()
                held, made = {}, made + 1
    if held:
        yield out()


def _align(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["part", "wrapper"])
    trees = [read(w) for w in rows["wrapper"]]
    for other in trees[1:]:
        join(trees[0], other)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "part": [int(rows["part"].iloc[0])], "n": [int(rows["n"].sum())], "wrapper": [written(prune(trees[0]))]})


def wrappers(scratch: Scratch, pages: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, n, wrapper) of all hosts of ``pages`` (host, text); pages without text or host make none."""
    held = scratch.save(pages.where("host <> '' AND text <> ''").select("host", "text").mapInArrow(_induce, PARTIAL))
    while True:
        place = held.withColumn("place", F.expr("row_number() OVER (PARTITION BY host ORDER BY part, wrapper) - 1"))
        most = held.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return held.select("host", "n", "wrapper")
        new = scratch.save(place.groupBy("host", F.floor(F.col("place") / fan).alias("g")).applyInPandas(_align, PARTIAL))
        scratch.drop(held)
        held = new


def settle(root: Slot) -> dict[int, str]:
    """What the slots of a wrapper are, by their place in pre-order: the text's digest of template, or "" of a list of links."""
    out: dict[int, str] = {}
    at, pages = -1, root.n

    def walk(x: Slot) -> None:
        nonlocal at
        at += 1
        if pages >= PAGES and x.n > OFTEN * pages:
            text, n = max(x.votes.items(), key=lambda v: v[1], default=(None, 0))
            if n > SAME * x.n:
                out[at] = str(text)
            elif x.linked > LINKS * x.chars:
                out[at] = ""
        for k in x.kids:
            walk(k)

    walk(root)
    return out


_settled: dict[str, tuple[Slot, list[Slot], dict[int, str]]] = {}


def _wrapper(s: str) -> tuple[Slot, dict[int, str]]:
    if (found := _settled.get(s)) is None:
        if len(_settled) > HOSTS:
            _settled.clear()
        root = read(s)
        places: dict[int, int] = {}

        def number(x: Slot) -> None:
            places[id(x)] = len(places)
            for k in x.kids:
                number(k)

        number(root)
        what = settle(root)
        found = _settled[s] = (root, {k: what[v] for k, v in places.items() if v in what})
    return found


def template_of(page: Slot, wrapper: str | None) -> set[int]:
    """ids of the page's elements whose own text is template, or a list of links, by the host's wrapper."""
    out: set[int] = set()
    if wrapper is None:
        return out
    root, what = _wrapper(wrapper)

    def walk(a: Slot, b: Slot) -> None:
        decided = what.get(id(a))
        if decided is not None and not b.fixed and (decided == "" or decided in map(str, b.votes)):
            out.update(id(e) for e in b.elements)
        for i, j in matched(a.kids, b.kids):
            walk(a.kids[i], b.kids[j])

    if root.sig == page.sig:
        walk(root, page)
    return out


def blocks_of_text(root: Element, template: set[int], in_article: bool = False) -> list[str]:
    """The texts of the blocks below ``root`` that neither markup nor ``template`` drops."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(text)

    def walk(x: Element, silent: bool, in_article: bool) -> None:
        for kid in x.kids:
            if isinstance(kid, str):
                if not silent:
                    parts.append(kid)
            elif kid is None:
                flush()
            elif kid.seen in (HARD, SOFT) or kid.seen == HEADER and not in_article:
                if kid.tag in BLOCK:
                    flush()
            elif kid.tag in BLOCK:
                flush()
                walk(kid, id(kid) in template, in_article or kid.part != "")
                flush()
            else:
                walk(kid, silent, in_article)

    walk(root, id(root) in template, in_article)
    flush()
    return out


def main_text(text: str | None, wrapper: str | None = None) -> str:
    """The main text of one page, given its host's wrapper. Where the wrapper takes all that markup leaves (a page of which the host
    has mostly copies), markup decides alone."""
    page = parse(text or "")
    roots = main_roots(page)
    for template in (template_of(skeleton(page), wrapper), set()):
        out = [b for r in roots for b in blocks_of_text(r, template, r is not page)]
        if out or not template:
            break
    return "\n\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch):
            texts = [main_text(t, w).encode("utf-8", "replace").decode() for t, w in zip(rows.column("text").to_pylist(), rows.column("wrapper").to_pylist(), strict=True)]
            yield pa.record_batch([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html): the main text, its blocks joined by an empty line.

    White space inside a block is one space, character references are decoded. A null or empty html has an empty text; a null url
    or one without a host is read by markup alone, as are hosts with fewer than PAGES pages. Rows that repeat, null ids and repeated
    ids each have their row; no rows, no rows; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("text"), host.alias("host"))
    made = scratch.save(wrappers(scratch, rows).where(F.col("n") >= PAGES).select("host", "wrapper"))
    size = made.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    # beyond the bound pages meet their wrappers by an exchange, in which adaptive execution splits a hot host
    joined = rows.join(F.broadcast(made) if size <= BROADCAST else made.hint("merge"), "host", "left")
    return joined.select("page_id", "url", "text", "wrapper").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
