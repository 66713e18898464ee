"""Spelling variants, ranked search and main texts of pages against brute force, and their edge cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest

from grovemark.llm import lexical_search as search
from grovemark.llm import spelling
from grovemark.llm import wrapper_induction as pages
from grovemark.llm.dom import parse

# spelling


def edits(a: str, b: str) -> bool:
    """Distance one, by definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_one_edit_and_tries_agree_with_the_definition():
    draw = random.Random(3)
    for _ in range(60):
        words = sorted({"".join(draw.choices("abé", k=draw.randint(1, 7))) for _ in range(draw.randint(1, 60))})
        trie = spelling.Trie.read(*spelling.Trie.of(words, [len(w) * 10 + i for i, w in enumerate(words)]).row())
        asked = words + ["".join(draw.choices("abé", k=draw.randint(1, 8))) for _ in range(30)]
        for word in asked:
            got = list(trie.near(word))
            assert len(got) == len({w for w, _ in got})
            assert sorted(got) == [(w, len(w) * 10 + i) for i, w in enumerate(words) if edits(word, w)]
            assert all(spelling.one_edit(word, w) == edits(word, w) for w in words)


def brute_variants(rows, loses=199, length=6, times=5, ratio=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % loses == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= length and n >= times}
    form, near = {}, {}
    for w, n in counts.items():
        own = [x for x in counts if edits(w, x)]
        near[w] = len(own)
        if own and counts[best := min(own, key=lambda x: (-counts[x], x))] >= ratio * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, near[w], counts.get(form.get(w))) for w, n in counts.items()}


@pytest.mark.parametrize("group, shard", [(16, 1 << 16), (2, 7)])
def test_variants_equal_brute_force(spark, group, shard):
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("aéB", k=draw.randint(5, 8))) for _ in range(60)]
    weights = [5**draw.uniform(0, 4) for _ in vocabulary]
    rows = [(i if i % 17 else None, " ".join(draw.choices(vocabulary, weights, k=draw.randint(0, 80))) + draw.choice(["", " x÷y×z ÀÉ-Āabcdefg", ". Tail"])) for i in range(120)]
    rows += [(5, None), (6, ""), rows[3], rows[3], (7, "abcdefg" * 20_000)]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n long, word string")
    got = spelling.variants(docs, group=group, shard=shard, loses=7, times=2)
    want = brute_variants(rows, loses=7, times=2)
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want) and any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)


def test_variants_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {tuple(r) for r in spelling.variants(docs).collect()}
    assert got == brute_variants([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string")).collect() == []


# search


def brute_search(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, t) for i, text in docs if (t := split(text))]
    n, total = len(held), sum(len(t) for _, t in held)
    df = Counter(t for _, own in held for t in set(own))
    out = []
    for item, text in items:
        scores = []
        for doc_id, own in held:
            tf, m = Counter(own), 25 + (75 * len(own) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in split(text) if tf[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if none else doc_id, -score) for rank, (score, none, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark):
    draw = random.Random(8)
    words = ["Äpfel", "ape", "APE", "bee", "c1", "d_e", "ÿ", "zoo", "rare", "q"]
    text = lambda n: draw.choice([" ", "\n", "-", "\x7f"]).join(draw.choices(words, [2, 9, 1, 5, 4, 3, 2, 9, 0.2, 1], k=n))
    docs = [(i if i % 13 else None, text(draw.randint(0, 30))) for i in range(300)]
    docs += [(7, None), (8, "... "), docs[4], docs[4], (9, "ape " * 50_000)]
    items = [(i, text(draw.randint(1, 12))) for i in range(12)] + [(3, "bee bee bee zoo"), (3, "bee bee bee zoo"), (20, None), (21, "!"), (None, "ape rare"), (22, "unheard")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score long").repartition(3)
    q = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, rank int")
    want = brute_search(docs, items)
    assert sorted((tuple(r) for r in search.search(d, q).collect()), key=str) == want
    assert sorted((tuple(r) for r in search.search(d, q, group=100).collect()), key=str) == want


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs, items).collect() == []
    assert search.search(items.select(items.item_id.alias("doc_id"), "text"), items.where("false")).collect() == []


def test_slices_add_and_select():
    draw = random.Random(1)
    for _ in range(80):
        size = draw.randint(1, 40)
        a, b, shift = [draw.choice([0, draw.randint(0, 900)]) for _ in range(size)], [draw.randint(0, 70) for _ in range(size)], draw.randint(0, 3)
        slices = lambda xs: [sum((x >> i & 1) << d for d, x in enumerate(xs)) for i in range(10)]
        total = slices(a)
        search.add(total, slices(b), shift)
        sums = [x + (y << shift) for x, y in zip(a, b, strict=True)]
        assert [sum((s >> d & 1) << i for i, s in enumerate(total)) for d in range(size)] == sums
        k = draw.randint(1, 12)
        want = sorted((d for d in range(size) if sums[d]), key=lambda d: (-sums[d], d))[:k]
        assert sorted(search.best(total, k)) == sorted(want)


def test_terms():
    assert search.terms("Ab_c Äö-1\x7fZ  é") == [x.encode() for x in ("ab", "c", "Äö", "1", "z", " é")]
    assert search.terms(None) == []


# pages


def site(body: str, i: int) -> str:
    return f'<html><head><title>t{i}</title></head><body><div><ul><li><a href="/{i}">go {i}</a><li><a href="/x">up {i}</a></ul></div><div>Our house style since 1990</div><div class=story>{body}<div>All rights kept by the house.</div></div><div>Terms and more</div></body></html>'


def test_constant_blocks_are_template_and_varying_ones_content(spark):
    rows = [(i, f"http://A.example/{i}", site(f"<h2>Head {i}</h2><p>Text {i} &amp; more<br>line<p>Another {i * i}", i), 0) for i in range(12)]
    rows += [(50, "http://b.example/", site("<p>lone", 1), 0), (51, None, None, 0), (52, "http://a.example:80/z", "", 0), (None, "nowhere", "<p>x &lt; y", 0), rows[0]]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(5)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    for i in range(12):
        assert by[i] == f"Head {i}\n\nText {i} & more line\n\nAnother {i * i}"
    assert "lone" in by[50] and by[51] == "" == by[52] and by[None] == "x < y"
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(i, "http://a.example/", "<body><div><p>The same words on each page</div>") for i in range(30)]
    assert {r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"The same words on each page"}


def test_pages_of_the_tables_are_their_articles(spark):
    import html

    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in pages.extract(table).collect()}
    for r in table.collect():
        inside = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", inside))
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_pages_of_nothing(spark):
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize(
    "markup, text",
    [
        ("<p>a<p>b", "a\n\nb"),
        ("x &amp; y &lt z &#233; &nbsp;w", "x & y < z é w"),
        ("<nav>m</nav><header>h</header><main><header><h1>T</h1></header><p>t</main><aside>s</aside><footer>f</footer>", "T\n\nt"),
        ("<article>a<div class='comment-list'>c</div><form>f</form><div class=article-header>k</div></article><p>rest", "a\n\nk"),
        ("<form><article>in a form</article></form>", "in a form"),
        ("<div id=cookie-notice>c</div><div class='adSlot'>a</div><div class=shadow>s</div>", "s"),
        ("<script>'<p>'</script><style>p{}</style><!-- <p>no --> yes <template>t</template>", "yes"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>d<td>e</table>", "a\n\nb\n\nc\n\nd\n\ne"),
        ("</p></div>stray", "stray"),
        ("<p title='1>0'>q</p><b", "q"),
        ("<div>" * 500 + "deep" + "</div>" * 500 + "after", "deep\n\nafter"),
        ("a <b>b</b>c <a href=x>d</a>", "a bc d"),
    ],
)
def test_markup(markup, text):
    assert pages.main_text(markup) == text


def test_odd_and_long_markup_is_read_in_linear_time():
    for odd in ("<a \"'" * 100_000, "<" * 300_000, "<!--" * 50_000, "<p class='" * 50_000, "<div><p>" * 20_000, "<title>" * 20_000):
        parse(odd)


def wide(n: int) -> str:
    return "<body>" + "".join(f"<div class=c{i % 3}><b>x</b><ul><li>{i}</ul></div>" for i in range(n))


def test_matching_is_the_largest_in_order():
    a, b = (pages.skeleton(parse(wide(n))).kids[0].kids for n in (40, 25))
    pairs = pages.matched(a, b)
    assert len(pairs) == 25 and all(a[i].sig == b[j].sig for i, j in pairs) and pairs == sorted(pairs)
    draw = random.Random(2)
    for _ in range(50):
        left, right = ([pages.Slot(draw.choice("xyz")).seal() for _ in range(draw.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x.sig == y.sig))
        assert len(pages.matched(left, right)) == best[-1][-1]


def test_wrappers_aligned_in_groups_hold_all_pages(spark):
    from grovemark.llm.common import Scratch

    rows = [("h", site(f"<p>{i}", i)) for i in range(60)] + [("k", "<p>1")]
    got = pages.wrappers(Scratch(spark), spark.createDataFrame(rows, "host string, text string").repartition(23), fan=3).collect()
    assert {(r["host"], r["n"]) for r in got} == {("h", 60), ("k", 1)}
    assert len(pages.prune(pages.skeleton(parse(wide(2000))), 100).kids) <= 100


# connected components


def test_components_equal_brute_force(spark):
    from grovemark.llm.common import Scratch, components

    draw = random.Random(11)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5000 + i, 4999) for i in range(300)] + [(4999, 5400)]
    some = [(draw.randint(0, 120), draw.randint(0, 120)) for _ in range(70)]
    edges = [*chain[::-1], *star, *some, *some[:10], (None, 3), (7, None), (9, 9)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    scratch = Scratch(spark)
    got = components(scratch, spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == label and len(got) == len(label)
    assert components(scratch, spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
