"""HTML texts as trees of elements, and which elements are no main text by their markup alone."""

from __future__ import annotations

import html
import re

#: Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
) | RAW
CLOSES_P = BLOCK - frozenset("html head body td th tr tbody thead tfoot caption option optgroup legend summary title".split())
P, BEYOND_P = frozenset(["p"]), BLOCK - CLOSES_P | {"button"}
#: What a start tag ends if it is open, and what it must not look beyond.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tr td th", "table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Never main text, wherever they stand.
NEVER = frozenset("head script style title noscript template iframe noembed noframes svg canvas object audio video map nav aside footer menu dialog form button input select textarea option datalist label".split())
#: No main text by a word of their class, id or role, unless ``EXCEPT`` names them; ``header`` only outside an article.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login popup modal overlay paywall sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager topbar toolbar footer comment comments commentlist respond disqus replies discussion related recommended recommendations share sharing social widget widgets skip copyright search contentinfo complementary".split()
)
EXCEPT = frozenset("with without no has".split())
OWN_HEADER = frozenset("article post entry story content section".split())
DEPTH = 64
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)/?>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: How an element is seen: KEEP, SOFT (dropped by its name), HEADER (dropped outside an article), HARD (dropped by its tag).
KEEP, SOFT, HEADER, HARD = range(4)


class Element:
    """kids: texts, elements, and None where a block's border is all that is left of an element."""

    __slots__ = ("tag", "sig", "seen", "part", "kids")

    def __init__(self, tag: str, sig: str, seen: int):
        self.tag, self.sig, self.seen, self.kids = tag, sig, seen, []
        self.part = sig.split(".", 1)[0] if sig.startswith(("article.", "main.")) else ""


_looks: dict[tuple[str, str], tuple[str, int]] = {}


def look(tag: str, attributes: str) -> tuple[str, int]:
    """(signature, how it is seen). The signature is the tag with class and id without digits."""
    key = (tag, attributes)
    if (found := _looks.get(key)) is None:
        named = {k.lower(): a or b or c for k, a, b, c in NAMED.findall(attributes)}
        own = {x.lower() for v in named.values() for x in PARTS.findall(v)}
        if tag in NEVER:
            seen = HARD
        elif tag in ("html", "body", "main", "article") or own & EXCEPT:
            seen = KEEP
        elif own & WORDS:
            seen = SOFT
        else:
            seen = HEADER if (tag == "header" or own & {"header", "masthead"}) and not own & OWN_HEADER else KEEP
        part = "main" if named.get("role", "").lower() == "main" else tag
        sig = f"{part}." + re.sub(r"\d+", "", f"{' '.join(sorted(named.get('class', '').split()))}#{named.get('id', '')}")[:120]
        if len(_looks) > 20_000:
            _looks.clear()
        found = _looks[key] = (sig, seen)
    return found


def parse(text: str) -> Element:
    """The tree of a whole text, however broken its markup is.

    Open paragraphs, items and cells end where HTML ends them; end tags without a start are ignored. Elements deeper than DEPTH
    are laid into the one above them, with a border where they are blocks. Texts have their character references decoded.
    """
    root = Element("html", "html", KEEP)
    stack, deep, at, unclosed = [root], {}, 0, set()

    def cut(down_to: int) -> None:
        del stack[down_to:]
        deep.clear()

    def add_text(lo: int, hi: int) -> None:
        if lo < hi:
            s = text[lo:hi]
            stack[-1].kids.append(html.unescape(s) if "&" in s else s)

    def opened(tags: frozenset, beyond: frozenset) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in beyond:
                return 0
        return 0

    while m := TAG.search(text, at):
        add_text(at, m.start())
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if deep.get(tag):
                deep[tag] -= 1
                stack[-1].kids.append(None if tag in BLOCK else "")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    cut(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK or tag in ("p", "li") and stack[i].tag in ("div", "section", "article", "table", "ul", "ol"):
                    break
            continue
        if tag in CLOSES_P and (i := opened(P, BEYOND_P)):
            cut(i)
        if tag in ENDS and (i := opened(*ENDS[tag])):
            cut(i)
        if tag in ("html", "body") and any(x.tag == tag for x in stack[1:]):
            continue
        if tag == "body" and (i := opened(frozenset(["head"]), frozenset())):
            cut(i)
        element = Element(tag, *(look(tag, attributes) if tag in BLOCK or tag in NEVER or tag != "a" and NAMED.search(attributes) else (tag, KEEP)))
        if tag in VOID:
            stack[-1].kids.append(" " if tag == "br" else element)
            continue
        if tag in RAW and tag not in unclosed:
            close = re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I).search(text, at)
            if close or tag in ("script", "style"):
                stack[-1].kids.append(element)
                at = close.end() if close else len(text)
                continue
            unclosed.add(tag)
        if len(stack) >= DEPTH:
            deep[tag] = deep.get(tag, 0) + 1
            stack[-1].kids.append(None if tag in BLOCK else "")
            continue
        stack[-1].kids.append(element)
        stack.append(element)
    add_text(at, len(text))
    return root


def main_roots(root: Element) -> list[Element]:
    """The elements that hold the main text by name: articles that lie in nothing dropped, else ``main``, else the whole page.

    Articles that only a dropped wrapper holds (a form around the page) count if there are no others.
    """
    found: dict[str, list[Element]] = {"article": [], "main": [], "wrapped": []}

    def walk(x: Element, wrapped: bool) -> None:
        for kid in x.kids:
            if isinstance(kid, Element):
                hidden = wrapped or kid.seen in (SOFT, HEADER) or kid.tag == "form"
                if kid.seen == HARD and kid.tag != "form":
                    continue
                if kid.part == "article":
                    found["wrapped" if hidden else "article"].append(kid)
                    continue
                if kid.part == "main" and not hidden:
                    found["main"].append(kid)
                walk(kid, hidden)

    walk(root, False)
    return found["article"] or found["main"][:1] or found["wrapped"] or [root]
