"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks of text at block-level tags. A block has its word count and link density, those of
the blocks before and after it, whether it and they are headings, and where they stand: inside boilerplate, inside a
form, outside the page's content containers, in a page without any, or inside one. A decision tree, grown from the
small labelled pages below, says which blocks are main text.

Names in class, id and role count only as whole names: every word of one must be a boilerplate or a general word, so
``cookie-banner`` is boilerplate and ``notice-board`` is not; headings, paragraphs and other leaves are judged by fewer
words, and never by their id. Time is linear in the page, also for broken markup.

Defined results: null or empty html gives empty text; unclosed tags, comments and scripts end at the end of
the page; a stray ``<`` is text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OWN = ("words", "links", "place", "heading")
FEATURES = (*_OWN, *(f"{x}_before" for x in _OWN), *(f"{x}_after" for x in _OWN))
BOILERPLATE, FORM, OUTSIDE, NEUTRAL, CONTENT = range(-2, 3)

#: Labelled pages. {n} stands for n words; a block whose first word has a + is main text.
LABELLED = (
    # an article among menus, adverts and a footer
    "<nav><ul><li><a>{1}</a><li><a>{1}</a><li><a>{2}</a></ul></nav><div class=ad>{8}</div><article><h1>+{9}</h1><p>+{80}</p><p>+{12}</p><p>+{146} <a>{4}</a></p><h2>+{3}</h2><p>+{59} <a>{1}</a></p><p>+{1}</p><p>+{1} <a>{3}</a></p></article><div class=promo>{12}</div><footer><a>{6}</a></footer>",
    "<div class=cookie-banner>{30}</div><main><h1>+{6}</h1><p>+<a>{2}</a></p><p>+{45}</p><p>+{18} <a>{12}</a></p><h2>+{5}</h2><p>+<a>{5}</a></p><p>+{20}</p><p>+{10} <a>{8}</a></p><h3>+{2}</h3><ul><li>+{2}</li><li>+{3}</li></ul><p>+{200}</p></main><aside>{12} <a>{3}</a></aside><div id=comments>{120}</div>",
    "<header><a>{2}</a><ul><li><a>{2}</a></ul></header><article><h1>+{11}</h1><p>+{23} <a>{2}</a></p><p>+{1}</p><p>+{90}</p><p>+<a>{3}</a></p><blockquote>+{40}</blockquote></article><section class=comments><p>{60}</p><p>{90}</p><p>{70}</p></section><footer><p>{9}</p><p>{2} <a>{2}</a></p></footer>",
    "<div class=notice>{60}</div><article><h1>+{2}</h1><p>+<a>{2}</a></p><p>+{11} <a>{1}</a></p><p>+{3} <a>{3}</a></p><p>+{12} <a>{3}</a></p><p>+<a>{1}</a></p><p>+{70}</p></article><div class=sidebar>{200}</div>",
    "<article><h1>+{4}</h1><p>+{200}</p><p>+{3}</p><p>+{1}</p></article>",
    "<article><h1>+{3}</h1><p>+{30}</p><p>+{5}</p></article>",
    "<main><h1>+{6}</h1><p>+{70}</p><p>+{8}</p></main>",
    "<article><p>+{50}</p><p>+{2}</p></article><footer><a>{2}</a></footer>",
    "<header><h2>{2}</h2></header><article><h1>+{6}</h1><p>+{40}</p><p>+{25}</p></article><footer><a>{4}</a></footer>",
    "<nav><h3>{1}</h3><a>{2}</a></nav><main><h1>+{5}</h1><p>+{60}</p><h2>+{2}</h2><p>+{30}</p></main><nav><a>{5}</a></nav>",
    "<div class=sidebar><h2>{3}</h2></div><article><h1>+{8}</h1><p>+{35}</p><p>+{7}</p></article><div class=related><a>{6}</a></div>",
    # boxes inside an article
    "<article><h1>+{5}</h1><p>+{40}</p><div class=ad>{7}</div><p>+{60}</p><div class=newsletter><h3>{2}</h3><p>{18}</p></div><p>+{30}</p><form><p>{6}</p><button>{1}</button></form><p>+{25}</p></article>",
    "<main><h1>+{6}</h1><div class=ad>{30}</div><p>+{55}</p><aside><h2>{7}</h2><p>{40}</p></aside><p>+{80}</p><div class=promo>{9}</div><h2>+{3}</h2><p>+{45}</p><div class=share>{4}</div></main>",
    "<div class=sidebar><h3>{2}</h3><p>{20}</p><h3>{6}</h3><p>{9}</p></div><article><h1>+{5}</h1><p>+{60}</p><p>+{2}</p></article><footer><h4>{1}</h4><a>{2}</a><h4>{7}</h4><p>{12}</p></footer>",
    "<nav><h2>{1}</h2><h2>{6}</h2><a>{3}</a></nav><main><h1>+{4}</h1><p>+{35}</p><p>+{3}</p></main>",
    "<article><h1>+{3}</h1><p>+{90}</p><p>+{2}</p></article>",
    "<div class=widget><h2>{6}</h2></div><div class=widget><h2>{7}</h2><p>{8}</p></div><article><h2>+{4}</h2><p>+{40}</p></article><div class=widget><h2>{6}</h2><a>{2}</a></div>",
    "<nav><a>{3}</a></nav><aside><h2>{5}</h2></aside><article><p>+{50}</p><p>+{30}</p></article>",
    "<header><a>{2}</a><h2>{6}</h2></header><main><p>+{44}</p><h2>+{4}</h2><p>+{20}</p></main><footer><a>{3}</a><h3>{2}</h3></footer>",
    # runs of links inside an article: tables of contents, related links, tags
    "<nav><a>{5}</a></nav><article><h1>+{7}</h1><p>+{50}</p><ul><li><a>{2}</a><li><a>{2}</a><li><a>{3}</a><li><a>{5}</a></ul><p>+{65}</p><ul><li><a>{6}</a><li><a>{7}</a><li><a>{4}</a><li><a>{8}</a></ul></article><footer>{9}</footer>",
    "<main><h1>+{10}</h1><p>+{80}</p><ul><li><a>{3}</a><li><a>{4}</a><li><a>{3}</a></ul></main><footer><a>{3}</a></footer>",
    "<article><h1>+{9}</h1><p>+{85} <a>{5}</a></p><p>+{60}</p><div><p><a>{5}</a></p><p><a>{6}</a></p><p><a>{3}</a></p></div><p>+{40}</p></article>",
    # text outside the content of a page that has some: titles, teasers, comments, notices, after link lines or not
    "<nav><a>{3}</a></nav><h1>+{8}</h1><div class=content><p>+{12}</p><p>+{60}</p><p>+{44}</p></div><h3>{5}</h3><p>{40}</p><p>{34} <a>{1}</a></p><p><a>{12}</a></p><footer><p>{4} <a>{2}</a></p></footer>",
    "<p>{30}</p><p><a>{4}</a></p><main><h1>+{9}</h1><p>+{70}</p><p>+{120}</p></main><p>{2}</p><p>{25}</p><p>{60}</p><p>{18}</p><p><a>{3}</a></p><footer>{7}</footer>",
    "<p><a>{2}</a></p><h1>+{6}</h1><article><p>+{50}</p><p>+{30}</p></article><p>{7} <a>{7}</a></p><p>{80}</p><footer>{9}</footer>",
    "<p><a>{5}</a></p><h1>+{12}</h1><div class=entry><p>+{35}</p><p>+{3}</p></div><p>{1}</p><p>{100}</p><p>{70}</p><footer><a>{2}</a></footer>",
    "<p>{9}</p><p>{9} <a>{6}</a></p><p><a>{3}</a></p><article><h1>+{8}</h1><p>+{66}</p></article><p>{45}</p><p>{8}</p>",
    "<p><a>{2}</a></p><p>{4}</p><p><a>{1}</a></p><p>{14}</p><article><h1>+{7}</h1><p>+{40}</p><p>+{22}</p></article><p><a>{1}</a></p><p>{3}</p><p><a>{2}</a></p><p>{35}</p>",
    "<article><h1>+{5}</h1><p>+{90}</p></article><h2>{1}</h2><div class=thread><p><a>{2}</a></p><p>{5}</p><p><a>{2}</a></p><p>{40}</p><p><a>{1}</a></p><p>{90}</p></div>",
    "<article><h1>+{6}</h1><p>+{45}</p><p>+{70}</p></article><h2>{3}</h2><p><a>{6}</a></p><h3><a>{5}</a></h3><p>{16}</p><h3><a>{4}</a></h3><p>{20}</p>",
    "<h2>{2}</h2><p>{20}</p><h3><a>{6}</a></h3><p>{15}</p><main><h1>+{7}</h1><p>+{55}</p><h2>+{3}</h2><p>+{80}</p></main><h2>{2}</h2><p>{30}</p>",
    "<article><h1>+{7}</h1><p>+{60}</p></article><h2>{7}</h2><p>{30}</p><h3>{9}</h3><p>{22}</p>",
    "<h2>{8}</h2><p>{20}</p><h2>{6}</h2><p>{14}</p><main><h1>+{5}</h1><p>+{50}</p></main><h2>{9}</h2><p><a>{4}</a></p>",
    "<h1>+{7}</h1><article><p>+{40}</p><p>+{16}</p></article>",
    "<p>{6}</p><h1>+{8}</h1><div class=content><p>+{70}</p></div><p>{20}</p>",
    "<p>{2}</p><h1>+{3}</h1><main><p>+{33}</p></main>",
    # pages without containers
    "+{3}",
    "<p>+{5}</p>",
    "<h1>+{1}</h1>",
    "<h1>+{6}</h1><p>+{50}</p><p>+{22}</p><h2>{2}</h2><p><a>{2}</a></p><p>{26}</p><p><a>{2}</a></p><p>{19}</p>",
    "<h1>+{5}</h1><p>+{36}</p><p>+{60}</p><h3>{1}</h3><div><a>{1}</a><p>{30}</p></div><div><a>{2}</a><p>{44}</p></div><div><a>{2}</a><p>{60}</p></div>",
    "<p><a>{2}</a></p><p><a>{2}</a></p><p><a>{3}</a></p><h1>+{3}</h1><p>+{40}</p><p>+{50}</p><p>+{60}</p><p><a>{4}</a></p><p>{6} <a>{24}</a></p><p><a>{2}</a></p>",
    "<a>{1}</a><hr><a>{2}</a><hr><h1>+{5}</h1><p>+{50}</p><p>+{23} <a>{2}</a></p><p>+{90}</p><p>+{70}</p><p>+{72} <a>{8}</a></p><p>+{12}</p><p><a>{2}</a></p><p>{2}</p><p><a>{3}</a></p><p><a>{2}</a></p>",
    "<h1>+{8}</h1><p>+{40}</p><p>+{35}</p><p>+{16}</p><h2>+{3}</h2><p>+{30}</p><p>+{45}</p><p><a>{6}</a></p><p><a>{5}</a></p><p><a>{4}</a></p>",
    "<h1>+{9}</h1><p>+{12}</p><p>+{14}</p><p>+{14} <a>{6}</a></p><p>+{45}</p><p>{1} <a>{4}</a></p><p><a>{4}</a></p><p>+{60}</p><p>{2} <a>{16}</a></p>",
    "+{13}",
    "<div>+{35}</div><div>+{4}</div><div>+{11}</div><div>+{13}</div>",
    "<p><a>{5}</a></p><h1>+{6}</h1><p>+{60}</p><p>{3} <a>{9}</a></p><p>{2} <a>{8}</a></p><p><a>{8}</a></p><p><a>{3}</a></p><p>{4}</p><p><a>{2}</a></p>",
    "<h1>+{4}</h1><p>+{60}</p><h2>+{2}</h2><p>+{72} <a>{8}</a></p><p>{2} <a>{1}</a></p><p><a>{4}</a></p>",
    "<h1>+{6}</h1><p>+{70}</p><p>+{30}</p><h3>{1}</h3><div><p><a>{2}</a></p><p>{14}</p></div><div><p><a>{2}</a></p><p>{30}</p></div><div><p><a>{1}</a></p><p>{8}</p></div>",
    "<h1>+{7}</h1><p>+{34}</p><h2>+{2}</h2><p>+{50}</p><p>+{25}</p><p><a>{2}</a></p><p>{21}</p><p><a>{2}</a></p><p>{45}</p><p>{3}</p>",
    "<h1>+{5}</h1><h2>+<a>{4}</a></h2><p>+{60}</p><p>+{40}</p><h2>+<a>{3}</a></h2><p>+{75}</p><p><a>{2}</a></p>",
    # forms
    "<form><h3>{3}</h3></form><article><h1>+{6}</h1><p>+{44}</p><p>+{6}</p></article>",
    "<form><h2>{2}</h2></form><h1>+{7}</h1><p>+{50}</p><p>+{13}</p>",
    "<form><p>{2}</p><p>{6}</p></form><h1>+{9}</h1><p>+{70}</p><form><p>{3}</p><p>{20}</p></form>",
    "<nav><a>{4}</a></nav><article><h1>+{7}</h1><p>+{55}</p></article><form><p>{5}</p><p>{12}</p><p>{2}</p></form><footer>{8}</footer>",
    "<p><a>{2}</a></p><form><p>{7}</p></form><article><h1>+{5}</h1><p>+{48}</p><p>+{20}</p></article><p><a>{2}</a></p><form><h3>{3}</h3><p>{11}</p><p><a>{2}</a></p><p>{5}</p></form>",
    "<h1>+{4}</h1><p>+{66}</p><p>+{31}</p><p><a>{3}</a></p><form><p>{9}</p><p><a>{3}</a></p><p>{16}</p></form>",
)


SCALES = (0.4, 1, 2.5)


@lru_cache(maxsize=1)
def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """The features and labels of the labelled pages' blocks, as the pages are cut; each page also with shorter and
    longer texts, so that no single length decides."""
    x, y = [], []
    for page in LABELLED:
        for scale in SCALES:
            texts, counts, places = blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * (int(m[1]) if int(m[1]) < 10 else max(10, round(scale * int(m[1]))))), page))
            x.append(features(counts, places))
            y += [float(t.startswith("+")) for t in texts]
    return np.concatenate(x), np.asarray(y)


#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template textarea iframe svg title object audio video canvas xmp".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold text of their own rather than other blocks; their id says nothing.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead tfoot caption figcaption legend summary option address center hr label body".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside dialog menu button select search head".split())
CONTENT_TAGS = frozenset("article main".split())
#: Words in class, id or role that name boilerplate or content, and words that say nothing beside them.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup sidebar aside widget widgets menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager toolbar topbar masthead footer copyright contentinfo complementary comment comments commentlist respond replies reply disqus "
    "share sharing social related recommended recommendations login search skip hidden disclaimer".split()
)
#: Of these, the words that tell on a paragraph or another leaf; the others may as well name its subject or style there.
LEAF_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr newsletter "
    "subscribe subscription signup menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer copyright disclaimer skip comment comments".split()
)
CONTENT_WORDS = frozenset("article post entry content main story".split())
GENERAL_WORDS = frozenset(
    "a area articles bar block body bottom box button buttons card column container content form foot global group head header holder icons inner item items "
    "left link links list main message news outer page panel post posts primary region right row secondary section site slot small stories story text the to "
    "top unit us wrap wrapper article entry google by d of l m s xs sm md lg xl".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
def names_boilerplate(name: str, leaf: bool = False) -> bool:
    words = {w.lower() for w in _WORDS.findall(name)}
    return bool(words & (LEAF_WORDS if leaf else BOILERPLATE_WORDS)) and words <= BOILERPLATE_WORDS | GENERAL_WORDS


def place_of(name: str, attributes: str, outer: int) -> int:
    """Where the content of an element stands, by its tag and attributes, else as outside of it."""
    leaf = name in LEAF or name not in BLOCK
    content = False
    if attributes and name not in ("html", "body") and _TELLING.search(attributes):
        for found in _ATTRIBUTE.finditer(attributes):
            key, value = found[1].lower(), entities.unescape(found[2] or found[3] or found[4] or "")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(value):
                return BOILERPLATE
            if key in ("class", "role") or key == "id" and not leaf:
                parts = value.split()
                if any(names_boilerplate(part, leaf) for part in parts):
                    return BOILERPLATE
                content |= not leaf and any(w.lower() in CONTENT_WORDS for part in parts for w in _WORDS.findall(part))
    if name in BOILERPLATE_TAGS or name == "header" and outer != CONTENT:
        return BOILERPLATE
    if name == "form":
        return min(outer, FORM)
    if name == "main" or (name in CONTENT_TAGS or content) and outer != BOILERPLATE:
        return CONTENT
    return outer


class Tags:
    """The tags of a page in order, each found in time linear in the page altogether."""

    def __init__(self, page: str):
        self.page, self.last, self.open_ended = page, page.rfind(">"), set()

    def end(self, at: int) -> int:
        """The place after the next >, or -1."""
        return self.page.find(">", at) + 1 if at <= self.last else -1

    def attributes_end(self, at: int) -> int:
        """The place after the > that ends a tag's attributes, or -1. It goes from quotation to quotation; if one never
        closes, the tag's first > ends it. Quotations that lead to one that never closes are kept, so that none is
        walked twice."""
        page, seen, i = self.page, [], at
        while mark := _MARK.search(page, i):
            if mark[0] == ">":
                return mark.end()
            seen.append(mark.start())
            shut = -1 if mark.start() in self.open_ended else page.find(mark[0], mark.end())
            if shut < 0:
                break
            i = shut + 1
        self.open_ended.update(seen)
        return self.end(at)

    def next(self, at: int):
        """(start, end, closing, name, attributes) of the next tag or comment from a place on, or None."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), False, "", ""
            if page.startswith(("<!", "<?"), start):
                end = self.end(start)
                if end > 0:
                    return start, end, False, "", ""
            else:
                closing = page.startswith("/", start + 1)
                name = _NAME.match(page, start + 1 + closing)
                end = self.attributes_end(name.end()) if name and start < self.last else -1
                if end > 0:
                    return start, end, closing, name[0].lower(), page[name.end() : end - 1]
            at = start + 1
        return None


def blocks(page: str) -> tuple[list[str], list[tuple[int, float, int]], list[int]]:
    """The page's text blocks: texts, (words, link density, whether it is a heading), places."""
    texts, counts, places = [], [], []
    parts: list[str] = []
    linked: list[str] = []
    opened: Counter[str] = Counter()
    in_link, place, stack, at = 0, NEUTRAL, [], 0

    def flush() -> None:
        if parts:
            words = entities.unescape("".join(parts)).split()
            if words:
                texts.append(" ".join(words))
                counts.append((len(words), min(1.0, len(entities.unescape(" ".join(linked)).split()) / len(words)), int(any(name in HEADINGS for name, _ in stack[-2:]))))
                places.append(place)
            parts.clear()
            linked.clear()

    def text(to: int) -> None:
        if to > at:
            parts.append(page[at:to])
            if in_link:
                linked.append(page[at:to])

    tags, position = Tags(page), 0
    while found := tags.next(position):
        start, end, closing, name, attributes = found
        text(start)
        at = position = end
        if not name:
            continue
        if name in RAW and not closing:
            if not attributes.endswith("/") or name in ("script", "style", "title", "textarea"):
                shut = _shut(name).search(page, position)
                at = position = tags.end(shut.end()) if shut and tags.end(shut.end()) > 0 else len(page)
            if name in ("iframe", "object", "video", "audio", "canvas"):
                flush()
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
        elif closing:
            if name in BLOCK or opened[name]:
                flush()
            if opened[name]:
                while True:
                    inner, place = stack.pop()
                    opened[inner] -= 1
                    if inner == name:
                        break
                in_link = 0
        else:
            inside = place_of(name, attributes, place) if attributes or name in BLOCK else place
            if name in BLOCK or name not in VOID and inside != place:
                flush()
                if name == "p" or name == "li" or name.startswith("h") and name[1:].isdigit():
                    in_link = 0
                    if stack and stack[-1][0] == name:  # an open paragraph, item or heading ends here
                        place = stack.pop()[1]
                        opened[name] -= 1
                if name not in VOID:
                    stack.append((name, place))
                    opened[name] += 1
                    place = place_of(name, attributes, place)
    text(len(page))
    flush()
    own, all_words = (sum(n for (n, *_), p in zip(counts, places, strict=True) if p >= least) for least in (CONTENT, NEUTRAL))
    if own and CONTENT_SHARE * all_words <= own:
        places = [OUTSIDE if p == NEUTRAL else p for p in places]
    return texts, counts, places


#: Content containers count if they hold this share of the page's words outside boilerplate.
CONTENT_SHARE = 0.25


@lru_cache(maxsize=None)
def _shut(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE)


def features(counts: list[tuple[int, float, int]], places: list[int]) -> np.ndarray:
    facts = np.asarray(counts, float).reshape(-1, 3)
    own = np.column_stack([facts[:, :2], np.asarray(places, float), facts[:, 2]])
    out = np.zeros((len(own), len(FEATURES)))
    out[:, :4], out[:, 6], out[:, 10] = own, OUTSIDE, OUTSIDE
    out[1:, 4:8], out[:-1, 8:12] = own[:-1], own[1:]
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 3):
    """A decision tree by Gini impurity: a leaf's share of 1s, or (feature, threshold, low, high); at least ``least``
    rows in a leaf."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (2 * share * (1 - share) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < t
            if min(low.sum(), (~low).sum()) < least:
                continue
            a, b = y[low].mean(), y[~low].mean()
            gini = low.mean() * 2 * a * (1 - a) + (~low).mean() * 2 * b * (1 - b)
            if gini < best[0] - 1e-12:
                best = (gini, f, float(t))
    if best[1] < 0:
        return share
    low = x[:, best[1]] < best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@lru_cache(maxsize=1)
def fitted_tree():
    return grow(*labelled_blocks())


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, a, b = tree
    low = x[:, f] < t
    out = np.empty(len(x))
    out[low], out[~low] = classify(a, x[low]), classify(b, x[~low])
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    return extract([page])[0]


def extract(pages: list[str | None]) -> list[str]:
    """The main texts of many pages; all their blocks are classified at once."""
    cut = [blocks(p) if p else ([], [], []) for p in pages]
    sizes = [len(c[0]) for c in cut]
    if not sum(sizes):
        return [""] * len(pages)
    keep = classify(fitted_tree(), np.concatenate([features(c[1], c[2]) for c in cut if c[0]])) >= 0.5
    out, at = [], 0
    for (texts, _, _), n in zip(cut, sizes, strict=True):
        out.append(" ".join(t for t, k in zip(texts, keep[at : at + n].tolist(), strict=True) if k))
        at += n
    return out


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_chars) for every page."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            for i in range(0, len(column), 200):
                texts = pa.array(extract(column[i : i + 200].to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 200], texts, pc.utf8_length(texts).cast(pa.int64())], ["k", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("k"), F.col(html_col).cast("string").alias("h"))
    return rows.mapInArrow(run, f"k {kind}, text string, n_chars long").withColumnRenamed("k", id_col)
