"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of tags and runs of text.  Each word scores the
weight of its context (the block it stands in, whether it is link text, inside
a part that names itself as page furniture) and that of its place (within or
beside the page's marked content), each tag a negative weight.  One linear scan
finds the contiguous stretch with the largest sum; its text, without
furniture, is the result.

Marked content: the articles, where they hold at least half of the words (of
the main element, if the page has one), else the main element.  Where articles
hold less, as teasers or comments do, and there is no main element, the page
has none and the other contexts decide.  An article that names itself as
furniture (``class="comment"``) is furniture, unless it holds nearly all words.

Weights come from labelled pages: a page with marked content labels its own
words.  Those of contexts are log odds of standing inside it, over a sample of
about ``max_pages`` pages chosen by a hash (fewer pages: all).  Those of places
are log odds of standing in the stretch that the contexts alone would choose
in the same sample, so marks weigh as much as the words bear them out.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one newline, empty ones
left out.  Inline tags add nothing; ``br`` counts as white space.

Furniture: elements of such kinds, hidden ones, and those whose class, id or
role is a furniture word or a compound of one with a word of layout.  Words in
a slug (``id="related-work"``), the id of a heading and, within an article or
main element, an id that may be a subject (``id="discussion"``) name none.

Edge cases: a null or empty page, or one without content, gives an empty
text; unclosed tags, comments and quotes end where a browser ends them, in
linear time; without any labelled page fixed starting weights hold; repeated
rows stay; extra columns stay (one named like the output is replaced).
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGES = 4000
#: The elements of HTML that matter here, and words in class, id and role that name page furniture.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split())
FURNITURE_TAGS = frozenset(
    "head nav header footer aside form menu button select option label fieldset legend dialog search object canvas svg audio video map datalist output".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv alert advert adverts advertisement advertising adsense adslot banner banners breadcrumb breadcrumbs byline-share comment comments "
    "commentlist complementary consent contentinfo cookie cookies copyright dialog discussion disqus feedback foot footer form gdpr "
    "header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination "
    "popup promo promos promotion promotions recommended related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription taboola teaser teasers toolbar topbar widget widgets".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
SAME_CLOSES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
               "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}
#: Starting weights, for contexts that no labelled page shows.
START = {"furniture": -2.0, "link": -0.5, "text": 1.0, "tag": -0.05}
#: The same for places: within and beside marked content; an article of a page without any.
START_PLACE = {"within": 3.0, "beside": -3.0, "minor": 0.0}
MAIN, ARTICLE = 1, 2
#: Least shares of a page's words: of articles, of a main element, of an article named as furniture that is kept.
ARTICLE_SHARE, MAIN_SHARE, NAMED_SHARE = 0.5, 0.1, 0.9
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_UNQUOTED = re.compile(r"[^>\"']*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/=][^\s/=]*+)(?:\s*+=\s*+("[^"]*"|'[^']*'|\S*+))?""")
#: What an attribute that could make an element furniture has in it; the others are not parsed.
_MAYBE = re.compile(r"class|id|role|style", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: With furniture words, these make compounds (``site-footer``, ``ad-slot``); other words make slugs (``search-algorithms``).
QUALIFIERS = frozenset(
    "above active area article articles bar base below block body bottom box button buttons card center col column container content count "
    "desktop element embed entry fixed global group holder icons inline inner item items js layout left lg line link links list main md middle "
    "mobile outer page pane panel post posts primary rail region right row secondary section site slot small sm sticky story stories tertiary text "
    "title top unit user visible wide wp wrap wrapper xs zone".split())
#: Furniture words that sections and headings are also called; as an id within text they name its subject.
TOPICS = frozenset(
    "alert banner consent copyright dialog discussion feedback form header menu navigation notice notices notification overlay pagination "
    "promotion promotions related replies reply respond search share sharing social subscription".split())
TOPIC_COMPOUNDS = frozenset("related-articles related-posts related-stories social-share share-buttons social-icons social-links".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a wrapper says about its parts (``with-sidebar``) does not name the wrapper.
_BESIDE = re.compile(r"\b(?:no|has|with|without)[-_]+[a-z0-9]+")
_BLANKS = " \t\n\r\f"
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Token(NamedTuple):
    context: str  # of a word; the name of a tag
    text: str | None  # None: a tag
    words: int
    block: int
    furniture: bool
    scope: int  # MAIN, ARTICLE, both or 0: the elements that it stands in
    named: int = 0  # which article named as furniture it stands in, from 1


class _Open(NamedTuple):
    """An open element, with what holds for text in it."""
    name: str
    furniture: bool
    scope: int
    named: int
    link: bool  # within a link, however deep
    block: str  # the nearest block element


_TOP = _Open("", False, 0, 0, False, "body")


def _attributes(raw: str) -> dict[str, str]:
    """Names and values, as a browser reads them; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        out.setdefault(name.lower(), html_lib.unescape(value))
    return out


def _names_furniture(key: str, value: str, name: str, within: bool) -> bool:
    """Whether a class, id or role is a furniture word or a compound of one."""
    if key == "id" and name in HEADINGS:  # the heading's own text
        return False
    for token in value.split():
        parts = [x for x in _SPLIT.split(_BESIDE.sub("", _CAMEL.sub("-", token).lower())) if x]
        words = FURNITURE_WORDS.intersection(parts)
        if not words or not all(x in words or x in QUALIFIERS or len(x) == 1 or x[0].isdigit() for x in parts):
            continue
        if key == "id" and words <= TOPICS and (within or name not in ("div", "ul", "ol", "table", "td")) and "-".join(parts) not in TOPIC_COMPOUNDS:
            continue
        return True
    return False


def _furniture(name: str, raw: str, within: bool = False) -> str:
    """Why an element (``within`` an article or main element) is furniture: ``tag``, ``hidden``, ``name``; or nothing."""
    if name in FURNITURE_TAGS:
        return "tag"
    if name in ("html", "body") or not _MAYBE.search(raw):  # hidden has id in it too
        return ""
    found = _attributes(raw)
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or "display:none" in "".join(found.get("style", "").lower().split()):
        return "hidden"
    if name != "main" and any(_names_furniture(key, found[key], name, within) for key in ("class", "id", "role") if key in found):
        return "name"
    return ""


def tokens(page: str) -> list[Token]:
    out: list[Token] = []
    stack: list[_Open] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # of each name on the stack
    block, at, no_more, end, articles = 0, 0, set(), len(page), 0

    def text(raw: str) -> None:
        if raw:
            here = stack[-1] if stack else _TOP
            raw = html_lib.unescape(raw)
            kind = "furniture" if here.furniture else "link" if here.link else here.block
            out.append(Token(kind, raw, len(raw.split()), block, here.furniture, here.scope, here.named))

    def close(name: str, within: Iterable[str] = ()) -> None:
        """Close the last open element of a name, unless one of ``within`` was opened after it."""
        if (own := places[name]) and all(own[-1] >= places[x][-1] for x in within if places[x]):
            for element in reversed(stack[(first := own[-1]):]):
                places[element.name].pop()
            del stack[first:]

    def push(element: _Open) -> None:
        places[element.name].append(len(stack))
        stack.append(element)

    while at < end:
        less = page.find("<", at)
        if less < 0:
            text(page[at:])
            break
        if less > at:
            text(page[at:less])
        at = less
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), at):
            stop = page.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, at)
        if not m:
            if page.startswith("</", at):  # a bogus comment
                stop = page.find(">", at)
                at = end if stop < 0 else stop + 1
            else:
                text("<")
                at += 1
            continue
        name, closing, i = m[1].lower(), page[at + 1] == "/", m.end()
        while True:
            stop = _UNQUOTED.match(page, i).end()
            if stop >= end or page[stop] == ">":
                break
            quote, i = page[stop], stop + 1
            last = stop - 1  # the last character before the quote that is no blank
            while last >= m.end() and page[last] in _BLANKS:
                last -= 1
            if quote not in no_more and last >= m.end() and page[last] == "=":
                j = page.find(quote, i)
                if j < 0:
                    no_more.add(quote)
                else:
                    i = j + 1
        if stop >= end:
            break
        attributes, at = page[m.end():stop], stop + 1
        if name in BLOCKS:
            block += 1
        here = stack[-1] if stack else _TOP
        out.append(Token(name, " " if name == "br" else None, 0, block, here.furniture, here.scope, here.named))
        if closing:
            close(name)
            continue
        if name in RAW:
            found = _RAW_END[name].search(page, at)
            at = found.start() if found else end
            push(_Open(name, True, 0, 0, False, "body"))
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name in CLOSES_P:
            close("p", {"div", "section", "article", "main", "td", "th", "li", "blockquote", "body", "aside", "nav", "footer", "header", "form"})
        if name in SAME_CLOSES:
            close(name, SAME_CLOSES[name])
        here = stack[-1] if stack else _TOP
        scope, named = here.scope, here.named
        why = _furniture(name, attributes, scope > 0)
        if name == "article" and why == "name":
            why = ""
            if not named:
                articles += 1
                named = articles
        if name == "main" or name == "article" and not named:
            scope |= MAIN if name == "main" else ARTICLE
        push(_Open(name, here.furniture or bool(why), scope, named, here.link or name == "a", name if name in BLOCKS else here.block))
    return _without_named(out) if articles else out


def _without_named(page: list[Token]) -> list[Token]:
    """The articles named as furniture made furniture, but for one that is nearly the whole page."""
    sizes: Counter = Counter()
    for t in page:
        if t.words and not t.furniture and t.context != "link":
            sizes[t.named] += t.words
    total = sum(sizes.values())
    drop = {i for i in {t.named for t in page} if i and sizes[i] < max(1, NAMED_SHARE * total)}
    return [t._replace(furniture=True, context=t.context if t.text is None or not t.words else "furniture") if t.named in drop else t for t in page]


def marked_scope(page: list[Token]) -> int:
    """The elements that make the page's marked content: ARTICLE, MAIN, both (articles in a main element) or 0 (none)."""
    for links in (False, True):  # link text counts only where there is no other
        sizes: Counter = Counter()
        for t in page:
            if t.words and not t.furniture and (links or t.context != "link"):
                sizes[t.scope] += t.words
        if sizes:
            break
    both, total = MAIN | ARTICLE, sum(sizes.values())
    main = sizes[MAIN] + sizes[both]
    if main and main >= MAIN_SHARE * total:
        return both if sizes[both] >= ARTICLE_SHARE * main else MAIN
    articles = sizes[ARTICLE] + sizes[both]
    return ARTICLE if articles and articles >= ARTICLE_SHARE * total else 0


def inside(t: Token, scope: int) -> bool:
    """Whether a token stands in the marked content."""
    return scope > 0 and t.scope & scope == scope


def place(t: Token, scope: int) -> str:
    if scope:
        return "within" if inside(t, scope) else "beside"
    return "minor" if t.scope & ARTICLE else ""


def label_counts(page: list[Token]) -> Counter:
    """(context, inside) of the words and tags of a page that marks its content."""
    scope, out = marked_scope(page), Counter()
    if scope:
        for t in page:
            kept = inside(t, scope) and not t.furniture
            if t.words:
                out[f"word:{t.context}", kept] += t.words
            elif t.text is None:
                out[f"tag:{t.context}", kept] += 1
    return out


def place_counts(page: list[Token], weight: dict[str, float]) -> Counter:
    """(place, in the stretch that the contexts alone choose) of the words that are no furniture."""
    scope, out = marked_scope(page), Counter()
    start, stop = region(page, scope, weight, {}) if scope or any(t.scope & ARTICLE for t in page) else (0, 0)
    for i, t in enumerate(page) if stop else ():
        if t.words and not t.furniture and (where := place(t, scope)):
            out[f"place:{where}", start <= i < stop] += t.words
    return out


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of standing inside; tags never above the starting weight."""
    out = {}
    for name in {c for c, _ in counts}:
        odds = math.log((counts.get((name, True), 0) + 1) / (counts.get((name, False), 0) + 1))
        out[name] = max(-3.0, min(3.0, odds)) if not name.startswith("tag:") else max(-0.2, min(START["tag"], odds / 10))
    return out


def learn(pages: DataFrame, html: str = "html", max_pages: int = MAX_PAGES) -> dict[str, float]:
    """Weights from the pages that mark their content; one row per context is collected."""
    rows = pages.select(F.col(html).alias("html"))
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < min(1.0, max_pages / max(n, 1)) * (1 << 20))

    def learned(counts_of) -> dict[str, float]:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: Counter = Counter()
            for batch in batches:
                for page in batch["html"]:
                    for (name, inside), k in counts_of(tokens(page or "")).items():
                        kind, _, what = name.partition(":")
                        what = what if kind == "place" or what in BLOCKS or what in VOID or what in ("furniture", "link", "a", "b", "i", "em", "strong", "span") else "other"
                        total[f"{kind}:{what}", inside] += k
            if total:
                yield pd.DataFrame([(c, i, k) for (c, i), k in total.items()], columns=["context", "inside", "n"])

        counted = chosen.mapInPandas(count, "context string, inside boolean, n long").groupBy("context", "inside").agg(F.sum("n").alias("n"))
        return weights({(r.context, r.inside): r.n for r in counted.collect()})

    contexts = learned(label_counts)
    return contexts | learned(lambda page: place_counts(page, contexts))


def score(t: Token, scope: int, weight: dict[str, float], places: dict[str, float]) -> float:
    if t.words:
        if t.furniture:  # left out anyway: within the marked content it must not part what stands on both sides
            return 0.0 if inside(t, scope) else min(weight.get("word:furniture", START["furniture"]) / 20, 0) * t.words
        each = weight.get(f"word:{t.context}", START["link"] if t.context == "link" else START["text"])
        return (each + places.get(place(t, scope), 0.0)) * t.words
    return 0.0 if t.text is not None else weight.get(f"tag:{t.context}", START["tag"])


def region(seq: list[Token], scope: int, weight: dict[str, float], places: dict[str, float]) -> tuple[int, int]:
    """Bounds of the contiguous stretch with the largest sum."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, t in enumerate(seq):
        if total <= 0:
            total, start = 0.0, i
        total += score(t, scope, weight, places)
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str | None, weight: dict[str, float]) -> str:
    """The main text of one page."""
    seq = tokens(page or "")
    scope = marked_scope(seq)
    places = {name: weight.get(f"place:{name}", start) for name, start in START_PLACE.items()}
    blocks: dict[int, list[str]] = {}
    for t in seq[slice(*region(seq, scope, weight, places))]:
        if t.text is not None and not t.furniture:
            blocks.setdefault(t.block, []).append(t.text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in joined if x)


def main_text(pages: DataFrame, weight: dict[str, float], html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the column ``out``."""
    held = pages.sparkSession.sparkContext.broadcast(weight)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(page, held.value) for page in batch], dtype="object")

    return pages.withColumn(out, text(F.col(html)))
