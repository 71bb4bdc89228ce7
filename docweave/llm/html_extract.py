"""Main-text extraction by the maximum-scoring subsequence.

A page is read as one sequence of words and tags. Words score positive and tags negative, with weights that are
log-likelihood ratios fitted on labelled pages (pages that mark their content with an article or main element). Menus,
footers, adverts, forms and the like score as a whole, by their name and, up to MOST_WORDS, their words: names of such
elements are given, and their weights fitted, so that a name that labelled pages have in their content costs nothing. One
linear scan finds the contiguous region with the highest total. Text of the region is returned without the boilerplate
elements inside it.

Defined cases: null or empty html, or a page without words, gives an empty text; unclosed elements end with their parent
or the page, but a menu or header without an end tag ends where the marked content begins; script, style and comments never
count, whatever they contain, but an unclosed element of that kind other than script and style is passed over like any
tag; a form around a whole page is no form; without labelled pages the priors hold; pages of any length are read whole and
once; rows are read one by one, repeated ones alike.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template svg iframe object canvas audio video textarea select title".split()
INLINE = frozenset("a abbr acronym area audio b base bdi bdo big canvas cite code data del dfn em embed font i iframe img ins kbd link mark math meta mi mn mo mrow msub msup noscript object param q rp rt ruby s samp script small source span strike strong style sub sup svg template time track tt u var video wbr".split())
BOILERPLATE = frozenset("nav footer aside form button dialog menu fieldset label option datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names (classes and ids) of boilerplate. PARTS also count next to words of LAYOUT, as in "site-footer" or "ad_slot_2".
PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense adslot sponsor sponsored promo cookie cookies consent gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "share sharing social comment comments disqus newsletter subscribe signup login popup modal toolbar footer masthead topbar".split()
)
NAMES = PARTS | frozenset(
    "advertising sponsors promotion promoted promos banner notice notices alert alerts side menus header site-header page-header respond reply replies discussion related related-posts related-articles related-links related-stories "
    "recommended recommendations subscription overlay widget widgets skip skip-link print hidden sr-only".split()
)
LAYOUT = frozenset("site page main top bottom left right primary secondary global box block wrapper wrap container list area section bar links link item items inner outer slot unit banner notice form buttons icons thread body post article mobile desktop sticky fixed widget column col title header reader user".split())
#: Names of elements that hold an article.
CONTENT = frozenset("article post entry story content post-content entry-content article-content article-body post-body story-body hentry main main-content blog-post".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
HEAD_END = re.compile(r"</head\s*>|(?=<body[\s>/])", re.I)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: Least weight of a tag or word, so that words stay positive and tags negative whatever the labels say.
LEAST = 0.05
PRIORS = {"word": 1.0, "link": -0.5, "boiler": -2.0, "outside": -1.0, "inner": 0.0}
#: Words of a boilerplate element that count against the region; more of them say no more.
MOST_WORDS = 5
#: How many labelled pages weights are fitted on at most.
LABELLED = 2000


def named(value: str) -> str | None:
    """The name of NAMES that a class or id goes by."""
    for name in value.lower().split():
        name = name.replace("_", "-")
        if name in NAMES:
            return name
        parts = [x for x in name.split("-") if x]
        own = [x for x in parts if x in PARTS]
        if own and all(x in PARTS or x in LAYOUT or x.isdecimal() for x in parts):
            return own[0]
    return None


def boilerplate(tag: str, attributes: str, in_content: bool, in_post: bool) -> str | None:
    """The feature of a boilerplate element; None for other elements."""
    if tag in BOILERPLATE or (tag == "header" and not in_content and not in_post):
        return "<" + tag
    if tag in ("html", "body", "main"):
        return None
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and (found := named(value)) and (tag != "article" or found in ("comment", "comments", "reply", "replies")):
            return None if tag == "header" and found == "header" and (in_content or in_post) else "." + found
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return ".hidden"
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return ".hidden"
    return None


def holds_post(attributes: str) -> bool:
    return any(x in CONTENT for name, *values in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for x in "".join(values).lower().replace("_", "-").split())


def label(page: str) -> str | None:
    """The element that marks a page's content, if it has one."""
    low = page.lower()
    return next((t for t in ("article", "main") if re.search(rf"<{t}[\s>]", low)), None)


def ends_later(page: str, tag: str, at: int) -> bool:
    return re.compile(rf"</{tag}[\s>]", re.I).search(page, at) is not None


def wraps_page(page: str, at: int) -> bool:
    """Whether the form that begins at a place has the page's content in it, or no end."""
    ended = re.compile(r"</form[\s>]", re.I).search(page, at)
    return ended is None or re.compile(r"<(?:article|main|h1)[\s>]", re.I).search(page, at, ended.start()) is not None


def tokens(page: str, mark: str | None) -> Iterator[tuple[str, str, bool]]:
    """(kind, value, inside the marked content) of runs of text, and kind "tag" with a tag's name.

    Text is a "word" run in the content (anywhere on a page without a mark), "link" in a link outside it, "outside" beyond
    it, "boiler" in boilerplate, and "inner" in boilerplate within the content, which counts nothing either way. Boilerplate
    elements also give a "name" with their feature where they begin.
    """
    stack: list[tuple[str, bool, bool]] = []  # tag, boilerplate, holds a post
    at, end, boiler, content, links, posts = 0, len(page), 0, 0, 0, 0

    def text(piece: str) -> tuple[str, str, bool]:
        kind = ("inner" if content else "boiler") if boiler else "word" if content else "link" if links else "outside" if mark else "word"
        return (kind, entities.unescape(piece), content > 0)

    def tag_token(name: str) -> tuple[str, str, bool]:
        return ("inner", "" if name.lstrip("/") in INLINE else " ", True) if boiler and content else ("tag", name, content > 0)

    def pop(k: int) -> None:
        nonlocal boiler, links, content, posts
        for tag, bad, post in stack[k:]:
            boiler, links, posts = boiler - bad, links - (tag == "a"), posts - post
            content -= tag == mark and not bad
        del stack[k:]

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            yield text(page[at:])
            return
        if m.start() > at:
            yield text(page[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1] or m[4] or "", (m[2] or m[5] or "").lower(), m[3] or m[6] or "")
        if not name:
            continue
        if not closing and name == "head" and (ended := HEAD_END.search(page, at)):
            at = ended.end()
            continue
        if not closing and name in RAW_END and not attributes.rstrip().endswith("/"):
            ended = RAW_END[name].search(page, at)
            if ended or name in ("script", "style"):
                at = ended.end() if ended else end
            yield tag_token(name)
            continue
        if not closing:
            if name not in VOID and not attributes.rstrip().endswith("/"):
                if name == "p" or name == "li":  # an open one of the same name ends where the next begins
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            pop(k)
                            break
                        if stack[k][0] not in INLINE:
                            break
                if name == mark and boiler:
                    first = next(k for k, x in enumerate(stack) if x[1])
                    if not ends_later(page, stack[first][0], at):
                        pop(first)
                bad = boilerplate(name, attributes, content > 0, posts > 0)
                bad = None if bad == "<form" and wraps_page(page, at) else bad
                post = bool(attributes) and not bad and holds_post(attributes)
                if bad and not boiler:
                    yield ("inner" if content else "name", "" if content else bad, content > 0)
                stack.append((name, bad is not None, post))
                boiler, links, posts = boiler + (bad is not None), links + (name == "a"), posts + post
                content += name == mark and not bad
            yield tag_token(name)
            continue
        yield tag_token("/" + name)
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                pop(k)
                break


#: All features that weights are fitted for: a fixed set, so what is counted and sent is bounded.
ELEMENTS = frozenset((
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption cite code col colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark math menu meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby "
    "s samp script section select slot small source span strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track u ul var video wbr center font tt big strike"
).split())


def counted(pages: Iterable[str]) -> Counter:
    """(feature, inside) to its number, of pages that mark their content; features are kinds of words, tags and names of boilerplate.

    Names count by where they are with the mark hidden, else none would be inside.
    """
    seen: Counter = Counter()
    for page in pages:
        if mark := label(page):
            for kind, value, inside in tokens(page, mark):
                if kind in ("inner", "name"):
                    continue
                if kind != "tag":
                    seen[(kind, inside)] += len(value.split())
                elif value.lstrip("/") in ELEMENTS:
                    seen[(value, inside)] += 1
            seen.update(names_in(page, mark))
    return seen


def names_in(page: str, mark: str) -> Counter:
    """(name, inside) to the words in elements of that name."""
    seen: Counter = Counter()
    content, open_ = 0, None
    for kind, value, _ in tokens(re.sub(rf"(?i)<(/?){mark}(?=[\s>])", r"<\1x-mark", page), None):
        if kind == "tag" and value in ("x-mark", "/x-mark"):
            content += 1 if value == "x-mark" else -1
        elif kind == "name":
            open_ = value
        elif kind == "boiler" and open_:
            seen[(open_, content > 0)] += len(value.split())
    return seen


def fitted(seen: Counter) -> dict[str, float]:
    """Log-likelihood ratios of inside to outside, words kept positive, tags and names at most 0; the priors where nothing was seen."""
    totals = [sum(n for (_, i), n in seen.items() if i is side) for side in (True, False)]
    if not all(totals):
        return dict(PRIORS)
    weights = dict(PRIORS)
    for feature in {f for f, _ in seen}:
        ratio = math.log((seen[(feature, True)] + 0.5) / (totals[0] + 1)) - math.log((seen[(feature, False)] + 0.5) / (totals[1] + 1))
        if feature == "word":
            weights[feature] = max(LEAST * 4, ratio)
        elif feature in PRIORS:
            weights[feature] = min(PRIORS[feature], ratio)
        elif feature[0] in "<.":
            weights[feature] = max(-2.0, min(0.0, ratio))
        else:
            weights[feature] = max(-2.0, min(-LEAST, ratio))
    return weights


def scored(page: str, weights: dict[str, float], mark: str | None) -> list[tuple[str, str, float]]:
    """(kind, value, score) of a page's sequence. Words of a boilerplate element score by its name's weight, MOST_WORDS of them at most."""
    out, name, left = [], 0.0, 0
    for kind, value, _ in tokens(page, mark):
        if kind == "name":
            name, left = weights.get(value, weights["boiler"]), MOST_WORDS
            score = 0.0
        elif kind == "boiler":
            n = min(left, len(value.split()))
            left -= n
            score = name * n
        elif kind == "tag":
            score = weights.get(value, -LEAST)
        else:
            score = weights[kind] * len(value.split())
        out.append((kind, value, score))
    return out


def best_region(page: str, weights: dict[str, float], mark: str | None = None) -> list[tuple[str, str]]:
    """(kind, value) of the region with the highest total, found in one scan; the earliest of equals."""
    sequence = scored(page, weights, mark)
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, (_, _, score) in enumerate(sequence):
        total += score
        if total > best:
            best, best_at = total, (start, i + 1)
        if total < 0:
            total, start = 0.0, i + 1
    return [(k, v) for k, v, _ in sequence[best_at[0] : best_at[1]]]


def extract(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The main text of one whole page."""
    if not page:
        return ""
    out, mark = [], label(page)
    region = best_region(page, weights or PRIORS, mark)
    if mark and not any(k == "word" for k, _ in region):  # the mark is in boilerplate only
        region = best_region(page, weights or PRIORS)
    for kind, value in region:
        if kind in ("word", "link"):
            out.append(value)
        elif kind == "inner":
            out.append(" " if value == " " else "")
        elif kind in ("boiler", "name") or kind == "tag" and value.lstrip("/") not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def fit(pages: DataFrame, html_col: str = "html", most: int = LABELLED) -> dict[str, float]:
    """Weights from at most `most` pages with an article or main element, those with the smallest hashes.

    The counts are made on the executors; the driver gets one short row per partition and feature.
    """
    marked = pages.filter(F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.col(html_col).alias("html"))
    few = marked.select(F.xxhash64("html").alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if few is None:
        return dict(PRIORS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(counted(batch["html"]))
        yield pd.DataFrame([(f, i, n) for (f, i), n in sorted(seen.items())], columns=["feature", "inside", "n"])

    rows = marked.filter(F.xxhash64("html") <= few).mapInPandas(count, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    return fitted(Counter({(r["feature"], r["inside"]): r["n"] for r in rows.collect()}))  # two rows a feature at most


def main_text(pages: DataFrame, html_col: str = "html", weights: dict[str, float] | None = None, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep's columns and text for every row of pages."""
    learned = weights if weights is not None else fit(pages, html_col)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return pd.Series([extract(x, learned) for x in column], dtype=object)

    return pages.select(*keep, text(F.col(html_col)).alias("text"))
