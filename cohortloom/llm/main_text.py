"""Main text of web pages by the maximum-scoring subsequence (operator 7).

A page is a sequence of words and tags. Words score positive, by how often words in their surroundings are content;
tags score negative, by how often they stand outside of it. Both weights are counted on labelled pages: pages that mark
their content themselves with an article or main element that is read (not dropped, not in a comment or script) and not
named as a comment or advert. The marks only label pages for learning: one linear scan finds the stretch with the highest
sum on every page alike. Inside it, elements that never are main text (menus, forms, scripts, comments and so on, by
name, role or class) are left out.

Defined results: null and empty pages, and pages without words, give an empty text. Cut-off pages and unclosed tags are
read as far as they go; an element left out ends where HTML ends it, also without its closing tag. Repeated rows give
repeated results; ids and urls are passed on as they are, null too. Of stretches with equal sums the last wins. Pages of
any length are read whole, once from front to back; further columns, whatever their names, are not read. Without any
labelled page all words count alike and most tags cost next to nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small
span strike strong sub sup time tt u var wbr br""".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements that are never main text.
DROPPED = frozenset("""head nav aside footer header menu form script style noscript template textarea title select option button input
iframe svg math canvas object dialog noframes noembed xmp datalist""".split())
#: Words in class, id or role that mark an element as something else than main text.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar
navigation menu menubar breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal
overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus reply replies respond widget
toolbar skip pagination pager copyright legal disclaimer contentinfo complementary search toc dialog""".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: What it costs to cross the border of an article, or to enter an element that a mark is only a part of the name of: about eight words.
HINT_COST = -8.0
SPLIT = re.compile(r"[^a-z]+")


def names_of(attributes: str) -> list[list[str]]:
    """The words of every class, id and role, split into their parts."""
    return [[p for p in SPLIT.split(t) if p] for m in NAMED.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").lower().split()]


def marked(attributes: str) -> bool:
    """Hidden, or a class, id or role that is made of marks only."""
    return bool(attributes) and (any(ps and MARKS.issuperset(ps) for ps in names_of(attributes)) or bool(HIDDEN.search(attributes)))


def hinted(attributes: str) -> bool:
    """A mark is part of a class, id or role."""
    return bool(attributes) and any(not MARKS.isdisjoint(ps) for ps in names_of(attributes))


# HTML's implied ends: what a start tag closes, and which elements it does not look beyond.
_LISTS = frozenset("ul ol menu dl table td th section article nav aside form blockquote select button template object figure".split())
_TABLE, _CELLS, _INNER = frozenset(["table", "template"]), frozenset(["td", "th"]), frozenset("table td th button object template svg math".split())
CLOSES = {"li": (frozenset(["li"]), _LISTS), "dt": (frozenset(["dt", "dd"]), _LISTS), "dd": (frozenset(["dt", "dd"]), _LISTS),
          "td": (_CELLS, _TABLE), "th": (_CELLS, _TABLE), "tr": (_CELLS | {"tr"}, _TABLE), "option": (frozenset(["option"]), frozenset(["select", "optgroup"])),
          "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"]))}
CLOSES |= {n: (_CELLS | {"tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, _TABLE) for n in ("tbody", "thead", "tfoot")}
ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr li dt dd main menu nav ol p pre search section table ul""".split())
IN_HEAD = frozenset("title meta link base script style noscript template basefont bgsound noframes head html".split())


def close_implied(inner: list[str], name: str) -> None:
    """Take the elements off ``inner``, the open elements, that a start tag ends."""
    rules = [CLOSES[name]] if name in CLOSES else []
    if name in ENDS_P:
        rules.append((frozenset(["p"]), _INNER))
    for closed, beyond in rules:
        stop = next((k for k in range(len(inner) - 1, -1, -1) if inner[k] in beyond), -1)
        first = next((k for k in range(stop + 1, len(inner)) if inner[k] in closed), len(inner))
        del inner[first:]


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text): kind is text, open or close; text of an opening tag is its attributes."""
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            yield "close", name, ""
            continue
        yield "open", name, m[3] or m[6] or ""
        if name in RAW:  # what it holds is no markup
            stop = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = stop.start() if stop else end


class Reader:
    """The page as units: ("tag", key) and ("text", key, text, block), outside of dropped elements.

    A key is (inside, tag): whether it is inside of content that the page marks (for learning); the tag is the nearest
    block's, or ``a`` in links.
    """

    def __init__(self, page: str) -> None:
        self.units: list[tuple] = []
        stack: list[str] = []  # open blocks
        link, block = 0, 0
        holds: list[bool] = []  # open article and main elements: whether they mark content
        inner: list[str] = []  # a dropped element and what is open in it
        for kind, name, text in events(page):
            if inner:
                if inner == ["head"] and (text.strip() if kind == "text" else kind == "open" and name not in IN_HEAD):
                    inner.clear()
                elif kind == "open":
                    close_implied(inner, name)
                    if inner and name not in VOID:
                        inner.append(name)
                elif kind == "close" and name in inner:
                    while inner.pop() != name:
                        pass
                    continue
                elif kind == "close" and name in stack and _INNER.isdisjoint(inner[1:]):
                    inner.clear()  # the end of an element around it
                if inner:
                    continue
            content = any(holds)
            area = content
            if kind == "text":
                self.units.append(("text", (area, "a" if link else stack[-1] if stack else ""), text, block))
                continue
            if kind == "open" and name not in VOID and name not in ("html", "body") and (
                    (name in DROPPED and not (name == "header" and content)) or marked(text)):
                inner = [name]
                if name not in INLINE:
                    block += 1
                self.units.append(("tag", (area, "dropped")))
                continue
            if kind == "open" and hinted(text):
                self.units.append(("tag", (area, "hinted")))
            if name == "a":
                link = int(kind == "open")
            if name == "br":
                self.units.append(("text", (area, stack[-1] if stack else ""), " ", block))
            elif name in ("td", "th"):
                self.units.append(("text", (area, stack[-1] if stack else ""), " ", block))
            elif name not in INLINE:
                block += 1
                if name in ("article", "main"):
                    if kind == "open":
                        holds.append(not hinted(text))  # comments and adverts can be articles too
                    elif holds:
                        holds.pop()
                if kind == "open" and name not in VOID:
                    if name in ("p", "li") and stack and stack[-1] == name:
                        stack.pop()
                    stack.append(name)
                elif kind == "close" and name in stack:
                    while stack.pop() != name:
                        pass
            self.units.append(("tag", (area, name)))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled pages: how often words and tags of each key are inside and outside of the content."""
    count: Counter = Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            units = Reader(page or "").units
            if not any(u[1][0] for u in units):
                continue
            for u in units:
                inside, tag = u[1]
                count[(u[0], tag, inside)] += len(u[2].split()) if u[0] == "text" else 1
    keys = list(count)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                      pa.array([k[2] for k in keys], pa.bool_()), pa.array([count[k] for k in keys], pa.int64())],
                                     ["kind", "tag", "inside", "n"])


def learned(pages: DataFrame, sample: int) -> dict[tuple[str, str], float]:
    """Share of content per kind and tag, from ``sample`` pages with marked content, the first by a hash."""
    own = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]")).withColumn("at", F.xxhash64("html"))
    # Only hashes are sorted; pages themselves stay where they are. Copies of the last page count with it.
    last = own.select("at").orderBy("at").limit(sample).agg(F.max("at")).first()[0]
    own = own.where(F.col("at") <= F.lit(last).cast("long"))
    rows = own.select("html").mapInArrow(counted, "kind string, tag string, inside boolean, n bigint").groupBy("kind", "tag").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("inside"), F.col("n")).otherwise(F.lit(0))).alias("inside")).collect()
    return {(r["kind"], r["tag"]): (r["inside"] + 0.5) / (r["n"] + 1) for r in rows}


def main_text(page: str | None, share: dict[tuple[str, str], float]) -> str:
    """Blocks of the maximum-scoring stretch, joined by line feeds."""
    units = Reader(page or "").units
    best, total, begin, found = 0.0, 0.0, 0, (0, 0)
    for at, u in enumerate(units):
        tag = u[1][1]
        if u[0] == "text":
            value = len(u[2].split()) * (0.01 + share.get(("text", tag), 1.0))
        elif tag in ("hinted", "article", "main"):
            value = HINT_COST
        else:
            value = -0.001 - 3.0 * (1 - share.get(("tag", tag), 5 / 6 if tag == "dropped" else 1.0))
        if total <= 0:
            total, begin = 0.0, at
        total += value
        if total > best or total == best != 0:
            best, found = total, (begin, at + 1)
    blocks: dict[int, list[str]] = {}
    for u in units[found[0] : found[1]]:
        if u[0] == "text":
            blocks.setdefault(u[3], []).append(u[2])
    texts = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(t for t in texts if t)


def extracted(share: dict[tuple[str, str], float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, share) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", sample: int = 2000) -> DataFrame:
    """page_id, url, text and n_chars of every page. ``sample`` bounds the labelled pages that weights are counted on."""
    pages = df.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    share = learned(pages.select("html"), sample)
    kind = dict(pages.dtypes)["page_id"]
    return pages.mapInArrow(extracted(share), f"page_id {kind}, url string, text string, n_chars bigint")
