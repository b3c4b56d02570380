"""HTML extraction by consensus of a host's pages.

Each page is parsed into blocks of text, each with the path of generalised tags (name, and classes or id without
digits) that leads to it. Containers are scored by how much of their text is running text. In Spark, the paths vote
for their host: the one with the highest sum over the host's pages wins, and every page of the host is extracted again
from its containers of that path, what is named as an article around them, and the headings and running text beside them.
Pages without such a container, and hosts without votes, fall back on the page's
own best container.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfast.llm.common import cut, small_batches, table
from steadfast.llm.url_filter import url_host

#: Up to so many hosts (with their paths about 200 bytes each) the winners are broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 50_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text.
RAW = frozenset("script style template textarea iframe object svg title canvas audio video select".split())
#: Elements that are never part of an article.
CHROME = frozenset("nav footer aside form head button dialog menu fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id or role that mark what stands around an article, or below it.
NOT_MAIN = frozenset(
    """ad ads adsbygoogle adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted
    nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toolbar topbar tabs
    sidebar side aside widget widgets rail complementary
    footer foot colophon copyright legal masthead siteheader sitefooter pageheader header contentinfo
    cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe signup login register search
    comment comments commentlist respond reply replies disqus discussion
    share sharing social related recommended recommendations trending popular more tags outbrain taboola
    skip hidden form""".split()
)
#: What a start tag of one of these ends first, if that is open: HTML leaves such end tags out.
ENDS_P = BLOCKS - {"html", "body"}
ALONE = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
ALONE = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ALONE.items()}

# as in HTML, a quote opens a value only after =; elsewhere in a tag it is a character like others
_VALUE = r"=\s*(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|[^\s>\"'][^\s>]*+)?"
_TOKEN = re.compile(rf"<!--.*?(?:--!?>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|{_VALUE})*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z]+")


CONTAINERS = frozenset("article main section div body td html".split())
#: Labels of a path, and its characters, that are written out; what is deeper or longer is a digest, so that paths stay short however deep a page is.
WRITTEN, LONGEST_PATH = 40, 1000


class Block:
    """A block's text, the innermost open element around it, and how many of its characters stand in links."""

    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: int, linked: int):
        self.text, self.element, self.linked = text, element, linked


class Page:
    """Blocks in page order, and of every element, by number, its parent, name and general path. Parents come first."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parents, self.names, self.paths, self.depths, self.articles = [0], [""], [""], [0], [False]

    def add(self, parent: int, name: str, label: str) -> int:
        path = f"{self.paths[parent]}/{label}"
        if self.depths[parent] >= WRITTEN or len(path) > LONGEST_PATH:
            path = "#" + hashlib.md5(path.encode()).hexdigest()
        self.parents.append(parent), self.names.append(name), self.paths.append(path), self.depths.append(self.depths[parent] + 1)
        self.articles.append(name == "article" or name in CONTAINERS - {"html", "body"} and not ARTICLE_NAMES.isdisjoint(_SPLIT.split(label.lower().partition(".")[2])))
        return len(self.names) - 1


#: With one of these in the same class, a word means something else: with-sidebar; or, if it is one of SOFT, entry-header.
NEGATES = frozenset("with has no without not".split())
OF_ARTICLE, SOFT = frozenset("post article entry story section".split()), frozenset("header tags more side search form popular".split())
#: Elements of running text. Within an article these words don't leave them out: what they mark as such are boxes.
TEXT = frozenset("p span b i em strong a u s small mark q cite code pre blockquote h2 h3 h4 h5 h6 li dt dd td th figcaption time abbr sub sup font label".split())
OF_BOXES = frozenset("related recommended recommendations trending popular more tags legal copyright side complementary search form register login hidden".split())

#: Words of a container's class or id that name it as an article.
ARTICLE_NAMES = OF_ARTICLE - {"section"}


def _is_chrome(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether class, id or role say that the element stands around an article."""
    marks = NOT_MAIN - OF_BOXES if in_article and name in TEXT else NOT_MAIN
    for attribute in ("class", "id", "role"):
        for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", attributes.get(attribute) or "").lower().split():
            pieces = {p for p in _SPLIT.split(token) if p}
            found = ({"".join(_SPLIT.split(token))} | pieces) & marks
            if found and not pieces & NEGATES and not (found <= SOFT and (in_article or pieces & OF_ARTICLE)):
                return True
    return False


def _general(name: str, attributes: dict[str, str]) -> str:
    """The tag with its classes, or else its id, without digits."""
    label = re.sub(r"\d+", "", attributes.get("class") or "").split() or re.sub(r"\d+", "", attributes.get("id") or "").split()
    return ".".join([name, *sorted(set(label))])


def parse(page: str) -> Page:
    """The blocks of text that can be main text, and the elements; in time that follows the page's length."""
    out = Page()
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, number, whether it is left out
    count: Counter[str] = Counter()  # open elements by name
    places: dict[str, list[int]] = {}  # their places in the stack, so that none is searched for
    text: list[str] = []
    linked = at = 0
    seen_body = False

    def flush() -> None:
        nonlocal linked
        if text:
            got = _SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if got:
                out.blocks.append(Block(got, stack[-1][1], linked))
        linked = 0

    def close(k: int) -> None:
        """Ends the open elements from place k on."""
        if any(x[0] in BLOCKS for x in stack[k:]):
            flush()
        for name, _, _ in stack[k:]:
            count[name] -= 1
            places[name].pop()
        del stack[k:]

    def last(names, until=frozenset()) -> int:
        """Place of the innermost open element of these names, if none of `until` is further in; else 0."""
        inner = lambda wanted: max((places[n][-1] for n in wanted if count[n]), default=0)
        found = inner(names)
        return found if found and found >= inner(until) else 0

    def add(piece: str) -> None:
        nonlocal linked
        if not stack[-1][2]:
            text.append(html.unescape(piece) if "&" in piece else piece)
            if count["a"]:
                linked += len(piece.strip())

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        m = _TOKEN.match(page, start)
        if m is None:  # a lone <
            add("<")
            at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                add(" ")
            elif name == "p" and not last({"p"}):
                flush()
            elif name in BLOCKS or name in RAW or len(stack) > 1:
                k = last({name}, frozenset({"article", "body", "main", "td", "th"}) - {name} if name not in BLOCKS else frozenset({"body"}) - {name})
                if k:
                    if name in ("body", "html"):
                        flush()
                    else:
                        close(k)
            continue
        if name == "body" and not seen_body:
            seen_body = True
            if k := last({"head"}):
                close(k)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if not m[3].rstrip().endswith("/") or name in ("script", "style"):
                at = stop.end() if stop else len(page)
            if name in BLOCKS:
                flush()
            continue
        if name == "br":
            add(" ")
            continue
        if name in ENDS_P and (k := last({"p"}, frozenset({"td", "th", "button", "table"}))):
            close(k)
        if name in ALONE and (k := last(*ALONE[name])):
            close(k)
        if name in HEADINGS and stack[-1][0] in HEADINGS:
            close(len(stack) - 1)
        if name in BLOCKS:
            flush()
        if name in VOID:
            continue
        attributes = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in _ATTRIBUTE.findall(m[3])} if m[3].strip(" /\n\t") else {}
        left_out, in_article = stack[-1][2], count["article"] + count["main"] > 0
        if not left_out:
            left_out = name in CHROME or (name == "header" and not in_article) or "hidden" in attributes or attributes.get("aria-hidden") == "true"
            left_out = left_out or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")))
            left_out = left_out or name not in ("html", "body", "article", "main", "h1") and _is_chrome(name, attributes, in_article)
        if m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        stack.append((name, out.add(stack[-1][1], name, _general(name, attributes)), left_out))
        places.setdefault(name, []).append(len(stack) - 1)
        count[name] += 1
    flush()
    return out


def scores(page: Page) -> dict[str, float]:
    """Of every container's path: the characters of running text that stand in it, less those of links, twice.

    A container gives three quarters of its sum to the one around it, so that the innermost that still holds all the text
    is ahead; an article or main element counts twice.
    """
    sums = [0.0] * len(page.names)
    for b in page.blocks:
        sums[b.element] += max(0, len(b.text) - 2 * b.linked)
    found: dict[str, float] = {}
    for n in range(len(sums) - 1, 0, -1):
        if sums[n]:
            name, give = page.names[n], 1.0
            if name in CONTAINERS:
                found[page.paths[n]] = found.get(page.paths[n], 0.0) + sums[n] * (2.0 if name in ("article", "main") else 1.0)
                give = 0.75
            sums[page.parents[n]] += give * sums[n]
    return found


def extract(page: Page, path: str | None) -> str:
    """The blocks in containers of the path, in page order; if there is none, of the page's own best path; else all of them.

    An article's title and lead may stand before the container that wins. So an element around it that is named as an article is
    taken whole; and of the other elements around it those blocks are that stand in no further container, headings and text
    that isn't mostly links. Other containers beside it stay out.
    """
    for wanted in (path, _best(scores(page))):
        if wanted is not None:
            chosen = _inside(page, [x == wanted for x in page.paths])
            if any(chosen[b.element] for b in page.blocks):
                around = [False] * len(page.names)
                for n in range(len(around) - 1, 0, -1):
                    if around[n] or page.paths[n] == wanted:
                        around[page.parents[n]] = True
                inside = _inside(page, [x == wanted or a and b for x, a, b in zip(page.paths, around, page.articles, strict=True)])
                return "\n".join(b.text for b in page.blocks if inside[b.element] or _beside(page, b, around))
    return "\n".join(b.text for b in page.blocks)


def _inside(page: Page, tops: list[bool]) -> list[bool]:
    """Of each element, whether it is one of tops or stands in one."""
    out = [False] * len(tops)
    for n in range(1, len(out)):
        out[n] = out[page.parents[n]] or tops[n]
    return out


def _beside(page: Page, b: Block, around: list[bool]) -> bool:
    """Whether a block is a heading or running text, with no container between it and an element of around."""
    n, heading = b.element, False
    while n and page.names[n] not in CONTAINERS:
        heading = heading or page.names[n] in HEADINGS
        n = page.parents[n]
    return around[n] and (heading or len(b.text) > 2 * b.linked)


def _best(found: dict[str, float]) -> str | None:
    return max(found.items(), key=lambda x: (x[1], x[0]))[0] if found else None


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for each row of pages.

    Null and empty html give ''. Null urls, and urls without ://, are pages of one host, ''. Ids can be null or repeat;
    each row is extracted by itself. Ties of votes go to the path that sorts last. Other columns are dropped. No text is
    capped; memory follows the longest page. An empty table gives no row.
    """
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def vote(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], int] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                found = scores(parse(page.as_py() or ""))
                best = max(found.values(), default=1.0)
                for path, score in found.items():
                    # a page's votes are shares of its best container's score, so that long pages don't outvote others;
                    # whole numbers, so that sums don't depend on their order
                    sums[host, path] = sums.get((host, path), 0) + round(1_000_000 * score / best)
            rows = list(sums.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.int64())], names=["host", "path", "score"])

    votes = small_batches(pages.select("host", "html")).mapInArrow(vote, "host string, path string, score long")
    sums = votes.groupBy("host", "path").agg(F.sum("score").alias("score"))
    winners = cut(sums.groupBy("host").agg(F.max(F.struct("score", "path")).alias("best")).select("host", F.col("best.path").alias("path")))
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    joined = pages.join(winners, "host", "left").select("id", "url", "html", "path")
    schema = pages.select("id", "url").schema.add("text", "string").add("n_chars", "long")

    def again(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, pages_, paths = (batch.column(c) for c in ("id", "url", "html", "path"))
            for at in range(0, batch.num_rows, 500):
                texts = [extract(parse(page.as_py() or ""), path.as_py()) for page, path in zip(pages_[at : at + 500], paths[at : at + 500], strict=True)]
                yield pa.RecordBatch.from_arrays([ids[at : at + 500], urls[at : at + 500], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return small_batches(joined).mapInArrow(again, schema).withColumnsRenamed({"id": id_col, "url": url_col})


def op10_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))
