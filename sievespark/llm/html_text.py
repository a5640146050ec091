"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of styles, whose nodes are the paths of tags and classes and whose
leaves are the texts of blocks. A node that shows the same things on all pages of its host (the styles and texts
under it) has low entropy and so low importance, as has a text that stands on nearly all pages; what differs from
page to page is content. Every page then drops its branches and blocks of low importance, inside the article as
well as outside, besides the parts that say themselves that they are never main text: menus, headers outside the article,
footers, asides, forms and their buttons, scripts, styles, frames, dialogues, what is ``hidden`` or ``aria-hidden``, and
what its role, class or id names as such.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A branch whose importance is below the first goes; a single block only below the second, where practically all
#: pages of the host show it, since a line that many articles quote is still theirs.
LEAST_IMPORTANCE, LEAST_OF_BLOCK = 0.15, 0.02
#: Made-up pages that each show something else, added to every host: what few pages share proves little.
PRIOR_PAGES = 1
#: Bytes of low-importance nodes up to which they are broadcast to the pages.
BROADCAST_BYTES = 32 << 20
#: Fixed values of HTML: elements without end tags, with raw text, and inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg math iframe object canvas xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are closed by the start of one of those listed.
CLOSED_BY = {
    "p": frozenset("li dt dd td th tr address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"]),
}
#: Elements, roles and class or id words of what is never main text.
NEVER = frozenset("nav footer aside form button select input datalist dialog menu head audio video map".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead "
    "cookie cookies consent gdpr notice alert popup modal newsletter subscribe subscription share sharing social comment comments disqus replies reply related recommended pagination pager "
    "toolbar topbar sidenav offcanvas dropdown submenu skip copyright adsbygoogle adslot adbox outbrain taboola respond signup".split()
)
#: Words that say where or in what a part stands; a name of several words counts only if all others are such.
PLACES = frozenset(
    "area bar block body bottom box button buttons col column container content count counter desktop end footer form group head header icon icons inner item items js label left link links list "
    "main message messages mobile module network networks outer overlay page panel post posts primary right row secondary section site slot start sticky stories text title tools top unit widget widgets wrap wrapper zone".split()
)
#: The same that hold only outside the article, where a header belongs to the page.
OUTSIDE = frozenset(["header"])
MAIN = frozenset(["article", "main"])

#: Elements inside the article that are judged block by block, as the path alone doesn't tell one from the next.
KEPT = frozenset("p h1 h2 h3 h4 h5 h6".split()) | MAIN
#: Class words that make even an article a reader's comment, and beginnings of names that only tell a layout.
COMMENTS = frozenset("comment comments reply replies".split())
LAYOUT = ("has-", "with-", "no-")

#: A tag's attributes as a browser reads them: a quote opens a value only behind ``=`` and a name, anywhere else it is a
#: character like others; an open value runs to the end of the page. Every part is taken whole, so time is linear.
_NAME = r"[^\s/>][^\s/>=]*+"
_VALUE = r"\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+)"
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))"
_TOKEN = re.compile(rf"{_COMMENT}|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:{_VALUE})?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+")
_SPLIT = re.compile(r"[^a-z0-9]+")
_PLAIN_TAG = re.compile(r"\s*/?\s*")
_ROOT = xxhash.xxh64_intdigest("root")


class Block(NamedTuple):
    """Text of one block; whether it is never main text, in the article, under a node of low importance."""

    text: str
    never: bool
    main: bool
    low: bool


class _Node(NamedTuple):
    tag: str
    key: int
    never: bool
    main: bool
    low: bool
    seen: list[int]


def _attributes(raw: str) -> dict[str, str]:
    if _PLAIN_TAG.fullmatch(raw):
        return {}
    out: dict[str, str] = {}
    for k, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(k.lower(), a or b or c)
    return out


def _words(attributes: dict[str, str]) -> set[str]:
    """What class and id say of a part: the word of each name that is one word, and of a name of several (split at
    anything but letters and digits) those of ``WORDS``, if the rest only tell its place. ``cookie-bar`` is a notice about
    cookies, ``share-price`` is not about sharing."""
    found: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = [w for w in _SPLIT.split(name) if w and not w.isdigit()]
        if len(words) == 1:
            found.update(words)
        elif not name.startswith(LAYOUT) and all(w in WORDS or w in PLACES for w in words):
            found.update(w for w in words if w in WORDS)
    return found


def _never(tag: str, attributes: dict[str, str], main: bool) -> bool:
    """The element says itself that it isn't main text."""
    if tag in NEVER or tag in OUTSIDE and not main:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if attributes.get("role") in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    words = _words(attributes)
    if tag in MAIN:
        return bool(words & COMMENTS)
    return bool(words & WORDS) or not main and bool(words & OUTSIDE)


def _digest(numbers: list[int]) -> int:
    return xxhash.xxh64_intdigest(b"".join([x.to_bytes(8, "little") for x in numbers]))


def parse(page: str, low: frozenset[int] | set[int] = frozenset()) -> tuple[list[Block], dict[int, list[int]], dict[int, str]]:
    """Blocks of a page in order, for each style node the hashes of what its elements hold, and the leaves with their texts.

    A leaf is a block's text under its node, as one hash. An element's hash covers the styles and texts of all that is in it, so a frame around changing content
    changes with it. Tolerant and linear: unclosed elements end with the one around them, stray end tags are
    ignored, raw elements run to their end tag, and a page cut off anywhere gives what it holds. An inline
    element that is never main text is left out of its block's text, at most up to the end of the block.
    """
    digest = xxhash.xxh64_intdigest
    stack = [_Node("", _ROOT, False, False, False, [])]
    open_tags: dict[str, int] = {}
    shown: dict[int, list[int]] = {}
    blocks: list[Block] = []
    leaves: dict[int, str] = {}
    parts: list[str] = []
    muted: list[str] = []
    at, size = 0, len(page)

    def flush() -> None:
        muted.clear()
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = stack[-1]
                top.seen.append(digest(text))
                leaf = digest(text, top.key)
                leaves[leaf] = text
                blocks.append(Block(text, top.never, top.main, top.low or leaf in low))

    def pop() -> None:
        node = stack.pop()
        open_tags[node.tag] -= 1
        shown.setdefault(node.key, []).append(_digest(node.seen))
        stack[-1].seen.extend((node.key, shown[node.key][-1]))

    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            parts.append("" if muted else page[at:])
            break
        if found.start() > at and not muted:
            parts.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif found[1] and muted[-1:] == [tag]:
                muted.pop()
            elif not found[1] and tag not in VOID and (muted[-1:] == [tag] or not muted and _never(tag, _attributes(found[3]), True)):
                muted.append(tag)
            continue
        if found[1]:
            if open_tags.get(tag):
                flush()
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        raw = found[3]
        if tag in RAW:
            if tag not in ("svg", "math") or not raw.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            continue
        flush()
        while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
            pop()
        if tag in VOID:
            continue
        attributes, above = _attributes(raw), stack[-1]
        main = above.main or tag in MAIN or attributes.get("role") in ("main", "article")
        key = digest(f"{tag}.{attributes.get('class', '')}", above.key)
        never = above.never or _never(tag, attributes, main)
        stack.append(_Node(tag, key, never, main, above.low or key in low and not (main and tag in KEPT), []))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    while len(stack) > 1:
        pop()
    return blocks, shown, leaves


def main_text(page: str, low: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of the blocks that are main text and of no low importance, one a line.

    If the page has an article or main element only its blocks count. Each block is decided by its own importance; only
    a page of which nothing would be left keeps what it has.
    """
    wanted = [b for b in parse(page, low)[0] if not b.never]
    if any(b.main for b in wanted):
        wanted = [b for b in wanted if b.main]
    left = [b for b in wanted if not b.low]
    return "\n".join(b.text for b in left or wanted)


def others(leaves: dict[int, str]) -> dict[int, int]:
    """For each leaf what tells its page from others: the hash of the longest text that the page shows besides it.

    Pages that show one article at many addresses have the same longest text beside any of its blocks, whatever date or
    count differs, so all of them say once that the block is there. Under 0 stands the longest text of all.
    """
    ranked = sorted(((len(t), xxhash.xxh64_intdigest(t)) for t in {*leaves.values()}), reverse=True)[:2]
    first, second = (ranked + [(0, 0), (0, 0)])[:2]
    return {0: first[1]} | {leaf: second[1] if xxhash.xxh64_intdigest(t) == first[1] else first[1] for leaf, t in leaves.items()}


_SIGNED = 1 << 63


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGNED else x


def host_of(url_col: str):
    """Host of a URL in lower case; empty for a null or odd URL, whose pages are never merged into a tree."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def style_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, leaf, node, shown, n)``: on how many pages of a host a node shows what the hash ``shown`` stands for.

    ``shown`` covers all that stands under the node's elements: styles (presentation) and texts (content). For a leaf,
    and for node 0, the page itself, it is what tells the page from others (``others``). Counts are summed in each task
    before they are shuffled by all four, so a host with a third of all pages is spread like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, kinds, nodes, seen = [], [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, shown, leaves = parse(page.as_py())
                beside = others(leaves)
                nodes += [*map(_signed, shown), *map(_signed, beside)]
                seen += [*(_signed(_digest(parts)) for parts in shown.values()), *map(_signed, beside.values())]
                kinds += [False] * len(shown) + [True] * len(beside)
                hosts += [host] * (len(nodes) - len(hosts))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(kinds, pa.bool_()), pa.array(nodes, pa.int64()), pa.array(seen, pa.int64())], names=["host", "leaf", "node", "shown"])

    rows = pages.select(host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).where("host != ''")
    return rows.mapInArrow(run, "host string, leaf boolean, node bigint, shown bigint").groupBy("host", "leaf", "node", "shown").agg(F.count(F.lit(1)).alias("n"))


def importance(counts: DataFrame) -> DataFrame:
    """``(host, node, pages, importance)`` of the style nodes, between 0 (always the same) and 1.

    The normalised entropy of what a node shows on m pages, n_i of them the i-th thing, and on the prior's a pages,
    each something else: with M = m + a it is (log M - sum(n_i log n_i) / M) / log M.
    """
    m, plogp = F.sum("n").alias("pages"), F.sum(F.col("n") * F.log(F.col("n"))).alias("s")
    sums = counts.where("NOT leaf").groupBy("host", "node").agg(m, plogp)
    every = F.col("pages") + F.lit(PRIOR_PAGES)
    return sums.select("host", "node", "pages", (1 - F.col("s") / (every * F.log(every))).alias("importance"))


def leaf_importance(counts: DataFrame) -> DataFrame:
    """``(host, node, pages, importance)`` of the leaves on two pages or more: 1 - log n / log(m + a), as above.

    That is one less the normalised entropy of a text's spread over the pages: 1 on one page, near 0 on all. Pages count
    as often as they differ: n are the different longest texts beside the leaf, m those of the host's pages.
    """
    marks = counts.where("leaf").groupBy("host", "node").agg(F.count(F.lit(1)).alias("pages"))
    leaves, hosts = marks.where("node != 0 AND pages > 1"), marks.where("node = 0").select("host", F.col("pages").alias("m"))
    spread = F.greatest(F.lit(0.0), 1 - F.log("pages") / F.log(F.greatest("m", "pages") + F.lit(PRIOR_PAGES)))
    return leaves.join(hosts, "host").select("host", "node", "pages", spread.alias("importance"))


def low_nodes(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: float = LEAST_IMPORTANCE, least_of_block: float = LEAST_OF_BLOCK) -> DataFrame:
    """``(host, low)``: for each host the nodes and leaves that go, one row a host, only hosts that have such.

    A host's leaves of low importance stand on nearly all its pages, so they are no more than a page's blocks or so.
    """
    counts = materialize(style_counts(pages, url_col, html_col), "style-counts")
    found = importance(counts).where(F.col("importance") < least).unionByName(leaf_importance(counts).where(F.col("importance") < least_of_block))
    return materialize(found.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("low")), "low-nodes")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST_IMPORTANCE, least_of_block: float = LEAST_OF_BLOCK) -> DataFrame:
    """``(page_id, url, text)`` per row of ``pages``, from its whole html; a null or empty html gives an empty text.

    The low nodes of all hosts are broadcast if they are at most ``BROADCAST_BYTES`` in all. Beyond that pages
    meet those of their host in a shuffled join, where Spark splits a host that holds many pages. Either way
    every page keeps its row, also repeated ones.
    """
    low = low_nodes(pages, url_col, html_col, least, least_of_block)
    size = low.agg(F.sum(F.length("host") + 8 * F.size("low"))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(url_col).alias("host"))
    rows = rows.join(F.broadcast(low) if size <= BROADCAST_BYTES else low, "host", "left")

    @F.pandas_udf("string")
    def text_of(page: pd.Series, low: pd.Series) -> pd.Series:
        sets = ({x & (2 * _SIGNED - 1) for x in map(int, nodes)} if nodes is not None else frozenset() for nodes in low)
        return pd.Series([main_text(p, s) for p, s in zip(page, sets)], dtype=object)

    return rows.select("page_id", "url", text_of("html", "low").alias("text"))
