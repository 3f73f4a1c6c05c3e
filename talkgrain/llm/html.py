"""Main text of web pages: nearest-URL page differencing, with the marks that pages carry.

Every page is cut into text lines (blocks). Pages of a host are sorted by URL path; each is paired with the neighbour that
shares more leading path segments (ties: the one before), their lines are aligned by longest common subsequence, and shared
lines are template. Where a page itself says what a line is, that decides: lines inside menus, footers, forms and the like
are dropped whether shared or not, and lines of the article stay even if the nearest page has them too, as a copy would.
Outside of marked parts, shared lines and lines made of links only are deleted, and so is everything beside a marked article.
A nearest page with the same lines throughout is a copy and tells nothing about templates: nothing is deleted then.

Only hashes of lines are sorted, paired and aligned; the html is read twice and not shuffled unless the list of deleted lines
is too large to broadcast. The sort is a range partition by (host, path), so a host with most pages is many tasks; neighbours
across the ends of partitions are found through one row per end.

Defined results: null html is empty; a page without main text gives an empty text; each row, repeated ones and those with a
null id or url too, gets its own row (rows without a url share one host without a path); markup that ends early is read to
its end; an empty table gives an empty result; other columns are ignored, whatever their names; pages of any length are read
whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm.common import Scratch, checked, text_of

#: Elements that hold no article text, and words of class, id and role that mark such elements.
NOT_TEXT = frozenset("head script style noscript template iframe object svg canvas nav footer aside form select button textarea dialog menu".split())
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion promoted banner billboard
    cookie cookies consent gdpr notice alert popup modal overlay nav navbar navigation navigator menu menubar breadcrumb breadcrumbs
    sidebar complementary contentinfo widget widgets masthead topbar toolbar footer comment comments commentlist discussion disqus
    respond reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup login
    search pagination pager skip copyright dialog form""".split()
)
#: Marks of headers, which an article may have of its own; of cards, which look like articles; words that turn marks around.
HEADERS, CARDS, TURNED = frozenset(["header", "head", "top"]), frozenset("comment comments reply related teaser card ad sponsored promo".split()), frozenset("with has no without".split())
ARTICLE = frozenset("article main".split())
ARTICLE_MARKS = frozenset(["articlebody", "main"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
IN_HEAD = frozenset("head base link meta".split())
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe"])
CLOSES_ITSELF = frozenset("li dt dd tr td th option".split())

#: Cells of the alignment's matrix, in bits, that are kept to read the alignment off; larger ones are halved first.
MATRIX_BITS = 1 << 28

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/>]|$)""", re.I)
_WORD = re.compile("[a-z]+")

DROPPED, KEPT, OPEN = 0, 1, 2


class _Open:
    """An element that is open: whether its text is dropped, or belongs to the article."""

    __slots__ = ("tag", "dropped", "article")

    def __init__(self, tag: str, dropped: bool, article: bool):
        self.tag, self.dropped, self.article = tag, dropped, article


def _opened(tag: str, attributes: str, over: _Open) -> _Open:
    dropped, article = over.dropped or tag in NOT_TEXT or tag == "header" and not over.article, over.article
    starts = tag in ARTICLE
    if attributes and not dropped and tag not in ("html", "body"):
        words: set[str] = set()
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "").lower()
            if name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true":
                dropped = True
            for part in value.split():
                found = _WORD.findall(part)
                words.update(found if not TURNED & set(found) else ())
        starts = starts or bool(words & ARTICLE_MARKS)
        marks = CARDS if starts else MARKS if article else MARKS | HEADERS
        dropped = dropped or bool(words & marks)
    if tag == "main":
        dropped = False
    return _Open(tag, dropped, (article or starts) and not dropped)


def _tops(stack: list[_Open]) -> Iterator[str]:
    """The inline elements that are open inside the innermost block."""
    for element in reversed(stack):
        if element.tag not in INLINE:
            return
        yield element.tag


def page_lines(html: str) -> list[tuple[str, int]]:
    """A page's text lines in page order: text with references decoded and white space runs as one space, and DROPPED, KEPT (of the article) or OPEN."""
    stack = [_Open("", False, False)]
    counts: dict[str, int] = {}
    lines: list[tuple[str, int]] = []
    pieces: list[str] = []
    linked = plain = False

    def end_line() -> None:
        nonlocal linked, plain
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                top = stack[-1]
                kind = DROPPED if top.dropped else KEPT if top.article else OPEN
                lines.append((text, DROPPED if kind == OPEN and linked and not plain else kind))
            pieces.clear()
        linked = plain = False

    def close(tag: str) -> None:
        while True:
            last = stack.pop()
            counts[last.tag] -= 1
            if last.tag == tag:
                return

    def say(text: str) -> None:
        nonlocal linked, plain
        if text:
            pieces.append(text)
            if not text.isspace():
                if counts.get("a"):
                    linked = True
                else:
                    plain = True

    at, size, tag_of = 0, len(html), _TAG
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        say(html[at:lt])
        following = html[lt + 1 : lt + 2]
        if following in ("!", "?"):
            end = html.find("-->", lt + 4) if html.startswith("<!--", lt) else html.find(">", lt)
            at = size if end < 0 else end + (3 if html.startswith("<!--", lt) else 1)
            continue
        if following != "/" and not following.isalpha():
            say("<")
            at = lt + 1
            continue
        m = tag_of.match(html, lt)
        if not m and tag_of is _TAG and html.find(">", lt) >= 0:
            tag_of = _PLAIN_TAG  # a quote that never ends: quotes count no more on this page
            m = tag_of.match(html, lt)
        if not m:
            end = html.find(">", lt) if following == "/" else -1  # </ and no name is a comment; a tag without an end is the end of the page
            at = size if end < 0 else end + 1
            continue
        at, tag = m.end(), m.group(1).lower()
        block = tag not in INLINE
        if block:
            end_line()
        if following == "/":
            if counts.get(tag) and (block or tag in _tops(stack)):
                close(tag)
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if block and tag not in IN_HEAD and counts.get("head"):
            close("head")
        if block and tag != "br" and counts.get("p"):
            close("p")
        if tag in CLOSES_ITSELF and stack[-1].tag == tag:
            close(tag)
        if tag not in VOID and not m.group(2).endswith("/"):
            stack.append(_opened(tag, m.group(2), stack[-1]))
            counts[tag] = counts.get(tag, 0) + 1
    end_line()
    return lines


def main_text(lines: list[tuple[str, int]], deleted: set[int]) -> str:
    """The article's lines; of a page that marks no article, the lines that are neither marked otherwise nor deleted."""
    marked = any(kind == KEPT for _, kind in lines)
    return " ".join(text for k, (text, kind) in enumerate(lines) if kind == KEPT or kind == OPEN and not marked and k not in deleted)


def _rows(a: np.ndarray, b: np.ndarray) -> Iterator[int]:
    """Bit rows of the subsequence table: after each element of b, bit i is 0 where the length grows at a[i]."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        u = row & at.get(y, 0)
        row = ((row + u) | (row - u)) & full
        yield row


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequence of each prefix of a with all of b."""
    row = (1 << len(a)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of a on a longest common subsequence of a and b (hashes of lines)."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64)
    if len(a) * len(b) > MATRIX_BITS and len(b) > 1:  # halve b, and cut a where the lengths of both sides add up to most
        half = len(b) // 2
        cut = int(np.argmax(_lengths(a, b[:half]) + _lengths(a[::-1], b[half:][::-1])[::-1]))
        return np.concatenate([shared(a[:cut], b[:half]), shared(a[cut:], b[half:]) + cut])
    width = len(a) // 8 + 1
    rows = [r.to_bytes(width, "little") for r in _rows(a, b)]
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[j - 1][(i - 1) >> 3] >> ((i - 1) & 7) & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1][(i - 1) >> 3] >> ((i - 1) & 7) & 1:
                i -= 1
                out.append(i)
    return np.array(out[::-1], np.int64)


def _profiles(rows: DataFrame) -> DataFrame:
    """Per page of (page, digest, host, path, html): hashes of its lines, and the numbers of its open lines if these decide its text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, open_ = [], []
            for i in range(len(b)):
                lines = page_lines(b.column(4)[i].as_py())
                hashes.append([xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t, _ in lines])
                open_.append([] if any(k == KEPT for _, k in lines) else [k for k, (_, kind) in enumerate(lines) if kind == OPEN])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(hashes, pa.list_(pa.int64())), pa.array(open_, pa.list_(pa.int32()))], ["page", "digest", "host", "path", "lines", "open"])

    kind = rows.schema["page"].dataType.simpleString()
    return rows.mapInArrow(read, f"page {kind}, digest binary, host string, path array<string>, lines array<long>, open array<int>").withColumn("key", F.monotonically_increasing_id())


def _common(a, b):
    """How many leading segments two paths share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other == 0, F.size(same)).otherwise(first_other - 1)


def nearest(profiles: DataFrame, scratch: Scratch) -> DataFrame:
    """profiles (key, page, digest, host, path) sorted by host and path, then by content and id: key, near (the key of the nearest page of the host)."""
    order = ["host", "path", "digest", "page", "key"]
    placed = profiles.select(order).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    placed = scratch.save(placed, "placed")
    me = F.struct(*order)
    ends = placed.groupBy("part").agg(F.min(me).alias("first"), F.max(me).alias("last"))  # one row per partition
    all_ends = Window.partitionBy(F.lit(0)).orderBy("part")
    ends = ends.select("part", F.lag("last").over(all_ends).alias("_before"), F.lead("first").over(all_ends).alias("_after"))
    w = Window.partitionBy("part").orderBy(*order)
    rows = placed.withColumn("before", F.lag(me).over(w)).withColumn("after", F.lead(me).over(w)).join(F.broadcast(ends), "part")
    for side in ("before", "after"):
        rows = rows.withColumn(side, F.coalesce(side, f"_{side}"))
        rows = rows.withColumn(f"_{side}", F.when(F.col(f"{side}.host") == F.col("host"), _common(F.col("path"), F.col(f"{side}.path"))))
    near = F.when(F.col("_after").isNotNull() & (F.col("_after") > F.coalesce("_before", F.lit(-1))), F.col("after.key")).when(F.col("_before").isNotNull(), F.col("before.key"))
    return rows.select("key", near.alias("near")).filter("near is not null")


def _deleted(pairs: DataFrame) -> DataFrame:
    """Of pairs (page, digest, lines, open, near_lines) the open lines that both pages share."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for i in range(len(b)):
                mine, open_, other = (np.array(b.column(c)[i].as_py() or [], np.int64) for c in (2, 3, 4))
                gone.append([] if np.array_equal(mine, other) else np.intersect1d(shared(mine, other), open_))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(gone, pa.list_(pa.int32()))], ["page", "digest", "deleted"])

    kind = pairs.schema["page"].dataType.simpleString()
    return pairs.mapInArrow(align, f"page {kind}, digest binary, deleted array<int>").filter("size(deleted) > 0")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (the page's main text), n_chars."""
    scratch = Scratch(pages.sparkSession, "html")
    url = text_of(url_col)
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)", 1))
    path = F.split(F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*", ""), "(?s)[?#].*$", ""), "/")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat_ws("\n", F.coalesce("url", F.lit("")), "html"), 256)))
    profiles = scratch.save(_profiles(rows.withColumn("host", host).withColumn("path", path).select("page", "digest", "host", "path", "html")), "profiles")
    other = profiles.select(F.col("key").alias("near"), F.col("lines").alias("near_lines"))
    pairs = profiles.drop("host", "path").join(nearest(profiles, scratch), "key").join(other, "near")
    gone = scratch.save(_deleted(pairs.select("page", "digest", "lines", "open", "near_lines")), "deleted")
    # rows that repeat id, url and html take the same list
    gone = gone.groupBy(F.col("page").alias("_page"), F.col("digest").alias("_digest")).agg(F.max("deleted").alias("deleted"))
    gone, _ = checked(gone)
    rows = rows.join(gone, F.col("page").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page", "url", "html", "deleted")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page_lines(h.as_py()), set(d.as_py() or ())) for h, d in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(extract, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string, n_chars long")
