"""Main text of web pages, by differencing each page with its nearest neighbours in URL order.

A page is read into lines: the text of a block element, with white space folded. Markup says of a line whether it stands in an
article container (``article``, ``main`` ...), in a part that is never the article (menus, forms, adverts ...), or in neither.
Every page is differenced: the pages of a host are ordered by path, a page is aligned with the pages
before and after it by the longest common subsequence of line hashes, and lines in neither that they share are deleted, those that
they don't share are text. A neighbour that is a copy of the page (most of its characters are shared) says nothing: the next one
takes its place, up to the fourth.

On real pages, articles quote the same passages, and menus differ from page to page; so differencing alone deletes true text and
leaves menus. Hence markup overrules it where it says what a line is: lines inside an article container stay, menus go. A page that has
no page to be compared with keeps its container alone, or all lines in neither if it has none.

Only line hashes are shuffled for the alignment. The order is cut into blocks of pages with one page of overlap on
either side, so a host of any size spreads over many tasks, and the pairs don't depend on the partitioning.

Defined cases: null html is an empty page; a page without text gives ""; a null url is a host of its own; pages that repeat
give a row each; extra columns are carried along, but for those named like an added one; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from itertools import groupby
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from spindrift.llm.common import id_key, settle, without

#: Elements whose content is no text, block elements, elements and class words of parts beside the article.
SILENT = frozenset("script style title noscript template iframe object svg canvas math select option textarea button audio video map".split())
BLOCKS = frozenset("address article aside blockquote body center caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BESIDE = frozenset("nav header footer aside form menu dialog".split())
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related respond share sharing sidebar skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IMPLIED = frozenset("p li dt dd tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: A comment, a tag or a declaration. Quotes hide a ">" only after "="; what is never closed goes on to the end, so that no place is read twice.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
#: A name and its value in turn, so that nothing inside a value or a longer name is read as a name.
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_READ = frozenset("class id role itemprop hidden aria-hidden".split())

ARTICLE, NEITHER, BESIDES = 0, 1, 2
#: Characters shared, of a hundred, from which two pages count as copies.
COPY_PERCENT = 80
#: Pages of a block; pages on either side among which the nearest that is no copy is sought.
BLOCK_PAGES, NEAR = 64, 4


def _place(tag: str, attributes: str, inside: bool) -> int | None:
    """The part that an element opens, if it opens one."""
    if tag in ("html", "body"):
        return None
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        if (name := m[1].lower()) in _READ:
            # Of an attribute that repeats, the first counts.
            found.setdefault(name, (m[2] or m[3] or m[4] or "").lower())
    if "hidden" in found or found.get("aria-hidden") == "true":
        return BESIDES
    if tag in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody":
        return BESIDES if BESIDE_WORDS & set(re.split(r"[\s_-]+", found.get("class", ""))) else ARTICLE
    if tag in HEADINGS:
        return None
    if tag in BESIDE and not (tag == "header" and inside):
        return BESIDES
    if found.get("role") in BESIDE_ROLES or BESIDE_WORDS & set(re.split(r"[\s_-]+", found.get("class", "") + " " + found.get("id", ""))):
        return BESIDES
    return None


def page_lines(source: str | None) -> tuple[list[str], list[int]]:
    """The lines of a page in order, and the part of each."""
    source, lines, parts = source or "", [], []
    open_tags: list[tuple[str, int]] = []
    part, buffer, at, silent = NEITHER, [], 0, None

    def flush():
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            lines.append(text)
            parts.append(part)

    def close(k):
        nonlocal part
        if open_tags[k][1] != part:
            flush()
            part = open_tags[k][1]
        del open_tags[k:]

    for token in _TOKEN.finditer(source):
        if silent is None and token.start() > at:
            buffer.append(source[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag, closing = token[2].lower(), token[1] == "/"
        if silent is not None:
            if closing and tag == silent:
                silent = None
            continue
        if tag in SILENT:
            if not closing and not token[3].endswith("/"):
                silent = tag
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            buffer.append(" ")
        if tag in VOID:
            continue
        if closing:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    close(k)
                    break
                if tag in IMPLIED and open_tags[k][0] in BLOCKS:
                    break
        else:
            if tag in BLOCKS:
                # A block ends an open paragraph, and an item or cell the one before it.
                k = len(open_tags) - 1
                while k >= 0 and open_tags[k][0] not in BLOCKS:
                    k -= 1
                if k >= 0 and (open_tags[k][0] == "p" or open_tags[k][0] == tag and tag in IMPLIED):
                    close(k)
            new = part if part == BESIDES else _place(tag, token[3], part == ARTICLE)
            open_tags.append((tag, part))
            if new is not None and new != part:
                flush()
                part = new
    if silent is None:
        buffer.append(source[at:])
    flush()
    return lines, parts


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions of ``a`` on a longest common subsequence with ``b``: rows of bits, traced back."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    state, rows = full, []
    for x in b:
        hit = state & where.get(x, 0)
        state = ((state + hit) | (state - hit)) & full
        rows.append(state)
    found, col, row = [], len(a), len(b)
    while row and col:
        if rows[row - 1] >> (col - 1) & 1:
            col -= 1
        else:
            row -= 1
            if not row or rows[row - 1] >> (col - 1) & 1:
                col -= 1
                found.append(col)
    return found[::-1]


def host_and_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path
    except ValueError:
        return url or "", ""


LINES = "k1 long, k2 long, host string, path string, whole boolean, hashes array<long>, sizes array<int>, parts array<int>"


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.withColumns({"_hx1": id_key(F.col(id_col)), "_hx2": F.xxhash64(F.col(url_col), F.col(html_col))})


def _lines(keyed: DataFrame, url_col: str, html_col: str) -> DataFrame:
    def run(batches):
        import xxhash

        for batch in batches:
            rows = []
            for k1, k2, url, source in zip(*(c.to_pylist() for c in batch.columns)):
                lines, parts = page_lines(source)
                hashes = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines]
                rows.append((k1, k2, *host_and_path(url), ARTICLE in parts, hashes, [len(x) for x in lines], parts))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["k1", "k2", "host", "path", "whole", "hashes", "sizes", "parts"])

    return keyed.select("_hx1", "_hx2", url_col, html_col).mapInArrow(run, LINES)


def _ordered(lines: DataFrame) -> DataFrame:
    """Adds the place of each page in the order of host and path, over all pages."""
    sort = ["host", "path", "k1", "k2"]
    ranged = lines.repartitionByRange(*sort).sortWithinPartitions(*sort)

    def number(batches):
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(nth, nth + n))], [*batch.schema.names, "part", "nth"])
            nth += n

    numbered = settle(ranged.mapInArrow(number, LINES + ", part int, nth long"), "ordered")
    counts = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return numbered.join(firsts, "part").withColumn("at", F.col("first") + F.col("nth")).drop("part", "nth", "first")


def shared_lines(page: dict, sides: list[list[dict]]) -> list[int] | None:
    """Positions of lines that are neither article nor beside it, and that the nearest page of a side shares; copies are passed over. None: no page to compare with."""
    lost, compared = set(), False
    for side in sides:
        for other in side:
            common = common_lines(page["hashes"], other["hashes"])
            shared, total = sum(page["sizes"][k] for k in common), max(sum(page["sizes"]), sum(other["sizes"]))
            if 100 * shared < COPY_PERCENT * total:
                lost.update(k for k in common if page["parts"][k] == NEITHER)
                compared = True
                break
    return sorted(lost) if compared else None


def template_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(_hx1, _hx2, _hx_lost): pages that differencing has a say on, and the positions of the lines that it deletes.

    Every page is compared. Those left out lose no line, and either have no container or no line in neither.
    """
    keyed = _keyed(pages, id_col, url_col, html_col)
    placed = _ordered(settle(_lines(keyed, url_col, html_col), "lines"))
    block_of = lambda shift: F.floor((F.col("at") + shift) / BLOCK_PAGES)
    blocks = F.array_distinct(F.array(block_of(-NEAR), block_of(0), block_of(NEAR)))
    spread = placed.withColumn("own", block_of(0)).withColumn("block", F.explode(blocks)).repartition("block").sortWithinPartitions("block", "at")

    def align(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, block in groupby(rows, key=lambda row: row["block"]):
            pages, done = list(block), []
            for k, page in enumerate(pages):
                if page["own"] == page["block"]:
                    sides = [pages[max(0, k - NEAR) : k][::-1], pages[k + 1 : k + 1 + NEAR]]
                    lost = shared_lines(page, [[x for x in side if x["host"] == page["host"]] for side in sides])
                    if lost or lost is not None and page["whole"] and NEITHER in page["parts"]:
                        done.append((page["k1"], page["k2"], lost))
            if done:
                yield _flags(done)

    return spread.mapInArrow(align, "_hx1 long, _hx2 long, _hx_lost array<int>").dropDuplicates(["_hx1", "_hx2"])


def _flags(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.int32()))], ["_hx1", "_hx2", "_hx_lost"])


def page_text(source: str | None, lost: list[int] | None) -> str:
    """The text of a page of which differencing deletes ``lost``; None: it was compared with no page, or lost nothing without a container."""
    lines, parts = page_lines(source)
    if lost is None and ARTICLE in parts:
        return "\n".join(x for x, p in zip(lines, parts) if p == ARTICLE)
    gone = set(lost or ())
    return "\n".join(x for k, (x, p) in enumerate(zip(lines, parts)) if p != BESIDES and k not in gone)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All columns but the html, with text and n_chars (its code points, long)."""
    pages = without(pages, ("text", "n_chars", "_hx1", "_hx2", "_hx_lost"))
    keyed = _keyed(pages, id_col, url_col, html_col)
    # Few pages have lines in neither where pages mark their articles: Spark sees the size of the written table, and broadcasts it if small.
    met = keyed.join(settle(template_lines(pages, id_col, url_col, html_col), "template"), ["_hx1", "_hx2"], "left")
    kept = [c for c in pages.columns if c != html_col]
    schema = StructType([pages.schema[c] for c in kept]).add("text", StringType()).add("n_chars", LongType())

    def run(batches):
        for batch in batches:
            *own, sources, lost = batch.columns
            texts = [page_text(s, x) for s, x in zip(sources.to_pylist(), lost.to_pylist())]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    return met.select(*kept, html_col, "_hx_lost").mapInArrow(run, schema)
