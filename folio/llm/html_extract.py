"""Main-text extraction by nearest-URL page differencing.

A page is cut into lines: one for each block of text, and one for each container of page chrome
(navigation, header, footer, sidebar, notice, advert, form, comments), whatever it holds, because
a site fills the same chrome with other words on every page.  Pages are put in the order of their
host and path, and each page is paired with its nearest neighbour in that order within the host
that is no copy of it (a page before it, or one after).  The pair's lines are aligned by a longest
common subsequence and lines that both share are deleted.

The alignment alone decides on text outside of articles and on containers whose name (class or id)
only ends in a chrome word (``site-header``): such a container goes if the neighbour has one like it
and stays if not.  Such names count by themselves where no other page of the host is at hand.  A container by name,
or a form, that holds an article or main is no chrome.  A chrome word among others (``header-text``,
``share-price``) says nothing.

Two checks follow.  A text block inside an article element is content even if the neighbour
repeats it (copied paragraphs are common), so it stays.  Containers that their tag, their role or their
whole name (``ad``, ``cookie-banner``, ``comment-list``, inside articles too) tells as chrome go though the neighbour lacks them.  Scripts, styles and markup never are lines.

Hosts are cut into blocks of neighbouring pages, each about as long as ``BLOCK`` or a 65,536th of all pages.
Where a block begins depends on the pages alone (those with a certain hash of path and id begin one), and
neighbours are looked for within a block, so results do not depend on partitions or tasks, and one host's pages lie in
many tasks.  Of copies at hand only ids and urls are held.

Defined results: null and empty html give an empty text; null urls count as empty; repeated
pages are each extracted; text outside of any block counts as a block; unclosed and misnested
tags are tolerated; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Pages of a block on average, at least; and blocks of large hosts in all, about: their beginnings go to all tasks.
BLOCK, BLOCKS = 256, 1 << 16
#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr ruby rt rp img".split()
)
HIDDEN = frozenset("script style noscript template svg math iframe object canvas head title textarea".split())
CHROME = frozenset("nav header footer aside form menu dialog select button fieldset".split())
ARTICLE = frozenset("article main".split())
CHROME_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget notice cookie cookies "
    "consent banner ad ads advert adverts advertisement advertising sponsor sponsored promo popup modal newsletter subscribe "
    "share sharing social comment comments respond reply related form login toolbar pagination pager skip alert".split()
)
NEUTRAL_WORDS = frozenset(
    "area articles bar block body box button container content group inner item items left link links list outer panel posts right row "
    "section wrap wrapper".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_NAME_WORDS = re.compile(r"[A-Za-z]+")
#: Cells up to which a piece of an alignment is solved by a table.
_CELLS = 4096


@dataclass
class Line:
    key: str  # what has to be equal for two lines to be aligned
    text: str
    article: bool
    chrome: bool
    named: bool = False  # chrome by the end of its class or id alone


def _chrome_name(name: str, in_article: bool) -> str:
    """What a class or id tells: chrome, if it is made of chrome words; named, if it ends in one outside of articles."""
    words = [w for w in (w.lower() for w in _NAME_WORDS.findall(name)) if w not in NEUTRAL_WORDS]
    if words and all(w in CHROME_WORDS for w in words):
        return "chrome"
    return "named" if words and not in_article and words[-1] in CHROME_WORDS else ""


def _part(tag: str, attrs: str, in_article: bool, holder: bool = False) -> tuple[str, bool]:
    """chrome, named (perhaps chrome, by the end of a class or id), hidden, article or nothing; holder: it has an article inside.

    And whether it would be none with an article inside: by name, or a form."""
    if tag in HIDDEN:
        return "hidden", False
    names: list[str] = []
    for m in _ATTR.finditer(attrs or ""):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden", False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "hidden", False
        if name == "role" and value.lower() in CHROME_ROLES:
            return "chrome", False
        if name in ("class", "id"):
            names += value.split()
    # the heading of an article may stand in a header element of its own
    if tag in CHROME and not (tag == "header" and in_article) and not (tag == "form" and holder):
        return "chrome", tag == "form"
    if tag in ("html", "body"):
        return "", False
    told = {_chrome_name(x, in_article) for x in names} - {""} if not (tag in ARTICLE or holder) else set()
    if told:
        return min(told), True  # chrome before named
    return "article" if tag in ARTICLE else "", False


def page_lines(html: str | None) -> list[Line]:
    """The lines of a page in order."""
    holders: set[int] = set()
    lines = _lines(html or "", holders)
    return _lines(html or "", holders) if holders else lines


def _lines(html: str, holders: set[int]) -> list[Line]:
    """The lines, given the places of containers by name and forms that hold an article; adds those it finds."""
    known = frozenset(holders)
    out: list[Line] = []
    stack: list[tuple[str, str, int, bool]] = []  # (tag, part, place, whether an article inside makes it none)
    depth = {"chrome": 0, "named": 0, "hidden": 0, "article": 0}
    buffer: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
        buffer.clear()
        if not text or depth["hidden"]:
            return
        if depth["named"] and out[-1].named:
            # what is chrome by its tag goes, whatever becomes of the container around it
            if not depth["chrome"]:
                out[-1].text += ("\n" if out[-1].text else "") + text
        elif depth["chrome"]:
            out[-1].text += ("\n" if out[-1].text else "") + text
        else:
            out.append(Line(text, text, depth["article"] > 0, False))

    def close(upto: int) -> None:
        while len(stack) > upto:
            _, part, _, _ = stack.pop()
            if part:
                depth[part] -= 1

    at = 0
    size = len(html)
    while at < size:
        m = _TAG.search(html, at)
        end = m.start() if m else size
        if end > at and not depth["hidden"]:
            buffer.append(html[at:end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "img":
            buffer.append(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in VOID or (m[3] or "").rstrip().endswith("/") and tag not in _RAW_END:
            continue
        if tag in _RAW_END:
            found = _RAW_END[tag].search(html, at)
            rest = html.find(">", found.end()) + 1 if found else size
            at = rest if rest > 0 else size
            continue
        if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == tag:
            close(len(stack) - 1)
        part, unless = _part(tag, m[3], depth["article"] > 0, m.start() in known)
        if part in ("chrome", "named") and not depth["chrome"] and not depth["named"] and not depth["hidden"]:
            names = " ".join(sorted(w.lower() for a in _ATTR.finditer(m[3] or "") for w in _NAME_WORDS.findall(a[2] or a[3] or a[4] or "")))
            out.append(Line(f"\x00{tag} {names}", "", depth["article"] > 0, True, part == "named"))
        if part == "article" and not depth["hidden"]:
            holders.update(place for _, _, place, if_none in stack if if_none)
        stack.append((tag, part, m.start(), unless))
        if part:
            depth[part] += 1
    flush()
    return out


def _last_row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x and the beginnings of y."""
    row = np.zeros(len(y) + 1, np.int64)
    for v in x:
        row[1:] = np.maximum.accumulate(np.where(y == v, row[:-1] + 1, row[1:]))
    return row


def _on_common(x: np.ndarray, y: np.ndarray, at: int, out: list[int]) -> None:
    """Add to out the places (from ``at``) of x that lie on a longest common subsequence with y; space is linear."""
    while len(x) and len(y) and x[0] == y[0]:  # equal heads and tails are on one
        out.append(at)
        x, y, at = x[1:], y[1:], at + 1
    while len(x) and len(y) and x[-1] == y[-1]:
        out.append(at + len(x) - 1)
        x, y = x[:-1], y[:-1]
    if not len(x) or not len(y):
        return
    if len(x) * len(y) > _CELLS and len(x) > 1:
        # the middle of x meets y where the two halves have most in common
        half = len(x) // 2
        cut = int(np.argmax(_last_row(x[:half], y) + _last_row(x[half:][::-1], y[::-1])[::-1]))
        _on_common(x[:half], y[:cut], at, out)
        _on_common(x[half:], y[cut:], at + half, out)
        return
    steps = np.zeros((len(x) + 1, len(y) + 1), np.int64)
    for r, v in enumerate(x, 1):
        steps[r, 1:] = np.maximum.accumulate(np.where(y == v, steps[r - 1, :-1] + 1, steps[r - 1, 1:]))
    r, c = len(x), len(y)
    while r and c:
        if steps[r, c] == steps[r - 1, c]:
            r -= 1
        elif steps[r, c] == steps[r, c - 1]:
            c -= 1
        else:
            out.append(at + r - 1)
            r, c = r - 1, c - 1


def shared(a: list[str], b: list[str]) -> np.ndarray:
    """Which entries of a lie on a longest common subsequence with b."""
    on = np.zeros(len(a), bool)
    common = {x: k for k, x in enumerate(set(a) & set(b))}
    mine = [i for i, x in enumerate(a) if x in common]
    places: list[int] = []
    _on_common(np.array([common[a[i]] for i in mine], np.int64), np.array([common[x] for x in b if x in common], np.int64), 0, places)
    on[[mine[i] for i in places]] = True
    return on


def main_text(page: list[Line], neighbour: list[Line] | None) -> str:
    """What the alignment with a page of the same host leaves of a page."""
    gone = shared([x.key for x in page], [x.key for x in neighbour]) if neighbour else np.zeros(len(page), bool)
    judged = neighbour is not None
    stay = []
    for x, g in zip(page, gone, strict=True):
        if x.chrome:
            # the alignment deletes what the neighbour has too; of what is left over, tags, roles and whole names are checked
            keep = not g and x.named and judged
        else:
            # an article's own text is content though the neighbour repeats it
            keep = x.article or not g
        if keep and x.text:
            stay.append(x.text)
    return "\n".join(stay)


def block_texts(pages):
    """(row, text) for (row, html) of one block's pages in order."""
    before: list[Line] | None = None  # the last page that is no copy of those at hand
    run: list[Line] | None = None  # the page at hand, of which there may be copies
    keys: list[str] = []
    wait: dict[tuple, tuple[list[Line], list]] = {}  # pages without a neighbour yet, by their texts
    for row, html in pages:
        lines = page_lines(html)
        its = [x.key for x in lines]
        if run is not None and its != keys:
            for held, rows in wait.values():
                text = main_text(held, lines)
                yield from ((r, text) for r in rows)
            wait.clear()
            before, run = run, None
        if run is None:
            run, keys = lines, its
        if before is not None:
            yield row, main_text(lines, before)
        else:
            wait.setdefault(tuple(x.text for x in lines), (lines, []))[1].append(row)
    for held, rows in wait.values():
        text = main_text(held, None)
        yield from ((r, text) for r in rows)


def _beginnings(rows: DataFrame, block: int) -> dict[str, list[tuple]]:
    """By host, the places in order where a new block begins; hosts of a block's size or less have none."""
    n = rows.count()
    every = max(block, n // BLOCKS)
    large = rows.groupBy("_host").agg(F.count("*").alias("k")).where(F.col("k") > every).select("_host")
    # about one page of ``every``, so about BLOCKS of them at most
    some = rows.where(F.pmod(F.xxhash64("_path", "_pid"), F.lit(every)) == 0).join(large, "_host", "left_semi")
    out: dict[str, list[tuple]] = {}
    for r in some.select("_host", "_stem", "_length", "_path", "_pid").distinct().toLocalIterator():
        out.setdefault(r._host, []).append((r._stem, r._length, r._path, r._pid))
    for places in out.values():
        places.sort()
    return out


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", block: int = BLOCK) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    spark = pages.sparkSession
    bare = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/]*)", 1))
    path = F.regexp_extract(bare, r"^[^/]*(.*)$", 1)
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.col(html).alias("html"),
        host.alias("_host"),
        path.alias("_path"),
        F.coalesce(F.col(page_id).cast("string"), F.lit("")).alias("_pid"),
    )
    # pages whose paths differ in numbers alone are neighbours, in the order of the numbers
    rows = rows.withColumns({"_stem": F.regexp_replace("_path", r"[0-9]+", ""), "_length": F.length("_path")})
    begin = spark.sparkContext.broadcast(_beginnings(rows.drop("html"), block))

    @F.pandas_udf("int")
    def block_of(hosts: pd.Series, stems: pd.Series, lengths: pd.Series, paths: pd.Series, ids: pd.Series) -> pd.Series:
        places = begin.value
        keys = zip(hosts, zip(stems, lengths, paths, ids, strict=True), strict=True)
        return pd.Series([bisect_right(places.get(h, ()), key) for h, key in keys], dtype="int32")

    rows = rows.withColumn("_block", block_of("_host", "_stem", "_length", "_path", "_pid"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["_host", "_block", "_stem", "_length", "_path", "_pid", F.xxhash64("html")]
    rows = rows.repartition(n, "_host", "_block").sortWithinPartitions(*order)
    kind = pages.schema[page_id].dataType
    arrow_kind = to_arrow_type(kind)

    def extract(batches):
        def read():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)

        out, held = [], 0
        for _, group in groupby(read(), key=lambda r: r[3:]):
            for row, text in block_texts(((r[0], r[1]), r[2]) for r in group):
                out.append((*row, text, len(text)))
                held += len(text)
                if held > 4 << 20 or len(out) >= 2000:
                    yield _batch(out, arrow_kind)
                    out, held = [], 0
        if out:
            yield _batch(out, arrow_kind)

    schema = T.StructType([T.StructField("page_id", kind), *T.StructType.fromDDL("url string, text string, n_chars long").fields])
    return rows.select("page_id", "url", "html", "_host", "_block").mapInArrow(extract, schema)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, urls, texts, sizes = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kind), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())],
        ["page_id", "url", "text", "n_chars"],
    )
