"""HTML extraction by page differencing: a page is compared with the page of the nearest URL path on its host.

Pages of one host and equal html count as one. In the order of (host, path) over all tasks, a page's partner is the one of its
two neighbours on the host that shares the longer beginning of its path (the earlier if both do). Text lines (blocks) of the two
are aligned by longest common subsequence and the shared ones are deleted, except inside an article or main element: there a
shared line is the author's, as when two pages carry one article. Where a page has such an element with text, its text is that
element's; where it has none, what the comparison leaves. Blocks of menus, headers, footers, sidebars, notices, adverts, forms
and readers' comments are never text; an article's own header is.

The comparison works on short rows of 64-bit line hashes, sorted by ranges, so a hot host spreads over tasks and the result does
not depend on their number. Only the verdicts, of pages that share lines, meet the pages.

Defined results: null and empty html give an empty text; a page alone on its host has nothing deleted by comparison; a null URL
has an empty host and path; repeated rows are pages of their own with equal results; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import dropped, mapped, partitions, per_batch, with_bounded_side, written
from quillgraph.llm.urlfilter import host_of, path_of

# Elements of the HTML standard by their role.
RAW = "script style textarea title noscript template iframe xmp noembed noframes".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set("head nav header footer aside form button select option script style noscript template iframe svg canvas object menu dialog fieldset".split())
MARKED = re.compile(r"(^|[\s_-])(ad|thread|ads|advert|adverts|advertisement|sponsored|promo|sidebar|comment|comments|reply|replies|discussion|notice|cookie|cookies|consent|banner|popup|modal|newsletter|subscribe|share|social|related|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|header|masthead|widget|login|search|toolbar|pagination|pager)s?($|[\s_-])", re.I)
#: With one of these in its name, a block belongs to the article: article-header, post-title.
OWN = re.compile(r"(^|[\s_-])(article|post|entry|story|title|headline)($|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
SPACE = re.compile(r"\s+")


def _is_dropped(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's text is never the page's. Inline elements only go if they are hidden."""
    if name in DROPPED:
        return not (name == "header" and in_article)
    if name in ("html", "body", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        named = key in ("class", "id") and name not in INLINE and not (name == "article" and not in_article)
        if named and any(MARKED.search(x) and not OWN.search(x) for x in value.split()) or key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, in an article, wanted) of every block in page order."""
    page, out, parts = page or "", [], []
    stack: list[tuple[str, bool, bool]] = []  # name, article, dropped

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append((text, any(x[1] for x in stack), not any(x[2] for x in stack)))

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        if name not in INLINE:
            flush()
        if m.group(1):
            names = [x[0] for x in stack]
            if name in names:
                if name in INLINE and _is_any_dropped(stack, name):
                    flush()
                del stack[len(names) - 1 - names[::-1].index(name) :]
        elif name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not m.group(3).endswith("/"):
            gone = _is_dropped(name, m.group(3), any(x[1] for x in stack))
            if gone and name in INLINE:
                flush()
            if name not in INLINE and name == "p":
                while stack and (stack[-1][0] == "p" or stack[-1][0] in INLINE and any(x[0] == "p" for x in stack)):
                    stack.pop()
            stack.append((name, name in ("article", "main"), gone))
    flush()
    return out


def _is_any_dropped(stack: list, name: str) -> bool:
    return next(x[2] for x in reversed(stack) if x[0] == name)


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence of the two, in linear memory.

    Equal beginnings and ends are taken first. Rows of the table of lengths are bits of whole numbers (Hyyro, 2004); a table of
    over ``TABLE_BITS`` is halved at the best place (Hirschberg, 1975)."""
    lo, end = 0, 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    while end < min(len(a), len(b)) - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    inner = _aligned(a[lo : len(a) - end], b[lo : len(b) - end], lo)
    return [*range(lo), *inner, *range(len(a) - end, len(a))]


TABLE_BITS = 1 << 24


def _rows(a: list, b: list) -> Iterator[int]:
    """After each line of ``a``: bit j is 0 where the common subsequence with b[: j + 1] is longer than with b[:j]."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    mask = v = (1 << len(b)) - 1
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & mask
        yield v


def _lengths(a: list, b: list) -> list[int]:
    """Length of the common subsequence of ``a`` with b[:j], for each j."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):
        pass
    out = [0]
    for j in range(len(b)):
        out.append(out[-1] + (not v >> j & 1))
    return out


def _aligned(a: list, b: list, start: int) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2
        left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        at = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        return _aligned(a[:half], b[:at], start) + _aligned(a[half:], b[at:], start + half)
    rows, i, j, out = [(1 << len(b)) - 1, *_rows(a, b)], len(a), len(b), []
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1 and (rows[i - 1] ^ rows[i]) & ((1 << j) - 1) == 0:
            i -= 1
        elif a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(start + i)
        else:
            i -= 1
    return out[::-1]


def extract(page: list, shared: list[int]) -> str:
    """The wanted blocks: of articles if there are any, else those that are not ``shared`` with the partner."""
    gone = set(shared)
    has_article = any(a and w for _, a, w in page)
    return "\n\n".join(t for i, (t, a, w) in enumerate(page) if w and (a or not has_article and i not in gone))


def _key() -> tuple[Column, ...]:
    url = F.col("url")
    return F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("content")


def _lines(pages: DataFrame) -> DataFrame:
    """host, content, path (the least one), lines (hashes of all blocks in order) of different pages."""

    def work(hosts: list, paths: list, contents: list, htmls: list) -> dict:
        import xxhash

        return {"host": hosts, "path": paths, "content": contents, "lines": [[xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t, _, _ in blocks(h)] for h in htmls]}

    rows = per_batch(pages, [*_key(), "html"], work, "host string, path string, content string, lines array<long>")
    return rows.groupBy("host", "content").agg(F.min("path").alias("path"), F.first("lines").alias("lines"))


def shared_lines(pages: DataFrame) -> DataFrame:
    """host, content, shared (places of lines) of the pages that share lines with their partner; written."""
    rows = _lines(pages).repartitionByRange(partitions(pages.sparkSession), "host", "path", "content").sortWithinPartitions("host", "path", "content")
    rows = written(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "page-lines")
    before = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # a row for each task
    before = before.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = rows.join(F.broadcast(before), "part").select((F.col("at") - F.col("first") + F.col("before")).alias("rank"), "host", "content", "path", "lines")
    side = lambda step: placed.select((F.col("rank") + step).alias("rank"), F.struct("host", "path", "lines").alias("next" if step < 0 else "last"))
    met = placed.join(side(1), "rank", "left").join(side(-1), "rank", "left")

    def work(hosts: list, contents: list, paths: list, lines: list, lasts: list, nexts: list) -> dict:
        out: dict = {"host": [], "content": [], "shared": []}
        for host, content, path, own, *near in zip(hosts, contents, paths, lines, lasts, nexts, strict=True):
            near = [x for x in near if x and x["host"] == host]
            other = max(near, key=lambda x: len(commonprefix([x["path"], path])), default=None)
            got = common_lines(own, other["lines"]) if other else []
            if got:
                for k, v in (("host", host), ("content", content), ("shared", got)):
                    out[k].append(v)
        return out

    found = written(per_batch(met, ["host", "content", "path", "lines", "last", "next"], work, "host string, content string, shared array<int>"), "shared-lines")
    dropped(rows)
    return found


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines shared with the partner) of every row."""
    verdicts = with_bounded_side(shared_lines(pages))
    rows = pages.select("page_id", "url", "html", *_key()).join(verdicts, ["host", "content"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                shared = [x or [] for x in piece.column(3).to_pylist()]
                texts = [extract(blocks(h), s) for h, s in zip(piece.column(2).to_pylist(), shared, strict=True)]
                yield {"page_id": piece.column(0), "url": piece.column(1), "text": texts, "n_chars": [len(t) for t in texts], "n_shared": [len(s) for s in shared]}

    return mapped(rows.select("page_id", "url", "html", "shared"), run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_shared int")
