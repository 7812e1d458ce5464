"""Main-text extraction by composite text density.

For every DOM node the characters a tag, lowered by the share of link characters and link tags, are its
density. The node whose children's densities have the largest sum holds the article; blocks with links in it
whose density falls below the lowest one on its path up to the body (link lists, share bars) are left out.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.shared import arrow

#: Quotes count after "=" alone; a tag that never closes ends with the page. Whatever the text, one way to match and no way back.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(>|\Z)""", re.S)
#: A character reference of more digits than any character has (the parser of integers refuses the longest).
_HUGE = re.compile(r"&#[0-9]{8,}+;?")
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in "script style noscript template iframe textarea title svg math".split()}
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
#: An opening tag of the key ends an open element of these, up to the nearest of the limits.
_ENDS = {t: (frozenset({"p"}), frozenset({"table", "td", "th", "button", "caption"})) for t in _BLOCK - {"body", "br", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "caption"}} | {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "optgroup", "datalist"})),
    "tr": (frozenset({"tr"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    **{t: (frozenset({"tbody", "thead", "tfoot"}), frozenset({"table"})) for t in ("tbody", "thead", "tfoot")},
}


class Dom:
    """Nodes in document order: tag, parent, and the last node of the subtree; texts as (node, text).

    ``where`` has the open elements of each tag by their place in the stack, so that none is searched for.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.last, self.texts, self.body = ["#root"], [-1], [0], [], 0
        stack, at, where = [0], 0, defaultdict(list)
        find = _TAG.search

        def close(to: int) -> None:
            n = len(self.tag) - 1
            while len(stack) > to:
                v = stack.pop()
                self.last[v] = n
                if v:
                    where[self.tag[v]].pop()

        def innermost(tags: frozenset) -> int:
            return max((where[t][-1] for t in tags if where[t]), default=0)

        while True:
            m = find(html, at)
            if (text := html[at : m.start() if m else len(html)]) and not text.isspace():
                self.texts.append((stack[-1], unescape(_HUGE.sub("\ufffd", text)) if "&" in text else text))
            if not m:
                break
            at, name = m.end(), m[2]
            if not name:
                continue
            if not m[4]:
                break
            name = name.lower()
            if m[1]:
                if where[name]:
                    close(where[name][-1])
                continue
            if name in ("html", "head"):
                continue
            if name == "body":
                if self.body:
                    continue
                close(1)
            elif (ends := _ENDS.get(name)) is not None and (k := innermost(ends[0])) > innermost(ends[1]):
                close(k)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.last.append(len(self.tag) - 1)
            if name == "body":
                self.body = len(self.tag) - 1
            if name in _RAW:
                end = _RAW[name].search(html, at)
                at = end.end() if end else len(html)
            elif name not in _VOID and not m[3].endswith("/") or name == "a":
                where[name].append(len(stack))
                stack.append(len(self.tag) - 1)
        close(0)


def densities(dom: Dom) -> tuple[list[float], list[float]]:
    """(density, sum of the children's densities) of each node."""
    n = len(dom.tag)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for v in range(1, n):
        linked[v] = linked[dom.parent[v]] or dom.tag[v] == "a"
    for v, text in dom.texts:
        k = len("".join(text.split()))
        chars[v] += k
        if linked[v]:
            links[v] += k
    for v in range(n - 1, 0, -1):
        p = dom.parent[v]
        chars[p] += chars[v]
        links[p] += links[v]
        tags[p] += tags[v] + 1
        link_tags[p] += link_tags[v] + (dom.tag[v] == "a")
    b = dom.body
    share = links[b] / chars[b] if chars[b] else 0.0
    density, total = [0.0] * n, [0.0] * n
    for v in range(n):
        c = chars[v]
        if not c:
            continue
        t, lc, lt = max(1, tags[v]), max(1, links[v]), max(1, link_tags[v] + (dom.tag[v] == "a"))
        base = math.log(c / max(1, c - links[v]) * links[v] + share * c + math.e)
        # without link text in the body the base is 1 (its logarithm 0) for all of it: the natural logarithm then
        density[v] = c / t * max(0.0, math.log(c / lc * t / lt) / (math.log(base) if base > 1 + 1e-9 else 1.0))
    for v in range(1, n):
        total[dom.parent[v]] += density[v]
    return density, total


def content(dom: Dom) -> tuple[int, set[int]]:
    """(root of the content subtree, roots of the block subtrees in it that fall below the threshold).

    The root has the largest sum of its children's densities (ties: the first; without any sum, the body).
    The threshold is the lowest density from it up to the body. It tells link lists from text, so only blocks
    with links are held against it: the density of a short or link-free paragraph says how long it is, no more.
    """
    density, total = densities(dom)
    inside, linked = [t == "a" for t in dom.tag], [t == "a" for t in dom.tag]
    for v in range(1, len(dom.tag)):
        inside[v] |= inside[dom.parent[v]]
    for v in range(len(dom.tag) - 1, 0, -1):
        linked[v] |= inside[v]
        linked[dom.parent[v]] |= linked[v]
    b = dom.body
    best = max(range(b, dom.last[b] + 1), key=lambda v: total[v])
    v, threshold = best, density[best]
    while v != b:
        v = dom.parent[v]
        threshold = min(threshold, density[v])
    below = {v for v in range(best + 1, dom.last[best] + 1) if linked[v] and dom.tag[v] in _BLOCK and density[v] < threshold}
    return best, below


def extract(html: str | None) -> str | None:
    """The main text: a line for each block, white space collapsed; "" for a page without text, null for null."""
    if html is None:
        return None
    dom = Dom(html)
    root, below = content(dom)
    block_of, out = [0] * len(dom.tag), [False] * len(dom.tag)
    for v in range(1, len(dom.tag)):
        block_of[v] = v if dom.tag[v] in _BLOCK else block_of[dom.parent[v]]
        out[v] = v in below or out[dom.parent[v]]
    lines: list[list[str]] = []
    at = None
    for v, text in dom.texts:
        if not root <= v <= dom.last[root] or out[v]:
            continue
        if block_of[v] != at:
            lines.append([])
            at = block_of[v]
        lines[-1].append(text)
    joined = (" ".join("".join(x).split()) for x in lines)
    return "\n".join(x for x in joined if x)


def extracted(df: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, text) of every row, in one pass without a shuffle.

    A null page has a null text, an empty one or one without text "". Broken markup is read as browsers
    would in the cases that matter here: unclosed elements end with their parents, stray end tags are
    skipped, a tag cut off by the page's end is none. Ties go to the first node. Pages are read whole, in time
    linear in their length. Repeated rows are extracted each; an empty table gives no rows; other columns
    are ignored.
    """
    given = df.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([extract(x) for x in batch.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    return arrow(given, run, T.StructType([given.schema["page_id"], T.StructField("text", T.StringType())]))
