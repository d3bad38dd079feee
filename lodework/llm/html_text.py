"""Main-text extraction from HTML by tree scoring.

A page is read into a tree of its block elements. Paragraphs (p, pre, td, blockquote, and other blocks with text of
their own) make points: one, one a comma, and one per hundred characters up to three. The points pass to the nearest
ancestors, whole to the parent, half to the next and less above, and are discounted by the share of the text that
stands in links. The best container, and those of its siblings that score near it or read like paragraphs, are
kept; elements that are navigation, notices, adverts, forms and the like by tag, role or class are not, wherever
they stand.

The text of the kept blocks comes in page order: character references decoded, white space inside a block turned
into one space, blocks joined by one space.

Nulls and edge cases: a null or empty html gives an empty text; markup that is cut off or badly nested is read as
far as it goes; a page with no block of text of its own gives what its body holds. Of containers that score the same
the first is kept. Very long and deeply nested pages are read whole, in time that grows with their length.
Repeated rows are extracted one by one. Columns named like the result's are replaced, others are carried along.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .common import table, tidy

# HTML's element kinds, as far as they matter here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed".split())
SKIPPED = frozenset("template svg math canvas object select".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav footer aside form button dialog menu head fieldset".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}
ENDS_P = BLOCK - {"html", "body", "head", "caption", "button", "legend", "tbody", "td", "th", "tr", "thead", "tfoot", "li", "dd", "dt"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
STEMS = ("advert", "adsby", "sponsor", "cookie", "sidebar", "breadcrumb", "newsletter", "navbar", "comment", "disqus", "pagination")
REMARKS = frozenset("comment comments reply replies ad advert sponsored teaser related".split())
UNLIKELY = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social sidebar aside rail menu nav navbar navigation navi breadcrumb breadcrumbs pagination pager footer foot header masthead topbar toolbar comment comments disqus respond "
    "discussion replies reply related recommended recommendations outbrain taboola widget widgets skip copyright legal disclaimer feedback hidden teaser teasers trending".split()
)
#: Points pass to so many ancestors.
REACH = 5
LIKELY = frozenset("article body content entry hentry main page post text blog story prose".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Page:
    """The tree of one page's blocks. Node 0 is the root; parents have smaller numbers than their children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.dropped, self.weight, self.soft, self.inside = [""], [-1], [False], [0], [False], [False]
        self.runs: list[tuple[int, str, bool]] = []  # (block, text, in a link); "" ends a block's run
        self._read(source)

    def _read(self, source: str) -> None:
        stack, links, at, n = [0], 0, 0, len(source)
        hidden_inline: list[str] = []
        opened: Counter[str] = Counter()  # elements on the stack, by name
        endless: set[str] = set()  # names that nothing closes from here on

        def close(k: int) -> None:
            opened.subtract(self.tag[i] for i in stack[k:])
            del stack[k:]

        while at < n:
            lt = source.find("<", at)
            m = None
            while lt >= 0 and not (m := _TOKEN.match(source, lt)):
                lt = source.find("<", lt + 1)
            end = lt if m else n
            if end > at and not hidden_inline:
                self.runs.append((stack[-1], source[at:end], links > 0))
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, attrs = m[1] or m[4], m[3] or m[6] or ""
            if name in RAW or name in SKIPPED:
                # without its end tag an element of raw text goes on to the page's end; of any other only the tag goes
                if not closing and not attrs.endswith("/") and name not in endless:
                    shut = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(source, at)
                    if shut or name in RAW:
                        at = shut.end() if shut else n
                    else:
                        endless.add(name)
                self.runs.append((stack[-1], "", False)) if name in ("select", "textarea") else None
            elif name == "a":
                links = 0 if closing else 1
            elif name == "br" or name == "hr":
                self.runs.append((stack[-1], "", False))
            elif name in BLOCK:
                self.runs.append((stack[-1], "", False))
                if closing:
                    for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                        if self.tag[stack[k]] == name:
                            close(k)
                            links = 0
                            break
                        if name == "p" and self.tag[stack[k]] not in HEADING:
                            break
                else:
                    if name in ENDS_P and self.tag[stack[-1]] == "p":
                        close(len(stack) - 1)
                    for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in CLOSES.get(name, ())) else ():
                        if self.tag[stack[k]] in SCOPE[name]:
                            break
                        if self.tag[stack[k]] in CLOSES[name]:
                            close(k)
                            break
                    stack.append(self._node(name, attrs, stack[-1]))
                    opened[name] += 1
            elif not closing and attrs and name not in VOID and not attrs.endswith("/") and self._judge(name, attrs)[0] == "hidden":
                hidden_inline.append(name)
            elif closing and hidden_inline and hidden_inline[-1] == name:
                hidden_inline.pop()

    def _judge(self, name: str, attrs: str) -> tuple[str, int]:
        """(what stands against the element: "", "hidden", "class" or, even for an article element, "remark"; its weight)."""
        got = {a.lower(): (x or y or z or "") for a, x, y, z in _ATTR.findall(attrs)}
        if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(got.get("style", "").lower()):
            return "hidden", 0
        if got.get("role", "").lower() in ROLES:
            return "class", 0
        names = {x.lower() for x in _NAMES.findall(f"{got.get('class', '')} {got.get('id', '')}")}
        return "remark" if names & REMARKS else "class" if names & UNLIKELY or any(n.startswith(STEMS) for n in names) else "", 25 * bool(names & LIKELY)

    def _node(self, name: str, attrs: str, parent: int) -> int:
        why, weight = self._judge(name, attrs) if attrs else ("", 0)
        inside = self.inside[parent] or self.tag[parent] in ("article", "main")
        out = name in NEVER or why == "hidden" or name == "header" and not inside
        self.tag.append(name)
        self.parent.append(parent)
        self.inside.append(inside)
        self.dropped.append(out)
        self.soft.append(why in ("class", "remark") and name not in ("html", "body", "main") and (name != "article" or why == "remark") or name == "header" and inside)
        self.weight.append(weight + (25 if name in ("article", "main") else 0))
        return len(self.tag) - 1

    def _up(self, k: int) -> Iterator[int]:
        while k > 0:
            yield k
            k = self.parent[k]

    def text(self) -> str:
        tag, parent, n = self.tag, self.parent, len(self.tag)
        # A class speaks against an element only where it holds no article of its own.
        holds = [False] * n
        for k in range(n - 1, 0, -1):
            holds[parent[k]] |= holds[k] or tag[k] in ("article", "main", "h1") and not self.soft[k]
        for k in range(1, n):
            self.dropped[k] |= self.soft[k] and not holds[k] or self.dropped[parent[k]]
        length, linked, commas = [0] * n, [0] * n, [0] * n
        for k, t, link in self.runs:
            if t and not self.dropped[k]:
                size = len(t.strip())
                length[k] += size
                linked[k] += size * link
                commas[k] += t.count(",")
        own = length[:]
        score = [float(w) if not d else 0.0 for w, d in zip(self.weight, self.dropped, strict=True)]
        for k in range(1, n):
            if own[k] and tag[k] not in HEADING:
                points = (1 + commas[k] + min(own[k] / 100, 3)) * (1 - linked[k] / own[k])
                share = 1.0
                for depth, p in enumerate(islice(self._up(parent[k]), REACH)):
                    score[p] += points * share
                    share = 0.5 if depth == 0 else 1 / (3 * (depth + 1))
                if tag[k] not in ("p", "td", "li", "pre", "blockquote"):
                    score[k] += points  # text that stands in the container itself
        for k in range(n - 1, 0, -1):
            length[parent[k]] += length[k]
            linked[parent[k]] += linked[k]
        density = [a / b if b else 0.0 for a, b in zip(linked, length, strict=True)]
        final = [s * (1 - d) for s, d in zip(score, density, strict=True)]
        best = max((k for k in range(1, n) if not self.dropped[k] and length[k] and tag[k] != "html"), key=lambda k: final[k], default=0)
        # A container that an article or main element encloses stands for the whole of it.
        outer = [p for p in [*self._up(best)][::-1] if not self.dropped[p]]
        best = next((p for kind in ("article", "main") for p in outer if tag[p] == kind), best)
        keep = {best}
        for k in range(1, n) if best and tag[best] not in ("article", "main", "body") else ():
            if parent[k] == parent[best] and not self.dropped[k] and k != best:
                near = final[k] >= max(10.0, 0.2 * final[best])
                prose = tag[k] == "p" and (length[k] > 80 and density[k] < 0.25 or 0 < length[k] <= 80 and not linked[k])
                if near or prose or tag[k] in HEADING and k < best:
                    keep.add(k)
        # Inside an article its lists of links belong to it, unless tag, role or class speaks against them.
        lists = {k for k in range(1, n) if tag[k] in ("ul", "ol", "dl", "div", "section", "table") and density[k] > 0.5 and k not in keep and not self.inside[k]}
        kept = [False] * n
        kept[0] = best == 0
        for k in range(1, n):
            kept[k] = not self.dropped[k] and k not in lists and (k in keep or kept[parent[k]])
        pieces = [html.unescape(t) if "&" in t else t for t in self._joined(kept)]
        return " ".join(" ".join(pieces).split())

    def _joined(self, kept: list[bool]) -> Iterator[str]:
        """The kept blocks' source text; references are decoded over a whole run, as markup may cut them."""
        run: list[str] = []
        for k, t, _ in self.runs:
            if not t:
                yield "".join(run)
                run.clear()
            elif kept[k]:
                run.append(t)
        yield "".join(run)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


OUT = "text string, n_chars long"


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    names = ["text", "n_chars"]
    carried = pages.select(*[c for c in pages.columns if c not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                got = [main_text(x) for x in part.column(part.schema.get_field_index(source)).to_pylist()]
                made = [pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    return carried.mapInArrow(tidy(run), StructType([*carried.schema.fields, *StructType.fromDDL(OUT).fields]))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


QUERIES = {"op5_html_extraction": op5}
#: These pages hold one article element each, so their text can be had from it in SQL.
ORACLE = {
    "op5_html_extraction": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '<(p|/p|h1|/h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;?', '&', 'g') AS t FROM b)
SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(t, '\s+', ' ', 'g')))::BIGINT AS n_chars FROM c"""
}
