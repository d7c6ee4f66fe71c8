"""Main text of web pages by composite text density.

A tolerant parser turns the page into a tree: raw-text elements, void elements, implied ends of paragraphs and list
items, and stray end tags are handled as browsers do. Subtrees that announce what they are (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, scripts, styles, hidden parts) are cut. For every node that is left,
its composite density is its characters per tag, scaled by a logarithm that falls with the share of link characters and
link tags. A node's density sum adds its children's densities. The node of the largest sum lies in the main text; the body's
own density is the threshold along the path between the two: the outermost subtree on it that reaches the threshold is the
main text, and other parts that reach it are added.

A <header> or <aside> is cut wherever it stands, an article's own included: the text wanted is without headers and sidebars.

Defined cases: null or empty html gives the empty text; a page without tags is one block; a page without <body> takes the
whole tree; unclosed tags, comments and quotes end with the page; nesting of any depth is handled without recursion, and the
open elements of a tag are found without a search, so a page of any length takes time in proportion; of equal density sums the
first node in the page counts; an empty table gives no rows; repeated rows and null keys are pages of their own; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm._text import small_batches

SCHEMA = "page_id long, url string, text string, n_chars long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes svg math template".split())
FOREIGN = frozenset(("svg", "math"))
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A start tag of these ends an open <p>.
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
#: A start tag of the first kind ends an open element of the second, up to the third.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
SCOPE = frozenset("applet button caption html marquee object table td template th".split())
CUT_TAGS = RAW | frozenset("head nav header footer aside form button select input dialog menu canvas object embed audio video".split())
CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer masthead comment comments respond responses disqus replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe signup login share sharing social related recommended widget pagination toolbar skip hidden".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>?|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*+)([^>]*+)>?)""", re.S)
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_NAME = re.compile(r"[a-z]+")


def _is_cut(tag: str, attrs: str) -> bool:
    if tag in CUT_TAGS:
        return True
    if not attrs or attrs.isspace() or tag in ("article", "main", "body", "html"):
        return False
    a = {k.lower(): (x or y or z).lower() for k, x, y, z in _ATTR.findall(attrs)}
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    return a.get("role") in CUT_ROLES or not CUT_NAMES.isdisjoint(_NAME.findall(f"{a.get('class', '')} {a.get('id', '')}"))


class Tree:
    """Nodes in document order (a parent's number is less than its children's), and the page as a list of events:
    (node, text) for text, (node, None) where a block begins or ends."""

    def __init__(self, page: str):
        self.tag, self.parent, self.cut, self.events = ["#root"], [-1], [False], []
        self.open: dict[str, list[int]] = {}  # by tag, the places of open elements in the stack
        self.blocks: list[int] = []
        stack, at, n = [0], 0, len(page)
        while at < n:
            m = _TAG.search(page, at)
            text = page[at : m.start() if m else n]
            if text:
                self.events.append((stack[-1], text))
            if not m:
                break
            at = m.end()
            closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if closing:
                self._end(stack, name)
                continue
            self._imply(stack, name)
            k = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.cut.append(self.cut[stack[-1]] or _is_cut(name, attrs))
            if name in BLOCK or name == "br":
                self.events.append((k, None if name != "br" else " "))
            if name in RAW:
                if name in FOREIGN and (attrs or "").rstrip().endswith("/"):
                    continue  # such an element may close itself
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
            elif name not in VOID:
                self.open.setdefault(name, []).append(len(stack))
                if name in BLOCK:
                    self.blocks.append(len(stack))
                stack.append(k)

    def _last(self, names) -> int:
        """The place of the innermost open element of these names, or 0."""
        return max((at[-1] for x in names if (at := self.open.get(x))), default=0)

    def _imply(self, stack: list[int], name: str) -> None:
        if name in ENDS_P:
            self._close(stack, ("p",), SCOPE)
        if name in SIBLINGS:
            ends, within = SIBLINGS[name]
            self._close(stack, ends, within)

    def _close(self, stack: list[int], names, within) -> None:
        """Closes from the outermost open element of `names` that lies inside the innermost one of `within`."""
        if not any(self.open.get(x) for x in names):
            return
        edge = self._last(within)
        inside = [at[i] for x in names if (at := self.open.get(x)) and (i := bisect.bisect_right(at, edge)) < len(at)]
        if inside:
            self._pop(stack, min(inside))

    def _pop(self, stack: list[int], low: int) -> None:
        if self.blocks and self.blocks[-1] >= low:
            self.events.append((self.parent[stack[low]], None))
        for k in stack[low:]:
            self.open[self.tag[k]].pop()
        while self.blocks and self.blocks[-1] >= low:
            self.blocks.pop()
        del stack[low:]

    def _end(self, stack: list[int], name: str) -> None:
        at = self.open.get(name)
        if not at or name not in BLOCK and self.blocks and self.blocks[-1] > at[-1] or name == "p" and self._last(SCOPE) > at[-1]:
            return  # an inline end tag doesn't end a block
        self._pop(stack, at[-1])


def densities(tree: Tree) -> tuple[list[float], list[float]]:
    """Composite density and density sum of every node that isn't cut."""
    n = len(tree.tag)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for k, text in tree.events:
        if text and not tree.cut[k]:
            chars[k] += len("".join(text.split()))
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = in_link[tree.parent[k]] or tree.tag[k] == "a"
        links[k] = chars[k] if in_link[k] else 0
    for k in range(n - 1, 0, -1):
        if not tree.cut[k]:
            p = tree.parent[k]
            chars[p] += chars[k]
            links[p] += links[k]
            tags[p] += tags[k] + 1
            link_tags[p] += link_tags[k] + (tree.tag[k] == "a")
    body = next((k for k in range(n) if tree.tag[k] == "body"), 0)
    share = links[body] / chars[body] if chars[body] else 0.0
    density, total = [0.0] * n, [0.0] * n
    for k in range(n):
        if c := chars[k]:
            t, lc, lt = max(1, tags[k]), max(1, links[k]), max(1, link_tags[k])
            base = math.log(c / max(1, c - links[k]) * links[k] + share * c + math.e)
            density[k] = c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9 if links[k] else max(math.e, c * t)) / math.log(max(base, 1.0) + 1.0)
    for k in range(n - 1, 0, -1):
        if not tree.cut[k]:
            total[tree.parent[k]] += density[k]
    return density, [x or d for x, d in zip(total, density, strict=True)]


def main_nodes(tree: Tree) -> list[bool]:
    """Marks the nodes of the main text."""
    density, total = densities(tree)
    n = len(tree.tag)
    alive = [k for k in range(n) if not tree.cut[k] and density[k] > 0]
    if not alive:
        return [False] * n
    best = max(alive, key=lambda k: (total[k], -k))
    path, k = [], best
    while k >= 0 and tree.tag[k] != "html":
        path.append(k)
        k = tree.parent[k]
    frame = ("html", "#root", "body")
    threshold = density[next((k for k in path if tree.tag[k] == "body"), path[-1])]
    marked = [False] * n
    marked[next((k for k in reversed(path) if tree.tag[k] not in frame and density[k] >= threshold), best)] = True
    for k in alive:  # other dense parts
        if density[k] >= threshold and k not in path and tree.tag[k] not in (*frame, "a"):
            marked[k] = True
    for k in range(1, n):
        marked[k] = (marked[k] or marked[tree.parent[k]]) and not tree.cut[k]
    return marked


def extract(page: str | None) -> str:
    """The main text of one page: its blocks in page order, joined by newlines."""
    if not page:
        return ""
    tree = Tree(page)
    marked = main_nodes(tree)
    blocks, parts = [], []
    for k, text in [*tree.events, (0, None)]:
        if text is None:
            if parts and (block := " ".join(_html.unescape("".join(parts)).split())):
                blocks.append(block)
            parts = []
        elif marked[k]:
            parts.append(text)
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, SCHEMA)
