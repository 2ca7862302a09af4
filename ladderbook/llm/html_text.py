"""Main-text extraction by composite text density.

The page becomes a tree. Parts that are by their tag or name no article text (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, reader comments) are cut off, unless a part that is
so only by its name, or a form, holds most of the page's text outside links. For every other
node the characters per tag are computed, adjusted for how much of its text stands in links; the
densities of a node's children are summed, and the subtree of the largest sum is the article. Its
threshold is the least density on the path from it to the body: where the sum is largest at the body
itself, holders (lists, tables, divisions) below the threshold are dropped. A subtree inside an article element is widened to it.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: element and part names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CUT_TAGS = frozenset("head title nav header footer aside form script style noscript template iframe object embed svg canvas button select textarea input label dialog menu".split())
CUT_NAMES = frozenset("ad ads adv advert adverts advertisement adsense banner sponsor sponsored promo promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer foot header masthead comment comments disqus respond cookie cookies notice notices notification consent gdpr newsletter subscribe subscription signup popup modal overlay share sharing social related recommended recommendations widget widgets toolbar login search pager pagination skip alert".split())
REPLIES = frozenset("comment comments disqus respond".split())  # may be longer than the article
TOPICS = frozenset("related social notice notices notification alert search share sharing promotion promo banner foot skip login".split())  # words of headings too
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
KEEPS_IN = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "option": frozenset(["select"])}
PROSE = frozenset("blockquote p pre section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDERS = frozenset("center details div dl fieldset ol section table ul".split())
HOLDS_P = frozenset("article aside body button caption div html li main section table td th".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_BLANK = re.compile(r"\s+")


class _Tree:
    """Nodes in page order: tag, parent, parts (texts and child nodes in turn), cut, and the names that alone cut it."""

    def __init__(self):
        self.tag, self.parent, self.parts, self.cut, self.names = ["html"], [-1], [[]], [False], {}

    def add(self, tag: str, parent: int, cut: bool) -> int:
        n = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.parts.append([])
        self.cut.append(cut)
        self.parts[parent].append(n)
        return n


def _is_cut(tag: str, raw: str) -> tuple[bool, list[str]]:
    """Whether the element is cut, and the class or id names if only they say so."""
    if tag in CUT_TAGS:
        return True, []
    if not raw or tag in ("html", "body", "article", "main"):
        return False, []
    names: list[str] = []
    for name, *values in _ATTR.findall(raw):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, []
        if name == "role" and value.lower() in CUT_ROLES:
            return True, []
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, []
        if name in ("class", "id"):
            names += value.split()
    names = [x for x in names if not CUT_NAMES.isdisjoint(_words(x))]
    return bool(names), names


def _words(name: str) -> list[str]:
    return [w.lower() for w in _NAMES.findall(name)]


class _Open:
    """The open elements, and at which depths those of each tag stand, so that no end tag walks them."""

    def __init__(self, tags: list[str]):
        self.tags, self.nodes = tags, [0]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # depths of block elements
        self.holders: list[int] = []  # depths of elements beyond which no paragraph is closed

    def push(self, node: int) -> None:
        tag, depth = self.tags[node], len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(tag, []).append(depth)
        if tag in BLOCK:
            self.blocks.append(depth)
        if tag in HOLDS_P:
            self.holders.append(depth)

    def cut(self, depth: int) -> None:
        for node in self.nodes[depth:]:
            self.at[self.tags[node]].pop()
        del self.nodes[depth:]
        for depths in (self.blocks, self.holders):
            while depths and depths[-1] >= depth:
                depths.pop()

    def last(self, tags) -> int:
        """The depth of the innermost open element of these tags, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def parse(page: str) -> _Tree:
    """The page's tree; unclosed, misplaced and cut-off tags are repaired as browsers mostly do, in linear time."""
    tree = _Tree()
    stack, at = _Open(tree.tag), 0
    parts = tree.parts
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                parts[stack.nodes[-1]].append(entities.unescape(page[at:]))
            return tree
        if m.start() > at:
            parts[stack.nodes[-1]].append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            depth = stack.last((tag,))
            if depth and (tag in BLOCK or not stack.blocks or stack.blocks[-1] < depth):
                stack.cut(depth)
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            depth = stack.last(("p",))
            if depth > (stack.holders[-1] if stack.holders else 0):
                stack.cut(depth)
        if tag in CLOSED_BY:
            depth = stack.last(CLOSED_BY[tag])
            if depth > stack.last(KEEPS_IN[tag]):
                stack.cut(depth)
        if tag == "body" and stack.last(("head",)):
            stack.cut(1)
        raw = m[3] if m[2] else m[6]
        cut, names = _is_cut(tag, raw)
        node = tree.add(tag, stack.nodes[-1], cut)
        if names:
            tree.names[node] = names
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            parts[node].append(page[at : end.start() if end else len(page)])
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        if not raw.endswith("/") or tag in BLOCK:
            stack.push(node)


def _inside(tree: _Tree, tags: tuple[str, ...]) -> list[bool]:
    """Whether an element of these tags is above each node."""
    out = [False] * len(tree.tag)
    for k in range(1, len(out)):
        up = tree.parent[k]
        out[k] = out[up] or tree.tag[up] in tags
    return out


def _holders(tree: _Tree) -> None:
    """A named part that holds the article element, or inside it the article's first heading, is not cut by its name."""
    within = _inside(tree, ("article",))
    seen = [0] * len(tree.tag)  # 2: the way up from here is done, 1: for headings only
    for k in range(len(tree.tag)):
        inner = tree.tag[k] == "h1" and within[k]
        if tree.tag[k] in ("article", "main") or inner:
            up, done = tree.parent[k], 1 if inner else 2
            while up > 0 and seen[up] < done:
                seen[up] = done
                if tree.tag[up] not in CUT_TAGS or tree.tag[up] == "form" and not inner:
                    tree.cut[up] = False
                up = tree.parent[up]
    _wide(tree)


def _wide(tree: _Tree) -> None:
    """Neither a part cut only by its name nor a form is cut that holds most of the text outside links.

    Inside an article a named paragraph or section also stays if its name has a topic's word beside
    others (related-work) and most of its text is outside links.
    """
    if not tree.names and "form" not in tree.tag:
        return
    n = len(tree.tag)
    free, chars = [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        if tree.cut[k] and k not in tree.names and tree.tag[k] != "form":
            free[k] = chars[k] = 0
            continue
        own = sum(len(part) - len("".join(_BLANK.findall(part))) for part in tree.parts[k] if isinstance(part, str))
        chars[k] += own
        free[k] = 0 if tree.tag[k] == "a" else free[k] + own
        if k:
            free[tree.parent[k]] += free[k]
            chars[tree.parent[k]] += chars[k]
    body = next((k for k in range(n) if tree.tag[k] == "body"), 0)
    within = _inside(tree, ("article", "main"))
    for k in range(1, n):
        if not tree.cut[k] or k not in tree.names and tree.tag[k] != "form":
            continue
        words = [_words(x) for x in tree.names.get(k, [])]
        if 2 * free[k] > free[body] and not (words and all(REPLIES.issuperset(w) for w in words)):
            tree.cut[k] = False
        elif words and tree.tag[k] in ("p", "section", "div") and 2 * free[k] > chars[k] and within[k]:
            if all(len(w) > 1 and TOPICS.issuperset(CUT_NAMES.intersection(w)) and not CUT_NAMES.issuperset(w) for w in words):
                tree.cut[k] = False


def _chosen(tree: _Tree) -> tuple[int, set[int]]:
    """The article's node, and further nodes to leave out."""
    n = len(tree.tag)
    out = [False] * n
    for k in range(n):
        out[k] = tree.cut[k] or k > 0 and out[tree.parent[k]]
    chars, tags, linked, links, sums = [0] * n, [0] * n, [0] * n, [0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        if out[k]:
            continue
        for part in tree.parts[k]:
            if isinstance(part, str):
                chars[k] += len(part) - len(_BLANK.findall(part))
        if tree.tag[k] == "a":
            linked[k], links[k] = chars[k], links[k] + 1
        if k:
            up = tree.parent[k]
            chars[up] += chars[k]
            tags[up] += tags[k] + 1
            linked[up] += linked[k]
            links[up] += links[k]
    body = next((k for k in range(n) if tree.tag[k] == "body" and not out[k]), 0)
    share = linked[body] / max(1, chars[body])
    density = [0.0] * n
    for k in range(n):
        if not out[k] and chars[k]:
            free = max(1, chars[k] - linked[k])
            base = math.log(chars[k] / free * linked[k] + share * chars[k] + math.e)
            links_per = chars[k] / max(1, linked[k]) * max(1, tags[k]) / max(1, links[k])
            density[k] = chars[k] / max(1, tags[k]) * math.log(max(links_per, 1.0)) / max(0.1, math.log(base))
            if k:
                sums[tree.parent[k]] += density[k]
    best = max(range(n), key=lambda k: (sums[k], -k))
    path, up = [], best
    while up >= 0:
        path.append(up)
        up = tree.parent[up]
    framed = [k for k in path if tree.tag[k] in ("article", "main")]
    if not framed and best in (0, body):
        framed = [k for k in range(n) if tree.tag[k] in ("article", "main") and not out[k] and chars[k]][:1]
    if framed:
        articles = [k for k in framed if tree.tag[k] == "article"]
        return (articles or framed)[-1], set()
    if sums[best] == 0:
        return body, set()
    return _grown(tree, best, path[: path.index(body) + 1] if body in path else path, out, chars, linked, density)


def _grown(tree: _Tree, best: int, path: list[int], out: list[bool], chars: list[int], linked: list[int], density: list[float]) -> tuple[int, set[int]]:
    """The subtree of the largest density sum, grown up the path to the body, and the parts in it to leave out.

    The least density on the path is the threshold. A parent takes the node's place while another part of
    it that is dense enough and has more text outside links than in them stands beside the node: a
    section, a lead paragraph, a headline. Parts below the threshold that hold others are left out.
    """
    threshold = min(density[k] for k in path)
    kids: dict[int, list[int]] = {}
    on_path = set(path)
    for k in range(1, len(tree.tag)):
        if tree.parent[k] in on_path and not out[k] and chars[k]:
            kids.setdefault(tree.parent[k], []).append(k)

    def plain(k: int) -> bool:
        return 2 * linked[k] < chars[k]

    def more(k: int) -> bool:
        """Whether a part beside the node is of the article too."""
        return plain(k) and (tree.tag[k] in HEADINGS or density[k] >= threshold and (tree.tag[k] in PROSE or density[k] >= density[best] / 2))

    top = 0
    for i in range(1, len(path)):
        if any(k not in on_path and more(k) for k in kids.get(path[i], [])):
            top = i
    root = path[top]
    leave = {k for up in path[: top + 1] for k in kids.get(up, []) if k not in on_path and tree.tag[k] in HOLDERS and (density[k] < threshold or not plain(k))}
    return root, leave


def main_text(page: str) -> str:
    """The article's blocks, one a line; empty if there is none."""
    tree = parse(page)
    _holders(tree)
    root, leave = _chosen(tree)
    blocks: list[list[str]] = [[]]
    todo: list = [root]
    while todo:
        item = todo.pop()
        if item is None:
            blocks.append([])
        elif isinstance(item, str):
            blocks[-1].append(item)
        elif not tree.cut[item] and item not in leave:
            tag = tree.tag[item]
            if tag == "br":
                blocks[-1].append(" ")
            elif tag in BLOCK:
                blocks.append([])
                todo.append(None)
            todo.extend(reversed(tree.parts[item]))
    lines = (_BLANK.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def _extract(batches):
    for batch in batches:
        names = [c for c in batch.schema.names if c != "_html"]
        texts = [main_text(p) if p else "" for p in batch.column("_html").to_pylist()]
        schema = pa.schema([*(batch.schema.field(c) for c in names), ("text", pa.string()), ("n_chars", pa.int64())])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text (the main text) and n_chars (its code points).

    Null, empty and textless pages give an empty text and 0. Pages are read whole, each row by itself.
    Columns of pages named text or n_chars are replaced, others handed through.
    """
    names = {"text", "n_chars", "_html", html_col}
    kept = pages.select(*[c for c in pages.columns if c not in names], F.col(html_col).cast("string").alias("_html"))
    out = T.StructType([f for f in kept.schema if f.name != "_html"] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return kept.mapInArrow(_extract, out)
