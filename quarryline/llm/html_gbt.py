"""Main text of web pages by gradient-boosted trees over DOM nodes and a hierarchical decision.

A tolerant parser builds the page's element tree. Every block element gets features: what kind of
element it is, which groups of words its class, id and role name (and those of its ancestors), depth,
text, link and markup density of its subtree, and how it stands among its siblings. Boosted trees,
trained here on generated pages whose main nodes are known, give its log-odds of holding main text;
outside them only the contents of scripts, styles and other elements that are no text are left out. The decision is taken over the tree: a node's gain is its own log-odds plus its children's positive
gains by their share of its text; a node is kept if its gain is positive and its parent is kept, so a
kept node never lies in a dropped one, and a dropped node's whole subtree goes.

A tag with an unclosed quote ends at its first bracket, one without a bracket at the page's end; neither
becomes text. Work grows in proportion to a page's length, whatever is unclosed or nested in it.

Defined cases: null and empty pages give an empty text; very long pages are parsed whole; a gain of
exactly zero drops a node; repeated pages give equal rows; a null url is
returned as it is; an empty table gives an empty result; further columns are ignored; white space is
Unicode white space; a line break counts as white space.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import wordbpe

#: A comment, a tag with closed quotes, a tag up to the first bracket, another declaration; no part is tried in two ways.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|[^>]*+(?:>|$))|<[!?/][^>]*+(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
WORDS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow msub msup q s samp small span strike strong sub sup time tt u var wbr".split())
KINDS = ("article", "main", "section", "div", "p", "li", "ul", "ol", "h1", "h2", "h3", "header", "footer", "aside", "table", "tr", "td", "blockquote", "figure", "pre", "body", "address", "nav", "form", "button", "select", "menu", "dialog")
GROUPS = {
    "main": "article post entry content main story body text copy prose read",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs toolbar skip",
    "head": "header head masthead top topbar brand logo",
    "foot": "footer foot bottom copyright legal imprint colophon",
    "side": "sidebar side aside widget widgets rail complementary secondary",
    "ad": "ad ads adv advert advertisement adsbox banner sponsor sponsored promo promotion promoted partner",
    "notice": "notice cookie cookies consent alert gdpr popup modal overlay message warning",
    "comment": "comment comments reply replies discussion disqus respond feedback reader readers",
    "share": "share sharing social follow like tweet",
    "related": "related recommended more similar also popular trending links list",
    "form": "form login search subscribe newsletter signup register contact",
    "meta": "meta byline author date tags tag category caption credit",
}
GROUP_OF = {w: i for i, ws in enumerate(GROUPS.values()) for w in ws.split()}
N_GROUPS = len(GROUPS)
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
OWN_CLOSERS = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
STOPS = frozenset("ul ol table body html div article section main td".split())


class Node:
    __slots__ = ("tag", "groups", "parent", "block", "children", "parts", "depth", "truth")

    def __init__(self, tag: str, groups: int, parent: Node | None):
        self.tag, self.groups, self.parent = tag, groups, parent
        self.block = self if tag not in INLINE or parent is None else parent.block  # the block that its text belongs to
        self.children: list[Node] = []
        self.parts: list = []  # own text, and children where they stand in it
        self.depth = parent.depth + 1 if parent else 0
        self.truth = None


def _groups(attributes: str) -> tuple[int, str | None]:
    """Bits of the word groups that class, id, role and label name, and the generator's own mark."""
    bits, truth = 0, None
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            for w in WORDS.findall((a or b or c).lower()):
                if w in GROUP_OF:
                    bits |= 1 << GROUP_OF[w]
        elif name == "data-truth":
            truth = a
    return bits, truth


def parse(page: str) -> Node:
    """The element tree; inline elements are kept as nodes but their text belongs to the block around."""
    root = Node("body", 0, None)
    top, at, end = root, 0, len(page)
    find, open_ = TOKEN.search, Counter()

    def leave(to: Node) -> None:
        """Close all elements below ``to``."""
        nonlocal top
        while top is not to:
            open_[top.tag] -= 1
            top = top.parent

    while at < end:
        m = find(page, at)
        if not m:
            top.parts.append(page[at:])
            break
        if m.start() > at:
            top.parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if open_[tag] > 0:
                node = top
                while node.tag != tag or node is root:
                    node = node.parent
                leave(node.parent)
            elif tag == "br":
                top.parts.append(" ")
            continue
        if tag in ("html", "body"):
            if open_["head"] > 0:
                while top.tag != "head":
                    leave(top.parent)
                leave(top.parent)
            root.groups |= _groups(m[3])[0] if m[3] else 0
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                top.parts.append(" ")
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}\\s*+>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in CLOSES_P and top.block.tag == "p":
            leave(top.block.parent)
        if tag in OWN_CLOSERS and any(open_[t] > 0 for t in OWN_CLOSERS[tag]):
            node = top
            while node is not root and node.tag not in STOPS and node.tag not in OWN_CLOSERS[tag]:
                node = node.parent
            if node.tag in OWN_CLOSERS[tag]:
                leave(node.parent)
        groups, truth = _groups(m[3]) if m[3] else (0, None)
        node = Node(tag, groups, top)
        node.truth = truth
        top.children.append(node)
        top.parts.append(node)
        if (m[3] or "")[-1:] != "/" or tag not in INLINE:
            top = node
            open_[tag] += 1
    return root


def blocks_of(root: Node) -> list[Node]:
    """Block elements in page order, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag not in INLINE:
            out.append(node)
        todo.extend(reversed(node.children))
    return out


N_FEATURES = len(KINDS) + 2 * N_GROUPS + 15


def features(blocks: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """A row per block, and the block's parent as an index (-1 for the root)."""
    place = {id(b): i for i, b in enumerate(blocks)}
    n = len(blocks)
    text, links, tags, paras = (np.zeros(n) for _ in range(4))
    parent = np.full(n, -1)
    above = np.zeros(n, np.int64)
    x = np.zeros((n, N_FEATURES))
    for i, b in enumerate(blocks):
        if i:
            parent[i] = place[id(b.parent.block)]
            above[i] = above[parent[i]] | blocks[parent[i]].groups
        todo = [(b, False)]
        while todo:
            node, link = todo.pop()
            tags[i] += 1
            for part in node.parts:
                if isinstance(part, str):
                    k = len(part) if not part.isspace() else 0
                    text[i] += k
                    if link:
                        links[i] += k
                elif part.tag in INLINE:
                    todo.append((part, link or part.tag == "a"))
        paras[i] = b.tag == "p"
    own = text.copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (text, links, tags, paras):
            a[p] += a[i]
    siblings = np.zeros(n)
    same = np.zeros(n)
    rank = np.zeros(n)
    by: dict[int, list[int]] = {}
    for i in range(1, n):
        by.setdefault(int(parent[i]), []).append(i)
    for kids in by.values():
        names = Counter(blocks[k].tag for k in kids)
        for r, k in enumerate(kids):
            siblings[k], rank[k], same[k] = len(kids), (r + 1) / len(kids), names[blocks[k].tag] / len(kids)
    kind = {t: i for i, t in enumerate(KINDS)}
    up = np.maximum(parent, 0)
    for i, b in enumerate(blocks):
        if b.tag in kind:
            x[i, kind[b.tag]] = 1
        x[i, len(KINDS) : len(KINDS) + N_GROUPS] = [b.groups >> g & 1 for g in range(N_GROUPS)]
        x[i, len(KINDS) + N_GROUPS : len(KINDS) + 2 * N_GROUPS] = [above[i] >> g & 1 for g in range(N_GROUPS)]
    kinds_above = np.zeros((n, 3))
    for i in range(1, n):
        t = blocks[parent[i]].tag
        kinds_above[i] = kinds_above[parent[i]]
        if t in ("article", "main"):
            kinds_above[i, 0] = 1
        elif t in ("header", "footer", "aside"):
            kinds_above[i, 1] = 1
        elif t in ("ul", "ol", "table"):
            kinds_above[i, 2] = 1
    total = max(1.0, text[0] if n else 1.0)
    depth = np.array([b.depth for b in blocks], float)
    rest = [np.log1p(text), np.log1p(own), links / np.maximum(text, 1), np.log1p(text / np.maximum(tags, 1)), np.log1p(tags), np.log1p(paras), text / total, text / np.maximum(text[up], 1), depth, np.log1p(siblings), rank, same, *kinds_above.T]
    x[:, len(KINDS) + 2 * N_GROUPS :] = np.stack(rest, axis=1)
    return x, parent


@dataclass(frozen=True)
class Boosting:
    """``pages`` generated pages, ``trees`` of ``depth``; ``seed`` of the generator."""

    pages: int = 2000
    trees: int = 60
    depth: int = 4
    rate: float = 0.25
    bins: int = 32
    ridge: float = 1.0
    seed: int = 11


class Forest:
    """Boosted complete trees: split features, thresholds and leaf values by heap position."""

    def __init__(self, depth: int):
        self.depth, self.split, self.limit, self.leaf = depth, [], [], []

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, line = np.zeros(len(x)), np.arange(len(x))
        for split, limit, leaf in zip(self.split, self.limit, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[line, split[at]] > limit[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rule: Boosting) -> Forest:
    """Second-order boosting of the logistic loss on histogram splits."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, rule.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    n, width = x.shape
    bins = rule.bins + 1
    forest, f = Forest(rule.depth), np.zeros(n)
    spread = binned + np.arange(width) * bins
    for _ in range(rule.trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        split, limit = np.zeros(2**rule.depth - 1, np.int64), np.full(2**rule.depth - 1, np.inf)
        for level in range(rule.depth):
            first, count = 2**level - 1, 2**level
            key = ((at - first)[:, None] * (width * bins) + spread).ravel()
            gs = np.bincount(key, np.repeat(g, width), count * width * bins).reshape(count, width, bins)
            hs = np.bincount(key, np.repeat(h, width), count * width * bins).reshape(count, width, bins)
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + rule.ridge) + (gt - gl) ** 2 / (ht - hl + rule.ridge) - gt**2 / (ht + rule.ridge)
            best = gain.reshape(count, -1).argmax(axis=1)
            for node in range(count):
                feature, b = divmod(int(best[node]), bins)
                if gain[node, feature, b] > 1e-6 and b < len(edges[feature]):
                    split[first + node], limit[first + node] = feature, edges[feature][b]
            at = 2 * at + 1 + (x[np.arange(n), split[at]] > limit[at])
        leaf = at - (2**rule.depth - 1)
        gsum, hsum = np.bincount(leaf, g, 2**rule.depth), np.bincount(leaf, h, 2**rule.depth)
        value = rule.rate * gsum / (hsum + rule.ridge)
        forest.split.append(split)
        forest.limit.append(limit)
        forest.leaf.append(value)
        f += value[leaf]
    return forest


def generated_page(rng: np.random.Generator) -> str:
    """A page in one of very many layouts; main blocks carry data-truth="1"."""
    pick = lambda *xs: xs[rng.integers(len(xs))]
    syllables = "ka to mi re sol an der ing tion pla es qu be ur em ot li zu ne".split()
    style = pick("plain", "plain", "plain", "marks", "caps", "bars")

    def words(n):
        out = ["".join(pick(*syllables) for _ in range(rng.integers(1, 4))) for _ in range(n)]
        for i in range(0, n, 9):
            out[min(n - 1, i + int(rng.integers(3, 9)))] += pick(".", ",", ".")
        return " ".join(out)

    def prose(n):
        t = words(n)
        if style == "marks":
            return " ".join(w + pick("***", "%%%", "$$$", "&amp;&amp;") for w in t.split())
        return {"plain": t, "caps": t.upper().replace(" ", "!! "), "bars": t.replace(" ", " | ")}[style] if style != "marks" else t

    def links(n):
        item = lambda: f'<a href="/{words(1)}">{words(int(rng.integers(1, 3)))}</a>'
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return pick(" | ", " ", " &middot; ").join(item() for _ in range(n))

    def box(tags, names, inside):
        tag = pick(*tags)
        plain = tag != "div" and tag != "section"
        name = "" if plain and rng.random() < 0.6 else f' {pick("class", "class", "id")}="{pick(*names)}{pick("", "", "-box", " wide", "1")}"'
        return f"<{tag}{name}>{inside}</{tag}>"

    few = lambda a, b: int(rng.integers(a, b))
    paragraph = lambda n: f"<p>{prose(n)}</p>"
    junk = {
        "nav": lambda: box(("nav", "div"), ("menu", "navbar", "navigation", "breadcrumb", "nav"), links(few(3, 12))),
        "header": lambda: box(("header", "div"), ("header", "masthead", "top", "site-header"), pick(f"<h2>{words(3)}</h2>", f"<p>{words(6)}</p>", links(few(2, 6)))),
        "footer": lambda: box(("footer", "div"), ("footer", "copyright", "bottom", "legal"), pick("&copy; ", "", "&copy; ") + words(few(3, 45)) + pick("", "", links(few(2, 6)))),
        "aside": lambda: box(("aside", "div"), ("sidebar", "widget", "side", "rail"), f"<h3>{words(2)}</h3>" + pick(links(few(3, 9)), paragraph(few(8, 60)))),
        "notice": lambda: box(("div", "section"), ("cookie-notice", "notice", "alert", "consent", "popup"), pick(words(few(5, 25)), paragraph(few(5, 30)))),
        "ad": lambda: box(("div", "section", "aside"), ("ad", "ads", "advert", "sponsored", "promo", "banner"), pick(words(few(4, 30)), paragraph(few(5, 50)))),
        "comments": lambda: box(("section", "div"), ("comments", "discussion", "comment-list", "replies"), f"<h3>{words(2)}</h3>" * few(0, 2) + "".join(f'<div class="{pick("comment", "reply", "item")}">{paragraph(few(5, 80))}</div>' for _ in range(few(1, 7)))),
        "share": lambda: box(("div",), ("share", "social", "follow"), links(few(2, 6))),
        "related": lambda: box(("div", "section", "aside"), ("related", "recommended", "popular", "more-links"), f"<h3>{words(2)}</h3>" + links(few(3, 8))),
        "button": lambda: pick(f"<button>{words(few(1, 4))}</button>", "<select>" + "".join(f"<option>{words(1)}</option>" for _ in range(few(2, 9))) + "</select>", f"<dialog>{words(few(3, 20))}</dialog>", f"<menu><li>{words(1)}</li><li>{words(2)}</li></menu>"),
        "form": lambda: f'<form class="{pick("search", "comment-form", "contact", "")}"><p>{words(few(2, 9))}</p><label>{words(1)}</label><input type="text"><textarea>{words(2)}</textarea><button>{words(1)}</button></form>' if rng.random() < 0.3 else f'<div class="{pick("newsletter", "subscribe", "login", "search")}"><form><p>{words(few(3, 9))}</p><input type="text"><button>{words(1)}</button></form></div>',
    }
    true = ' data-truth="1"'

    def body():
        out = [f"<h1{true}>{prose(pick(few(1, 4), few(1, 25)))}</h1>"] if rng.random() < 0.85 else []
        if out and rng.random() < 0.15:  # a headline in a header of the article's own
            out = [f"<header{true}>{out[0]}</header>"]
        short = rng.random() < 0.25
        for _ in range(few(1, 4) if short else few(1, 14)):
            kind, n = rng.random(), pick(few(1, 4), few(1, 15)) if short else pick(few(1, 6), few(8, 120), few(8, 120), few(20, 300))
            if kind < 0.72:
                t = prose(n)
                if rng.random() < 0.04:
                    t = f"{words(3)} <label>{words(2)}</label> {t} <math><mi>{words(1)}</mi></math>"
                t = f"<b>{t}" if rng.random() < 0.1 else t + (f' <a href="#">{words(2)}</a> {words(3)}.' if rng.random() < 0.2 else "")
                out.append(f"<p{true}>{t}" + pick("</p>", "</p>", "</p>", "<br>", ""))
            elif kind < 0.78:
                out.append(f"<{pick('h2', 'h3')}{true}>{words(few(2, 7))}</h2>".replace("</h2>", "") + "</h2></h3>")
            elif kind < 0.84:
                out.append(f"<ul{true}>" + "".join(f"<li{true}>{prose(few(2, 25))}</li>" for _ in range(few(2, 6))) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote{true}>{prose(few(6, 40))}</blockquote>")
            elif kind < 0.90:
                out.append(f"<table{true}>" + "".join(f"<tr{true}><td{true}>{words(2)}</td><td{true}>{words(3)}</td></tr>" for _ in range(few(1, 4))) + "</table>")
            elif kind < 0.93:
                out.append(f"<div{true}>{prose(few(10, 90))}</div>")
            else:
                out.append(junk[pick("ad", "share", "related", "form", "aside", "button")]())
        return "".join(out)

    tag = pick("article", "article", "main", "div", "div", "section")
    name = "" if (tag in ("article", "main") and rng.random() < 0.6) or rng.random() < 0.15 else f' {pick("class", "id")}="{pick("content", "post", "entry-content", "article-body", "story", "main", "text", "page")}"'
    main = f"<{tag}{name}{true}>{body()}" + (junk[pick("comments", "share", "related")]() if rng.random() < 0.2 else "") + f"</{tag}>"
    if rng.random() < 0.15:  # nothing around the article
        main = body()
    bare = rng.random() < 0.08  # nor anything beside it
    before = [junk[k]() for k in ("nav", "header", "notice", "ad", "aside", "form") if not bare and rng.random() < 0.45]
    after = [junk[k]() for k in ("comments", "related", "aside", "ad", "share", "footer", "notice", "form") if not bare and rng.random() < 0.4]
    rng.shuffle(before)
    page = "".join(before) + main + "".join(after)
    for _ in range(few(0, 3)):
        page = f"<div{pick('', ' class="wrapper"', ' id="page"', ' class="container"')}{true}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title><script>var a=1;</script></head><body>{page}</body></html>"


def trained(rule: Boosting = Boosting()) -> Forest:
    rng = np.random.default_rng(rule.seed)
    xs, ys = [], []
    for _ in range(rule.pages):
        blocks = blocks_of(parse(generated_page(rng)))
        xs.append(features(blocks)[0])
        ys.append(np.array([b.truth == "1" or i == 0 for i, b in enumerate(blocks)], float))
    return boost(np.concatenate(xs), np.concatenate(ys), rule)


def decide(odds: np.ndarray, parent: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which blocks are kept: gains from the leaves up, then from the root down."""
    gain = odds.copy()
    for i in range(len(odds) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i] * size[i] / max(1.0, size[parent[i]])
    keep = gain > 0
    if len(keep):
        keep[0] = True
    for i in range(1, len(odds)):
        keep[i] &= keep[parent[i]]
    return keep


def kept_text(blocks: list[Node], keep: np.ndarray) -> str:
    """Texts of kept blocks in page order, one space between blocks and words."""
    kept = {id(b) for b, k in zip(blocks, keep.tolist(), strict=True) if k}
    out: list[str] = []
    todo: list = [blocks[0]] if blocks else []
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        elif part.tag in INLINE:
            todo.extend(reversed(part.parts))
        elif id(part) not in kept:
            out.append(" ")
        else:
            out.append(" ")
            todo.append(" ")
            todo.extend(reversed(part.parts))
    return " ".join(html.unescape("".join(out)).split())


def main_texts(pages: list[str], forest: Forest) -> list[str]:
    trees = [blocks_of(parse(p)) for p in pages]
    found = [features(b) for b in trees]
    cuts = np.cumsum([0, *(len(b) for b in trees)])
    odds = forest.log_odds(np.concatenate([x for x, _ in found])) if found else np.zeros(0)
    at = len(KINDS) + 2 * N_GROUPS
    return [kept_text(b, decide(odds[a:z], parent, np.expm1(x[:, at]))) for b, (x, parent), a, z in zip(trees, found, cuts[:-1], cuts[1:], strict=True)]


def extract(pages: DataFrame, forest: Forest | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""
    forest = forest or trained()
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for b in wordbpe.slices(batch, 2, 1 << 20):
                texts = main_texts([p or "" for p in b.column(2).to_pylist()], forest)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op3_html_gbt(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
