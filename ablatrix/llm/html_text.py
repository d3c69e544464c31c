"""HTML extraction: a tree-structured graphical model over DOM nodes, solved by sum-product."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.llm.common import ship, table

#: Labelled pages that the model is trained on, drawn from templates by labelled_pages().
TRAINING_PAGES, SEED = 200, 7

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z|(?=["']))|<[!?/][^>]*(?:>|\Z)""", re.S)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose text isn't markup, and others that hold no text of the page.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
DROPPED = RAW | frozenset("noscript template svg math object select button canvas audio video".split())
BLOCKS = {
    name: group
    for group, names in {
        "article": "article main",
        "nav": "nav menu",
        "header": "header",
        "footer": "footer address",
        "aside": "aside",
        "form": "form fieldset label dialog",
        "p": "p pre blockquote figure figcaption",
        "heading": "h1 h2 h3 h4 h5 h6 hgroup",
        "list": "ul ol dl li dt dd",
        "table": "table thead tbody tfoot tr td th caption",
        "page": "html body head",
        "box": "div section center details summary hr",
    }.items()
    for name in names.split()
}
#: Words in class, id and role that speak for or against content.
AGAINST = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar side aside widget "
    "related recommended share sharing social cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login search form pagination pager copyright legal "
    "disclaimer toolbar tags meta byline hidden contentinfo complementary".split()
)
COMMENTS = frozenset("comment comments reply replies disqus discussion respond reader readers".split())
FOR = frozenset("article content main post story entry body text page prose".split())
#: What an open element of a kind is closed by, besides its end tag, and where the search for it stops.
_CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}


@dataclass
class Node:
    tag: str
    hint: str
    parent: int
    runs: list = field(default_factory=list)  # numbers of its text blocks
    chars: int = 0
    linked: int = 0
    stops: bool = False


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block-level nodes, the body first and parents before children, and the text blocks as (node, text) in page order.

    Inline elements belong to their block.  Any page parses: a paragraph ends where a block begins, stray end tags are
    passed over, what is open at the end is closed.  A dropped element goes with all that it holds; one that is never
    closed takes no more than the text up to the next block with it, but scripts and styles the rest of the page.
    """
    nodes, blocks, closed = [Node("body", "none", -1)], [], {}
    stack, pieces, anchor = [0], [], False

    def flush() -> None:
        text = " ".join("".join(html.unescape(t) for t, _ in pieces).split()) if pieces else ""
        if text:
            node = nodes[stack[-1]]
            node.runs.append(len(blocks))
            node.chars += len(text)
            node.linked += min(len(text), sum(len(t) for t, linked in pieces if linked))
            node.stops |= text[-1] in ".!?…:;”\"'"
            blocks.append((stack[-1], text))
        pieces.clear()

    def close(names: tuple[str, ...], until: tuple[str, ...]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if nodes[stack[at]].tag in names:
                del stack[at:]
                return
            if nodes[stack[at]].tag in until:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            pieces.append((page[at:], anchor))
            break
        if m.start() > at:
            pieces.append((page[at : m.start()], anchor))
        at = max(m.end(), m.start() + 1)
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in DROPPED:
            if not m[1] and not m[3].endswith("/"):
                at = _past(page, m.start(), at, tag, closed)
            continue
        if tag == "a":
            anchor = not m[1]
        elif tag == "br":
            pieces.append((" ", anchor))
        elif tag in BLOCKS:
            flush()
            anchor = False
            if m[1]:
                close((tag,), ())
            elif BLOCKS[tag] != "page" and tag != "hr":
                if nodes[stack[-1]].tag == "p" or "p" in (nodes[i].tag for i in stack[-2:]):
                    close(("p",), ("article", "div", "section", "td", "li", "body"))
                if tag in _CLOSES:
                    names, until = _CLOSES[tag]
                    close(tuple(names.split()), until)
                nodes.append(Node(tag, _hint(m[3]), stack[-1]))
                stack.append(len(nodes) - 1)
    flush()
    return nodes, blocks


_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.I)


def _closed(page: str, tag: str) -> dict[int, int]:
    """By where each start tag of a dropped element stands, where its end tag ends; those never closed are left out."""
    found: dict[int, int] = {}
    opened: list[int] = []
    for m in re.compile(rf"<(/?){tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).finditer(page):
        if not m[1]:
            if not m[0].endswith("/>"):
                opened.append(m.start())
        elif tag in RAW:
            found.update((o, m.end()) for o in opened)
            opened = []
        elif opened:
            found[opened.pop()] = m.end()
    return found


def _past(page: str, start: int, at: int, tag: str, closed: dict[str, dict[int, int]]) -> int:
    """Where the page goes on after a dropped element whose start tag stands from ``start`` to ``at``; closed keeps _closed() by tag."""
    if tag not in closed:
        closed[tag] = _closed(page, tag)
    end = closed[tag].get(start)
    if end is not None:
        return end
    if tag in ("script", "style"):
        return len(page)
    block = _BLOCK_TAG.search(page, at)
    return block.start() if block else len(page)


def _hint(attributes: str) -> str:
    if not attributes:
        return "none"
    found = {w.lower() for m in _HINT.finditer(attributes) for w in _PARTS.findall(m[1] or m[2] or m[3] or "")}
    if re.search(r"\bhidden\b|display:\s*none", attributes):
        return "against"
    if found & COMMENTS:
        return "comments"
    return "both" if found & AGAINST and found & FOR else "against" if found & AGAINST else "for" if found & FOR else "none"


def observed(node: Node) -> tuple[tuple[str, object], ...]:
    """What a node shows beside its kind: hint, length of its own text, share of links, end of a sentence."""
    n, share = node.chars, node.linked / node.chars if node.chars else 0
    return (
        ("hint", node.hint),
        ("size", 0 if not n else 1 if n <= 25 else 2 if n <= 80 else 3 if n <= 300 else 4),
        ("links", "none" if not n else 0 if share == 0 else 1 if share < 0.4 else 2),
        ("stops", node.stops if n else "none"),
    )


class TreeModel:
    """Two states a node, content or not: node potentials by what it shows, edge potentials by its parent's state and its kind."""

    def __init__(self, labelled: list[tuple[list[Node], list[bool]]], smooth: float = 0.5):
        seen, edges, totals = Counter(), Counter(), Counter()
        for nodes, states in labelled:
            for node, state in zip(nodes, states):
                totals[state] += 1
                for name, value in observed(node):
                    seen[name, value, state] += 1
                if node.parent >= 0:
                    edges[BLOCKS[node.tag], states[node.parent], state] += 1
        self.kinds = Counter(name for name, _ in {(n, v) for n, v, _ in seen})
        self.seen, self.totals, self.smooth = seen, totals, smooth
        self.edge = {
            kind: [[(edges[kind, a, b] + smooth) / (edges[kind, a, False] + edges[kind, a, True] + 2 * smooth) for b in (False, True)] for a in (False, True)]
            for kind in set(BLOCKS.values())
        }
        whole = sum(states[0] for _, states in labelled)
        self.first = [(len(labelled) - whole + smooth) / (len(labelled) + 2 * smooth), (whole + smooth) / (len(labelled) + 2 * smooth)]
        self.memory: dict[tuple, tuple[float, float]] = {}

    def potential(self, node: Node) -> tuple[float, float]:
        shown = observed(node)
        found = self.memory.get(shown)
        if found is None:
            logs = [
                sum(math.log((self.seen[name, value, s] + self.smooth) / (self.totals[s] + self.smooth * (self.kinds[name] + 1))) for name, value in shown)
                for s in (False, True)
            ]
            top = max(logs)
            found = self.memory[shown] = (math.exp(logs[0] - top), math.exp(logs[1] - top))
        return found

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's chance of content: messages from the leaves up, then from the root down."""
        edges = [self.edge[BLOCKS[n.tag]] for n in nodes]
        belief = [list(self.potential(n)) for n in nodes]
        up = [(1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
            a, b = belief[i]
            edge = edges[i]
            m0, m1 = edge[0][0] * a + edge[0][1] * b, edge[1][0] * a + edge[1][1] * b
            scale = m0 + m1
            up[i] = (m0 / scale, m1 / scale)
            above = belief[nodes[i].parent]
            above[0] *= up[i][0]
            above[1] *= up[i][1]
            top = max(above)
            above[0] /= top
            above[1] /= top
        out = [0.0] * len(nodes)
        full = belief
        full[0] = [full[0][0] * self.first[0], full[0][1] * self.first[1]]
        for i, node in enumerate(nodes):
            if i:
                p, edge = full[node.parent], edges[i]
                a, b = p[0] / max(up[i][0], 1e-300), p[1] / max(up[i][1], 1e-300)
                down0, down1 = a * edge[0][0] + b * edge[1][0], a * edge[0][1] + b * edge[1][1]
                scale = down0 + down1 or 1.0
                full[i] = [full[i][0] * down0 / scale, full[i][1] * down1 / scale]
            total = full[i][0] + full[i][1]
            out[i] = full[i][1] / total if total else 0.0
            if total:
                full[i] = [full[i][0] / total, full[i][1] / total]
        return out


def labelled_pages(count: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[list[Node], list[bool]]]:
    """Training pages with each node's state, drawn from templates: no table has labelled pages.

    A template marks a content element by the attribute data-content, which says nothing to parse().
    """
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("aeioustrnlmd") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def sentences(low: int, high: int) -> str:
        return " ".join(words(1, 16).capitalize() + rng.choice("...?!") for _ in range(rng.randint(low, high)))

    def links(tag: str) -> str:
        return "".join(f'<{tag}><a href="/x">{words(1, 3)}</a></{tag}>' for _ in range(rng.randint(3, 9)))

    def pick(*options: str) -> str:
        return rng.choice(options)

    def boilerplate() -> str:
        return pick(
            f"<nav><ul>{links('li')}</ul></nav>", f'<div class="{pick("menu", "navbar", "nav main-nav")}"><ul>{links("li")}</ul></div>',
            f"<header><h2>{words(1, 4)}</h2><p>{words(2, 8)}</p></header>", f'<div class="{pick("ad", "ads", "advert", "sponsored", "promo box")}">{sentences(1, 3)}</div>',
            f'<div class="{pick("cookie-notice", "banner", "alert", "consent")}"><p>{sentences(1, 2)}</p></div>', f"<aside><h3>{words(1, 3)}</h3><p>{sentences(1, 3)}</p><ul>{links('li')}</ul></aside>",
            f'<div class="{pick("sidebar", "related", "widget")}"><h3>{words(1, 3)}</h3><ul>{links("li")}</ul><p>{sentences(1, 2)}</p></div>',
            f'<form><p>{words(1, 4)}</p><label>{words(1, 2)}</label><input></form>', f"<div><p>{links('span')}</p></div>", f"<div>{links('div')}</div>",
        )

    def article() -> str:
        mark = " data-content=1"
        body = f"<{pick('h1', 'h1', 'h2')}{mark}>{words(2, 10)}</h1>" if rng.random() < 0.9 else ""
        for _ in range(rng.randint(1, 12)):
            body += pick(
                *[f"<p{mark}>{sentences(1, 9)}</p>"] * 6, f"<p{mark}><b>{words(1, 9)}.<br><p{mark}>{sentences(1, 5)}", f"<p{mark}>{words(1, 3)}</p>",
                f"<h2{mark}>{words(1, 6)}</h2>", f"<ul{mark}>" + "".join(f"<li{mark}>{words(2, 14)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>",
                f"<blockquote{mark}>{sentences(1, 4)}</blockquote>", f"<p{mark}>{sentences(1, 3)} <a href='/y'>{words(1, 3)}</a> {sentences(1, 3)}</p>",
                f"<table{mark}><tr{mark}><td{mark}>{words(1, 4)}</td><td{mark}>{words(1, 4)}</td></tr></table>",
            )
            if rng.random() < 0.03:
                body += f'<div class="{pick("text-header", "post-banner", "story meta", "content-widget", "article-header")}"{mark}>' + "".join(f"<p{mark}>{sentences(1, 6)}</p>" for _ in range(rng.randint(1, 3))) + "</div>"
            if rng.random() < 0.06:
                body += pick(f'<div class="ad">{sentences(1, 2)}</div>', f"<aside><p>{sentences(1, 2)}</p></aside>", f'<div class="share">{links("span")}</div>')
        return body

    def page() -> str:
        before, after = "".join(boilerplate() for _ in range(rng.randint(1, 3))), "".join(boilerplate() for _ in range(rng.randint(0, 2)))
        comments = pick("", f'<{pick("div", "section")} class="comments"><h3>{words(1, 3)}</h3><div class="comment"><p>{sentences(1, 4)}</p></div><div class="comment"><p>{sentences(1, 3)}</p></div></div>')
        wrap = pick("article", "article", "article", "main", 'div class="content"', 'div id="post-body"', "div", "section", "")
        inner = f"<{wrap} data-content=1>{article()}</{wrap.split()[0]}>" if wrap else article()
        foot = f"<footer>{words(2, 8)} <p>{sentences(1, 2)}</p></footer>" if rng.random() < 0.8 else f'<div class="footer">{words(3, 9)}</div>'
        tail = rng.random()
        inner = inner.replace(f"</{wrap.split()[0]}>", comments + f"</{wrap.split()[0]}>") if wrap and comments and tail < 0.4 else inner + comments
        body = "<body>" if wrap else "<body data-content=1>"
        return f"<html><head><title>{words(1, 5)}</title></head>{body}{before}{inner}{after}{foot}</body></html>"

    out = []
    for _ in range(count):
        source = page()
        nodes = parse(source)[0]
        states = [False] * len(nodes)
        opened = [m for m in _TOKEN.finditer(source) if m[2] and not m[1] and BLOCKS.get(m[2].lower(), "page") != "page"]
        states[0] = "<body data-content=1>" in source
        for i, m in enumerate(opened, start=1):
            states[i] = "data-content" in m[3]
        out.append((nodes, states))
    return out


_trained: list[TreeModel] = []


def model() -> TreeModel:
    """The trained model, once a process."""
    if not _trained:
        _trained.append(TreeModel(labelled_pages()))
    return _trained[0]


def main_text(page: str | None, tree: TreeModel | None = None) -> str:
    """The blocks whose node is more likely content than not, in page order, joined by newlines."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    chance = (tree or model()).marginals(nodes)
    return "\n".join(text for node, text in blocks if chance[node] > 0.5)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = model()
    for batch in batches:
        texts = [main_text(page, tree) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: id, url, text, n_chars (code points).

    Every row of pages gives one row, null and empty pages an empty text, whatever their id or url; pages of any length
    are read whole; an empty table gives an empty result; other columns play no part.
    """
    ship(pages.sparkSession)
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    out = source.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
