"""Main-text extraction with a tree-structured graphical model over the DOM.

Every block element of a page is a binary variable, content or not. Its own potential comes from its tag, class and id names, the
text and links in it; a potential on each parent-child edge, by the child's kind, says how content runs down the tree. Sum-product
messages, upward then downward, give exact marginals. Weights are fitted by maximum likelihood (what is seen less what the
marginals expect) on labelled pages, by default those of ``labelled_pages``, written by rules for many page designs.

Text is the article's blocks with a marginal of one half or more: references decoded, white space inside a block made one space,
trimmed, joined in page order by one space. An element's text is cut into blocks at its block children, so nothing moves.

Defined results: null and empty pages and pages without content give an empty text; text without a tag is content; unclosed tags,
comments and scripts end where HTML says, at the latest with the page; pictures (svg, canvas), buttons and menus of choices have no text,
and end with what holds them if nothing else ends them; repeated rows are extracted each; an empty table gives an empty result; other
columns are ignored. Time is linear in the page's length.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces, prepare

#: HTML's element kinds.
BLOCKS = set(
    "html body main article section aside header footer nav div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table thead tbody tfoot tr td th caption figure figcaption form fieldset legend address details summary dialog menu hr center hgroup search".split()
)
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}
SPACED = {"br", "wbr", "img", "input", "option"}
MUTE = {"svg", "canvas", "button", "select"}
SECTIONS = {"article", "main", "nav", "header", "footer", "aside", "form"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|noscript|iframe|textarea|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("attrs", "children", "links", "own", "parent", "tag", "total", "y")

    def __init__(self, tag: str, parent: int, attrs: str = "", y: int = -1):
        self.tag, self.parent, self.attrs, self.children, self.own, self.links, self.total, self.y = tag, parent, attrs, [], 0, 0, [0, 0], y


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, parents first; blocks of text in page order with their node)."""
    nodes, blocks = [Node("html", -1)], []
    stack, at, links = [0], 0, 0
    open_: dict[str, int] = {}  # how many elements of a tag the stack holds
    mute: tuple[str, int] | None = None  # the element whose text doesn't count, and the stack's height there
    run: list[str] = []

    def flush():
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                blocks.append((stack[-1], text))
                nodes[stack[-1]].own += len(text)

    def add(text: str):
        if text and not mute:
            run.append(text)
            if links:
                nodes[stack[-1]].links += len(text)

    def cut(height: int):
        nonlocal mute
        for i in stack[height:]:
            open_[nodes[i].tag] -= 1
        del stack[height:]
        if mute and height < mute[1]:
            mute = None

    for m in _TAG.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            links = max(0, links - 1) if m["end"] else 1
        elif tag in MUTE:
            if m["end"]:
                mute = None if mute and mute[0] == tag else mute
            elif not mute and not m["attrs"].endswith("/"):
                mute = (tag, len(stack))
        elif tag in SPACED:
            run.append(" ")
        elif tag in BLOCKS:
            flush()
            links = 0
            if m["end"]:
                if open_.get(tag):
                    k = len(stack) - 1
                    while nodes[stack[k]].tag != tag:
                        k -= 1
                    cut(k)
                continue
            if tag == "html" or tag == "body" and open_.get("body"):
                continue
            if tag in CLOSES_P and open_.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    name = nodes[stack[k]].tag
                    if name == "p":
                        cut(k)
                        break
                    if name in ("td", "th", "table", "li", "div", "article", "section", "body"):
                        break
            if tag in IMPLIED and any(open_.get(x) for x in IMPLIED[tag][0]):
                same, scope = IMPLIED[tag]
                for k in range(len(stack) - 1, 0, -1):
                    name = nodes[stack[k]].tag
                    if name in same:
                        cut(k)
                        if tag != "tr" or name == "tr":
                            break
                    elif name in scope:
                        break
            node = Node(tag, stack[-1], m["attrs"] or "")
            nodes[stack[-1]].children.append(len(nodes))
            if tag != "hr":
                stack.append(len(nodes))
                open_[tag] = open_.get(tag, 0) + 1
            nodes.append(node)
    add(page[at:])
    flush()
    return nodes, blocks


def _bucket(n: int) -> int:
    return min(6, (n + 19).bit_length() - 4) if n else 0


def kind(tag: str) -> str:
    return {"p": "p", "li": "li", "div": "div", "section": "div", "article": "div", "main": "div"}.get(tag, "h" if re.fullmatch("h[1-6]", tag) else "o")


KINDS = ("p", "li", "div", "h", "o")


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of the features that hold for each node."""
    for n in nodes:
        n.total = [n.own, n.links]
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[nodes[i].parent].total
        up[0] += nodes[i].total[0]
        up[1] += nodes[i].total[1]
    out, inside = [], [""] * len(nodes)
    for i, n in enumerate(nodes):
        text, links = n.total
        share = "n" if not text else "abcd"[min(3, int(4 * min(1.0, links / text)))]
        if i:  # the two nearest sections that hold the node, itself included
            held = inside[n.parent]
            inside[i] = f"{held.rpartition('.')[2]}.{n.tag}" if n.tag in SECTIONS else held
        found = ["bias", f"tag={n.tag}", f"link={share}", f"own={_bucket(n.own)}", f"all={_bucket(text)}", f"{kind(n.tag)}:{share}", f"in={inside[i]}", f"in={inside[i]}:{share}"]
        if n.attrs:
            found += {f"name={w}" for m in _NAMED.finditer(n.attrs) for w in _PART.findall((m[1] or m[2] or m[3] or "").lower())}
        out.append(found)
    return out


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def sum_product(nodes: list[Node], unary: list[float], edge: dict[str, list[float]]) -> tuple[list[float], list[float]]:
    """Log odds of every node's marginal, and of what its parent's side says of the parent. Exact on a tree.

    unary: log odds of each node alone; edge: by the child's kind, log potentials of (parent, child) = 00, 01, 10, 11.
    """
    up, held = [0.0] * len(nodes), list(unary)
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        e, w = edge[kind(nodes[i].tag)], held[i]
        up[i] = _add(w + e[3], e[2]) - _add(w + e[1], e[0])
        held[nodes[i].parent] += up[i]
    belief, cavity = held, [0.0] * len(nodes)
    for i in range(1, len(nodes)):
        e = edge[kind(nodes[i].tag)]
        cavity[i] = belief[nodes[i].parent] - up[i]
        b = cavity[i]
        belief[i] += _add(b + e[3], e[1]) - _add(b + e[2], e[0])
    return belief, cavity


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def fit(pages: list[list[Node]], rounds: int = 25, rate: float = 0.5, ridge: float = 0.002):
    """(feature weights, edge potentials) by stochastic gradient steps on labelled trees (Adagrad)."""
    weight: dict[str, float] = {}
    square: dict = {}
    edge = {k: [0.0] * 4 for k in KINDS}
    named = [(nodes, features(nodes)) for nodes in pages]
    rng = random.Random(11)

    def move(key, store, at, gradient):
        gradient -= ridge * store[at]
        square[key] = square.get(key, 1e-2) + gradient * gradient
        store[at] += rate * gradient / math.sqrt(square[key])

    for _ in range(rounds):
        rng.shuffle(named)
        for nodes, found in named:
            unary = [sum(weight.get(f, 0.0) for f in fs) for fs in found]
            belief, cavity = sum_product(nodes, unary, edge)
            grad: dict[str, float] = {}
            for n, fs, b in zip(nodes, found, belief):
                d = n.y - _sigmoid(b)
                if abs(d) > 1e-4:
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) + d
            pair: dict[str, list[float]] = {}
            for i in range(1, len(nodes)):
                k = kind(nodes[i].tag)
                e, b = edge[k], cavity[i]
                w = belief[i] - (_add(b + e[3], e[1]) - _add(b + e[2], e[0]))  # the child's side alone
                joint = [e[0], e[1] + w, e[2] + b, e[3] + b + w]
                top = max(joint)
                p = [math.exp(x - top) for x in joint]
                g = pair.setdefault(k, [0.0] * 4)
                for j in range(4):
                    g[j] -= p[j] / sum(p)
                g[2 * nodes[nodes[i].parent].y + nodes[i].y] += 1
            for f, d in grad.items():
                weight.setdefault(f, 0.0)
                move(f, weight, f, d)
            for k, g in pair.items():
                for j in range(4):
                    move((k, j), edge[k], j, g[j])
    return weight, edge


CONTENT_NAMES = "content article post entry main body story text page markdown prose single detail news blog".split()
OUTSIDE = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav links pagination pager toc",
    "header": "header masthead topbar brand logo banner site",
    "footer": "footer copyright legal bottom colophon",
    "aside": "sidebar aside widget related recommended trending popular rail",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp",
    "notice": "cookie consent notice alert popup modal gdpr warning message overlay toast paywall",
    "form": "form newsletter subscribe signup login search contact",
    "comments": "comments comment reply discussion disqus responses respond thread",
    "share": "share social sharing tags meta byline author toolbar tools",
}


def labelled_pages(n: int = 500, seed: int = 5) -> list[list[Node]]:
    """Trees of pages in many designs; y is 1 for article blocks and for elements most of whose text is theirs."""
    rng = random.Random(seed)
    pick = rng.choice
    parts = ["".join(pick("bcdfglmnprstv") + pick("aeiou") for _ in range(k)) for k in (1, 1, 2, 2, 3, 3, 4) for _ in range(40)]

    def say(a, b):
        words = [pick(parts) for _ in range(rng.randint(a, b))]
        return " ".join(words).capitalize() + pick([".", ".", ""])

    def names(words):
        return pick(["", f' class="{pick(words)}"', f' class="{pick(words)}-{pick(parts)}"', f' id="{pick(words)}"', f' class="{pick(parts)} {pick(words)}"'])

    def link():
        return f'<a href="/{pick(parts)}">{say(1, 3)}</a>'

    def outside(what):
        words = OUTSIDE[what].split()
        tag = {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol", "aside"]}.get(what, ["div", "div", "section", "p", "aside"])
        tag = pick(tag)
        name = f' class="{pick(words)}"' if tag in ("div", "section", "p", "ul", "ol") or rng.random() < 0.5 else ""
        if rng.random() < 0.3 and name:
            name = name[:-1] + f' {pick(parts)}"'
        if what == "nav" or (what in ("aside", "footer") and rng.random() < 0.5):
            items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8)))
            inner = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        elif what == "comments":
            item = "li" if tag == "ol" else "div"
            inner = "".join(f'<{item}{pick(["", " class=comment"])}><p>{say(3, 40)}</p></{item}>' for _ in range(rng.randint(1, 5)))
        elif what == "form":
            inner = f"<label>{say(1, 4)}</label><input name=q>" + pick(["", f"<p>{say(3, 15)}</p>"])
        elif what == "ad":
            inner = pick([say(2, 20), f"<p>{say(3, 20)}</p>", f"{link()} {say(2, 8)}"])
        else:
            inner = pick([say(2, 14), f"<p>{say(3, 25)}</p>", f"{link()} {link()} {say(1, 5)}", f"<h3>{say(1, 4)}</h3><p>{say(4, 25)}</p>", f"&copy; {say(2, 12)}"])
        return f"<!--0--><{tag}{name} data-y=0>{inner}</{tag}>"

    def block():
        return pick(
            [f"<p>{say(2, 90)}</p>"] * 9
            + [f"<p>{say(20, 80)} {link()} {say(5, 40)}", f"<p><b>{say(3, 30)}<br>", f"<h2>{say(1, 7)}</h2>", f"<h3>{say(1, 7)}</h3>", f"<blockquote>{say(8, 40)}</blockquote>", f"<div>{say(20, 60)}</div>", f"<p>{link()}, {link()}</p>"]
            + ["<ul>" + "".join(f"<li>{say(2, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>", f"<pre>{say(4, 20)}</pre>", "<ol>" + "".join(f"<li>{say(6, 30)}</li>" for _ in range(rng.randint(1, 4))) + "</ol>"]
            + ["<ul>" + "".join(f"<li>{link()}{pick(['', ' ' + say(1, 4)])}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"]
            + ["<table>" + "".join(f"<tr><td>{say(1, 4)}</td><td>{say(1, 5)}</td></tr>" for _ in range(3)) + "</table>", f"<figure><figcaption>{say(3, 12)}</figcaption></figure>", f"<dl><dt>{say(1, 3)}</dt><dd>{say(3, 20)}</dd></dl>"]
        )

    def article(shell):
        out = [pick([f"<h1>{say(2, 9)}</h1>", f"<h1>{say(2, 9)}</h1>", f"<h2>{say(2, 9)}</h2>", "", ""])]
        if shell == "article" and out[0] and rng.random() < 0.3:
            out = [f"<header>{out[0]}{pick(['', f'<p>{say(4, 20)}</p>'])}</header>"]
        few = rng.random() < 0.4
        out += [pick([f"<p>{say(4, 40)}</p>", f"<div>{say(4, 40)}</div>", say(2, 40), block()])] if few else [block() for _ in range(rng.randint(1, 12))]
        for what in ("ad", "share", "notice", "aside", "nav", "form", "comments"):
            if rng.random() < (0.03 if few else 0.12):
                out.insert(rng.randint(0, len(out)) if what != "comments" else len(out), outside(what))
        if shell == "article" and rng.random() < 0.15:
            out.append(f"<footer data-y=0>{pick([link() + ' ' + link(), say(2, 8), f'<p>{say(2, 8)}</p>'])}</footer>")
        return "".join(out)

    trees = []
    for _ in range(n):
        shell = pick(["article", "article", "article", "main", "main", "section", "div", "div", ""])
        name = names(CONTENT_NAMES) if shell in ("article", "main") else f' class="{pick(CONTENT_NAMES)}"'
        core = f"<{shell}{name} data-y=1>{article(shell)}</{shell}>" if shell else article(shell)
        if rng.random() < 0.35:
            wrap = pick(["main", "div", "section", "div"])
            core = f"<{wrap}{names(CONTENT_NAMES + ['container', 'wrapper', 'row', 'layout'])}>{core}{outside('aside') if rng.random() < 0.4 else ''}</{wrap}>"
        before = [outside(w) for w in ("nav", "header", "ad", "notice", "form", "aside") if rng.random() < 0.45]
        after = [outside(w) for w in ("footer", "comments", "aside", "ad", "share", "notice", "form", "nav") if rng.random() < 0.4]
        rng.shuffle(before)
        if rng.random() < 0.12:
            before, after = [], []
        page = f"<html><body>{''.join(before)}{core}{''.join(after)}</body></html>"
        nodes, _blocks = parse(say(3, 60) if rng.random() < 0.03 else page if rng.random() < 0.9 else page[12:-14])
        for node in nodes:
            mark = re.search(r"data-y=(\d)", node.attrs)
            node.y = int(mark[1]) if mark else (nodes[node.parent].y if node.parent >= 0 else -1)
            if node.y < 0 and not shell and (node.parent < 0 or node.parent == 0 or nodes[node.parent].tag == "body"):
                node.y = 1 if node.tag not in ("html", "body") else -1
        good = [0] * len(nodes)
        whole = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            # text right in the body or the page is the article's: what lies outside has elements of its own
            good[i] += nodes[i].own * (nodes[i].y != 0)
            whole[i] += nodes[i].own
            if nodes[i].parent >= 0:
                good[nodes[i].parent] += good[i]
                whole[nodes[i].parent] += whole[i]
        for i, node in enumerate(nodes):
            if node.y < 0:
                node.y = int(2 * good[i] > whole[i])
        trees.append(nodes)
    return trees


@lru_cache(maxsize=1)
def default_model():
    return fit(labelled_pages())


def main_text(page: str | None, model) -> str:
    if not page:
        return ""
    weight, edge = model
    nodes, blocks = parse(page)
    belief, _ = sum_product(nodes, [sum(weight.get(f, 0.0) for f in fs) for fs in features(nodes)], edge)
    return " ".join(text for i, text in blocks if belief[i] >= 0)


def _extract(shared, column: str):
    def run(batches):
        model = shared.value
        for part in pieces(batches, 1 << 20, column):
            texts = [main_text(x, model) for x in part.column(column).to_pylist()]
            keep = [part.column(c) for c in part.schema.names if c != column]
            names = [c for c in part.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return run


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model=None) -> DataFrame:
    """The kept columns, text and n_chars (code points) of every page."""
    spark = pages.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model or default_model())
    rows = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "__html")
    return rows.mapInArrow(_extract(shared, "__html"), f"{schema}, text string, n_chars long")


def op1_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
