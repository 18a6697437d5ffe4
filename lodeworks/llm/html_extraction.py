"""Main text of web pages: boosted trees over DOM nodes, then a hierarchical decoding of keep and drop."""

from __future__ import annotations

import html
import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices

#: Fixed sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that are blocks of their own; all others, unknown ones too, are part of the text around them.
BLOCK = CLOSES_P | frozenset("html head body li dt dd tr td th thead tbody tfoot caption figcaption summary legend button select optgroup option input dialog link meta base".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("table ul ol dl div article section body html td th li".split())
#: Never text of an article.
NEVER = frozenset("form button select option input textarea head".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "words", "text", "links", "depth", "runs", "commas", "place")

    def __init__(self, tag: str, parent: "Node | None", words: tuple[str, ...] = ()):
        self.tag, self.parent, self.words, self.children = tag, parent, words, []
        self.depth = parent.depth + 1 if parent else 0
        self.runs: list = []  # own text pieces and children, in page order
        self.text = self.links = self.commas = 0
        if parent:
            parent.children.append(self)
            parent.runs.append(self)


def parse(page: str) -> Node:
    """The block nodes of a page; inline elements only add their text to the block around them."""
    root = Node("#", None)
    at, pos, anchors, end = root, 0, 0, len(page)
    lowered = None

    def say(text: str) -> None:
        at.runs.append(text)
        n = len(text)
        at.text += n
        at.commas += text.count(",") + text.count(".")
        if anchors:
            at.links += n

    while pos < end:
        m = TOKEN.search(page, pos)
        if not m:
            say(page[pos:])
            break
        if m.start() > pos:
            say(page[pos : m.start()])
        pos = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if closing:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in BLOCK or "-" in tag:
                up = at
                while up is not root and up.tag != tag:
                    if tag == "p" and up.tag in BARRIER:
                        up = root
                        break
                    up = up.parent
                if up is not root:
                    at, anchors = up.parent, 0
            continue
        if tag in RAW:
            lowered = page.lower() if lowered is None else lowered
            stop = lowered.find("</" + tag, pos)
            pos = end if stop < 0 else stop
            continue
        if tag not in BLOCK and "-" not in tag:
            if tag == "a":
                anchors += 1
            elif tag == "br":
                at.runs.append(" ")
            continue
        if tag in CLOSES_P and at.tag == "p":
            at, anchors = at.parent, 0
        shut = CLOSES.get(tag)
        if shut:
            up = at
            while up is not root and up.tag not in shut and up.tag not in ("ul", "ol", "dl", "table", "select"):
                up = up.parent
            if up.tag in shut:
                at, anchors = up.parent, 0
        words: tuple[str, ...] = ()
        if "=" in attributes:
            words = tuple(w.lower() for a in ATTRIBUTE.findall(attributes) for w in SPLIT.split(a[0] or a[1] or a[2]) if w)
        node = Node(tag, at, words)
        if tag not in VOID:
            at = node
    return root


def walk(root: Node) -> list[Node]:
    """Nodes, each before its children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.place = len(out)
        out.append(node)
        todo.extend(reversed(node.children))
    return out


TAGS = ("p", "li", "ul", "ol", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "table", "td", "h1", "h2", "h3", "blockquote", "pre", "body", "html", "figure", "dl")
#: Attribute tokens are features by name where known, else by one of BUCKETS hash buckets.
HINTS = (
    "nav", "menu", "header", "footer", "sidebar", "aside", "ad", "ads", "advert", "banner", "cookie", "notice", "promo", "sponsor",
    "comment", "comments", "reply", "related", "share", "social", "breadcrumb", "form", "newsletter", "login", "popup",
    "article", "content", "post", "entry", "main", "body", "story", "text", "page",
)
COUNTS, BUCKETS = 16, 16
WORDS = len(HINTS) + BUCKETS
WIDTH = COUNTS + len(TAGS) + 2 * WORDS


#: Tags that say what their box is for; they count as attribute tokens, so that what is below them knows of them.
NAMED = frozenset("nav header footer aside article main form".split())
TAG_AT = {t: COUNTS + i for i, t in enumerate(TAGS)}
HINT_AT = {w: COUNTS + len(TAGS) + i for i, w in enumerate(HINTS)}


def token_place(word: str) -> int:
    """The feature of an attribute token."""
    at = HINT_AT.get(word)
    return COUNTS + len(TAGS) + len(HINTS) + zlib.crc32(word.encode()) % BUCKETS if at is None else at


def features(nodes: list[Node]) -> np.ndarray:
    """Subtree sizes and densities, depth, siblings, tags, attribute tokens of the node and of those above it."""
    n = len(nodes)
    text, links, commas = [x.text for x in nodes], [x.links for x in nodes], [x.commas for x in nodes]
    tags, paras = [1] * n, [int(x.tag == "p") for x in nodes]
    up = [x.parent.place if x.parent else 0 for x in nodes]
    for k in range(n - 1, 0, -1):
        u = up[k]
        text[u] += text[k]
        links[u] += links[k]
        commas[u] += commas[k]
        tags[u] += tags[k]
        paras[u] += paras[k]
    alike: dict[tuple[int, str], int] = {}
    for k, node in enumerate(nodes):
        alike[up[k], node.tag] = alike.get((up[k], node.tag), 0) + 1
    told = ((text[k], x.text, links[k], commas[k], tags[k], paras[k], x.depth, len(x.children), alike[up[k], x.tag]) for k, x in enumerate(nodes))
    raw = np.array(list(told), np.float32)
    u = np.array(up)
    size, mine, linked, marks, count, para, depth, kids, same = raw.T
    x = np.zeros((n, WIDTH), np.float32)
    ones, around = np.maximum(1, size), np.maximum(1, kids[u])
    sizes = [np.log1p(size), np.log1p(mine), linked / ones, size / count, size / ones[0], marks / ones, depth]
    family = [around, same / around, count, para, kids, size / ones[u], np.log1p(size[u]), (linked / ones)[u], para[u]]
    x[:, :COUNTS] = np.column_stack(sizes + family)
    for k, node in enumerate(nodes):
        at = TAG_AT.get(node.tag)
        if at:
            x[k, at] = 1
        for w in (*node.words, node.tag) if node.tag in NAMED else node.words:
            x[k, token_place(w)] = 1
    own, above = slice(COUNTS + len(TAGS), COUNTS + len(TAGS) + WORDS), slice(WIDTH - WORDS, WIDTH)
    if x[:, own].any():
        for k in range(1, n):
            np.maximum(x[up[k], own], x[up[k], above], out=x[k, above])
    return x


@dataclass
class Trees:
    """Gradient boosted trees of one depth: per level and node a feature and a cut, values in the leaves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1]))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0) -> Trees:
    """Newton boosting with quantile histograms of all features at once."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    used = [j for j, e in enumerate(edges) if len(e)]
    place = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") + bins * k for k, j in enumerate(used)])
    base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    f, inner = np.full(len(y), base), 2**depth - 1
    feature, cuts, leaves = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1))

    def upto(rows: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Sums of value over the rows up to each bin of each feature."""
        sums = np.bincount(place[rows].ravel(), np.repeat(value[rows], len(used)), bins * len(used))
        return np.cumsum(sums.reshape(len(used), bins), axis=1)

    for t in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            here = np.flatnonzero(at == node)
            if len(here) > 10:
                gs, hs, G, H = upto(here, g), upto(here, h), g[here].sum(), h[here].sum()
                gain = gs**2 / (hs + ridge) + (G - gs) ** 2 / (H - hs + ridge) - G**2 / (H + ridge)
                j, k = divmod(int(gain.argmax()), bins)
                if gain[j, k] > 1e-6 and k < len(edges[used[j]]):
                    feature[t, node], cuts[t, node] = used[j], edges[used[j]][k]
            at[here] = 2 * node + 1 + (x[here, feature[t, node]] > cuts[t, node])
        at -= inner
        for k in range(inner + 1):
            here = at == k
            leaves[t, k] = rate * g[here].sum() / (h[here].sum() + ridge)
        f += leaves[t, at]
    return Trees(base, feature, cuts, leaves)


def sample_page(rnd: random.Random) -> tuple[str, set[str]]:
    """An invented page, and the marks that stand in the blocks of its article. Every text block carries a mark of its own."""
    marks, kept = iter(range(10_000)), set()

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéäñ") for _ in range(rnd.randint(2, 9))) + rnd.choice(["", "", "", "", ",", "."]) for _ in range(rnd.randint(lo, hi)))

    def block(lo: int, hi: int, keep: bool = False) -> str:
        mark = f"m{next(marks)}q"
        if keep:
            kept.add(mark)
        return f"{mark} {words(lo, hi)}"

    def links(lo: int, hi: int) -> str:
        return "".join(f'<li><a href="/x">{block(1, 4)}</a></li>' for _ in range(rnd.randint(lo, hi)))

    def box(tag: str, names: str, body: str) -> str:
        """The tag itself, or a div or section that only its class or id names; sometimes a bare tag."""
        if rnd.random() < 0.6:
            return f"<{tag}>{body}</{tag}>"
        t = rnd.choice(["div", "section", tag])
        return f'<{t} {rnd.choice(["class", "id"])}="{noise(rnd.choice(names.split()))}">{body}</{t}>'

    def noise(names: str) -> str:
        """names, at times among tokens that say nothing."""
        more = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(rnd.choice([0, 0, 1, 2]))]
        return " ".join(rnd.sample([names, *more], len(more) + 1))

    def junk() -> str:
        kind = rnd.randrange(8)
        if kind == 0:
            return box("nav", "nav menu navbar breadcrumb", f"<ul>{links(2, 9)}</ul>")
        if kind == 1:
            return f'<div class="{rnd.choice(["ad", "ads", "advert", "banner", "promo", "sponsor ad"])}">{block(2, 40)}</div>'
        if kind == 2:
            return box("aside", "sidebar aside related", f"<h3>{block(1, 4)}</h3>" + rnd.choice([f"<ul>{links(2, 8)}</ul>", f"<p>{block(5, 40)}</p>"]))
        if kind == 3:
            return f'<div class="{rnd.choice(["cookie", "cookie-notice", "notice", "newsletter", "popup", "login"])}"><p>{block(4, 40)}</p><button>{block(1, 2)}</button></div>'
        if kind == 4:
            return box("section", "comments comment reply", "".join(f'<div class="comment"><p>{block(3, 60)}</p></div>' for _ in range(rnd.randint(1, 5))))
        if kind == 5:
            return f"<form><label>{block(1, 3)}</label><input><p>{block(2, 9)}</p></form>"
        if kind == 6:
            return f'<div class="{rnd.choice(["share", "social", "related"])}"><ul>{links(2, 5)}</ul></div>'
        return f"<p><a href='/y'>{block(1, 6)}</a></p>"

    def prose() -> str:
        kind = rnd.randrange(12)
        if kind == 0:
            return f"<ul>{''.join(f'<li>{block(2, 25, True)}</li>' for _ in range(rnd.randint(2, 5)))}</ul>"
        if kind == 1:
            return f"<blockquote><p>{block(5, 40, True)}</p></blockquote>"
        if kind == 2:
            return f"<h2>{block(1, 6, True)}</h2>"
        if kind == 3:
            return f"<table><tr><td>{block(1, 5, True)}</td><td>{block(1, 5, True)}</td></tr></table>"
        if kind == 4:
            return f"<p><b>{block(1, rnd.choice([4, 80]), True)}<br>"
        if kind == 5:
            return f"<p>{block(2, 20, True)} <a href='/z'>{words(1, 3)}</a> {words(2, 60)}</p>"
        return f"<p>{block(1, rnd.choice([4, 40, 150]), True)}</p>"

    head = rnd.randrange(3)
    body = ["" if head == 2 else f"<h1>{block(2, 12, True)}</h1>"]
    if head == 1:
        body = [f"<header>{body[0]}</header>"]
    for _ in range(rnd.randint(1, 9) if rnd.random() < 0.6 else 1):
        body.append(prose())
        if rnd.random() < 0.08:
            body.append(f'<div class="{rnd.choice(["ad", "advert", "promo", "related", "share"])}">{block(2, 20)}</div>')
    inner = "".join(body)
    case = rnd.random()
    if case < 0.5:
        inner = f"<article>{inner}</article>"
    elif case < 0.65:
        inner = f"<main>{inner}</main>"
    elif case < 0.95:
        inner = f'<div {rnd.choice(["class", "id"])}="{noise(rnd.choice(["article", "content", "post", "entry", "main", "story", "post-body", "entry-content", "page-content"]))}">{inner}</div>'
    before = [box("header", "header banner", f"<p>{block(1, 6)}</p>")] * (rnd.random() < 0.4) + [box("nav", "nav menu navigation", f"<ul>{links(2, 9)}</ul>")] * (rnd.random() < 0.8)
    after = [box("footer", "footer bottom-footer", rnd.choice([f"&copy; {block(2, 25)}", f"<p>{block(2, 25)}</p>"]))] * (rnd.random() < 0.85)
    extra = [junk() for _ in range(rnd.randint(0, 4))]
    cut = rnd.randint(0, len(extra))
    return "<html><head><title>t</title></head><body>" + "".join(before + extra[:cut] + [inner] + extra[cut:] + after), kept


@lru_cache(maxsize=2)
def train(pages: int = 600, seed: int = 3) -> Trees:
    """Trees fitted on invented pages, a documented and fixed sample: the table has no marked pages to learn from. What they tell of
    a node is whether all of its text is of the article."""
    rnd, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page, kept = sample_page(rnd)
        nodes = walk(parse(page))
        good = {}
        for node in reversed(nodes):
            own = set(re.findall(r"m\d+q", " ".join(r for r in node.runs if isinstance(r, str))))
            a, b = len(own & kept), len(own)
            for c in node.children:
                a, b = a + good[id(c)][0], b + good[id(c)][1]
            good[id(node)] = (a, b)
        with_text = [k for k, node in enumerate(nodes) if good[id(node)][1]]
        xs.append(features(nodes)[with_text])
        ys.append(np.array([good[id(nodes[k])][0] == good[id(nodes[k])][1] for k in with_text], float))
    return boost(np.concatenate(xs), np.concatenate(ys))


OPEN, IN, OUT = 0, 1, 2
#: Log odds that a part of an article isn't of it.
LEAVE = -4.5


def decode(nodes: list[Node], logits: np.ndarray) -> list[int]:
    """The best states of all nodes: OPEN above the article, IN the article, OUT elsewhere. Below OUT all is OUT; below IN there is
    IN or, at a price, OUT; only OPEN has any below it, and counts as not of the article, as its own text isn't. So no dropped node has a kept one below
    it, and the article's parts stand together unless their own evidence is strong."""
    kept, lost = (-np.logaddexp(0, -logits)).tolist(), (-np.logaddexp(0, logits)).tolist()
    n = len(nodes)
    opened, inside, out = [0.0] * n, [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        node = nodes[k]
        o, i, x = lost[k], kept[k], lost[k]
        if node.tag in NEVER:
            o = i = -1e9
        for c in node.children:
            j = c.place
            o += max(opened[j], inside[j], out[j])
            i += max(inside[j], out[j] + LEAVE)
            x += out[j]
        opened[k], inside[k], out[k] = o, i, x
    state = [OPEN] * n
    for k, node in enumerate(nodes):
        above = state[node.parent.place] if node.parent else OPEN
        if above == OUT:
            state[k] = OUT
        elif above == IN:
            state[k] = IN if inside[k] >= out[k] + LEAVE else OUT
        else:
            best = max(opened[k], inside[k], out[k])
            state[k] = IN if inside[k] == best else OUT if out[k] == best else OPEN
    return state


def blocks(nodes: list[Node], state: list[int]) -> str:
    """Kept text in page order: white space inside a block is one space, blocks stand two line ends apart."""
    out: list[str] = []
    stack: list[tuple[Node, int]] = [(nodes[0], 0)]
    now: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(now))).strip()
        now.clear()
        if text:
            out.append(text)

    while stack:
        node, i = stack.pop()
        if i == len(node.runs):
            flush()
            continue
        run = node.runs[i]
        stack.append((node, i + 1))
        if isinstance(run, str):
            if state[node.place] == IN:
                now.append(run)
        else:
            flush()
            stack.append((run, 0))
    return "\n\n".join(out)


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Null and empty html give an empty text; any length is read whole; rows that
    repeat give the same text each; markup that is broken or cut off is read as far as it goes."""
    trees = trees or train()

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "html", 2 << 20):
                parsed = [walk(parse(h)) if h else [] for h in part.column("html").to_pylist()]
                sizes = [len(p) for p in parsed]
                xs = [features(p) for p in parsed if p]
                logits = trees.logits(np.concatenate(xs)) if xs else np.zeros(0)
                texts, at = [], 0
                for p, n in zip(parsed, sizes, strict=True):
                    texts.append(blocks(p, decode(p, logits[at : at + n])) if n else "")
                    at += n
                told = [part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string())]
                cols = [*told, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
