"""Main-text extraction with a tree-structured graphical model over the DOM.

Each element is a node with a hidden label, content or not. A node's tag, attributes and own text give unary
potentials; a parent and a child share a pairwise potential that depends on the child's kind. Sum-product
messages, first up to the root and then down, give exact marginals; the weights are fitted on labelled pages
by the likelihood gradient (observed minus expected counts, both from the same messages).
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import task

# Element names by their role in HTML.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "select", "object", "canvas", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr acronym ruby rt rp".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
# Words in class, id and role attributes that speak for or against content, and words that say nothing.
AGAINST = "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar sidebar aside widget widgets cookie cookies consent gdpr notice notices alert modal popup overlay newsletter subscribe subscription signup login register form search share sharing social related recommended recommendations comment comments commentlist reply replies disqus respond toolbar tags pager pagination paging copyright legal skip skiplink contentinfo complementary dialog toc tracking teaser teasers trending colophon sharedaddy addthis outbrain taboola".split()
FOR = "article content contents main post entry story body text prose maincontent mainbody articlebody hentry".split()
GENERIC = "area list box wrap wrapper container section block bar links link widget buttons button inner outer group item items panel row col column site page top bottom left right main primary secondary global nav holder unit slot zone strip content thread the id js css mw gh el lg md sm xs posts count title body form js us our wp".split()
# What furniture says of itself, in the supplied tables' languages.
SAYS = (
    r"©|\(c\) ?\d{4}|\bcopyright\b|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|\bimpressum\b|privacy policy|terms of (?:use|service)",
    r"^\W*(?:share|tweet|like this|follow us|pin it|teilen|partager|compartir)\b|\b(?:facebook|twitter|whatsapp|linkedin|pinterest|reddit)\b",
    r"\bcookies?\b|\b(?:subscribe|newsletter|sign up|log ?in|abonnieren|s'abonner|suscríbete)\b|^\W*(?:advertisement|sponsored|anzeige|publicité|publicidad)\b",
    r"^\W*(?:\d+ )?(?:comments?|responses?|replies|reply|leave a (?:reply|comment)|post a comment|join the (?:discussion|conversation)|kommentare?|commentaires?|comentarios?)\b",
    r"^\W*(?:related|you (?:may|might) also like|more (?:from|stories|in)|recommended|read (?:more|next)|see also:? |most (?:read|popular)|trending|popular|recent posts|filed under|posted in|tagged|categories|tags?:)\b",
)
TAGS = ("p", "h1", "h2", "h3", "li", "ul", "ol", "a", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "span", "body", "html", "dl", "button", "h4", "details", "label", "address", "time")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(RAW)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|\bhidden\b|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")

_SAYS = tuple(re.compile(x, re.I) for x in SAYS)
_SAID = re.compile("|".join(f"(?:{x})" for x in SAYS), re.I)
#: Text of a node that phrases are looked for in: its beginning and its end, so that long prose costs nothing.
_HEARD = 160

OWN = 28  # features beside the tag
N_FEATURES = len(TAGS) + 1 + OWN
EDGE_KINDS = 4  # child is a paragraph, a container, an element that HTML sets apart from content, another


@dataclass
class Page:
    """The nodes of a page in document order and its text runs; node 0 is the page itself."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    named: list[tuple[int, int, int, int]] = field(default_factory=lambda: [(0, 0, 0, 0)])
    hidden: list[int] = field(default_factory=lambda: [0])
    label: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    stops: list[int] = field(default_factory=lambda: [0])
    says: list[int] = field(default_factory=lambda: [0])  # a bit for each of SAYS
    #: (block, node, text with entities): a block's runs are consecutive
    runs: list[tuple[int, int, str]] = field(default_factory=list)


_FOR, _AGAINST, _GENERIC = frozenset(FOR), frozenset(AGAINST), frozenset(GENERIC)
_LONG = tuple(sorted((w for w in AGAINST if len(w) > 4), key=len, reverse=True))


@lru_cache(maxsize=8192)
def _words(value: str) -> tuple[int, int, int, int]:
    """How names speak: plainly for, in part for, plainly against, in part against.

    A name does so plainly if all its words do, or the others say nothing (``comments-area``); in part if it has
    other words (``notice-board-history``) or is one run of letters that only begins so (``sharebox``).
    """
    out = [0, 0, 0, 0]
    for name in value.split():
        words = [w.lower() for w in _SPLIT.split(name) if w]
        for k, known in ((0, _FOR), (2, _AGAINST)):
            hits = [w in known for w in words]
            if any(hits):
                # what belongs to a post isn't the post (``post-footer``), but its header has the title
                neutral = _GENERIC if k == 0 or words[-1] == "header" else _GENERIC | _FOR
                plainly = all(h or w in neutral for h, w in zip(hits, words, strict=True)) and (k or not any(w in _AGAINST for w in words))
                out[k if plainly else k + 1] = 1
        if any(w not in _AGAINST and w.startswith(_LONG) for w in words):
            out[3] = 1
    return tuple(out)


def parse(text: str) -> Page:
    """The DOM as far as extraction needs it. Unclosed paragraphs and list items end where HTML ends them,
    formatting elements make no nodes unless their attributes speak, raw-text elements and comments vanish."""
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]  # element name, node
    block, at, links = 0, 0, 0

    def run(raw: str) -> None:
        if raw and not raw.isspace():
            node, n = stack[-1][1], len(raw)
            page.runs.append((block, node, raw))
            page.chars[node] += n
            page.linked[node] += n if links else 0
            page.stops[node] += raw.count(". ") + raw.count(", ") + raw.endswith(".")
            heard = raw.strip() if n <= 2 * _HEARD else raw[:48]
            if "&" in heard:
                heard = entities.unescape(heard)
            if _SAID.search(heard):
                for k, said in enumerate(_SAYS):
                    if said.search(heard):
                        page.says[node] |= 1 << k
        elif raw and page.runs:
            page.runs.append((block, stack[-1][1], " "))

    for m in _TOKEN.finditer(text):
        if m.start() > at:
            run(text[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            if m[1]:
                block += m[1].lower() not in INLINE
            continue
        name, closing, attrs = name.lower(), bool(m[2] or m[5]), m[4] if m[3] else m[7]
        inline = name in INLINE
        if closing:
            links -= name == "a" and links > 0
            if not inline:
                block += 1
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            # a stray inline end doesn't close blocks that opened after its start
            if k and (not inline or all(x[0] in INLINE for x in stack[k:])):
                del stack[k:]
            continue
        if name in VOID:
            if name == "br":
                run(" ")
            elif name == "hr":
                block += 1
            continue
        if name == "a":
            links = 1
        label = hide = 0
        named = (0, 0, 0, 0)
        if attrs:
            for a in _ATTRIBUTE.finditer(attrs):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "data-y":
                    label = int(value)
                else:
                    named = tuple(map(max, named, _words(value)))
            hide = int(bool(_HIDDEN.search(attrs)))
        if inline and not named[2] and not hide:
            continue
        if not inline:
            block += 1
            if name not in ("html", "body", "head") and stack[-1][0] in PARAGRAPH and (name in PARAGRAPH or stack[-1][0] == "p"):
                stack.pop()
            while len(stack) > 1 and stack[-1][0] in INLINE and name in PARAGRAPH:
                stack.pop()
            if len(stack) > 1 and stack[-1][0] == "p":
                stack.pop()
            closes = CLOSED_BY.get(name)
            if closes:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closes:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPES.get(name, ()):
                        break
        node = len(page.parent)
        page.parent.append(stack[-1][1])
        page.tag.append(name)
        page.named.append(named)
        page.hidden.append(hide)
        page.label.append(label)
        page.chars.append(0)
        page.linked.append(0)
        page.stops.append(0)
        page.says.append(0)
        if not attrs or not attrs.endswith("/"):
            stack.append((name, node))
    if at < len(text):
        run(text[at:])
    return page


_TAG_INDEX = {t: i for i, t in enumerate(TAGS)}


_APART = frozenset(("nav", "aside", "header", "footer", "form", "button", "label", "address", "details"))
_CONTAINER = frozenset(("div", "section", "article", "main", "ul", "ol", "dl", "table", "blockquote", "figure"))


def _context(page: Page) -> np.ndarray:
    """What a node's subtree, ancestors and elder siblings say of it, one row a node."""
    n = len(page.parent)
    parent, tag = page.parent, page.tag
    chars, linked, h1, paras = list(page.chars), list(page.linked), [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        h1[p] += h1[i] + (tag[i] == "h1")
        paras[p] += paras[i] + (tag[i] == "p" and page.chars[i] > 60)
    total = max(1, chars[0])
    inside, under, follows = [0] * n, [0] * n, [0] * n
    before, gone, titled, headed = [0] * n, [0] * n, [0] * n, [0] * n
    out = []
    seen = 0
    for i in range(n):
        p = parent[i]
        if p >= 0:
            inside[i] = inside[p] or tag[p] in ("article", "main")
            under[i] = under[p] or page.named[p][2] or tag[p] in _APART
            # a heading that announces comments or more to read speaks of all that follows it among its siblings
            follows[i] = headed[p] or follows[p]
            titled[i] = gone[p]
            gone[p] = gone[p] or h1[i] or tag[i] == "h1"
            if tag[i] in ("h2", "h3", "h4", "h5", "h6"):
                headed[p] = int(page.says[i] & 0b11000 > 0)
        before[i] = seen
        seen += page.chars[i]
        at = before[i] / total
        out.append((
            linked[i] / chars[i] if chars[i] else 0, min(log1p(chars[i]) / 9, 1.2), chars[i] / total, min(paras[i], 8) / 8, inside[i], under[i], follows[i],
            tag[i] in ("header", "footer") and inside[i], tag[i] == "header" and h1[i] > 0, at < 0.03, at > 0.97 and chars[i] / total < 0.1, titled[i], linked[i] > 0.6 * chars[i] > 0,
        ))
    return np.array(out, float)


def tensors(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, parents, depths and edge kinds of all nodes of several pages, as one forest."""
    sizes = [len(p.parent) for p in pages]
    base = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    cat = lambda name: np.array([v for p in pages for v in getattr(p, name)])
    parent = cat("parent")
    parent = np.where(parent < 0, -1, parent + base)
    tags = [t for p in pages for t in p.tag]
    kind = np.array([_TAG_INDEX.get(t, len(TAGS)) for t in tags])
    n = len(tags)
    x = np.zeros((n, N_FEATURES))
    x[np.arange(n), kind] = 1
    chars, linked, says = cat("chars").astype(float), cat("linked").astype(float), cat("says")
    k = len(TAGS) + 1
    x[:, k] = 1
    x[:, k + 1] = np.minimum(np.log1p(chars) / 5, 1.5)
    x[:, k + 2] = np.divide(linked, chars, out=np.zeros(n), where=chars > 0)
    x[:, k + 3] = np.minimum(cat("stops"), 6) / 6
    x[:, k + 4 : k + 8] = cat("named")
    x[:, k + 8] = cat("hidden")
    x[:, k + 9] = chars == 0
    x[:, k + 10] = (chars > 0) & (chars < 25)
    for j in range(3):
        x[:, k + 11 + j] = says >> j & 1
    x[:, k + 14] = (says & 0b11000) > 0
    x[:, k + 15 : k + 28] = np.concatenate([_context(p) for p in pages])
    edges = np.array([0 if t in PARAGRAPH else 1 if t in _CONTAINER else 2 if t in _APART else 3 for t in tags])
    # pre-order: a parent comes before its children, so one pass gives depths
    depth = np.zeros(n, np.int64)
    par = parent.tolist()
    d = depth.tolist()
    for i, p in enumerate(par):
        if p >= 0:
            d[i] = d[p] + 1
    return x, parent, np.array(d), edges


def _logsum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(unary: np.ndarray, parent: np.ndarray, depth: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on a forest: P(label = 1) of each node, and the joint of (parent, child) labels of each edge.

    ``unary`` is n x 2, ``pair`` n x 2 x 2 (parent label, child label), both logarithms. Messages go up from the
    deepest level to the roots, then down again; each level is one array step.
    """
    n = len(unary)
    up = unary.copy()  # unary plus the children's messages
    message = np.zeros((n, 2))
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)] if n and depth.max() < 64 else _by_level(depth)
    for level in reversed(levels[1:]):
        p = pair[level]
        message[level] = np.stack([_logsum(up[level, 0] + p[:, a, 0], up[level, 1] + p[:, a, 1]) for a in (0, 1)], axis=1)
        np.add.at(up, parent[level], message[level])
    down = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2))
    for level in levels[1:]:
        above = up[parent[level]] - message[level] + down[parent[level]]
        p = pair[level] + above[:, :, None]
        down[level] = _logsum(p[:, 0], p[:, 1])
        j = p + up[level][:, None, :]
        j -= _logsum(_logsum(j[:, 0, 0], j[:, 0, 1]), _logsum(j[:, 1, 0], j[:, 1, 1]))[:, None, None]
        joint[level] = np.exp(j)
    belief = up + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), joint


def _by_level(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray  # edge kind x parent label x child label

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """Content marginals of each page's nodes."""
        x, parent, depth, edges = tensors(pages)
        score = x @ self.weights
        p, _ = marginals(np.stack([-score / 2, score / 2], axis=1), parent, depth, self.pair[edges])
        return np.split(p, np.cumsum([len(q.parent) for q in pages])[:-1])


def fit(pages: list[Page], rounds: int = 200, rate: float = 0.15, penalty: float = 1e-4) -> Model:
    """Weights that make the pages' labels likely, by Adam on the exact likelihood gradient."""
    x, parent, depth, edges = tensors(pages)
    y = np.array([v for p in pages for v in p.label])
    inner = np.flatnonzero(parent >= 0)
    seen = np.zeros((EDGE_KINDS, 2, 2))
    np.add.at(seen, (edges[inner], y[parent[inner]], y[inner]), 1)
    w, pair = np.zeros(x.shape[1]), np.zeros((EDGE_KINDS, 2, 2))
    state = [np.zeros_like(a) for a in (w, pair, w, pair)]
    for t in range(1, rounds + 1):
        score = x @ w
        p, joint = marginals(np.stack([-score / 2, score / 2], axis=1), parent, depth, pair[edges])
        expected = np.zeros_like(seen)
        np.add.at(expected, edges[inner], joint[inner])
        grads = (x.T @ (y - p) / len(y) - penalty * w, (seen - expected) / len(y) - penalty * pair)
        for k, (value, g) in enumerate(zip((w, pair), grads, strict=True)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 2] = 0.99 * state[k + 2] + 0.01 * g * g
            value += rate * (state[k] / (1 - 0.9**t)) / (np.sqrt(state[k + 2] / (1 - 0.99**t)) + 1e-8)
    return Model(w, pair)


# ---------------------------------------------------------------- labelled pages


class _Invented:
    """One invented page in one of many layouts; ``data-y`` marks elements of the article.

    Names of elements are plain, compound, run together, opaque or, for some content, misleading, so that none of
    them decides alone; furniture says what it is, is set apart by its element, or is told by its links and place.
    """

    MARK = ' data-y="1"'

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.naming = rng.choices(("plain", "compound", "opaque"), (0.45, 0.4, 0.15))[0]

    def word(self) -> str:
        return "".join(self.rng.choice(("ta", "re", "mo", "lin", "es", "qua", "ber", "und", "ion", "é", "ost")) for _ in range(self.rng.randint(1, 4)))

    def sentence(self, n: int) -> str:
        words = [self.word() for _ in range(n)]
        return " ".join(words).capitalize().replace(" ", ", ", self.rng.random() < 0.3) + self.rng.choice((".", ".", ".", "", "!"))

    def prose(self, low: int = 1, high: int = 5) -> str:
        return " ".join(self.sentence(self.rng.choice((2, 5, 9, 14, 20))) for _ in range(self.rng.randint(low, high)))

    def link(self) -> str:
        return f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(self.rng.randint(1, 3)))}</a>'

    def opaque(self) -> str:
        return "".join(self.rng.choice("abcdefghkmnprstxz0123456789_") for _ in range(self.rng.randint(4, 8)))

    def name(self, words: tuple[str, ...]) -> str:
        rng, word = self.rng, self.rng.choice(words)
        if self.naming == "opaque":
            return f"{self.opaque()} {self.opaque()}" if rng.random() < 0.3 else f"css-{self.opaque()}"
        if self.naming == "compound" and rng.random() < 0.7:
            other = rng.choice(("site", "page", "main", "wp", "top", "js"))
            tail = rng.choice(("area", "list", "box", "wrap", "container", "section", "block", "bar", "inner"))
            return rng.choice((f"{word}-{tail}", f"{other}-{word}", f"{word}_{tail}", f"{other}{word.capitalize()}", f"{word}{tail}", f"{word} {self.word()}"))
        return word

    def wrapped(self, tags: tuple[str, ...], words: tuple[str, ...], body: str) -> str:
        tag = self.rng.choice(tags)
        must = tag in ("div", "section", "ul", "p", "span")
        attr = f' {self.rng.choice(("class", "id", "class", "role"))}="{self.name(words)}"' if must or self.rng.random() < 0.4 else ""
        return f"<{tag}{attr}>{body}</{tag}>"

    def links(self) -> str:
        items = [self.link() for _ in range(self.rng.randint(2, 8))]
        style = self.rng.random()
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if style < 0.6 else " | ".join(items) if style < 0.8 else "".join(f"<p>{x}</p>" for x in items)

    def any_text(self) -> str:
        x = self.prose(1, 3)
        style = self.rng.random()
        return x if style < 0.45 else f"<p>{x}</p>" if style < 0.75 else f"<h3>{self.sentence(3)}</h3><p>{x}</p>" if style < 0.9 else self.links()

    def said(self, *phrases: str, heading: bool = False) -> str:
        """What furniture calls itself; always where nothing else would tell."""
        if self.naming != "opaque" and self.rng.random() < 0.4:
            return ""
        x = self.rng.choice(phrases)
        tag = self.rng.choice(("h2", "h3", "h4") if heading else ("p", "span", "h3", "div", ""))
        return f"<{tag}>{x}</{tag}>" if tag else x + " "

    def comments(self) -> str:
        rng = self.rng

        def one() -> str:
            head = rng.choice(("", f"<b>{self.word()}</b> ", f'<div class="{self.name(("comment-author", "comment-meta"))}">{self.link()} {self.word()}</div>', f"<cite>{self.word()}</cite><time>{self.word()}</time>"))
            tail = rng.choice(("", "", f'<a href="#" class="reply">{self.word()}</a>'))
            return f"{head}<p>{self.prose(1, 3)}</p>" * rng.choice((1, 1, 2)) + tail

        head = self.said("Comments", "3 Comments", "2 responses", "Leave a Reply", "Join the discussion", "Kommentare", "Commentaires", "Comentarios", heading=True)
        listed = rng.random() < 0.4
        item = lambda: f'<li class="{self.name(("comment", "comment-item"))}">{one()}</li>' if listed else f'<div class="{self.name(("comment", "reply", "comment-body"))}">{one()}</div>'
        items = "".join(item() for _ in range(rng.choice((1, 2, 4, 15))))
        return self.wrapped(("section", "div", "div"), ("comments", "comment-list", "reader-comments", "respond", "comments-area", "disqus"), head + (f"<ol>{items}</ol>" if listed else items))

    def furniture(self, where: str) -> str:
        rng = self.rng
        make = {
            "nav": lambda: self.wrapped(("nav", "nav", "div", "ul"), ("nav", "menu", "main-menu", "navbar", "navigation", "breadcrumb"), self.links()),
            "header": lambda: self.wrapped(("header", "header", "div"), ("header", "site-header", "masthead", "banner", "topbar"), rng.choice(("", f"<h1>{self.sentence(3)}</h1>", f"<a href='/'>{self.sentence(2)}</a>", f"<p>{self.sentence(3)}</p>")) + (self.any_text() if rng.random() < 0.5 else self.links())),
            "ad": lambda: self.wrapped(("div", "div", "aside", "section", "p"), ("ad", "ads", "advert", "sponsored", "promo", "ad-box", "banner-ad"), self.said("Advertisement", "Sponsored", "Anzeige") + self.any_text()),
            "side": lambda: self.wrapped(("aside", "aside", "div"), ("sidebar", "widget", "related", "side-bar", "recommended"), self.said("Related posts", "You may also like", "Recent posts", "Most read", "Read more", heading=True) + self.any_text() + self.links() * (rng.random() < 0.5)),
            "notice": lambda: self.wrapped(("div", "section", "p"), ("cookie-notice", "notice", "consent", "gdpr", "alert", "newsletter", "popup", "subscribe"), self.said("We use cookies", "Subscribe to our newsletter", "Sign up") + self.any_text()),
            "form": lambda: self.wrapped(("form", "form", "div"), ("search", "signup-form", "login", "newsletter"), f"<label>{self.word()}</label><input><button>{self.word()}</button>" + f"<p>{self.prose(1, 2)}</p>" * (rng.random() < 0.4)),
            "comments": self.comments,
            "share": lambda: self.wrapped(("div", "ul", "p"), ("share", "social", "tags", "share-buttons", "sharedaddy", "sharing"), self.said("Share this", "Share", "Tweet", "Follow us", "Teilen") + self.links() * (rng.random() < 0.8)),
            "meta": lambda: self.wrapped(("footer", "div", "p"), ("tags", "related", "tags-links", "share"), self.said("Filed under", "Posted in", "Tagged", "Tags:") + self.links()),
            "footer": lambda: self.wrapped(("footer", "footer", "footer", "div"), ("footer", "site-footer", "copyright", "legal", "colophon"), (f"&copy; {self.word()} " if self.naming == "opaque" or rng.random() < 0.6 else "") + rng.choice(("", "All rights reserved. ")) + (self.any_text() if rng.random() < 0.6 else self.links())),
        }
        return make[where]()

    def unseen(self) -> str:
        """Text that isn't shown."""
        return f"<div {self.rng.choice(('hidden', 'style=' + chr(34) + 'display:none' + chr(34), 'aria-hidden=true', 'style=' + chr(34) + 'display: none;' + chr(34)))}>{self.any_text()}</div>"

    def misled(self) -> str:
        """A name whose words speak against content though it has other words too."""
        return f' class="{self.rng.choice(("notice", "tags", "comment", "menu", "header", "social", "search", "form", "related", "share"))}-{self.word()}{self.rng.choice(("", "-" + self.word()))}"' if self.rng.random() < 0.5 else ""

    def block(self, terse: bool) -> str:
        rng, mark = self.rng, self.MARK
        style = rng.random() * (0.3 if terse else 1)
        if style < 0.66:
            x = self.sentence(rng.choice((1, 2, 3))) if terse else self.prose(1, 6)
            x = f"<b>{x}<br>" if rng.random() < 0.2 else x.replace(" ", f" {self.link()} ", 1) if rng.random() < 0.2 else x
            return f"<p{mark}{self.misled() if rng.random() < 0.06 else ''}>{x}" + "</p>" * (rng.random() < 0.85)
        if style < 0.74:
            return f"<{(h := rng.choice(('h2', 'h2', 'h3', 'h4')))}{mark}>{self.sentence(rng.randint(1, 5))}</{h}>"
        if style < 0.82:
            listed = lambda: self.sentence(rng.randint(1, 9)) if rng.random() < 0.8 else f"{self.link()} {self.sentence(6)}"
            return f"<{(t := rng.choice(('ul', 'ol')))}{mark}>" + "".join(f"<li{mark}>{listed()}</li>" for _ in range(rng.randint(1, 6))) + f"</{t}>"
        if style < 0.86:
            return f"<blockquote{mark}><p{mark}>{self.prose(1, 2)}</p></blockquote>"
        if style < 0.89:
            return f"<pre{mark}>{self.prose(1, 2)}</pre>"
        if style < 0.92:
            return f"<table{mark}>" + "".join(f"<tr{mark}><td{mark}>{self.sentence(2)}</td><td{mark}>{self.sentence(3)}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>"
        if style < 0.95:
            return f"<figure{mark}><img><figcaption{mark}>{self.sentence(4)}</figcaption></figure>"
        return f"<div{mark}{self.misled() if rng.random() < 0.1 else ''}>{self.prose(1, 3)}</div>"

    def content(self) -> str:
        rng, mark = self.rng, self.MARK
        parts = []
        if rng.random() < 0.85:
            title = f"<h1{mark}>{self.sentence(rng.randint(1, 9))}</h1>"
            if rng.random() < 0.35:
                by = rng.choice(("", f"<p{mark}>{self.sentence(4)}</p>", f'<p class="byline"{mark}>By {self.word()}</p>', f'<div class="entry-meta"{mark}><time{mark}>{self.word()}</time> {self.word()}</div>'))
                title = f"<header{rng.choice(('', ' class=entry-header', ' class=post-header'))}{mark}>{title}{by}</header>"
            parts.append(title)
            if rng.random() < 0.12:
                parts.append(self.furniture("share"))
        terse = rng.random() < 0.3
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 8, 20, 60))):
            x = self.block(terse)
            if rng.random() < 0.06:
                x = f"<section{mark}><h2{mark}>{self.sentence(3)}</h2>{x}{self.block(terse)}</section>"
            parts.append(x)
            if rng.random() < 0.07:
                parts.append(self.furniture(rng.choice(("ad", "share", "notice", "form", "side"))))
        if rng.random() < 0.25:
            parts = [f"<div{mark}{rng.choice(('', self.misled(), f' class={chr(34)}{self.name(('entry-content', 'content', 'post-body', 'text'))}{chr(34)}'))}>{''.join(parts)}</div>"]
        for where, chance in (("meta", 0.15), ("share", 0.2), ("side", 0.12), ("comments", 0.2)):
            if rng.random() < chance:
                parts.append(self.furniture(where))
        body = "".join(parts)
        kind = rng.random()
        if kind < 0.5:
            body = f'<article{mark}{rng.choice(("", "", f" class={chr(34)}post{chr(34)}", f" id={chr(34)}post-{rng.randrange(999)}{chr(34)}"))}>{body}</article>'
        elif kind < 0.68:
            body = f"<main{mark}>{body}</main>"
        elif kind < 0.95:
            named = self.name(("content", "main-content", "post", "entry-content", "story", "article-body", "text", "post-body"))
            body = f'<{(t := rng.choice(("div", "section")))}{mark}{self.misled() if rng.random() < 0.08 else f" {rng.choice(('class', 'id'))}={chr(34)}{named}{chr(34)}"}>{body}</{t}>'
        if rng.random() < 0.15:
            body = f"<main{mark}>{body}</main>"
        return body

    def page(self) -> str:
        rng = self.rng
        before = "".join(self.furniture(k) for k in ("nav", "header", "ad", "notice", "side", "form") if rng.random() < 0.4)
        after = "".join(self.furniture(k) for k in ("share", "ad", "side", "comments", "form", "notice", "footer") if rng.random() < 0.4)
        page = before + self.content() + (self.unseen() if rng.random() < 0.12 else "") + after
        for _ in range(rng.choice((0, 0, 1, 2))):
            page = f'<div id="{rng.choice(("wrapper", "page", "container", self.opaque()))}">{page}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.word()}</title></head><body>{page}</body></html>"


def labelled_page(rng: random.Random) -> str:
    """An invented page; ``data-y`` marks elements of the article."""
    return _Invented(rng).page()


@lru_cache(maxsize=1)
def trained(pages: int = 900, seed: int = 5) -> Model:
    """The model, fitted on ``pages`` invented labelled pages; the same on every machine up to rounding."""
    rng = random.Random(seed)
    return fit([parse(labelled_page(rng)) for _ in range(pages)])


# ---------------------------------------------------------------- text


def main_text(page: Page, p: np.ndarray, threshold: float = 0.5) -> str:
    """Blocks of the runs whose node is content, white space squeezed, joined by an empty line."""
    blocks: list[str] = []
    keep = (p > threshold).tolist()
    last, own = -1, []
    for block, node, raw in page.runs:
        if block != last:
            if own:
                blocks.append("".join(own))
            last, own = block, []
        if keep[node]:
            own.append(raw)
    if own:
        blocks.append("".join(own))
    done = (_SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return "\n\n".join(b for b in done if b)


def extract_texts(sources: list[str | None], model: Model) -> list[str]:
    pages = [parse(s or "") for s in sources]
    return [main_text(page, p) for page, p in zip(pages, model.content(pages), strict=True)] if pages else []


#: Characters of html that one step parses; a longer page is a step of its own.
STEP = 2_000_000


@task("extract")
def _extract(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html = batch.column(2).to_pylist()
        at = 0
        while at < len(html):
            end, size = at, 0
            while end < len(html) and end - at < 256 and (end == at or size + len(html[end] or "") <= STEP):
                size += len(html[end] or "")
                end += 1
            texts = extract_texts(html[at:end], model)
            part = batch.slice(at, end - at)
            at = end
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(df: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null or empty html, and a page where nothing is content, give the empty text; null ids and urls pass
    through; repeated rows are repeated; a marginal of exactly one half isn't content; an empty table gives no
    rows; other columns are ignored; a page of any length is parsed whole. Narrow: no shuffle; the model is under a
    kilobyte.
    """
    model = model or trained()
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(lambda it: _extract(it, model), "page_id long, url string, text string, n_chars long")
