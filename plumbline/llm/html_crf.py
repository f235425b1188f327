"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between the starts and ends of block elements, inline elements
inside. A block has binary features of its ancestors (tags, and the stems that their class, id and role
hold), of its text (length, links, punctuation) and of its place. The field scores each block as article or
not and each step from block to block; Viterbi finds the best labelling, and the article's blocks are joined
in page order.

The field is trained here, by gradient ascent on the penalised likelihood, on labelled pages: at most
``MAX_TRAINING_PAGES`` (HTML, one label per block). ``labelled_pages`` makes such a set from page layouts;
any other labelled pages can be given instead. Pages are decoded one by one inside Arrow batches.

Edge cases: null or empty HTML, or a page without article blocks, gives an empty text; unclosed elements end
with their parent; an unfinished tag or comment at the end is markup; repeated rows stay; columns besides
the three are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: More labelled pages than this are refused: training runs on the driver.
MAX_TRAINING_PAGES = 5000
# A quoted value after = may hold >; a quote that never closes is a character like others.
_REST = r"""(?>=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)(?=[\s/>])" + _REST + r"(?:>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)|\Z)|</?[a-zA-Z]" + _REST + r"(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I
)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
NAMING = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# HTML's block elements and elements without content (fixed values of the format).
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " label legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of a family ends an open one of its family, unless a holder stands between.
FAMILIES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol menu dl table select body".split())
#: What class, id and role names are searched for.
STEMS = (
    "ad ads advert sponsor promo banner nav menu breadcrumb sidebar widget footer header masthead topbar cookie consent notice gdpr alert popup modal form search login subscribe newsletter"
    " comment reply discuss respond share social related recommend tag copyright legal content article post entry story main body text page skip toolbar pagination meta author"
).split()


#: Elements of running text; a block belongs to the nearest element around its own that is none of them.
FLOW = frozenset("blockquote center dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li ol p pre table tbody tfoot thead tr ul".split())


class Place:
    """An open element, with what its descendants take over from it: each set holds a few dozen names at most, however
    deep the element lies, and is shared with the parent where nothing is new."""

    __slots__ = ("tag", "block", "above", "core", "nearest", "container", "outer")

    def __init__(self, parent: Place | None, tag: str, names: str):
        self.tag, self.block = tag, tag in BLOCK
        stems = _stems(names) if names else ()
        own = [f"stem:{s}" for s in stems] + ([f"in:{tag}"] if self.block else [])
        self.above = _joined(parent.above if parent else frozenset(), own)
        if tag in ("article", "main"):
            self.core = frozenset(("core",))
        else:
            self.core = parent.core if parent else None
            if self.core is not None:
                self.core = _joined(self.core, [f"core>{x}" for x in stems] + ([f"core>{tag}"] if self.block else []))
        nearest = parent.nearest if parent else ()
        self.nearest = ((tag, stems), *nearest[:2]) if self.block else nearest
        around = parent.container if parent else None
        # What the own text belongs to, and what the blocks inside belong to.
        self.outer = around if self.block or not parent else parent.outer
        self.container = object() if self.block and tag not in FLOW else around

    def features(self) -> tuple[str, ...]:
        return _place_features(self.above, self.core, self.nearest)


def _joined(known: frozenset[str], more: list[str]) -> frozenset[str]:
    return known if known.issuperset(more) else known.union(more)


@functools.lru_cache(maxsize=20_000)
def _stems(names: str) -> tuple[str, ...]:
    """Stems in class, id and role names; short ones only as words of their own."""
    return tuple(dict.fromkeys(s for word in re.findall("[a-z]+", names) for s in STEMS if word == s or (len(s) > 3 and s in word)))


@functools.lru_cache(maxsize=20_000)
def _place_features(above: frozenset[str], core: frozenset[str] | None, nearest: tuple) -> tuple[str, ...]:
    out = {"bias", *above, *(core or ()), f"own:{nearest[0][0] if nearest else '-'}"}
    for k, (tag, stems) in enumerate(nearest):
        out.add(f"up{k}:{tag}")
        out.update(f"up{k}:stem:{s}" for s in stems)
    return tuple(sorted(out))


@dataclass
class Block:
    text: str
    place: Place
    link_share: float


class _Stack:
    """The open elements; for each tag also where it is open, so that no step walks over elements that stay open."""

    def __init__(self):
        self.open: list[Place] = []
        self.at: dict[str, list[int]] = {}
        self.holders: list[int] = []
        self.blocks: list[int] = []

    def push(self, tag: str, names: str) -> None:
        k = len(self.open)
        self.open.append(Place(self.open[-1] if self.open else None, tag, names))
        self.at.setdefault(tag, []).append(k)
        if tag in HOLDERS:
            self.holders.append(k)
        if tag in BLOCK:
            self.blocks.append(k)

    def cut(self, index: int) -> None:
        for place in reversed(self.open[index:]):
            self.at[place.tag].pop()
        del self.open[index:]
        for known in (self.holders, self.blocks):
            while known and known[-1] >= index:
                known.pop()

    def last(self, tag: str) -> int:
        known = self.at.get(tag)
        return known[-1] if known else -1

    def first_after(self, tag: str, index: int) -> int | None:
        known = self.at.get(tag, ())
        k = bisect.bisect_right(known, index)
        return known[k] if k < len(known) else None


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order; character references decoded, white space runs as one space.

    Takes time in proportion to the page, however deep its elements lie.
    """
    blocks: list[Block] = []
    stack = _Stack()
    nowhere = Place(None, "", "")
    parts: list[str] = []
    linked = at = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if stack.at.get("a"):
            linked += len(text)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, stack.open[-1] if stack.open else nowhere, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def close(index: int) -> None:
        """End all elements from ``index`` on."""
        if stack.blocks and stack.blocks[-1] >= index:
            flush()
        stack.cut(index)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        token = m[0]
        named = NAME.match(token)
        if m[1] or not named:
            continue
        tag = named[1].lower()
        if token[1] == "/":
            found = stack.last(tag)
            if found >= 0:
                close(found)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK:
            holder = stack.holders[-1] if stack.holders else -1
            if stack.last("p") > max(holder, stack.last("button")):
                close(stack.last("p"))
            inside = [k for k in (stack.first_after(f, holder) for f in FAMILIES.get(tag, ())) if k is not None]
            if inside:
                close(min(inside))
            flush()
        if tag not in VOID and not token.endswith("/>"):
            names = " ".join(a or b or c for a, b, c in NAMING.findall(token)).lower() if "=" in token else ""
            stack.push(tag, names)
    if at < len(page):
        add(page[at:])
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    weight: dict[int, float] = {}
    for b in blocks:
        weight[id(b.place.outer)] = weight.get(id(b.place.outer), 0.0) + len(b.text) * (1 - b.link_share)
    whole, most = sum(weight.values()) or 1.0, max(weight.values(), default=0.0)
    out = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        own = [*b.place.features()]
        mass = weight[id(b.place.outer)]
        own.append(f"mass:{int(mass / whole * 3.99)}")
        if mass == most:
            own.append("top")
        own.append(f"len:{min(6, n.bit_length() // 2)}")
        own.append(f"link:{int(b.link_share * 3.99)}")
        if b.text[-1] in ".!?:;…\"”»":
            own.append("stop")
        if "©" in b.text or "®" in b.text:
            own.append("rights")
        own.append(f"commas:{min(3, b.text.count(','))}")
        label, colon, rest = b.text.partition(": ")
        if colon and " " not in label and n < 80:
            own.append("labelled stop" if "stop" in own else "labelled")
        if i == 0:
            own.append("first")
        if i == len(blocks) - 1:
            own.append("last")
        out.append(own)
    return out


class Field:
    """A trained field: a weight per feature (for the label article) and the steps' scores."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, steps: np.ndarray, start: np.ndarray):
        self.weights = {f: float(weights[i]) for f, i in index.items()}
        self.steps, self.start = steps.tolist(), start.tolist()

    def decode(self, found: list[list[str]]) -> list[int]:
        """Viterbi: the labelling of the largest score."""
        if not found:
            return []
        weights, (t0, t1) = self.weights, self.steps
        back: list[tuple[int, int]] = []
        a, b = self.start[0], self.start[1] + sum(weights.get(f, 0.0) for f in found[0])
        for own in found[1:]:
            x0, x1 = a + t0[0], b + t1[0]
            y0, y1 = a + t0[1], b + t1[1]
            back.append((int(x1 > x0), int(y1 > y0)))
            a, b = max(x0, x1), max(y0, y1) + sum(weights.get(f, 0.0) for f in own)
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def extract(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        return "\n".join(b.text for b, y in zip(blocks, self.decode(features(blocks)), strict=True) if y)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Prepared:
    """Labelled pages side by side, padded and masked: what does not depend on the parameters."""

    def __init__(self, pages: list[tuple[list[np.ndarray], np.ndarray]]):
        self.sizes = np.array([len(y) for _, y in pages])
        self.n, self.most = len(pages), int(self.sizes.max())
        self.flat = np.concatenate([f for own, _ in pages for f in own])
        places = np.concatenate([p * self.most + np.arange(len(own)) for p, (own, _) in enumerate(pages)])
        self.owner = np.repeat(places, [len(f) for own, _ in pages for f in own])
        self.live = np.arange(self.most) < self.sizes[:, None]
        self.truth = np.zeros((self.n, self.most), int)
        for p, (_, y) in enumerate(pages):
            self.truth[p, : len(y)] = y
        both = self.live[:, 1:]
        self.seen = np.zeros((2, 2))
        np.add.at(self.seen, (self.truth[:, :-1][both], self.truth[:, 1:][both]), 1)


def likelihood(params: np.ndarray, pages: Prepared | list[tuple[list[np.ndarray], np.ndarray]], n: int) -> tuple[float, np.ndarray]:
    """Log likelihood of the labels and its gradient; ``params``: n weights, 4 step scores, 2 start scores."""
    d = pages if isinstance(pages, Prepared) else Prepared(pages)
    w, steps, start = params[:n], params[n : n + 4].reshape(2, 2), params[n + 4 :]
    live, most = d.live, d.most
    score = np.zeros((d.n * most, 2))
    score[:, 1] = np.bincount(d.owner, w[d.flat], d.n * most)
    score = score.reshape(d.n, most, 2)
    ahead = np.zeros_like(score)
    ahead[:, 0] = score[:, 0] + start
    for t in range(1, most):
        new = _log_sum(ahead[:, t - 1, :, None] + steps, 1) + score[:, t]
        ahead[:, t] = np.where(live[:, t, None], new, ahead[:, t - 1])
    total = _log_sum(ahead[:, -1], 1)
    behind = np.zeros_like(score)
    pair = np.zeros((2, 2))
    for t in range(most - 2, -1, -1):
        nxt = steps + (score[:, t + 1] + behind[:, t + 1])[:, None, :]
        on = live[:, t + 1]
        behind[:, t] = np.where(on[:, None], _log_sum(nxt, 2), 0.0)
        pair += (np.exp(ahead[:, t, :, None] + nxt - total[:, None, None]) * on[:, None, None]).sum(0)
    chance = np.exp(ahead + behind - total[:, None, None]) * live[..., None]
    value = (np.take_along_axis(score, d.truth[..., None], 2)[..., 0] * live).sum() + start[d.truth[:, 0]].sum() - total.sum()
    value += (d.seen * steps).sum()
    rest = ((d.truth - chance[..., 1]) * live).reshape(-1)
    grad = np.concatenate([np.bincount(d.flat, rest[d.owner], n), (d.seen - pair).ravel(), np.bincount(d.truth[:, 0], minlength=2) - chance[:, 0].sum(0)])
    return float(value), grad


def train(labelled: Iterable[tuple[str, list[int]]], rounds: int = 200, penalty: float = 0.001, rate: float = 0.15) -> Field:
    """Fit a field to pages with a 0/1 label for each of their leaf blocks."""
    index: dict[str, int] = {}
    pages = []
    for page, labels in labelled:
        found = features(leaf_blocks(page))
        if len(found) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(found)} blocks")
        if found:
            pages.append(([np.array([index.setdefault(f, len(index)) for f in own]) for own in found], np.array(labels)))
        if len(pages) > MAX_TRAINING_PAGES:
            raise ValueError(f"more than {MAX_TRAINING_PAGES} labelled pages")
    n, data = len(index), Prepared(pages)
    params, first, second = np.zeros(n + 6), np.zeros(n + 6), np.zeros(n + 6)
    for k in range(1, rounds + 1):
        _, grad = likelihood(params, data, n)
        grad = grad / len(pages) - penalty * params
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        params = params + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return Field(index, params[:n], params[n : n + 4].reshape(2, 2), params[n + 4 :])


# --- labelled pages -------------------------------------------------------------------------------------


class _Writer:
    """Makes pages from layouts and remembers the label of every text."""

    def __init__(self, rng: random.Random):
        self.rng, self.labels = rng, {}
        self.count = 0

    def words(self, low: int, high: int) -> str:
        syllables = "ka lo mi ten rus vo pel dan sir qu est ombra li né für aud".split()
        return " ".join("".join(self.rng.choices(syllables, k=self.rng.randint(1, 3))) for _ in range(self.rng.randint(low, high)))

    def text(self, label: int, low: int, high: int, stop: float = 0.5) -> str:
        self.count += 1
        out = self.words(low, high).capitalize() + f" {self.rng.choice(['', 'x', 'no'])}{self.count}"
        if high > 12 and self.rng.random() < 0.7:
            out = out.replace(" ", ", ", 1)
        out += "." if self.rng.random() < stop else ""
        self.labels[out] = label
        return out

    def listed(self) -> str:
        """A short label and what it lists."""
        self.count += 1
        out = f"{self.words(1, 1).capitalize()}: {', '.join(self.words(1, 1) for _ in range(self.rng.randint(1, 4)))}{self.count}"
        self.labels[out] = 0
        return out

    def links(self, label: int = 0) -> str:
        items = [f'<li><a href="/{i}">{self.text(label, 1, 3, 0.05)}</a></li>' for i in range(self.rng.randint(2, 7))]
        return f"<ul>{''.join(items)}</ul>"

    def one(self, *choices: str) -> str:
        return self.rng.choice(choices)

    def inline(self, body: str) -> str:
        r = self.rng.random()
        cut = body.find(" ")
        if cut < 0 or r > 0.3:
            return body
        a, b = body[:cut], body[cut + 1 :]
        return self.one(f"<b>{a}</b> {b}", f'<a href="#">{a}</a> {b}', f"<em>{a} {b}</em>", f"<b>{a} {b}<br>", f"<span class=x>{a}</span>\n {b}")

    def name(self) -> str:
        """A class that tells nothing."""
        syllables = "ka lo mi ten rus vo pel dan sir qu est".split()
        return "".join(self.rng.choices(syllables, k=self.rng.randint(1, 3))) + self.one("", "1", "-2", "_x")

    def within(self, body: str) -> str:
        """``body`` in a container whose tag and class tell nothing."""
        tag, names = self.one("div", "div", "div", "section"), self.one("", f' class="{self.name()}"', f' id={self.name()} class="{self.name()} {self.name()}"', f" class='{self.name()}'")
        return f"<{tag}{names}>{body}</{tag}>"

    def boiler(self) -> str:
        """A piece of a page that is no article text."""
        r = self.rng
        t = lambda low=1, high=12, stop=0.5: self.text(0, low, high, stop)
        kind = r.choice(["nav", "nav", "menu", "ad", "ad", "aside", "sidebar", "cookie", "notice", "form", "form", "comments", "comments", "related", "share", "news", "crumbs", "head", "tags", "plain", "plain"])
        if kind == "plain":
            own = self.one(self.links(), " | ".join(f"<a href=/{i}>{t(1, 3, 0)}</a>" for i in range(r.randint(2, 6))), f"&copy; {t(1, 8)}")
            return self.within(own)
        if kind == "nav":
            return f"<nav>{self.links()}</nav>" if r.random() < 0.7 else f"<nav><a href=/>{t(1, 2)}</a></nav>"
        if kind == "menu":
            return f'<div class="{self.one("menu", "main-menu", "navbar", "nav-list", "topbar menu")}">{self.links()}</div>'
        if kind == "ad":
            return f'<div class="{self.one("ad", "ads", "ad-box", "advert", "advertisement", "banner", "promo", "sponsored")}">{self.one("", "<p>")}{t(2, 30)}</div>'
        if kind == "aside":
            if r.random() < 0.3:
                return f"<aside>{t(2, 12)}</aside>"
            return f"<aside>{self.one('', f'<h3>{t(1, 3, 0)}</h3>')}<p>{t(4, 40)}</p>{self.one('', self.links())}</aside>"
        if kind == "sidebar":
            return f'<div {self.one("class", "id")}="{self.one("sidebar", "side-bar sidebar", "widget", "sidebar-left")}"><h3>{t(1, 3, 0)}</h3>{self.links()}<p>{t(4, 35)}</p></div>'
        if kind == "cookie":
            return f'<div {self.one("class", "id")}="{self.one("cookie", "cookie-notice", "consent", "cookie-banner", "gdpr")}"><p>{t(6, 25)}</p><button>{t(1, 2, 0)}</button></div>'
        if kind == "notice":
            tag = self.one("div", "section")
            return f'<{tag} class="{self.one("notice", "alert", "popup", "modal notice")}">{self.one("<p>", "")}{t(4, 25)}</{tag}>'
        if kind == "form":
            return f'<form {self.one("", "class=search", "id=login")}><p>{t(2, 10)}</p><label>{t(1, 3, 0)}</label><input name=q><button>{t(1, 2, 0)}</button></form>'
        if kind == "comments" and r.random() < 0.35:  # nothing but the layout tells
            top = self.one("", f"<h3>{t(1, 3, 0)}</h3>", f"<h4>{t(1, 3, 0)}</h4>")
            who = lambda: self.one("", "", f"<p><b>{t(1, 2, 0)}</b></p>", f"<span>{t(1, 3, 0)}</span>")
            items = "".join(f"<li>{self.one('', '<div>')}{who()}<p>{t(2, 60)}</p>{self.one('', '<p>' + t(2, 40) + '</p>') if r.random() < 0.3 else ''}</li>" for _ in range(r.randint(1, 5)))
            return self.within(f"{top}<{self.one('ul', 'ol')}>{items}</{self.one('ul', 'ol')}>")
        if kind == "comments":
            tag, item = self.one("section", "div"), self.one("div", "li", "article", "div")
            own = "".join(f'<{item} class="{self.one("comment", "reply", "comment-body")}"><p>{t(1, 3, 0)}</p><p>{t(5, 60)}</p></{item}>' for _ in range(r.randint(1, 4)))
            return f'<{tag} {self.one("class", "id")}="{self.one("comments", "comment-list", "discussion", "respond")}"><h2>{t(1, 3, 0)}</h2>{own}</{tag}>'
        if kind == "related":
            tag = self.one("section", "div")
            return f'<{tag} class="{self.one("related", "recommended", "related-posts")}"><h3>{t(1, 3, 0)}</h3>{self.links()}</{tag}>'
        if kind == "share":
            return f'<div class="{self.one("share", "social", "social-share")}"><a href=#>{t(1, 2, 0)}</a> <a href=#>{t(1, 2, 0)}</a></div>'
        if kind == "news":
            return f'<div class="{self.one("newsletter", "subscribe")}"><p>{t(4, 20)}</p></div>'
        if kind == "crumbs":
            return f'<div class="{self.one("breadcrumb", "breadcrumbs")}"><a href=/>{t(1, 1, 0)}</a> / <a href=/x>{t(1, 2, 0)}</a></div>'
        if kind == "tags" and r.random() < 0.5:
            return f"<{self.one('p', 'div')}>{self.listed()}</p>"
        if kind == "tags":
            return f'<div class="{self.one("tags", "post-tags")}"><a href=#>{t(1, 1, 0)}</a></div>'
        tag = self.one("p", "h2", "a", "div")
        return f"<header><{tag}>{t(1, 6, 0.1)}</{tag}>{self.one('', self.links())}</header>"

    def article(self) -> str:
        r = self.rng
        t = lambda low=4, high=60, stop=0.85: self.inline(self.text(1, low, high, stop))
        head, para = self.one("h1", "h1", "h1", "h2"), self.one(*"pppppp", "div")
        title = f"<{head}>{t(2, 10, 0.3)}</{head}>" if r.random() < 0.85 else ""
        parts = [f"<header>{title}</header>" if title and r.random() < 0.15 else title]
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.62:
                parts.append(f"<{para}>{t(1, 60)}" + (self.one("</p>", "</p>", "</p>", "") if para == "p" else "</div>"))
            elif kind < 0.70:
                parts.append(f"<h2>{t(1, 6, 0.1)}</h2>")
            elif kind < 0.77:
                items = "".join(f"<li>{t(1, 12, 0.4)}{self.one('</li>', '')}" for _ in range(r.randint(1, 4)))
                parts.append(f"<ul>{items}</ul>")
            elif kind < 0.83:
                parts.append(f"<blockquote>{self.one('<p>', '')}{t(3, 30)}</blockquote>")
            elif kind < 0.87:
                parts.append(f"<table><tr><td>{t(1, 3, 0)}</td><td>{t(1, 3, 0)}</td></tr></table>")
            elif kind < 0.90:
                parts.append(f"<figure><img src=x><figcaption>{t(2, 12)}</figcaption></figure>")
            elif kind < 0.94:
                parts.append(f"<div>{t(3, 30)}</div>")
            else:
                parts.append(self.boiler())  # something else amid the article
        holder = r.random()
        body = "".join(parts)
        if holder < 0.25:  # nothing tells but the text
            for _ in range(r.randint(0, 2)):
                body = self.within(body)
            return body
        if holder < 0.55:
            return f"<article>{body}{self.one('', self.boiler() if r.random() < 0.3 else '')}</article>"
        if holder < 0.65:
            return f"<main>{body}</main>"
        if holder < 0.75:
            return f"<main><article class='{self.one('post', 'story', '')}'>{body}</article></main>"
        tag = self.one("div", "section")
        return f'<{tag} {self.one("class", "id")}="{self.one("content", "post", "entry-content", "article-body", "story", "main", "main-content", "text")}">{body}</{tag}>'

    def page(self) -> str:
        r = self.rng
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        before = [self.boiler() for _ in range(r.randint(0, 4))]
        after = [self.boiler() for _ in range(r.randint(0, 4))]
        foot = f'<footer>{self.one("<p>", "")}{self.one("&copy; ", "")}{self.text(0, 2, 20)}</footer>' if r.random() < 0.7 else self.one("", f'<div class="{self.one("footer", "site-footer", "copyright")}">&copy; {self.text(0, 1, 12)}</div>')
        if r.random() < 0.08:  # columns of a table
            side = "<br>".join(f"<a href=/{i}>{self.text(0, 1, 3, 0.05)}</a>" for i in range(r.randint(2, 6)))
            left, right = f"<td{self.one('', ' width=120')}>{side}", f"<td>{self.article()}"
            row = self.one(f"{left}</td>{right}</td>", f"{right}</td>{left}</td>", f"{left}{right}")
            return f"{head}<table>{self.one('', f'<tr><td colspan=2>{self.links()}')}<tr>{row}</table>{foot}"
        # A copyright sign stands before the text that was remembered.
        body = "".join([*before, self.article() if r.random() < 0.96 else "", *after, foot])
        if r.random() < 0.3:
            body = f'<div class="{self.one("wrapper", "container", "page")}">{body}</div>'
        return f"{head}<!-- {self.words(1, 3)} -->{body}" + self.one("</body></html>", "")


def labelled_pages(n: int = 1000, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages of many layouts, each with one label per leaf block; the same for the same seed."""
    out = []
    for k in range(n):
        writer = _Writer(random.Random(seed * 1_000_003 + k))
        page = writer.page()
        labels = []
        for b in leaf_blocks(page):
            text = b.text.removeprefix("© ")
            labels.append(writer.labels[text] if text in writer.labels else 0)
        out.append((page, labels))
    return out


@functools.lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages())


def extract_pages(spark: SparkSession, pages: DataFrame, field: Field | None = None, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = spark.sparkContext.broadcast(field or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [model.extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    q = lambda c: F.col(f"`{c}`")
    return pages.select(q(page_id).cast("long").alias("page_id"), q(url).cast("string").alias("url"), q(source).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
