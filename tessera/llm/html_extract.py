"""Operator 4: main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read with the tolerant parser of the standard library into leaf blocks: runs of text between block-level
tags, each with the tags, classes and ids above it. Every block gets features of its ancestors, its text and its place.
The field has two labels, main and boilerplate, weights for the features of a block and for pairs of neighbouring
labels, is trained by stochastic gradients of the conditional likelihood, and is decoded by Viterbi.

The tables hold no page labels, so the training pages are made here by rule: articles in several kinds of containers
among menus, headers, footers, sidebars, notices, adverts, forms and reader comments, all of nonsense words, with the
label of each block known. Training is the same each time and takes a few seconds on the driver; the weights, some
thousands of numbers, go to the tasks. Pages are read whole and nothing is shuffled.

Words of buttons and formulas inside a paragraph are text; a block that is a button isn't. A head without an end tag ends
where something stands that no head holds; a hidden element without one hides nothing. Reading takes time in proportion
to the page, however many elements stay open.

Null and empty html give the empty text, as do pages without any block labelled main; repeated rows come out as often as
they came in; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, unused

#: Tags whose content is never text of a page.
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas audio video select option datalist textarea".split())
#: Tags that may stand in a head; any other opening tag, and any text, ends a head that has no end tag.
IN_HEAD = frozenset("head title meta link base style script noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that stand inside a line of text; all others part blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img button math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics".split())
#: Tags that an opening tag of the first kind closes, unless one of the last kind stands between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What a class or id may tell of a block.
HINTS = {
    "menu": r"nav|menu|breadcrumb|toolbar|tabs|pagination|pager|toc",
    "head": r"header|masthead|banner|topbar|logo|branding",
    "foot": r"footer|copyright|legal|colophon|bottom",
    "side": r"side|aside|widget|related|recommend|popular|trending|more-|also",
    "note": r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|subscribe|newsletter|signup|paywall|promo",
    "advert": r"(?:^|[^a-z])(?:ad|ads|advert\w*|sponsor\w*|banner|dfp|outbrain|taboola)(?:$|[^a-z])",
    "form": r"form|login|search|contact",
    "reply": r"comment|reply|replies|disqus|discussion|respond",
    "share": r"share|social|follow|tweet",
    "body": r"article|content|post|entry|story|body|main|text",
}
_HINTS = {k: re.compile(v) for k, v in HINTS.items()}


@lru_cache(maxsize=10_000)
def hints(names: str) -> tuple[str, ...]:
    return tuple(k for k, v in _HINTS.items() if v.search(names))


@dataclass
class Block:
    text: str
    tag: str  # the nearest element that parts blocks
    inside: frozenset[str]  # the other such elements above it
    hints: frozenset[str]  # of all elements above
    near: frozenset[str]  # of the nearest element with any
    linked: int  # characters inside links
    pressed: int  # characters inside buttons


@dataclass(slots=True)
class _Open:
    """An open element, and what it and those above it say of the blocks inside; unchanged parts are shared."""

    name: str
    tag: str
    inside: frozenset[str]
    hints: frozenset[str]
    near: frozenset[str]


_NOTHING: frozenset[str] = frozenset()
_ENDS = re.compile(r"</([a-zA-Z]+)")


class BlockParser(HTMLParser):
    """Collects leaf blocks, in time that grows with the page however many elements stay open."""

    def __init__(self, ends: Counter):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.parting: list[int] = []  # places in ``open`` of the elements that part blocks
        self.count: Counter = Counter()  # open elements by tag
        self.ends = ends  # end tags still to come
        self.hidden = self.linked = self.pressed = 0
        self.parts: list[str] = []
        self.blocks: list[Block] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.open[-1] if self.open else _Open("", "none", _NOTHING, _NOTHING, _NOTHING)
                self.blocks.append(Block(text, top.tag, top.inside, top.hints, top.near, self.linked, self.pressed))
            self.parts, self.linked, self.pressed = [], 0, 0

    def _close_to(self, k: int) -> None:
        for e in self.open[k:]:
            self.hidden -= e.name in HIDDEN
            self.count[e.name] -= 1
        del self.open[k:]
        while self.parting and self.parting[-1] >= k:
            self.parting.pop()

    def _open(self, tag: str, own: tuple[str, ...]) -> None:
        up = self.open[-1] if self.open else _Open("", "none", _NOTHING, _NOTHING, _NOTHING)
        parts = tag not in INLINE
        inside = up.inside | {up.tag} if parts and up.tag != "none" and up.tag not in up.inside else up.inside
        marked = up.hints if up.hints.issuperset(own) else up.hints.union(own)
        if parts:
            self.parting.append(len(self.open))
        self.open.append(_Open(tag, tag if parts else up.tag, inside, marked, frozenset(own) if own else up.near))
        self.count[tag] += 1
        self.hidden += tag in HIDDEN

    def _end_head(self) -> None:
        if self.count["head"]:
            self._close_to(next(k for k, e in enumerate(self.open) if e.name == "head"))

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            return
        if tag in HIDDEN and tag != "head" and not self.ends[tag]:
            return  # without an end it would hide the rest of the page
        if tag not in INLINE:
            self.flush()
            self._imply_end(tag)
        names = " ".join(v.lower() for n, v in attrs if n in ("class", "id", "role") and v)
        self._open(tag, hints(names) if names else ())

    def _imply_end(self, tag: str) -> None:
        """Closes what an opening tag closes: a paragraph right above, or the item or cell before."""
        ends, walls = CLOSES.get(tag, ({"p"}, None))
        if any(self.count[t] for t in ends):
            for k in reversed(self.parting):
                t = self.open[k].name
                if t in ends:
                    self._close_to(k)
                if t in ends or walls is None or t in walls:
                    break

    def handle_endtag(self, tag):
        self.ends[tag] -= 1
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
        if self.count[tag]:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].name == tag:
                    self._close_to(k)
                    break
                if tag in INLINE and self.open[k].name not in INLINE:
                    break

    def handle_data(self, data):
        if self.count["head"] and self.open[-1].name == "head" and data.strip():
            self._end_head()
        if not self.hidden:
            self.parts.append(data)
            if self.count["a"]:
                self.linked += len(data)
            if self.count["button"]:
                self.pressed += len(data)


def blocks_of(html: str | None) -> list[Block]:
    html = html or ""
    parser = BlockParser(Counter(m[1].lower() for m in _ENDS.finditer(html)))
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


_LEGAL = re.compile(r"©|\(c\)|copyright|all rights|rights reserved", re.I)


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of each block: ancestors, hints, text, and where it stands."""
    out = []
    for k, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        size = min(int(math.log2(n + 1)), 10)
        dense = min(int(4 * b.linked / max(n, 1)), 4)
        last = b.text[-1]
        shut = "stop" if last in ".!?\"'”’»)…" else "colon" if last in ":;," else "open"
        kind = "h" if b.tag in HEADINGS else b.tag
        x = ["bias", f"tag={kind}", f"size={size}", f"links={dense}", f"shut={shut}", f"size={size},links={dense}", f"words={min(words, 12)}"]
        x += [f"in={t}" for t in sorted(b.inside)]
        if 2 * b.pressed > n:
            x.append("pressed")
        x += [f"hint={h}" for h in sorted(b.hints)] + [f"near={h}" for h in sorted(b.near)]
        if not b.hints:
            x.append("hint=none")
        if _LEGAL.search(b.text):
            x.append("legal")
        if k == 0:
            x.append("first")
        if k == len(blocks) - 1:
            x.append("last")
        out.append(x)
    return out


class Field:
    """A linear-chain conditional random field with the labels 0 (boilerplate) and 1 (main)."""

    def __init__(self, names: dict[str, int] | None = None, weights: np.ndarray | None = None, pairs: np.ndarray | None = None):
        self.names = names or {}
        self.weights = weights if weights is not None else np.zeros(0)
        self.pairs = pairs if pairs is not None else np.zeros((2, 2))

    def scores(self, page: list[list[str]]) -> np.ndarray:
        """For each block, by how much its features speak for main; unknown features say nothing."""
        names, w = self.names, self.weights
        return np.array([sum(w[names[f]] for f in x if f in names) for x in page])

    def decode(self, page: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not page:
            return []
        s, t = self.scores(page).tolist(), self.pairs.tolist()
        best, back = [0.0, s[0]], []
        for v in s[1:]:
            step, nxt = [], []
            for y in (0, 1):
                a, b = best[0] + t[0][y], best[1] + t[1][y]
                step.append(0 if a >= b else 1)
                nxt.append(max(a, b) + (v if y else 0.0))
            back.append(step)
            best = nxt
        y = 0 if best[0] >= best[1] else 1
        out = [y]
        for step in reversed(back):
            y = step[y]
            out.append(y)
        return out[::-1]

    def _marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(main) of each block, and P(label, next label) of each pair, by forward and backward sums."""
        n, t = len(s), np.exp(self.pairs)
        e = np.column_stack([np.ones(n), np.exp(np.clip(s, -30, 30))])
        a, b = np.empty((n, 2)), np.ones((n, 2))
        a[0] = e[0] / e[0].sum()
        for k in range(1, n):
            a[k] = (a[k - 1] @ t) * e[k]
            a[k] /= a[k].sum()
        for k in range(n - 2, -1, -1):
            b[k] = t @ (e[k + 1] * b[k + 1])
            b[k] /= b[k].sum()
        m = a * b
        pair = a[:-1, :, None] * t[None] * (e[1:] * b[1:])[:, None, :]
        return m[:, 1] / m.sum(axis=1), pair / pair.sum(axis=(1, 2), keepdims=True)

    @classmethod
    def train(cls, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Field:
        """Stochastic gradient ascent on the conditional log-likelihood, step sizes by feature, with weight decay."""
        names: dict[str, int] = {}
        coded = [([np.array([names.setdefault(f, len(names)) for f in x]) for x in page], np.array(y)) for page, y in pages]
        out = cls(names, np.zeros(len(names)))
        seen, seen_pairs = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
        order = random.Random(seed)
        for _ in range(rounds):
            for k in order.sample(range(len(coded)), len(coded)):
                page, y = coded[k]
                main, pair = out._marginals(np.array([out.weights[x].sum() for x in page]))
                flat = np.concatenate(page)
                slope = np.bincount(flat, np.repeat(y - main, [len(x) for x in page]), len(names))
                used = np.unique(flat)
                seen[used] += slope[used] ** 2
                out.weights[used] += rate * slope[used] / np.sqrt(seen[used]) - rate * decay * out.weights[used]
                if len(y) > 1:
                    real = np.bincount(y[:-1] * 2 + y[1:], minlength=4).reshape(2, 2)
                    slope = real - pair.sum(axis=0)
                    seen_pairs += slope**2
                    out.pairs += rate * slope / np.sqrt(seen_pairs) - rate * decay * out.pairs
        return out


class PageMaker:
    """Labelled pages of nonsense words in varied layouts."""

    SYLLABLES = "ba co di fu ga he ji ka lo me ni or pa qui re sa to un ve wa xi yo zu ter ing tion ent al".split()

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, a: int, b: int) -> str:
        r = self.r
        return " ".join("".join(r.choices(self.SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def sentence(self, a: int = 4, b: int = 25) -> str:
        return self.words(a, b).capitalize() + self.r.choice(". . . . ! ?".split())

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 5, 8, 15))))

    def links(self, a: int, b: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.words(1, 4)}</a></li>' for k in range(self.r.randint(a, b)))

    def boilerplate(self) -> dict[str, str]:
        r, w, s = self.r, self.words, self.sentence
        return {
            "menu": r.choice((f"<nav><ul>{self.links(3, 10)}</ul></nav>", f'<div class="{r.choice(("menu", "navbar", "breadcrumbs", "main-nav"))}"><ul>{self.links(3, 10)}</ul></div>', f'<ul id="nav">{self.links(3, 8)}</ul>')),
            "head": r.choice((f"<header><div class=logo>{w(1, 3)}</div><p>{w(3, 8)}</p></header>", f'<div id="header"><a href="/">{w(1, 3)}</a><span>{s(3, 9)}</span></div>')),
            "foot": r.choice((f"<footer>&copy; {w(1, 3)} &middot; {s(3, 10)}</footer>", f"<footer><p>{s(3, 12)}</p><ul>{self.links(2, 6)}</ul></footer>", f'<div class="footer"><p>Copyright 2020 {w(1, 4)}. All rights reserved.</p></div>')),
            "side": r.choice((f"<aside><h3>{w(1, 4)}</h3><ul>{self.links(3, 8)}</ul></aside>", f'<div class="sidebar"><h4>{w(1, 3)}</h4><p>{s(5, 20)}</p></div>', f"<aside><p>{self.paragraph()}</p></aside>")),
            "note": r.choice((f'<div class="cookie-notice">{s(6, 25)} <button>OK</button></div>', f'<div id="newsletter"><h3>{w(2, 5)}</h3><p>{s(5, 15)}</p></div>', f'<div role="alert" class="notice">{s(5, 20)}</div>')),
            "advert": r.choice((f'<div class="ad">{s(4, 15)}</div>', f'<div class="advertisement"><a href="/x">{s(3, 12)}</a></div>', f'<section class="sponsored"><h4>{w(2, 6)}</h4><p>{s(5, 15)}</p></section>', f'<div id="ad-1"><p>{s(5, 30)}</p></div>')),
            "form": f'<form action="/s"><label>{w(1, 4)}</label><input name="q"><p>{s(3, 8)}</p><button>{w(1, 2)}</button></form>',
            "reply": r.choice(('<section id="comments"><h3>{0}</h3>{1}</section>', '<div class="comments"><h4>{0}</h4>{1}</div>', '<div class="comment-list">{1}</div>')).format(w(1, 3), "".join(f'<div class="{r.choice(("comment", "reply"))}"><b>{w(1, 2)}</b><p>{self.paragraph()}</p></div>' for _ in range(r.randint(1, 5)))),
            "share": f'<div class="share-buttons"><a href="/f">{w(1, 2)}</a> <a href="/t">{w(1, 2)}</a></div>',
        }

    def article(self) -> tuple[str, list[str]]:
        r, out, texts = self.r, [], []

        def put(shape: str, *parts: str) -> None:
            out.append(shape.format(*parts))
            texts.extend(parts)

        if r.random() < 0.85:
            put("<h1>{}</h1>", self.words(2, 12).capitalize())
        for _ in range(r.choice((1, 1, 2, 4, 8, 14))):
            kind = r.random()
            if kind < 0.66:
                put(r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p><em>{}</em></p>", "<div>{}</div>", "{}<hr>")), self.paragraph())
            elif kind < 0.76:
                put("<h2>{}</h2>", self.words(1, 7).capitalize())
            elif kind < 0.86:
                items = [self.sentence(2, 14) if r.random() < 0.5 else self.words(1, 8) for _ in range(r.randint(2, 5))]
                put("<ul>" + "<li>{}</li>" * len(items) + "</ul>", *items)
            elif kind < 0.91:
                put("<blockquote><p>{}</p></blockquote>", self.paragraph())
            elif kind < 0.93:  # a legal line may close an article as well
                put("<p>{}</p>", r.choice(("All rights reserved.", f"Copyright {r.randint(1990, 2025)} {self.words(1, 3)}.", f"Released under the {self.words(1, 2)} License.")))
            elif kind < 0.96:
                cells = [self.words(1, 4) for _ in range(4)]
                put("<table><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table>", *cells)
            elif kind < 0.98:  # a button in a sentence is text, one on its own isn't
                a, b = self.sentence(), self.words(1, 2)
                out.append(f"<p>{a} <button>{b}</button> {a}</p><div><button>{self.words(1, 2)}</button></div>")
                texts.append(f"{a} {b} {a}")
            else:
                put("<p>{}</p>", self.words(1, 3).capitalize() + ".")
        return "".join(out), texts

    def page(self) -> tuple[str, set[str]]:
        r, part = self.r, self.boilerplate()
        body, texts = self.article()
        if r.random() < 0.3:  # boilerplate inside the article's element
            body += part[r.choice(("reply", "share", "advert", "side"))]
        shell = r.choice(("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="post-content">{}</div>', '<div id="content">{}</div>', '<div class="entry"><div class="article-body">{}</div></div>', '<section class="story">{}</section>', "<div>{}</div>", "{}"))
        before = [part[k] for k in ("menu", "head", "note", "advert", "side", "form") if r.random() < 0.45]
        after = [part[k] for k in ("reply", "side", "share", "note", "foot", "advert", "menu") if r.random() < 0.4]
        r.shuffle(before)
        after = [x for x in after if x not in before]
        inner = f"{''.join(before)}{shell.format(body)}{''.join(after)}"
        if r.random() < 0.15:  # the tags around a page may be left out
            return inner, set(texts)
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{inner}</body></html>", set(texts)


def labelled_pages(n: int, seed: int) -> list[tuple[list[list[str]], list[int]]]:
    maker, out = PageMaker(seed), []
    for _ in range(n):
        html, main = maker.page()
        blocks = blocks_of(html)
        if blocks:
            out.append((features(blocks), [int(b.text in main) for b in blocks]))
    return out


@lru_cache(maxsize=2)
def trained(pages: int = 500, seed: int = 11) -> Field:
    """The field trained on ``pages`` made pages."""
    return Field.train(labelled_pages(pages, seed))


def main_text(html: str | None, field: Field) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, y in zip(blocks, field.decode(features(blocks)), strict=True) if y)


def extract(pages: DataFrame, *, html: str = "html", field: Field | None = None) -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to every page, in place of the html."""
    field = field or trained()
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    whole = unused(keep, "_html")[0]
    rows = pages.select(*keep, F.col(html).alias(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, whole):
                texts = [main_text(h, field) for h in piece.column(whole).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = rows.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
