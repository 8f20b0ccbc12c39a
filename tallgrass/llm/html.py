"""Main text of web pages, by a recurrent block labeller.

A page is read into its blocks: leaf texts between block-level tags, each with
the path of tags (and class or id words) above it. A bidirectional LSTM in NumPy
reads a page's whole sequence of blocks. A block's vector is made of hashed
embeddings of its tag path (the mean over the whole path, and that of its last two
elements), the mean of hashed embeddings of all its words, and a few figures
(length, link share, place in the page). Every block gets one label, with the
context of all others: main text or not. The kept blocks are joined by line
breaks, in page order.

The labeller is trained here, on pages that a seeded generator lays out in many
ways (``training_pages``), where the role of every block is known: articles in
different containers, among menus, headers, footers, sidebars, notices, adverts,
forms and comments. No table is read for training.

Scripts, styles, comments in markup and hidden control content never become
blocks. One rule holds for comments, scripts and styles, that of browsers: without
an end they take the rest of the page. Comments end at ``-->`` or ``--!>``, and
``<!-->`` and ``<!--->`` are whole comments. Of other elements that are never closed
only the opening tag is left out. Reading a page
takes time in proportion to its length, whatever its markup. Null or empty pages
have an empty text, repeated rows are read each, and an empty table gives no rows.
Rows are independent, so there is no shuffle; memory is bounded by an Arrow batch
and the longest page.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import table, text_slices
from tallgrass.llm.words import NOT_SPACE, Words

#: Elements that begin and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; what is in ``noscript``, ``object``, ``canvas`` or ``math`` is.
RAW_TAGS = frozenset("script style template iframe svg textarea title".split())
CODE_TAGS = frozenset(("script", "style"))
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html article section div main aside nav header footer form select td th blockquote".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag: quotes hold a ``>`` only after an equals sign.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)>""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAME_WORD = re.compile(r"[a-z]+")

#: The text, the place of its element among the page's ``Path`` nodes, characters inside links.
Block = tuple[str, int, int]


class Path:
    """The elements that a page's blocks lie in: each one's parent (-1: none) and names."""

    def __init__(self) -> None:
        self.parents: list[int] = []
        self.names: list[tuple[str, ...]] = []

    def add(self, parent: int, names: tuple[str, ...]) -> int:
        self.parents.append(parent)
        self.names.append(names)
        return len(self.names) - 1


_END_OF_COMMENT = re.compile("--!?>")


@lru_cache(4096)
def _end_of_raw(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE)


@lru_cache(4096)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role."""
    words = [w for _, *values in _ATTRIBUTE.findall(attributes) for w in _NAME_WORD.findall("".join(values).lower())]
    return (tag, *(f".{w}" for w in words))


class _Markup:
    """Tags and texts of a page, in time in proportion to its length."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.last_end = page.rfind(">")
        self.quotes = self.comments = True
        self.unclosed: set[str] = set()

    def tokens(self) -> Iterator[tuple[str, bool, str]]:
        """(tag name, whether it closes, attributes) of tags, ("", False, text) of texts."""
        page, n = self.page, len(self.page)
        while self.at < n:
            start = page.find("<", self.at)
            if start != self.at:
                end = start if start >= 0 else n
                text, self.at = page[self.at : end], end
                yield "", False, text
                continue
            if page.startswith("<!--", start):
                m = _END_OF_COMMENT.search(page, start + 4) if self.comments else None
                self.comments = m is not None
                self.at = start + (5 if page[start + 4] == ">" else 6) if page.startswith((">", "->"), start + 4) else m.end() if m else n
            elif start <= self.last_end and page[start + 1 : start + 2] in ("!", "?"):
                self.at = page.find(">", start) + 1
            elif start <= self.last_end and (m := _NAME.match(page, start)):
                yield m.group(2).lower(), bool(m.group(1)), self._rest(m.end())
            else:
                self.at = start + 1
                yield "", False, "<"

    def _rest(self, at: int) -> str:
        """The attributes from ``at`` on. Once a quote runs on to the page's end, a tag ends at its first ``>``."""
        m = _REST.match(self.page, at) if self.quotes else None
        if m:
            self.at = m.end()
            return m.group(1)
        self.quotes = False
        end = self.page.find(">", at)
        end = end if end >= 0 else len(self.page)
        self.at = end + 1
        return self.page[at:end]

    def skip(self, tag: str) -> None:
        """Goes on after the element's closing tag. Without one, code takes the rest of the page, and of others only the opening tag is left out."""
        if tag not in self.unclosed:
            closing = _end_of_raw(tag).search(self.page, self.at)
            if closing:
                self.at = closing.end()
            elif tag in CODE_TAGS:
                self.at = len(self.page)
            else:
                self.unclosed.add(tag)


def blocks(page: str) -> tuple[list[Block], Path]:
    """Every block with text, in page order, and the elements that they lie in."""
    out: list[Block] = []
    path = Path()
    stack: list[tuple[str, int]] = []
    texts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            texts.clear()
            if text:
                out.append((text, stack[-1][1] if stack else -1, linked))
        linked = 0

    markup = _Markup(page)
    opened: dict[str, list[int]] = defaultdict(list)  # places in the stack, by tag

    def last(tags: Iterable[str]) -> int:
        return max((opened[t][-1] for t in tags if opened[t]), default=-1)

    def close_to(i: int) -> None:
        for tag, _ in stack[i:]:
            opened[tag].pop()
        del stack[i:]

    for tag, closes, rest in markup.tokens():
        if not tag:
            text = entities.unescape(rest) if "&" in rest else rest
            texts.append(text)
            if links:
                linked += len(text)
            continue
        if closes:
            if tag in BLOCK_TAGS:
                flush()
            elif tag == "a" and links:
                links -= 1
            i = last([tag])
            if i >= 0 and (tag in SCOPES or i > last(SCOPES)):
                close_to(i)
            continue
        if tag in RAW_TAGS:
            if not (tag == "svg" and rest.endswith("/")):
                markup.skip(tag)
            continue
        if tag == "br":
            texts.append(" ")
        if tag in BLOCK_TAGS:
            flush()
            closed = CLOSES.get(tag, ()) if tag in CLOSES else ("p", "h1", "h2", "h3", "h4", "h5", "h6")
            i = last(closed)
            if i >= 0 and i > last(SCOPES.difference(closed)):
                close_to(i)
                links = 0
        elif tag == "a":
            links += 1
        if tag not in VOID_TAGS and tag != "a" and (tag in BLOCK_TAGS or rest.strip("/ ")):
            opened[tag].append(len(stack))
            stack.append((tag, path.add(stack[-1][1] if stack else -1, _names(tag, rest))))
    flush()
    return out, path


PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, FIGURES, HIDDEN = 1 << 10, 1 << 11, 16, 8, 6, 16
Page = tuple[list[Block], Path]


@lru_cache(65536)
def _bucket(name: str) -> int:
    return crc32(name.encode()) % PATH_BUCKETS


def last_names(path: Path, node: int) -> list[int]:
    """Buckets of the names of an element and its parent, of both tags together, and of the element's own apart."""
    if node < 0:
        return []
    own, parent = path.names[node], path.parents[node]
    above = path.names[parent] if parent >= 0 else ()
    return [*map(_bucket, own), *map(_bucket, above), _bucket(f"{above[0] if above else ''}/{own[0]}"), *(_bucket(f"!{name}") for name in own)]


def figures_of(page: list[Block]) -> list[tuple[float, ...]]:
    n = len(page)
    return [(min(len(text), 2000) / 500, np.log1p(len(text)) / 8, min(1.0, linked / len(text)), i / n, (n - i) / n, float(text[-1] in ".!?…。")) for i, (text, _, linked) in enumerate(page)]


class Labeller:
    """Weights by name; ``Wf``/``Wb`` are the two directions' input, forget, cell and output gates."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = 2 * PATH_DIM + WORD_DIM + FIGURES
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.w = {"P": draw(PATH_BUCKETS, PATH_DIM, scale=0.1), "L": draw(PATH_BUCKETS, PATH_DIM, scale=0.1), "V": draw(WORD_BUCKETS, WORD_DIM, scale=0.1)}
        for side in "fb":
            self.w[f"W{side}"] = draw(d + HIDDEN, 4 * HIDDEN, scale=0.2)
            self.w[f"B{side}"] = np.zeros(4 * HIDDEN, np.float32)
            self.w[f"B{side}"][HIDDEN : 2 * HIDDEN] = 1
        self.w["O"] = draw(2 * HIDDEN + d, scale=0.1)
        self.w["c"] = np.zeros(1, np.float32)

    def inputs(self, pages: list[Page]) -> tuple[np.ndarray, list[tuple[str, slice, np.ndarray, np.ndarray, np.ndarray]]]:
        """Vectors of all blocks; and for the way back, by part: table, columns, rows, the blocks that read them, shares."""
        every = [b for own, _ in pages for b in own]
        n = len(every)
        means, back = [], []

        def mean(key: str, rows: np.ndarray, sizes: np.ndarray) -> None:
            table = self.w[key]
            out = np.zeros((n, table.shape[1]), np.float32)
            some = np.flatnonzero(sizes)
            if len(some):
                out[some] = np.add.reduceat(table[rows], (np.cumsum(sizes) - sizes)[some], axis=0) / sizes[some, None]
            at = sum(m.shape[1] for m in means)
            means.append(out)
            back.append((key, slice(at, at + table.shape[1]), rows, np.repeat(np.arange(n), sizes), 1 / np.maximum(sizes, 1)))

        lists = [last_names(path, node) for own, path in pages for _, node, _ in own]
        mean("L", np.fromiter((x for own in lists for x in own), np.int64), np.fromiter(map(len, lists), np.int64, n))
        words = Words([text.encode("utf-8", "replace").lower() for text, _, _ in every], NOT_SPACE)
        mean("V", (words.hashes() % np.uint64(WORD_BUCKETS)).astype(np.int64), words.counts())
        whole = self._paths(pages, n)
        figures = np.array([f for own, _ in pages for f in figures_of(own)], np.float32).reshape(-1, FIGURES)
        return np.concatenate([*means, whole, figures], 1), back

    def _paths(self, pages: list[Page], n: int) -> np.ndarray:
        """Means over the names of whole paths, from sums that go down from element to element."""
        out = np.zeros((n, PATH_DIM), np.float32)
        at = 0
        for own, path in pages:
            sums = np.zeros((len(path.names) + 1, PATH_DIM), np.float32)  # the last row: no element
            counts = np.zeros(len(path.names) + 1)
            for i, (parent, names) in enumerate(zip(path.parents, path.names, strict=True)):
                sums[i] = sums[parent] + self.w["P"][[_bucket(name) for name in names]].sum(0)
                counts[i] = counts[parent] + len(names)
            nodes = [node for _, node, _ in own]
            out[at : at + len(own)] = sums[nodes] / np.maximum(counts[nodes], 1)[:, None] if own else 0
            at += len(own)
        return out

    def forward(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Logits of blocks ``x``, of pages with ``sizes`` blocks each, one after the other. Longest pages first inside."""
        order = np.argsort(-sizes, kind="stable")
        begins = np.cumsum(sizes) - sizes
        steps = int(sizes.max(initial=0))
        alive = np.searchsorted(-sizes[order], -np.arange(steps), "left") if steps else np.zeros(0, int)
        hidden = np.zeros((len(x), 2 * HIDDEN), np.float32)
        tape = []
        for side, name in enumerate("fb"):
            w, b = self.w[f"W{name}"], self.w[f"B{name}"]
            given = x @ w[: x.shape[1]] + b
            h = np.zeros((len(sizes), HIDDEN), np.float32)
            c = np.zeros_like(h)
            for t in range(steps):
                pages = order[: alive[t]]
                at = begins[pages] + (t if not side else sizes[pages] - 1 - t)
                z = given[at] + h[: alive[t]] @ w[x.shape[1] :]
                gates = 1 / (1 + np.exp(-z))
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 3 * HIDDEN :]
                g = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
                before = (h[: alive[t]].copy(), c[: alive[t]].copy()) if keep else None
                c[: alive[t]] = f * c[: alive[t]] + i * g
                squashed = np.tanh(c[: alive[t]])
                h[: alive[t]] = o * squashed
                hidden[at, side * HIDDEN : (side + 1) * HIDDEN] = h[: alive[t]]
                if keep:
                    tape.append((name, at, i, f, g, o, squashed, *before))
        return np.concatenate([hidden, x], 1) @ self.w["O"] + self.w["c"], [hidden, tape]

    def gradients(self, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, pages: list[Page], reads: list[tuple]) -> dict[str, np.ndarray]:
        logits, (hidden, tape) = self.forward(x, sizes, keep=True)
        error = ((1 / (1 + np.exp(-logits)) - labels) / len(sizes)).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["O"] = np.concatenate([hidden, x], 1).T @ error
        grad["c"][0] = error.sum()
        back = error[:, None] * self.w["O"]
        dx = back[:, 2 * HIDDEN :].copy()
        d = x.shape[1]
        for side, name in enumerate("fb"):
            w = self.w[f"W{name}"]
            dh = np.zeros((len(sizes), HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for step, at, i, f, g, o, squashed, h0, c0 in reversed(tape):
                if step != name:
                    continue
                n = len(at)
                total = dh[:n] + back[at, side * HIDDEN : (side + 1) * HIDDEN]
                cell = dc[:n] + total * o * (1 - squashed**2)
                dz = np.concatenate([cell * g * i * (1 - i), cell * c0 * f * (1 - f), cell * i * (1 - g**2), total * squashed * o * (1 - o)], 1)
                grad[f"W{name}"][:d] += x[at].T @ dz
                grad[f"W{name}"][d:] += h0.T @ dz
                grad[f"B{name}"] += dz.sum(0)
                dx[at] += dz @ w[:d].T
                dh[:n] = dz @ w[d:].T
                dc[:n] = cell * f
        for key, columns, rows, which, share in reads:
            np.add.at(grad[key], rows, (dx[:, columns] * share[:, None])[which])
        of_path = dx[:, PATH_DIM + WORD_DIM : 2 * PATH_DIM + WORD_DIM]
        at = 0
        for own, path in pages:  # from the elements up: what an element's names do to all blocks below it
            down = np.zeros((len(path.names), PATH_DIM), np.float32)
            counts = np.zeros(len(path.names) + 1)
            for i, (parent, names) in enumerate(zip(path.parents, path.names, strict=True)):
                counts[i] = counts[parent] + len(names)
            for j, (_, node, _) in enumerate(own):
                if node >= 0:
                    down[node] += of_path[at + j] / max(counts[node], 1)
            for i in range(len(path.names) - 1, -1, -1):
                if path.parents[i] >= 0:
                    down[path.parents[i]] += down[i]
                for name in path.names[i]:
                    grad["P"][_bucket(name)] += down[i]
            at += len(own)
        return grad

    def train(self, pages: list[tuple[Page, list[int]]], epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for some in (order[i : i + batch] for i in range(0, len(order), batch)):
                own = [pages[j][0] for j in some]
                x, back = self.inputs(own)
                t += 1
                labels = np.array([y for j in some for y in pages[j][1]], np.float32)
                for k, g in self.gradients(x, np.array([len(p[0]) for p in own]), labels, own, back).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def labels(self, pages: list[Page]) -> np.ndarray:
        """Which blocks are main text, for all pages' blocks one after the other."""
        if not any(own for own, _ in pages):
            return np.zeros(0, bool)
        x, _ = self.inputs(pages)
        return self.forward(x, np.array([len(own) for own, _ in pages]))[0] > 0

    def main_texts(self, pages: list[Page]) -> list[str]:
        kept = self.labels(pages)
        out, at = [], 0
        for own, _ in pages:
            out.append("\n".join(text for (text, _, _), good in zip(own, kept[at : at + len(own)], strict=True) if good))
            at += len(own)
        return out


def training_pages(n: int = 700, seed: int = 2) -> Iterator[tuple[str, list[int]]]:
    """Pages of random words in random layouts, with the label of each block: 1 in the article."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[int(rng.integers(len(options)))]
    chance = lambda p: rng.random() < p
    syllables = ["".join(s) for s in zip("bcdfghklmnprstvzéøñ", "aeiouaeiouaeiouaeio", strict=True)] + ["ing", "the", "ent", "sch", "que", "ón"]

    def word() -> str:
        return "".join(syllables[int(j)] for j in rng.integers(len(syllables), size=int(rng.integers(1, 4))))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(int(rng.integers(low, high + 1))))

    def sentences(low: int, high: int) -> str:
        return " ".join(words(1, 14).capitalize() + "." for _ in range(int(rng.integers(low, high + 1))))

    for _ in range(n):
        parts: list[str] = []
        labels: list[int] = []

        def add(markup: str, *own: int, parts: list[str] = parts, labels: list[int] = labels) -> None:
            parts.append(markup)
            labels.extend(own)

        def menu(add=add) -> None:  # noqa: ANN001
            count = int(rng.integers(2, 9))
            items = "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(count))
            add(pick(f"<nav><ul>{items}</ul></nav>", f'<div class="{pick("menu", "navbar", "nav", "breadcrumb")}"><ul>{items}</ul></div>', f'<nav class="main-nav"><ol>{items}</ol></nav>'), *[0] * count)

        def clutter(add=add) -> None:  # noqa: ANN001
            text = sentences(1, 3)
            kind = int(rng.integers(7))
            if kind == 0:
                add(f'<div class="{pick("ad", "ads", "advert", "advertisement", "sponsored", "banner promo")}">{text}</div>', 0)
            elif kind == 1:
                add(f'<aside{pick("", " class=sidebar")}><h3>{words(1, 3)}</h3><p>{text}</p></aside>', 0, 0)
            elif kind == 2:
                add(f'<div class="{pick("sidebar", "related", "widget", "share social")}"><h4>{words(1, 3)}</h4><ul><li><a href="#">{words(2, 6)}</a></li><li><a href="#">{words(2, 6)}</a></li></ul></div>', 0, 0, 0)
            elif kind == 3:
                add(f'<div {pick("class", "id")}="{pick("cookie-notice", "cookie banner", "consent", "notice", "gdpr popup", "newsletter")}"><p>{pick("We use cookies. ", "")}{text}</p><button>{words(1, 2)}</button></div>', 0, 0)
            elif kind == 4:
                add(f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><select><option>{word()}</option></select><button>{word()}</button></form>', 0, 0, 0)
            elif kind == 5:
                add(f'<div class="{pick("ad", "promo", "newsletter-signup", "subscribe")}"><p>{text}</p></div>', 0)
            else:
                add(f'<header><h1>{words(1, 4)}</h1><p>{words(2, 8)}</p></header>', 0, 0)

        def article(add=add) -> None:  # noqa: ANN001
            opening, closing = pick(("<article>", "</article>"), ("<article>", "</article>"), ('<article class="post">', "</article>"), ("<main>", "</main>"), ('<main id="content"><article>', "</article></main>"), ('<div class="content">', "</div>"), ('<div id="article-body" class="entry">', "</div>"), ('<section class="post-content">', "</section>"))
            title = pick(words(2, 9), sentences(1, 2))
            add(f"{opening}<h1>{title}</h1>" if chance(0.9) else opening + f"<p>{title}</p>", 1)
            for _ in range(int(rng.integers(1, 14)) if chance(0.93) else 60):
                kind = rng.random()
                text = sentences(1, pick(1, 2, 5, 9)) if chance(0.85) else words(1, 3)
                if chance(0.1):
                    text = " ".join(w + pick("###", "%%%", "$$$", "***", "&amp;&amp;&amp;") for w in text.split())
                if kind < 0.6:
                    add(f"<p>{text}</p>", 1)
                elif kind < 0.7:
                    add(f"<p><b>{text}<br>", 1)
                elif kind < 0.78:
                    level = pick(2, 3)
                    add(f"<h{level}>{words(1, 6)}</h{level}>", 1)
                elif kind < 0.84:
                    add(f"<ul><li>{text}</li><li>{words(1, 9)}</li></ul>", 1, 1)
                elif kind < 0.88:
                    add(f"<blockquote><p>{text}</p></blockquote>", 1)
                elif kind < 0.91:
                    add(f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", 1, 1)
                elif kind < 0.94:
                    add(f"<p>{words(1, 5)} <a href='#'>{words(1, 4)}</a> {text}</p>", 1)
                elif kind < 0.96:
                    add(f"<pre>{words(3, 9)}</pre>", 1)
                elif chance(0.6):
                    add(f'<div class="{pick("ad", "advert", "promo", "share", "related")}">{text}</div>', 0)
                else:
                    add(f"<div>{text}</div>", 1)
            add(closing)

        if chance(0.3):
            clutter()
        if chance(0.85):
            menu()
        for _ in range(int(rng.integers(0, 3))):
            clutter()
        article()
        if chance(0.35):
            holder = pick('<section class="comments">', '<div id="comments">', '<section id="comments" class="discussion">', '<div class="comment-list">')
            add(f"{holder}<h3>{pick('Comments', words(1, 2))}</h3>", 0)
            for _ in range(int(rng.integers(1, 6))):
                add(f'<div class="comment"><span class="author">{word()}</span><p>{sentences(1, 4)}</p></div>', 0, 0)
            add("</section>" if holder.startswith("<section") else "</div>")
        for _ in range(int(rng.integers(0, 3))):
            clutter()
        if chance(0.85):
            add(pick(f"<footer>&copy; {word()}.example &middot; {sentences(1, 2)}</footer>", f'<div class="footer">{words(2, 9)} &copy;</div>', f"<footer><p>{sentences(1, 2)}</p></footer>"), 0)
        yield f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title></head><body>{''.join(parts)}</body></html>", labels


@lru_cache(1)
def trained() -> Labeller:
    """The labeller, trained once in a process; seeds are fixed, so it is the same everywhere."""
    made = [(blocks(page), labels) for page, labels in training_pages()]
    return Labeller().train([(page, labels) for page, labels in made if len(page[0]) == len(labels)])


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text", labeller: Labeller | None = None) -> DataFrame:
    """``pages`` with the main text of ``html_col`` in ``out_col``, which replaces a column of that name."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller or trained())  # a fixed size, whatever the input
    out = pages if out_col == html_col else pages.drop(out_col)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name != out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = shared.value
        for batch, texts in text_slices(batches, html_col, 1 << 20):
            found = labeller.main_texts([blocks(t.decode()) for t in texts])
            names = [c for c in batch.schema.names if c != out_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.string())], names=[*names, out_col])

    return out.mapInArrow(run, f"{ddl}, `{out_col}` string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
