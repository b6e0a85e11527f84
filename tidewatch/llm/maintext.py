"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A block's features are the tags and the kinds of class, id and role words of all its ancestors, its own tag, and shape of its text.
Two states, page furniture and main text, are linked by transition weights. The weights maximise the penalised
conditional likelihood of labelled pages (forward-backward sums, Adam steps in numpy); a page is decoded by Viterbi.

The labelled pages are put together here from parts whose label is known: main text in semantic or plain containers, and menus,
headers, footers, sidebars, notices, adverts, forms and comments around and inside it. Their number and seed are
parameters; the pages to extract give nothing to the training.

A null or empty html has the text ''. A page without main text too. Every row gives a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.blocks import blocks

LABELLED_PAGES, SEED = 600, 3
STEPS, STEP, PENALTY = 200, 0.1, 0.0005
PAGES_AT_ONCE = 256


POOL = ["".join("aeiounrstlmdk"[k * (3 + j) % 13] for j, k in enumerate(range(i, i + 2 + i % 7))) for i in range(1, 500)]


def _words(rng: np.random.Generator, n: int, closed: bool = True) -> str:
    """Words without meaning; the model looks at shape only."""
    made = [POOL[k] for k in rng.integers(0, len(POOL), n)]
    made[::9] = [w.capitalize() for w in made[::9]]
    return " ".join(made) + ("." if closed else "")


class PageMaker:
    """Pages of random build, with the label of each block."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def _one(self, options: list[str]) -> str:
        return options[int(self.rng.integers(len(options)))]

    def _open(self, tags: list[str], names: list[str]) -> tuple[str, str]:
        tag = self._one(tags)
        name = self._one(names)
        return f'<{tag} {self._one(["class", "id"])}="{name}">' if name else f"<{tag}>", f"</{tag}>"

    def _lines(self, label: int, low: int, high: int, closed: bool, wrap: str = "p") -> list[tuple[str, int]]:
        return [(f"<{wrap}>{_words(self.rng, int(self.rng.integers(low, high)), closed)}", label) for _ in range(int(self.rng.integers(1, 4)))]

    def furniture(self, kind: str) -> list[tuple[str, int]]:
        """Opening mark-up and blocks, each with label 0; a label of -1 is mark-up only."""
        rng = self.rng
        if kind == "menu":
            a, b = self._open(["nav", "nav", "div", "ul"], ["menu", "nav", "navbar", "breadcrumb", ""]) if rng.random() < 0.7 else ("<nav>", "</nav>")
            links = [(f"<li><a href='/x'>{_words(rng, int(rng.integers(1, 4)), False)}</a></li>", 0) for _ in range(int(rng.integers(3, 8)))]
            return [(a + "<ul>", -1), *links, ("</ul>" + b, -1)]
        made = {
            "head": (["header", "div"], ["header", "masthead", "topbar"], self._lines(0, 1, 8, False, self._one(["p", "h1", "div"]))),
            "foot": (["footer", "footer", "div"], ["footer", "colophon", ""], [(f"&copy; {_words(rng, 3, False)} &middot; {_words(rng, int(rng.integers(3, 14)))}", 0)]),
            "side": (["aside", "div"], ["sidebar", "related", "widget"], self._lines(0, 3, 25, True)),
            "ad": (["div", "section", "aside"], ["ad", "advert", "sponsored", "promo", "ads"], [(_words(rng, int(rng.integers(4, 30))), 0)]),
            "notice": (["div", "section", "dialog"], ["cookie", "notice", "newsletter", "alert", "consent"], self._lines(0, 4, 30, True)),
            "comment": (["section", "div", "ul"], ["comments", "comment", "discussion", "replies"], self._lines(0, 4, 50, True)),
            "form": (["form"], ["search", "login", "contact", ""], [(f"<label>{_words(rng, 2, False)}</label><input name='q'>", 0), (f"<button>{_words(rng, 1, False)}</button>", 0)]),
            "share": (["div", "p"], ["share", "social", "byline"], [(f"<a href='#'>{_words(rng, 2, False)}</a>", 0)]),
        }[kind]
        a, b = self._open(made[0], made[1] if kind not in ("foot",) else made[1])
        if a in ("<div>", "<ul>", "<section>"):
            a = a[:-1] + f' class="{made[1][0]}">'
        return [(a, -1), *made[2], (b, -1)]

    def plain(self) -> tuple[str, list[int]]:
        """A page that is nothing but its text."""
        some = self._lines(1, 1, 40, True) if self.rng.random() < 0.7 else [(_words(self.rng, int(self.rng.integers(1, 40)), False), 1)]
        return "".join(p for p, _ in some), [y for _, y in some]

    def page(self) -> tuple[str, list[int]]:
        rng = self.rng
        if rng.random() < 0.05:
            return self.plain()
        parts: list[tuple[str, int]] = [("<!DOCTYPE html><html><head><meta charset='utf-8'>", -1), (f"<title>{_words(rng, 6, False)}</title>", 0), ("</head><body>", -1)]
        for kind in ("notice", "head", "menu", "form", "ad", "side"):
            if rng.random() < 0.55:
                parts += self.furniture(kind)
        open_, close = self._open(["article", "article", "main", "div", "section", "div"], ["content", "post", "entry", "article", "main", "story", "", ""])
        if open_ in ("<div>", "<section>") and rng.random() < 0.7:
            open_, close = "<article>", "</article>"
        bare = rng.random() < 0.1
        if bare:
            open_ = close = ""
        outer = ("<main>", "</main>") if rng.random() < 0.3 and not bare else ("", "")
        # some pages have their paragraphs in plain containers
        leaf = self._one(["div", "section", "p"]) if rng.random() < 0.2 else "p"
        parts.append((outer[0] + open_, -1))
        if rng.random() < 0.85:
            parts.append((f"<h1>{_words(rng, int(rng.integers(3, 14)), False)}</h1>", 1))
        for _ in range(int(rng.integers(1, 10))):
            what = rng.random()
            if what < 0.66:
                text = _words(rng, int(rng.integers(1, 12) if rng.random() < 0.35 else rng.integers(12, 90)), rng.random() < 0.8)
                if rng.random() < 0.2:
                    text = f"<b>{text}</b>" if rng.random() < 0.5 else f"{text} <a href='/y'>{_words(rng, 2, False)}</a> {_words(rng, 4)}"
                parts.append((f"<{leaf}>{text}" + (self._one(["</p>", "</p>", ""]) if leaf == "p" else f"</{leaf}>"), 1))
            elif what < 0.73:
                parts.append((f"<h2>{_words(rng, int(rng.integers(1, 8)), False)}</h2>", 1))
            elif what < 0.79:
                parts += [("<ul>", -1), *[(f"<li>{_words(rng, int(rng.integers(2, 15)), rng.random() < 0.5)}</li>", 1) for _ in range(int(rng.integers(2, 5)))], ("</ul>", -1)]
            elif what < 0.83:
                parts.append((self._one(["<blockquote>", "<pre>", "<blockquote>"]) + _words(rng, int(rng.integers(5, 40))) + self._one(["</blockquote>", "</pre>"]), 1))
            else:
                parts += self.furniture(self._one(["ad", "share", "side", "form", "notice"]))
        if rng.random() < 0.25:
            parts += self.furniture("comment")
        parts.append((close + outer[1], -1))
        for kind in ("comment", "side", "ad", "form", "menu", "foot", "notice"):
            if rng.random() < (0.85 if kind == "foot" else 0.35):
                parts += self.furniture(kind)
        parts.append(("</body></html>", -1))
        return "".join(p for p, _ in parts), [y for p, y in parts if y >= 0]


def labelled_pages(count: int = LABELLED_PAGES, seed: int = SEED) -> list[tuple[list[list[str]], list[int]]]:
    """Block features and labels of pages whose blocks are found again one by one."""
    maker, out = PageMaker(seed), []
    while len(out) < count:
        html, labels = maker.page()
        found = blocks(html)
        if len(found) != len(labels):
            raise AssertionError("a block of a made page was not found again")
        out.append(([b.features for b in found], labels))
    return out


@dataclass
class ChainModel:
    """Weights per feature and state, and per pair of neighbouring states."""

    features: dict[str, int]
    state: np.ndarray
    pair: np.ndarray
    first: np.ndarray

    def unary(self, pages: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (page, block, state), padded, and the number of blocks of each page."""
        sizes = np.array([len(p) for p in pages])
        out = np.zeros((len(pages), max(1, sizes.max(initial=0)), 2))
        for i, page in enumerate(pages):
            for t, names in enumerate(page):
                out[i, t] = self.state[[k for k in map(self.features.get, names) if k is not None]].sum(axis=0)
        return out, sizes

    def decode(self, pages: list[list[list[str]]]) -> list[np.ndarray]:
        """The most probable labels of each page (Viterbi)."""
        u, sizes = self.unary(pages)
        n, longest = u.shape[:2]
        best = u[:, 0] + self.first
        back = np.zeros((n, longest, 2), np.int8)
        scores = np.zeros((n, longest, 2))
        scores[:, 0] = best
        for t in range(1, longest):
            step = best[:, :, None] + self.pair[None]
            back[:, t] = step.argmax(axis=1)
            best = step.max(axis=1) + u[:, t]
            scores[:, t] = best
        out = []
        for i, size in enumerate(sizes):
            labels = np.zeros(size, np.int8)
            if size:
                labels[-1] = scores[i, size - 1].argmax()
                for t in range(size - 1, 0, -1):
                    labels[t - 1] = back[i, t, labels[t]]
            out.append(labels)
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS) -> ChainModel:
    names = sorted({f for page, _ in pages for block in page for f in block})
    index = {f: k for k, f in enumerate(names)}
    sizes = np.array([len(y) for _, y in pages])
    n, longest = len(pages), int(sizes.max())
    x = np.zeros((n, longest, len(names)))
    y = np.zeros((n, longest, 2))
    live = np.arange(longest)[None] < sizes[:, None]
    for i, (page, labels) in enumerate(pages):
        for t, (block, label) in enumerate(zip(page, labels, strict=True)):
            x[i, t, [index[f] for f in block]] = 1
            y[i, t, label] = 1
    flat = x.reshape(-1, len(names))
    both = live[:, 1:, None, None]
    seen_pairs = (y[:, :-1, :, None] * y[:, 1:, None, :] * both).sum(axis=(0, 1))
    params = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)]
    first_moment, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        state, pair, first = params
        u = (flat @ state).reshape(n, longest, 2)
        forward, backward = np.zeros_like(u), np.zeros_like(u)
        forward[:, 0] = u[:, 0] + first
        for t in range(1, longest):
            forward[:, t] = _log_sum(forward[:, t - 1, :, None] + pair[None], 1) + u[:, t]
        for t in range(longest - 2, -1, -1):
            inner = _log_sum(pair[None] + (u[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(live[:, t + 1, None], inner, 0.0)
        total = _log_sum(forward[np.arange(n), sizes - 1], 1)
        p = np.exp(forward + backward - total[:, None, None]) * live[:, :, None]
        pairs = forward[:, :-1, :, None] + pair[None, None] + (u + backward)[:, 1:, None, :] - total[:, None, None, None]
        expected = (np.exp(np.where(both, pairs, -np.inf))).sum(axis=(0, 1))
        grads = [flat.T @ (p - y).reshape(-1, 2) / n + PENALTY * state, (expected - seen_pairs) / n + PENALTY * pair, (p[:, 0] - y[:, 0]).mean(axis=0)]
        for k, g in enumerate(grads):
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] = params[k] - STEP * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return ChainModel(index, *params)


def main_text(model: ChainModel, pages: list[str | None]) -> list[str]:
    found = [blocks(p or "") for p in pages]
    labels = model.decode([[b.features for b in page] for page in found]) if found else []
    return ["\n".join(b.text for b, y in zip(page, some, strict=True) if y) for page, some in zip(found, labels, strict=True)]


def _extractor(model: ChainModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                # pages of like size share a round of decoding
                pages = part.column(1).to_pylist()
                order = sorted(range(len(pages)), key=lambda i: len(pages[i] or ""))
                texts = [""] * len(pages)
                for a in range(0, len(order), 32):
                    some = order[a : a + 32]
                    for i, text in zip(some, main_text(model, [pages[i] for i in some]), strict=True):
                        texts[i] = text
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return run


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", model: ChainModel | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    model = model or train(labelled_pages())
    row = F.struct(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"))
    packed = pages.select(row.alias("row"), F.col(html_column).cast("string").alias("html"))
    out = packed.mapInArrow(_extractor(model), f"row {packed.schema['row'].dataType.simpleString()}, text string")
    return out.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
