"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Each leaf block is a position of the chain and its label is main text or not.
Features are the tags and names of ancestors and marks of the text itself;
neighbouring labels have a weight each.  The weights maximise the penalised
conditional likelihood of labelled pages (forward-backward in log space over
all pages at once, Adam), and Viterbi decodes a page.

The labelled pages are generated (TRAIN_PAGES of them, from a fixed seed):
articles inside containers of many kinds, among menus, headers, footers,
sidebars, notices, adverts, forms and reader comments.  No page of a table is
used for fitting, and every page is scored whole.

Defined results: null, empty and text-free pages give no text; blocks of
hidden elements and noscript are not text; broken and deep pages are scanned
once (html_blocks); repeated pages are extracted each; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, need
from .html_blocks import Block, Element, leaf_blocks

TRAIN_PAGES, STEPS, RATE, PENALTY, SEED = 480, 160, 0.08, 0.02, 4711


def element_features(e: Element) -> list[str]:
    """The features that a block has from the element that owns it."""
    f = [f"tag:{t}" for t in sorted(e.tags)]
    if e.tag:
        f.append(f"near:{e.tag}")
    held = e.holder
    f += [f"held:{held.tag if held else ''}", *(f"heldname:{w}" for w in sorted(set(held.names if held else ())))]
    f += [f"name:{w}" for w in sorted(e.all_names)]
    near, k = set(), e
    for _ in range(3):
        if k is not None:
            near.update(k.names)
            k = k.parent
    return f + [f"nearname:{w}" for w in sorted(near)]


def text_features(b: Block) -> list[str]:
    n, text = len(b.text), b.text
    words = text.count(" ") + 1
    share = b.linked / n
    f = ["bias", f"words:{min(6, words.bit_length())}"]
    f.append("links:" + ("none" if not b.linked else "all" if share > 0.9 else "many" if share > 0.4 else "few"))
    f.append("ends:" + ("stop" if text[-1] in ".!?…\"”»:" else "other"))
    if "©" in text or "(c)" in text.lower():
        f.append("copyright")
    if sum(map(str.isdigit, text)) * 5 > n:
        f.append("digits")
    if "|" in text or "»" in text or "·" in text:
        f.append("bars")
    return f


def block_features(blocks: list[Block]) -> list[list[str]]:
    """The names of the features that hold at each block."""
    return [text_features(b) + element_features(b.owner) for b in blocks]


# ------------------------------------------------------------------ labelled pages

_NOT_MAIN = {
    "nav": ["", "menu", "navbar", "breadcrumb"],
    "header": ["", "site-header", "masthead", "top"],
    "footer": ["", "site-footer", "page-footer", "legal"],
    "aside": ["", "sidebar", "related", "widget"],
    "form": ["", "search", "newsletter", "login", "subscribe"],
    "div": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "sidebar", "notice", "cookie", "cookie-banner", "consent", "alert", "comments", "comment", "comment-list", "menu", "nav", "breadcrumbs", "related", "share", "social", "newsletter", "popup", "modal", "footer", "header", "widget", "toolbar", "pagination", "tags", "reader-comments", "respond", "replies"],
    "section": ["comments", "related", "newsletter", "sidebar", "comments-area", "promo", "ads", "notice"],
    "ul": ["menu", "nav", "tags", "share", "pagination", "comments", "breadcrumb"],
}
_MAIN = [("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("div", "post"), ("section", "article"), ("div", "main"), ("div", "story"), ("div", "text")]


class _Pages:
    """Generated pages; texts of main blocks carry a mark that labels them and is taken off again."""

    mark = "\ue000"

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.vocabulary = ["".join(self.r.choice(["ta", "re", "mi", "so", "lu", "ne", "ka", "or", "en", "th", "is", "é", "ung"]) for _ in range(self.r.randint(1, 4))) for _ in range(700)]

    def words(self, least: int, most: int, stop: bool = True) -> str:
        w = [self.r.choice(self.vocabulary) for _ in range(self.r.randint(least, most))]
        s = " ".join(w).capitalize()
        if self.r.random() < 0.08:
            s += self.r.choice([" &amp;", "!!", " ###", " | " + w[0], " 2024", "%%%", " &copy;"])
        return s + ("." if stop and self.r.random() < 0.85 else "")

    def opened(self, tag: str, name: str) -> str:
        if not name:
            return f"<{tag}>"
        return f'<{tag} {self.r.choice(["class", "class", "id"])}="{name}">'

    def links(self) -> str:
        item = self.r.choice(["li", "li", "span", "p"])
        some = "".join(f'<{item}><a href="/x">{self.words(1, 3, False)}</a></{item}>' for _ in range(self.r.randint(1, 7)))
        return f"<ul>{some}</ul>" if item == "li" else some

    def other(self, among: list[str] | None = None) -> str:
        tag = self.r.choice(among or list(_NOT_MAIN) + ["div", "div", "div"])
        name = self.r.choice(_NOT_MAIN[tag])
        kind = self.r.random()
        if tag == "form":
            body = f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2, False)}</button>"
        elif tag in ("nav", "ul") or kind < 0.3:
            body = self.links()
        elif kind < 0.65:
            body = self.words(1, 16)
        else:
            body = "".join(f"<p>{self.words(2, 45)}</p>" for _ in range(self.r.randint(1, 3)))
        if tag == "ul":
            body = "".join(f"<li>{self.words(1, 25)}</li>" for _ in range(self.r.randint(1, 5))) if kind > 0.6 else body
        if tag == "footer" and kind < 0.7:
            body = f"&copy; {self.words(1, 2, False)} &middot; {self.words(2, 10)}"
        return f"{self.opened(tag, name)}{body}</{tag}>"

    def main(self) -> str:
        kind, m, r = self.r.random(), self.mark, self.r
        if kind < 0.70:
            body = self.words(1, 12 if r.random() < 0.4 else 110)
            if r.random() < 0.2:
                body = f"<b>{body}<br>" if r.random() < 0.5 else f"<b>{body}</b> {self.words(1, 20)}"
            if r.random() < 0.12:
                body += f' <a href="/y">{self.words(1, 4, False)}</a> {self.words(1, 9)}'
            return f"<p>{m}{body}" + ("</p>" if r.random() < 0.9 else "")
        if kind < 0.80:
            h = r.choice(["h2", "h3"])
            return f"<{h}>{m}{self.words(1, 9, False)}</{h}>"
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{m}{self.words(1, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{m}{self.words(5, 40)}</blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{m}{self.words(1, 4)}</td><td>{m}{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<pre>{m}{self.words(3, 20)}</pre>"

    def page(self) -> str:
        r = self.r
        tag, name = r.choice(_MAIN + [("article", "")] * 6)
        inside = [f"<h1>{self.mark}{self.words(1, 12, False)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
            inside.append(self.main())
            if r.random() < 0.25:
                inside.append(self.other(["div", "div", "div", "aside", "form", "ul", "section", "nav", "footer"]))
        before = [self.other(["nav", "header", "div", "ul", "form", "div"]) for _ in range(r.randint(0, 3))]
        after = [self.other(["footer", "aside", "div", "section", "form", "nav"]) for _ in range(r.randint(0, 3))]
        body = "".join(before) + f"{self.opened(tag, name)}{''.join(inside)}</{tag}>" + "".join(after)
        if r.random() < 0.3:
            body = f'<div {r.choice(["class", "id"])}="{r.choice(["wrapper", "page", "container", "site"])}">{body}</div>'
        return f"<html><head><title>{self.words(1, 8)}</title></head><body>{body}</body></html>"

    def labelled(self) -> tuple[list[Block], list[int]]:
        blocks = leaf_blocks(self.page())
        labels = [int(self.mark in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(self.mark, "") or "."
        return blocks, labels


# ------------------------------------------------------------------ the field


class Crf:
    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray, begin: np.ndarray):
        self.names, self.weights, self.moves, self.begin = names, weights, moves, begin

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most probable labels of a page's blocks."""
        if not blocks:
            return []
        at, w = self.names.get, self.weights
        score = lambda f: sum(w[k] for n in f if (k := at(n)) is not None)
        state = []
        for b in blocks:
            if b.owner.known is None or b.owner.known[0] is not self:  # once for all blocks of an element
                b.owner.known = self, score(element_features(b.owner))
            state.append(score(text_features(b)) + b.owner.known[1])
        # label 0 scores 0 at each block, label 1 scores state
        (m00, m01), (m10, m11) = self.moves
        a, b, back = self.begin[0], self.begin[1] + state[0], []
        for s in state[1:]:
            back.append((a + m00 < b + m10, a + m01 < b + m11))
            a, b = max(a + m00, b + m10), max(a + m01, b + m11) + s
        out = [int(b > a)]
        for pair in reversed(back):
            out.append(int(pair[out[-1]]))
        return out[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Crf:
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    listed = [[[names.setdefault(n, len(names)) for n in f] for f in block_features(b)] for b, _ in pages]
    most = max(len(b) for b, _ in pages)
    x = np.zeros((len(pages), most, len(names)), np.float32)
    y, here = np.zeros((len(pages), most), int), np.zeros((len(pages), most), bool)
    for i, (page, (_, labels)) in enumerate(zip(listed, pages)):
        for j, f in enumerate(page):
            x[i, j, f] = 1
            y[i, j], here[i, j] = labels[j], True
    flat = x[here]
    size = len(names)
    theta = np.zeros(size + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    follow = here[:, 1:]
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (y[:, :-1][follow], y[:, 1:][follow]), 1)
    seen_begin = np.bincount(y[:, 0], minlength=2).astype(float)
    for step in range(1, steps + 1):
        w, moves, begin = theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        s = np.zeros((len(pages), most, 2))
        s[here, 1] = flat @ w
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        forward[:, 0] = s[:, 0] + begin
        for t in range(1, most):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + s[:, t]
            forward[:, t] = np.where(here[:, t, None], new, forward[:, t - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        for t in range(most - 2, -1, -1):
            new = np.logaddexp.reduce(moves + (s[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(here[:, t + 1, None], new, 0)
        p = np.exp(forward + backward - total[:, None, None])
        pair = np.exp(forward[:, :-1, :, None] + moves + (s + backward)[:, 1:, None, :] - total[:, None, None, None])
        g = np.concatenate([flat.T @ (y[here] - p[here][:, 1]), (seen_moves - pair[follow].sum(axis=0)).ravel(), seen_begin - p[:, 0].sum(axis=0)])
        g = g / len(pages) - penalty * theta / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(names, theta[:size].copy(), theta[size : size + 4].reshape(2, 2).copy(), theta[size + 4 :].copy())


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    made = _Pages(seed)
    return [made.labelled() for _ in range(n)]


@lru_cache(1)
def trained() -> Crf:
    return fit(labelled_pages())


def main_text(page: str | None, crf: Crf) -> str:
    blocks = [b for b in leaf_blocks(page) if not b.hidden]
    return "\n\n".join(b.text for b, keep in zip(blocks, crf.decode(blocks)) if keep)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    need(pages, "page_id", "url", "html")
    crf = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), crf) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
