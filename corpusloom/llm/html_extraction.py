"""Main text of web pages by a linear-chain conditional random field.

A page is the chain of its leaf blocks. Features of a block: its ancestors' tags and the words of
their class, id and role names, and its text's length, share of linked characters, punctuation, digits
and place. The field has two labels, article and other; weights are learned by gradient ascent on
the log-likelihood of labelled pages (forward-backward), pages are decoded by Viterbi.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map
from .dom import Block, blocks
from .page_corpus import labelled_pages

#: Labelled pages and steps of training.
TRAIN_PAGES = 500
STEPS = 160
_END = re.compile(r"[.!?…:;\"'»”)]$")


def own_features(chain: list[Block]) -> list[list[str]]:
    """Names of each block's binary features, those of its ancestors aside."""
    out = []
    for i, b in enumerate(chain):
        n, words = len(b.text), b.text.count(" ") + 1
        f = ["1", f"tag={b.node.tag if b.node else ''}", f"long={min(6, words.bit_length())}", f"linked={min(4, int(4 * b.linked / n))}"]
        f.append("end" if _END.search(b.text) else "no end")
        if "©" in b.text:
            f.append("(c)")
        if i == 0:
            f.append("first")
        if i == len(chain) - 1:
            f.append("last")
        if i and chain[i - 1].node:
            f.append(f"before={chain[i - 1].node.tag}")
        out.append(f)
    return out


def features(chain: list[Block]) -> list[list[str]]:
    """Names of all of each block's features, for training: its ancestors' tags and names each once."""
    out = own_features(chain)
    for f, b in zip(out, chain, strict=True):
        node = b.node
        while node:
            f += node.fresh
            node = node.parent
    return out


@dataclass
class Field:
    """Weights of features (by label), of neighbouring labels and of the first label."""

    index: dict[str, int]
    weight: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def scores(self, chain: list[Block]) -> list[tuple[float, float]]:
        """Each block's score of either label. What an element adds to its ancestors is looked up once for all its blocks."""
        index, pairs = self.index, self.pairs()
        of_node: dict[int, tuple[float, float]] = {}

        def total(names, x: float, y: float) -> tuple[float, float]:
            for name in names:
                if (i := index.get(name)) is not None:
                    x, y = x + pairs[i][0], y + pairs[i][1]
            return x, y

        out = []
        for f, b in zip(own_features(chain), chain, strict=True):
            path, node = [], b.node
            while node and id(node) not in of_node:
                path.append(node)
                node = node.parent
            score = of_node[id(node)] if node else (0.0, 0.0)
            for n in reversed(path):
                score = of_node[id(n)] = total(n.fresh, *score)
            out.append(total(f, *score))
        return out

    def pairs(self) -> list[list[float]]:
        """The weights as plain numbers."""
        if not hasattr(self, "_pairs"):
            self._pairs = self.weight.tolist()
        return self._pairs

    def decode(self, chain: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks."""
        if not chain:
            return []
        scores = self.scores(chain)
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = float(self.first[0]) + scores[0][0], float(self.first[1]) + scores[0][1]
        back = []
        for s0, s1 in scores[1:]:
            x0, y0, x1, y1 = a + m00, b + m10, a + m01, b + m11
            back.append((y0 > x0, y1 > x1))
            a, b = max(x0, y0) + s0, max(x1, y1) + s1
        label = bool(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[Block], list[bool]]], steps: int = STEPS, decay: float = 2e-3) -> Field:
    """Weights of greatest penalized likelihood; all pages take part in each step, side by side."""
    pages = [(c, y) for c, y in pages if c]
    named = [features(c) for c, _ in pages]
    index = {x: i for i, x in enumerate(sorted({x for page in named for f in page for x in f}))}
    n, longest = len(pages), max(len(c) for c, _ in pages)
    mask = np.zeros((n, longest))
    gold = np.zeros((n, longest), int)
    at_page, at_block, at_feature = [], [], []
    for p, (page, (_, y)) in enumerate(zip(named, pages, strict=True)):
        mask[p, : len(page)] = 1
        gold[p, : len(page)] = y
        for t, f in enumerate(page):
            at_page += [p] * len(f)
            at_block += [t] * len(f)
            at_feature += [index[x] for x in f]
    at_page, at_block, at_feature = map(np.array, (at_page, at_block, at_feature))
    w, move, first = np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)
    moment = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, move, first)]
    onehot = np.eye(2)[gold] * mask[:, :, None]
    for step in range(1, steps + 1):
        score = np.zeros((n, longest, 2))
        np.add.at(score, (at_page, at_block), w[at_feature])
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = first + score[:, 0]
        for t in range(1, longest):
            new = _logsum(alpha[:, t - 1, :, None] + move, 1) + score[:, t]
            alpha[:, t] = np.where(mask[:, t, None] > 0, new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _logsum(move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
        z = _logsum(alpha[:, -1], 1)
        prob = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mask[:, :, None]
        pair = np.exp(np.minimum(alpha[:, :-1, :, None] + move + (score + beta)[:, 1:, None, :] - z[:, None, None, None], 0)) * mask[:, 1:, None, None]
        seen = np.einsum("pti,ptj->ij", onehot[:, :-1], onehot[:, 1:])
        gw = np.zeros_like(w)
        np.add.at(gw, at_feature, (onehot - prob)[at_page, at_block])
        grads = (gw - decay * n * w, seen - pair.sum(axis=(0, 1)) - decay * n * move, (onehot - prob)[:, 0].sum(axis=0))
        for x, g, (m, v) in zip((w, move, first), grads, moment, strict=True):  # Adam
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(index, w, move, first)


@lru_cache(maxsize=1)
def field(n: int = TRAIN_PAGES) -> Field:
    """The field of the drawn labelled pages; pages whose blocks and marks don't agree are left out."""
    chains = [(blocks(p), y) for p, y in labelled_pages(n)]
    return train([(c, y) for c, y in chains if len(c) == len(y)])


def main_text(page: str | None, model: Field) -> str:
    """The article's blocks, one a line."""
    chain = blocks(page)
    return "\n".join(b.text for b, keep in zip(chain, model.decode(chain), strict=True) if keep)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every whole page.

    Null and empty pages, and those without an article, give an empty text of 0 characters. Null ids
    and urls stay null, repeated rows stay, an empty table gives an empty one; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or field())
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batch):
        texts = [main_text(p, shared.value) for p in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(pages.select("page_id", "url", "html"), run, f"{kinds}, text string, n_chars bigint")
