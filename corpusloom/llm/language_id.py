"""Language identification by a blended-spectrum string kernel.

A text is the set of its distinct character n-grams, n = 1 to 4, over lower-cased letters with one
space for every stretch of anything else. The presence kernel of two texts is the number of n-grams
they share over the root of the product of their set sizes. Landmark texts give the Nyström
approximation; one-versus-rest ridge regression is solved in its space. Its dual weights times the
landmarks' sets are one matrix, so a batch of texts is scored by one matrix product.

N-grams are held by a 24-bit hash, so the model has the same size for any corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_map, bounded, stash

#: Bounds of the labelled sample that the classifier is fitted on, landmarks included. Each language has an
#: equal part, one text at least, so beyond so many languages there are as many rows.
TRAIN_ROWS = 2400
#: Bytes of their texts at most.
TRAIN_BYTES = 64 << 20
LANDMARKS = 240
RIDGE = 1e-3
ORDERS = 4
BITS = 24

#: Texts that are scored by one matrix product; a row has as many columns as the landmarks have n-grams.
BLOCK = 12

UNDETERMINED = "und"
_SPACE = np.array([32], np.uint32)
_STEP, _SPREAD, _SHIFT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(32 - BITS)
_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _table:
        is_letter = np.zeros(0x110000, bool)
        is_letter[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _table.append(is_letter)
    return _table[0]


def ngram_ids(text: str) -> np.ndarray:
    """Hashes of all n-grams of a text, repeats included."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cps = np.concatenate([_SPACE, np.where(_letters()[cps], cps, np.uint32(32)), _SPACE])
    space = cps == 32
    keep = np.ones(len(cps), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    c = cps[keep]
    out, h = np.empty(ORDERS * len(c), np.uint32), np.uint32(0)
    at = 0
    for n in range(1, min(ORDERS, len(c)) + 1):
        h = h * _STEP + c if n == 1 else h[:-1] * _STEP + c[n - 1 :]
        out[at : at + len(h)] = (h * _SPREAD) >> _SHIFT
        at += len(h)
    return out[:at]


@dataclass
class Kernel:
    """languages; the n-gram ids that landmarks have; their weights, one column a language."""

    languages: list[str]
    ids: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row of regression values a text."""
        out = np.zeros((len(texts), len(self.languages)), np.float32)
        seen = np.zeros(1 << BITS, bool)
        for start in range(0, len(texts), BLOCK):
            part = texts[start : start + BLOCK]
            rows, size = np.empty((len(part), len(self.ids)), np.float32), np.empty((len(part), 1), np.float32)
            for i, t in enumerate(part):
                ids = np.sort(ngram_ids(t))
                seen[ids] = True
                rows[i], size[i] = seen[self.ids], 1 + np.count_nonzero(ids[1:] != ids[:-1])
                seen[ids] = False
            out[start : start + BLOCK] = rows @ self.weights / np.sqrt(np.maximum(size, 1))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (its share of the clipped regression values) of each text.

        Null texts, those without a letter, and all if nothing was learned: und with score 0.
        """
        langs, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        if not at:
            return langs, score
        values = np.clip(self.scores([texts[i] for i in at]), 1e-6, None)
        share = values / values.sum(axis=1, keepdims=True)
        for i, best, p in zip(at, values.argmax(axis=1), share.max(axis=1), strict=True):
            langs[i], score[i] = self.languages[best], float(min(1.0, p))
        return langs, score


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Kernel:
    """The kernel ridge classifier of a bounded labelled sample, on the driver; each language has a landmark."""
    names = sorted(set(langs))
    if not names:
        return Kernel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    y = np.array([names.index(x) for x in langs])
    sets = [np.unique(ngram_ids(t)) for t in texts]
    turn = np.zeros(len(y))  # each language gives landmarks in turn
    for c in range(len(names)):
        turn[y == c] = np.arange((y == c).sum())
    chosen = np.argsort(turn, kind="stable")[: max(landmarks, len(names))]
    ids = np.unique(np.concatenate([sets[i] for i in chosen]))

    def matrix(rows) -> np.ndarray:
        out = np.zeros((len(rows), len(ids)), np.float32)
        for i, s in enumerate(rows):
            place = np.minimum(np.searchsorted(ids, s), len(ids) - 1)
            out[i, place[ids[place] == s]] = 1 / np.sqrt(max(1, len(s)))
        return out

    base = matrix([sets[i] for i in chosen])
    k_mm = (base @ base.T).astype(np.float64)
    normal, right = ridge * len(y) * k_mm, np.zeros((len(chosen), len(names)))
    weight = 1 / np.bincount(y, minlength=len(names))[y]
    weight *= len(y) / weight.sum()
    for start in range(0, len(sets), 200):
        k = (matrix(sets[start : start + 200]) @ base.T).astype(np.float64)
        w = weight[start : start + 200, None]
        normal += k.T @ (w * k)
        right += k.T @ (w * np.eye(len(names))[y[start : start + 200]])
    alpha = np.linalg.solve(normal + 1e-8 * np.trace(normal) / len(chosen) * np.eye(len(chosen)), right)
    return Kernel(names, ids, np.ascontiguousarray(base.T @ alpha, dtype=np.float32))


def bucket(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def held_out():
    """Whether a row is never learned from; a row without doc_id isn't either."""
    return F.coalesce(bucket(5) == 0, F.lit(True))


def learn(docs: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Kernel:
    """Fit on a bounded sample: rows and size, in bytes, are the bounds for all languages together, shared evenly among them.

    Of each language rows are taken in the order of a hash, texts that alone are over a language's bytes after all others, until
    either bound is met; one text of each language is taken in any case.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = stash(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    quota = max(1, rows // max(1, counts.count()))
    chance = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    # Thinned to a little more than the quota before rows of a language are put in order.
    thin = known.select("doc_id", "lang", "text", chance.alias("chance")).join(bounded(counts), "lang").where(F.col("chance") * F.col("n") <= 1.5 * quota + 20)
    share, held = max(1, size // max(1, counts.count())), F.octet_length("text").cast("bigint")
    order = Window.partitionBy("lang").orderBy(F.when(held > share, held).otherwise(0), "chance", "doc_id", "text")
    places = {"place": F.row_number().over(order), "held": F.sum(held).over(order.rowsBetween(Window.unboundedPreceding, 0))}
    kept = thin.withColumns(places).where((F.col("place") <= quota) & (F.col("held") <= share) | (F.col("place") == 1)).select("doc_id", "lang", "text").collect()
    kept.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in kept], [r["lang"] for r in kept])


def annotate(docs: DataFrame, model: Kernel, name: str) -> DataFrame:
    """docs, all columns, with a struct of that name more: lang_pred and score of every whole text.

    Of languages with equal values the first in order is taken. A null text or one without a letter is und with score 0. Each row is scored alone: repeated rows
    get equal results, an empty table an empty one.
    """
    if name in docs.columns:
        raise ValueError(f"there is a column {name}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batch):
        langs, score = shared.value.predict(batch.column(at).to_pylist())
        found = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])
        return dict(zip(batch.schema.names, batch.columns, strict=True)) | {name: found}

    return arrow_map(docs, run, StructType([*docs.schema.fields, StructField(name, StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]))]))


def identify(docs: DataFrame, model: Kernel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text, as annotate() has them; other columns are not read."""
    found = annotate(docs.select("doc_id", "text"), model, "found")
    return found.select("doc_id", held_out().alias("held_out"), "found.lang_pred", "found.score")
