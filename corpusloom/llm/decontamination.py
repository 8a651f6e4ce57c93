"""Benchmark decontamination by winnowing.

Words are maximal runs of ASCII letters (lower-cased) and digits and of all non-ASCII characters.
The least hash of every WINDOW consecutive K-grams is a fingerprint, so two texts that share
K + WINDOW - 1 = 13 words share a fingerprint at the same place of those words. Fingerprints of documents
and benchmark items are joined, and each match is extended to the spans of 13 words around it that both
sides have. An item of fewer words is one window of its own: all of it must occur.

A span is looked up once, whatever number of matches lie in it and of items have it, so repetitive texts
take time in proportion to their length.

The join: the benchmark's fingerprints go to every task if its texts have at most ITEM_BYTES. A larger
benchmark is joined by Spark, first on fingerprints, then on the spans' words.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, arrow_map, stash

SPAN = 13
K = 7
WINDOW = SPAN - K + 1
#: Bytes of benchmark texts up to which items are broadcast.
ITEM_BYTES = 8 << 20
#: A document is contaminated if one in so many of its words is hit.
ONE_IN = 20

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes; null has none."""
    return _WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Positions of the least hash (rightmost among equals) in each window; all of a shorter text's least."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    if n <= WINDOW:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    at = WINDOW - 1 - np.argmin(views[:, ::-1], axis=1) + np.arange(n - WINDOW + 1)
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    return at[keep]


def around(grams: np.ndarray, known: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the spans of SPAN words that hold a fingerprint which is among the known, sorted, hashes."""
    at = winnow(grams)
    if not len(known) or not len(at):
        return np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
    at = at[known[place] == grams[at]]
    starts = (at[:, None] - np.arange(WINDOW)).ravel()
    return np.unique(starts[(starts >= 0) & (starts + SPAN <= n_words)])


class Items:
    """Fingerprints of benchmark items, and their windows by length: hash, item and place, sorted by hash.

    An item's equal windows are one.
    """

    def __init__(self, items: list[tuple[object, str | None]]):
        self.words = [(None if i is None else str(i), words_of(t)) for i, t in items]
        self.words = [(i, w) for i, w in self.words if w]
        prints, found = [np.zeros(0, np.uint64)], {}
        for n, (_, w) in enumerate(self.words):
            rolling = Rolling(b" ".join(w))
            k = min(SPAN, len(w))
            if k == SPAN:
                grams = rolling.grams(K)
                prints.append(grams[winnow(grams)])
            spans, place = np.unique(rolling.grams(k), return_index=True)
            found.setdefault(k, []).append((spans, np.full(len(spans), n, np.int32), place.astype(np.int32)))
        self.prints = np.unique(np.concatenate(prints))
        self.spans = {}
        for k, rows in sorted(found.items()):
            spans, item, place = (np.concatenate(c) for c in zip(*rows, strict=True))
            order = np.argsort(spans, kind="stable")
            self.spans[k] = (spans[order], item[order], place[order])

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words of a text are hit, and the items whose windows occur; items without an id hit but aren't named."""
        if not words:
            return None, set()
        rolling = Rolling(b" ".join(words))
        edges, seen = None, None
        for k, (spans, item, place) in self.spans.items():
            if k > len(words):
                continue
            grams = rolling.grams(k)
            starts = around(rolling.grams(K), self.prints, len(words)) if k == SPAN else np.arange(len(grams))
            lo, hi = np.searchsorted(spans, grams[starts], "left"), np.searchsorted(spans, grams[starts], "right")
            for at in np.flatnonzero(hi > lo).tolist():
                p, some = int(starts[at]), slice(lo[at], hi[at])
                if edges is None:
                    edges, seen = np.zeros(len(words) + 1, np.int32), np.zeros(len(self.words), bool)
                new, hit = ~seen[item[some]], False
                # An item that was met before needs no further look but one, for the hit.
                for n, q in [*zip(item[some][new].tolist(), place[some][new].tolist(), strict=True), *zip(item[some][~new][:1].tolist(), place[some][~new][:1].tolist(), strict=True)]:
                    if words[p : p + k] == self.words[n][1][q : q + k]:
                        seen[n] = hit = True
                if hit:
                    edges[p] += 1
                    edges[p + k] -= 1
        if seen is None or not seen.any():
            return None, set()
        return np.cumsum(edges[:-1]) > 0, {i for i, _ in (self.words[n] for n in np.flatnonzero(seen)) if i is not None}


def _result(text: str | None, items: Items) -> tuple[int, int, list[str]]:
    words = words_of(text)
    hit, which = items.hits(words)
    return len(words), 0 if hit is None else int(hit.sum()), sorted(which)


_KINDS = "n_words bigint, n_hit bigint, item_ids array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs' doc_id with n_words, n_hit, item_ids (sorted as strings) and contaminated.

    Null texts have no words and aren't contaminated; items without words never occur; repeated items
    each count by their id, equal ids as one, and items without an id hit words but aren't named.
    Repeated documents get equal rows, an empty table none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)) + 50)).first()[0] or 0
    if size <= item_bytes:
        items = docs.sparkSession.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").collect()]))

        def run(batch):
            got = [_result(t, items.value) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "n_words": [g[0] for g in got], "n_hit": [g[1] for g in got], "item_ids": [g[2] for g in got]}

        found = arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, {_KINDS}")
    else:
        found = _joined(docs, benchmark, kind)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words")))


def _joined(docs: DataFrame, benchmark: DataFrame, kind: str) -> DataFrame:
    """The same for a benchmark of any size, by joins on fingerprints and on the words of spans.

    Only fingerprints of documents, 8 bytes each with a row number, are shuffled whole; spans are taken
    from documents that share a fingerprint, around those. Spans of a short item's length are taken from
    all documents.
    """
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")

    def windows(batch):
        prints, spans = [], []
        for t in batch.column(1).to_pylist():
            w = words_of(t)
            g = Rolling(b" ".join(w)).grams(K) if len(w) >= SPAN else np.zeros(0, np.uint64)
            prints.append(np.unique(g[winnow(g)]).view(np.int64).tolist())
            k = min(SPAN, len(w))
            spans.append(list({b" ".join(w[p : p + k]) for p in range(len(w) - k + 1)}) if w else [])
        return {"item_id": batch.column(0), "prints": prints, "spans": spans}

    keyed = stash(arrow_map(bench, windows, "item_id string, prints array<bigint>, spans array<binary>"), "item-windows")
    prints = keyed.select(F.explode("prints").alias("print")).distinct()
    spans = keyed.select("item_id", F.explode("spans").alias("span")).distinct()
    n_words = F.size(F.split(F.col("span").cast("string"), " "))
    lengths = sorted(r["n"] for r in spans.select(n_words.alias("n")).distinct().where(f"n < {SPAN}").collect())  # at most 12
    rows = stash(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")

    def doc_prints(batch):
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        grams = [Rolling(b" ".join(w)).grams(K) if len(w) >= SPAN else np.zeros(0, np.uint64) for w in words]
        return {"row": batch.column(0), "n_words": [len(w) for w in words], "prints": [np.unique(g[winnow(g)]).view(np.int64).tolist() for g in grams]}

    sketches = stash(arrow_map(rows.select("row", "text"), doc_prints, "row bigint, n_words bigint, prints array<bigint>"), "doc-prints")
    matched = sketches.select("row", F.explode("prints").alias("print")).join(prints, "print").groupBy("row").agg(F.collect_set("print").alias("known"))
    of_text = rows.select("row", "text").join(matched, "row", "left" if lengths else "inner")

    def doc_spans(batch):
        at, names = [], []
        for t, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            w = words_of(t)
            starts = {SPAN: around(Rolling(b" ".join(w)).grams(K), np.sort(np.array(known, np.int64).view(np.uint64)), len(w)).tolist() if known else []}
            starts |= {k: range(len(w) - k + 1) for k in lengths}
            at.append([p for k in starts for p in starts[k]])
            names.append([b" ".join(w[p : p + k]) for k in starts for p in starts[k]])
        return {"row": batch.column(0), "at": at, "spans": names}

    of_doc = arrow_map(of_text, doc_spans, "row bigint, at array<int>, spans array<binary>")
    of_doc = of_doc.select("row", F.explode(F.arrays_zip("at", "spans")).alias("x")).select("row", "x.at", F.col("x.spans").alias("span"))
    hits = stash(of_doc.join(spans.select("span").distinct(), "span", "left_semi"), "spans")
    of_items = hits.select("row", "span").distinct().join(spans.where("item_id is not null"), "span")
    names = of_items.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    # Hit words by the edges of spans: where their running number is above 0, a word is hit.
    reach = hits.select("row", "at", (F.col("at") + n_words).alias("end")).groupBy("row", "at").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("end") - F.greatest("at", F.coalesce("before", F.lit(0)))
    n_hit = reach.withColumn("before", before).groupBy("row").agg(F.sum(F.greatest(new, F.lit(0))).alias("n_hit"))
    out = rows.select("row", "doc_id").join(sketches.select("row", "n_words"), "row").join(n_hit, "row", "left").join(names, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def digests(found: DataFrame) -> DataFrame:
    """The query's columns: item ids as their number and a digest."""
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def sha256_of(items: list[str]) -> str:
    """What digests() gives for a list of ids, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
