"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint keeps every shingle hash below 1 / SCALE of the hash range, and of a document with fewer
than FLOOR such hashes its FLOOR least ones, so that short documents keep all. Both can be told from the
fingerprints alone when documents are united, so fingerprints are mergeable. How far up a fingerprint
has every hash is its reach; two fingerprints are compared up to the lesser reach: the share of the one's
hashes there that the other also has estimates its containment, also for very unequal documents. It is
exact between documents of at most FLOOR shingles.

As a string: the scale, the number of distinct shingles, a digest of all of them, and the kept hashes,
sorted, 48 bits each, in base64.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, settle, shingles
from .ordering import boundaries, part_of, parts

SCALE = 4
FLOOR = 64
SHINGLE = 5
_DROP = np.uint64(16)  # of 64 bits, 48 stay
_WHOLE = (1 << 48) - 1
_BELOW = _WHOLE // SCALE


def _keep(hashes: np.ndarray) -> np.ndarray:
    """What a fingerprint keeps of sorted distinct hashes."""
    return hashes[: max(FLOOR, int(np.searchsorted(hashes, np.uint64(_BELOW), "right")))]


def _reach(n: int, kept: np.ndarray) -> int:
    """Up to which hash a fingerprint has all."""
    return _WHOLE if n <= len(kept) else max(_BELOW, int(kept[-1]))


class Sketch:
    """n distinct shingles, a digest of all, the kept hashes, and how far they reach."""

    def __init__(self, text: str):
        s = shingles(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()), SHINGLE)
        self.n = len(s)
        self.digest = int(mix(np.array([s.sum()], np.uint64))[0]) if len(s) else 0
        self.kept = _keep(np.unique(s >> _DROP))
        self.reach = _reach(self.n, self.kept)

    def __str__(self) -> str:
        six = np.ascontiguousarray(self.kept.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
        return f"{SCALE}:{self.n}:{self.digest:016x}:{base64.b64encode(six.tobytes()).decode()}"


def parse(fingerprint: str) -> tuple[int, int, np.ndarray]:
    """Number of shingles, digest and kept hashes of a fingerprint string."""
    _, n, digest, kept = fingerprint.split(":")
    six = np.frombuffer(base64.b64decode(kept), np.uint8).reshape(-1, 6)
    eight = np.zeros((len(six), 8), np.uint8)
    eight[:, :6] = six
    return int(n), int(digest, 16), eight.view("<u8").ravel().astype(np.uint64)


def merge(parts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, int]:
    """Kept hashes and reach of the union of documents, from their (n, kept hashes)."""
    reach = min((_reach(n, kept) for n, kept in parts), default=_WHOLE)
    both = np.unique(np.concatenate([np.zeros(0, np.uint64), *[kept for _, kept in parts]]))
    kept = _keep(both[both <= np.uint64(reach)])
    whole = reach == _WHOLE and len(kept) == len(both)
    return kept, _WHOLE if whole else max(_BELOW, int(kept[-1]) if len(kept) else 0)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's hashes that b has too; 0 if a has none."""
    return float(np.isin(a, b, assume_unique=True).mean()) if len(a) else 0.0


def containments(a: Sketch, b: Sketch) -> tuple[float, float]:
    """Estimated shares of a's shingles in b, and of b's in a. 1 for equal sets, empty ones too.

    0 if no hash of the one lies within the other's reach, as may be for a text of a few shingles and a long one.
    """
    if (a.n, a.digest) == (b.n, b.digest):
        return 1.0, 1.0
    reach = np.uint64(min(a.reach, b.reach))
    x, y = (s.kept[: np.searchsorted(s.kept, reach, "right")] for s in (a, b))
    return containment(x, y), containment(y, x)


def likeness(a: Sketch, b: Sketch) -> float:
    """The greater containment, so a part is like the whole."""
    return max(containments(a, b))


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as much of the following text's beginning."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m] if m else text


_SCHEMA = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, share_in_edited double, share_of_edited double, share_in_next double, share_of_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document: fingerprints of its whole text and of its edited text, and likenesses.

    near_ is the greater of share_in_ (of the text's shingles, those that the other has) and share_of_ (of
    the other's shingles, those that the text has).

    The edited text borrows from the next document in descending doc_id, which after the last is the
    first. Null texts count as empty. Null ids come last; rows with equal ids are ordered by text. An
    empty table gives an empty table; a lone document is its own next.

    Documents are dealt to partitions by id ranges, once. The first document of each range goes to the
    range above as well, so that each partition has the next document of its last one.
    """
    spark = docs.sparkSession
    settle(spark)
    n = parts(docs)
    cuts = boundaries(docs, n)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), part_of("doc_id", cuts).alias("part"))
    heads = {r["part"]: r["head"] for r in rows.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = sorted(heads)
    above = [(heads[p], order[(i + 1) % len(order)]) for i, p in enumerate(order)]  # one row for each partition
    small = spark.createDataFrame(above, f"head {kind}, above int")
    rows = rows.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("part").alias("p"), F.lit(0).alias("guest"))
    places = F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("above").alias("p"), F.lit(1).alias("guest"))))
    rows = rows.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.p", "at.guest")
    rows = rows.repartitionById(n, "p").sortWithinPartitions("p", "guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    out = spark.createDataFrame([], f"doc_id {kind}, {_SCHEMA}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document before, which waits for its next one
        done = None  # the part whose last document has got its next one
        for batch in batches:
            made = []
            for doc_id, text, part, guest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if guest and done == part:
                    continue
                sketch = Sketch(text)
                if held is not None:
                    made.append(_row(held, text, sketch))
                held = None if guest else (doc_id, text, sketch)
                done = part if guest else done
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(run, out)


def _row(held: tuple, following: str, next_sketch: Sketch) -> tuple:
    doc_id, text, sketch = held
    other = edited(text, following)
    theirs = Sketch(other) if other != text else sketch
    sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
    of_edited, of_next = containments(sketch, theirs), containments(sketch, next_sketch)
    return doc_id, len(text), sha, str(sketch), str(theirs), max(of_edited), max(of_next), *of_edited, *of_next
