"""Vector compression by product codes, learned and assigned in exact integers.

A vector's components become integers (floor of 256 times the value) and are cut into equal parts; each part is
replaced by the index of the nearest entry of its position's codebook. Nearest entries are found by screening: one
float32 matrix product gives all distances of a batch (less the part's own square, which all entries share) with
a bound on their rounding error. Only entries whose interval reaches down to the least upper end can be nearest;
those are evaluated again in int64, and ties go to the lower index. So the codes are exact, and alike on every processor.

The bound. With u = 2^-24 and K components a part, |c|^2 - 2 x.c is computed from K + 1 products whose factors are
rounded once each: every term passes at most K + 3 roundings, in whatever order the product adds them, so the error is
at most g (|c|^2 + 2 |x||c|) with g = (K + 3) u / (1 - (K + 3) u), by Cauchy and Schwarz. The code takes K + 8.

Codebooks are improved by rounds over all vectors: each task adds up its parts by entry, Spark adds the tasks' sums, and
the new entries, a table of fixed size, go back to the tasks. Sums are carried in limbs of 40 bits, so they can't
overflow. Components too large for int64 distances take the same way with Python's integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import join_counted, stash

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a limb of sums.
LIMB = 40
_U = 2.0**-24


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE x) of finite values: int64 where all fit well, else Python's integers."""
    x = vectors.astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)  # times a power of 2: exact, or too large
    if not scaled.size or np.abs(scaled).max() < 2.0**60:
        return scaled.astype(np.int64)
    return np.frompyfunc(lambda v: math.floor(v * SCALE) if abs(v) < 2.0**1000 else int(v) * SCALE, 1, 1)(x)


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether squared distances of a's and b's rows fit in int64."""
    if a.dtype == object or b.dtype == object:
        return False
    return 4 * max(1, a.shape[1]) * max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0))) ** 2 < 1 << 63


def candidates(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries may be nearest to each part, by float32 products and their error bounds. The nearest always are."""
    a, c = x.astype(np.float32), entries.astype(np.float32)
    square = np.square(entries.astype(np.float64)).sum(1)
    with np.errstate(over="ignore", invalid="ignore"):
        rough = (a @ (c.T * np.float32(-2)) + np.square(c).sum(1)).astype(np.float64)
        length = np.sqrt(np.square(x.astype(np.float64)).sum(1))
        k = (x.shape[1] + 8) * _U
        slack = (k / (1 - k)) * (square + 2 * length[:, None] * np.sqrt(square)) * (1 + 1e-9)
        low, high = rough - slack, rough + slack
        may = low <= np.nanmin(np.where(np.isfinite(high), high, np.inf), axis=1)[:, None]
    return may | ~np.isfinite(low) | ~np.isfinite(high)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and exact squared distance of the entry nearest to each part; of equals the lower index."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not _fits(x, entries):
        x, entries = x.astype(object), entries.astype(object)
        d = np.stack([np.square(x - e).sum(1) for e in entries], 1)
        best = np.array([min(range(len(r)), key=r.__getitem__) for r in d])
        return best, d[np.arange(len(x)), best]
    rows, cols = np.nonzero(candidates(x, entries))  # by row, then by index
    d = np.square(x[rows] - entries[cols]).sum(1)
    starts = np.searchsorted(rows, np.arange(len(x)))
    least = np.minimum.reduceat(d, starts)
    hits = np.flatnonzero(d == least[rows])
    first = hits[np.searchsorted(rows[hits], np.arange(len(x)))]
    return cols[first], least


def _assign(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and distances of whole vectors, a column for each part."""
    width = x.shape[1] // len(codebooks)
    got = [nearest(x[:, p * width : (p + 1) * width], c) for p, c in enumerate(codebooks)]
    return np.stack([g[0] for g in got], 1), np.stack([g[1] for g in got], 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return integers(flat.reshape(len(column), dim))


def kept(vectors: DataFrame, vector: str, parts: int) -> tuple[DataFrame, int]:
    """The rows that count, and their dimension: see compress."""
    v = F.col(f"`{vector}`")
    good = vectors.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    first = good.select(F.col("vec_id"), F.size(v).alias("n")).orderBy(F.asc_nulls_last("vec_id"), "n").limit(1).collect()
    dim = first[0]["n"] if first else parts
    return good.where(F.size(v) == dim), dim


def initial(good: DataFrame, vector: str, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors of least vec_id; of equal ids the least vectors come first."""
    rows = good.select("vec_id", F.col(f"`{vector}`").alias("v")).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    if not rows:
        return np.zeros((parts, 0, 1), np.int64)
    x = integers(np.array([list(r["v"]) for r in rows], np.float64))
    return np.stack(np.split(x, parts, axis=1))


def improve(good: DataFrame, vector: str, codebooks: np.ndarray, dim: int) -> np.ndarray:
    """Codebooks of the parts' means, rounded down; entries without parts stay."""
    shared = good.sparkSession.sparkContext.broadcast(codebooks)
    fields = ["part", "entry", "place", "limb", "value"]
    schema = StructType([StructField(n, LongType()) for n in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, entries, width = books.shape
        sums = np.zeros((parts, entries, width + 1), object)  # the last column counts
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), dim)
            codes, _ = _assign(x, books)
            wide = x.dtype == object or int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62
            for p in range(parts):
                of = np.zeros((entries, width + 1), object if wide else np.int64)
                np.add.at(of, codes[:, p], np.hstack([x[:, p * width : (p + 1) * width], np.ones((len(x), 1), np.int64)]))
                sums[p] += of.astype(object)
        out = [[] for _ in fields]
        for (p, e, i), value in np.ndenumerate(sums):
            value, limb = int(value), 0
            while value:  # limbs of equal sign, so that sums of limbs are limbs of sums
                size = abs(value) & ((1 << LIMB) - 1)
                for o, v in zip(out, (p, e, i, limb, size if value > 0 else -size), strict=True):
                    o.append(v)
                value, limb = (abs(value) >> LIMB) * (1 if value > 0 else -1), limb + 1
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=fields)

    # One row at most for each number of the codebooks and limb.
    got = good.select(F.col(f"`{vector}`").alias("v")).mapInArrow(run, schema).groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect()
    sums: dict[tuple[int, int, int], int] = {}
    for r in got:
        at = (r["part"], r["entry"], r["place"])
        sums[at] = sums.get(at, 0) + (r["value"] << LIMB * r["limb"])
    out, width = codebooks.astype(object), codebooks.shape[2]
    for p, e in np.ndindex(*codebooks.shape[:2]):
        n = sums.get((p, e, width), 0)
        if n:
            out[p, e] = [sums.get((p, e, i), 0) // n for i in range(width)]
    return out.astype(np.int64) if max((abs(v) for v in out.flat), default=0) < 1 << 62 else out


def learn(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, components of a part), integers."""
    good, dim = kept(vectors, vector, parts)
    books = initial(good, vector, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = improve(good, vector, books, dim)
    return books


def encode(vectors: DataFrame, codebooks: np.ndarray, vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code and error of the rows that count, for any codebooks; an error beyond a long is null."""
    good, dim = kept(vectors, vector, len(codebooks))
    if dim // len(codebooks) != codebooks.shape[2] or not codebooks.shape[1]:
        good, dim = good.limit(0), len(codebooks) * codebooks.shape[2]
    digits = max(2, len(f"{max(0, codebooks.shape[1] - 1):x}"))
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)
    base = good.select("vec_id", F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    schema = StructType([*base.schema.fields[:2], *vectors.sparkSession.createDataFrame([], "code string, error bigint").schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                codes, far = _assign(_matrix(batch.column(2), dim), shared.value)
                code = ["".join(f"{c:0{digits}x}" for c in r) for r in codes.tolist()]
                error = [e if e < 1 << 63 else None for e in (int(sum(r)) for r in far.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], schema=kinds)

    return base.mapInArrow(run, schema)


def digest(codebooks: np.ndarray) -> str:
    """sha256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in codebooks.reshape(-1)).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that counts.

    Rows are left out if their vector is null or empty, holds null or non-finite components, or can't be cut into so
    many equal parts; so are those of another dimension than the row of least vec_id has. With fewer vectors than entries
    the codebooks are smaller. Null vec_ids are kept and come last in order; repeated rows are kept. Errors beyond a
    long are null, and so are their labels' sums. An empty table gives an empty one; other columns aren't read.
    """
    books = learn(vectors, vector, parts, entries, rounds)
    rows = stash(encode(vectors, books, vector, label), "vector-codes")
    labels = stash(rows.groupBy("label").agg(F.count("*").alias("n"), F.try_sum("error").alias("label_error"), F.count_if(F.col("error").isNull()).alias("lost")), "vector-labels")
    labels = labels.select("label", "n", F.when(F.col("lost") == 0, F.col("label_error")).alias("label_error"))
    return join_counted(rows, labels, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
