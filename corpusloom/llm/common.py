"""Helpers that the text operators share: Arrow mapping, rolling hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sizes import BROADCAST_BYTES, bounded, join_counted, n_bytes
from ..storage import shared_dir, stash

__all__ = ["BROADCAST_BYTES", "arrow_map", "bounded", "join_counted", "mix", "n_bytes", "shared_dir", "shingles", "stash", "table"]

#: Rows per Arrow batch: 1,000 very long texts still fit a small Python worker.
ARROW_ROWS = 1000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, by whatever path Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(spark: SparkSession) -> None:
    """Small Arrow batches: texts differ by orders of magnitude in length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str | StructType) -> DataFrame:
    """Apply fn to every Arrow batch; fn returns a dict of columns, whose types schema gives."""
    settle(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=kinds.field(i).type) for i, c in enumerate(made[n] for n in kinds.names)],
                    schema=kinds,
                )

    return df.mapInArrow(run, out)


MULT = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and INVERSE to the powers 0 to n - 1, modulo 2 to the 64th."""
    if len(_powers.get("p", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, b in (("p", BASE), ("q", INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit hashes of any span of consecutive words of one text, each by two table look-ups.

    words: the text's words joined by single spaces, as bytes (word bytes are never 0x20).
    """

    def __init__(self, joined: bytes):
        a = np.frombuffer(joined, np.uint8)
        self.n_bytes = len(a)
        if not len(a):
            self.n = 0
            return
        gaps = np.flatnonzero(a == 32)
        self.starts = np.concatenate([[0], gaps + 1])
        self.ends = np.concatenate([gaps, [len(a)]])
        self.n = len(self.starts)
        p, self.q = powers(len(a))
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p, out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all spans of k words, in order; with fewer words, none."""
        if self.n < k or not self.n:
            return np.zeros(0, np.uint64)
        s, e = self.starts[: self.n - k + 1], self.ends[k - 1 :]
        return mix((self.sums[e] - self.sums[s]) * self.q[s] + np.uint64(k * int(MULT) & (1 << 64) - 1))


def shingles(joined: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words make one shingle of them all; none make none."""
    r = Rolling(joined)
    if not r.n:
        return np.zeros(0, np.uint64)
    return np.unique(r.grams(min(k, r.n)))

