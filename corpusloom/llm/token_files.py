"""Token ids as compressed binary blocks with a shared zstandard dictionary.

Format, all written and read by Spark, so it may lie in any store Spark reaches:
- <path>/dictionary: one row: hash (sha256), the dictionary's bytes, bytes per id.
- <path>/blocks: one row for each block of documents in ascending doc_id order: part and block number,
  first and last doc_id, the dictionary's hash, payload (the documents' zstandard frames, one after
  another) and the index: doc_ids, where each frame ends, each document's number of ids and the
  number of ids of all documents before it.

Each document is a frame of its own, so one document is read without its neighbours: a filter on
first and last doc_id finds the block, the index the frame. The dictionary makes short frames small.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, settle, shared_dir, stash
from .ordering import boundaries, part_of, parts

#: Documents whose ids the dictionary is trained on at most, its size, and bytes of a full block.
SAMPLE_ROWS = 1500
DICTIONARY_BYTES = 64 * 1024
BLOCK_BYTES = 1 << 20
LEVEL = 3
#: Words, and parts of words, whose ids a worker memoizes.
MEMO_WORDS = 700_000

#: Longer words, such as encoded files, are encoded each time.
MEMO_CHARS = 40

_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space for str.split(), not for the tokenizer
#: Marks that a tokenizer which parts letters from marks parts from a word they begin or end.
_MARKS = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'
#: What a tokenizer must encode alike whole and by words, to be used by words.
_PROBES = ("Don't say 'that' (again), U.S.-made x_1... \u00e9t\u00e9 e\u0301a\u0300 12,34.5% \u03a3\u0391\u03a3 #tag @you a--b \"Quoted!\"\n\ttabs  two\u00a0nbsp\u3000wide 'S 's x'LL \u65e5\u672c\u8a9e\u3002 \U0001f600!? (a)b [c] {d}e `f` ~g~ A.B.C. ...", "l'\u00e9t\u00e9; \u00bfqu\u00e9? na\u00efve co-op \u201cquoted\u201d\u2019s \ufb01ne \u0130I \u1e9e\u00df")


class Encoder:
    """Ids of whole texts as the tokenizers library gives them; words are memoized.

    A text's ids are its words' ids, one after another, for tokenizers that drop white space and never
    join what it parts; a word's are those of its marks and of what is between. Whether a file's
    tokenizer is of that kind is asked when it is loaded: added tokens without white space, neither
    truncation nor padding, and equal ids for texts that join what could be joined. If it isn't, texts are
    encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.within_added = {c for t in added for c in t if c not in _MARKS and not c.isalnum()}
        self.by_words = self.library.truncation is None and self.library.padding is None and not any(c.isspace() for t in added for c in t)
        self.by_words = self.by_words and all(self._by_words([t]) == self._ids([t]) for p in _PROBES for t in (p, *p.split()))
        self.memo.clear()
        self.parts = {"": b""}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words: a word that begins or ends with marks is put together from them and the rest."""
        apart, whole = {}, []
        for w in words:
            base = w.strip(_MARKS)
            ends = base if base.isascii() else unicodedata.normalize("NFC", base).lower()
            if base == w or not base or "\u03a3" in w or not ends[0].isalnum() or not ends[-1].isalnum() or any(c in w for c in self.within_added):
                whole.append(w)
            else:
                i = w.index(base)
                apart[w] = (w[:i], base, w[i + len(base) :])
        parts = self.parts
        need = list({x for k in apart.values() for x in k if x not in parts} | {w for w in whole if w not in parts})
        got = dict(zip(need, self._ids(need), strict=True)) if need else {}
        if len(parts) + len(got) <= MEMO_WORDS:
            parts.update({w: b for w, b in got.items() if len(w) <= MEMO_CHARS})
        find = _Both(parts, got)
        out = {w: find[w] for w in whole}
        out |= {w: find[a] + find[b] + find[c] for w, (a, b, c) in apart.items()}
        return out

    def _by_words(self, texts: list[str | None]) -> list[bytes]:
        words = [(t or "").split() if not t or not _ODD_SPACE.search(t) else None for t in texts]
        memo = self.memo
        new = [w for w in set(chain.from_iterable(ws for ws in words if ws)) if w not in memo]
        got = self._new(new) if new else {}
        if len(memo) + len(got) <= MEMO_WORDS:
            memo.update({w: b for w, b in got.items() if len(w) <= MEMO_CHARS})
        get = _Both(memo, got).__getitem__ if got else memo.__getitem__
        whole = iter(self._ids([t for t, ws in zip(texts, words, strict=True) if ws is None]))
        return [next(whole) if ws is None else b"".join(map(get, ws)) for ws in words]

    def encode(self, texts: list[str | None], end: int | None) -> list[bytes]:
        """Serialized ids of each text, with the end id appended; null is empty."""
        tail = b"" if end is None else array(self.kind, [end]).tobytes()
        return [ids + tail for ids in (self._by_words(texts) if self.by_words else self._ids([t or "" for t in texts]))]


class _Both(dict):
    """A batch's new words, and the memo for all others."""

    def __init__(self, memo: dict[str, bytes], new: dict[str, bytes]):
        super().__init__(new)
        self.memo = memo

    def __missing__(self, word: str) -> bytes:
        return self.memo[word]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def train_dictionary(docs: DataFrame, path: str, end: int | None) -> bytes:
    """A dictionary trained on the ids of a bounded sample of documents; empty if they are too few."""
    n = docs.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10_000_000)) < int(10_000_000 * min(1.0, SAMPLE_ROWS / max(1, n))) + 1
    sample = arrow_map(docs.where(part).select("text"), lambda b: {"ids": encoder(path).encode(b.column(0).to_pylist(), end)}, "ids binary")
    got = [bytes(r["ids"])[: 1 << 16] for r in sample.limit(2 * SAMPLE_ROWS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, got).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, tokenizer: str, path: str, end: int | None = 2) -> None:
    """Encode every whole text and write the files, in ascending doc_id order.

    Null texts are empty: the end id alone. Null ids come first, rows with equal ids by their content.
    """
    spark = docs.sparkSession
    settle(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    trained = train_dictionary(docs, tokenizer, end)
    name = hashlib.sha256(trained).hexdigest()
    shared = spark.sparkContext.broadcast(trained)

    def compress(batch):
        e = encoder(tokenizer)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value)) if shared.value else zstandard.ZstdCompressor(level=LEVEL)
        ids = e.encode(batch.column(1).to_pylist(), end)
        return {"doc_id": batch.column(0), "n": [len(x) // e.width for x in ids], "frame": [press.compress(x) for x in ids]}

    frames = stash(arrow_map(docs.select("doc_id", "text"), compress, f"doc_id {kind}, n bigint, frame binary"), "frames")
    n = parts(docs)
    rows = frames.withColumn("part", part_of("doc_id", boundaries(frames, n)))
    totals = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row for each part
    starts, before = {}, 0
    for p in sorted(totals):
        starts[p], before = before, before + totals[p]
    rows = rows.repartitionById(n, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "n", "frame")
    fields = f"part int, block int, first_id {kind}, last_id {kind}, dictionary string, doc_ids array<{kind}>, ends array<bigint>, counts array<bigint>, starts array<bigint>, payload binary"
    out = spark.createDataFrame([], fields).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(out)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = None, 0, 0
        ids, ends, counts, begins, frames_, size = [], [], [], [], [], 0

        def made():
            known = [i for i in ids if i is not None]
            row = [part, number, known[0] if known else None, known[-1] if known else None, name, ids, ends, counts, begins, b"".join(frames_)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, kinds, strict=True)], schema=kinds)

        for batch in batches:
            for doc_id, k, frame, p in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if ids and (p != part or size >= BLOCK_BYTES):
                    yield made()
                    ids, ends, counts, begins, frames_, size, number = [], [], [], [], [], 0, number + 1
                if p != part:
                    part, number, start = p, 0, starts[p]
                size += len(frame)
                ids.append(doc_id)
                ends.append(size)
                counts.append(k)
                begins.append(start)
                frames_.append(frame)
                start += k
        if ids:
            yield made()

    rows.mapInArrow(blocks, out).write.option("compression", "none").parquet(f"{path}/blocks")
    width = 2 if _vocabulary(tokenizer) <= 1 << 16 else 4
    spark.createDataFrame([(name, bytearray(trained), width)], "hash string, bytes binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    got = bytes(row["bytes"])
    if hashlib.sha256(got).hexdigest() != row["hash"]:
        raise ValueError("the dictionary doesn't match its hash")
    return row["hash"], got, row["width"]


def _unpress(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and, if asked for, token_ids, decoded from the files."""
    name, dictionary, width = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["first_id"].dataType.simpleString()
    fields = f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", token_ids array<bigint>" * with_ids
    shared = spark.sparkContext.broadcast(dictionary)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    def run(batch):
        press = _unpress(shared.value)
        cols = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", *["token_ids"] * with_ids)}
        for used, ids, ends, starts, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if used != name:
                raise ValueError("a block was written with another dictionary")
            at = 0
            for doc_id, e, start in zip(ids, ends, starts, strict=True):
                got = np.frombuffer(press.decompress(payload[at:e]), f"<u{width}").astype("<u4")
                at = e
                cols["doc_id"].append(doc_id)
                cols["start"].append(start)
                cols["n_tokens"].append(len(got))
                cols["ids_crc32"].append(zlib.crc32(got.tobytes()))
                if with_ids:
                    cols["token_ids"].append(got.tolist())
        return cols

    return arrow_map(blocks.select("dictionary", "doc_ids", "ends", "starts", "payload"), run, fields)


def read_one(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """Ids of one document: its block by the ids' range, its frame by the index; None if absent."""
    _, dictionary, width = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    at = F.array_position("doc_ids", F.lit(doc_id).cast("bigint"))
    frame = F.expr("substring(payload, cast(if(at > 1, ends[at - 2], 0) as int) + 1, cast(ends[at - 1] - if(at > 1, ends[at - 2], 0) as int))")
    row = blocks.withColumn("at", at.cast("int")).where("at > 0").select(frame.alias("frame")).first()
    return np.frombuffer(_unpress(dictionary).decompress(bytes(row["frame"])), f"<u{width}").tolist() if row else None


def write_and_read(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write docs to a new folder among the application's and read the result back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/loom/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write(docs, tokenizer, path, end)
    return read(spark, path, with_ids=False)
