"""Alignment of two tokenizers' tokens over the same bytes.

Each byte of a text has a label: a token of A ends there, one of B does, both do, or none. A pattern runs over the
string of labels: each match reaches up to the next label `both` and is a group, and its labels say how many tokens of
either side it has. The last tokens of a group end together, so they are linked; the links of all texts, counted by
their pair of ids, tell which tokens stand for each other.

Both tokenizers part a text before a single space or new line between two characters that aren't white space: A's
pattern begins a new word there, and B's pieces hold no space or new line but at their beginning (asked when the
file is loaded). So a group never reaches over such a place, labels are made and read for the stretches between them,
those of short stretches are memoized in a
dictionary of bounded size in each Python worker, and new ones are encoded a batch at once.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, arrow_map, join_counted, n_bytes, settle, stash
from .vocab import BYTE, NORMAL, SPACE, USER, normalizer, pieces

#: Stretches that a worker memoizes, and their longest length; longer ones are worked through each time.
MEMO_STRETCHES = 300_000
MEMO_CHARS = 40
#: Different pairs that a task counts before it hands them on.
PAIRS_HELD = 1 << 20

A_END, B_END = b"\x01\x02"
_GROUP = re.compile(b"[\x00-\x02]*\x03")
_LETTER = r"[^\W\d_\u00b2\u00b3\u00b9]"  # superscript digits have pieces with marks


def stretch_pattern(marks: str) -> re.Pattern:
    """Stretches begin with the text, or a single space or new line between other characters, and reach to the next such place.

    Of a stretch of letters and then some of the given marks, the marks are a stretch of their own.
    """
    whole = r"(?:\A\s+|[ \n])\S+(?:(?:\s{2,}|[^\S \n]|\s\Z)\S*)*"
    if not marks:
        return re.compile(whole)
    run = "[" + re.escape(marks) + "]"
    end = r"(?=[ \n]\S|\Z)"
    return re.compile(rf"[ \n]{_LETTER}+(?={run}+{end})|(?<={_LETTER}){run}+{end}|{whole}")


def byte_characters() -> dict[str, int]:
    """The bytes that the characters of byte-level vocabularies stand for: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def labels(a_sizes: list[int], b_sizes: list[int]) -> bytes:
    """A label for each byte, of two ways to cut as many bytes."""
    out = bytearray(sum(a_sizes))
    for sizes, end in ((a_sizes, A_END), (b_sizes, B_END)):
        at = -1
        for n in sizes:
            at += n
            out[at] |= end
    return bytes(out)


def groups(a: list[int], b: list[int], marks: bytes) -> list[tuple[list[int], list[int]]]:
    """The ids of each group, of tokens whose ends the labels say."""
    out, i, j = [], 0, 0
    for m in _GROUP.finditer(marks):
        span = m.group()
        n, k = span.count(A_END) + 1, span.count(B_END) + 1
        out.append((a[i : i + n], b[j : j + k]))
        i, j = i + n, j + k
    return out


class Aligner:
    """Groups and links of whole texts."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        file = json.load(open(a_path))
        before = file["pre_tokenizer"] or {}
        added = {t["content"] for t in file["added_tokens"] if not t["special"]}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or file["normalizer"] or added:
            raise ValueError("A must be a byte-level tokenizer without normalizer, prefix space and ordinary added tokens")
        chars = byte_characters()
        vocabulary = {t: i for t, i in self.a.get_vocab(with_added_tokens=False).items() if set(t) <= chars.keys()}
        if not chars.keys() <= vocabulary.keys():
            raise ValueError("A must have a token for each byte")
        self.a_sizes, self.a_names = {i: len(t) for t, i in vocabulary.items()}, {i: str(i) for i in vocabulary.values()}
        vocab = pieces(b_path)
        if any(t in (NORMAL, USER) and (SPACE in p.lstrip(SPACE) or "\n" in p) for p, _, t in vocab):
            raise ValueError("B's pieces must not reach over a space or hold a new line")
        if normalizer(b_path) != {"identity": True, "prefix": True, "squeezed": False}:
            raise ValueError("B must put a space before a text, and not change it otherwise")
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, _, t in vocab]
        self.b_names = [str(i) for i in range(len(vocab))]
        self.space = self.b.piece_to_id(SPACE)
        self.wide = max(self.a.get_vocab_size(), len(vocab)) > 1 << 16
        self.kind = "Q" if self.wide else "I"
        self.shift = 32 if self.wide else 16
        self.pattern = stretch_pattern(self.marks({p for p, _, t in vocab if t in (NORMAL, USER)}))
        self.memo: dict[str, tuple] = {}

    @staticmethod
    def marks(vocabulary: set[str]) -> str:
        """Marks that no piece has after a letter, so that B parts between the two, as A does. The apostrophe begins A's contractions."""
        joined = {p[i + 1] for p in vocabulary for i in range(len(p) - 1) if re.match(_LETTER, p[i])}
        return "".join(m for m in string.punctuation if m != "'" and m not in joined)

    def tokens(self, stretches: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """(stretch, ids of A, ids of B); a stretch begins with the text's space, or where both tokenizers part."""
        of_a = self.a.encode_batch_fast(stretches, add_special_tokens=False)
        of_b = self.b.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        for s, a, b in zip(stretches, of_a, of_b, strict=True):
            if s[0] != " " and b[0] == self.space:  # B puts a space before it
                b = b[1:]
            elif s[0] != " ":  # which has become part of a piece: a new line keeps them apart
                b = self.b.encode("\n" + s)[2:]
            yield s, a.ids, b

    def made(self, stretches: list[str]) -> dict[str, tuple[bytes, bytes, int, int, bool]]:
        """Of each: groups as text, links, tokens of A and of B; and whether both sides spell the stretch. A always does."""
        out, a_sizes, b_bytes, kind, shift = {}, self.a_sizes, self.b_bytes, self.kind, self.shift
        a_names, b_names = self.a_names, self.b_names
        for s, a, b in self.tokens(stretches):
            b_parts = [b_bytes[i] for i in b]
            if b"".join(b_parts) != s.encode():
                out[s] = b"", b"", 0, 0, False
                continue
            if len(a) > 1 and len(b) > 1:
                found = groups(a, b, labels([a_sizes[i] for i in a], [len(p) for p in b_parts]))
            else:
                found = [(a, b)]  # only the end is an end of both
            text = ";".join([f"{','.join([a_names[i] for i in x])}|{','.join([b_names[i] for i in y])}" for x, y in found]).encode()
            out[s] = text, array(kind, [x[-1] << shift | y[-1] for x, y in found]).tobytes(), len(a), len(b), True
        return out

    def align(self, texts: list[str | None]) -> list[tuple[int, int, bytes, bytes] | None]:
        """(tokens of A, tokens of B, groups as text, links) of a space and each text; None if a side doesn't spell these."""
        memo, cut = self.memo, self.pattern.findall
        cuts = [cut(" " + t) if t else [] for t in texts]
        cuts = [c if not t or sum(map(len, c)) == len(t) + 1 else [" " + t] for t, c in zip(texts, cuts, strict=True)]
        fresh = self.made(list({s for c in cuts for s in c if s not in memo}))
        short = [s for s in fresh if len(s) <= MEMO_CHARS]
        memo.update((s, fresh[s]) for s in short[: MEMO_STRETCHES - len(memo)])
        find = _Both(memo, fresh).__getitem__
        out: list[tuple[int, int, bytes, bytes] | None] = []
        for t, c in zip(texts, cuts, strict=True):
            got = list(map(find, c))
            if got and not all([g[4] for g in got]):  # the sides may spell the text all the same, parted elsewhere
                whole = self.made([" " + t])[" " + t]
                got = [whole] if whole[4] else []
            if got:
                groups_, links, a, b, _ = zip(*got, strict=True)
                out.append((sum(a), sum(b), b";".join(groups_), b"".join(links)))
            else:
                out.append(None)
        return out


class _Both(dict):
    """A batch's new stretches, and the memo for all others."""

    def __init__(self, memo: dict, new: dict):
        super().__init__(new)
        self.memo = memo

    def __missing__(self, stretch: str) -> tuple:
        return self.memo[stretch]


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for each Python worker."""
    return Aligner(a_path, b_path)


_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary"


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and the packed links of each row of docs; for align_tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        al, cols = aligner(a_path, b_path), {n: [] for n in ("n_a", "n_b", "n_groups", "groups_sha256", "links")}
        for got in al.align(batch.column(1).to_pylist()):
            n_a, n_b, text, links = got or (0, 0, b"", b"")
            for n, v in zip(cols, (n_a, n_b, len(links) // (8 if al.wide else 4), hashlib.sha256(text).hexdigest() if got else "", links), strict=True):
                cols[n].append(v)
        return {"doc_id": batch.column(0)} | cols

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, {_COUNTS}")


def token_groups(docs: DataFrame, a_path: str, b_path: str, groups: str = "token_groups") -> DataFrame:
    """docs with the groups of each text, in order: the ids of A and of B that spell the same bytes.

    Texts that are null, empty or spelled differently by the tokenizers have no groups. A column of docs that bears the new name is replaced.
    """
    kept = [c for c in docs.columns if c != groups]
    base = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields] + [f"`{groups}` array<struct<a: array<int>, b: array<int>>>"])

    def run(batch):
        al, out = aligner(a_path, b_path), []
        for got in al.align(batch.column(kept.index("text")).to_pylist()):
            sides = [g.split("|") for g in got[2].decode().split(";")] if got else []
            out.append([{"a": list(map(int, x.split(","))), "b": list(map(int, y.split(",")))} for x, y in sides])
        return dict(zip(kept, batch.columns, strict=True)) | {groups: out}

    return arrow_map(base, run, schema)


def _codes(links: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch, and where each row's begin and end."""
    rows = links.to_pylist()
    ends = np.cumsum([0, *[len(r) // kind.itemsize for r in rows]])
    return np.frombuffer(b"".join(rows), kind), ends


def pair_counts(aligned: DataFrame, wide: bool = False) -> DataFrame:
    """(pair, n, best) of the links of alignments(): how many hold the pair, and whether no pair of its B id has more.

    pair packs both ids. Tasks hand on partial counts; pairs are summed by Spark, as many as there may be.
    """
    settle(aligned.sparkSession)
    kind, bits = np.dtype("<u8" if wide else "<u4"), 32 if wide else 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, kind), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            some, n = np.unique(_codes(batch.column(0), kind)[0], return_counts=True)
            codes, at = np.unique(np.concatenate([codes, some]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(codes)).astype(np.int64)
            if len(codes) > PAIRS_HELD:
                yield out()
                codes, counts = codes[:0], counts[:0]
        if len(codes):
            yield out()

    pairs = aligned.select("links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = stash(pairs.withColumn("b", F.col("pair").bitwiseAND((1 << bits) - 1)), "link-pairs")
    return pairs.join(pairs.groupBy("b").agg(F.max("n").alias("most")), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(aligned: DataFrame, pairs: DataFrame, kind: np.dtype) -> DataFrame:
    """n_best and count_sum by look-up in a table that is small enough to be sent to each task."""
    rows = sorted((r["pair"], r["n"], r["best"]) for r in pairs.collect())
    table = [np.array([r[i] for r in rows], t) for i, t in ((0, np.int64), (1, np.int64), (2, np.int64))]
    shared = aligned.sparkSession.sparkContext.broadcast(table)
    fields = [f for f in aligned.schema.fields if f.name != "links"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_best bigint, count_sum bigint"
    names = [f.name for f in fields]

    def run(batch):
        codes, ends = _codes(batch.column(batch.schema.get_field_index("links")), kind)
        sums = []
        at = np.searchsorted(shared.value[0], codes.astype(np.int64))
        for column in (shared.value[2], shared.value[1]):
            total = np.concatenate([[0], np.cumsum(column[at] if len(column) else np.zeros(0, np.int64))])
            sums.append((total[ends[1:]] - total[ends[:-1]]).tolist())
        return {n: batch.column(batch.schema.get_field_index(n)) for n in names} | {"n_best": sums[0], "count_sum": sums[1]}

    return arrow_map(aligned, run, schema)


def _joined(aligned: DataFrame, pairs: DataFrame, kind: np.dtype) -> DataFrame:
    """The same by joins, for a table of any size: each row's different pairs meet their counts."""
    rows = stash(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned-rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends = _codes(batch.column(1), kind)
            for row, i, j in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                some, times = np.unique(codes[i:j], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row)), pa.array(some.astype(np.int64)), pa.array(times)], names=["row", "pair", "times"])

    each = rows.select("row", "links").mapInArrow(run, "row bigint, pair bigint, times bigint")
    met = join_counted(each, stash(pairs, "counted-pairs"), ["pair"])
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = rows.drop("links").join(sums, "row", "left").drop("row")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def align_tokens(docs: DataFrame, a_path: str, b_path: str, small: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every whole text.

    A encodes a space and the text, B the text (it adds that space); special tokens' strings are plain text. Texts that
    are null, empty, or whose bytes either tokenizer changes have no tokens: zeros, and an empty digest. Counts are
    over all rows, repeated ones too; n_best counts links whose pair is the most frequent of its B id, ties included.
    Null and repeated ids are kept, other columns aren't read, an empty table gives an empty one.
    """
    al = Aligner(a_path, b_path)
    aligned = stash(alignments(docs, a_path, b_path), "alignments")
    pairs = stash(pair_counts(aligned, al.wide), "pair-counts")
    out = (_looked_up if n_bytes(pairs) <= small else _joined)(aligned, pairs, np.dtype("<u8" if al.wide else "<u4"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
