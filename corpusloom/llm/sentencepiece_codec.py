"""SentencePiece BPE encoding by a prefix table, and decoding.

Encoding. In a merge-type vocabulary each prefix of a text has one encoding, so one last token. A
table holds that token for each prefix: an Aho-Corasick automaton gives the vocabulary's pieces that
end at the prefix, and of them only one is compatible with the last token of what is before it.
Two neighbours are compatible if undoing their merges, latest first, meets no merge across their
border that would have come earlier. The ids are read off the table backwards.

Pieces never reach over a space or a new line, so a text is cut there and the tables of words are
memoized in a bounded dictionary in each Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .vocab import BYTE, NORMAL, SPACE, UNUSED, USER, pieces

#: Words that a worker memoizes; beyond it new words are encoded each time.
MEMO_WORDS = 250_000
#: Pairs of pieces whose fit a worker remembers; beyond it others are asked anew each time.
MEMO_PAIRS = 400_000
#: Longer words, such as encoded files, are worked through each time, so that the memo is bounded in bytes.
MEMO_CHARS = 40


def _merged(text: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Merges of a short string, best score first and leftmost among equals; the last merge made."""
    s, last = list(text), None
    while len(s) > 1:
        best, at = None, -1
        for i in range(len(s) - 1):
            v = score.get(s[i] + s[i + 1])
            if v is not None and (best is None or v > best):
                best, at = v, i
        if best is None:
            break
        last = (s[at], s[at + 1])
        s[at : at + 2] = [s[at] + s[at + 1]]
    return s, last


class PrefixTable:
    """The prefix-table encoder of one merge-type vocabulary with byte fallback."""

    def __init__(self, path: str):
        vocab = pieces(path)
        if any(t in (USER, UNUSED) for _, _, t in vocab):
            raise ValueError("user-defined and unused pieces aren't supported")
        normal = [(p, s, i) for i, (p, s, t) in enumerate(vocab) if t == NORMAL]
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in normal):
            raise ValueError("pieces must not reach over a space")
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(vocab) if t == BYTE}
        self.runs = {len(p): i for p, _, i in normal if set(p) == {SPACE}}
        self.run_score = {len(p): s for p, s, _ in normal if set(p) == {SPACE}}
        if min(s for p, s, _ in normal if len(p) > 1 and set(p) != {SPACE}) <= max([s for n, s in self.run_score.items() if n > 1], default=-2e9):
            raise ValueError("runs of spaces must merge after everything else")
        words = [(p, s, i) for p, s, i in normal if set(p) != {SPACE} or len(p) == 1]
        score = {p: s for p, s, _ in words}
        self.text, self.rank, self.split, self.pair = {}, {}, {}, {}
        auto, single = ahocorasick.Automaton(), {}
        order = sorted((x for x in words if len(x[0]) > 1), key=lambda x: (-x[1], x[2]))
        for p, _, i in words:
            if len(p) == 1:
                single[p] = i
                self.rank[i], self.split[i] = -1, None
                auto.add_word(p, (1, i))
        ids = {p: i for p, _, i in words}
        for rank, (p, _, i) in enumerate(order):
            made, last = _merged(p, score)
            if made == [p] and last:  # else no text is ever encoded with this piece
                self.rank[i], self.split[i] = rank, (ids[last[0]], ids[last[1]])
                auto.add_word(p, (len(p), i))
            for k in range(1, len(p)):  # any two pieces that spell a piece merge
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    self.pair[a << 20 | b] = rank
        auto.make_automaton()
        self.auto, self.single = auto, single
        self.fits, self.known = _Fits(self), set(single)
        self.space = single[SPACE]
        self.new_line = self._bytes("\n") if "\n" not in single else struct.pack("<I", single["\n"])

    def _bytes(self, c: str) -> bytes:
        return b"".join(struct.pack("<I", self.byte[x]) for x in c.encode())

    def compatible(self, a: int, b: int) -> bool:
        """Whether the pieces a and b stay apart when b's text follows a's."""
        rank, split, pair = self.rank, self.split, self.pair
        # A merge over the border wins if it comes before the merge that used up either neighbour;
        # of equal merges the one further left wins.
        left_at, right_at = 1 << 30, 1 << 30
        while True:
            over = pair.get(a << 20 | b)
            if over is not None and over < left_at and over <= right_at:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                left_at, a = ra, split[a][1]
            else:  # equal merges: the left one was made first, so the right one is undone first
                right_at, b = rb, split[b][0]

    def run_lengths(self, n: int) -> list[int]:
        """Lengths of the pieces that n spaces merge into: best score first, leftmost among equals."""
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        score = self.run_score
        heap = [(-score[2], i, i + 1, 2) for i in range(n - 1)] if 2 in score else []
        while heap:
            _, a, b, k = heapq.heappop(heap)
            if not size[a] or not size[b] or size[a] + size[b] != k or after[a] != b:
                continue
            size[a], size[b], after[a] = k, 0, after[b]
            if after[a] < n:
                before[after[a]] = a
            for x, y in ((before[a], a), (a, after[a])):
                if x >= 0 and y < n and size[x] + size[y] in score:
                    heapq.heappush(heap, (-score[size[x] + size[y]], x, y, size[x] + size[y]))
        return [k for k in size if k]

    def ids(self, s: str) -> list[int]:
        """Ids of a text without spaces but for one leading space piece."""
        n = len(s)
        last, size = [-1] * (n + 1), [1] * (n + 1)
        last[0] = 0
        if not self.known.issuperset(s):
            for i, c in enumerate(s):
                if c not in self.known:
                    last[i + 1] = 0
        fits = self.fits
        for end, (length, token) in self.auto.iter(s):  # by end, longest first
            if last[end + 1] < 0 and fits[last[end + 1 - length] << 20 | token]:
                last[end + 1], size[end + 1] = token, length
        out = []
        while n:
            token = last[n]
            if token:
                out.append(token)
            else:
                out += [self.byte[x] for x in reversed(s[n - 1].encode())]
            n -= size[n]
        out.reverse()
        return out


class _Fits(dict):
    """compatible() by both ids, remembered for a bounded number of pairs; before 0 (a text's start, an unknown character) all fits."""

    def __init__(self, table: PrefixTable):
        super().__init__()
        self.table = table

    def __missing__(self, key: int) -> bool:
        fits = key < 1 << 20 or self.table.compatible(key >> 20, key & (1 << 20) - 1)
        if len(self) < MEMO_PAIRS:
            self[key] = fits
        return fits


class _Memo(dict):
    """Ids of a word, as little-endian bytes, encoded when first asked for."""

    def __init__(self, table: PrefixTable, prefix: str):
        super().__init__()
        self.table, self.prefix = table, prefix

    def __missing__(self, word: str) -> bytes:
        ids = self.table.ids(self.prefix + word)
        made = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < MEMO_WORDS and len(word) <= MEMO_CHARS:
            self[word] = made
        return made


class Codec:
    """Encodes and decodes texts exactly as the sentencepiece library does with the same file."""

    def __init__(self, path: str):
        import sentencepiece

        self.table = PrefixTable(path)
        self.after_space, self.bare = _Memo(self.table, SPACE), _Memo(self.table, "")
        self.run_memo: dict[int, bytes] = {}
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = struct.pack("<I", self.library.bos_id()), struct.pack("<I", self.library.eos_id())

    def _run(self, n: int) -> bytes:
        """Ids of n spaces that belong to no word. Their merges come last, so nothing else takes part."""
        made = self.run_memo.get(n)
        if made is None:
            made = b"".join(struct.pack("<I", self.table.runs[k]) for k in self.table.run_lengths(n))
            if len(self.run_memo) < 1000:
                self.run_memo[n] = made
        return made

    def _loose(self, line: str) -> bytes:
        """A line with several spaces in a row or at its end."""
        out = []
        bare_space = struct.pack("<I", self.table.space)
        for spaces, word in re.findall(r"( *)([^ ]*)", line):
            if not word:
                out.append(self._run(len(spaces)))
            elif not spaces:
                out.append(self.bare[word])
            else:
                ids = self.after_space[word]
                if ids[:4] == bare_space:
                    out += [self._run(len(spaces)), ids[4:]]
                else:
                    out += [self._run(len(spaces) - 1), ids]
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """All ids with begin and end, as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return self.begin + self.end
        lines = (" " + text.replace(SPACE, " ")).split("\n")
        out = []
        get = self.after_space.__getitem__
        for line in lines:
            if "  " in line or line[-1:] == " ":
                out.append(self._loose(line))
            else:
                head, *rest = line.split(" ")
                part = b"".join(map(get, rest))
                out.append(self.bare[head] + part if head else part)
        return self.begin + self.table.new_line.join(out) + self.end

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path)


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded_text") -> DataFrame:
    """docs with the ids of each text (begin and end ids too) and the text that they decode to.

    A null text counts as empty: only begin and end ids, decoded to an empty text. Row by row: ties,
    repeated rows and empty tables need no care. Columns of docs that bear the new names are replaced.
    """
    return _columns(docs, path, text, {ids: "array<int>", decoded: "string"}, lambda c, b, d: {ids: struct.unpack(f"<{len(b) // 4}i", b), decoded: d})


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs' doc_id with n_tokens, ids_sha256 and decoded_sha256 of what encode_decode makes.

    The digests are taken where the ids are made, so that the ids needn't leave the task.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()
    made = lambda c, b, d: {"n_tokens": len(b) // 4, "ids_sha256": sha(b), "decoded_sha256": sha(d.encode("utf-8", "surrogatepass"))}
    kinds = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    return _columns(docs.select("doc_id", text), path, text, kinds, made).drop(text)


def _columns(docs: DataFrame, path: str, text: str, kinds: dict[str, str], make) -> DataFrame:
    import numpy as np

    kept = [c for c in docs.columns if c not in kinds]
    base = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields] + [f"`{n}` {t}" for n, t in kinds.items()])

    def run(batch):
        c, cols = codec(path), {n: [] for n in kinds}
        for t in batch.column(kept.index(text)).to_pylist():
            b = c.encode(t)
            for n, v in make(c, b, c.decode(np.frombuffer(b, "<u4").tolist())).items():
                cols[n].append(v)
        return dict(zip(kept, batch.columns, strict=True)) | cols

    return arrow_map(base, run, schema)
