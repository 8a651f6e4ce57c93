"""Token counts of a unigram vocabulary, without the tokens.

A word's best segmentation is found by Viterbi over the vocabulary pieces that an Aho-Corasick
automaton finds in it. Only the best score and its number of pieces are carried for each prefix.

Rules, as the tokenizers library's unigram model has them: text is cut before each space, which
becomes the space piece and is put before the text too; scores add up as 64-bit floats; of equal
scores the piece that starts earliest wins; a character that no one-character piece covers scores
the least score less 10, and such a stretch counts as one unknown token, or, if the vocabulary has
all bytes, as its UTF-8 bytes, each run of unknown characters as one piece.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from .common import arrow_map
from .vocab import BYTE, NORMAL, SPACE, pieces

#: Words that a worker memoizes; beyond it new words are counted each time.
MEMO_WORDS = 700_000
#: Longer words, such as encoded files, are worked through each time, so that the memo is bounded in bytes.
MEMO_CHARS = 40

#: The unigram model's penalty of unknown characters. Fixed value.
UNKNOWN_PENALTY = 10.0


class UnigramCounter(dict):
    """Counts of words by the best path; a bounded memo of words that all begin with the space piece."""

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool):
        super().__init__()
        self.auto = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.known = {p for p, _ in vocab if len(p) == 1}
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback

    def __missing__(self, word: str) -> int:
        n = self.count(SPACE + word)
        if len(self) < MEMO_WORDS and len(word) <= MEMO_CHARS:
            self[word] = n
        return n

    def count(self, s: str) -> int:
        """Tokens of one word, space piece included."""
        n = len(s)
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        count, unknown = [0] * (n + 1), [False] * (n + 1)
        at = 0
        known = self.known

        def alone(i: int) -> None:
            """An unknown character from i; a stretch of them is one piece."""
            score = best[i] + self.unknown
            if best[i + 1] is None or score > best[i + 1]:
                size = len(s[i].encode()) if self.byte_fallback else 0 if unknown[i] else 1
                best[i + 1], count[i + 1], unknown[i + 1] = score, count[i] + size, True

        for end, (length, score) in self.auto.iter(s):  # by end, longest (so earliest start) first
            end += 1
            while at < end - 1:  # what ends before is settled
                if s[at] not in known:
                    alone(at)
                at += 1
            start = end - length
            total = best[start] + score
            if best[end] is None or total > best[end]:
                best[end], count[end], unknown[end] = total, count[start] + 1, False
        while at < n:
            if s[at] not in known:
                alone(at)
            at += 1
        return count[n]

    def tokens(self, text: str | None) -> int:
        """Tokens of a whole text; null and empty texts have none."""
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if words[0] == "":  # the text begins with a space, so no other is put before it
            del words[0]
        return sum(map(self.__getitem__, words))


@lru_cache(maxsize=1)
def counter(path: str) -> UnigramCounter:
    """One counter for each Python worker: the file's pieces with their stored scores.

    Byte and control pieces match no text.
    """
    vocab = pieces(path)
    has_bytes = sum(t == BYTE for _, _, t in vocab) == 256
    return UnigramCounter([(p, s) for p, s, t in vocab if t == NORMAL], has_bytes)


def token_counts(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs' doc_id with the number of tokens of each whole text.

    Null and empty texts have 0. Repeated rows stay; an empty table gives an empty table.
    """

    def run(batch):
        c = counter(path)
        return {"doc_id": batch.column(0), name: [c.tokens(t) for t in batch.column(1).to_pylist()]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", text), run, f"doc_id {kind}, `{name}` bigint")
