"""Functions of whole segments that carry a state from token to token: Arrow-backed, one small helper a text."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DELAYED_ENDS, SENTENCE_TERMINALS, latin_pattern

#: Quotation marks by the kind that closes what it opened. Fixed values.
QUOTE_KINDS = {c: kind for kind, marks in {"d": '"“”„‟', "s": "'‘’‚‛", "a": "«»", "g": "‹›"}.items() for c in marks}
#: Marks that keep to the word after them. Fixed values.
OPENERS = "([{¿¡<"
FORMS = ("NFC", "NFD", "NFKC", "NFKD")
_RANGES = "array<struct<start:int,end:int>>"


def normalize(text: Column, form: str = "NFC") -> Column:
    """Text in a Unicode normalization form; ASCII texts are the same in all of them."""
    if form not in FORMS:
        raise ValueError(f"no such form: {form}")

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(apply(text))


#: The side of a token on which no space stands, by its first character, else by the character's category: the word after
#: it (R), the word before it (L), both (B); none is N.
SIDES = {**dict.fromkeys(OPENERS, "R"), ">": "L", "/": "B", "\\": "B"}
CATEGORY_SIDES = {"Sc": "R", **dict.fromkeys(("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po"), "L")}


def _closes(kinds: list[str]) -> list[bool]:
    """Whether each quotation mark closes: if the last one that is still open is of its kind."""
    still_open, out = "", []
    for kind in kinds:
        out.append(still_open.endswith(kind))
        still_open = still_open[:-1] if out[-1] else still_open + kind
    return out


def _sides(tokens: list[str]) -> list[str]:
    heads = [t[0] for t in tokens]
    closes = iter(_closes([QUOTE_KINDS[c] for c in heads if c in QUOTE_KINDS]))
    return [("L" if next(closes) else "R") if c in QUOTE_KINDS else SIDES.get(c) or CATEGORY_SIDES.get(unicodedata.category(c), "N") for c in heads]


def _joined(tokens: list[str], zero_width: bool) -> str:
    """The tokens with a gap wherever neither neighbour keeps to the other.

    With zero_width the gap is a zero-width space, but a space beside a mark that opens or closes; tokens of white space are their own gap.
    """
    tokens = [t for t in tokens if t]
    sides = ["B" if zero_width and t[0].isspace() else side for t, side in zip(tokens, _sides(tokens), strict=True)]
    marks = [unicodedata.category(t[0]).startswith("P") for t in tokens]

    def gap(i: int) -> str:
        if sides[i] in "RB" or sides[i + 1] in "LB":
            return ""
        beside = marks[i] and sides[i] == "L" or marks[i + 1] and sides[i + 1] == "R"
        return " " if beside or not zero_width else "\u200b"

    gaps = [gap(i) for i in range(len(tokens) - 1)]
    return "".join(chain.from_iterable(zip_longest(tokens, gaps, fillvalue="")))


def _detokenizer(zero_width: bool):
    @F.pandas_udf("string")
    def apply(segments: pd.Series) -> pd.Series:
        return segments.map(lambda s: None if s is None else _joined(list(s), zero_width))

    return apply


def latin_detokenize(tokens: Column) -> Column:
    """Tokens of Latin script as a text: marks keep to their words, quotation marks by what is open."""
    return _detokenizer(False)(tokens)


def zwsp_detokenize(tokens: Column) -> Column:
    """Tokens of a script without spaces as a text, with zero-width spaces between words and spaces around marks."""
    return _detokenizer(True)(tokens)


def whitespace_detokenize(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


@lru_cache(maxsize=8)
def _latin(abbreviations: tuple[str, ...]):
    import regex

    return regex.compile(latin_pattern(abbreviations))


def _words(line: str, abbreviations: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _latin(abbreviations).finditer(line))


#: Sentences over a string with a letter for each token: T sentence terminals, C closing marks, l a lower-case word, w any other.
#: A sentence ends with a terminal and the closing marks after it, unless a lower-case word follows such marks. A
#: terminal at a sentence's beginning is none, but for the first of a line.
SENTENCE = re.compile(r"(?:\A|.)[^T]*TC*(?:(?<=C)l[^T]*TC*)*")


def _letter(token: str) -> str:
    for letter, chars in (("T", SENTENCE_TERMINALS), ("C", DELAYED_ENDS)):
        if set(token) <= set(chars):
            return letter
    return "l" if token[0].islower() else "w"


def _sentences(line: str, abbreviations: tuple[str, ...]) -> list[tuple[int, int]]:
    """Where the sentences of a line begin and end; what follows the last full one goes up to the end of the line."""
    spans = list(_words(line, abbreviations))
    found = [m.span() for m in SENTENCE.finditer("".join(_letter(line[a:b]) for a, b in spans))]
    rest = found[-1][1] if found else 0
    return [(spans[i][0], spans[j - 1][1]) for i, j in found] + [(a, len(line)) for a, _ in spans[rest : rest + 1]]


def _ranges(find, by_line: bool):
    """Ranges as Arrow arrays, put together from plain integers: a batch may have millions of them."""

    @F.arrow_udf(_RANGES)
    def apply(texts: pa.Array) -> pa.Array:
        ends, ranges = array("q", [0]), array("i")
        for text in texts:
            text = text.as_py() or ""
            parts = ((m.start(), m[0]) for m in re.finditer(r"[^\r\n]+", text)) if by_line else [(0, text)]
            for at, part in parts:
                for a, b in find(part):
                    ranges.append(at + a)
                    ranges.append(at + b)
            ends.append(len(ranges) // 2)
        both = np.frombuffer(ranges, np.int32) if ranges else np.zeros(0, np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(both[0::2]), pa.array(both[1::2])], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int64).astype(np.int32)), pairs, mask=texts.is_null())

    return apply


def latin_ranges(text: Column, abbreviations: tuple[str, ...] = ()) -> Column:
    """Half-open ranges (start, end) of the tokens that latin_tokens gives."""
    return _ranges(lambda t: _words(t, abbreviations), False)(text)


def sentence_ranges(text: Column, abbreviations: tuple[str, ...] = ()) -> Column:
    """Half-open ranges of sentences; each line has sentences of its own."""
    return _ranges(lambda t: _sentences(t, abbreviations), True)(text)


def split_ranges(text: Column, ranges: Column) -> Column:
    """The parts of a text at half-open ranges."""
    return F.transform(ranges, lambda r: F.substring(text, r["start"] + 1, r["end"] - r["start"]))


def sentences(text: Column, abbreviations: tuple[str, ...] = ()) -> Column:
    return split_ranges(text, sentence_ranges(text, abbreviations))
