"""Reading public vocabulary files: SentencePiece protobufs and their piece types."""

from __future__ import annotations

import struct
from functools import lru_cache

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"


def tokenizer_path(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        if x < 128:
            return value, i
        shift += 7


def _fields(b: bytes):
    """(field number, value) of a protobuf message; values are ints, 4-byte floats or bytes."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 2:
            n, i = _varint(b, i)
            yield tag >> 3, b[i : i + n]
            i += n
        elif tag & 7 == 5:
            yield tag >> 3, struct.unpack("<f", b[i : i + 4])[0]
            i += 4
        elif tag & 7 == 1:
            i += 8
        else:
            v, i = _varint(b, i)
            yield tag >> 3, v


@lru_cache(maxsize=2)
def pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id."""
    out = []
    with open(path, "rb") as f:
        for number, body in _fields(f.read()):
            if number == 1:
                got = dict(_fields(body))
                out.append((got.get(1, b"").decode(), got.get(2, 0.0), got.get(3, NORMAL)))
    return out


def normalizer(path: str) -> dict[str, bool]:
    """What a SentencePiece file does to a text first: nothing (identity), a space put before it (prefix), runs of spaces squeezed."""
    with open(path, "rb") as f:
        spec = dict(next((list(_fields(body)) for number, body in _fields(f.read()) if number == 3), []))
    return {"identity": not spec.get(2), "prefix": bool(spec.get(3, 1)), "squeezed": bool(spec.get(4, 1))}
