"""Token counts, the SentencePiece codec and token files against the libraries."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from corpusloom.llm import sentencepiece_codec, token_counts, token_files
from corpusloom.llm.vocab import NORMAL, pieces, tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")
WORDS = tokenizer_path("word_bpe_49k.json")
BITS = ["a", "aa", "b", "e", "th", " ", "  ", "   ", "\n", "é", "梦", "😀", "\t", "▁", "in", "er", "s", "0", "1", ".", "-", "==", "\x00", "<s>", " " * 17]
TEXTS = ["", " ", "   ", "\n\n", "a", " a", "a ", "The cat  sat.\nOn the\tmat", "aaaaaaaaaa", "Ünïcödé 日本語 🎉🎉", "x" * 3000, " " * 200 + "x", "<|endoftext|> it's", "ΑΣ σς", "a\x1cb"]


def drawn(n, seed=1):
    r = random.Random(seed)
    return TEXTS + ["".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_codec_equals_library():
    c = sentencepiece_codec.Codec(PIECES)
    for t in drawn(3000):
        assert np.frombuffer(c.encode(t), "<u4").tolist() == [1, *c.library.encode(t), 2], repr(t)


def test_codec_over_vocabulary_pairs():
    c, r = sentencepiece_codec.Codec(PIECES), random.Random(3)
    words = [p for p, _, t in pieces(PIECES) if t == NORMAL]
    for _ in range(3000):
        t = "".join(r.choice(words) for _ in range(3))
        assert np.frombuffer(c.encode(t), "<u4").tolist() == [1, *c.library.encode(t), 2], repr(t)


def test_codec_frame(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a cat", "z"), (3, "a cat", "z"), (None, "b", None)], "doc_id bigint, text string, n_tokens string")
    got = {r["doc_id"]: r for r in sentencepiece_codec.digests(docs, PIECES).collect()}
    empty = hashlib.sha256(struct.pack("<2I", 1, 2)).hexdigest()
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 2 and got[1]["ids_sha256"] == got[2]["ids_sha256"] == empty
    assert got[3]["decoded_sha256"] == hashlib.sha256(b"a cat").hexdigest() and None in got
    whole = sentencepiece_codec.encode_decode(docs, PIECES).where("doc_id = 3").collect()
    assert len(whole) == 2 and whole[0]["decoded_text"] == "a cat" and list(whole[0]["token_ids"])[0] == 1
    assert sentencepiece_codec.digests(docs.limit(0), PIECES).count() == 0


def test_unigram_counts_equal_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = pieces(PIECES)
    library = Tokenizer(models.Unigram([(p, s if t == NORMAL else -2e9) for p, s, t in v], unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    c = token_counts.counter(PIECES)
    texts = [t for t in drawn(3000, 2) if "<s>" not in t]
    for t in texts:
        assert c.tokens(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a cat"), (3, "a cat")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(docs, PIECES).collect()) == [(1, 0), (2, 0), (3, c.tokens("a cat")), (3, c.tokens("a cat"))]
    assert token_counts.token_counts(docs.limit(0), PIECES).count() == 0


def test_unigram_ties_and_unknown():
    c = token_counts.UnigramCounter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)], False)
    assert c.count("▁ab") == 2  # ▁|ab and ▁a|b and ▁|a|b tie: the piece that starts earliest wins
    assert c.count("▁xy") == 2  # one unknown stretch


def expected_files(texts):
    from tokenizers import Tokenizer

    library, start, out = Tokenizer.from_file(WORDS), 0, []
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, tmp_path):
    texts = [(i, t) for i, t in enumerate(drawn(150, 4))] + [(1000, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    token_files.write(docs.repartition(5), WORDS, str(tmp_path / "t"))
    want = expected_files(texts)
    assert sorted(tuple(r) for r in token_files.read(spark, str(tmp_path / "t"), with_ids=False).collect()) == want
    with_ids = {r["doc_id"]: list(r["token_ids"]) for r in token_files.read(spark, str(tmp_path / "t")).collect()}
    assert token_files.read_one(spark, str(tmp_path / "t"), 7) == with_ids[7]
    assert token_files.read_one(spark, str(tmp_path / "t"), 5000) is None


def test_token_files_edges(spark, tmp_path):
    docs = spark.createDataFrame([(None, "b"), (2, "a"), (2, "a"), (1, None)], "doc_id bigint, text string")
    got = token_files.write_and_read(docs, WORDS).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 2), (1, 1), (2, 2), (2, 2)]
    assert sorted(r["start"] for r in got) == [0, 2, 3, 5]
    assert token_files.write_and_read(docs.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 100])
def test_runs_of_spaces(n):
    c = sentencepiece_codec.Codec(PIECES)
    assert sum(c.table.run_lengths(n)) == n


def test_encoder_by_words_equals_library():
    r = random.Random(9)
    e = token_files.Encoder(tokenizer_path("word_bpe_49k.json"))
    assert e.by_words
    bits = ["don't", "'s", "S", "x", "é", "é", "Σ", "ΑΣ", "12", ".", ",", "(", ")", '"', "-", "_", "<|endoftext|>", "<|", "|>", "日本", "İ", "ß", " ", "​", " ", "  ", "\n", "\x1c", "\x85", "﻿", "`", "$"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for _ in range(2):  # the second time from the memo
        assert e.encode(texts, None) == e._ids(texts)
    long = ["ab" * 50_000, "word, " * 50_000, "=" * 100_000]
    assert e.encode(long, None) == e._ids(long) and all(len(w) <= token_files.MEMO_CHARS for w in e.memo)


def test_encoder_falls_back_to_whole_texts(tmp_path):
    import json

    file = json.load(open(tokenizer_path("word_bpe_49k.json")))
    file["pre_tokenizer"]["pretokenizers"][0]["behavior"] = "Isolated"
    file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\s*\p{L}+\s*\p{P}"
    (tmp_path / "t.json").write_text(json.dumps(file))
    e = token_files.Encoder(str(tmp_path / "t.json"))
    texts = ["one two, three", "a b", None, ""]
    assert not e.by_words and e.encode(texts, None) == e._ids([t or "" for t in texts])


def test_long_words_are_not_memoized(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    c, d = sentencepiece_codec.Codec(path), token_counts.counter(path)
    for text in ("ab" * 20_000 + " x " + "ab" * 20_000, "a b " * 50_000):
        ids = list(struct.unpack(f"<{len(c.encode(text)) // 4}i", c.encode(text)))
        assert ids == [c.library.bos_id(), *c.library.encode(text), c.library.eos_id()] and d.tokens(text) > 0
    assert max(map(len, [*c.after_space, *c.bare, *d])) <= token_counts.MEMO_CHARS


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7, b"x"), (2, None, None, None, None, None)], "doc_id bigint, text string, n_tokens int, start int, ids int, frame binary")
    assert [r["doc_id"] for r in token_counts.token_counts(docs, tokenizer_path("piece_bpe_32k.model")).orderBy("doc_id").collect()] == [1, 2]
    got = token_files.write_and_read(docs, tokenizer_path("word_bpe_49k.json")).orderBy("doc_id").collect()
    assert [(r["start"], r["n_tokens"]) for r in got] == [(0, 3), (3, 1)]


def test_pairs_of_pieces_are_remembered_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "MEMO_PAIRS", 50)
    c = sentencepiece_codec.Codec(PIECES)
    for t in drawn(300, 8):
        assert np.frombuffer(c.encode(t), "<u4").tolist() == [1, *c.library.encode(t), 2], repr(t)
    assert len(c.table.fits) == 50
