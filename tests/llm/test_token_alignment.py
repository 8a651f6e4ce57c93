"""Token alignment against whole texts encoded by the libraries and all pairs of ends."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from corpusloom.llm import token_alignment as ta
from corpusloom.llm.vocab import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
BITS = ["the", "a", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "😀", "'s", "don't", "12", ".", ",", "(x)", "\x1c", "\x85", " ", "　", "<|endoftext|>", "<s>", "<unk>", "\r\n", "==", "\x00", "ing", "​", "é"]


def byte_level():
    from tokenizers import decoders

    level = decoders.ByteLevel()
    assert level.decode(["Ġ"]) == " "
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {c: b for b, c in zip(shown + [b for b in range(256) if b not in shown], map(chr, shown + [256 + i for i in range(68)]), strict=True)}


def plain(texts):
    """Of (doc_id, text)s, from whole texts and sets of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, chars = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_level()
    a.encode_special_tokens = True
    a_piece = {i: bytes(chars[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    b_piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, count = [], Counter()
    for doc, text in texts:
        ids = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text) if text else []
        spelled = [a_piece[i] for i in ids[0]], [b_piece(i) for i in ids[1]]
        if not text or b"".join(spelled[0]) != (" " + text).encode() or b"".join(spelled[1]) != (" " + text).encode():
            rows.append((doc, [], [], [], []))
            continue
        ends = []
        for s in spelled:
            at, of = 0, {}
            for k, p in enumerate(s):
                at += len(p)
                of[at] = k
            ends.append(of)
        both = sorted(ends[0].keys() & ends[1].keys())
        links = [(ids[0][ends[0][e]], ids[1][ends[1][e]]) for e in both]
        count.update(links)
        groups, i, j = [], 0, 0
        for e in both:
            groups.append((ids[0][i : ends[0][e] + 1], ids[1][j : ends[1][e] + 1]))
            i, j = ends[0][e] + 1, ends[1][e] + 1
        rows.append((doc, *ids, groups, links))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for doc, x, y, groups, links in rows:
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if x else ""
        out.append((doc, len(x), len(y), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out)


def drawn(n, seed=1):
    r = random.Random(seed)
    fixed = [None, "", " ", "  ", "\n", " a", "a ", "a\n", "\na", "a\n b", "a \nb", "▁", "a ▁ b", "a" * 3000, "The cat  sat on\nthe mat.\n\nNext\tone", "word " * 2000]
    return list(enumerate(fixed + ["".join(r.choice(BITS) for _ in range(r.randint(1, 25))) for _ in range(n)]))


@pytest.mark.parametrize("small", [1 << 24, 0])
def test_equals_whole_texts(spark, small):
    texts = drawn(1500 if small else 200)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    assert sorted(tuple(r) for r in ta.align_tokens(docs, A, B, small).collect()) == plain(texts)


def test_groups_and_labels():
    assert ta.labels([1, 2, 1], [3, 1]) == bytes([1, 0, 3, 3])
    assert ta.groups([7, 8, 9], [5, 6], bytes([1, 0, 3, 3])) == [([7, 8], [5]), ([9], [6])]
    assert ta.groups([1, 2], [3, 4], ta.labels([2, 2], [1, 3])) == [([1, 2], [3, 4])]


def test_stretches_join_to_the_text():
    patterns = ta.stretch_pattern(""), ta.Aligner(A, B).pattern
    assert patterns[1].findall(" ab,. cd") == [" ab", ",.", " cd"] and patterns[1].findall(" ab,c") == [" ab,c"]
    for _, t in drawn(3000, 5):
        for pattern in patterns:
            got = pattern.findall(" " + (t or ""))
            assert not got or "".join(got) == " " + t


def test_groups_column_memo_and_edges(spark):
    docs = spark.createDataFrame([(None, "a cat", 1, "x"), (1, "a cat", 1, "x"), (1, None, 2, None)], "doc_id bigint, text string, links int, token_groups string")
    rows = ta.token_groups(docs, A, B).collect()
    assert [len(r["token_groups"]) for r in rows].count(0) == 1 and all([g["a"] for g in r["token_groups"]] for r in rows if r["text"])
    assert sorted(r["count_sum"] for r in ta.align_tokens(docs, A, B).collect()) == [0, 4, 4]
    assert ta.align_tokens(docs.limit(0), A, B).count() == 0
    al = ta.Aligner(A, B)
    al.align(["x" * 100_000 + " y", None])
    assert max(map(len, al.memo)) <= ta.MEMO_CHARS
