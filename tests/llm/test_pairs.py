"""Near duplicates, decontamination and fingerprints against brute force."""

import collections
import hashlib
import random
import re
import time
import tracemalloc

import numpy as np
from corpusloom.llm import decontamination, fingerprints, near_dedup
from pyspark.sql import functions as F

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCAB = [a + b for a in "bcdfgklm" for b in ("a", "E", "io", "ü")]


def text(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edit(r, t, n):
    w = t.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(VOCAB)
    return " ".join(w)


def brute_components(rows, k):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))
        sets.append((i, {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, o in sets[:a]:
            if s and o and 100 * len(s & o) >= 80 * len(s | o):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "one")]
    base = text(r, 150)
    for i in range(10, 90):  # a group whose members are like the base, but not all like each other
        rows.append((i, edit(r, base, r.randint(0, 5))))
    chain = text(r, 120)
    for i in range(100, 120):  # a chain: each like the one before
        rows.append((i, chain))
        chain = edit(r, chain, 3)
    rows += [(i, text(r, r.randint(1, 200))) for i in range(200, 260)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id bigint, text string, node string, sketch int").repartition(3)
    want = brute_components(rows, 4)
    got = {x["doc_id"]: x for x in near_dedup.near_duplicates(docs, k=4).collect()}
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in got.items()} == want
    assert all(x["kept"] == (i == x["component_id"]) for i, x in got.items())


def test_unconnected_band_members_meet(spark):
    """The exact way for bands whose members the heads leave unconnected."""
    r = random.Random(6)
    base = text(r, 200)
    rows = [(i, edit(r, base, 4)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sketches = near_dedup.sketch_documents(docs, 4).cache()  # all sets differ, so documents are nodes
    keys = near_dedup.band_keys(sketches)
    roots = spark.createDataFrame([], "node bigint, root bigint")
    sets = near_dedup.member_sets(docs, keys, sketches, 4)
    links = near_dedup.verify(near_dedup.late_pairs(near_dedup.unconnected(keys, roots, 0), sets, 80), sets, 80).collect()
    at = {x["doc_id"]: x["node"] for x in sketches.collect()}
    parent = {n: n for n in at.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in links:
        parent[find(x["a"])] = find(x["b"])
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for i, (_, root) in brute_components(rows, 4).items():
        want[root].add(i)
        got[find(at[i])].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert len(links) < 30 * 30 and len(want) < 30


def late_tables(spark, sets):
    """One open band of given sets, none connected."""
    rows = spark.createDataFrame([(1, n, n) for n in sets], "key bigint, node bigint, root bigint").withColumn("top", F.lit(min(sets)).cast("bigint"))
    return rows, spark.createDataFrame([(n, len(m), sorted(m)) for n, m in sets.items()], "node bigint, n_shingles bigint, members array<bigint>")


def test_late_pairs_lose_no_link(spark):
    r = random.Random(12)
    base = [r.getrandbits(62) for _ in range(120)]
    sets = {n: set(r.sample(base, r.randint(1, 120))) | {r.getrandbits(62) for _ in range(r.choice([0, 1, 5, 20]))} for n in range(150)}
    sets |= {200 + i: set(base[: 100 + i]) for i in range(20)} | {300 + i: set(base) - set(r.sample(base, i)) for i in range(20)}
    rows, table = late_tables(spark, sets)
    links = {(x["a"], x["b"]) for x in near_dedup.verify(near_dedup.late_pairs(rows, table, 80), table, 80).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links == want and len(want) > 100


def test_near_misses_never_meet(spark):
    """5,000 texts that share 70 % with each other, all of one band: no pairs, let alone all of them."""
    r = random.Random(13)
    common = [r.getrandbits(62) for _ in range(140)]
    sets = {n: {*common, *(r.getrandbits(62) for _ in range(30))} for n in range(5000)}
    rows, table = late_tables(spark, sets)
    assert near_dedup.late_pairs(rows, table, 80).count() == 0


def test_counters_are_small_on_the_driver(spark):
    """Long sets fill all counters; the driver gets two arrays of numbers, not an object for each counter."""
    members = F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.xxhash64("node", i))
    sets = spark.range(1, 9).select(F.col("id").alias("node")).select("node", F.lit(60_000).cast("bigint").alias("n_shingles"), members.alias("members"))
    rows = sets.select(F.lit(1).cast("bigint").alias("key"), "node", F.col("node").alias("root"), F.lit(1).cast("bigint").alias("top"))
    tracemalloc.start()
    assert near_dedup.late_pairs(rows, sets, 80).isEmpty()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6, most


def test_near_duplicates_of_very_long_texts(spark):
    r = random.Random(14)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " more words at the end"), (3, " ".join(long.split()[:30_000])), (4, "=" * 200_000)]
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=4).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_near_duplicates_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "x"), (None, None)], "doc_id bigint, text string")
    got = sorted((x["doc_id"] or -1, x["component_id"] or -1, x["kept"]) for x in near_dedup.near_duplicates(docs).collect())
    assert got == [(-1, -1, True), (-1, 7, False), (7, 7, True), (7, 7, True), (9, 9, True)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = h[:2000], h[200:2200]
    assert (np.maximum(near_dedup.registers(a), near_dedup.registers(b)) == near_dedup.registers(np.union1d(a, b))).all()
    j = near_dedup._estimates(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([2000.0]), np.array([2000.0]))
    assert abs(j[0] - 1800 / 2200) < 0.1


def brute_contamination(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = pattern.findall((t or "").translate(AZ))
        k = min(13, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[p : p + k])].update([] if i is None else [str(i)])
    out = {}
    for i, t in docs:
        w = pattern.findall((t or "").translate(AZ))
        hit, which = set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit.update(range(p, p + k))
                    which |= windows[tuple(w[p : p + k])]
        out[i] = (len(w), len(hit), sorted(which), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_contamination_equals_brute_force(spark):
    r = random.Random(8)
    items = [(i, text(r, r.randint(1, 60))) for i in range(30)] + [(50, None), (51, ""), (52, "?!"), (53, "ba BE"), (54, "ba BE"), (55, "ba " * 40), (None, text(r, 20))]
    docs = [(0, None), (1, ""), (2, "ba, be."), (3, "ba " * 100), (4, text(r, 300))]
    for i in range(10, 60):
        item = (items[r.randrange(30)][1] or "").split()
        a = r.randrange(len(item))
        part = item[a : a + r.choice([5, 12, 13, 14, 40])]
        docs.append((i, (text(r, r.randint(0, 200)) + ".\n" + "; ".join(part) + " " + text(r, r.randint(0, 50)) + " " + " ".join(item)).upper()))
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_contamination(docs, [(i, t) for i, t in items])
    for limit in (decontamination.ITEM_BYTES, 0):  # broadcast and joined
        got = decontamination.contamination(frame, bench, limit).collect()
        assert {x["doc_id"]: (x["n_words"], x["n_hit"], x["item_ids"], x["contaminated"]) for x in got} == want
    d = decontamination.digests(decontamination.contamination(frame, bench)).where("doc_id = 2").first()
    assert d["items_sha256"] == decontamination.sha256_of(["53", "54"]) and d["n_items"] == 2 and d["contaminated"]
    assert decontamination.contamination(frame.limit(0), bench).count() == 0
    assert decontamination.contamination(frame, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0


def test_repetitive_texts_take_linear_time():
    took = []
    for n in (20_000, 80_000):
        items = decontamination.Items([(i, "ba " * n) for i in range(3)])
        began = time.time()
        hit, which = items.hits(decontamination.words_of("ba " * 2 * n + "x"))
        took.append(time.time() - began)
        assert hit.sum() == 2 * n and which == {"0", "1", "2"}
    assert took[1] < 8 * took[0] + 1


def test_one_word_of_any_size_is_a_long_text(spark):
    docs, items = spark.createDataFrame([(1, "é" * 300_000), (2, "x")], "doc_id bigint, text string"), spark.createDataFrame([(1, "é" * 300_000)], "item_id bigint, text string")
    for limit in (decontamination.ITEM_BYTES, 1000):
        got = {r["doc_id"]: r for r in decontamination.contamination(docs, items, limit).collect()}
        assert got[1]["n_hit"] == got[1]["n_words"] == 1 and got[1]["item_ids"] == ["1"] and not got[2]["contaminated"]


def test_fingerprints(spark):
    r = random.Random(9)
    rows = [(i, text(r, r.choice([0, 1, 4, 30, 400]))) for i in r.sample(range(10_000), 120)] + [(20_000, None)]
    docs = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id bigint, text string, fingerprint string").repartition(7)
    got = {x["doc_id"]: x for x in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda x: -x[0])
    for n, (i, t) in enumerate(order):
        t, following = t or "", order[(n + 1) % len(order)][1] or ""
        m = len(t) // 3
        other = t[: len(t) - m] + following[:m]
        x = got[i]
        assert (x["n_chars"], x["edited_sha256"]) == (len(t), hashlib.sha256(other.encode()).hexdigest())
        a, b, c = shingle_set(t), shingle_set(other), shingle_set(following)
        for name, o in (("edited", b), ("next", c)):
            shares = [1.0, 1.0] if a == o else [len(a & o) / len(y) if y else 0.0 for y in (a, o)]
            if len(a) <= fingerprints.FLOOR >= len(o):  # nothing is estimated
                assert [x[f"share_in_{name}"], x[f"share_of_{name}"]] == shares
            elif min(len(a), len(o)) > 300:
                assert abs(x[f"share_in_{name}"] - shares[0]) < 0.2 and abs(x[f"share_of_{name}"] - shares[1]) < 0.2
            assert x[f"near_{name}"] == max(x[f"share_in_{name}"], x[f"share_of_{name}"])
        assert (x["fingerprint"] == x["edited_fingerprint"]) == (a == b)


def shingle_set(t, k=5):
    w = t.translate(AZ).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_short_texts_are_like_their_edited_ones(spark):
    r = random.Random(3)
    rows = [(i, text(r, 12)) for i in range(50)]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(0 < x["near_edited"] <= 1 for x in got)


def test_fingerprints_merge():
    r = random.Random(6)
    for _ in range(60):
        texts = [text(r, r.choice([0, 3, 40, 80, 300, 2000])) for _ in range(r.randint(1, 4))]
        kept, reach = fingerprints.merge([(s.n, s.kept) for s in map(fingerprints.Sketch, texts)])
        of_each = [fingerprints.shingles(" ".join(t.lower().split()).encode(), 5) >> np.uint64(16) for t in texts]
        union = np.unique(np.concatenate(of_each))
        assert (kept == fingerprints._keep(union)).all() and (union[union <= np.uint64(reach)] == kept).all()


def test_very_long_text_and_its_part():
    r = random.Random(7)
    long = " ".join(f"w{r.randrange(10**9)}" for _ in range(100_000))
    a, b = fingerprints.Sketch(long), fingerprints.Sketch(" ".join(long.split()[500:1500]))
    shares = fingerprints.containments(b, a)
    assert shares[0] == 1.0 and abs(shares[1] - 0.01) < 0.002


def test_fingerprint_strings_and_containment():
    r = random.Random(10)
    part, rest = text(r, 2000), text(r, 8000)
    a, whole = fingerprints.Sketch(part), fingerprints.Sketch(part + " " + rest)
    n, digest, kept = fingerprints.parse(str(a))
    assert (n, digest) == (a.n, a.digest) and (kept == a.kept).all()
    assert fingerprints.containment(a.kept, whole.kept) == 1.0
    assert abs(fingerprints.containment(whole.kept, a.kept) - 0.2) < 0.04


def test_fingerprints_odd_rows(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h i")], "doc_id bigint, text string")
    assert fingerprints.fingerprints(one).first()["near_next"] == 1.0
    assert fingerprints.fingerprints(one.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x"), (1, "y"), (1, "z"), (1, "z")], "doc_id bigint, text string")
    assert fingerprints.fingerprints(odd).count() == 4
