"""Near-duplicate detection by SetSketch registers.

A document is the set of its distinct word shingles. Register i keeps the least of exponentially
distributed hashes of the set's members, on an exponential scale: floor(1 - log_b(least)), cut off at
0 and LIMIT. The registers of a union are the greater of either's, and equal registers become likelier
with the Jaccard similarity, so bands of registers serve as keys of a locality-sensitive search.

Steps, each a Spark job on keys that texts share:
1. Sets: equal sets are one node from here on, whatever number of documents has them.
2. Bands: nodes with an equal band meet. Each is paired with the band's least node only, not with all
   others, so a group of any size makes as many pairs as it has members.
3. Estimate: the likelihood of the registers' order (less, equal, greater) gives the similarity; pairs
   that are surely below the threshold are left out.
4. Verify on the full sets, of each node only the likeliest pair. These links make a forest.
5. Members of a band that are still unconnected are paired likewise with a member of the band's largest
   component, a few times over.
6. What then remains outside is joined exactly, with a prefix filter: members are ordered by how rare they
   are among those sets, and two sets of the similarity asked for share one of the first 11 % of the
   smaller's members that is also one of the first 20 % of the larger's, and their sizes differ by no more
   than 20 %. Sets that share a lot, but not enough, differ in these parts and never meet, however many
   they are. So no link between nodes that share a band is lost, only such as join what is joined already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import arrow_map, bounded, mix, shingles, stash

#: Registers in BANDS bands of ROWS. At a similarity of 0.8, 6 in 100,000 pairs share no band.
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
BASE_LOG = np.log(1.005)
LIMIT = 65534
#: Pairs with an estimate below the threshold by this much (over 4 standard errors) aren't verified.
SLACK = 0.12
#: Times that unconnected members of a band are paired with a member of its largest component.
TURNS = 3
#: Counters of how frequent members are; a smaller number only makes the order of members less apt.
COUNTERS = 1 << 18

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def joined_words(text: str | None) -> bytes:
    """Words (ASCII letters lower-cased, cut at ASCII white space) with single spaces between."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""


def registers(members: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    step = 2048
    for i in range(0, len(members), step):
        h = members[None, i : i + step] * _A[:, None]
        h += _B[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    u = (least.astype(np.float64) + 1) / 2.0**64
    e = np.maximum(-np.log1p(-np.minimum(u, 1 - 2.0**-53)), 1e-300)
    return np.clip(np.floor(1 - np.log(e) / BASE_LOG), 0, LIMIT).astype(np.uint16)


def node_of(members: np.ndarray) -> int | None:
    """A 63-bit name of a set; None for the empty set."""
    if not len(members):
        return None
    with np.errstate(over="ignore"):
        weight = mix(members + np.uint64(0x632BE59BD9B4E019))
        return int(mix(np.array([weight.sum() + np.uint64(len(members))], np.uint64))[0] >> np.uint64(1))


def sketch_documents(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, node, n_shingles, sketch) of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        nodes, sizes, sketches = [], [], []
        for t in batch.column(1).to_pylist():
            s = shingles(joined_words(t), k)
            nodes.append(node_of(s))
            sizes.append(len(s))
            sketches.append(registers(s).tobytes() if len(s) else None)
        return {"doc_id": batch.column(0), "node": nodes, "n_shingles": sizes, "sketch": sketches}

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, node bigint, n_shingles bigint, sketch binary")


def band_keys(nodes: DataFrame) -> DataFrame:
    """(node, key), one row for each band."""

    def run(batch):
        got = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.full(got.shape[:2], 0, np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + got[:, :, i])
        flat = pa.array(key.view(np.int64).ravel())
        return {"node": batch.column(0), "keys": pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)}

    return arrow_map(nodes.select("node", "sketch"), run, "node bigint, keys array<bigint>").select("node", F.explode("keys").alias("key"))


def likeliest(less: np.ndarray, equal: np.ndarray, greater: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, given how registers of a compare with those of b.

    With sets of na and nb members, of which the shares u and v of the union are only in a or b, a
    register of a is the greater with probability log_b(1 + ...), here for the nearly continuous scale
    of a base near 1: u, and v for less; equal with the rest. Newton steps on the similarity.
    """
    m = less + equal + greater
    share = na / (na + nb)  # of a among all members; similarity j gives u = share (1 + j) - j
    j = np.clip(equal / m, 1e-3, 1 - 1e-3)
    most = np.minimum(na, nb) / np.maximum(na, nb)
    for _ in range(8):
        u = np.maximum(share * (1 + j) - j, 1e-9)
        v = np.maximum((1 - share) * (1 + j) - j, 1e-9)
        du, dv = share - 1, -share
        grad = greater * du / u + less * dv / v + equal / j
        hess = -greater * (du / u) ** 2 - less * (dv / v) ** 2 - equal / j**2
        j = np.clip(j - grad / np.minimum(hess, -1e-9), 1e-3, np.maximum(most, 2e-3))
    return j


def _estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return likeliest((a < b).sum(-1), (a == b).sum(-1), (a > b).sum(-1), na, nb)


def estimate(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, likeness) of the pairs whose estimated similarity is at least that."""
    one = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    two = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb", "na", "nb")

    def run(batch):
        sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
        na, nb = (np.asarray(batch.column(i), np.float64) for i in (4, 5))
        return {"a": batch.column(0), "b": batch.column(1), "likeness": _estimates(sa, sb, na, nb)}

    return arrow_map(both, run, "a bigint, b bigint, likeness double").where(F.col("likeness") >= least)


def member_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, sketch, n_shingles, members) of the nodes in rows; members are the full sets."""
    ends = stash(rows.select("node").distinct(), "ends")
    # One document stands for each node; only those documents' texts are read on.
    chosen = nodes.join(bounded(ends), "node").select(F.col("doc_id").alias("chosen")).distinct()
    texts = docs.select("doc_id", "text").join(bounded(stash(chosen, "chosen")), F.col("doc_id").eqNullSafe(F.col("chosen")), "left_semi")

    def run(batch):
        names, sets = [], []
        for t in batch.column(1).to_pylist():
            s = shingles(joined_words(t), k)
            names.append(node_of(s))
            sets.append(s.view(np.int64))
        return {"node": names, "members": pa.array(sets, pa.list_(pa.int64()))}

    sets = arrow_map(texts, run, "node bigint, members array<bigint>").where("node is not null")
    sets = sets.join(bounded(ends), "node", "left_semi").groupBy("node").agg(F.first("members").alias("members"))
    return stash(sets.join(nodes.select("node", "sketch", "n_shingles"), "node"), "sets")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have a similarity of at least percent / 100."""
    one = sets.select(F.col("node").alias("a"), F.col("members").alias("ma"))
    two = sets.select(F.col("node").alias("b"), F.col("members").alias("mb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("ma", "mb")).cast("bigint")
    both = both.select("a", "b", shared.alias("shared"), (F.size("ma") + F.size("mb")).cast("bigint").alias("total"))
    return stash(both.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b"), "links")


def tops(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b) in which each b has one a, and a < b: follow them, twice as far each time."""
    at = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    while True:
        up = at.select(F.col("node").alias("root"), F.col("root").alias("further"))
        at = stash(at.join(up, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "tops")
        moved = not at.where("moved").isEmpty()
        at = at.select("node", "root")
        if not moved:
            return at


def unconnected(rows: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """(key, node, root) of bands with several components, and what is known of each such band.

    top is the component with most members there, head one of its members (another in each turn), size
    the band's number of members and rest the number of those outside top.
    """
    named = rows.join(roots, rows["node"] == roots["node"], "left").select("key", rows["node"], F.coalesce("root", rows["node"]).alias("root"))
    named = stash(named, "named-bands")
    parts = named.groupBy("key", "root").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("head"))
    bands = parts.groupBy("key").agg(F.count("*").alias("n_roots"), F.sum("n").alias("size"), F.max(F.struct("n", "root", "head")).alias("most")).where("n_roots > 1")
    bands = bands.select("key", "size", F.col("most.root").alias("top"), F.col("most.head").alias("head"), (F.col("size") - F.col("most.n")).alias("rest"))
    return stash(named.join(bands, "key"), "open-bands")


def prefixes(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the prefixes of sets of n members: as the smaller of two, and as the larger.

    Two sets of sizes n <= m that are similar share at least share * (n + m) members, share being
    percent / (100 + percent): 2 n share of the smaller's own, and percent of the larger's.
    """
    least = -(-2 * percent * n // (100 + percent))
    return n - least + 1, n - -(-percent * n // 100) + 1


def late_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be links of a member outside its band's largest component, rows being of unconnected()."""
    nodes = rows.groupBy("node").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("top")).alias("outside"))
    nodes = stash(nodes.join(sets.select("node", "n_shingles", "members"), "node"), "open-sets")
    bucket = F.pmod(F.col("m"), F.lit(COUNTERS)).cast("int")
    counts = nodes.select(F.explode("members").alias("m")).groupBy(bucket.alias("at")).agg(F.count("*").alias("n")).toArrow()  # at most COUNTERS rows, two numbers each
    frequency = np.zeros(COUNTERS, np.int64)
    frequency[counts["at"].to_numpy()] = counts["n"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(frequency)

    def run(batch):
        first, at = [], []
        for members in batch.column(4):
            m = members.values.to_numpy()
            m = m[np.lexsort((m, shared.value[m & (COUNTERS - 1)]))]
            k = int(prefixes(np.array(len(m)), percent)[1])
            first.append(m[:k])
            at.append(np.arange(k, dtype=np.int32))
        kept = {name: batch.column(i) for i, name in enumerate(("node", "root", "outside", "n"))}
        return kept | {"first": pa.array(first, pa.list_(pa.int64())), "at": pa.array(at, pa.list_(pa.int32()))}

    made = arrow_map(nodes.select("node", "root", "outside", F.col("n_shingles").alias("n"), "members"), run, "node bigint, root bigint, outside boolean, n bigint, first array<bigint>, at array<int>")
    each = stash(made.select("node", "root", "outside", "n", F.explode(F.arrays_zip("first", "at")).alias("x")).select("node", "root", "outside", "n", F.col("x.first").alias("m"), "x.at"), "prefixes")
    n, share = F.col("n"), 100 + percent
    small = each.where(F.col("at") < n - F.ceil(2 * percent * n / share) + 1)
    one, two = (df.select("m", *[F.col(c).alias(c + t) for c in ("node", "root", "outside", "n", "at")]) for df, t in ((small, "1"), (each, "2")))
    sizes = (F.col("n1") <= F.col("n2")) & (percent * F.col("n2") <= 100 * F.col("n1"))
    apart = (F.col("root1") != F.col("root2")) & (F.col("outside1") | F.col("outside2"))
    # What both can share from this member on, if it is the first that they share.
    room = share * F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) >= percent * (F.col("n1") + F.col("n2"))
    pairs = one.join(two, "m").where(sizes & apart & room).select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
    return stash(pairs, "late-pairs")


def connected(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links (a, b)."""
    joined = stash(components(_named(links, roots)).select(F.col("node").alias("old"), F.col("root").alias("new")), "joined")
    ends = joined.select(F.col("old").alias("node"), F.col("new").alias("root")).join(roots.select("node"), "node", "left_anti")
    moved = roots.join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return stash(moved.unionByName(ends), "roots")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    component_id is the least doc_id that links lead to, the document's own included; kept marks the
    document with that id. Texts with fewer words than k are one shingle; null texts and those without
    words have none, are linked with nothing and are kept. Repeated rows share their component, and all
    rows with the kept id are kept. A null doc_id is never the least; without any id component_id is
    null and the row is kept. An empty table gives an empty table.
    """
    sketches = stash(sketch_documents(docs, k), "sketches")
    nodes = sketches.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n_docs"))
    nodes = stash(nodes, "nodes")
    rows = stash(band_keys(nodes), "bands")
    heads = rows.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    rows = stash(rows.join(heads, "key"), "shared-bands")
    pairs = rows.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    least = percent / 100 - SLACK
    sets = member_sets(docs, rows, nodes, k)

    def likely(pairs: DataFrame) -> DataFrame:
        best = estimate(pairs, sets, least).groupBy("b").agg(F.max_by("a", F.struct("likeness", "a")).alias("a"))
        return verify(stash(best, "likeliest"), sets, percent)  # two plans of two joins: a plan costs the driver its size at each step

    roots = tops(likely(pairs))
    still = unconnected(rows, roots, 0)
    for turn in range(1, TURNS + 1):
        links = likely(still.where("root <> top").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())
        if links.isEmpty():
            break
        roots = connected(roots, links)
        still = unconnected(still.select("key", "node"), roots, turn)
    links = verify(late_pairs(still, sets, percent), sets, percent)
    if not links.isEmpty():
        roots = connected(roots, links)
    # By node, so that a set which a third of the documents have is one row; only then by document.
    named = nodes.select("node", "doc_id", "n_docs").join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select("node", "doc_id", "n_docs", F.coalesce("root", "node").alias("root"))
    first = named.groupBy("root").agg(F.min("doc_id").alias("first"), F.sum("n_docs").alias("n")).where("n > 1").select("root", "first")
    first = stash(named.join(first, "root").select(F.col("node").alias("of"), "first"), "first")
    out = sketches.select("doc_id", "node", "n_shingles").join(bounded(first), F.col("node") == F.col("of"), "left").withColumn("component_id", F.coalesce("first", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _named(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges (u, v) between the components that links (a, b) join."""
    one = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    two = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    both = links.join(one, "a", "left").join(two, "b", "left")
    return both.select(F.coalesce("ra", "a").alias("u"), F.coalesce("rb", "b").alias("v"))
