"""Pairs of near vectors by pivots, and what rests on them: nearest neighbours, reachability, clusters at all densities.

Some vectors, drawn by a hash, are pivots. Vectors are sorted by their nearest pivot and their distance from it and cut into short runs; a run
holds, for each pivot, the least and greatest distance of its vectors. By the triangle inequality two runs have vectors within r of each
other only if these ranges come within r for every pivot. Runs lie in packs, and packs meet packs without a shuffle, so a vector is stored once,
however little the pivots part. Equal vectors are one vector with a count, so copies make no pairs. Distances are matrix products
within a task, and only pairs within r leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sizes import join_counted
from ..storage import stash
from .graph import components

#: Pivots at most; there are about as many as the root of the number of vectors.
PIVOTS = 1024
#: Vectors of a run at most, and of a pack.
BLOCK = 64
PACK = 2048
#: Pairs of vectors that are looked at one by one, or given back, at a time.
CHUNK = 1 << 16


def distinct_points(points: DataFrame) -> DataFrame:
    """(id, vector, n) of points (id, vector): each different vector once, with its least id and its number. Null vectors are left out."""
    return points.where("vector is not null").groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), "n")


def _pivots(points: DataFrame, n: int, most: int) -> np.ndarray:
    wanted = max(1, min(most, int(n**0.5)))
    share = F.pmod(F.xxhash64("vector", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2.0 * wanted / max(1, n))) + 1
    rows = points.where(share).select("vector").limit(2 * wanted).collect()
    return np.array([r["vector"] for r in rows or points.select("vector").limit(1).collect()], np.float64)


def _about(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between rows of a and of b, as matrix products give them: near ones aren't exact."""
    return np.sqrt(np.maximum(0.0, np.square(a).sum(1)[:, None] + np.square(b).sum(1)[None] - 2 * a @ b.T))


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """By how much a distance of _about() may be wrong at most."""
    scale = max(float(np.abs(x).max(initial=0.0)) for x in (a, b))
    return 1e-6 * scale * max(1, a.shape[1])


def packs(points: DataFrame, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(pack, ids, dim, vectors, runs, low, high): vectors (id, vector) in packs of about PACK, vectors being numbers of 4 bytes if these hold them.

    runs are the sizes of a pack's runs; low and high their distances from each pivot, rounded outwards.
    """
    base, n = points.select("id", "vector"), points.count()
    spark, centres = points.sparkSession, _pivots(base, n, pivots)
    shared = spark.sparkContext.broadcast(centres)
    kind = points.schema["id"].dataType.simpleString()
    size = max(block, min(PACK, -(-n // 16)))
    matrix = lambda batch, c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                d = _about(matrix(part, 1), shared.value)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(d[np.arange(len(d)), own]), part.column(0), part.column(1)], names=["cell", "far", "id", "vector"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x, cells = matrix(part, 3), part.column(0).to_numpy()
                fresh = np.concatenate([[True], np.diff(cells) != 0])
                begins = np.flatnonzero(fresh)
                begins = np.flatnonzero((np.arange(len(x)) - begins[np.cumsum(fresh) - 1]) % block == 0)
                d, slack = _about(x, shared.value), _slack(x, shared.value)
                low, high = (np.nextafter((f.reduceat(d, begins) + s).astype(np.float32), np.float32(to)) for f, s, to in ((np.minimum, -slack, -np.inf), (np.maximum, slack, np.inf)))
                short = x.astype(np.float32)
                held = short if (short == x).all() else x
                runs = np.diff(np.append(begins, len(x))).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"pack": pa.array([made]), "ids": pa.ListArray.from_arrays([0, len(x)], part.column(2)), "dim": pa.array([x.shape[1]], pa.int32()), "vectors": pa.array([held.tobytes()]), "runs": pa.ListArray.from_arrays([0, len(runs)], pa.array(runs)), "low": pa.array([low.tobytes()]), "high": pa.array([high.tobytes()])})
                made += 1

    files = max(min(24, -(-n // size)), n * centres.shape[-1] // (2 << 20), 1)
    dealt = base.mapInArrow(nearest, f"cell bigint, far double, id {kind}, vector array<double>").repartitionByRange(files, "cell", "far", F.xxhash64("id")).sortWithinPartitions("cell", "far")
    return stash(dealt.mapInArrow(pack, f"pack bigint, ids array<{kind}>, dim int, vectors binary, runs array<int>, low binary, high binary"), "packs")


def _met(made: DataFrame) -> DataFrame:
    """Each pack with itself and each later one."""
    a, b = (made.select(*[F.col(c).alias(f"{side}_{c}") for c in made.columns]) for side in "ab")
    return a.join(b, F.col("a_pack") <= F.col("b_pack"))


def _candidates(batches: Iterator[pa.RecordBatch], radius: float):
    """For each row of _met(): whether a pack meets itself, ids and vectors of both, and where their rows may come within the radius, as pairs of indices."""
    for batch in batches:
        names = batch.schema.names
        for row in range(batch.num_rows):
            of = {name: batch.column(k)[row] for k, name in enumerate(names)}
            ids, runs = ([of[f"{s}_{c}"].values for s in "ab"] for c in ("ids", "runs"))
            low, high = ([np.frombuffer(of[f"{s}_{c}"].as_buffer(), np.float32).reshape(len(n), -1) for s, n in zip("ab", runs, strict=True)] for c in ("low", "high"))
            x = []
            for s in "ab":
                raw, dim = of[f"{s}_vectors"].as_buffer(), of[f"{s}_dim"].as_py()
                n = len(of[f"{s}_ids"].values)
                x.append(np.frombuffer(raw, np.float32 if raw.size == 4 * n * dim else np.float64).reshape(n, dim))
            yield of["a_pack"].as_py() == of["b_pack"].as_py(), ids, x, _regions([n.to_numpy() for n in runs], low, high, radius)


def _regions(runs: list[np.ndarray], low: list[np.ndarray], high: list[np.ndarray], radius: float) -> list[tuple[np.ndarray | slice, np.ndarray | slice]]:
    every, r = slice(None), np.float32(radius * (1 + 1e-5))
    if (np.maximum(low[0].min(0) - high[1].max(0), low[1].min(0) - high[0].max(0)) > r).any():
        return []
    near = np.stack([~(np.maximum(low[0][k] - high[1], low[1] - high[0][k]) > r).any(1) for k in range(len(low[0]))])
    if (near * runs[0][:, None] * runs[1][None]).sum() > 0.3 * runs[0].sum() * runs[1].sum():
        return [(every, every)]
    ends = np.cumsum(runs[0])
    return [(np.arange(end - n, end), np.flatnonzero(np.repeat(of, runs[1]))) for end, n, of in zip(ends, runs[0], near, strict=True) if of.any()]


def _close(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of rows within a radius, and maybe some others."""
    scale = float(np.square(a).sum(1, dtype=float).max() + np.square(b).sum(1, dtype=float).max())
    slack = 4e-7 * (a.shape[1] + 8) * scale
    if a.dtype != np.float32 or b.dtype != np.float32 or not slack < 0.01 * radius * radius:
        a, b, slack = a.astype(float), b.astype(float), 1e-9 * (1 + scale)
    half = a @ b.T
    half -= (np.square(a).sum(1) / 2)[:, None]
    half -= (np.square(b).sum(1) / 2)[None]
    return np.nonzero(half >= -(radius * radius + slack) / 2)


def within(points: DataFrame, radius: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(a, b, dist), a < b, of all pairs of different vectors (id, vector) within a radius, which must be above 0."""
    if radius <= 0:
        raise ValueError("a radius is above 0")
    kind = points.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for same, (a_ids, b_ids), (a, b), regions in _candidates(batches, radius):
            for rows, columns in regions:
                found = _close(a[rows], b[columns], radius)
                for at in range(0, len(found[0]), CHUNK):
                    i, j = (np.arange(len(x))[of][f[at : at + CHUNK]] for x, of, f in ((a, rows, found[0]), (b, columns, found[1])))
                    d = np.sqrt(np.square(a[i].astype(float) - b[j].astype(float)).sum(1))
                    i, j, d = (v[d <= radius] for v in (i, j, d))
                    left, right = a_ids.take(pa.array(i)), b_ids.take(pa.array(j))
                    first = pc.less(left, right)
                    keep = first if same else pc.not_equal(left, right)
                    yield pa.RecordBatch.from_arrays([v.filter(keep) for v in (pc.if_else(first, left, right), pc.if_else(first, right, left), pa.array(d))], names=["a", "b", "dist"])

    return _met(packs(points, pivots, block)).mapInArrow(run, f"a {kind}, b {kind}, dist double")


def compared(points: DataFrame, radius: float, pivots: int = PIVOTS, block: int = BLOCK) -> tuple[int, int]:
    """How many pairs within() computes, each way, and how many there are."""
    n = points.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for same, ids, _, regions in _candidates(batches, radius):
            pairs = sum(len(np.arange(len(ids[0]))[rows]) * len(np.arange(len(ids[1]))[columns]) for rows, columns in regions)
            yield pa.RecordBatch.from_pydict({"n": pa.array([pairs if same else 2 * pairs], pa.int64())})

    return _met(packs(points, pivots, block)).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0, n * (n - 1)


def core_distances(distinct: DataFrame, near: DataFrame, min_points: int) -> DataFrame:
    """(id, n, core) of distinct_points: the distance of a vector's min_points-th point, itself and its copies being first; null if there are fewer.

    Of each vector at most min_points neighbours are ranked.
    """
    both = near.select(F.col("a").alias("id"), F.col("b").alias("other"), "dist").unionByName(near.select(F.col("b").alias("id"), F.col("a").alias("other"), "dist"))
    first = both.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "other"))).where(F.col("rank") < min_points)
    first = first.join(distinct.select(F.col("id").alias("other"), F.col("n").alias("times")), "other")
    reach = first.join(distinct.select("id", "n"), "id").withColumn("held", F.col("n") + F.sum("times").over(Window.partitionBy("id").orderBy("dist", "other")))
    found = reach.where(F.col("held") >= min_points).groupBy("id").agg(F.min("dist").alias("d"))
    return distinct.join(found, "id", "left").select("id", "n", F.when(F.col("n") >= min_points, F.lit(0.0)).otherwise(F.col("d")).alias("core"))


def spanning_tree(edges: DataFrame) -> DataFrame:
    """(u, v, weight): the lightest spanning forest of edges (u, v, weight), u < v, by rounds of joining components (Borůvka).

    Of equal weights the lesser u, then v, counts as lighter, so the forest is one. Each round every component takes its
    lightest edge outwards, and components joined by them become one: their number at least halves. An edge within one component goes.
    """
    rest = stash(edges.select("u", "v", "weight", F.col("u").alias("cu"), F.col("v").alias("cv")), "edges")
    parts = []
    while not rest.isEmpty():
        both = rest.unionByName(rest.select("u", "v", "weight", F.col("cv").alias("cu"), F.col("cu").alias("cv")))
        chosen = stash(both.groupBy("cu").agg(F.min(F.struct("weight", "u", "v", "cv")).alias("e")).select("cu", "e.*"), "lightest")
        parts.append(chosen.select("u", "v", "weight").distinct())
        roots = stash(components(chosen.select(F.col("cu").alias("u"), F.col("cv").alias("v"))), "roots")
        to = lambda df, c: df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(c, F.coalesce(f"r{c}", c)).drop(f"r{c}")
        rest = stash(to(to(rest, "cu"), "cv").where("cu <> cv").select("u", "v", "weight", "cu", "cv"), "edges")
    out = edges.select("u", "v", "weight").limit(0)
    for p in parts:
        out = out.unionByName(p)
    return out.distinct()


def reachability(points: DataFrame, radius: float, min_points: int, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, n, core) and the edges (u, v, weight) of the mutual reachability tree of points (id, vector), pairs within a radius.

    near are the pairs of distinct_points within the radius, at rest, if they are at hand.

    A pair of core vectors weighs as much as the larger of its distance and their core distances. At any height up to the radius,
    the tree's edges up to that height join what a density clusterer of that radius joins.
    """
    distinct = stash(distinct_points(points), "distinct-points")
    near = stash(within(distinct, radius), "near") if near is None else near
    cores = stash(core_distances(distinct, near, min_points), "cores")
    of = lambda c: cores.where("core is not null").select(F.col("id").alias(c), F.col("core").alias(f"core_{c}"))
    edges = near.join(of("a"), "a").join(of("b"), "b").select(F.col("a").alias("u"), F.col("b").alias("v"), F.greatest("dist", "core_a", "core_b").alias("weight"))
    return cores, stash(spanning_tree(edges), "tree")


def _of_points(points: DataFrame, distinct: DataFrame, named: DataFrame) -> DataFrame:
    """(id, cluster) of all points, from (id, cluster) of different vectors; a hot vector's points are joined by broadcast."""
    of_vector = stash(distinct.join(named, "id", "left").select(F.col("vector").alias("__v"), "cluster", "n"), "vector-clusters")
    rows = points.select("id", F.transform("vector", lambda x: x.cast("double")).alias("__v"))
    none = rows.where("__v is null").select("id", F.lit(None).cast(points.schema["id"].dataType).alias("cluster"))
    return join_counted(rows.where("__v is not null"), of_vector, ["__v"]).select("id", "cluster").unionByName(none)


def clusters_at(points: DataFrame, cores: DataFrame, tree: DataFrame, height: float, radius: float, near: DataFrame | None = None) -> DataFrame:
    """(id, cluster) of all points at one height of reachability(): the least id of its core vectors; null is noise.

    near are the pairs within the radius, if they are at hand.

    A vector that is no core goes with the nearest core vector within the height, of equals the least. Null vectors are noise.
    """
    distinct = stash(distinct_points(points), "distinct-points")
    inner = cores.where(F.col("core") <= height).select("id")
    roots = components(tree.where(F.col("weight") <= height).select("u", "v"))
    named = stash(inner.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster")), "named")
    if height > 0:
        near = within(distinct, min(height, radius)) if near is None else near.where(F.col("dist") <= min(height, radius))
        both = near.select("a", "b", "dist").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))
        border = both.join(named.withColumnRenamed("id", "b"), "b").join(named.select(F.col("id").alias("a")), "a", "left_anti")
        border = border.groupBy("a").agg(F.min_by("cluster", F.struct("dist", "b")).alias("cluster")).select(F.col("a").alias("id"), "cluster")
        named = stash(named.unionByName(border), "with-border")
    return _of_points(points, distinct, named)


def dbscan(points: DataFrame, radius: float, min_points: int) -> DataFrame:
    """(id, cluster) of points (id, vector): density clusters of one radius; see clusters_at. Equal vectors are in one cluster."""
    distinct = stash(distinct_points(points), "distinct-points")
    near = stash(within(distinct, radius), "near")
    both = near.select("a", "b", "dist").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))
    around = both.join(distinct.select(F.col("id").alias("b"), F.col("n").alias("times")), "b").groupBy("a").agg(F.sum("times").alias("around"))
    core = stash(distinct.join(around, F.col("id") == F.col("a"), "left").where(F.col("n") + F.coalesce("around", F.lit(0)) >= min_points).select("id"), "core")
    inner = near.join(core.select(F.col("id").alias("a")), "a").join(core.select(F.col("id").alias("b")), "b")
    roots = components(inner.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = core.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))
    border = both.join(named.withColumnRenamed("id", "b"), "b").join(core.select(F.col("id").alias("a")), "a", "left_anti")
    border = border.groupBy("a").agg(F.min_by("cluster", F.struct("dist", "b")).alias("cluster")).select(F.col("a").alias("id"), "cluster")
    return _of_points(points, distinct, named.unionByName(border))
