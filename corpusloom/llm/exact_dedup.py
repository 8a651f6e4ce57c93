"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A text's bytes are cut into blocks of a fixed size. The different blocks are sorted, and a block's place among
them is its name, an integer. Then the names of two neighbours make a pair (0 stands for a missing right one);
the different pairs are sorted and named in the same way, until each text has one name. Texts with as many
rounds and the same last name are equal, and no others: names stand for blocks and pairs, not for hashes of
them.

Blocks travel once. They are grouped by a 64-bit hash and their content, each map task handing on its different
blocks only; what the texts' rows are joined with is the hash. If different blocks share one, they are told apart
by their contents, in a join of their own (`_names`); as a rule there are none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, stash

#: Bytes of a block. Most texts are one or two; a long text is a row for each.
BLOCK_BYTES = 4096


def ranked(keys: DataFrame, order: list[str], tag: str) -> DataFrame:
    """keys, whose rows differ in order, with name: each row's place in that order, from 1, for any partitioning.

    Rows are sorted over all partitions; what passes through the driver is one number for each partition.
    """
    rows = keys.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = stash(rows, tag)
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0))), initial=1))
    return rows.withColumn("name", F.get(F.array(*[F.lit(s).cast("bigint") for s in starts]), part.cast("int")) + place).drop("__at")


def _hash(block: Column) -> Column:
    return F.xxhash64(block)


def _last(size: int) -> Column:
    """The place of the last block of the column `bytes`; an empty text is one empty block."""
    return F.greatest(F.ceil(F.octet_length("bytes") / size) - 1, F.lit(0)).cast("int")


def _blocks(size: int) -> Column:
    """The blocks of the column `bytes`, in order."""
    return F.transform(F.sequence(F.lit(0), _last(size)), lambda i: F.substring(F.col("bytes"), i * size + 1, F.lit(size)))


def _names(texts: DataFrame, size: int, hashed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame | None]:
    """The blocks' names by (hash, twin), and the (hash, block, twin) of different blocks with equal hashes, if there are any.

    Equal hashes' blocks are numbered (twin) from 0 by content; all others' twin is 0.
    """
    blocks = texts.select(F.explode(_blocks(size)).alias("block")).select(hashed(F.col("block")).alias("hash"), "block")
    distinct = blocks.groupBy("hash", "block").agg(F.count("*").alias("n"))
    counts = stash(distinct.groupBy("hash").agg(F.count("*").alias("blocks"), F.sum("n").alias("n")), "block-hashes")
    keys = counts.where("blocks = 1").select("hash", F.lit(0).alias("twin"), "n")
    several, clashes = counts.where("blocks > 1").select("hash"), None
    if not several.isEmpty():
        of_them = blocks.join(several, "hash", "left_semi").groupBy("hash", "block").agg(F.count("*").alias("n"))
        clashes = stash(of_them.withColumn("twin", F.row_number().over(Window.partitionBy("hash").orderBy("block")) - 1), "clashing-blocks")
        keys = keys.unionByName(clashes.select("hash", "twin", "n"))
    return ranked(keys, ["hash", "twin"], "block-names"), clashes


def _rounds(level: DataFrame) -> DataFrame:
    """(row, rounds, name) of (row, pos, last, name), last being the place of the row's last name: pairs are named until it is 0."""
    done, rounds = [], 0
    while True:
        done.append(level.where("last = 0").select("row", F.lit(rounds).alias("rounds"), "name"))
        rest = level.where("last > 0")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        half = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("pos", "last")]
        pairs = stash(rest.groupBy("row", *half).agg(side(0).alias("left"), F.coalesce(side(1), F.lit(0)).alias("right")), "pairs")
        names = ranked(pairs.groupBy("left", "right").agg(F.count("*").alias("n")), ["left", "right"], "pair-names")
        level = stash(join_counted(pairs, names, ["left", "right"]).select("row", "pos", "last", "name"), "names")
        rounds += 1


def identities(texts: DataFrame, size: int = BLOCK_BYTES, hashed: Callable[[Column], Column] = _hash) -> tuple[DataFrame, DataFrame]:
    """Of a table with a binary column bytes: its other columns with row, a number, at rest; and (row, rounds, name).

    Rows are equal in rounds and name if, and only if, in bytes. The table is read twice.
    """
    names, clashes = _names(texts, size, hashed)
    rest = [c for c in texts.columns if c != "bytes"]
    row, hashes = F.monotonically_increasing_id().alias("row"), F.transform(_blocks(size), hashed).alias("hashes")
    if clashes is None:
        rows = stash(texts.select(*rest, row, hashes), "rows")
        blocks = rows.select("row", (F.size("hashes") - 1).alias("last"), F.posexplode("hashes").alias("pos", "hash")).withColumn("twin", F.lit(0))
    else:
        rows = stash(texts.select(*rest, row, "bytes"), "rows")
        blocks = rows.select("row", _last(size).alias("last"), F.posexplode(_blocks(size)).alias("pos", "block")).withColumn("hash", hashed(F.col("block")))
        told = join_counted(blocks, clashes, ["hash", "block"]).select("row", "last", "pos", "hash", "twin")
        others = blocks.join(clashes.select("hash").distinct(), "hash", "left_anti").select("row", "last", "pos", "hash", F.lit(0).alias("twin"))
        blocks = others.unionByName(told)
    return rows.select(*rest, "row"), _rounds(stash(join_counted(blocks, names, ["hash", "twin"]).select("row", "pos", "last", "name"), "names"))


def exact_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", normalize: Callable[[Column], Column] | None = None, size: int = BLOCK_BYTES, hashed: Callable[[Column], Column] = _hash) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after `normalize`, by default unchanged; a null text counts as empty, and so does what
    normalize makes null. Of equal texts the row with the largest id stays; null ids are less than all others. If several rows
    of a group have that id, one of them stays. keep_id is null only for groups without any id. An empty table
    gives an empty one; other columns aren't read, so their names don't matter. A group may be of any size:
    it is counted by partial sums, and what its rows get is joined by broadcast if the group is hot.
    """
    of = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    of = F.coalesce(normalize(of), F.lit("")) if normalize else of
    base = docs.select(F.col(f"`{id}`").alias("doc_id"), of.alias("text"))
    texts = base.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.col("text").cast("binary").alias("bytes"))
    rows, names = identities(texts, size, hashed)
    found = stash(rows.join(names, "row"), "identities")
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), (-F.col("row")).alias("row"))
    groups = found.groupBy("rounds", "name").agg(F.count("*").alias("group_size"), F.max(first).alias("stays"))
    groups = stash(groups.select("rounds", "name", "group_size", F.col("stays.id").alias("keep_id"), (-F.col("stays.row")).alias("keep_row")), "groups")
    out = join_counted(found, groups, ["rounds", "name"], "group_size")
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
