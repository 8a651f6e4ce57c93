"""Running statistics over streams: word counts, truecaser updates, windows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn


def word_counts(stream: DataFrame, text: str = "text") -> DataFrame:
    """(word, cnt) of a stream of texts; Spark keeps the counts as state, to be written in update mode."""
    return stream.select(F.explode(fn.lowercase(fn.whitespace_tokens(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def event_windows(stream: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Numbers and sums by window of event time and kind; rows later than the watermark are left out."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Each user's sessions: events no further apart than the gap."""
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def update_table(batch: DataFrame, path: str, version: int, keys: list[str]) -> None:
    """Add a batch's counts to the table of the version before; for foreachBatch.

    Each batch writes a version of its own, so a batch that is run again after a failure writes the same.
    """
    spark = batch.sparkSession
    rows = batch.select(*keys, "cnt")
    if version > 0:
        rows = rows.unionByName(spark.read.parquet(f"{path}/v={version - 1}").select(*keys, "cnt"))
    rows.groupBy(*keys).agg(F.sum("cnt").alias("cnt")).write.mode("overwrite").parquet(f"{path}/v={version}")
