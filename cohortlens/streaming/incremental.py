"""Incremental counts: prevalence, joint counts and patterns of a stream of isolates.

A batch's counts are sums, so the running result is the sum of the batches' results.
Isolates that come again (by id) are dropped within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_isolates(stream: DataFrame, id_col: str, time_col: str, delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def running_prevalence(stream: DataFrame, features_col: str = "features") -> DataFrame:
    """feature, k over all isolates so far, from an array of each isolate's features (complete or update mode)."""
    return stream.select(F.explode(F.array_distinct(features_col)).alias("feature")).groupBy("feature").agg(F.count("*").alias("k"))


def running_joint_counts(stream: DataFrame, features_col: str = "features") -> DataFrame:
    """item1 < item2, n11 over all isolates so far: pairs are made inside the row."""
    has = F.array_sort(F.array_distinct(features_col))
    two = F.flatten(F.transform("has", lambda a, i: F.transform(F.slice("has", i + 2, F.size("has")), lambda b: F.struct(a.alias("item1"), b.alias("item2")))))
    return stream.select(has.alias("has")).select(F.explode(two).alias("p")).groupBy("p.item1", "p.item2").agg(F.count("*").alias("n11"))


def windowed_prevalence(stream: DataFrame, time_col: str, window: str = "1 day", delay: str = "1 hour", features_col: str = "features") -> DataFrame:
    """feature, k by event-time window; late isolates are taken until the watermark."""
    spread = stream.withWatermark(time_col, delay).select(time_col, F.explode(F.array_distinct(features_col)).alias("feature"))
    by = spread.groupBy(F.window(time_col, window), "feature").agg(F.count("*").alias("k"))
    return by.select(F.col("window.start").alias("start"), "feature", "k")


def to_parquet(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each trigger replaces the table's content by the counts so far (complete mode)."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write).start()
