"""Pages of an ordered table that read what they show: any page, however deep.

The table is written once in parts that are ranges of its order, with the number of rows
in each.  The numbers tell which parts hold a page, so the others are not read, and no
row before the page is passed over but in its own part.
"""

from __future__ import annotations

import bisect
import itertools
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import shared_dir


@dataclass
class Pages:
    """A paged table: its folder, schema, order, and the rows before each part (a number for each part and one for the end)."""

    spark: SparkSession
    path: str
    schema: str
    order: list[Column]
    parts: list[int]
    before: list[int]

    @property
    def rows(self) -> int:
        return self.before[-1]

    def parts_of(self, page: int, size: int) -> list[int]:
        """The parts that hold a page (from 1), none beyond the end."""
        first, last = (page - 1) * size, min(page * size, self.rows) - 1
        if first > last:
            return []
        return self.parts[bisect.bisect_right(self.before, first) - 1 : bisect.bisect_right(self.before, last)]

    def page(self, page: int, size: int) -> DataFrame:
        if page < 1 or size < 1:
            raise ValueError("pages and their sizes are 1 or more")
        held = self.parts_of(page, size)
        found = self.spark.read.schema(f"{self.schema}, _part int").parquet(self.path).where(F.col("_part").isin(held)).drop("_part")
        skipped = (page - 1) * size - (self.before[self.parts.index(held[0])] if held else 0)
        return found.orderBy(*self.order).offset(max(0, skipped)).limit(size)


def paged(df: DataFrame, order: list[Column], path: str | None = None, parts: int | None = None) -> Pages:
    """Writes the table in parts of its order, which has to tell all rows apart for pages not to overlap.

    ``path`` (the cluster's shared folder by default) is replaced; ``parts`` is Spark's own
    choice by default.  What comes to the driver is a number for each part.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    ranged.withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("_part").parquet(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    counts = spark.read.schema(f"{schema}, _part int").parquet(path).groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    return Pages(spark, path, schema, order, [r["_part"] for r in counts], [0, *itertools.accumulate(r["n"] for r in counts)])
