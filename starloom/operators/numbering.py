"""Consecutive numbers in a global order, without bringing the rows to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.session import Workspace


def number_in_order(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Add ``name``: 1, 2, 3, … in the given order; rows equal in it are numbered in any order.

    Rows are dealt by ranges and stored with their place in their range; what comes before a range is
    a sum over the ranges, of which the driver sees one number each.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    stored = Workspace(spark, "numbered").save(dealt, "rows")
    part = F.shiftright("_place", 33).alias("_part")
    counts = stored.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    before = [0, *accumulate(r.n for r in counts)]
    offsets = spark.createDataFrame([(r._part, b) for r, b in zip(counts, before)], "_part long, _before long")
    numbered = stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row per range
    inside = F.col("_place").bitwiseAND((1 << 33) - 1)
    return numbered.withColumn(name, (F.col("_before") + inside + 1).cast("int")).drop("_place", "_part", "_before")
