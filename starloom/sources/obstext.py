"""Text forms of observations, series and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.schema import NO_NEIGHBOURS

# Order of the fields in the space-separated text form.
FIELDS = [
    "epoch int",
    "source_id string",
    "ra double",
    "dec double",
    "mag double",
    "magerr double",
    "cell bigint",
    "border_cells string",
    "obs_time string",
    "match_state string",
    "miss_streak int",
]
JOIN_FIELDS = 9  # the two-table joins use the first nine fields


def read_observations(
    spark: SparkSession, path: str, fields: int = len(FIELDS), min_partitions: int | None = None
) -> DataFrame:
    """Observation text; neighbour lists become arrays (empty for ``-``).

    ``min_partitions`` deals the rows anew where the files make fewer partitions than that.
    """
    listed = F.col("border_cells")
    cells = F.when(
        listed == NO_NEIGHBOURS, F.array().cast("array<bigint>")
    ).otherwise(F.split(listed, ",").cast("array<bigint>"))
    rows = spark.read.csv(path, sep=" ", schema=", ".join(FIELDS))
    if min_partitions and rows.rdd.getNumPartitions() < min_partitions:
        rows = rows.repartition(min_partitions)
    rows = rows.withColumns(
        {"border_cells": cells, "obs_time": F.col("obs_time").cast("timestamp_ntz")}
    )
    return rows.select(*[f.split()[0] for f in FIELDS[:fields]])


def write_observations(observations: DataFrame, path: str) -> None:
    """Tagged observations in the space-separated text form, one file per task."""
    listed = F.array_join(F.col("border_cells").cast("array<string>"), ",")
    extra = {}
    if "match_state" not in observations.columns:
        extra["match_state"] = F.lit("0")
    if "miss_streak" not in observations.columns:
        extra["miss_streak"] = F.lit(0)
    text = observations.withColumns(
        {
            "obs_time": F.translate(F.col("obs_time").cast("string"), " ", "T"),
            "border_cells": F.when(F.size("border_cells") == 0, NO_NEIGHBOURS).otherwise(listed),
            **extra,
        }
    ).select(*[f.split()[0] for f in FIELDS])
    text.write.csv(path, sep=" ", quote="", mode="overwrite")


def write_observation_table(observations: DataFrame, path: str, coarse_order_shift: int = 12) -> None:
    """Parquet, the form for further work: split by coarse cell so that scans can skip.

    The default shift turns level-10 cells into the 3072 cells of level 4. Rows
    are dealt to tasks by ranges of (coarse cell, cell, epoch, id), so tasks
    hold like numbers of rows however the survey lies on the sky, a file covers
    few cells, and its statistics let scans skip by ``cell`` and ``epoch``.
    """
    order = ["coarse_cell", "cell", "epoch", "source_id"]
    coarse = F.shiftright("cell", coarse_order_shift)
    (
        observations.withColumn("coarse_cell", coarse)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.partitionBy("coarse_cell")
        .mode("overwrite")
        .parquet(path)
    )


def series_lines(series: DataFrame) -> DataFrame:
    """One line ``(object,id,id,...)`` per series row; further pages of an object are ``(object#part,id,...)``."""
    name = F.when(F.col("part") > 0, F.concat_ws("#", "object_id", "part")).otherwise(F.col("object_id"))
    return series.select(F.format_string("(%s,%s)", name, "detections").alias("value"))


def write_series(series: DataFrame, path: str) -> None:
    series_lines(series).write.mode("overwrite").text(path)


def pair_lines(pairs: DataFrame, first: str = "id1", second: str = "id2") -> DataFrame:
    """One line ``[id1,id2]`` per pair."""
    return pairs.select(F.format_string("[%s,%s]", first, second).alias("value"))


def write_pairs(pairs: DataFrame, path: str, first: str = "id1", second: str = "id2") -> None:
    pair_lines(pairs, first, second).write.mode("overwrite").text(path)
