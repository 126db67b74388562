"""Projections of the given tables to observations, in Spark and in SQL.

Positions are built so that detections of one star stay within the match
radius and different stars stay far apart, which makes the star number a truth
label for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _position(star: Column, serial: Column, per_row: int, step_ra: float, step_dec: float):
    def jitter(factor: int) -> Column:
        return ((serial * factor) % 11 - 5).cast("double") * 1e-4

    row = ((star - star % per_row) / per_row).cast("bigint")
    ra = F.lit(89.90) + (star % per_row).cast("double") * step_ra + jitter(7)
    dec = F.lit(-74.5) + row.cast("double") * step_dec + jitter(13)
    return ra, dec


def _mag(star: Column) -> Column:
    return F.lit(8.0) + ((star * 7) % 150).cast("double") / 10.0


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``events`` as a detection; several per star and epoch."""
    e = table(spark, sf_dir, "events")
    ra, dec = _position(F.col("user_id"), F.col("event_id"), 50, 0.11, 0.02)
    return e.select(
        (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).alias("epoch"),
        F.col("event_id").cast("string").alias("source_id"),
        F.col("user_id").alias("star"),
        ra.alias("ra"),
        dec.alias("dec"),
        _mag(F.col("user_id")).alias("mag"),
        ((F.col("event_id") % 50).cast("double") / 1000.0).alias("magerr"),
        F.col("ts").alias("obs_time"),
        "event_id",
        "event_type",
    )


def first_seen(rows: DataFrame) -> DataFrame:
    """A reference list: the first detection of each star."""
    keep = [c for c in rows.columns if c not in ("star", "epoch", "event_id")]
    first = F.min(F.struct("epoch", "event_id", *keep)).alias("first")
    return rows.groupBy("star").agg(first).select("star", "first.*")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as detections of parts over months: the bench input."""
    li = table(spark, sf_dir, "lineitem")
    serial = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    month = (
        (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    ).cast("int")
    rows = li.select(serial.alias("serial"), F.col("l_partkey").alias("star"), month.alias("epoch"))
    one = rows.groupBy("serial").agg(F.min(F.struct("star", "epoch")).alias("r")).select("serial", "r.*")
    ra, dec = _position(F.col("star"), F.col("serial"), 200, 0.05, 0.01)
    return one.select(
        "epoch",
        F.col("serial").cast("string").alias("source_id"),
        "star",
        ra.alias("ra"),
        dec.alias("dec"),
        _mag(F.col("star")).alias("mag"),
    )


def whole_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position per customer, spread over the whole sphere."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    turns = key.cast("double") * 137.50776405
    return c.select(
        key.alias("star"),
        (turns - F.floor(turns / 360.0) * 360.0).alias("ra"),
        F.degrees(F.asin(((key % 997).cast("double") + 0.5) * 2.0 / 997.0 - 1.0)).alias("dec"),
    )


# --- the same projections in SQL -------------------------------------------

DETECTIONS = """
det AS (
  SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS epoch,
         CAST(event_id AS VARCHAR) AS source_id, user_id AS star,
         CAST(89.90 AS DOUBLE) + CAST(user_id % 50 AS DOUBLE) * CAST(0.11 AS DOUBLE)
           + CAST((event_id * 7) % 11 - 5 AS DOUBLE) * 1e-4 AS ra,
         CAST(-74.5 AS DOUBLE) + CAST(user_id // 50 AS DOUBLE) * CAST(0.02 AS DOUBLE)
           + CAST((event_id * 13) % 11 - 5 AS DOUBLE) * 1e-4 AS dec,
         CAST(8 AS DOUBLE) + CAST((user_id * 7) % 150 AS DOUBLE) / CAST(10 AS DOUBLE) AS mag,
         CAST(event_id % 50 AS DOUBLE) / CAST(1000 AS DOUBLE) AS magerr,
         ts AS obs_time, event_id, event_type
  FROM events)"""

FIRST_SEEN = "QUALIFY row_number() OVER (PARTITION BY star ORDER BY epoch, event_id) = 1"

WHOLE_SKY = """
sky AS (
  SELECT c_custkey AS star,
         CAST(c_custkey AS DOUBLE) * CAST(137.50776405 AS DOUBLE)
           - floor(CAST(c_custkey AS DOUBLE) * CAST(137.50776405 AS DOUBLE) / CAST(360 AS DOUBLE))
             * CAST(360 AS DOUBLE) AS ra,
         degrees(asin((CAST(c_custkey % 997 AS DOUBLE) + CAST(0.5 AS DOUBLE)) * CAST(2 AS DOUBLE)
           / CAST(997 AS DOUBLE) - CAST(1 AS DOUBLE))) AS dec
  FROM customer)"""
