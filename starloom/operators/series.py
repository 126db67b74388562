"""Series of detections per object, and the counting of missed epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.schema import MAG_LIMIT, MAX_MISSES

PAGE = 1_000_000  # detections in a line of a series
CLOCKS = ("cell", "global")


def assemble_series(pairs: DataFrame, page: int = PAGE) -> DataFrame:
    """Wide form: the detections of each object, in epoch order, as comma lists.

    A series is cut into pages of ``page`` detections, numbered by ``part``
    from 0 in time order; a task never holds more than a page as a list. Objects of one page, all but
    a few, are grouped at once. At most ``rows / page`` objects have more, so their list may be
    broadcast whatever the input; only their detections are numbered.
    """
    sizes = pairs.groupBy("object_id").agg(F.count(F.lit(1)).alias("_n"))
    long = F.broadcast(sizes.filter(F.col("_n") > page).select("object_id"))
    short = pairs.join(long, "object_id", "left_anti").withColumn("part", F.lit(0))
    return written_pages(short.unionByName(in_pages(pairs.join(long, "object_id", "left_semi"), page)))


def in_pages(pairs: DataFrame, page: int, begins: DataFrame | None = None) -> DataFrame:
    """Add ``part``. The place of a detection is the number of those in earlier epochs, from counts
    per epoch, plus its place within the epoch, plus ``begins`` (object_id, ``_held``) if there are detections before."""
    counts = pairs.groupBy("object_id", "epoch").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("object_id").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("object_id", "epoch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("object_id", "epoch").orderBy("source_id")) - 1
    placed = pairs.withColumn("_inside", inside).join(before, ["object_id", "epoch"])
    place = F.col("_before") + F.col("_inside")
    if begins is not None:
        placed = placed.join(begins, "object_id", "left")
        place = place + F.coalesce("_held", F.lit(0))
    return placed.withColumn("part", F.floor(place / page).cast("int")).select("object_id", "epoch", "source_id", "part")


def written_pages(parts: DataFrame) -> DataFrame:
    """Pages as comma lists."""
    return (
        parts.groupBy("object_id", "part")
        .agg(
            F.count(F.lit(1)).alias("n_detections"),
            F.array_sort(F.collect_list(F.struct("epoch", "source_id"))).alias("_series"),
        )
        .select(
            "object_id",
            "part",
            "n_detections",
            F.array_join(F.col("_series.source_id"), ",").alias("detections"),
        )
    )


def combine_series(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of the main result and the backfilled pairs, each pair once."""
    columns = ["object_id", "epoch", "source_id"]
    return first.select(*columns).unionByName(second.select(*columns)).dropDuplicates(
        ["object_id", "source_id"]
    )


def add_ticks(hits: DataFrame, observations: DataFrame, miss_clock: str = "cell") -> DataFrame:
    """Number the epochs in which an object could have been seen.

    ``hits`` has one row per object and matched epoch with the object's
    ``cell``. The ``global`` clock counts all epochs of the data set, the
    ``cell`` clock only those with a row in the object's cell (an exposure that
    does not cover a cell is not a miss). ``tick`` is the number of clock
    epochs up to and including this one, ``counted`` is 1 if this one counts,
    ``last_tick`` is the number of all clock epochs. The windows see one row
    per epoch (and cell), never the detections.
    """
    if miss_clock not in CLOCKS:
        raise ValueError(f"miss_clock must be one of {CLOCKS}")
    if miss_clock == "global":
        ticks = (
            observations.select("epoch")
            .distinct()
            .select(
                "epoch",
                F.row_number().over(W.orderBy("epoch")).alias("tick"),
                F.count(F.lit(1)).over(W.partitionBy()).cast("int").alias("last_tick"),
            )
        )
        return hits.join(ticks, "epoch").withColumn("counted", F.lit(1))
    covered = observations.select("cell", "epoch", F.lit(1).alias("counted"))
    matched = hits.select("cell", "epoch", F.lit(0).alias("counted"))
    moments = covered.unionByName(matched).groupBy("cell", "epoch").agg(
        F.max("counted").alias("counted")
    )
    running = W.partitionBy("cell").orderBy("epoch")
    ticks = moments.withColumn("tick", F.sum("counted").over(running).cast("int")).withColumn(
        "last_tick", F.sum("counted").over(W.partitionBy("cell")).cast("int")
    )
    return hits.join(ticks, ["cell", "epoch"])


def miss_gaps(hits: DataFrame, observations: DataFrame, miss_clock: str = "cell") -> DataFrame:
    """Missed epochs before every match of an object (0 for its discovery)."""
    per_object = W.partitionBy("object_id").orderBy("epoch")
    gap = F.col("tick") - F.col("counted") - F.lag("tick").over(per_object)
    return add_ticks(hits, observations, miss_clock).withColumn(
        "misses", F.coalesce(gap, F.lit(0)).cast("int")
    )


def miss_streak(hits: DataFrame, observations: DataFrame, miss_clock: str = "cell") -> DataFrame:
    """The state of each object at the end: last matched epoch and misses since then."""
    return (
        add_ticks(hits, observations, miss_clock)
        .groupBy("object_id")
        .agg(
            F.max("epoch").alias("last_epoch"),
            (F.max("last_tick") - F.max("tick")).cast("int").alias("miss_streak"),
        )
    )


def eviction_epoch(
    hits: DataFrame,
    observations: DataFrame,
    max_misses: int = MAX_MISSES,
    mag_limit: float = MAG_LIMIT,
    miss_clock: str = "cell",
) -> DataFrame:
    """First epoch at which a bright object that was dropped is seen again.

    From that epoch on its detections belong to a new object. ``hits`` needs
    ``mag``; objects that are faint or never away for long have no row.
    """
    gaps = miss_gaps(hits.filter(F.col("mag") < mag_limit), observations, miss_clock)
    return (
        gaps.filter(F.col("misses") >= max_misses)
        .groupBy("object_id")
        .agg(F.min("epoch").alias("gone_epoch"))
    )
