"""Cell tags, border copies, cell layout and per-cell statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.functions.cells import border_cells, cell_parent, with_sky_cell
from starloom.schema import CELL_ORDER, FINE_ORDER

ROWS_PER_TASK = 2_000_000


def tag_cells(df: DataFrame, order: int = CELL_ORDER, fine_order: int = FINE_ORDER) -> DataFrame:
    """Add ``cell`` and ``border_cells``, the foreign cells that touch the row's fine cell."""
    kept = [c for c in df.columns if c not in ("cell", "border_cells")]
    fine = with_sky_cell(df.select(*kept), "_fine", fine_order)
    return fine.select(
        *kept,
        cell_parent("_fine", fine_order, order).alias("cell"),
        border_cells("_fine", fine_order, order).alias("border_cells"),
    )


def on_border(df: DataFrame) -> DataFrame:
    """Rows whose surroundings reach into another cell."""
    return df.filter(F.size("border_cells") > 0)


def halo_replicate(df: DataFrame) -> DataFrame:
    """One row per cell that has to see a detection; copies share its ``source_id``."""
    kept = [c for c in df.columns if c not in ("cell", "border_cells")]
    return df.select(
        *kept,
        F.col("cell").alias("home_cell"),
        F.explode(F.array_append("border_cells", F.col("cell"))).alias("cell"),
    )


def hot_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more rows than one task should take, and into how many slots to split them.

    At most ``rows / rows_per_task`` keys can qualify, so the table is small
    enough to broadcast whatever the input: 10^12 rows give at most 500,000.
    """
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_task)
        .select(key, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_slots"))
    )


def assign_slot(df: DataFrame, hot: DataFrame, key: str, by: str = "source_id") -> DataFrame:
    """Spread the rows of hot keys over their slots; all other rows get slot 0."""
    slots = F.coalesce(F.col("_slots"), F.lit(1))
    return (
        df.join(F.broadcast(hot), key, "left")
        .withColumn("_slot", F.pmod(F.xxhash64(by), slots).cast("int"))
        .drop("_slots")
    )


def copy_to_slots(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """The other side of a join with spread keys: one copy per slot of the key."""
    last = F.coalesce(F.col("_slots"), F.lit(1)) - 1
    kept = df.columns
    return df.join(F.broadcast(hot), key, "left").select(
        *kept, F.explode(F.sequence(F.lit(0), last)).alias("_slot")
    )


def cell_layout(
    df: DataFrame, partitions: int | None = None, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Rows of a cell together, in epoch order; only oversized cells are split."""
    placed = assign_slot(df, hot_keys(df, "cell", rows_per_task), "cell")
    keys = ["cell", "_slot"]
    placed = placed.repartition(partitions, *keys) if partitions else placed.repartition(*keys)
    return placed.sortWithinPartitions("cell", "_slot", "epoch", "source_id").drop("_slot")


def cell_occupancy(df: DataFrame) -> DataFrame:
    """Rows and epoch range of every cell: the basis for sizing partitions and finding skew."""
    return df.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("epoch").alias("first_epoch"),
        F.max("epoch").alias("last_epoch"),
    )


def cell_epochs(df: DataFrame) -> DataFrame:
    """Rows per cell and epoch; the small table behind the two functions below."""
    return df.groupBy("cell", "epoch").agg(F.count(F.lit(1)).alias("n_rows"))


def cell_day_one(df: DataFrame) -> DataFrame:
    """The first epoch of each cell and the number of rows that seed its reference list."""
    return (
        cell_epochs(df)
        .groupBy("cell")
        .agg(F.min("epoch").alias("first_epoch"), F.min_by("n_rows", "epoch").alias("n_seed"))
    )


def cell_epoch_steps(df: DataFrame) -> DataFrame:
    """Every change of epoch inside a cell; the window sees one row per cell and epoch."""
    steps = W.partitionBy("cell").orderBy("epoch")
    return (
        cell_epochs(df)
        .withColumn("previous_epoch", F.lag("epoch").over(steps))
        .filter(F.col("previous_epoch").isNotNull())
        .select("cell", "previous_epoch", "epoch", "n_rows")
    )
