"""Positional joins: which detections lie within the radius of which references.

All joins are equi-joins on a sky cell with the distance as a further join
condition, so Spark plans hash or merge joins and never a nested loop. Only the
reference side is copied over cell borders; every pair is found exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.cells import MatchGrid, border_cells, cell_parent, with_sky_cell
from starloom.functions.separation import separation2, within_radius
from starloom.operators.halo import ROWS_PER_TASK, assign_slot, copy_to_slots, hot_keys
from starloom.schema import RADIUS_DEG2

STRATEGIES = ("auto", "broadcast", "shuffle_hash", "merge")
# Largest reference list, border copies included, that is sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def key_observations(df: DataFrame, grid: MatchGrid) -> DataFrame:
    """Add the join cell of the side that stays in its home cell."""
    return with_sky_cell(df, "_key", grid.order)


def key_reference(df: DataFrame, grid: MatchGrid) -> DataFrame:
    """Prefix all columns with ``ref_`` and add a row for every join cell to look in."""
    fine = with_sky_cell(df, "_fine", grid.fine_order)
    cells = F.array_append(
        border_cells("_fine", grid.fine_order, grid.order),
        cell_parent("_fine", grid.fine_order, grid.order),
    )
    named = [F.col(c).alias(f"ref_{c}") for c in df.columns]
    return fine.select(*named, F.explode(cells).alias("_key"))


def near(radius_deg2: float) -> Column:
    return within_radius("ref_ra", "ref_dec", "ra", "dec", radius_deg2)


def rows_and_bytes(df: DataFrame) -> tuple[int, int]:
    """Number of rows and their size in memory: 16 bytes a field, and what strings and lists hold."""
    width = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map"):
            width = width + 16 * F.greatest(F.size(f.name), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(width.cast("long"))).first()
    return rows, size or 0


def fits(reference: DataFrame, copies: DataFrame, most_rows: int, most_bytes: int) -> bool:
    """Whether the reference with its border copies is small enough to broadcast.

    A row has at most nine copies (a field more each), so a small reference needs no cells to tell; others are measured with
    their copies.
    """
    rows, size = rows_and_bytes(reference)
    if 9 * rows <= most_rows and 9 * (size + 16 * rows) <= most_bytes:
        return True
    rows, size = rows_and_bytes(copies)
    return rows <= most_rows and size <= most_bytes


def spread(left: DataFrame, right: DataFrame, rows_per_task: int) -> tuple[DataFrame, DataFrame]:
    """Deal the observations (left) of crowded keys over slots, and copy the references to them."""
    hot = hot_keys(left, "_key", rows_per_task)
    return assign_slot(left, hot, "_key"), copy_to_slots(right, hot, "_key")


def spread_reference(
    left: DataFrame, right: DataFrame, rows_per_task: int, counted: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Deal the references (right) of crowded keys over ``_part``, and copy the observations to them.

    With ``spread`` before it, a cell crowded on both sides becomes a grid of slots and parts, in which
    every pair meets once and no part holds more than ``rows_per_task`` of either side.
    """
    hot = hot_keys(counted, "_key", rows_per_task)
    parts = F.coalesce("_slots", F.lit(1))
    values = [c for c in right.columns if c not in ("_key", "_slot")]
    dealt = right.join(F.broadcast(hot), "_key", "left").withColumn("_part", F.pmod(F.xxhash64(*values), parts).cast("int"))
    copies = left.join(F.broadcast(hot), "_key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return copies.drop("_slots"), dealt.drop("_slots")


def create_match_views(
    reference: DataFrame,
    observations: DataFrame,
    reference_view: str,
    observation_view: str,
    grid: MatchGrid | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> None:
    """Temporary views for matching in SQL: join on ``match_cell`` and ``match_slot``, then test the radius.

    The reference view has all columns with prefix ``ref_``, and a row for each cell to look in.
    """
    grid = grid or MatchGrid.for_radius()
    sides = spread(key_observations(observations, grid), key_reference(reference, grid), rows_per_task)
    for df, name in zip(sides, (observation_view, reference_view)):
        df.withColumnsRenamed({"_key": "match_cell", "_slot": "match_slot"}).createOrReplaceTempView(name)


def join_keyed(
    observations: DataFrame,
    reference: DataFrame,
    condition: Column,
    how: str = "inner",
    keys: tuple[str, ...] = ("_key", "_slot"),
) -> DataFrame:
    """Join sides that already carry their keys; key columns are dropped."""
    right = reference.select(
        *[F.col(k).alias(f"ref{k}") for k in keys],
        *[c for c in reference.columns if c not in keys],
    )
    on = condition
    for k in keys:
        on = on & (F.col(k) == F.col(f"ref{k}"))
    return observations.join(right, on, how).drop(*keys, *[f"ref{k}" for k in keys])


def crossmatch(
    reference: DataFrame,
    observations: DataFrame,
    *,
    how: str = "inner",
    extra: Column | None = None,
    strategy: str = "auto",
    radius_deg2: float = RADIUS_DEG2,
    grid: MatchGrid | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join observations with the references within the radius.

    ``how`` is ``inner`` (all pairs, many to many), ``left_semi`` or
    ``left_anti`` (observations with or without a partner). ``extra`` may use
    the observation columns and the reference columns with prefix ``ref_``.

    ``broadcast`` measures the reference first (with its border copies, unless it is small) and is
    used only up to ``broadcast_rows`` and ``broadcast_bytes``; beyond that the
    join is a sort-merge join. The shuffled strategies split cells that hold
    more than ``rows_per_task`` observations, and, for all pairs, references.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    grid = grid or MatchGrid.for_radius(radius_deg2)
    grid.check_radius(radius_deg2)
    condition = near(radius_deg2) if extra is None else near(radius_deg2) & extra

    left = key_observations(observations, grid)
    right = key_reference(reference, grid)
    if strategy == "broadcast" and not fits(reference, right, broadcast_rows, broadcast_bytes):
        strategy = "merge"
    if strategy == "broadcast":
        return join_keyed(left, F.broadcast(right), condition, how, keys=("_key",))

    keys: tuple[str, ...] = ("_key", "_slot")
    copied = right
    left, right = spread(left, right, rows_per_task)
    if how == "inner":
        # Counted before the references were copied to slots: a slot sees all references of its cell.
        hot = copied.select("_key")
        left, right = spread_reference(left, right, rows_per_task, hot)
        keys = (*keys, "_part")
    if strategy != "auto":
        right = right.hint(strategy)
    return join_keyed(left, right, condition, how, keys)


def epoch_match(reference: DataFrame, observations: DataFrame, **options) -> DataFrame:
    """All (reference, observation) pairs of an epoch; no nearest pick."""
    return crossmatch(reference, observations, **options).select(
        F.col("ref_source_id").alias("object_id"), "epoch", "source_id"
    )


def new_objects(reference: DataFrame, observations: DataFrame, **options) -> DataFrame:
    """Observations without any reference in range: they become references."""
    return crossmatch(reference, observations, how="left_anti", **options)


def nearest_only(pairs: DataFrame) -> DataFrame:
    """Optional: keep the closest reference of each observation (an aggregate, no window)."""
    distance = separation2("ref_ra", "ref_dec", "ra", "dec")
    kept = F.struct(*[c for c in pairs.columns if c != "source_id"])
    return (
        pairs.withColumn("_d", distance)
        .groupBy("source_id")
        .agg(F.min_by(kept, F.struct("_d", "ref_source_id")).alias("_best"))
        .select("source_id", "_best.*")
    )
