"""Operators on objects near a cell border.

A border object is delivered to each cell in its ``border_cells``. The cell it
arrives in is the home cell of the detections it is compared with, so the
delivery is a condition of the positional join and no outside store is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.crossmatch import crossmatch
from starloom.session import Workspace

NEVER = 2**31 - 1  # joining epoch of a delivery that its target cell never takes up


def _delivered():
    return F.array_contains(F.col("ref_border_cells"), F.col("cell"))


def border_exchange(reference: DataFrame, observations: DataFrame, **options) -> DataFrame:
    """Pairs that only the border delivery finds: the two home cells differ."""
    return crossmatch(
        reference, observations, extra=_delivered() & (F.col("ref_epoch") < F.col("epoch")), **options
    ).select(
        F.col("ref_source_id").alias("object_id"),
        F.col("ref_cell").alias("object_cell"),
        "epoch",
        "source_id",
        "cell",
    )


def border_known(border_objects: DataFrame, local_reference: DataFrame, **options) -> DataFrame:
    """Deliveries that are discarded because the cell already has a reference there."""
    return (
        crossmatch(border_objects, local_reference, extra=_delivered(), **options)
        .select(F.col("ref_source_id").alias("source_id"), F.col("cell").alias("target_cell"))
        .distinct()
    )


def directed_match(border_objects: DataFrame, observations: DataFrame, **options) -> DataFrame:
    """Later detections of delivered border objects.

    A delivery is dropped as soon as the target cell holds a detection in range
    of the same or an earlier epoch: then the object was not new there. The
    positional join runs once; its pairs are stored and read for both purposes.
    """
    delivery = ["object_id", "target_cell"]
    pairs = crossmatch(border_objects, observations, extra=_delivered(), **options).select(
        F.col("ref_source_id").alias("object_id"),
        F.col("cell").alias("target_cell"),
        "epoch",
        "source_id",
        (F.col("epoch") > F.col("ref_epoch")).alias("later"),
    )
    pairs = Workspace(observations.sparkSession, "directed").save(pairs, "pairs")
    dropped = pairs.filter(~F.col("later")).select(*delivery).distinct()
    return pairs.filter("later").drop("later").join(dropped, delivery, "left_anti")


def joining_epochs(border_objects: DataFrame, observations: DataFrame, delay: int = 1) -> DataFrame:
    """One row per delivery, with the epochs between which the target cell misses the object.

    An object is known to its home cell from its own epoch on (``from_epoch``).
    A delivery reaches the target cell's reference list at the ``delay``-th
    later epoch that covers that cell (``to_epoch``). ``border_cells`` names the
    target alone. The lists of epochs hold one number per exposure of a cell.
    """
    epochs = observations.groupBy("cell").agg(F.array_sort(F.collect_set("epoch")).alias("_epochs"))
    kept = [c for c in border_objects.columns if c != "border_cells"]
    sent = border_objects.select(*kept, F.explode("border_cells").alias("_target"))
    later = F.filter("_epochs", lambda e: e > F.col("epoch"))
    joined = sent.join(epochs.withColumnRenamed("cell", "_target"), "_target")
    return joined.select(
        *kept,
        F.array("_target").alias("border_cells"),
        F.col("epoch").alias("from_epoch"),
        F.coalesce(F.get(later, F.lit(delay - 1)), F.lit(NEVER)).alias("to_epoch"),
    )


def backfill(joined: DataFrame, observations: DataFrame, **options) -> DataFrame:
    """Detections missed between discovery and joining a neighbour's reference list.

    ``joined`` is the result of ``joining_epochs``: ``from_epoch`` (discovery)
    and ``to_epoch`` (first epoch the cell matches by itself) are both excluded.
    """
    inside = (F.col("epoch") > F.col("ref_from_epoch")) & (F.col("epoch") < F.col("ref_to_epoch"))
    return crossmatch(joined, observations, extra=_delivered() & inside, **options).select(
        F.col("ref_source_id").alias("object_id"),
        F.col("cell").alias("target_cell"),
        "epoch",
        "source_id",
    )
