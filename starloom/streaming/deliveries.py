"""Deliveries of border objects to neighbouring cells, carried from micro-batch to micro-batch.

An object found near a border is known to its home cell at once, but to a neighbouring cell only at the
``delay``-th later exposure of that cell. The detections between are missed there and filled in here. The
batch form is ``border.backfill`` after ``border.joining_epochs``; this is the same over a stream of exposures.

A log holds one entry per step and delivery that the step touched: the object, the target cell, the epoch of
discovery, and how many exposures are still to come. The last entry counts; with nothing to come the delivery is
consumed and never read again. A step opens only the coarse cells that it covers, and writes only deliveries whose target
it covers. A step that is run again reads entries of earlier steps only and overwrites its own.

Exposures of one cell come in order of epoch, and an epoch of a cell within one micro-batch. Objects without an
id, an epoch or a position are left out, as are rows without a cell or an epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.cells import cell_parent
from starloom.operators.border import NEVER, backfill
from starloom.schema import CELL_ORDER
from starloom.session import Workspace
from starloom.streaming.fold import COARSE_ORDER

ENTRY = ["source_id", "epoch", "ra", "dec", "target_cell", "to_come"]
LOG = "source_id string, epoch int, ra double, dec double, target_cell bigint, to_come int, step bigint, coarse_cell bigint"
PAIRS = "object_id string, target_cell bigint, epoch int, source_id string, step bigint"


class BorderDeliveries:
    """The log of deliveries and the detections filled in so far, below one folder."""

    def __init__(self, spark: SparkSession, path: str, delay: int = 1, **options):
        """``options`` go to the positional join."""
        self.spark, self.path, self.delay, self.options = spark, path, delay, options
        for name, schema in (("log", LOG), ("pairs", PAIRS)):
            empty = spark.createDataFrame([], schema).drop("step")
            self._store(empty, name, -1)

    def _store(self, df: DataFrame, name: str, step: int) -> None:
        path = f"{self.path}/{name}/step={step}"
        if name == "pairs":
            df.write.mode("overwrite").parquet(path)
            return
        dealt = df.hint("rebalance", "coarse_cell").sortWithinPartitions("coarse_cell")
        dealt.write.mode("overwrite").partitionBy("coarse_cell").parquet(path)

    def open_deliveries(self, before: int | None = None, coarse: list[int] | None = None) -> DataFrame:
        """Deliveries still to be taken up, of these coarse cells (all, if none are named)."""
        log = self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        if before is not None:
            log = log.filter(F.col("step") < before)
        if coarse is not None:
            log = log.filter(F.col("coarse_cell").isin(coarse))
        last = F.max_by(F.struct("epoch", "ra", "dec", "to_come"), "step").alias("_e")
        return log.groupBy("source_id", "target_cell").agg(last).select("source_id", "target_cell", "_e.*").filter("to_come > 0")

    def pairs(self) -> DataFrame:
        """All detections filled in: object_id, target_cell, epoch, source_id."""
        return self.spark.read.schema(PAIRS).parquet(f"{self.path}/pairs").drop("step")

    def absorb(self, border_objects: DataFrame, rows: DataFrame, step: int) -> None:
        """Take a micro-batch: the border objects found in it and its tagged rows.

        The objects of a step must not be found again in later ones.
        """
        work = Workspace(self.spark, "deliveries")
        rows = work.save(rows.filter("cell IS NOT NULL AND epoch IS NOT NULL"), "rows")
        coarse = cell_parent("cell", CELL_ORDER, COARSE_ORDER)
        covered = [r[0] for r in rows.select(coarse.alias("c")).distinct().collect()]  # at most 3072 on the sky
        placed = border_objects.filter("source_id IS NOT NULL AND epoch IS NOT NULL AND ra IS NOT NULL AND dec IS NOT NULL")
        sent = placed.select(
            "source_id", F.explode("border_cells").alias("target_cell"), "epoch", "ra", "dec", F.lit(self.delay).alias("to_come")
        )
        known = self.open_deliveries(step, covered).select(*sent.columns).withColumn("_sent", F.lit(False))
        waiting = known.unionByName(sent.withColumn("_sent", F.lit(True)))
        epochs = rows.groupBy(F.col("cell").alias("target_cell")).agg(F.array_sort(F.collect_set("epoch")).alias("_epochs"))
        later = F.filter(F.coalesce("_epochs", F.array().cast("array<int>")), lambda e: e > F.col("epoch"))
        met = waiting.join(epochs, "target_cell", "left").withColumn("_later", later)
        met = met.filter(F.col("_sent") | (F.size("_later") > 0)).select(
            "source_id",
            "epoch",
            "ra",
            "dec",
            "target_cell",
            F.greatest(F.lit(0), F.col("to_come") - F.size("_later")).alias("to_come"),
            F.coalesce(F.get("_later", F.col("to_come") - 1), F.lit(NEVER)).alias("to_epoch"),
        )
        met = work.save(met, "met")
        joined = met.select("source_id", "epoch", "ra", "dec", F.array("target_cell").alias("border_cells"), F.col("epoch").alias("from_epoch"), "to_epoch")
        self._store(backfill(joined, rows, **self.options), "pairs", step)
        entries = met.select(*ENTRY).withColumn("coarse_cell", cell_parent("target_cell", CELL_ORDER, COARSE_ORDER))
        self._store(entries, "log", step)
