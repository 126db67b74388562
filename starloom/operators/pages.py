"""Series that grow: new epochs write last pages only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.series import PAGE, in_pages, written_pages

PAGES = "object_id string, part int, n_detections bigint, detections string"
INDEX = "object_id string, last_part int, n_detections bigint"
STARTED = -1


class SeriesPages:
    """The wide form of all series, stored by step.

    An index holds each object's last page and the number of its detections. A step takes the pairs of later epochs,
    reads of what is stored the index and the last pages it continues, and writes these pages anew with those
    that follow. Pages before them are not read or written. A page's latest step counts; a step that is run
    again overwrites itself.
    """

    def __init__(self, spark: SparkSession, path: str, page: int = PAGE):
        self.spark, self.path, self.page = spark, path, page
        for name, schema in (("pages", PAGES), ("index", INDEX)):
            self._store(spark.createDataFrame([], schema), name, STARTED)

    def _store(self, df: DataFrame, name: str, step: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/step={step}")

    def _stored(self, name: str, schema: str, before: int | None) -> DataFrame:
        df = self.spark.read.schema(schema + ", step bigint").parquet(f"{self.path}/{name}")
        return df if before is None else df.filter(F.col("step") < before)

    def _latest(self, name: str, schema: str, keys: list[str], before: int | None) -> DataFrame:
        values = [c.split()[0] for c in schema.split(", ") if c.split()[0] not in keys]
        last = F.max(F.struct("step", *values)).alias("_l")
        return self._stored(name, schema, before).groupBy(*keys).agg(last).select(*keys, *[f"_l.{v}" for v in values], "_l.step")

    def pages(self, before: int | None = None) -> DataFrame:
        return self._latest("pages", PAGES, ["object_id", "part"], before).drop("step")

    def extend(self, pairs: DataFrame, step: int) -> None:
        """Add pairs (object_id, epoch, source_id) whose epochs come after all stored ones of their objects."""
        touched = pairs.select("object_id").distinct()
        index = self._latest("index", INDEX, ["object_id"], step).drop("step").join(touched, "object_id", "left_semi")
        begins = index.select("object_id", F.col("n_detections").cast("long").alias("_held"))
        new = written_pages(in_pages(pairs.select("object_id", "epoch", "source_id"), self.page, begins))
        # Only pages that are not full are continued; all others of these objects stay as they are.
        open_page = index.filter(F.col("n_detections") % self.page > 0).select("object_id", F.col("last_part").alias("part"))
        held = self._stored("pages", PAGES, step).join(open_page, ["object_id", "part"], "left_semi")
        last = F.max(F.struct("step", "n_detections", "detections")).alias("_l")
        held = held.groupBy("object_id", "part").agg(last).select(
            "object_id", "part", F.col("_l.n_detections").alias("_n"), F.col("_l.detections").alias("_before")
        )
        joined = new.join(held, ["object_id", "part"], "left")
        pages = joined.select(
            "object_id",
            "part",
            (F.col("n_detections") + F.coalesce("_n", F.lit(0))).alias("n_detections"),
            F.concat_ws(",", "_before", "detections").alias("detections"),
        )
        self._store(pages, "pages", step)
        grown = pairs.groupBy("object_id").agg(F.count(F.lit(1)).alias("_more")).join(begins, "object_id", "left")
        total = F.col("_more") + F.coalesce("_held", F.lit(0))
        self._store(grown.select("object_id", F.floor((total - 1) / self.page).cast("int").alias("last_part"), total.alias("n_detections")), "index", step)
