"""The fold as a stream: each micro-batch of exposures extends a stored reference list.

State is kept in tables below one folder, with one subfolder per step. A micro-batch ``n`` has step
``3 n`` for its rows in time, ``3 n + 1`` for its late rows, and ``3 n + 2`` if the state is compacted after
it. A step that is run again after a failure overwrites its own subfolders and reads only those of
earlier steps, so every row counts exactly once. Tables are stored by coarse cell, so a batch opens
only the cells it can reach; the latest epoch and time of each step are a table of their own.

*Dropping.* The state holds the epochs in which each cell was covered (the clock) and the last epoch
in which each object was seen. A batch counts the misses of the objects it meets, and no others: an object that
comes back after too many is closed, and the detection starts a new one.

*Late rows* (of epochs already passed) can change what their neighbours are, and through them what theirs are. So
everything connected with a late row by steps within the radius is folded anew. A late exposure can also add an
epoch to a cell's clock; objects that this closes earlier are folded anew, too. The state is
then that of a fold over all rows in order.

*Watermark.* With ``lateness``, rows whose ``obs_time`` lies further than that behind the latest time of the
batches before are too late: they are set aside in a table and counted, and change nothing. Rows behind the
watermark are final, so they leave the state; what is folded anew starts from the references found before.
Epochs have to rise with time. A row without a time is never too late.

*Compaction.* ``compact`` merges the steps since the last time into a run, and runs of equal level into one of the next,
so the state has a logarithm of runs, each row is written that often, and a list of the live runs, written
last, switches readers over at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.cells import cell_parent, with_sky_cell
from starloom.operators.crossmatch import join_keyed, key_observations, key_reference, near
from starloom.operators.halo import assign_slot, copy_to_slots, hot_keys
from starloom.operators.series import eviction_epoch
from starloom.plans.fold import FoldOptions, placed
from starloom.plans.percell import fold_per_cell
from starloom.schema import CELL_ORDER
from starloom.session import Workspace, remove_folder, subfolders

POSITION = "source_id string, epoch int, ra double, dec double, mag double, cell bigint"
TABLES = {
    "references": POSITION + ", gone_epoch int, coarse_cell bigint",
    "rows": POSITION + ", obs_time timestamp, coarse_cell bigint",
    "pairs": "object_id string, epoch int, source_id string, coarse_cell bigint",
    "redone": "source_id string",
    "clock": "cell bigint, epoch int, coarse_cell bigint",
    "gone": "source_id string, gone_epoch int, coarse_cell bigint",
    "seen": "source_id string, last_epoch int, coarse_cell bigint",
    "frontier": "epoch int, obs_time timestamp",
    "too_late": "source_id string, epoch int, ra double, dec double, mag double, obs_time timestamp",
    "runs": "run bigint, level int",
}
COARSE_ORDER = 4  # 3072 cells on the sky
STARTED = -1  # number of the empty step that creates the tables
NAMED = [c.split()[0] for c in POSITION.split(", ")]


def columns(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name].split(", ")]


class StreamFold:
    """Stored state of a streaming fold and the steps that extend it."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        options: FoldOptions = FoldOptions(),
        lateness: str | None = None,
        compact_every: int | None = None,
    ):
        """``lateness`` is an interval such as ``10 days``; ``compact_every`` a number of micro-batches."""
        self.spark, self.path, self.options = spark, path, options
        self.lateness, self.compact_every = lateness, compact_every
        self._lists: dict[int | None, tuple[dict[int, int], int]] = {}
        for name, schema in TABLES.items():
            self.store(spark.createDataFrame([], schema), name, STARTED)

    # --- Tables ---------------------------------------------------------------

    def store(self, df: DataFrame, name: str, step: int) -> None:
        """Tables by cell get a folder per coarse cell; rebalancing brings a cell together but splits a crowded one."""
        df, path = df.select(*columns(name)), f"{self.path}/{name}/step={step}"
        if "coarse_cell" not in df.columns:
            df.write.mode("overwrite").parquet(path)
            return
        dealt = df.hint("rebalance", "coarse_cell").sortWithinPartitions("coarse_cell")
        dealt.write.mode("overwrite").partitionBy("coarse_cell").parquet(path)

    def stored(self, name: str, before: int | None = None) -> DataFrame:
        """The live rows of a table with their step; only files of live steps are opened."""
        df = self.spark.read.schema(TABLES[name] + ", step bigint").parquet(f"{self.path}/{name}")
        if before is not None:
            df = df.filter(F.col("step") < before)
        if name in ("runs", "too_late"):
            return df
        runs, upto = self.live_runs(before)
        return df.filter(F.col("step").isin([STARTED, *runs]) | (F.col("step") > upto))

    def live_runs(self, before: int | None = None) -> tuple[dict[int, int], int]:
        """The compacted runs in use with their levels, and the last step they cover."""
        batch = None if before is None else before // 3  # lists are written between micro-batches
        if batch is None or batch not in self._lists:
            listed = self.stored("runs", before)
            upto = listed.agg(F.max("step")).first()[0]
            rows = [] if upto is None else listed.filter(F.col("step") == upto).orderBy("run").collect()
            self._lists[batch] = {r.run: r.level for r in rows}, STARTED if upto is None else upto
        return self._lists[batch]

    def current(self, name: str, before: int | None = None) -> DataFrame:
        """A table without what later steps have redone."""
        redone = self.stored("redone", before).select(F.col("source_id").alias("_redone"), F.col("step").alias("_later"))
        same = (F.col("source_id") == F.col("_redone")) & (F.col("_later") > F.col("step"))
        return self.stored(name, before).join(redone, same, "left_anti")

    def latest(self, name: str, value: str, before: int | None = None) -> DataFrame:
        """The last entry of each object."""
        last = F.max(F.struct("step", value, "coarse_cell")).alias("_e")
        told = self.stored(name, before).groupBy("source_id").agg(last)
        return told.select("source_id", F.col(f"_e.{value}").alias(f"_{value}"), F.col("_e.step").alias("_at"), F.col("_e.coarse_cell").alias("_cell"))

    def pairs(self, before: int | None = None) -> DataFrame:
        return self.current("pairs", before).drop("coarse_cell", "step")

    def references(self, before: int | None = None, cells: list[int] | None = None) -> DataFrame:
        """The reference list with the epochs in which objects were closed."""
        known = self.within(self.current("references", before), cells)
        if self.options.max_misses is not None:
            closed = self.latest("gone", "gone_epoch", before)
            closed = self.within(closed, cells, "_cell").drop("_cell").withColumnRenamed("source_id", "_id")
            known = known.join(closed, (F.col("source_id") == F.col("_id")) & (F.col("_at") > F.col("step")), "left")
            told = F.when(F.col("_id").isNotNull(), F.col("_gone_epoch")).otherwise(F.col("gone_epoch"))
            known = known.withColumn("gone_epoch", told)
        return known.select(*columns("references"))

    def too_late(self) -> DataFrame:
        """Rows that came behind the watermark."""
        return self.stored("too_late").drop("step")

    # --- Cells ------------------------------------------------------------------

    def coarse_of(self, cell: str, order: int) -> Column:
        """The coarse cell of a cell of any level (of level 4, or the grid's own if that is coarser)."""
        return cell_parent(cell, order, min(COARSE_ORDER, self.options.match_grid().order))

    def coarse(self, df: DataFrame) -> DataFrame:
        return df.withColumn("coarse_cell", self.coarse_of("cell", min(CELL_ORDER, self.options.match_grid().order)))

    def within(self, df: DataFrame, cells: list[int] | None, name: str = "coarse_cell") -> DataFrame:
        """Only the part of a table that can meet the batch; the filter reaches the scan."""
        return df if cells is None else df.filter(F.col(name).isin(cells))

    def reach(self, df: DataFrame) -> list[int]:
        """Coarse cells a batch can reach into: at most 3072 numbers."""
        grid = self.options.match_grid()
        keyed = key_reference(df.select("ra", "dec"), grid)
        return [r.c for r in keyed.select(self.coarse_of("_key", grid.order).alias("c")).distinct().collect()]

    # --- Steps ---------------------------------------------------------------------

    def frontier(self, before: int):
        """The latest epoch and time of the steps before, from one row per step."""
        return self.stored("frontier", before).agg(F.max("epoch"), F.max("obs_time")).first()

    def watermark(self, before: int) -> Column | None:
        seen = self.frontier(before)[1]
        if self.lateness is None or seen is None:
            return None
        return F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {self.lateness}")

    def absorb(self, batch: DataFrame, number: int) -> None:
        """Fold the rows of a micro-batch, of any epochs, into the state."""
        step = 3 * number
        work = Workspace(self.spark, f"stream-{number}")
        time = F.col("obs_time").cast("timestamp") if "obs_time" in batch.columns else F.lit(None).cast("timestamp")
        mag = F.col("mag") if "mag" in batch.columns else F.lit(None).cast("double")
        arrived = batch.filter(placed()).select("source_id", F.col("epoch").cast("int").alias("epoch"), "ra", "dec", mag.alias("mag"), time.alias("obs_time"))
        arrived = work.save(arrived, "arrived")
        mark = self.watermark(step)
        if mark is not None:
            behind = F.coalesce(F.col("obs_time") < mark, F.lit(False))
            self.store(arrived.filter(behind), "too_late", step)
            arrived = arrived.filter(~behind)
        first, last, latest = arrived.agg(F.min("epoch"), F.max("epoch"), F.max("obs_time")).first()
        if first is None:
            return
        passed = self.frontier(step)[0]
        if passed is None or last > passed:
            in_time = arrived if passed is None else arrived.filter(F.col("epoch") > passed)
            self.extend(in_time, step, work)
        if passed is not None and first <= passed:
            late = arrived.filter(F.col("epoch") <= passed)
            self.fold_anew(late, step + 1, Workspace(self.spark, f"late-{number}"), mark)
        told = self.spark.createDataFrame([(last, latest)], TABLES["frontier"])
        self.store(told, "frontier", step)
        if self.compact_every and (number + 1) % self.compact_every == 0:
            self.compact(number)

    def extend(self, rows: DataFrame, step: int, work: Workspace) -> None:
        """Rows of epochs after all others."""
        cells = self.reach(rows)
        known = work.save(self.references(step, cells), "known")
        placed_rows = work.save(self.celled(rows), "celled")
        clock = last = None
        if self.options.max_misses is not None:
            moments = self.moments(placed_rows)
            self.store(moments, "clock", step)
            clock = work.save(self.clock(cells, step).unionByName(moments.select("cell", "epoch")).distinct(), "clock-all")
            last = self.within(self.latest("seen", "last_epoch", step), cells, "_cell")
            last = last.select("source_id", F.col("_last_epoch").alias("last_epoch"))
        self.fold(placed_rows, known, last, clock, step, work)
        self.store(self.coarse(placed_rows), "rows", step)

    def celled(self, rows: DataFrame) -> DataFrame:
        """The rows with the cell that counts their epochs."""
        grid = self.options.match_grid()
        return with_sky_cell(rows, "cell", min(CELL_ORDER, grid.order)).select(*NAMED, "obs_time")

    def moments(self, rows: DataFrame) -> DataFrame:
        """Which cells these rows cover in which epochs; one cell stands for all where the clock is global."""
        cell = F.col("cell") if self.options.miss_clock == "cell" else F.lit(0).cast("long")
        covered = rows.select(cell.alias("cell"), "epoch").distinct()
        return self.coarse(covered) if self.options.miss_clock == "cell" else covered.withColumn("coarse_cell", F.lit(0).cast("long"))

    def clock(self, cells: list[int] | None, before: int) -> DataFrame:
        here = cells if self.options.miss_clock == "cell" else None
        return self.within(self.stored("clock", before), here).select("cell", "epoch").distinct()

    def fold(self, rows: DataFrame, known: DataFrame, last: DataFrame | None, clock: DataFrame | None, step: int, work: Workspace) -> None:
        """Fold rows into the known references, seen last at ``last``, and store what comes of it."""
        alive = known.filter(F.col("gone_epoch").isNull())
        if last is None:
            alive = alive.withColumn("last_epoch", F.col("epoch"))
        else:
            alive = alive.join(last, "source_id")
        found = fold_per_cell(rows.select("source_id", "epoch", "ra", "dec", "mag"), self.options, Workspace(self.spark, f"fold-{step}"), clock, alive)
        references = found.references.withColumnRenamed("object_id", "source_id")
        self.store(self.coarse(references), "references", step)
        pairs = work.save(self.coarse(found.placed), "placed")
        self.store(pairs, "pairs", step)
        if last is None:
            return
        closed = found.closed.withColumnRenamed("object_id", "source_id")
        self.store(known.drop("gone_epoch").join(closed, "source_id"), "gone", step)
        hits = self.coarse(references).select("source_id", "epoch", "coarse_cell").unionByName(
            pairs.select(F.col("object_id").alias("source_id"), "epoch", "coarse_cell")
        )
        self.store(hits.groupBy("source_id", "coarse_cell").agg(F.max("epoch").alias("last_epoch")), "seen", step)

    # --- Late rows -----------------------------------------------------------------

    def near_any(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Stored rows (left) in range of any of a few delivered ones (right)."""
        grid = self.options.match_grid()
        keyed = key_observations(left, grid)
        hot = hot_keys(keyed, "_key", self.options.rows_per_task)
        return join_keyed(
            assign_slot(keyed, hot, "_key"),
            copy_to_slots(key_reference(right.select("ra", "dec"), grid), hot, "_key"),
            near(self.options.radius_deg2),
            "left_semi",
        )

    def fold_anew(self, late: DataFrame, step: int, work: Workspace, mark: Column | None) -> None:
        """Late rows with all that is connected with them."""
        late = work.save(self.celled(late), "late")
        # Everything seen so far, including the newer rows of this micro-batch; what is behind the watermark is
        # final, and only the references found there take part, as they are.
        history = self.stored("rows", step)
        if mark is not None:
            history = history.filter(F.coalesce(F.col("obs_time") >= mark, F.lit(True)))
        fixed = None
        if mark is not None:
            fixed = self.references(step).join(history.select("source_id"), "source_id", "left_anti")
            history = history.select(*NAMED, "coarse_cell", F.lit(False).alias("fixed")).unionByName(fixed.select(*NAMED, "coarse_cell", F.lit(True).alias("fixed")))
        else:
            history = history.select(*NAMED, "coarse_cell", F.lit(False).alias("fixed"))
        clock = None
        region = edge = late.select(*NAMED, F.lit(False).alias("fixed"))
        if self.options.max_misses is not None:
            moments = self.moments(late)
            self.store(moments, "clock", step)
            clock = self.clock(None, step + 1)
            changed = self.closed_otherwise(moments, clock, step, work)
            if changed is not None:
                # Fold anew from the founders, or, where these are final, from the references.
                edge = work.save(region.unionByName(history.join(changed, "source_id", "left_semi").select(*region.columns)), "edge-0")
                region = edge
        rounds = 0
        while True:
            rounds += 1
            around = self.near_any(self.within(history, self.reach(edge)), edge).select(*region.columns)
            edge = work.save(around.join(region.select("source_id"), "source_id", "left_anti"), f"edge-{rounds}")
            if edge.isEmpty():
                break
            region = region.unionByName(edge)
        region = work.save(region, "region")
        rows = region.filter(~F.col("fixed"))
        self.store(rows.join(late.select("source_id"), "source_id", "left_anti").select("source_id"), "redone", step)
        known = held = self.references(step).limit(0)
        last = None
        if fixed is not None:
            held = self.references(step).join(region.filter("fixed").select("source_id"), "source_id", "left_semi")
            least = rows.agg(F.min("epoch")).first()[0]
            still = F.when(F.col("gone_epoch") < least, F.col("gone_epoch"))
            known = work.save(held.withColumn("gone_epoch", still), "held")
        if clock is not None:
            if self.options.miss_clock == "cell":
                clock = clock.join(region.select("cell").distinct(), "cell", "left_semi")
            clock = work.save(clock, "clock-here")
            last = known.select("source_id", F.col("epoch").alias("last_epoch"))
            if fixed is not None:
                # When the fixed ones were seen last by rows that are not folded anew.
                told = self.pairs(step).join(rows.select("source_id"), "source_id", "left_anti")
                told = told.select(F.col("object_id").alias("source_id"), F.col("epoch").alias("last_epoch"))
                told = told.join(known.select("source_id"), "source_id", "left_semi").unionByName(last)
                last = work.save(told.groupBy("source_id").agg(F.max("last_epoch").alias("last_epoch")), "last")
        self.fold(rows, known, last, clock, step, Workspace(self.spark, "anew"))
        if fixed is not None and clock is not None:
            self.reopened(known, held, last, step)
        self.store(self.coarse(late), "rows", step)

    def closed_otherwise(self, moments: DataFrame, clock: DataFrame, step: int, work: Workspace) -> DataFrame | None:
        """Objects that the clock's new epochs close at another time than before; None if there are no new ones."""
        new = moments.select("cell", "epoch").join(self.clock(None, step), ["cell", "epoch"], "left_anti")
        new = work.save(new, "new-moments")
        if new.isEmpty():
            return None
        here = self.references(step).filter(F.col("mag") < self.options.mag_limit)
        if self.options.miss_clock == "cell":
            here = here.join(new.select("cell").distinct(), "cell", "left_semi")
        here = work.save(here, "in-new-moments")
        objects = here.select(F.col("source_id").alias("object_id"), "mag", "cell")
        seen = self.pairs(step).join(objects, "object_id").select("object_id", "epoch", "mag", "cell")
        own = here.select(F.col("source_id").alias("object_id"), "epoch", "mag", "cell")
        again = here.filter("gone_epoch IS NOT NULL").select(F.col("source_id").alias("object_id"), F.col("gone_epoch").alias("epoch"), "mag", "cell")
        hits = seen.unionByName(own).unionByName(again).distinct()
        o = self.options
        gone = eviction_epoch(hits, clock, o.max_misses, o.mag_limit, o.miss_clock).withColumnRenamed("gone_epoch", "_gone")
        told = here.join(gone.withColumnRenamed("object_id", "source_id"), "source_id")
        return told.filter(~F.col("gone_epoch").eqNullSafe(F.col("_gone"))).select("source_id")

    def reopened(self, known: DataFrame, held: DataFrame, last: DataFrame, step: int) -> None:
        """Entries for fixed references whose closing was taken back and not made anew, and for those not met again."""
        closed = self.stored("gone", step + 1).filter(F.col("step") == step).select("source_id")
        back = held.filter("gone_epoch IS NOT NULL").join(known.filter("gone_epoch IS NULL").select("source_id"), "source_id", "left_semi")
        back = back.join(closed, "source_id", "left_anti").withColumn("gone_epoch", F.lit(None).cast("int"))
        cells = known.select("source_id", "coarse_cell")
        met = self.stored("seen", step + 1).filter(F.col("step") == step).drop("step")
        seen = met.unionByName(last.join(cells, "source_id").join(met.select("source_id"), "source_id", "left_anti").select(*met.columns))
        work = Workspace(self.spark, "reopened")
        again = work.save(self.stored("gone", step + 1).filter(F.col("step") == step).drop("step").unionByName(back.select(*columns("gone"))), "gone")
        self.store(again, "gone", step)
        self.store(work.save(seen, "seen"), "seen", step)

    # --- Compaction -------------------------------------------------------------------

    def compact(self, number: int) -> None:
        """Merge the steps since the last run, and with them the runs of levels 0, 1, 2 … that end the list."""
        step = 3 * number + 2
        runs, upto = self.live_runs(step)
        merged, level = [], 0
        kept = list(runs)
        while kept and runs[kept[-1]] == level:
            merged.append(kept.pop())
            level += 1
        part = F.col("step").isin(merged) | ((F.col("step") > upto) & (F.col("step") < step))
        oldest = not kept
        work = Workspace(self.spark, f"compact-{number}")
        mark = self.watermark(step)
        closed = self.latest("gone", "gone_epoch", step).drop("_cell").withColumnRenamed("source_id", "_id")
        for name in ("references", "rows", "pairs", "clock", "gone", "seen", "redone", "frontier"):
            df = (self.current(name, step) if name in ("references", "pairs") else self.stored(name, step)).filter(part)
            if name == "references" and self.options.max_misses is not None:
                df = df.join(closed, (F.col("source_id") == F.col("_id")) & (F.col("_at") > F.col("step")), "left")
                df = df.withColumn("gone_epoch", F.when(F.col("_id").isNotNull(), F.col("_gone_epoch")).otherwise(F.col("gone_epoch")))
            elif name == "rows" and mark is not None:
                df = df.filter(F.coalesce(F.col("obs_time") >= mark, F.lit(True)))
            elif name in ("gone", "seen"):
                value = columns(name)[1]
                df = df.groupBy("source_id").agg(F.max(F.struct("step", value, "coarse_cell")).alias("_e"))
                df = df.select("source_id", f"_e.{value}", "_e.coarse_cell")
            elif name in ("clock", "redone"):
                df = df.drop("step").distinct()
            elif name == "frontier":
                df = df.agg(F.max("epoch").alias("epoch"), F.max("obs_time").alias("obs_time"))
            if name in ("gone", "redone") and oldest:
                df = df.limit(0)  # all they speak of is in this run, which follows them already
            self.store(work.save(df.select(*columns(name)), name), name, step)
        told = [*((r, runs[r]) for r in kept), (step, level)]
        self.store(self.spark.createDataFrame(told, TABLES["runs"]), "runs", step)
        self._lists = {k: v for k, v in self._lists.items() if k is not None and k <= number}

    def vacuum(self) -> int:
        """Delete the folders of steps that the last two lists of runs no longer use; readers of these must be done."""
        lists = sorted(r.step for r in self.stored("runs").select("step").distinct().collect())[-2:]
        if len(lists) < 2:
            return 0
        live = {STARTED, *lists}
        for at in lists:
            live |= set(self.live_runs(at + 1)[0])
        removed = 0
        for name in TABLES:
            for folder in subfolders(self.spark, f"{self.path}/{name}"):
                step = int(folder.rpartition("=")[2])
                if step < lists[0] and step not in live and name != "too_late":
                    remove_folder(self.spark, f"{self.path}/{name}/{folder}")
                    removed += 1
        return removed


def run_stream(spark: SparkSession, source: str, schema, state: StreamFold, max_files: int | None = None) -> None:
    """Fold everything that has arrived in ``source`` since the last run; late rows included."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    query = (
        reader.parquet(source)
        .writeStream.foreachBatch(lambda df, number: state.absorb(df, number))
        .option("checkpointLocation", f"{state.path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
