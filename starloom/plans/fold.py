"""The epoch fold: which detections found an object, and which belong to it.

Going through the epochs in order, a detection without a reference in range
becomes a reference itself. Detections of the same epoch do not see each other.
Taken literally that is one step per exposure. The outcome of a detection,
however, depends only on earlier detections in its range, so the fold can
settle everything whose surroundings are settled at once:

1. Take the undecided detections of the lowest undecided epoch of each spot (a
   cell narrower than the radius). They lead their spot.
2. Leaders without an earlier undecided detection in range become references.
3. Undecided detections in range of a new reference are settled; repeat.

On clean data two rounds do, however many epochs there are; a chain of
detections, each just in range of the next, takes a round per link. Rounds
after the first work on what is left over. The result is exactly that of the
step-by-step fold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.functions.cells import MatchGrid, cell_parent, with_sky_cell
from starloom.operators.crossmatch import join_keyed, key_reference, near
from starloom.operators.halo import ROWS_PER_TASK, assign_slot, copy_to_slots, hot_keys
from starloom.operators.series import eviction_epoch
from starloom.schema import CELL_ORDER, MAG_LIMIT, RADIUS_DEG2
from starloom.session import Workspace


@dataclass(frozen=True)
class FoldOptions:
    radius_deg2: float = RADIUS_DEG2
    max_misses: int | None = None  # None: objects are never dropped
    mag_limit: float = MAG_LIMIT
    miss_clock: str = "cell"
    rows_per_task: int = ROWS_PER_TASK
    grid: MatchGrid | None = None

    def match_grid(self) -> MatchGrid:
        grid = self.grid or MatchGrid.for_radius(self.radius_deg2)
        grid.check_radius(self.radius_deg2)
        return grid


@dataclass
class Series:
    """``references``: one row per object found. ``placed``: (object_id, epoch, source_id) and the object's cell.

    ``closed``: of the references known before, those that were dropped, with the epoch.
    """

    references: DataFrame
    placed: DataFrame
    rounds: int = field(default=0)
    closed: DataFrame | None = None

    @property
    def pairs(self) -> DataFrame:
        return self.placed.drop("cell")


COLUMNS = ["source_id", "epoch", "ra", "dec", "mag", "cell"]


def placed() -> Column:
    """Rows the fold can judge: with an id, an epoch and a position."""
    known = F.col("source_id").isNotNull() & F.col("epoch").isNotNull()
    for c in ("ra", "dec"):
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    return known


def set_aside(observations: DataFrame) -> DataFrame:
    """The rows a fold leaves out, as they came."""
    return observations.filter(~placed())


def add_keys(observations: DataFrame, options: FoldOptions) -> DataFrame:
    """Narrow the rows to what the fold needs and add its cells."""
    grid = options.match_grid()
    mag = F.col("mag") if "mag" in observations.columns else F.lit(None).cast("double")
    slim = observations.select(
        "source_id", F.col("epoch").cast("int").alias("epoch"), "ra", "dec", mag.alias("mag")
    ).filter(placed())
    return with_sky_cell(slim, "_micro", grid.micro_order).withColumns(
        {
            "_key": cell_parent("_micro", grid.micro_order, grid.order),
            "cell": cell_parent("_micro", grid.micro_order, min(CELL_ORDER, grid.order)),
        }
    )


class Resolver:
    """Settles undecided detections against each other, round by round."""

    def __init__(
        self, workspace: Workspace, observations: DataFrame, options: FoldOptions, clock: DataFrame | None = None
    ):
        """``clock`` gives (cell, epoch) where more exposures count than those of the rows."""
        self.work = workspace
        self.options = options
        self.grid = options.match_grid()
        # The input is read once; what follows works on the stored, narrow rows.
        # They lie in buckets of their keys, so the joins of all rounds move references only.
        stored = workspace.save(add_keys(observations, options), "keyed")
        self.hot = workspace.save(hot_keys(stored, "_key", options.rows_per_task), "hot_keys")
        self.rows = workspace.save_bucketed(assign_slot(stored, self.hot, "_key"), "rows", "_key", "_slot")
        self.clock = clock
        if options.max_misses is not None and clock is None:
            # Which cells were covered in which epochs: all that counting misses needs.
            self.clock = workspace.save(stored.select("cell", "epoch").distinct(), "clock")
        self.near = near(options.radius_deg2)

    def with_slots(self, df: DataFrame) -> DataFrame:
        """Keys for further rows, spread over the same slots as the stored ones."""
        return assign_slot(add_keys(df, self.options), self.hot, "_key")

    def as_reference(self, df: DataFrame) -> DataFrame:
        """Copies of references for every cell and slot they have to be seen in."""
        return copy_to_slots(key_reference(df, self.grid), self.hot, "_key")

    def attached(self):
        """Join condition: the detection belongs to the reference."""
        later = self.near & (F.col("epoch") > F.col("ref_epoch"))
        if self.options.max_misses is None:
            return later
        return later & (F.col("ref_gone_epoch").isNull() | (F.col("epoch") < F.col("ref_gone_epoch")))

    def leaders(self, undecided: DataFrame) -> DataFrame:
        """The rows of the first undecided epoch of each spot (and slot, where a cell is crowded)."""
        spot = Window.partitionBy("_key", "_slot", "_micro")
        return undecided.withColumn("_first", F.min("epoch").over(spot)).filter("epoch = _first").select(*COLUMNS)

    def founders(self, leaders: DataFrame, undecided: DataFrame) -> DataFrame:
        """Leaders that no earlier undecided detection can still claim."""
        waiting = (
            join_keyed(
                undecided,
                self.as_reference(leaders.select("source_id", "epoch", "ra", "dec")),
                self.near & (F.col("epoch") < F.col("ref_epoch")),
            )
            .select(F.col("ref_source_id").alias("source_id"))
            .distinct()
        )
        return leaders.join(waiting, "source_id", "left_anti")

    def with_gone_epoch(self, references: DataFrame) -> DataFrame:
        """Add the epoch from which on a dropped reference no longer matches."""
        o = self.options
        if o.max_misses is None:
            return references.withColumn("gone_epoch", F.lit(None).cast("int"))
        bright = references.filter(F.col("mag") < o.mag_limit)
        matched = join_keyed(
            self.rows.drop("mag", "cell"),
            self.as_reference(bright.select("source_id", "epoch", "ra", "dec", "mag", "cell")),
            self.near & (F.col("epoch") > F.col("ref_epoch")),
        ).select(
            F.col("ref_source_id").alias("object_id"),
            "epoch",
            F.col("ref_mag").alias("mag"),
            F.col("ref_cell").alias("cell"),
        )
        own = bright.select(F.col("source_id").alias("object_id"), "epoch", "mag", "cell")
        hits = matched.unionByName(own).distinct()
        gone = eviction_epoch(hits, self.clock, o.max_misses, o.mag_limit, o.miss_clock)
        return references.join(
            gone.withColumnRenamed("object_id", "source_id"), "source_id", "left"
        )

    def closed(self, known: DataFrame) -> DataFrame:
        """Known references that these rows meet after too many misses: ``object_id`` and ``gone_epoch``."""
        o = self.options
        if o.max_misses is None:
            return known.select(F.col("source_id").alias("object_id"), F.col("epoch").alias("gone_epoch")).limit(0)
        bright = known.filter(F.col("mag") < o.mag_limit)
        met = join_keyed(
            self.rows.drop("mag", "cell"),
            self.as_reference(bright.select(*COLUMNS)),
            self.near & (F.col("epoch") > F.col("ref_epoch")),
        ).select(F.col("ref_source_id").alias("object_id"), "epoch", F.col("ref_mag").alias("mag"), F.col("ref_cell").alias("cell"))
        before = bright.select(F.col("source_id").alias("object_id"), F.col("last_epoch").alias("epoch"), "mag", "cell")
        hits = met.unionByName(before).distinct()
        return eviction_epoch(hits, self.clock, o.max_misses, o.mag_limit, o.miss_clock)

    def uncovered(self, undecided: DataFrame, references: DataFrame) -> DataFrame:
        """What is left after taking out the references and everything attached to them."""
        itself = F.col("source_id") == F.col("ref_source_id")
        return join_keyed_keep(
            undecided, self.as_reference(references), self.attached() | itself
        )

    def run(self, undecided: DataFrame, tag: str = "round") -> tuple[list[str], int]:
        """Returns the names of the stored reference tables and the number of rounds."""
        names: list[str] = []
        number = 0
        left = undecided.count()
        while left:
            number += 1
            leaders = self.work.save(self.leaders(undecided), f"{tag}-{number}/leaders")
            founders = self.founders(leaders, undecided)
            if self.options.max_misses is not None:
                founders = self.work.save(founders, f"{tag}-{number}/founders")
            name = f"{tag}-{number}/references"
            references = self.work.save(self.with_gone_epoch(founders), name)
            names.append(name)
            rest = self.uncovered(undecided, references)
            undecided = self.work.save_bucketed(rest, f"{tag}-{number}/undecided", "_key", "_slot", dealt=True)
            before, left = left, undecided.count()
            if left >= before:
                raise RuntimeError(f"{left} detections stay undecided; is source_id unique?")
        return names, number


def join_keyed_keep(undecided: DataFrame, reference: DataFrame, condition) -> DataFrame:
    """Anti join on the keys that leaves the keys in place."""
    right = reference.withColumnsRenamed({"_key": "ref_key", "_slot": "ref_slot"})
    on = (F.col("_key") == F.col("ref_key")) & (F.col("_slot") == F.col("ref_slot")) & condition
    return undecided.join(right, on, "left_anti")


def fold_rounds(
    observations: DataFrame,
    options: FoldOptions = FoldOptions(),
    workspace: Workspace | None = None,
    clock: DataFrame | None = None,
    known: DataFrame | None = None,
) -> Series:
    """Reference list and series by rounds. ``source_id`` must be unique.

    Rows without id, epoch or position take no part; ``set_aside`` gives them. ``known`` are references found
    before (with ``cell`` and ``last_epoch``, the epoch in which each was seen last), ``clock`` the (cell, epoch) that count.
    """
    spark: SparkSession = observations.sparkSession
    work = workspace or Workspace(spark, "fold")
    resolver = Resolver(work, observations, options, clock)
    if known is None:
        names, rounds = resolver.run(resolver.rows)
        return collect_series(resolver, names, rounds)
    closed = work.save(resolver.closed(known), "closed")
    gone = closed.withColumnRenamed("object_id", "source_id")
    before = work.save(known.select(*COLUMNS).join(gone, "source_id", "left"), "known")
    open_rows = work.save(resolver.uncovered(resolver.rows, before), "open")
    names, rounds = resolver.run(open_rows)
    found = collect_series(resolver, names, rounds, before)
    found.closed = closed
    return found


def fold_series(
    observations: DataFrame, options: FoldOptions = FoldOptions(), workspace: Workspace | None = None
) -> Series:
    """Reference list and series of all detections. ``source_id`` must be unique.

    The cells' tasks do it in one pass; radii too wide for the border strips go through the rounds.
    """
    from starloom.plans.percell import fold_per_cell  # which uses the rounds of this module

    return fold_per_cell(observations, options, workspace)


def collect_series(resolver: Resolver, names: list[str], rounds: int, known: DataFrame | None = None) -> Series:
    """The references of the rounds, and the pairs of these and the known ones."""
    spark = resolver.work.spark
    if names:
        schema = "source_id string, epoch int, ra double, dec double, mag double, cell bigint, gone_epoch int"
        references = resolver.work.load(schema, *names)
    else:
        references = resolver.rows.select(*COLUMNS).withColumn("gone_epoch", F.lit(None).cast("int")).limit(0)
    every = references if known is None else references.unionByName(known)
    pairs = join_keyed(resolver.rows.drop("cell"), resolver.as_reference(every), resolver.attached()).select(
        F.col("ref_source_id").alias("object_id"), "epoch", "source_id", F.col("ref_cell").alias("cell")
    )
    return Series(references.withColumnRenamed("source_id", "object_id"), pairs, rounds)
