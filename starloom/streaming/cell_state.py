"""The fold as keyed state: the references of a sky cell, by small squares, in a map.

Rows go to their own cell and, near a border, also to the cells they touch. A cell keeps the references it can
see in a map from squares (a few radii wide) to lists, so a batch reads and writes the squares it touches, however many
references the cell holds. Pairs are reported by the home cell of the detection.

*Dropping.* Misses are counted by the epochs in which a reference's home cell was covered. Every cell tells its
neighbours which epochs it covered (one message per task, cell and epoch), so copies of a reference across a border
are dropped at the same epoch as the reference. Misses are counted when a reference is met again; in between
a timer sweeps the cell and takes out references that have missed too many epochs to match ever again, with
the epochs of the clock that nobody needs any more.

Foreign rows are judged with less context, which is exact as long as chains of detections, each just in
range of the next, stay shorter than the border strip (six radii at the default
levels); ``StreamFold`` has no such limit.

An exposure has to arrive within one micro-batch, and epochs in order. The rows
of one cell and micro-batch are held by one task; the source's trigger limits
bound them.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from starloom.functions.cells import MatchGrid, cell_neighbours
from starloom.operators.halo import halo_replicate, tag_cells
from starloom.plans.fold import FoldOptions, placed
from starloom.schema import CELL_ORDER, FINE_ORDER

OUTPUT = "object_id string, epoch int, source_id string"
MESSAGE = ["cell", "home_cell", "source_id", "epoch", "ra", "dec", "mag"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SQUARE_RADII = 8
SWEEP_MINUTES = 60.0
# Places in a stored reference.
NAME, EPOCH, RA, DEC, MAG, HOME, LAST = range(7)


class Squares:
    """The touched squares of a cell, read once and written back if changed."""

    def __init__(self, state, ra0: float, shrink: float, radius: float):
        self.state, self.ra0, self.shrink, self.radius = state, ra0, shrink, radius
        self.side = SQUARE_RADII * radius
        self.held: dict[tuple[int, int], list[list]] = {}
        self.changed: set[tuple[int, int]] = set()

    def place(self, ra: float, dec: float, east: int = 0, north: int = 0) -> tuple[int, int]:
        x = ((ra - self.ra0 + 180.0) % 360.0 - 180.0) * self.shrink + east * self.radius
        return math.floor(x / self.side), math.floor((dec + north * self.radius) / self.side)

    def read(self, place: tuple[int, int]) -> list[list]:
        if place not in self.held:
            stored = self.state.getValue(place)
            self.held[place] = json.loads(stored[0]) if stored else []
        return self.held[place]

    def around(self, ra: float, dec: float) -> list[tuple[int, int]]:
        """Squares with all that can be in range; right ascension shrunk by the field's least cosine."""
        low, high = self.place(ra, dec, -1, -1), self.place(ra, dec, 1, 1)
        return [(x, y) for x in range(low[0], high[0] + 1) for y in range(low[1], high[1] + 1)]

    def write(self) -> None:
        for place in self.changed:
            refs = self.held[place]
            if refs:
                self.state.updateValue(place, (json.dumps(refs),))
            else:
                self.state.removeKey(place)


class CellFold(StatefulProcessor):
    def __init__(self, options: FoldOptions, sweep_minutes: float = SWEEP_MINUTES):
        self.radius_deg2 = options.radius_deg2
        self.max_misses = options.max_misses
        self.mag_limit = options.mag_limit
        self.sweep_ms = max(1, int(sweep_minutes * 60_000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frame = handle.getValueState("frame", "ra0 double, shrink double")
        self.spots = handle.getMapState("spots", "x bigint, y bigint", "refs string")
        self.clocks = handle.getMapState("clocks", "home bigint", "epochs string")

    def squares(self, ra: float, dec: float) -> Squares:
        """The grid of this cell, laid down by the first row it sees."""
        if not self.frame.exists():
            # A cell and its strip reach less than a fifth of a degree; near a pole all is one column.
            self.frame.update((ra, max(0.0, math.cos(math.radians(min(90.0, abs(dec) + 0.2))))))
        ra0, shrink = self.frame.get()
        return Squares(self.spots, ra0, shrink, math.sqrt(self.radius_deg2))

    def read_clocks(self) -> None:
        """The clocks of the cell and its neighbours, read in one go."""
        self.known = {int(home[0]): json.loads(stored[0]) for home, stored in self.clocks.iterator()}

    def clock(self, home: int) -> list[int]:
        return self.known.get(home, [])

    def gone(self, ref: list, now: int | None = None) -> bool:
        """Whether a reference has missed too many epochs of its home cell before this one (or so far)."""
        if self.max_misses is None or ref[MAG] is None or not ref[MAG] < self.mag_limit:
            return False
        clock = self.clock(ref[HOME])
        end = len(clock) if now is None else bisect_left(clock, now)
        return end - bisect_right(clock, ref[LAST]) >= self.max_misses

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batches = list(rows)
        names, home, epoch, ra, dec, mag = ([v for b in batches for v in b[c].tolist()] for c in ("source_id", "home_cell", "epoch", "ra", "dec", "mag"))
        named = [not pd.isna(n) for n in names]
        self.known: dict[int, list[int]] = {}
        cell = int(key[0])
        if self.max_misses is not None:
            self.read_clocks()
            covered: dict[int, set[int]] = {}
            for h, e, n in zip(home, epoch, named):
                if not n or h == cell:
                    covered.setdefault(int(h), set()).add(int(e))
            for h, epochs in covered.items():
                before = self.clock(h)
                merged = sorted({*before, *epochs})
                if len(merged) > len(before):
                    self.known[h] = merged
                    self.clocks.updateValue((h,), (json.dumps(merged),))
            if not list(self.handle.listTimers()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.sweep_ms)
        mags = (None if pd.isna(m) else float(m) for m in mag)
        told = zip(names, epoch, ra, dec, mags, home, named)
        detections = sorted(((n, int(e), r, d, m, int(h)) for n, e, r, d, m, h, is_row in told if is_row), key=lambda row: row[EPOCH])
        found: list[tuple] = []
        if detections:
            squares = self.squares(detections[0][RA], detections[0][DEC])
            at = 0
            while at < len(detections):
                end = at
                while end < len(detections) and detections[end][EPOCH] == detections[at][EPOCH]:
                    end += 1
                found += self.step(squares, detections[at:end], cell)
                at = end
            squares.write()
        yield reported(found)

    def step(self, squares: Squares, now: list[tuple], cell: int) -> list[tuple]:
        """One epoch: match, count misses, drop, and take in what is new."""
        met: list[tuple[int, list, tuple[int, int]]] = []
        for number, row in enumerate(now):
            for place in squares.around(row[RA], row[DEC]):
                met += [(number, ref, place) for ref in squares.read(place) if ref[EPOCH] < row[EPOCH] and self.near(ref, row)]
        epoch = now[0][EPOCH]
        dropped: set[int] = set()
        judged: set[int] = set()
        for _, ref, place in met:
            if id(ref) in judged:
                continue
            judged.add(id(ref))
            squares.changed.add(place)
            if self.gone(ref, epoch):
                dropped.add(id(ref))
                squares.held[place].remove(ref)
            else:
                ref[LAST] = epoch
        claimed = {number for number, ref, _ in met if id(ref) not in dropped}
        found = [
            (ref[NAME], epoch, now[number][NAME]) for number, ref, _ in met if id(ref) not in dropped and now[number][HOME] == cell
        ]
        for number, row in enumerate(now):
            if number not in claimed:
                place = squares.place(row[RA], row[DEC])
                squares.read(place).append([*row, epoch])
                squares.changed.add(place)
        return found

    def near(self, ref: list, row: tuple) -> bool:
        rise = ref[DEC] - row[DEC]
        gap = abs(ref[RA] - row[RA])
        gap = min(gap, 360.0 - gap) * math.cos(math.radians((ref[DEC] + row[DEC]) / 2.0))
        return gap * gap + rise * rise < self.radius_deg2

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Take out what can never match again, and epochs before all that is left."""
        self.read_clocks()
        least: dict[int, int] = {}
        for place, stored in list(self.spots.iterator()):
            refs = json.loads(stored[0])
            kept = [r for r in refs if not self.gone(r)]
            for r in kept:
                least[r[HOME]] = min(least.get(r[HOME], r[LAST]), r[LAST])
            if not kept:
                self.spots.removeKey(tuple(place))
            elif len(kept) < len(refs):
                self.spots.updateValue(tuple(place), (json.dumps(kept),))
        for home, epochs in self.known.items():
            # The latest stays: an exposure of that epoch may not be complete in a neighbour's messages.
            needed = [e for e in epochs if e >= least.get(home, epochs[-1])]
            if len(needed) < len(epochs):
                self.clocks.updateValue((home,), (json.dumps(needed),))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.sweep_ms)
        yield reported([])

    def close(self) -> None:
        pass


def reported(found: list[tuple]) -> pd.DataFrame:
    objects, epochs, sources = zip(*found) if found else ((), (), ())
    columns = {"object_id": np.array(objects, dtype=object), "epoch": np.array(epochs, dtype=np.int32)}
    return pd.DataFrame({**columns, "source_id": np.array(sources, dtype=object)})


def covered_epochs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each cell and epoch once per batch of rows."""
    for batch in batches:
        yield batch.drop_duplicates()


def cell_fold(
    observations: DataFrame,
    options: FoldOptions = FoldOptions(),
    order: int = CELL_ORDER,
    fine_order: int = FINE_ORDER,
    sweep_minutes: float = SWEEP_MINUTES,
) -> DataFrame:
    """Streaming observations to a stream of (object_id, epoch, source_id).

    A higher ``order`` makes smaller cells, for fields where one cell would
    hold too many rows of a micro-batch; the miss clock then counts per such
    cell, too.
    """
    if options.max_misses is not None and options.miss_clock != "cell":
        raise ValueError("the keyed state knows the epochs of its own cell only: miss_clock must be 'cell'")
    if MatchGrid.for_radius(options.radius_deg2).fine_order < fine_order:
        raise ValueError(f"the radius is too wide for border strips of level {fine_order}")
    slim = observations.select("source_id", "epoch", "ra", "dec", "mag").filter(placed())
    tagged = tag_cells(slim, order, fine_order)
    messages = halo_replicate(tagged).withColumn("epoch", F.col("epoch").cast("int")).select(*MESSAGE)
    if options.max_misses is not None:
        covered = tagged.select("cell", F.col("epoch").cast("int").alias("epoch")).mapInPandas(covered_epochs, "cell bigint, epoch int")
        told = covered.select(F.col("cell").alias("home_cell"), "epoch", F.explode(F.array_compact(F.array_distinct(cell_neighbours("cell", order)))).alias("cell"))
        empty = {"source_id": F.lit(None).cast("string"), **{c: F.lit(None).cast("double") for c in ("ra", "dec", "mag")}}
        messages = messages.unionByName(told.withColumns(empty).select(*MESSAGE))
    return messages.groupBy("cell").transformWithStateInPandas(
        statefulProcessor=CellFold(options, sweep_minutes),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None" if options.max_misses is None else "ProcessingTime",
    )


def run_cell_fold(
    observations: DataFrame,
    out: str,
    checkpoint: str,
    options: FoldOptions = FoldOptions(),
    state_partitions: int | None = None,
    sweep_minutes: float = SWEEP_MINUTES,
) -> DataFrame:
    """Process what has arrived and return all pairs reported so far.

    ``state_partitions`` fixes, at the first start, over how many partitions
    the cells are spread; the default is the session's.
    """
    spark = observations.sparkSession
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Timers alone start no batch, or a run over what is there would never end.
    empty_batches = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        query = (
            cell_fold(observations, options, sweep_minutes=sweep_minutes)
            .writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .option("path", out)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", empty_batches)
    return spark.read.schema(OUTPUT).parquet(out)
