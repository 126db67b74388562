import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.operators.halo import tag_cells
from starloom.plans.fold import FoldOptions, fold_series
from starloom.session import Workspace
from starloom.streaming.cell_state import CellFold, cell_fold, run_cell_fold
from starloom.streaming.fold import StreamFold, run_stream
from tests import brute

SCHEMA = "source_id string, epoch int, ra double, dec double, mag double"


def pair_set(df):
    rows = df.select("object_id", "source_id").collect()
    assert len(rows) == len(set(rows))
    return {(r[0], r[1]) for r in rows}


def arrive(spark, rows, work, waves):
    for n, wave in enumerate(waves):
        part = spark.createDataFrame(rows, SCHEMA).filter(F.col("epoch").isin(*wave))
        part.coalesce(2).write.parquet(f"{work.path}/in/wave-{n}")
        yield spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{work.path}/in")


def test_stream_fold_and_repeated_batch(spark):
    rows = brute.random_sky(31, stars=20, epochs=12, spread=0.03)
    work = Workspace(spark, "test-stream")
    state = StreamFold(spark, f"{work.path}/state")
    for _ in arrive(spark, rows, work, [range(1, 6), range(6, 13)]):
        run_stream(spark, f"{work.path}/in", SCHEMA, state)
    want = brute.fold(rows)
    assert pair_set(state.pairs()) == want
    # a micro-batch that is run again replaces what it wrote
    state.absorb(spark.createDataFrame(rows[rows.epoch >= 6], SCHEMA), 1)
    assert pair_set(state.pairs()) == want


def test_keyed_state_equals_the_fold(spark):
    rows = brute.random_sky(32, stars=12, epochs=30, seen=0.15, spread=0.05, jitter=2e-4)
    options = FoldOptions(max_misses=3, miss_clock="cell")
    work = Workspace(spark, "test-keyed")
    pairs = None
    for stream in arrive(spark, rows, work, [range(1, 16), range(16, 31)]):
        pairs = run_cell_fold(stream, f"{work.path}/out", f"{work.path}/checkpoint", options)
    want = pair_set(fold_series(spark.createDataFrame(rows, SCHEMA), options).pairs)
    assert want and pair_set(pairs) == want


def test_late_rows_give_the_batch_result(spark):
    rows = brute.random_sky(33, stars=15, epochs=10, spread=0.02)
    chain = [("R", 1, 50.0, 5.0, 12.0), ("L0", 4, 50.0005, 5.0, 12.0), ("L1", 2, 50.001, 5.0, 12.0), ("N", 6, 50.0015, 5.0, 12.0)]
    rows = pd.concat([rows, pd.DataFrame(chain, columns=rows.columns)], ignore_index=True)
    work = Workspace(spark, "test-late")
    state = StreamFold(spark, f"{work.path}/state")
    late = rows.source_id.isin(["L1"]) | (rows.epoch.isin([3, 5]) & (rows.index % 2 == 0))
    for n, part in enumerate([rows[(rows.epoch <= 6) & ~late], rows[(rows.epoch > 6) | late]]):
        state.absorb(spark.createDataFrame(part, SCHEMA), n)
    found = fold_series(spark.createDataFrame(rows, SCHEMA))
    assert pair_set(state.pairs()) == pair_set(found.pairs) == brute.fold(rows)
    names = [r.source_id for r in state.references().collect()]
    assert sorted(names) == sorted(r.object_id for r in found.references.collect())


def test_wide_radius_on_a_stream(spark):
    options = FoldOptions(radius_deg2=0.02**2)
    rows = [("x1", 1, 10.0, 5.0, 12.0), ("y1", 1, 200.0, -60.0, 12.0), ("x2", 2, 10.015, 5.0, 12.0), ("y2", 2, 200.0, -60.015, 12.0)]
    work = Workspace(spark, "test-wide")
    state = StreamFold(spark, f"{work.path}/state", options)
    for n in (0, 1):
        state.absorb(spark.createDataFrame(rows[2 * n : 2 * n + 2], SCHEMA), n)
    assert pair_set(state.pairs()) == {("x1", "x2"), ("y1", "y2")}


def test_keyed_state_refuses_the_global_clock(spark):
    rows = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        cell_fold(rows, FoldOptions(max_misses=3, miss_clock="global"))


def cell_clock(spark, rows):
    cells = tag_cells(spark.createDataFrame(rows, SCHEMA)).select("source_id", "epoch", "cell").toPandas()
    epochs = cells.groupby("cell")["epoch"].agg(set).to_dict()
    home = cells.set_index("source_id")["cell"].to_dict()
    return lambda r: epochs[home[r.source_id]]


def test_a_row_behind_the_frontier_is_late_by_itself(spark):
    rows = [("a", 5, 10.0, 5.0, 12.0), ("b", 6, 10.0, 5.0, 12.0), ("c", 2, 10.0, 5.0, 12.0)]
    work = Workspace(spark, "test-frontier")
    state = StreamFold(spark, f"{work.path}/state")
    for n, row in enumerate(rows):
        state.absorb(spark.createDataFrame([row], SCHEMA), n)
    assert pair_set(state.pairs()) == {("c", "a"), ("c", "b")}


@pytest.mark.parametrize("clock", ["cell", "global"])
def test_dropping_on_a_stream(spark, clock):
    """Waves, of which two bring late rows and late exposures, with and without compaction between."""
    rows = brute.random_sky(51, stars=25, epochs=24, seen=0.2, spread=0.05, jitter=3e-4)
    options = FoldOptions(max_misses=3, miss_clock=clock)
    counts = cell_clock(spark, rows) if clock == "cell" else None
    want = brute.fold(rows, max_misses=3, clock=counts)
    late = rows.epoch.isin([3, 9]) | ((rows.index % 11 == 0) & (rows.epoch < 12))
    parts = [rows[(rows.epoch <= 8) & ~late], rows[rows.epoch.between(9, 16) & ~late], rows[late], rows[rows.epoch > 16]]
    work = Workspace(spark, "test-stream-evict")
    state = StreamFold(spark, f"{work.path}/state", options, compact_every=2 if clock == "cell" else None)
    for n, part in enumerate(parts):
        state.absorb(spark.createDataFrame(part, SCHEMA), n)
    assert pair_set(state.pairs()) == want != brute.fold(rows)
    found = fold_series(spark.createDataFrame(rows, SCHEMA), options).references
    told = ["source_id", "epoch", "gone_epoch"]
    batch = found.withColumnRenamed("object_id", "source_id").select(*told).collect()
    assert sorted(state.references().select(*told).collect(), key=str) == sorted(batch, key=str)
    # A micro-batch that is run again changes nothing.
    state.absorb(spark.createDataFrame(parts[3], SCHEMA), 3)
    assert pair_set(state.pairs()) == want


TIMED = SCHEMA + ", obs_time timestamp"


@pytest.mark.parametrize("misses", [None, 3])
def test_rows_behind_the_watermark(spark, misses):
    """One exposure an hour; what is more than six hours behind is set aside, the rest is filled in, state leaves."""
    rows = brute.random_sky(52, stars=25, epochs=24, seen=0.3, spread=0.04, jitter=4e-4)
    rows["obs_time"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rows.epoch, unit="h")
    behind, late = rows.epoch.isin([2, 5]) & (rows.index % 2 == 0), rows.epoch.isin([10, 11, 13]) & (rows.index % 3 != 0)
    parts = [rows[(rows.epoch <= 8) & ~behind], rows[rows.epoch.between(9, 15) & ~late], rows[behind | late], rows[rows.epoch > 15]]
    options = FoldOptions(max_misses=misses, miss_clock="global")
    work = Workspace(spark, "test-watermark")
    state = StreamFold(spark, f"{work.path}/state", options, lateness="6 hours", compact_every=2)
    for n, part in enumerate(parts):
        state.absorb(spark.createDataFrame(part, TIMED), n)
    assert {r.source_id for r in state.too_late().collect()} == set(rows[behind].source_id)
    assert pair_set(state.pairs()) == brute.fold(rows[~behind], max_misses=misses) and state.pairs().count()
    held = state.stored("rows").select("epoch").distinct().collect()
    assert min(r.epoch for r in held) >= 24 - 15  # compacted rows are behind the watermark's five hours at most


def test_compaction_bounds_the_files(spark):
    rows = brute.random_sky(53, stars=8, epochs=12, spread=0.01)
    work = Workspace(spark, "test-compact")
    state = StreamFold(spark, f"{work.path}/state", compact_every=1)
    for n in range(6):
        state.absorb(spark.createDataFrame(rows[rows.epoch.between(2 * n + 1, 2 * n + 2)], SCHEMA), n)
        assert len(state.live_runs()[0]) == bin(n + 1).count("1")
    assert pair_set(state.pairs()) == brute.fold(rows)
    assert state.vacuum() > 0
    assert pair_set(state.pairs()) == brute.fold(rows)
    state.absorb(spark.createDataFrame([("new", 30, 10.0, 5.0, 12.0)], SCHEMA), 6)
    assert "new" in {r.source_id for r in state.references().collect()}


def test_keyed_state_with_dropping_across_borders(spark):
    """Cells covered in different epochs, copies on both sides of borders, sweeps between the batches."""
    rows = brute.random_sky(54, stars=60, epochs=24, seen=0.12, spread=0.09, jitter=1e-4)
    options = FoldOptions(max_misses=2, miss_clock="cell")
    want = brute.fold(rows, max_misses=2, clock=cell_clock(spark, rows))
    work = Workspace(spark, "test-keyed-borders")
    for stream in arrive(spark, rows, work, [range(1, 9), range(9, 17), range(17, 25)]):
        pairs = run_cell_fold(stream, f"{work.path}/out", f"{work.path}/checkpoint", options, sweep_minutes=0)
    assert pair_set(pairs) == want != brute.fold(rows)
    tagged = tag_cells(spark.createDataFrame(rows, SCHEMA))
    assert tagged.filter("size(border_cells) > 0").count() > 20


class Stored:
    """A map state of the keyed form, in a dictionary that counts what is read."""

    def __init__(self):
        self.data, self.reads = {}, 0

    def getValue(self, key):
        self.reads += 1
        return self.data.get(key)

    def updateValue(self, key, value):
        self.data[key] = value

    def removeKey(self, key):
        self.data.pop(key, None)

    def iterator(self):
        return iter(list(self.data.items()))

    def exists(self):
        return "frame" in self.data

    def update(self, value):
        self.data["frame"] = value

    def get(self):
        return self.data["frame"]


class Handle:
    def __init__(self):
        self.timers, self.states = [], {}

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Stored())

    getMapState = getValueState

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)


class Now:
    def getCurrentProcessingTimeInMs(self):
        return 0


def test_a_sweep_frees_what_cannot_match_again_and_batches_read_touched_squares_only():
    task = CellFold(FoldOptions(max_misses=2, miss_clock="cell"))
    handle = Handle()
    task.init(handle)

    def feed(epoch, stars, mag=12.0):
        columns = {"cell": 5, "home_cell": 5, "source_id": [f"s{s}_{epoch}" for s in stars], "epoch": epoch}
        batch = pd.DataFrame({**columns, "ra": [10 + 0.01 * s for s in stars], "dec": 5.0, "mag": mag})
        return list(task.handleInputRows((5,), iter([batch]), Now()))[0]

    feed(1, range(40))
    spots = handle.states["spots"]
    spots.reads = 0
    assert list(feed(2, [3])["object_id"]) == ["s3_1"] and spots.reads <= 4
    feed(3, [3])
    held = lambda: {r[0] for v in spots.data.values() for r in json.loads(v[0])}
    assert len(held()) == 40
    list(task.handleExpiredTimer((5,), Now(), None))
    assert held() == {"s3_1"} and json.loads(handle.states["clocks"].data[(5,)][0]) == [3]
    assert len(feed(4, [7])) == 0 and held() == {"s3_1", "s7_4"}  # found anew
    assert list(feed(5, [3])["object_id"]) == ["s3_1"]
    assert len(handle.timers) == 2


def test_clocks_of_a_cell_are_read_in_one_go():
    task = CellFold(FoldOptions(max_misses=2, miss_clock="cell"))
    handle = Handle()
    task.init(handle)
    for epoch in (1, 2):
        covered = {"cell": 5, "home_cell": range(1, 10), "source_id": None, "epoch": epoch, "ra": np.nan, "dec": np.nan, "mag": np.nan}
        row = {"cell": 5, "home_cell": 5, "source_id": f"s{epoch}", "epoch": epoch, "ra": 10.0, "dec": 5.0, "mag": 12.0}
        told = list(task.handleInputRows((5,), iter([pd.DataFrame(covered), pd.DataFrame([row])]), Now()))[0]
    assert told.values.tolist() == [["s1", 2, "s2"]] and str(told.dtypes["epoch"]) == "int32"
    clocks = handle.states["clocks"]
    assert len(clocks.data) == 9 and all(json.loads(v[0]) == [1, 2] for v in clocks.data.values())
    list(task.handleExpiredTimer((5,), Now(), None))
    assert clocks.reads == 0
