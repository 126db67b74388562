import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starloom.operators import groups
from starloom.operators.halo import tag_cells
from starloom.operators.pages import SeriesPages
from starloom.operators.series import assemble_series
from starloom.plans import fold, percell
from starloom.plans.fold import FoldOptions, fold_series, set_aside
from starloom.plans.percell import fold_per_cell
from starloom.schema import RADIUS_DEG2
from starloom.session import Workspace
from starloom.sources.obstext import series_lines
from tests import brute

# The fields lie across cell borders; the last one across RA 0.
FIELDS = [dict(seed=12, spread=0.05, stars=40), dict(seed=13, ra0=0.0, dec0=5.0, spread=0.01)]


def pair_set(df):
    rows = df.select("object_id", "source_id").collect()
    assert len(rows) == len(set(rows))
    return {(r[0], r[1]) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame(rows)


@pytest.mark.parametrize("plan", [fold_series, fold.fold_rounds])
@pytest.mark.parametrize("field", FIELDS)
def test_fold_equals_step_by_step(spark, field, plan):
    rows = brute.random_sky(**field)
    want = brute.fold(rows)
    found = plan(frame(spark, rows))
    assert want and pair_set(found.pairs) == want
    objects = {r[0] for r in found.references.select("object_id").collect()}
    assert objects == set(rows.source_id) - {b for _, b in want}


def test_hot_keys_in_the_fold(spark):
    rows = brute.random_sky(14, stars=6, epochs=40, seen=0.9, spread=0.002)
    found = fold.fold_rounds(frame(spark, rows), FoldOptions(rows_per_task=9))
    assert pair_set(found.pairs) == brute.fold(rows)


@pytest.mark.parametrize("limit", [2_000_000, 40])
def test_per_cell_fold_equals_step_by_step(spark, limit):
    """With the small limit most cells are too large and take the other way."""
    rows = brute.random_sky(15, spread=0.06, stars=60)
    found = fold_per_cell(frame(spark, rows), FoldOptions(rows_per_task=limit))
    assert pair_set(found.pairs) == brute.fold(rows)


def test_long_chain_across_cells(spark):
    """Each detection is in range of the next only, over several cells."""
    step = 0.0011
    links = [(f"c{i}", i + 1, 90.0, -74.0 + i * step, 15.0) for i in range(24)]
    rows = spark.createDataFrame(links, "source_id string, epoch int, ra double, dec double, mag double")
    want = {(f"c{i}", f"c{i + 1}") for i in range(0, 24, 2)}
    assert pair_set(fold_per_cell(rows).pairs) == want
    short = rows.filter("epoch <= 8")
    assert pair_set(fold.fold_rounds(short).pairs) == {p for p in want if int(p[1][1:]) < 8}


def test_eviction_global_clock(spark):
    rows = brute.random_sky(21, stars=20, epochs=40, seen=0.12, spread=0.03, jitter=2e-4)
    want = brute.fold(rows, max_misses=7)
    found = fold.fold_rounds(frame(spark, rows), FoldOptions(max_misses=7, miss_clock="global"))
    assert want != brute.fold(rows) and pair_set(found.pairs) == want


def test_eviction_cell_clock(spark):
    rows = brute.random_sky(23, stars=30, epochs=40, seen=0.12, spread=0.08, jitter=2e-4)
    cells = tag_cells(frame(spark, rows)).select("source_id", "epoch", "cell").toPandas()
    epochs = cells.groupby("cell")["epoch"].agg(set).to_dict()
    home = cells.set_index("source_id")["cell"].to_dict()
    want = brute.fold(rows, max_misses=3, clock=lambda r: epochs[home[r.source_id]])
    found = fold.fold_rounds(frame(spark, rows), FoldOptions(max_misses=3, miss_clock="cell"))
    assert pair_set(found.pairs) == want != brute.fold(rows, max_misses=3)


def test_per_cell_fold_with_a_wide_radius(spark):
    options = FoldOptions(radius_deg2=0.02**2)
    rows = [("a", 1, 90.0, -74.0, 12.0), ("b", 2, 90.0, -74.019, 12.0), ("c", 3, 90.0, -74.038, 12.0), ("d", 4, 90.03, -74.0, 12.0)]
    table = spark.createDataFrame(rows, "source_id string, epoch int, ra double, dec double, mag double")
    assert pair_set(fold_per_cell(table, options).pairs) == {("a", "b"), ("a", "d")}


def test_empty_input(spark):
    rows = spark.createDataFrame([], "source_id string, epoch int, ra double, dec double, mag double")
    assert fold_series(rows).pairs.count() == 0
    assert fold_per_cell(rows).pairs.count() == 0


def test_long_series_take_pages_in_time_order(spark):
    rows = [("a", e, f"a{e:02d}") for e in range(50)] + [("a", 7, f"x{k}") for k in range(25)]
    pairs = spark.createDataFrame(rows + [("b", 1, "b1"), ("b", 2, "b2")], "object_id string, epoch int, source_id string")
    got = {(r.object_id, r.part): r.detections for r in assemble_series(pairs, page=10).collect()}
    members = [i for _, _, i in sorted(rows, key=lambda r: r[1:])]
    want = {("a", k // 10): ",".join(members[k : k + 10]) for k in range(0, 75, 10)}
    assert got == {**want, ("b", 0): "b1,b2"}
    lines = [r.value for r in series_lines(assemble_series(pairs, page=40)).collect()]
    assert sorted(x.split(",")[0] for x in lines) == ["(a", "(a#1", "(b"]


@pytest.mark.parametrize("plan", [fold.fold_rounds, fold_per_cell])
def test_rows_without_a_position_are_set_aside(spark, plan):
    rows = [("a", 1, 10.0, 5.0, 12.0), ("b", 2, 10.0, 5.0, 12.0), ("c", 2, None, 5.0, 12.0), ("d", 2, 10.0, float("nan"), 12.0)]
    rows += [("e", None, 10.0, 5.0, 12.0), (None, 3, 10.0, 5.0, 12.0)]
    table = spark.createDataFrame(rows, "source_id string, epoch int, ra double, dec double, mag double")
    found = plan(table)
    assert [tuple(r) for r in found.pairs.collect()] == [("a", 2, "b")]
    assert [r.object_id for r in found.references.collect()] == ["a"]
    assert set_aside(table).count() == 4


def cell_clock(spark, rows):
    """The epochs in which the home cell of a row was covered."""
    cells = tag_cells(frame(spark, rows)).select("source_id", "epoch", "cell").toPandas()
    epochs = cells.groupby("cell")["epoch"].agg(set).to_dict()
    home = cells.set_index("source_id")["cell"].to_dict()
    return lambda r: epochs[home[r.source_id]]


@pytest.mark.parametrize("limit", [2_000_000, 60, 7])
@pytest.mark.parametrize("clock", ["cell", "global"])
def test_per_cell_fold_with_dropping(spark, monkeypatch, clock, limit):
    """Fields across borders; the smaller limits use the coarser cells, then the rounds for what no task can hold."""
    rows = brute.random_sky(41, stars=40, epochs=25, seen=0.2, spread=0.08, jitter=3e-4)
    options = FoldOptions(max_misses=3, miss_clock=clock, rows_per_task=limit)
    calls = []
    run = fold.Resolver.run
    monkeypatch.setattr(fold.Resolver, "run", lambda self, *a: calls.append(1) or run(self, *a))
    found = fold_per_cell(frame(spark, rows), options)
    counts = cell_clock(spark, rows) if clock == "cell" else None
    want = brute.fold(rows, max_misses=3, clock=counts)
    assert pair_set(found.pairs) == want != brute.fold(rows)
    assert bool(calls) == (limit == 7)
    by_rounds = fold.fold_rounds(frame(spark, rows), options).references.select(*sorted(found.references.columns))
    told = found.references.select(*sorted(found.references.columns))
    assert sorted(told.collect(), key=str) == sorted(by_rounds.collect(), key=str)


def test_most_objects_are_settled_in_their_cell(spark):
    rows = brute.random_sky(42, stars=60, epochs=20, seen=0.2, spread=0.08, jitter=1e-4)
    work = Workspace(spark, "test-percell")
    found = fold_per_cell(frame(spark, rows), FoldOptions(max_misses=3), work)
    told = spark.read.parquet(f"{work.path}/decided-0")
    assert told.filter("kind = 0").count() > 0.8 * found.references.count() > 0


def one_field(rows, clocks, max_misses=None):
    columns = (rows.ra.to_numpy(), rows.dec.to_numpy(), rows.epoch.to_numpy(), rows.mag.to_numpy())
    return groups.Field(*columns, np.zeros(len(rows), dtype=np.int64), clocks, RADIUS_DEG2, max_misses, 18.0)


@pytest.mark.parametrize("seed", range(12))
def test_groups_in_a_task(seed):
    """The kernel against the plain loop, on fields with dense spots, ties and a wrap of right ascension."""
    spot = dict(ra0=0.0, dec0=89.99, spread=0.003) if seed % 3 == 0 else dict(ra0=0.0, dec0=-30.0, spread=0.004 * (1 + seed))
    rows = brute.random_sky(100 + seed, stars=12, epochs=20, seen=0.3, jitter=[6e-4, 2e-4][seed % 2], **spot)
    again = rows.sample(frac=0.1, random_state=seed).assign(source_id=lambda r: r.source_id + "b")
    rows = pd.concat([rows, again], ignore_index=True).sample(frac=1.0, random_state=seed).reset_index(drop=True)
    for misses in (None, 3):
        field = one_field(rows, {None: np.unique(rows.epoch)}, misses)
        group = groups.connected_groups(field.ra, field.dec, RADIUS_DEG2)
        for a in range(len(rows)):
            for b in range(a):
                assert group[a] == group[b] or not brute.near(rows.loc[a], rows.loc[b])
        found = groups.settle_groups(field, np.arange(len(rows)), group)
        names = rows.source_id.to_numpy()
        want = brute.fold(rows, max_misses=misses)
        assert set(zip(names[found.pairs[0]], names[found.pairs[1]])) == want and len(found.pairs[0]) == len(want)
        assert len(set(found.founders)) == len(found.founders) == len(rows) - len({b for _, b in want})


def test_small_cells_share_the_work():
    """Cells come whole, many to a table, and detections of different cells stay apart."""
    keys = np.repeat(np.arange(50), np.arange(50) % 7 + 1).tolist() + [50] * 400 + [51] * 3
    batches = pa.table({"key": keys}).to_batches(max_chunksize=11)
    told = [t.column("key").to_pylist() for t in percell.whole_cells(iter(batches), 40)]
    assert sum(told, []) == keys and len(told) < 10
    assert sum(len(set(t)) for t in told) == 52
    assert groups.connected_groups(*(np.full(4, 5.0),) * 2, RADIUS_DEG2, np.array([1, 1, 2, 9])).tolist() in ([0, 0, 1, 2], [0, 0, 2, 3])


@pytest.mark.parametrize("misses", [None, 2])
def test_many_small_groups_are_settled_together(monkeypatch, misses):
    """Pairs of stars in hundreds of groups: the same as group by group, without a loop over the groups."""
    rng = np.random.default_rng(7)
    star = np.repeat(np.arange(600), 12)
    rows = pd.DataFrame({"ra": 10 + 0.1 * (star // 2) + rng.normal(0, 6e-4, len(star)), "dec": 5.0 + rng.normal(0, 6e-4, len(star)), "epoch": rng.integers(1, 12, len(star)), "mag": 15.0})
    field = one_field(rows, {None: np.arange(1, 12)}, misses)
    group = groups.connected_groups(field.ra, field.dec, RADIUS_DEG2)

    def settled():
        found = groups.settle_groups(field, np.arange(len(rows)), group)
        return set(zip(*(p.tolist() for p in found.pairs))), dict(zip(found.founders.tolist(), found.gone.tolist()))

    with monkeypatch.context() as alone:
        alone.setattr(groups, "MARCH_ROWS", 0)
        want = settled()
    monkeypatch.setattr(groups, "walk", None)
    assert settled() == want and len(want[1]) > 600


def test_many_epochs_of_one_cell_take_linear_time():
    def seconds(epochs):
        rng = np.random.default_rng(1)
        star = np.tile(np.arange(20), epochs)
        epoch = np.repeat(np.arange(epochs), 20)
        keep = rng.random(len(star)) < 0.3
        rows = pd.DataFrame({"ra": 10 + 0.0004 * star, "dec": 5.0 + rng.normal(0, 1e-4, len(star)), "epoch": epoch, "mag": 15.0})[keep]
        field = one_field(rows, {None: np.arange(epochs)}, 7)
        start = time.process_time()
        found = groups.settle_groups(field, np.arange(len(rows)), groups.connected_groups(field.ra, field.dec, RADIUS_DEG2))
        assert len(found.founders)
        return time.process_time() - start

    few, many = seconds(1000), seconds(10_000)
    assert many < 25 * few + 0.5


def test_series_pages_rewrite_last_pages_only(spark):
    rng = np.random.default_rng(3)
    rows = [(f"o{o}", e, f"o{o}-{e}-{k}") for o in range(12) for e in range(1, 25) for k in range(int(rng.integers(0, 3)))]
    rows += [("big", 5, f"b{k:03d}") for k in range(40)]
    pairs = spark.createDataFrame(rows, "object_id string, epoch int, source_id string")
    work = Workspace(spark, "test-pages")
    series = SeriesPages(spark, f"{work.path}/s", page=7)
    key = lambda df: sorted(tuple(r) for r in df.select("object_id", "part", "n_detections", "detections").collect())
    for step, (low, high) in enumerate([(1, 4), (5, 9), (10, 10), (11, 24)]):
        before = {(r.object_id, r.part): r.n_detections for r in series.pages().collect()}
        series.extend(pairs.filter(F.col("epoch").between(low, high)), step)
        written = spark.read.parquet(f"{work.path}/s/pages/step={step}").collect()
        assert all(before.get((r.object_id, r.part), 0) < 7 for r in written)
        assert key(series.pages()) == key(assemble_series(pairs.filter(F.col("epoch") <= high), page=7))
    series.extend(pairs.filter("epoch >= 11"), 3)  # run again
    assert key(series.pages()) == key(assemble_series(pairs, page=7))


def exchanges(df):
    """The shuffles of a plan, without those that bring a table to every task."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange SinglePartition" in line]


def test_rounds_move_references_only(spark):
    rows = brute.random_sky(43, stars=20, epochs=12, spread=0.03)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        work = Workspace(spark, "test-rounds")
        resolver = fold.Resolver(work, frame(spark, rows), FoldOptions())
        undecided = resolver.rows
        for number in (1, 2):
            assert exchanges(resolver.leaders(undecided)) == []
            leaders = work.save(resolver.leaders(undecided), f"leaders-{number}")
            references = work.save(resolver.with_gone_epoch(resolver.founders(leaders, undecided)), f"references-{number}")
            rest = resolver.uncovered(undecided, references)
            assert len(exchanges(rest)) == 1  # that of the references
            undecided = work.save_bucketed(rest, f"undecided-{number}", "_key", "_slot", dealt=True)
            assert len(exchanges(resolver.uncovered(undecided, references))) == 1
        assert pair_set(fold.fold_rounds(frame(spark, rows)).pairs) == brute.fold(rows)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
