"""Deliveries handed from micro-batch to micro-batch give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from starloom.operators import border as B
from starloom.operators import halo
from starloom.session import Workspace
from starloom.streaming.deliveries import BorderDeliveries

SCHEMA = "source_id string, epoch int, ra double, dec double, mag double"


@pytest.fixture(scope="module")
def sky(spark):
    """Detections of stars on a line over several borders; every third of the first epochs counts as a new object."""
    rng = random.Random(5)
    rows = [
        (f"{epoch}_{star}", epoch, 30 + star * 0.0004, 10 + star * 0.0001 + rng.uniform(-0.0005, 0.0005), 12.0)
        for epoch in range(1, 13)
        for star in range(600)
        if rng.random() < 0.8
    ]
    work = Workspace(spark, "test-deliveries")
    tagged = work.save(halo.tag_cells(spark.createDataFrame(rows, SCHEMA)), "rows")
    found = tagged.filter((F.col("epoch") <= 6) & (F.pmod(F.xxhash64("source_id"), F.lit(3)) == 0))
    return work.save(halo.on_border(found), "objects"), tagged


def pairs(df):
    rows = [tuple(r) for r in df.select("object_id", "target_cell", "epoch", "source_id").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("delay, waves", [(1, [3, 99]), (2, [1, 2, 3, 99]), (5, [3, 6, 9, 99]), (40, [6, 99])])
def test_waves_give_the_batch_result(spark, sky, delay, waves):
    objects, rows = sky
    state = BorderDeliveries(spark, Workspace(spark, "test-deliveries").path, delay)
    below = 0
    for n, upto in enumerate(waves):
        wave = F.col("epoch").between(below + 1, upto)
        state.absorb(objects.filter(wave), rows.filter(wave), n)
        below = upto
    want = pairs(B.backfill(B.joining_epochs(objects, rows, delay), rows))
    assert pairs(state.pairs()) == want and (want or delay == 1)
    still = state.open_deliveries()
    never = B.joining_epochs(objects, rows, delay).filter(F.col("to_epoch") == B.NEVER)
    covered = rows.select("cell").distinct().withColumnRenamed("cell", "target_cell")
    assert still.join(covered, "target_cell", "left_semi").count() == never.count()


def test_a_repeated_step_and_empty_ones(spark, sky):
    objects, rows = sky
    state = BorderDeliveries(spark, Workspace(spark, "test-deliveries").path, 4)
    first, later = F.col("epoch") <= 6, F.col("epoch") > 6
    none = F.lit(False)
    state.absorb(objects.filter(none), rows.filter(none), 0)
    state.absorb(objects.filter(first), rows.filter(first), 1)
    state.absorb(objects.filter(later), rows.filter(later), 2)
    state.absorb(objects.filter(later), rows.filter(later), 2)
    assert pairs(state.pairs()) == pairs(B.backfill(B.joining_epochs(objects, rows, 4), rows))
