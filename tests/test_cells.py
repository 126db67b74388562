import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.functions.cells import MatchGrid, cell_neighbours, cell_parent, with_sky_cell
from starloom.operators.crossmatch import key_observations, key_reference
from starloom.operators.halo import tag_cells
from starloom.schema import RADIUS_DEG2


def sphere(spark, n):
    return spark.range(n).select(
        "id",
        (F.rand(1) * 360.0).alias("ra"),
        F.degrees(F.asin(F.rand(2) * 2.0 - 1.0)).alias("dec"),
    )


def test_cells_have_equal_area(spark):
    counts = with_sky_cell(sphere(spark, 200_000), "c", 3).groupBy("c").count().toPandas()
    assert sorted(counts["c"]) == list(range(768))
    expected = 200_000 / 768
    chi2 = ((counts["count"] - expected) ** 2 / expected).sum() / 767
    assert 0.8 < chi2 < 1.25


def test_parent_of_fine_cell(spark):
    both = with_sky_cell(with_sky_cell(sphere(spark, 20_000), "f", 13), "c", 10)
    assert both.filter(cell_parent("f", 13, 10) != F.col("c")).count() == 0


def test_neighbours_are_symmetric_with_24_gaps(spark):
    cells = spark.range(768).select("id", F.explode(cell_neighbours("id", 3)).alias("n")).toPandas()
    assert cells["n"].isna().sum() == 24
    cells = cells.dropna().astype(int)
    links = set(map(tuple, cells.to_numpy()))
    assert len(links) == len(cells)
    assert all((b, a) in links and a != b for a, b in links)


def test_null_position_and_poles(spark):
    rows = spark.createDataFrame(
        [(None, 1.0), (10.0, 90.0), (10.0, -90.0), (360.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (359.0, 0.0)],
        "ra double, dec double",
    )
    got = [r.c for r in with_sky_cell(rows, "c", 4).collect()]
    assert got[0] == -1
    assert got[1] // 256 in range(4) and got[2] // 256 in range(8, 12)
    assert got[3] == got[4] and got[5] == got[6]


@pytest.mark.parametrize("grid", [MatchGrid.for_radius(), MatchGrid(10, 13, 16)])
def test_copies_cover_every_partner_within_the_radius(spark, grid):
    """Partners at almost the full radius, all over the sky, with both caps and face corners."""
    rng = np.random.default_rng(3)
    n = 30_000
    dec = np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    dec[: n // 4] = rng.choice([-1, 1], n // 4) * (90 - rng.uniform(0.01, 2.0, n // 4))
    dec[n // 4 : n // 2] = rng.choice([-1, 0, 1], n // 4) * 41.8103 + rng.normal(0, 0.003, n // 4)
    ra = rng.uniform(0, 360, n)
    ra[: n // 2 : 2] = rng.choice([0, 45, 90, 135, 180, 225, 270, 315], n // 4) + rng.normal(0, 0.003, n // 4)
    way = rng.uniform(0, 2 * np.pi, n)
    r = RADIUS_DEG2**0.5 * 0.999
    dec2 = dec + r * np.sin(way)
    ra2 = (ra + r * np.cos(way) / np.cos(np.radians((dec + dec2) / 2))) % 360
    first = pd.DataFrame({"source_id": np.arange(n), "ra": ra % 360, "dec": dec})
    second = pd.DataFrame({"source_id": np.arange(n), "ra": ra2, "dec": dec2})
    left = key_reference(spark.createDataFrame(first), grid)
    right = key_observations(spark.createDataFrame(second), grid)
    met = left.join(
        right, (F.col("ref_source_id") == F.col("source_id")) & (left["_key"] == right["_key"])
    )
    assert met.count() == n


def test_filter_on_a_cell_keeps_the_plan_small(spark):
    rows = tag_cells(sphere(spark, 100).withColumnRenamed("id", "source_id"))
    plan = rows.filter(F.size("border_cells") > 0).filter("cell > 5")
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_levels_are_checked(spark):
    with pytest.raises(ValueError):
        MatchGrid(14, 13, 16)
    with pytest.raises(ValueError):
        MatchGrid(13, 14, 16).check_radius(1.0)
    assert MatchGrid.for_radius(RADIUS_DEG2) == MatchGrid(13, 14, 16)
