import pytest
from pyspark.sql import functions as F

from starloom.functions.separation import register_sql_functions
from starloom.operators import crossmatch as X
from starloom.operators.crossmatch import crossmatch, nearest_only
from tests import brute

PLACES = [(90.0, -74.0), (0.0, 10.0), (359.9999, -41.8103), (45.0, 89.5), (200.0, 0.0)]


def ids(df):
    return {(r[0], r[1]) for r in df.select("ref_source_id", "source_id").collect()}


@pytest.mark.parametrize("place", PLACES)
def test_equals_brute_force(spark, place):
    left = brute.random_sky(1, stars=12, epochs=6, ra0=place[0], dec0=place[1], spread=0.004)
    right = brute.random_sky(2, stars=12, epochs=6, ra0=place[0], dec0=place[1], spread=0.004)
    got = crossmatch(spark.createDataFrame(left), spark.createDataFrame(right))
    want = brute.pairs(left, right)
    assert want and ids(got) == want and got.count() == len(want)


def test_strategies_agree_and_plan_as_asked(spark):
    rows = brute.random_sky(5, spread=0.01)
    left = spark.createDataFrame(rows[rows.epoch <= 15])
    right = spark.createDataFrame(rows[rows.epoch > 15])
    want = ids(crossmatch(left, right))
    for strategy, node in [
        ("broadcast", "BroadcastHashJoin"),
        ("shuffle_hash", "ShuffledHashJoin"),
        ("merge", "SortMergeJoin"),
    ]:
        df = crossmatch(left, right, strategy=strategy)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert node in plan and "NestedLoop" not in plan and "Cartesian" not in plan
        assert ids(df) == want
    # too many rows to broadcast: the same result another way
    beyond = crossmatch(left, right, strategy="broadcast", broadcast_rows=10)
    assert "SortMergeJoin" in beyond._jdf.queryExecution().executedPlan().toString()
    assert ids(beyond) == want


def test_hot_cells_are_split_without_changing_the_result(spark):
    rows = brute.random_sky(6, stars=3, epochs=60, seen=0.9, spread=0.001)
    left = spark.createDataFrame(rows[rows.epoch <= 20])
    right = spark.createDataFrame(rows[rows.epoch > 20])
    whole = crossmatch(left, right)
    split = crossmatch(left, right, rows_per_task=7, strategy="shuffle_hash")
    assert whole.count() == split.count() and ids(whole) == ids(split)


def test_semi_anti_and_nearest(spark):
    rows = brute.random_sky(7, stars=20, spread=0.01)
    left = spark.createDataFrame(rows[rows.epoch <= 3])
    right = spark.createDataFrame(rows[rows.epoch > 3])
    pairs = crossmatch(left, right)
    matched = {b for _, b in ids(pairs)}
    semi = {r.source_id for r in crossmatch(left, right, how="left_semi").collect()}
    anti = {r.source_id for r in crossmatch(left, right, how="left_anti").collect()}
    assert semi == matched and anti and not anti & semi
    assert semi | anti == set(rows[rows.epoch > 3].source_id)
    one = nearest_only(pairs).select("ref_source_id", "source_id").collect()
    assert len(one) == len(matched) and {(r[0], r[1]) for r in one} <= ids(pairs)


def test_sql_functions(spark):
    register_sql_functions(spark)
    row = spark.sql(
        "SELECT separation2(359.9999, 10, 0.0001, 10) d, within_radius(10, 20, 10, 20.0011) a,"
        " within_radius(10, 20, 10, 20.0012) b"
    ).first()
    assert abs(row.d - (0.0002 * 0.984807753) ** 2) < 1e-15 and row.a and not row.b


def test_unknown_strategy(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.0)], "source_id string, epoch int, ra double, dec double")
    with pytest.raises(ValueError):
        crossmatch(df, df, strategy="loop")
    assert crossmatch(df, df).select(F.col("source_id")).count() == 1


def test_cells_crowded_on_either_side_are_split(spark):
    """One spot holds most of both lists: every pair once, and no join key with more than its share of either side."""
    crowd = [(f"a{k}", 1, 10.0 + (k % 20) * 1e-4, 5.0) for k in range(300)]
    sparse = [(f"b{k}", 2, 20.0 + k, 5.0) for k in range(20)]
    schema = "source_id string, epoch int, ra double, dec double"
    reference = spark.createDataFrame(crowd + sparse, schema)
    observations = spark.createDataFrame([(f"o{i}", e, r, d) for i, e, r, d in crowd[:200] + sparse], schema)
    got = X.crossmatch(reference, observations, strategy="merge", rows_per_task=40).select("ref_source_id", "source_id").collect()
    want = X.crossmatch(reference, observations, strategy="merge").select("ref_source_id", "source_id").collect()
    assert len(got) == len(set(got)) and set(got) == set(want) and len(got) > 200 * 100
    grid = X.MatchGrid.for_radius()
    left, right = X.key_observations(observations, grid), X.key_reference(reference, grid)
    sides = X.spread_reference(*X.spread(left, right, 40), 40, right)
    for side in sides:
        sizes = [r["count"] for r in side.groupBy("_key", "_slot", "_part").count().collect()]
        assert max(sizes) < 100
    kept = X.crossmatch(reference, observations, how="left_anti", strategy="merge", rows_per_task=40)
    assert kept.count() == 0
