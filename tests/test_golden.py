"""A field whose pairs, objects and counts are known by construction, from files to series."""

import pytest
from pyspark.sql import functions as F

from starloom.functions.cells import with_sky_cell
from starloom.operators.crossmatch import STRATEGIES, crossmatch
from starloom.plans.fold import fold_rounds, fold_series
from starloom.plans.percell import fold_per_cell
from starloom.sources.ascii import scan_ascii_catalog

# Stars stand 18 arc seconds apart on a square over several cells; a detection lies less than 2 arc seconds from
# its star. Star k is seen in the epochs that its number names: in binary, bit e - 1 for epoch e.
SIDE, STEP, EPOCHS = 40, 0.005, 3
ARCSEC = 1 / 3600


def seen(star, epoch):
    return star >> (epoch - 1) & 1 == 1


def detections(epoch):
    """Star, right ascension and declination of the rows of a catalogue, in order."""
    for star in range(SIDE * SIDE):
        if seen(star, epoch):
            turn = (star * 7 + epoch * 5) % 4
            east, north = [(1.9, 0), (0, 1.9), (-1.9, 0), (0, -1.9)][turn]
            yield star, 120 + star % SIDE * STEP + east * ARCSEC, 3 + star // SIDE * STEP + north * ARCSEC


@pytest.fixture(scope="module")
def field(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("field")
    stars = {}
    for epoch in range(1, EPOCHS + 1):
        lines = [f"# obs. start time(UT) : 2020-01-0{epoch}T00:00:00.00"]
        for number, (star, ra, dec) in enumerate(detections(epoch)):
            values = ["0"] * 18
            values[11], values[12], values[16], values[17] = repr(ra), repr(dec), "12.5", "0.1"
            lines.append(" ".join(values))
            stars[f"000{epoch}_{number}"] = star, epoch
        (folder / f"f_000{epoch}.cat").write_text("\n".join(lines) + "\n")
    return scan_ascii_catalog(spark, str(folder), source_pattern=r"_(\d+)\.cat$").cache(), stars


def known_pairs(stars, first, second):
    at = {v: k for k, v in stars.items()}
    return {(i, at[star, second]) for i, (star, epoch) in stars.items() if epoch == first and (star, second) in at}


def test_the_field_spans_cells(field):
    rows, stars = field
    assert rows.count() == len(stars) == 2400
    assert with_sky_cell(rows, "cell", 10).select("cell").distinct().count() > 8


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_known_pairs(field, strategy):
    rows, stars = field
    first, second = (rows.filter(F.col("epoch") == e) for e in (1, 2))
    got = crossmatch(first, second, strategy=strategy).select("ref_source_id", "source_id").collect()
    assert len(got) == 400 and {tuple(r) for r in got} == known_pairs(stars, 1, 2)


@pytest.mark.parametrize("fold", [fold_series, fold_per_cell, fold_rounds])
def test_known_series(field, fold):
    rows, stars = field
    found = fold(rows)
    at, members = {}, set()
    for i, (star, epoch) in sorted(stars.items(), key=lambda s: s[1][1]):
        if star in at:
            members.add((at[star], epoch, i))
        at.setdefault(star, i)
    got = {(r.object_id, r.epoch, r.source_id) for r in found.pairs.collect()}
    assert got == members and len(members) == 1000
    objects = found.references.groupBy("epoch").count().collect()
    assert {r["epoch"]: r["count"] for r in objects} == {1: 800, 2: 400, 3: 200}
