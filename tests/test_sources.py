import pandas as pd
import pytest
from pyspark.sql import functions as F

from queries import projections as P
from queries import render
from starloom.operators.halo import tag_cells
from starloom.session import Workspace
from starloom.sources import ascii as A
from starloom.sources import fits, fits_source, obstext


def write_catalog(folder, name, started, rows):
    lines = [f"# obs. start time(UT) : {started}", "# exposure time(s)  : 30"]
    for i in range(rows):
        values = ["0.0"] * 38
        values[11], values[12], values[16], values[17] = str(10 + i / 1000), "5.5", "12.5", "0.1"
        lines.append("  ".join(values))
        if i == 7:
            lines.append("# a remark between the rows")
    (folder / name).write_text("\n".join(lines) + "\n")


def test_numbering_does_not_depend_on_splits(spark, tmp_path):
    write_catalog(tmp_path, "b_0002.cat", "2020-01-02T00:00:00.50", 300)
    write_catalog(tmp_path, "a_0003.cat", "2020-01-03T00:00:00.00", 120)
    write_catalog(tmp_path, "c_0001.cat", "2020-01-01T00:00:00.25", 5)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = {}
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = A.scan_ascii_catalog(spark, str(tmp_path), source_pattern=r"_(\d+)\.cat$")
            if size == "2k":
                assert df.rdd.getNumPartitions() >= 1
                splits = A.read_lines(spark, str(tmp_path)).select("file", "split_start").distinct()
                assert splits.count() > 10
            got[size] = df.select("epoch", "source_id", "ra").toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [
        (e, f"{s}_{i}", 10 + i / 1000)
        for e, s, n in [(1, "0001", 5), (2, "0002", 300), (3, "0003", 120)]
        for i in range(n)
    ]
    for df in got.values():
        assert sorted(df.itertuples(index=False, name=None)) == sorted(want)


@pytest.mark.parametrize("rows_per_range", [10, 500_000])
def test_fits_files_are_read_in_ranges(spark, tmp_path, rows_per_range):
    for name, started, n in [("f2.cat", "2020-01-02T01:02:03.500", 25), ("f1.cat", "2020-01-01T00:00:00.000", 3)]:
        rows = pd.DataFrame({"ra": [10 + i / 7 for i in range(n)], "dec": -1.5, "mag": 12.25, "magerr": 0.5})
        (tmp_path / name).write_bytes(render.fits_bytes(started, rows))
    df = fits.scan_fits_catalog(spark, f"file://{tmp_path}", rows_per_range=rows_per_range)
    got = df.orderBy("epoch", "row_no").collect()
    assert [(r.epoch, r.source_id) for r in got] == [(1, f"f1_{i}") for i in range(3)] + [
        (2, f"f2_{i}") for i in range(25)
    ]
    assert got[-1].ra == 10 + 24 / 7 and got[-1].mag == 12.25 and got[-1].dec == -1.5
    assert str(got[-1].obs_time) == "2020-01-02 01:02:03.500000"


def test_observation_text_round_trip(spark, sf_dir):
    folder = Workspace(spark, "test-text").path
    rows = tag_cells(P.detections(spark, sf_dir))
    obstext.write_observations(rows, folder)
    back = obstext.read_observations(spark, folder)
    columns = ["epoch", "source_id", "ra", "dec", "mag", "magerr", "cell", "border_cells", "obs_time"]
    assert rows.select(*columns).exceptAll(back.select(*columns)).count() == 0
    assert back.count() == rows.count()
    nine = obstext.read_observations(spark, folder, obstext.JOIN_FIELDS)
    assert nine.columns == columns


def test_table_scan_skips_other_cells(spark, sf_dir):
    folder = Workspace(spark, "test-table").path
    obstext.write_observation_table(tag_cells(P.detections(spark, sf_dir)), folder)
    one = spark.read.parquet(folder).select("coarse_cell").first()[0]
    plan = spark.read.parquet(folder).filter(F.col("coarse_cell") == one).select("source_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(coarse_cell" in text and "ReadSchema: struct<source_id:string>" in text


def test_ascii_dirty_files(spark, tmp_path):
    for folder in ("n1", "n2", "n3"):
        (tmp_path / folder).mkdir()
    write_catalog(tmp_path / "n1", "f.cat", "2020-01-02T00:00:00.50", 4)
    write_catalog(tmp_path / "n2", "f.cat", "2020-01-01T00:00:00.00", 3)
    write_catalog(tmp_path / "n3", "g.cat", "no time", 2)
    with open(tmp_path / "n1" / "f.cat", "a") as file:
        file.write("1 2 3\n" + "x " * 38 + "\n")
    rows = A.scan_ascii_catalog(spark, str(tmp_path)).collect()
    assert len(rows) == 9 and len({r.source_id for r in rows}) == 9
    assert {(r.epoch, r.file[-8:]) for r in rows} == {(1, "n2/f.cat"), (2, "n1/f.cat"), (3, "n3/g.cat")}
    assert {r.obs_time is None for r in rows if r.epoch == 3} == {True}
    assert [r.n_lines for r in A.bad_lines(spark, str(tmp_path)).collect()] == [2]


def test_fits_column_widths():
    cards = {"TFIELDS": "6", "TFORM1": "12X", "TFORM2": "1PE(9)", "TFORM3": "2M", "TFORM4": "E", "TFORM5": "3A", "TFORM6": "D"}
    offsets, kinds = fits._columns(cards)
    assert offsets == [0, 2, 10, 42, 46, 49] and kinds[3] == ">f4" and kinds[5] == ">f8"


def test_numbers_in_order_by_many_tasks(spark):
    from starloom.operators.numbering import number_in_order

    keys = [(k * 7919) % 5000 for k in range(3000)]
    df = spark.createDataFrame([(k, f"f{k}") for k in keys], "k int, name string").repartition(5)
    numbered = number_in_order(df, "no", "k")
    assert [r.k for r in numbered.orderBy("no").collect()] == sorted(keys)
    assert sorted(r.no for r in numbered.collect()) == list(range(1, 3001))
    assert number_in_order(df.limit(0), "no", "k").count() == 0
    plan = numbered._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_minimum_of_partitions(spark, tmp_path):
    from starloom.operators.halo import tag_cells

    rows = spark.createDataFrame([(1, f"s{k}", 10.0 + k, 5.0, 12.0, 0.1) for k in range(20)], "epoch int, source_id string, ra double, dec double, mag double, magerr double")
    rows = tag_cells(rows.withColumn("obs_time", F.lit("2024-01-01").cast("timestamp"))).coalesce(1)
    obstext.write_observations(rows, str(tmp_path / "t"))
    few, many = (obstext.read_observations(spark, str(tmp_path / "t"), obstext.JOIN_FIELDS, n) for n in (None, 9))
    assert few.rdd.getNumPartitions() < 9 <= many.rdd.getNumPartitions() and len(many.columns) == 9
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def fits_files(folder):
    rows = {}
    for name, started, n in [("f2.cat", "2020-01-02T01:02:03.500", 700), ("f1.cat", "2020-01-01T00:00:00.000", 3), ("f0.cat", "", 0)]:
        rows[name] = pd.DataFrame({"ra": [10 + i / 7 for i in range(n)], "dec": -1.5, "mag": 12.25, "magerr": 0.5})
        (folder / name).write_bytes(render.fits_bytes(started, rows[name]))
    (folder / "notes.txt").write_text("no catalogue")
    return {(name, i, ra) for name, r in rows.items() for i, ra in enumerate(r.ra)}


@pytest.mark.parametrize("size", [700, 2880, 1 << 27])
def test_fits_source_in_ranges_of_any_size(spark, tmp_path, size):
    want = fits_files(tmp_path)
    df = fits_source.read_fits(spark, str(tmp_path), "file", "row_no", "ra", glob="*.cat", bytes_per_range=size)
    got = [(r.file.rpartition("/")[2], r.row_no, r.ra) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    assert df.rdd.getNumPartitions() == 3 or size < 1 << 27


def test_small_ranges_share_tasks_and_headers(spark, tmp_path, monkeypatch):
    rows = pd.DataFrame({"ra": [10 + i / 7 for i in range(9000)], "dec": -1.5, "mag": 12.25, "magerr": 0.5})
    (tmp_path / "f1.cat").write_bytes(render.fits_bytes("2020-01-01T00:00:00.000", rows))
    df = fits_source.read_fits(spark, str(tmp_path), "row_no", "ra", bytes_per_range=1024)
    assert df.rdd.getNumPartitions() <= 200 and {(r.row_no, r.ra) for r in df.collect()} == set(enumerate(rows.ra))
    reader = fits_source.FitsReader(df.schema, {"path": str(tmp_path), "bytesperrange": "1024", "minpartitions": "5"})
    tasks = reader.partitions()
    assert 5 <= len(tasks) <= 7 and all(len(t.ranges) == 1 for t in tasks)
    headers = []
    monkeypatch.setattr(fits_source, "read_table_header", lambda h: headers.append(1) or fits.read_table_header(h))
    assert sum(b.num_rows for t in tasks for b in reader.read(t)) == 9000 and len(headers) == len(tasks)


def test_a_file_of_many_ranges_is_opened_once_per_batch(tmp_path, monkeypatch):
    rows = pd.DataFrame({"ra": [10 + i / 7 for i in range(700)], "dec": -1.5, "mag": 12.25, "magerr": 0.5})
    (tmp_path / "f1.cat").write_bytes(render.fits_bytes("2020-01-01T00:00:00.000", rows))
    path = f"file://{tmp_path}/f1.cat"
    header = next(fits._read_headers(iter([pd.DataFrame({"path": [path], "file": [path]})])))
    ranges = header.merge(pd.DataFrame({"first_row": range(0, 700, 10), "range_rows": 10}), how="cross")
    opened, open_file = [], fits.open_file
    monkeypatch.setattr(fits, "open_file", lambda p: opened.append(p) or open_file(p))
    told = pd.concat(fits._read_range(iter([ranges.sample(frac=1.0, random_state=1)])))
    assert list(zip(told.row_no, told.ra)) == list(enumerate(rows.ra)) and len(opened) == 1


def test_ranges_are_read_by_many_tasks(spark):
    rows = [(f"p{k}", 1000) for k in range(300)]
    ranges = fits.table_ranges(spark.createDataFrame(rows, "path string, n_rows bigint"), 100)
    tasks = ranges.withColumn("task", F.spark_partition_id())
    assert tasks.select("path", "task").distinct().count() == 300
    assert tasks.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_source_names(spark):
    paths = ["file:/a.cat/b_1.cat", "b.cat", "/x/.cat", "/x/y.txt", "/x/y.z.cat", "/x.cat/", None, "/x/a.cat\n"]
    df = spark.createDataFrame([(p,) for p in paths], "file string")
    got = df.select(A.source_name(), F.regexp_extract("file", A.SOURCE_PATTERN, 1)).collect()
    assert all(a == b for a, b in got) and got[0][0] == "b_1"


def test_fits_source_decodes_the_named_columns_only(spark, tmp_path):
    fits_files(tmp_path)
    df = fits_source.read_fits(spark, f"file://{tmp_path}", "mag", "started", glob="f*.cat")
    assert df.columns == ["mag", "started"] and df.filter("mag <> 12.25").count() == 0
    assert {r[0] for r in df.select("started").distinct().collect()} == {"2020-01-02T01:02:03.500", "2020-01-01T00:00:00.000"}
    reader = fits_source.FitsReader(df.schema, {"path": str(tmp_path), "pathglobfilter": "f*.cat"})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 703 and batches[0].schema.names == ["mag", "started"]
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("fits_catalog").schema("flux double").load(str(tmp_path)).collect()


def test_fits_source_of_an_empty_folder(spark, tmp_path):
    assert fits_source.read_fits(spark, str(tmp_path)).count() == 0


def test_headers_of_arriving_files_are_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = fits_files(tmp_path / "in")

    def run():
        arriving = fits_source.stream_fits(spark, str(tmp_path / "in"), "*.cat", rows_per_range=100)
        out = arriving.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint"))
        out.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).select("file", "row_no", "ra").collect()
        got = [(r.file.rpartition("/")[2], r.row_no, r.ra) for r in rows]
        assert len(got) == len(set(got))
        return set(got)

    assert run() == want
    more = pd.DataFrame({"ra": [float("nan"), 3.5], "dec": -1.5, "mag": 12.25, "magerr": 0.5})
    (tmp_path / "in" / "f3.cat").write_bytes(render.fits_bytes("2020-01-03T00:00:00.000", more))
    assert run() == want | {("f3.cat", 1, 3.5)}
