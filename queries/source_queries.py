"""Scans and sinks, on files that Spark writes from the given tables."""

from pyspark.sql import functions as F

from queries import projections as P
from queries import render
from queries import sql as S
from queries.registry import register
from queries.series_queries import SERIES
from starloom.operators import crossmatch as X
from starloom.operators import halo
from starloom.operators.series import assemble_series
from starloom.plans.fold import fold_series
from starloom.session import Workspace
from starloom.sources import ascii as A
from starloom.sources import fits, fits_source, obstext

WRITTEN = f"WITH {P.DETECTIONS}, {render.CATALOGUES}"
IN_FOLDER = r"catalog=([^/]+)/"  # the rendered files carry the name in their folder


def _time_text():
    return F.date_format("obs_time", "yyyy-MM-dd'T'HH:mm:ss.SS").alias("started")


def _ascii(spark, sf_dir):
    folder = Workspace(spark, "ascii").path
    render.write_ascii(P.detections(spark, sf_dir), folder)
    return folder


@register(
    "scan_ascii_catalog",
    WRITTEN + " SELECT no AS epoch, det_id AS source_id, ra, dec, mag, magerr, started FROM written",
)
def scan_ascii(spark, sf_dir):
    rows = A.scan_ascii_catalog(spark, _ascii(spark, sf_dir), "*.txt", IN_FOLDER)
    return rows.select("epoch", "source_id", "ra", "dec", "mag", "magerr", _time_text())


@register("catalog_header", WRITTEN + " SELECT catalog, started FROM file")
def catalog_header(spark, sf_dir):
    times = A.header_times(A.read_lines(spark, _ascii(spark, sf_dir), "*.txt"))
    return times.select(A.source_name("file", IN_FOLDER).alias("catalog"), _time_text())


@register("assign_epoch", WRITTEN + " SELECT catalog, started, no AS epoch FROM filed")
def assign_epoch(spark, sf_dir):
    times = A.header_times(A.read_lines(spark, _ascii(spark, sf_dir), "*.txt"))
    return A.assign_epoch(times).select(
        A.source_name("file", IN_FOLDER).alias("catalog"), _time_text(), "epoch"
    )


@register(
    "source_from_filename",
    WRITTEN + " SELECT catalog AS source, count(*) AS n_rows FROM written GROUP BY catalog",
)
def source_from_filename(spark, sf_dir):
    lines = A.read_lines(spark, _ascii(spark, sf_dir), "*.txt")
    named = A.parse_detections(lines).withColumn("source", A.source_name("file", IN_FOLDER))
    return named.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))


@register("detection_id", WRITTEN + " SELECT det_id AS source_id, ra, dec FROM written")
def detection_id(spark, sf_dir):
    lines = A.read_lines(spark, _ascii(spark, sf_dir), "*.txt")
    numbered = A.number_rows(A.parse_detections(lines))
    named = numbered.withColumn("source", A.source_name("file", IN_FOLDER))
    return named.select(A.detection_id().alias("source_id"), "ra", "dec")


@register(
    "scan_fits_catalog",
    WRITTEN
    + """ SELECT no AS epoch, det_id AS source_id, ra, dec, CAST(mag AS FLOAT) AS mag,
    CAST(magerr AS FLOAT) AS magerr, started FROM written""",
)
def scan_fits(spark, sf_dir):
    folder = Workspace(spark, "fits").path
    render.write_fits(P.detections(spark, sf_dir), folder)
    rows = fits.scan_fits_catalog(spark, folder, "*.cat", rows_per_range=100)
    return rows.select("epoch", "source_id", "ra", "dec", "mag", "magerr", _time_text())


@register(
    "read_fits_source",
    WRITTEN + """ SELECT catalog, no_in_file AS row_no, ra, dec, started FROM (
    SELECT *, row_number() OVER (PARTITION BY catalog ORDER BY event_id) - 1 AS no_in_file FROM written)""",
)
def read_fits_source(spark, sf_dir):
    """The files as a data source in ranges of 8 KB; magnitudes are not decoded."""
    folder = Workspace(spark, "fits-source").path
    render.write_fits(P.detections(spark, sf_dir), folder)
    rows = fits_source.read_fits(spark, folder, "file", "row_no", "ra", "dec", "started", glob="*.cat", bytes_per_range=8192)
    started = F.substring(F.regexp_replace("started", r"\s+", "T"), 1, 22).alias("started")
    return rows.select(A.source_name("file").alias("catalog"), "row_no", "ra", "dec", started)


@register(
    "stream_fits_source",
    WRITTEN + " SELECT det_id AS source_id, ra, dec, CAST(mag AS FLOAT) AS mag, started FROM written",
)
def stream_fits_source(spark, sf_dir):
    """Catalogues that arrive in two waves, read by a stream that goes on where it stopped."""
    work = Workspace(spark, "fits-stream")
    rows = work.save(P.detections(spark, sf_dir), "rows")
    for wave in ("epoch <= 15", "epoch > 15"):
        render.write_fits(rows.filter(wave), f"{work.path}/arrived")
        arriving = fits_source.stream_fits(spark, f"{work.path}/arrived", "*.cat", rows_per_range=100)
        named = arriving.withColumn("source", A.source_name("file")).withColumn("source_id", A.detection_id())
        started = F.date_format("obs_time", "yyyy-MM-dd'T'HH:mm:ss.SS").alias("started")
        writer = named.select("source_id", "ra", "dec", "mag", started).writeStream.format("parquet")
        writer = writer.option("checkpointLocation", f"{work.path}/checkpoint").trigger(availableNow=True)
        writer.start(f"{work.path}/out").awaitTermination()
    return spark.read.parquet(f"{work.path}/out")


TAGGED = f"WITH {P.DETECTIONS}, {S.border('det')}"
TOUCHING = """(SELECT coalesce(string_agg(border_cell, ',' ORDER BY border_cell), '')
    FROM touch WHERE touch.source_id = tagged.source_id)"""


def _touching():
    """The foreign cells in order of their number."""
    return F.array_join(F.array_sort("border_cells").cast("array<string>"), ",").alias("touching")



def _text(spark, sf_dir):
    folder = Workspace(spark, "text").path
    obstext.write_observations(halo.tag_cells(P.detections(spark, sf_dir)), folder)
    return folder


@register(
    "scan_obs_text",
    TAGGED
    + f""" SELECT epoch, source_id, ra, dec, mag, magerr, cell, {TOUCHING} AS touching,
    strftime(obs_time, '%Y-%m-%dT%H:%M:%S.%f') AS obs_time, 0 AS miss_streak FROM tagged""",
)
def scan_obs_text(spark, sf_dir):
    rows = obstext.read_observations(spark, _text(spark, sf_dir))
    return rows.select(
        "epoch",
        "source_id",
        "ra",
        "dec",
        "mag",
        "magerr",
        "cell",
        _touching(),
        F.date_format("obs_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("obs_time"),
        "miss_streak",
    )


@register(
    "sink_obs_text",
    TAGGED
    + """, listed AS (SELECT source_id, string_agg(border_cell, ',' ORDER BY border_cell) AS cells FROM touch GROUP BY source_id)
    SELECT epoch, source_id, ra, dec, mag, magerr, cell, coalesce(cells, '-') AS neighbours,
           strftime(obs_time, '%Y-%m-%dT%H:%M:%S') AS obs_time, '0' AS match_state, 0 AS miss_streak, 11 AS n_fields
    FROM tagged LEFT JOIN listed USING (source_id)""",
)
def sink_obs_text(spark, sf_dir):
    """All eleven fields of the written lines; neighbours in order of their number."""
    part = F.split("value", " ")
    neighbours = F.array_join(F.array_sort(F.split(part[7], ",").cast("array<bigint>")).cast("array<string>"), ",")
    return spark.read.text(_text(spark, sf_dir)).select(
        part[0].cast("int").alias("epoch"),
        part[1].alias("source_id"),
        *[part[n].cast("double").alias(c) for n, c in enumerate(("ra", "dec", "mag", "magerr"), 2)],
        part[6].cast("long").alias("cell"),
        F.when(part[7] == "-", "-").otherwise(neighbours).alias("neighbours"),
        F.substring_index(part[8], ".", 1).alias("obs_time"),
        part[9].alias("match_state"),
        part[10].cast("int").alias("miss_streak"),
        F.size(part).alias("n_fields"),
    )


@register(
    "sink_observation_table",
    TAGGED + f""" SELECT CAST(cell // 4096 AS INTEGER) AS coarse_cell, cell, epoch, source_id, ra, dec, mag, magerr,
    {TOUCHING} AS touching FROM tagged""",
)
def sink_observation_table(spark, sf_dir):
    folder = Workspace(spark, "table").path
    obstext.write_observation_table(halo.tag_cells(P.detections(spark, sf_dir)), folder)
    columns = ["coarse_cell", "cell", "epoch", "source_id", "ra", "dec", "mag", "magerr"]
    return spark.read.parquet(folder).select(*columns, _touching())


@register(
    "sink_series_text",
    SERIES
    + """ SELECT '(' || a.object_id || ',' || string_agg(b.source_id, ',' ORDER BY b.epoch, b.source_id)
    || ')' AS value FROM p GROUP BY a.object_id""",
)
def sink_series_text(spark, sf_dir):
    folder = Workspace(spark, "series-text").path
    obstext.write_series(assemble_series(fold_series(P.detections(spark, sf_dir)).pairs), folder)
    return spark.read.text(folder)


@register(
    "sink_pairs_text",
    f"""WITH {P.DETECTIONS}, found AS (SELECT * FROM det {P.FIRST_SEEN}),
    {S.pairs('found', 'det', 'p', 'a.epoch < b.epoch')}
    SELECT '[' || a.source_id || ',' || b.source_id || ']' AS value FROM p""",
)
def sink_pairs_text(spark, sf_dir):
    """A reference list against all detections: both read from the nine-column text form, written as pairs."""
    folder = Workspace(spark, "pairs-text")
    found = P.first_seen(P.detections(spark, sf_dir))
    obstext.write_observations(halo.tag_cells(found), f"{folder.path}/found")
    obstext.write_observations(halo.tag_cells(P.detections(spark, sf_dir)), f"{folder.path}/in")
    found, rows = (
        obstext.read_observations(spark, f"{folder.path}/{part}", obstext.JOIN_FIELDS) for part in ("found", "in")
    )
    matched = X.crossmatch(found, rows, extra=F.col("ref_epoch") < F.col("epoch"))
    obstext.write_pairs(matched, f"{folder.path}/out", "ref_source_id", "source_id")
    return spark.read.text(f"{folder.path}/out")
