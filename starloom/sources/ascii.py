"""ASCII catalogues: one text file per exposure, ``#`` lines first, then values.

Files are read with the splittable text source, so one huge file is shared by
many tasks. A detection's number within its file is then its number within its
split plus the rows of the splits before it; the second part comes from a
small aggregate, so that no file has to pass through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.operators.numbering import number_in_order
from starloom.session import Workspace

# Fixed values of the file format.
RA, DEC, MAG, MAGERR = 11, 12, 16, 17  # positions of the values used
TIME_LINE = "# obs"  # start of the header line with the observation time
TIME_PATTERN = r"(\d{4}-\d{2}-\d{2}T[0-9:.]+)"
SOURCE_PATTERN = r"([^/]+)\.cat$"  # the default source name: the file name without its ending


def read_lines(spark: SparkSession, path: str, glob: str = "*.cat") -> DataFrame:
    """Lines with the file and the split they come from."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split_start"),
            "value",
        )
    )


def parse_detections(lines: DataFrame) -> DataFrame:
    """Data lines as (ra, dec, mag, magerr); ``line_seq`` rises along each split.

    Values that are absent or no numbers are null.
    """
    values = F.split(F.trim("value"), r"\s+")
    used = {"ra": RA, "dec": DEC, "mag": MAG, "magerr": MAGERR}
    return lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        "file",
        "split_start",
        F.monotonically_increasing_id().alias("line_seq"),
        *[F.get(values, F.lit(at)).try_cast("double").alias(name) for name, at in used.items()],
    )


def readable() -> Column:
    """Data lines that hold a position."""
    return F.col("ra").isNotNull() & F.col("dec").isNotNull() & ~F.isnan("ra") & ~F.isnan("dec")


def bad_lines(spark: SparkSession, path: str, glob: str = "*.cat") -> DataFrame:
    """Files with data lines that a scan leaves out, and how many."""
    parsed = parse_detections(read_lines(spark, path, glob))
    return parsed.filter(~readable()).groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"))


def header_times(lines: DataFrame) -> DataFrame:
    """Observation start time of each file, taken from its header."""
    stamp = F.regexp_extract("value", TIME_PATTERN, 1)
    return (
        lines.filter(F.col("value").startswith(TIME_LINE))
        .groupBy("file")
        .agg(F.max(F.try_to_timestamp(stamp).cast("timestamp_ntz")).alias("obs_time"))
    )


def number_rows(detections: DataFrame) -> DataFrame:
    """Replace ``line_seq`` by ``row_no``, the place of the row in its file from 0.

    The parsed rows are stored first: both uses below then see the same splits.
    """
    detections = Workspace(detections.sparkSession, "parsed").save(detections, "rows")
    splits = detections.groupBy("file", "split_start").agg(
        F.min("line_seq").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = W.partitionBy("file").orderBy("split_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select(
        "file", "split_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        detections.join(offsets, ["file", "split_start"])
        .withColumn("row_no", F.col("line_seq") - F.col("_first") + F.col("_before"))
        .drop("split_start", "line_seq", "_first", "_before")
    )


def source_name(file: str = "file", pattern: str = SOURCE_PATTERN) -> Column:
    """Name of a catalogue, cut from the path of its file; the default pattern lies in the path's last part."""
    return F.regexp_extract(F.substring_index(file, "/", -1) if pattern == SOURCE_PATTERN else file, pattern, 1)


def detection_id(source: str = "source", number: str = "row_no") -> Column:
    return F.concat_ws("_", source, number)


def unique_sources(files: DataFrame, pattern: str = SOURCE_PATTERN) -> DataFrame:
    """Add ``source`` to a table of files; a name that is empty or taken twice gets a hash of the path."""
    named = files.withColumn("source", source_name("file", pattern))
    many = F.count(F.lit(1)).over(W.partitionBy("source"))
    mark = F.lower(F.hex(F.xxhash64("file")))
    own = F.when((F.col("source") == "") | (F.col("_many") > 1), F.concat_ws("-", "source", mark)).otherwise(F.col("source"))
    return named.withColumn("_many", many).withColumn("source", own).drop("_many")


def assign_epoch(files: DataFrame) -> DataFrame:
    """Number the catalogues by observation time, those without one last; ``files`` has one row per file."""
    return number_in_order(files, "epoch", F.col("obs_time").asc_nulls_last(), "file")


def scan_ascii_catalog(
    spark: SparkSession, path: str, glob: str = "*.cat", source_pattern: str = SOURCE_PATTERN
) -> DataFrame:
    """A directory of catalogues as observations, one epoch per file.

    A file without a time header comes after all others, with an empty time.
    Data lines without a position keep their number but are left out; ``bad_lines`` counts them.
    """
    lines = read_lines(spark, path, glob)
    rows = number_rows(parse_detections(lines))
    files = rows.select("file").distinct().join(header_times(lines), "file", "full")
    epochs = unique_sources(assign_epoch(files), source_pattern)
    return (
        rows.filter(readable())
        .join(epochs, "file")
        .select(
            "epoch",
            detection_id().alias("source_id"),
            "ra",
            "dec",
            "mag",
            "magerr",
            "obs_time",
            "file",
            "row_no",
        )
    )
