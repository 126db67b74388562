"""FITS catalogues: detections in a binary table.

Only names and sizes are listed first. One pass reads each file's headers and
turns the file into byte ranges of whole table rows; a second pass decodes the
ranges. A file of any size is thus shared by many tasks, and no task holds more
than one range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.session import Workspace
from starloom.sources.ascii import assign_epoch, detection_id, readable, unique_sources

# Fixed values of the format: block and card sizes, big-endian column types,
# and the places of the values used.
BLOCK, CARD = 2880, 80
COLUMN_TYPES = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S1"}
COLUMN_BYTES = {"L": 1, "B": 1, "I": 2, "J": 4, "K": 8, "E": 4, "D": 8, "A": 1, "C": 8, "M": 16, "P": 8, "Q": 16}
RA, DEC, MAG, MAGERR = 4, 5, 10, 11  # columns of the table in the third header unit
TIME_CARD, DATE_AT, TIME_AT = 52, slice(11, 21), slice(22, 35)
ROWS_PER_RANGE = 500_000
ROWS_AT_ONCE = 50_000  # rows of small ranges that are passed on as one frame
SOURCE_PATTERN = r"([^/]+)\.[^./]{3}$"  # the file name without its ending

RANGES = """path string, file string, date_text string, time_text string, data_start bigint,
    row_bytes int, n_rows bigint, offsets array<int>, kinds array<string>"""
ROWS = "file string, row_no bigint, ra double, dec double, mag float, magerr float"


def open_file(path: str):
    """An input file on whatever file system the path names."""
    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(inner)


def _header(handle) -> dict[str, str]:
    """Key-value cards of the header unit at the current place."""
    cards: dict[str, str] = {}
    while True:
        block = handle.read(BLOCK).decode("ascii")
        for at in range(0, BLOCK, CARD):
            card = block[at : at + CARD]
            if card[:8].strip() == "END":
                return cards
            if card[8:10] == "= ":
                cards[card[:8].strip()] = card[10:].split("/")[0].strip().strip("'").strip()


def _data_bytes(cards: dict[str, str]) -> int:
    axes = [int(cards[f"NAXIS{i + 1}"]) for i in range(int(cards.get("NAXIS", 0)))]
    size = int(np.prod(axes, dtype=np.int64)) * abs(int(cards.get("BITPIX", 8))) // 8 if axes else 0
    size += int(cards.get("PCOUNT", 0))
    return -(-size // BLOCK) * BLOCK


def _columns(cards: dict[str, str]) -> tuple[list[int], list[str]]:
    offsets, kinds, at = [], [], 0
    for i in range(int(cards["TFIELDS"])):
        count, kind = re.match(r"(\d*)([A-Z])", cards[f"TFORM{i + 1}"]).groups()
        count = int(count) if count else 1
        width = -(-count // 8) if kind == "X" else count * COLUMN_BYTES[kind]
        offsets.append(at)
        kinds.append(COLUMN_TYPES.get(kind, f"V{width}"))
        at += width
    return offsets, kinds


class TableHeader(NamedTuple):
    """When a catalogue was taken, and where its table lies."""

    date_text: str
    time_text: str
    data_start: int
    row_bytes: int
    n_rows: int
    offsets: list[int]
    kinds: list[str]


def read_table_header(handle) -> TableHeader:
    """The headers of a file, up to the first row of its table."""
    first = _header(handle)
    handle.seek(handle.tell() + _data_bytes(first))
    attributes = _header(handle)
    cards_start = handle.tell()
    handle.seek(cards_start + TIME_CARD * CARD)
    card = handle.read(CARD).decode("ascii")
    handle.seek(cards_start + _data_bytes(attributes))
    table = _header(handle)
    place = handle.tell(), int(table["NAXIS1"]), int(table["NAXIS2"])
    return TableHeader(card[DATE_AT], card[TIME_AT], *place, *_columns(table))


def table_layout(header, columns: dict[str, int]) -> np.dtype:
    """Rows of a table with these of its columns, by their places; ``header`` has offsets, kinds and row_bytes."""
    return np.dtype(
        {
            "names": list(columns),
            "formats": [header.kinds[i] for i in columns.values()],
            "offsets": [header.offsets[i] for i in columns.values()],
            "itemsize": header.row_bytes,
        }
    )


def _read_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, file in zip(batch["path"], batch["file"]):
            with open_file(path) as handle:
                rows.append((path, file, *read_table_header(handle)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RANGES.split(",")])


def _read_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the ranges; a file is opened once per batch, and small ranges are told together."""
    used = {"ra": RA, "dec": DEC, "mag": MAG, "magerr": MAGERR}
    for batch in batches:
        for path, ranges in batch.sort_values(["path", "first_row"]).groupby("path", sort=False):
            read: list[dict] = []
            held = 0
            with open_file(path) as handle:
                for r in ranges.itertuples():
                    handle.seek(r.data_start + r.first_row * r.row_bytes)
                    data = handle.read(r.range_rows * r.row_bytes)
                    rows = np.frombuffer(data, dtype=table_layout(r, used))
                    places = {c: rows[c].astype(rows[c].dtype.newbyteorder("=")) for c in used}
                    read.append({"row_no": np.arange(r.first_row, r.first_row + len(rows)), **places})
                    held += len(rows)
                    if held >= ROWS_AT_ONCE:
                        yield _told(r, read, "obs_time" in batch.columns)
                        read, held = [], 0
            if read:
                yield _told(r, read, "obs_time" in batch.columns)


def _told(header, read: list[dict], timed: bool) -> pd.DataFrame:
    """What was read of one file, as a frame."""
    columns = {c: np.concatenate([part[c] for part in read]) for c in read[0]}
    told = pd.DataFrame({"file": header.file, **columns})
    if timed:
        told["obs_time"] = pd.Series([header.obs_time] * len(told), dtype="datetime64[ns]")
    return told


def table_ranges(headers: DataFrame, rows_per_range: int) -> DataFrame:
    """The ranges of rows that are read by themselves, dealt out; neighbours of up to ``ROWS_PER_RANGE`` rows stay together."""
    ranges = headers.filter("n_rows > 0").select(
        "*",
        F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1, F.lit(rows_per_range))).alias("first_row"),
    )
    # A fixed number of partitions: ranges are few bytes, so adaptive coalescing would leave the reading to one task.
    tasks = int(headers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.withColumn(
        "range_rows", F.least(F.lit(rows_per_range), F.col("n_rows") - F.col("first_row"))
    ).repartition(tasks, "path", F.floor(F.col("first_row") / max(rows_per_range, ROWS_PER_RANGE)))


def scan_fits_catalog(
    spark: SparkSession,
    path: str,
    glob: str = "*",
    source_pattern: str = SOURCE_PATTERN,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """A directory of FITS catalogues as observations, one epoch per file.

    Rows without a position keep their number but are left out, as those of text catalogues.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", F.col("path").alias("file"))
    )
    # Stored, as both the ranges and the epochs need them: every header is read once.
    headers = Workspace(spark, "fits").save(files.repartition("path").mapInPandas(_read_headers, RANGES), "headers")
    ranges = table_ranges(headers, rows_per_range)
    stamp = F.to_timestamp_ntz(F.concat_ws("T", F.trim("date_text"), F.trim("time_text")))
    epochs = assign_epoch(headers.select("file", stamp.alias("obs_time")))
    return (
        ranges.mapInPandas(_read_range, ROWS)
        .filter(readable())
        .join(unique_sources(epochs, source_pattern), "file")
        .select(
            "epoch", detection_id().alias("source_id"), "ra", "dec", "mag", "magerr", "obs_time", "file", "row_no"
        )
    )
