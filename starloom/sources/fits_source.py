"""FITS catalogues as a Spark data source, and as a stream of arriving files.

``spark.read.format("fits_catalog").load(folder)`` gives the rows of all files. The driver lists names and
sizes only; every file is cut into byte ranges, and small ranges are dealt together, in order, so that a task has its
share of the bytes. A task reads the headers of each of its files once (a few blocks) and
decodes those table rows that begin in its ranges, ``BATCH_ROWS`` at a time. No header passes through the
driver, and a file of any size is shared by many tasks. The columns of a schema given to the reader are
the only ones decoded; a null or absent time stays null.

``stream_fits`` leaves it to Spark's file stream to remember which files have come, and reads each
file's headers once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from starloom.sources.ascii import readable
from starloom.sources.fits import DEC, MAG, MAGERR, RA, RANGES, ROWS, ROWS_PER_RANGE, TableHeader, _read_headers, _read_range
from starloom.sources.fits import open_file, read_table_header, table_layout, table_ranges

NAME = "fits_catalog"
SCHEMA = ROWS + ", started string"
VALUES = {"ra": RA, "dec": DEC, "mag": MAG, "magerr": MAGERR}
BYTES_PER_RANGE, BATCH_ROWS = 128 << 20, 65_536
#: Bytes of a task, unless there would be fewer tasks than ``minPartitions``; opening a file counts as so many bytes.
BYTES_PER_TASK, MIN_PARTITIONS, OPEN_BYTES = 128 << 20, 64, 64 << 10


@dataclass
class FileRange:
    """Bytes ``start`` to ``stop`` of a file."""

    path: str
    start: int
    stop: int


@dataclass
class TaskRanges(InputPartition):
    """What a task reads, a range or more of each of its files."""

    ranges: list[FileRange]


def dealt(ranges: list[FileRange], partitions: int) -> list[TaskRanges]:
    """Neighbouring ranges together, those of one file as one, up to a task's share of the bytes; a larger range has its own task."""
    weights = [r.stop - r.start + (OPEN_BYTES if not r.start else 0) for r in ranges]
    share = min(BYTES_PER_TASK, -(-sum(weights) // max(1, partitions)))
    tasks, held = [], 0
    for one, weight in zip(ranges, weights):
        if not tasks or held + weight > share:
            tasks.append(TaskRanges([]))
            held = 0
        held += weight
        mine = tasks[-1].ranges
        if mine and (mine[-1].path, mine[-1].stop) == (one.path, one.start):
            one = FileRange(one.path, mine.pop().start, one.stop)
        mine.append(one)
    return tasks


def list_files(folder: str, glob: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files below a folder whose names match, hidden ones left out."""
    uri = re.sub(r"^file:/+", "file:///", folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    system, inner = fs.FileSystem.from_uri(uri)
    scheme = uri[: len(uri) - len(inner)] if uri.endswith(inner) else uri.split("://")[0] + "://"
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    files = [f for f in found if f.is_file and fnmatch(f.base_name, glob) and f.base_name[0] not in "._"]
    return sorted((scheme + f.path, f.size) for f in files)


class FitsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = schema
        self.folder, self.glob = options["path"], options.get("pathglobfilter", "*")
        self.size = int(options.get("bytesperrange", BYTES_PER_RANGE))
        self.least = int(options.get("minpartitions", MIN_PARTITIONS))

    def partitions(self) -> list[TaskRanges]:
        ranges = []
        for path, size in list_files(self.folder, self.glob):
            ranges += [FileRange(path, at, min(size, at + self.size)) for at in range(0, size, self.size)]
        return dealt(ranges, self.least) or [TaskRanges([])]

    def read(self, partition: TaskRanges) -> Iterator[pa.RecordBatch]:
        for path, ranges in groupby(partition.ranges, lambda r: r.path):
            with open_file(path) as handle:
                header = read_table_header(handle)
                for one in ranges:
                    # A row belongs to the range in which its first byte lies.
                    first, last = (self.row_at(header, at) for at in (one.start, one.stop))
                    handle.seek(header.data_start + first * header.row_bytes)
                    for low in range(first, last, BATCH_ROWS):
                        count = min(BATCH_ROWS, last - low)
                        yield self.batch(path, header, low, handle.read(count * header.row_bytes))

    @staticmethod
    def row_at(header: TableHeader, byte: int) -> int:
        """The first row that begins at this byte or after it."""
        return min(header.n_rows, max(0, -((header.data_start - byte) // max(1, header.row_bytes))))

    def batch(self, path: str, header: TableHeader, low: int, data: bytes) -> pa.RecordBatch:
        used = {f.name: VALUES[f.name] for f in self.schema.fields if f.name in VALUES}
        rows = np.frombuffer(data, dtype=table_layout(header, used))
        started = f"{header.date_text.strip()}T{header.time_text.strip()}"
        made = {
            "file": lambda: pa.array([path] * len(rows)),
            "row_no": lambda: pa.array(np.arange(low, low + len(rows))),
            "started": lambda: pa.array([started if started != "T" else None] * len(rows), pa.string()),
        }
        kinds = to_arrow_schema(self.schema)
        columns = [
            pa.array(rows[f.name].astype(rows[f.name].dtype.newbyteorder("="))) if f.name in used else made[f.name]()
            for f in kinds
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds)], schema=kinds)


class FitsSource(DataSource):
    """``format("fits_catalog")``; options ``pathGlobFilter``, ``bytesPerRange`` and ``minPartitions``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FitsReader:
        unknown = set(schema.names) - {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"a catalogue has no columns {sorted(unknown)}")
        return FitsReader(schema, dict(self.options))


def read_fits(spark: SparkSession, folder: str, *columns: str, glob: str = "*", bytes_per_range: int = BYTES_PER_RANGE) -> DataFrame:
    """Rows of all catalogues below a folder; only these columns are decoded (all, if none is named)."""
    spark.dataSource.register(FitsSource)
    fields = dict(c.split() for c in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {fields[c]}" for c in columns or fields)
    reader = spark.read.format(NAME).schema(schema).option("pathGlobFilter", glob)
    partitions = max(MIN_PARTITIONS, 4 * spark.sparkContext.defaultParallelism)
    return reader.option("bytesPerRange", bytes_per_range).option("minPartitions", partitions).load(folder)


def stream_fits(spark: SparkSession, folder: str, glob: str = "*", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Detections of the catalogues that arrive in a folder, as a streaming DataFrame with ``obs_time``.

    Rows without a position keep their number but are left out. An epoch is not given: it is a number among all
    catalogues, which a stream does not know; ``obs_time`` tells the order.
    """
    arriving = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select("path", F.col("path").alias("file"))
    )
    headers = arriving.repartition("path").mapInPandas(_read_headers, RANGES)
    stamp = F.to_timestamp_ntz(F.concat_ws("T", F.trim("date_text"), F.trim("time_text")))
    ranges = table_ranges(headers, rows_per_range).withColumn("obs_time", stamp)
    rows = ranges.mapInPandas(_read_range, f"{ROWS}, obs_time timestamp_ntz")
    return rows.filter(readable())
