"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.session import Workspace

__all__ = [
    "Workspace",
    "fresh_names",
    "gram_hashes",
    "map_batches",
    "repeat_ranges",
    "shuffle_width",
    "table",
    "text_bytes",
    "text_column",
    "word_bounds",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as keep it apart from the columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_column(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column; tasks in Python then need not decode what they only scan."""
    return text_column(name).cast("binary").alias(name)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its owner sizes with the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word of words joined by one space."""
    if not joined:
        none = np.empty(0, dtype=np.int64)
        return none, none
    spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    return np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(joined)]))


def gram_hashes(
    joined: bytes, starts: np.ndarray, ends: np.ndarray, size: int, digest: Callable[[bytes], int], step: int = 1
) -> np.ndarray:
    """The 64-bit ``digest`` of every ``step``-th run of ``size`` words."""
    count = max(0, len(starts) - size + 1)
    first, last = starts[:count:step].tolist(), ends[size - 1 :: step].tolist()
    return np.fromiter((digest(joined[a:b]) for a, b in zip(first, last)), dtype=np.uint64, count=len(first))


def repeat_ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[k] .. first[k] + count[k] - 1 of all k, one after the other."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(first - (ends - count), count)
