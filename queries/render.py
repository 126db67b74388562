"""Writes the given tables as catalogue files, so that the sources have something to scan.

A catalogue is an epoch and a block of 50,000 event numbers, which bounds the
rows of a file whatever the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 50_000

CATALOGUES = """
cat AS (
  SELECT *, printf('field_%04d_%05d', epoch, event_id // 50000) AS catalog FROM det),
file AS (
  SELECT catalog, left(strftime(min(obs_time), '%Y-%m-%dT%H:%M:%S.%f'), 22) AS started
  FROM cat GROUP BY catalog),
filed AS (
  SELECT catalog, started, CAST(row_number() OVER (ORDER BY started, catalog) AS INTEGER) AS no
  FROM file),
written AS (
  SELECT cat.*, f.started, f.no,
         catalog || '_' || (row_number() OVER (PARTITION BY catalog ORDER BY event_id) - 1) AS det_id
  FROM cat JOIN filed f USING (catalog))"""


def by_catalogue(detections: DataFrame) -> DataFrame:
    block = F.floor(F.col("event_id") / BLOCK_ROWS)
    return detections.withColumn(
        "catalog", F.format_string("field_%04d_%05d", F.col("epoch"), block)
    )


def _started(rows: DataFrame) -> DataFrame:
    text = F.date_format(F.min("obs_time"), "yyyy-MM-dd'T'HH:mm:ss.SS")
    return rows.groupBy("catalog").agg(text.alias("started"))


def write_ascii(detections: DataFrame, path: str) -> None:
    """Catalogues of 38 values per line below ``path/catalog=<name>/``."""
    rows = by_catalogue(detections)
    at = {11: F.col("ra"), 12: F.col("dec"), 16: F.col("mag"), 17: F.col("magerr")}
    values = [at[i].cast("string") if i in at else F.lit("0.00") for i in range(38)]
    data = rows.select("catalog", F.col("event_id").alias("at"), F.concat_ws("  ", *values).alias("value"))
    head = _started(rows).select(
        "catalog",
        F.posexplode(
            F.array(
                F.concat(F.lit("# obs. start time(UT) : "), "started"),
                F.lit("# exposure time(s)  : 30"),
                F.lit("#   1 XWIN_IMAGE   Windowed position estimate along x   [pixel]"),
            )
        ).alias("at", "value"),
    )
    lines = head.withColumn("at", F.col("at").cast("bigint") - 3).unionByName(data)
    (
        lines.repartition("catalog")
        .sortWithinPartitions("catalog", "at")
        .drop("at")
        .write.partitionBy("catalog")
        .mode("overwrite")
        .text(path)
    )


def _cards(**values) -> bytes:
    text = "".join(f"{k:<8}= {v!s:>20}".ljust(80) for k, v in values.items()) + "END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880).encode("ascii")


def _pad(data: bytes) -> bytes:
    return data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def fits_bytes(started: str, rows: pd.DataFrame) -> bytes:
    """A file of three header units: empty, header cards, and a table of twelve columns."""
    cards = ["COMMENT".ljust(80)] * 60
    cards[52] = ("DATE-OBS= '" + started.replace("T", " ")).ljust(80)
    card_bytes = "".join(cards).encode("ascii")
    kinds = ["J"] + ["E"] * 3 + ["D", "D"] + ["E"] * 6
    width = {"J": 4, "E": 4, "D": 8}
    table = np.zeros(
        len(rows), dtype=[(f"c{i}", {"J": ">i4", "E": ">f4", "D": ">f8"}[k]) for i, k in enumerate(kinds)]
    )
    for i, name in {4: "ra", 5: "dec", 10: "mag", 11: "magerr"}.items():
        table[f"c{i}"] = rows[name].to_numpy()
    unit = {"XTENSION": "'BINTABLE'", "BITPIX": 8, "NAXIS": 2}
    return (
        _cards(SIMPLE="T", BITPIX=8, NAXIS=0, EXTEND="T")
        + _cards(**unit, NAXIS1=len(card_bytes), NAXIS2=1, PCOUNT=0, GCOUNT=1, TFIELDS=1,
                 TFORM1=f"'{len(card_bytes)}A'")
        + _pad(card_bytes)
        + _cards(**unit, NAXIS1=sum(width[k] for k in kinds), NAXIS2=len(rows), PCOUNT=0, GCOUNT=1,
                 TFIELDS=len(kinds), **{f"TFORM{i + 1}": f"'1{k}'" for i, k in enumerate(kinds)})
        + _pad(table.tobytes())
    )


def write_fits(detections: DataFrame, path: str) -> None:
    """One FITS file per catalogue, written by the tasks to the shared folder."""
    target = path if "://" in path else f"file://{path}"

    def one_file(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id")
        name = rows["catalog"].iloc[0]
        system, inner = fs.FileSystem.from_uri(f"{target}/{name}.cat")
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inner) as out:
            out.write(fits_bytes(rows["started"].iloc[0], rows))
        return pd.DataFrame({"catalog": [name]})

    rows = by_catalogue(detections)
    started = F.date_format(F.min("obs_time"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    begun = rows.groupBy("catalog").agg(started.alias("started"))
    rows.join(begun, "catalog").select(
        "catalog", "started", "event_id", "ra", "dec", "mag", "magerr"
    ).groupBy("catalog").applyInPandas(one_file, "catalog string").write.format("noop").mode(
        "overwrite"
    ).save()
