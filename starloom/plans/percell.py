"""The epoch fold cell by cell: one shuffle brings a cell's whole history to a task.

A task sees the rows of its cells, many small ones at a time, and copies of foreign rows near their borders. It divides a cell's rows
into groups that cannot touch each other. A group of own rows only lies wholly in the cell, so
the task goes through its epochs once and settles it: founders, hits, misses, dropping and restarts,
and pairs. Groups with a foreign row stay open; they are few, and closed among themselves. They are
folded again by coarser cells, which hold most of them wholly, and in the end by one task as
long as it can hold what is left (``rows_per_task``). Only beyond that, and for cells too large for one task,
come the rounds of ``fold_rounds``, over the open rows alone. The outcome equals that of the
step-by-step fold, with dropping and without.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.cells import MatchGrid, cell_parent, with_sky_cell
from starloom.operators.groups import STAYS, Field, connected_groups, settle_groups
from starloom.operators.halo import halo_replicate, hot_keys, tag_cells
from starloom.plans.fold import FoldOptions, Series, fold_rounds, placed
from starloom.schema import CELL_ORDER, FINE_ORDER
from starloom.session import Workspace

FOUNDER, OPEN, PAIR, CLOSED = 0, 1, 2, 3
#: Coarser levels at which rows that stay open are tried again.
COARSER = (7, 4)
#: Epochs of a global clock that are sent to every task; a catalogue of more exposures goes through the rounds.
CLOCK_EPOCHS = 5_000_000

#: ``last_epoch`` is null for detections; references known before bring the epoch in which they were seen last.
SLIM = ["source_id", "epoch", "ra", "dec", "mag", "home", "last_epoch"]
DECIDED = (
    "kind int, object_id string, source_id string, epoch int, ra double, dec double, mag double, home long,"
    " last_epoch int, gone_epoch int"
)
_DECIDED = pa.schema(
    [("kind", pa.int32()), ("object_id", pa.string()), ("source_id", pa.string()), ("epoch", pa.int32())]
    + [(c, pa.float64()) for c in ("ra", "dec", "mag")]
    + [("home", pa.int64()), ("last_epoch", pa.int32()), ("gone_epoch", pa.int32())]
)
PAIRS_AT_ONCE = 500_000
#: Rows of small cells that a task settles at once.
ROWS_AT_ONCE = 100_000


def clocks_of(home: np.ndarray, epoch: np.ndarray) -> dict[int, np.ndarray]:
    """The epochs in which each home cell was covered, in order."""
    order = np.lexsort((epoch, home))
    home, epoch = home[order], epoch[order]
    new = np.append(True, (home[1:] != home[:-1]) | (epoch[1:] != epoch[:-1]))[: len(home)]
    home, epoch = home[new], epoch[new]
    cuts = np.flatnonzero(np.diff(home)) + 1
    return {int(h[0]): e for h, e in zip(np.split(home, cuts), np.split(epoch, cuts)) if len(h)}


def decide(rows: pa.Table, options: FoldOptions, shared_clock: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Founders and pairs of the groups that lie wholly in a cell, then its other own rows; for one or more whole cells, sorted by key."""

    def numbers(name: str, kind: str) -> np.ndarray:
        return rows.column(name).to_numpy().astype(kind)

    names, own = rows.column("source_id").combine_chunks(), numbers("own", "bool")
    named = np.asarray(names.is_valid())
    epoch, home, key = (numbers(c, "int64") for c in ("epoch", "home", "key"))
    if shared_clock is not None:
        clocks = {None: shared_clock}
    else:
        # Rows without a name say that a cell was covered; detections say it, too, known references do not.
        covers = own & ~np.asarray(rows.column("last_epoch").combine_chunks().is_valid())
        clocks = clocks_of(home[covers], epoch[covers])
    at = np.flatnonzero(named)
    ra, dec, mag = (numbers(c, "float64")[at] for c in ("ra", "dec", "mag"))
    names, own, epoch, home = names.take(pa.array(at)), own[at], epoch[at], home[at]
    last = pc.fill_null(rows.column("last_epoch").cast(pa.int64()), int(STAYS)).to_numpy()[at]
    field = Field(ra, dec, epoch, mag, home, clocks, options.radius_deg2, options.max_misses, options.mag_limit, last)
    group = connected_groups(ra, dec, options.radius_deg2, key[at])
    foreign = np.zeros(len(group) + 1, dtype=bool)
    foreign[group[~own]] = True
    whole = ~foreign[group]
    found = settle_groups(field, np.flatnonzero(whole), group)

    def told(kind: int, objects: pa.Array, at: np.ndarray, home: np.ndarray, gone: np.ndarray | None = None) -> pa.RecordBatch:
        places = [pa.array(c[at], mask=np.isnan(c[at]) | (kind == PAIR)) for c in (ra, dec, mag)]
        gone = np.full(len(at), STAYS) if gone is None else gone
        epochs = [pa.array(np.where(e == STAYS, 0, e).astype(np.int32), mask=e == STAYS) for e in (last[at], gone)]
        columns = [pa.array(np.full(len(at), kind, np.int32)), objects, names.take(pa.array(at)), pa.array(epoch[at].astype(np.int32))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, *places, pa.array(home), *epochs], _DECIDED)], schema=_DECIDED)

    new = last[found.founders] == STAYS
    shut = ~new & (found.gone != STAYS)
    for kind, some in ((FOUNDER, new), (CLOSED, shut)):
        founders = found.founders[some]
        yield told(kind, names.take(pa.array(founders)), founders, home[founders], found.gone[some])
    left = np.flatnonzero(own & ~whole)
    yield told(OPEN, pa.nulls(len(left), pa.string()), left, home[left])
    for low in range(0, len(found.pairs[0]), PAIRS_AT_ONCE):
        a, b = (p[low : low + PAIRS_AT_ONCE] for p in found.pairs)
        yield told(PAIR, names.take(pa.array(a)), b, home[a])


def settle(copies: DataFrame, options: FoldOptions, shared_clock: np.ndarray | None) -> DataFrame:
    """One pass: rows with ``key`` (the cell that sees them) and ``own`` to founders, pairs and open rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in whole_cells(batches):
            yield from decide(cells, options, shared_clock)

    return copies.select("key", "own", *SLIM).repartition("key").sortWithinPartitions("key").mapInArrow(run, DECIDED)


def whole_cells(batches: Iterator[pa.RecordBatch], rows_at_once: int = ROWS_AT_ONCE) -> Iterator[pa.Table]:
    """Tables of whole cells from rows sorted by ``key``: so many rows that small cells share the work, or one large cell."""
    held: list[pa.RecordBatch] = []
    count, enough = 0, rows_at_once
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < enough:
            continue
        rows = pa.Table.from_batches(held)
        keys = rows.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last cell may go on
        if cut:
            yield rows.slice(0, cut)
        held, count = rows.slice(cut).to_batches(), count - cut
        enough = max(rows_at_once, 2 * count)
    if count:
        yield pa.Table.from_batches(held)


def seen_by_cells(rows: DataFrame, order: int) -> DataFrame:
    """The rows and their copies for the neighbouring cells of a level."""
    fine = FINE_ORDER if order == CELL_ORDER else order + 3
    copies = halo_replicate(tag_cells(rows, order, fine))
    own = F.col("home_cell") == F.col("cell")
    return copies.withColumns({"key": F.col("cell"), "own": own}).select("key", "own", *SLIM)


def with_clock(rows: DataFrame, copies: DataFrame, order: int | None, clock: DataFrame) -> DataFrame:
    """Add the covered epochs of the rows' home cells to the cells that hold them, as rows without a name."""
    homes = clock.join(rows.select("home").distinct(), "home", "left_semi")
    key = F.lit(0).cast("long") if order is None else cell_parent("home", CELL_ORDER, order)
    empty = F.lit(None)
    named = {"source_id": empty.cast("string"), "last_epoch": empty.cast("int"), **{c: empty.cast("double") for c in ("ra", "dec", "mag")}}
    covered = homes.select(key.alias("key"), F.lit(True).alias("own"), "epoch", "home").withColumns(named)
    return copies.unionByName(covered.select("key", "own", *SLIM))


def fold_per_cell(
    observations: DataFrame,
    options: FoldOptions = FoldOptions(),
    workspace: Workspace | None = None,
    clock: DataFrame | None = None,
    known: DataFrame | None = None,
) -> Series:
    """Reference list and series. The rounds do it all where the radius is too wide for the border strip.

    ``known`` and ``clock`` are those of ``fold_rounds``.
    """
    if MatchGrid.for_radius(options.radius_deg2).fine_order < FINE_ORDER:
        return fold_rounds(observations, options, workspace, clock, known)
    work = workspace or Workspace(observations.sparkSession, "percell")
    mag = F.col("mag") if "mag" in observations.columns else F.lit(None).cast("double")
    slim = observations.select("source_id", F.col("epoch").cast("int").alias("epoch"), "ra", "dec", mag.alias("mag"))
    rows = with_sky_cell(slim.filter(placed()), "home", CELL_ORDER).withColumn("last_epoch", F.lit(None).cast("int"))
    if known is not None:
        rows = rows.unionByName(known.withColumn("home", F.col("cell")).select(*SLIM))
    rows = work.save(rows, "rows")
    shared_clock = needed = None
    if options.max_misses is not None:
        needed = None if clock is None else clock.select(F.col("cell").alias("home"), F.col("epoch").cast("int").alias("epoch"))
        if options.miss_clock == "global":
            epochs = work.save((rows if needed is None else needed).select("epoch").distinct(), "epochs")
            if epochs.count() > CLOCK_EPOCHS:
                return fold_rounds(observations, options, workspace, clock, known)
            shared_clock = np.sort(np.array([r.epoch for r in epochs.collect()], dtype=np.int64))
        elif clock is None:
            needed = work.save(rows.select("home", "epoch").distinct(), "clock")

    def one_pass(rows: DataFrame, order: int | None, name: str) -> tuple[DataFrame, DataFrame | None]:
        """What a pass tells, and the own rows of cells too large for a task (None: there is no such cell)."""
        large = None
        if order is None:
            copies = rows.withColumns({"key": F.lit(0).cast("long"), "own": F.lit(True)}).select("key", "own", *SLIM)
        else:
            copies = seen_by_cells(rows, order)
            hot = work.save(hot_keys(copies, "key", options.rows_per_task), f"{name}-hot")
            if not hot.isEmpty():
                large = copies.join(F.broadcast(hot), "key", "left_semi").filter("own").select(*SLIM)
                copies = copies.join(F.broadcast(hot), "key", "left_anti")
        if shared_clock is None and needed is not None and (order != CELL_ORDER or clock is not None):
            copies = with_clock(rows, copies, order, needed)  # else a cell's own rows are its clock
        return work.save(settle(copies, options, shared_clock), name), large

    parts: list[DataFrame] = []
    left, levels = rows, [CELL_ORDER, *COARSER]
    while True:
        order = levels.pop(0) if levels else None
        told, large = one_pass(left, order, f"decided-{len(parts)}")
        parts.append(told)
        left = told.filter(F.col("kind") == OPEN).select(*SLIM)
        if large is not None:
            # Open rows may touch those of the large cells, so they go on together.
            left = work.save(left.unionByName(large), "crowded")
        count = left.count()
        if not count or large is not None or not (levels or count <= options.rows_per_task):
            break
        if count <= options.rows_per_task:
            levels = []  # one task can hold the rest
    decided = parts[0]
    for more in parts[1:]:
        decided = decided.unionByName(more)
    founders = decided.filter(F.col("kind") == FOUNDER)
    references = founders.select("object_id", "epoch", "ra", "dec", "mag", F.col("home").alias("cell"), "gone_epoch")
    pairs = decided.filter(F.col("kind") == PAIR).select("object_id", "epoch", "source_id", F.col("home").alias("cell"))
    closed = decided.filter(F.col("kind") == CLOSED).select("object_id", "gone_epoch")
    if not count:
        return Series(references, pairs, 0, closed)
    # What no task could hold goes through the rounds.
    if needed is not None:
        needed = needed.withColumnRenamed("home", "cell")
    if shared_clock is not None:
        needed = epochs.select(F.lit(0).cast("long").alias("cell"), "epoch")
    held = None
    if known is not None:
        held = left.filter("last_epoch IS NOT NULL").withColumnRenamed("home", "cell")
        left = left.filter("last_epoch IS NULL")
    others = fold_rounds(left, options, Workspace(work.spark, "crowded"), needed, held)
    if others.closed is not None:
        closed = closed.unionByName(others.closed)
    return Series(references.unionByName(others.references), pairs.unionByName(others.placed), others.rounds, closed)
