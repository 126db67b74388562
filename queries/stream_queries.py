"""Streaming forms: the observations arrive in three waves of epochs."""

from pyspark.sql import functions as F

from queries import projections as P
from queries.registry import register
from queries import sql as S
from queries.series_queries import EVICT_CELL, EVICT_GLOBAL, FOLD, MISSES, PAIR_COLUMNS, SERIES
from starloom.plans.fold import FoldOptions
from starloom.schema import RADIUS_DEG2
from starloom.session import Workspace
from starloom.streaming.cell_state import run_cell_fold
from starloom.streaming.fold import StreamFold, run_stream

WAVES = ["epoch <= 10", "epoch BETWEEN 11 AND 20", "epoch > 20"]
LATE = (1, 12)  # epochs that arrive only with the last wave


def _slim(spark, sf_dir, rows=P.detections):
    return rows(spark, sf_dir).select("source_id", "epoch", "ra", "dec", "mag")


def _waves(rows, work):
    """The rows, stored once, and a condition for each wave."""
    stored = work.save(rows, "all")
    return stored, [F.expr(w) for w in WAVES]


@register("stream_fold", SERIES + f" SELECT {PAIR_COLUMNS} FROM p")
def stream_fold(spark, sf_dir):
    work = Workspace(spark, "stream-fold")
    rows, waves = _waves(_slim(spark, sf_dir), work)
    state = StreamFold(spark, f"{work.path}/state")
    for n, wave in enumerate(waves):
        rows.filter(wave).write.parquet(f"{work.path}/arrived/wave-{n}")
        run_stream(spark, f"{work.path}/arrived", rows.schema, state)
    return state.pairs()


@register("stream_late_backfill", SERIES + f" SELECT {PAIR_COLUMNS} FROM p")
def stream_late_backfill(spark, sf_dir):
    work = Workspace(spark, "stream-late")
    rows, waves = _waves(_slim(spark, sf_dir), work)
    state = StreamFold(spark, f"{work.path}/state")
    late = F.col("epoch").isin(*LATE)
    for n, wave in enumerate(waves):
        last = n == len(waves) - 1
        arrived = rows.filter((wave | late) if last else (wave & ~late))
        arrived.write.parquet(f"{work.path}/arrived/wave-{n}")
        run_stream(spark, f"{work.path}/arrived", rows.schema, state)
    return state.pairs()


def _cell_state(spark, sf_dir, rows, options, sweep_minutes=60.0):
    work = Workspace(spark, "stream-cells")
    stored, waves = _waves(_slim(spark, sf_dir, rows), work)
    pairs = None
    for n, wave in enumerate(waves):
        stored.filter(wave).write.parquet(f"{work.path}/arrived/wave-{n}")
        arriving = (
            spark.readStream.schema(stored.schema)
            .option("recursiveFileLookup", "true")
            .parquet(f"{work.path}/arrived")
        )
        pairs = run_cell_fold(
            arriving, f"{work.path}/out", f"{work.path}/checkpoint", options, sweep_minutes=sweep_minutes
        )
    return pairs


@register("stream_cell_state", SERIES + f" SELECT {PAIR_COLUMNS} FROM p")
def stream_cell_state(spark, sf_dir):
    return _cell_state(spark, sf_dir, P.detections, FoldOptions())


@register("stream_cell_evict", EVICT_CELL)
def stream_cell_evict(spark, sf_dir):
    """Keyed state with dropping, borders included; the timers sweep between the waves."""
    return _cell_state(spark, sf_dir, P.detections, FoldOptions(max_misses=MISSES), 0.0)


WIDE_DEG2 = 0.02**2  # a radius for which the join cells are coarser than level 10
WIDE = f"""WITH RECURSIVE {P.DETECTIONS}, obs AS (SELECT * FROM det),
{FOLD.replace(repr(RADIUS_DEG2), repr(WIDE_DEG2))},
p AS (SELECT a, b FROM objects a, obs b WHERE a.epoch < b.epoch AND {S.distance2('a', 'b')} < {WIDE_DEG2!r})"""


@register("stream_wide_radius", WIDE + f" SELECT {PAIR_COLUMNS} FROM p")
def stream_wide_radius(spark, sf_dir):
    """Three waves with a radius over a degree's fiftieth, one of them partly late."""
    work = Workspace(spark, "stream-wide")
    rows, waves = _waves(_slim(spark, sf_dir), work)
    state = StreamFold(spark, f"{work.path}/state", FoldOptions(radius_deg2=WIDE_DEG2))
    for n, wave in enumerate(waves):
        state.absorb(rows.filter(wave), n)
    return state.pairs()


def _evict(spark, sf_dir, name, clock):
    """Waves with dropping; the exposures of two epochs come only with the last."""
    work = Workspace(spark, name)
    rows, waves = _waves(_slim(spark, sf_dir), work)
    state = StreamFold(spark, f"{work.path}/state", FoldOptions(max_misses=MISSES, miss_clock=clock))
    late = F.col("epoch").isin(*LATE)
    for n, wave in enumerate(waves):
        state.absorb(rows.filter((wave | late) if n == len(waves) - 1 else (wave & ~late)), n)
    return state.pairs()


@register("stream_evict", EVICT_CELL)
def stream_evict(spark, sf_dir):
    return _evict(spark, sf_dir, "stream-evict", "cell")


@register("stream_evict_global", EVICT_GLOBAL)
def stream_evict_global(spark, sf_dir):
    return _evict(spark, sf_dir, "stream-evict-global", "global")


# Epochs 4 and 18 come with the last wave. After the second wave, up to day 20, the watermark lies at
# five days before the latest time seen: day 4 is too late, day 18 is not.
LATENESS, TOO_LATE, JUST_LATE = "5 days", 4, 18


@register(
    "stream_too_late",
    SERIES.replace("FROM det)", f"FROM det WHERE epoch <> {TOO_LATE})", 1)
    + f""" SELECT 'pair' AS kind, {PAIR_COLUMNS} FROM p
    UNION ALL SELECT 'too late', NULL, epoch, source_id FROM det WHERE epoch = {TOO_LATE}""",
)
def stream_too_late(spark, sf_dir):
    """Exposures behind the watermark are set aside, later ones are filled in."""
    work = Workspace(spark, "stream-too-late")
    rows = P.detections(spark, sf_dir).select("source_id", "epoch", "ra", "dec", "mag", "obs_time")
    rows, waves = _waves(rows, work)
    state = StreamFold(spark, f"{work.path}/state", lateness=LATENESS, compact_every=2)
    late = F.col("epoch").isin(TOO_LATE, JUST_LATE)
    for n, wave in enumerate(waves):
        arrived = rows.filter((wave | late) if n == len(waves) - 1 else (wave & ~late))
        arrived.write.parquet(f"{work.path}/arrived/wave-{n}")
        run_stream(spark, f"{work.path}/arrived", rows.schema, state)
    pairs = state.pairs().select(F.lit("pair").alias("kind"), "object_id", "epoch", "source_id")
    aside = state.too_late().select(F.lit("too late").alias("kind"), F.lit(None).cast("string").alias("object_id"), "epoch", "source_id")
    return pairs.unionByName(aside)


@register("stream_compacted", EVICT_CELL)
def stream_compacted(spark, sf_dir):
    """Four waves of eight epochs, merged after every second one, with a late exposure between."""
    work = Workspace(spark, "stream-compacted")
    rows = work.save(_slim(spark, sf_dir), "all")
    state = StreamFold(spark, f"{work.path}/state", FoldOptions(max_misses=MISSES), compact_every=2)
    late = F.col("epoch") == 7
    for n in range(4):
        wave = F.col("epoch").between(8 * n + 1, 8 * n + 8 if n < 3 else 10_000)
        state.absorb(rows.filter((wave & ~late) | (late if n == 2 else F.lit(False))), n)
    state.vacuum()
    return state.pairs()
