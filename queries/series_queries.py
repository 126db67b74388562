"""Fold, series, misses and eviction."""

from queries import projections as P
from queries import sql as S
from queries.registry import register
from starloom.operators import series as A
from starloom.operators.halo import tag_cells
from starloom.operators.pages import SeriesPages
from starloom.plans.fold import FoldOptions, fold_rounds, fold_series
from starloom.plans.percell import fold_per_cell
from starloom.schema import CELL_ORDER, MAG_LIMIT, RADIUS_DEG2
from starloom.session import Workspace

# The fold, epoch by epoch, as a recursive query over positions (no truth label).
FOLD = f"""
o AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY epoch) AS step FROM obs),
refs(upto, source_id, ra, dec, epoch, mag) AS (
  SELECT CAST(1 AS BIGINT), source_id, ra, dec, epoch, mag FROM o WHERE step = 1
  UNION ALL
  (WITH r AS MATERIALIZED (SELECT * FROM refs)
   SELECT upto + 1, source_id, ra, dec, epoch, mag FROM r WHERE upto < (SELECT max(step) FROM o)
   UNION ALL
   SELECT (SELECT max(upto) + 1 FROM r), v.source_id, v.ra, v.dec, v.epoch, v.mag FROM o v
   WHERE v.step = (SELECT max(upto) + 1 FROM r)
     AND NOT EXISTS (SELECT 1 FROM r WHERE {S.distance2('r', 'v')} < {S.RADIUS_DEG2!r}))),
objects AS (SELECT source_id AS object_id, ra, dec, epoch, mag FROM refs
            WHERE upto = (SELECT max(step) FROM o))"""
SERIES = f"WITH RECURSIVE {P.DETECTIONS}, obs AS (SELECT * FROM det), {FOLD}, {S.pairs('objects', 'obs', 'p', 'a.epoch < b.epoch')}"
PAIR_COLUMNS = "a.object_id AS object_id, b.epoch AS epoch, b.source_id AS source_id"


@register("series_fold", SERIES + f" SELECT {PAIR_COLUMNS} FROM p")
def series_fold(spark, sf_dir):
    """Round by round."""
    return fold_rounds(P.detections(spark, sf_dir)).pairs


@register("series_per_cell", SERIES + f" SELECT {PAIR_COLUMNS} FROM p")
def series_per_cell(spark, sf_dir):
    return fold_per_cell(P.detections(spark, sf_dir)).pairs


@register("epoch_references", SERIES + " SELECT object_id, epoch FROM objects")
def epoch_references(spark, sf_dir):
    return fold_series(P.detections(spark, sf_dir)).references.select("object_id", "epoch")


@register("series_fold_multi", SERIES + f" SELECT {PAIR_COLUMNS} FROM p")
def series_fold_multi(spark, sf_dir):
    """All rows through the per-cell fold and, for oversized cells, the rounds."""
    return fold_per_cell(P.detections(spark, sf_dir), FoldOptions(rows_per_task=500)).pairs


@register(
    "series_assemble",
    SERIES
    + """ SELECT object_id, part, count(*) AS n_detections,
    string_agg(source_id, ',' ORDER BY epoch, source_id) AS detections
    FROM (SELECT a.object_id AS object_id, b.epoch AS epoch, b.source_id AS source_id,
                 CAST((row_number() OVER (PARTITION BY a.object_id ORDER BY b.epoch, b.source_id) - 1) // 4 AS INTEGER) AS part
          FROM p) GROUP BY object_id, part""",
)
def series_assemble(spark, sf_dir):
    return A.assemble_series(fold_series(P.detections(spark, sf_dir)).pairs, page=4)


@register(
    "series_incremental",
    SERIES
    + """ SELECT object_id, part, count(*) AS n_detections,
    string_agg(source_id, ',' ORDER BY epoch, source_id) AS detections
    FROM (SELECT a.object_id AS object_id, b.epoch AS epoch, b.source_id AS source_id,
                 CAST((row_number() OVER (PARTITION BY a.object_id ORDER BY b.epoch, b.source_id) - 1) // 6 AS INTEGER) AS part
          FROM p) GROUP BY object_id, part""",
)
def series_incremental(spark, sf_dir):
    """The pairs of three stretches of epochs, one after the other."""
    work = Workspace(spark, "series-pages")
    pairs = work.save(fold_series(P.detections(spark, sf_dir)).pairs, "pairs")
    series = SeriesPages(spark, f"{work.path}/series", page=6)
    for step, part in enumerate(["epoch <= 9", "epoch BETWEEN 10 AND 17", "epoch > 17"]):
        series.extend(pairs.filter(part), step)
    return series.pages()


@register(
    "series_combined",
    SERIES
    + """ SELECT a.object_id AS object_id, 0 AS part, count(*) AS n_detections,
    string_agg(b.source_id, ',' ORDER BY b.epoch, b.source_id) AS detections FROM p GROUP BY ALL""",
)
def series_combined(spark, sf_dir):
    """The main result up to an epoch, combined with an overlapping later part."""
    pairs = fold_series(P.detections(spark, sf_dir)).pairs
    early, late = pairs.filter("epoch <= 20"), pairs.filter("epoch >= 10")
    return A.assemble_series(A.combine_series(early, late))


# Hits of each object (its own detection included) and the epochs a clock counts.
CELLS = f"""WITH RECURSIVE {P.DETECTIONS}, {S.cell('det', 'celled', CELL_ORDER)},
obs AS (SELECT * EXCLUDE (pix, face, px, py), pix AS cell FROM celled)"""
HITS = f"""{CELLS}, {FOLD}, {S.pairs('objects', 'obs', 'p', 'a.epoch < b.epoch')},
hits AS (
  SELECT h.object_id, h.epoch, o.cell,
         lag(h.epoch) OVER (PARTITION BY h.object_id ORDER BY h.epoch) AS previous
  FROM (SELECT a.object_id AS object_id, b.epoch AS epoch FROM p
        UNION SELECT object_id, epoch FROM objects) h JOIN obs o ON o.source_id = h.object_id),
clock AS (SELECT DISTINCT {{cell}} AS cell, epoch FROM obs)"""
GLOBAL, CELL = HITS.format(cell="0"), HITS.format(cell="cell")


def _gaps(base: str, cell: str) -> str:
    return f"""{base} SELECT h.object_id, h.epoch, CAST(count(c.epoch) AS INTEGER) AS misses
    FROM hits h LEFT JOIN clock c ON c.cell = {cell} AND c.epoch > h.previous AND c.epoch < h.epoch
    GROUP BY h.object_id, h.epoch"""


def _streak(base: str, cell: str) -> str:
    return f"""{base}, seen AS (SELECT object_id, cell, max(epoch) AS last_epoch FROM hits GROUP BY ALL)
    SELECT s.object_id, s.last_epoch, CAST(count(c.epoch) AS INTEGER) AS miss_streak
    FROM seen s LEFT JOIN clock c ON c.cell = {cell} AND c.epoch > s.last_epoch
    GROUP BY s.object_id, s.last_epoch"""


def _hits(observations):
    found = fold_series(observations)
    objects = found.references.select("object_id", "epoch", "mag", "cell")
    seen = found.pairs.join(objects.drop("epoch"), "object_id")
    return seen.select(*objects.columns).unionByName(objects).distinct()


def _miss_gaps(spark, sf_dir, clock):
    hits = _hits(P.detections(spark, sf_dir))
    rows = tag_cells(P.detections(spark, sf_dir)).select("cell", "epoch")
    return A.miss_gaps(hits, rows, clock).select("object_id", "epoch", "misses")


def _miss_streak(spark, sf_dir, clock):
    hits = _hits(P.detections(spark, sf_dir))
    rows = tag_cells(P.detections(spark, sf_dir)).select("cell", "epoch")
    return A.miss_streak(hits, rows, clock)


@register("miss_gaps", _gaps(GLOBAL, "0"))
def miss_gaps(spark, sf_dir):
    return _miss_gaps(spark, sf_dir, "global")


@register("miss_gaps_cell", _gaps(CELL, "h.cell"))
def miss_gaps_cell(spark, sf_dir):
    return _miss_gaps(spark, sf_dir, "cell")


@register("miss_streak", _streak(GLOBAL, "0"))
def miss_streak(spark, sf_dir):
    return _miss_streak(spark, sf_dir, "global")


@register("miss_streak_cell", _streak(CELL, "s.cell"))
def miss_streak_cell(spark, sf_dir):
    return _miss_streak(spark, sf_dir, "cell")


MISSES = 2  # missed epochs after which the queries below drop a bright object


def evicting(counts: str) -> str:
    """The fold with a miss counter, epoch by epoch; ``counts`` says whether the epoch is one of an object's clock."""
    return f"""{CELLS},
o AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY epoch) AS step FROM obs),
refs(upto, source_id, ra, dec, epoch, mag, cell, misses, gone) AS (
  SELECT CAST(1 AS BIGINT), source_id, ra, dec, epoch, mag, cell, 0, CAST(NULL AS BIGINT) FROM o WHERE step = 1
  UNION ALL
  (WITH r AS MATERIALIZED (SELECT * FROM refs),
   now AS MATERIALIZED (SELECT * FROM o WHERE step = (SELECT max(upto) + 1 FROM r)),
   met AS MATERIALIZED (SELECT r.source_id AS ref_id, v.source_id AS obs_id FROM r, now v
                        WHERE r.gone IS NULL AND {S.distance2('r', 'v')} < {RADIUS_DEG2!r}),
   told AS (SELECT *, CASE WHEN source_id IN (SELECT ref_id FROM met) THEN 0
                           WHEN {counts} THEN misses + 1 ELSE misses END AS missed FROM r)
   SELECT upto + 1, source_id, ra, dec, epoch, mag, cell, missed,
          CASE WHEN gone IS NULL AND mag < {MAG_LIMIT} AND missed >= {MISSES} THEN upto + 1 ELSE gone END
   FROM told WHERE upto < (SELECT max(step) FROM o)
   UNION ALL
   SELECT (SELECT max(upto) + 1 FROM r), source_id, ra, dec, epoch, mag, cell, 0, NULL
   FROM now WHERE source_id NOT IN (SELECT obs_id FROM met))),
objects AS (SELECT source_id AS object_id, ra, dec, epoch, gone FROM refs WHERE upto = (SELECT max(step) FROM o)),
{S.pairs('objects', 'o', 'p', 'a.epoch < b.epoch AND (a.gone IS NULL OR b.step < a.gone)')}
SELECT {PAIR_COLUMNS} FROM p"""


EVICT_GLOBAL, EVICT_CELL = evicting("true"), evicting("cell IN (SELECT cell FROM now)")


@register("evict_and_restart", EVICT_GLOBAL)
def evict_and_restart(spark, sf_dir):
    options = FoldOptions(max_misses=MISSES, miss_clock="global")
    return fold_rounds(P.detections(spark, sf_dir), options).pairs


@register("evict_cell_clock", EVICT_CELL)
def evict_cell_clock(spark, sf_dir):
    return fold_rounds(P.detections(spark, sf_dir), FoldOptions(max_misses=MISSES)).pairs


@register("per_cell_evict", EVICT_CELL)
def per_cell_evict(spark, sf_dir):
    return fold_per_cell(P.detections(spark, sf_dir), FoldOptions(max_misses=MISSES)).pairs
