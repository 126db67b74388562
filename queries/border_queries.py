"""Exchange, discard, directed match and backfill of border objects."""

from pyspark.sql import functions as F

from queries import projections as P
from queries import sql as S
from queries.registry import register
from starloom.operators import border as B
from starloom.operators import halo
from starloom.session import Workspace
from starloom.streaming.deliveries import BorderDeliveries

# New objects (the first detection of each star) against all detections.
TAGGED = f"WITH {P.DETECTIONS}, {S.border('det')}, found AS (SELECT * FROM tagged {P.FIRST_SEEN})"
ALL_PAIRS = TAGGED + f", {S.pairs('found', 'tagged', 'p')}"
# Pairs in which the object is delivered to the home cell of the detection.
SENT = """,
sent AS (SELECT a.source_id AS object_id, a.cell AS object_cell, a.epoch AS e1,
                b.epoch AS e2, b.source_id AS source_id, b.cell AS cell
         FROM p JOIN touch ON touch.source_id = p.a.source_id AND touch.border_cell = p.b.cell)"""
DELIVERED = ALL_PAIRS + SENT


def _rows(spark, sf_dir):
    slim = P.detections(spark, sf_dir).select("source_id", "epoch", "ra", "dec", "mag", "star", "event_id")
    return halo.tag_cells(slim)


def _tagged(spark, sf_dir):
    """Border objects and all detections."""
    rows = _rows(spark, sf_dir)
    return halo.on_border(P.first_seen(rows)), rows.drop("star", "event_id")


@register(
    "border_exchange",
    DELIVERED + " SELECT object_id, object_cell, e2 AS epoch, source_id, cell FROM sent WHERE e1 < e2",
)
def border_exchange(spark, sf_dir):
    return B.border_exchange(*_tagged(spark, sf_dir))


@register(
    "border_known",
    f"""{TAGGED}, local AS (SELECT * FROM tagged WHERE epoch = (SELECT min(epoch) FROM det)),
    {S.pairs('tagged', 'local', 'p')}{SENT}"""
    + """ SELECT DISTINCT object_id AS source_id, cell AS target_cell FROM sent""",
)
def border_known(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    first = F.broadcast(rows.agg(F.min("epoch").alias("first")))
    local = rows.join(first, F.col("epoch") == F.col("first"), "left_semi")
    return B.border_known(halo.on_border(rows), local)


@register(
    "border_directed_match",
    DELIVERED
    + """ SELECT object_id, cell AS target_cell, e2 AS epoch, source_id FROM sent s
    WHERE e2 > e1 AND NOT EXISTS (SELECT 1 FROM sent d WHERE d.object_id = s.object_id
                                  AND d.cell = s.cell AND d.e2 <= d.e1)""",
)
def border_directed_match(spark, sf_dir):
    return B.directed_match(*_tagged(spark, sf_dir))


DELAY = 8  # exposures of the target cell until a delivery has joined its reference list


BACKFILL = (
    DELIVERED
    + f""", covered AS (SELECT cell, list_sort(list(DISTINCT epoch)) AS epochs FROM tagged GROUP BY cell)
    SELECT object_id, cell AS target_cell, e2 AS epoch, source_id FROM sent JOIN covered USING (cell)
    WHERE e2 > e1 AND e2 < coalesce([x for x in epochs if x > e1][{DELAY}], 2147483647)"""
)


@register("border_backfill", BACKFILL)
def border_backfill(spark, sf_dir):
    objects, rows = _tagged(spark, sf_dir)
    return B.backfill(B.joining_epochs(objects, rows, DELAY), rows)


@register("stream_border_backfill", BACKFILL)
def stream_border_backfill(spark, sf_dir):
    """The same over waves of exposures: open deliveries are handed from one to the next."""
    work = Workspace(spark, "stream-border")
    objects, rows = (work.save(df, name) for df, name in zip(_tagged(spark, sf_dir), ("objects", "rows")))
    state = BorderDeliveries(spark, f"{work.path}/state", DELAY)
    for n, wave in enumerate(("epoch <= 6", "epoch BETWEEN 7 AND 14", "epoch BETWEEN 15 AND 22", "epoch > 22")):
        state.absorb(objects.filter(wave), rows.filter(wave), n)
    return state.pairs()
