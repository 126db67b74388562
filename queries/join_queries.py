"""Separation, radius and cross-match queries."""

from pyspark.sql import functions as F

from queries import projections as P
from queries import sql as S
from queries.registry import register
from starloom.functions.separation import register_sql_functions, separation2
from starloom.operators import crossmatch as X

HALF = 15  # the stars seen up to this epoch form the reference list of the two-table joins


def _halves(spark, sf_dir):
    rows = P.detections(spark, sf_dir)
    slim = rows.select("source_id", "epoch", "ra", "dec", "star", "event_id")
    return P.first_seen(slim.filter(F.col("epoch") <= HALF)), slim.filter(F.col("epoch") > HALF)


HALVES = f"""{P.DETECTIONS},
t1 AS (SELECT * FROM det WHERE epoch <= {HALF} {P.FIRST_SEEN}), t2 AS (SELECT * FROM det WHERE epoch > {HALF})"""
MATCH_SQL = f"""WITH {HALVES}, {S.pairs('t1', 't2', 'p')}
SELECT a.source_id AS id1, b.source_id AS id2 FROM p"""


def _match(spark, sf_dir, strategy):
    t1, t2 = _halves(spark, sf_dir)
    return X.crossmatch(t1, t2, strategy=strategy).select(
        F.col("ref_source_id").alias("id1"), F.col("source_id").alias("id2")
    )


@register("crossmatch_broadcast", MATCH_SQL)
def crossmatch_broadcast(spark, sf_dir):
    return _match(spark, sf_dir, "broadcast")


@register("crossmatch_shuffle_hash", MATCH_SQL)
def crossmatch_shuffle_hash(spark, sf_dir):
    return _match(spark, sf_dir, "shuffle_hash")


@register("crossmatch_merge", MATCH_SQL)
def crossmatch_merge(spark, sf_dir):
    return _match(spark, sf_dir, "merge")


ALL_SQL = f"""WITH {P.DETECTIONS}, {S.pairs('det', 'det', 'p', 'a.epoch < b.epoch')}
SELECT a.source_id AS id1, b.source_id AS id2 FROM p"""


@register("crossmatch_adaptive", ALL_SQL)
def crossmatch_adaptive(spark, sf_dir):
    """All rows against all later ones, cells split by both sides wherever one holds more than a few rows."""
    rows = P.detections(spark, sf_dir).select("source_id", "epoch", "ra", "dec")
    later = F.col("epoch") > F.col("ref_epoch")
    pairs = X.crossmatch(rows, rows, strategy="merge", extra=later, rows_per_task=10)
    return pairs.select(F.col("ref_source_id").alias("id1"), F.col("source_id").alias("id2"))


SEED = f"""{P.DETECTIONS},
t1 AS (SELECT * FROM det WHERE epoch = (SELECT min(epoch) FROM det)),
t2 AS (SELECT * FROM det WHERE epoch > (SELECT min(epoch) FROM det))"""


def _seed(spark, sf_dir):
    rows = P.detections(spark, sf_dir).select("source_id", "epoch", "ra", "dec")
    first = F.broadcast(rows.agg(F.min("epoch").alias("first")))
    return (
        rows.join(first, F.col("epoch") == F.col("first"), "left_semi"),
        rows.join(first, F.col("epoch") == F.col("first"), "left_anti"),
    )


@register(
    "sky_separation",
    f"""WITH {HALVES}, {S.pairs('t1', 't2', 'p')}
    SELECT a.source_id AS id1, b.source_id AS id2,
           round(sqrt({S.distance2('a', 'b')}) * CAST(3600 AS DOUBLE), 6) AS arcsec FROM p""",
)
def sky_separation(spark, sf_dir):
    t1, t2 = _halves(spark, sf_dir)
    pairs = X.crossmatch(t1, t2)
    arcsec = F.sqrt(separation2("ref_ra", "ref_dec", "ra", "dec")) * 3600.0
    return pairs.select(
        F.col("ref_source_id").alias("id1"),
        F.col("source_id").alias("id2"),
        F.round(arcsec, 6).alias("arcsec"),
    )


@register(
    "match_radius",
    f"""WITH {HALVES}, {S.pairs('t1', 't2', 'p')}
    SELECT a.source_id AS id1, count(*) AS n_matches FROM p GROUP BY ALL""",
)
def match_radius(spark, sf_dir):
    """The same join written in SQL on the match views and the SQL functions."""
    register_sql_functions(spark)
    X.create_match_views(*_halves(spark, sf_dir), reference_view="seen", observation_view="later")
    return spark.sql(
        """SELECT r.ref_source_id AS id1, count(*) AS n_matches
        FROM seen r JOIN later o
          ON r.match_cell = o.match_cell AND r.match_slot = o.match_slot
         AND within_radius(r.ref_ra, r.ref_dec, o.ra, o.dec)
        GROUP BY r.ref_source_id"""
    )


@register(
    "epoch_match",
    f"""WITH {SEED}, {S.pairs('t1', 't2', 'p')}
    SELECT a.source_id AS object_id, b.epoch AS epoch, b.source_id AS source_id FROM p""",
)
def epoch_match(spark, sf_dir):
    return X.epoch_match(*_seed(spark, sf_dir))


@register(
    "epoch_new_objects",
    f"""WITH {SEED}, {S.pairs('t1', 't2', 'p')}
    SELECT source_id, epoch FROM t2 WHERE source_id NOT IN (SELECT b.source_id FROM p)""",
)
def epoch_new_objects(spark, sf_dir):
    return X.new_objects(*_seed(spark, sf_dir)).select("source_id", "epoch")
