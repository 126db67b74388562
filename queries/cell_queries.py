"""Cells, neighbours, border tags and cell statistics."""

from pyspark.sql import functions as F

from queries import projections as P
from queries import sql as S
from queries.registry import register
from starloom.functions.cells import cell_neighbours, cell_parent, with_sky_cell
from starloom.operators import halo


@register(
    "sky_cell",
    f"WITH {P.WHOLE_SKY}, {S.cell('sky', 'c', 13)} SELECT star, pix // 64 AS cell, pix AS fine_cell FROM c",
)
def sky_cell(spark, sf_dir):
    fine = with_sky_cell(P.whole_sky(spark, sf_dir), "fine_cell", 13)
    return with_sky_cell(fine, "cell", 10).select("star", "cell", "fine_cell")


@register(
    "cell_parent",
    f"""WITH {P.WHOLE_SKY}, {S.cell('sky', 'f', 13)}, {S.cell('sky', 'c', 10)}
    SELECT f.star, f.pix AS fine_cell, c.pix AS parent FROM f JOIN c USING (star)""",
)
def parent(spark, sf_dir):
    fine = with_sky_cell(P.whole_sky(spark, sf_dir), "fine_cell", 13)
    return fine.select("star", "fine_cell", cell_parent("fine_cell", 13, 10).alias("parent"))


def _neighbour_sql(order):
    return f"""{S.cell('sky', f'c{order}', order)}, {S.neighbours(f'c{order}', f'n{order}', order)}"""


@register(
    "cell_neighbours",
    f"""WITH {P.WHOLE_SKY}, {_neighbour_sql(2)}, {_neighbour_sql(13)}
    SELECT star, 2 AS level, step, npix AS neighbour FROM n2
    UNION ALL SELECT star, 13, step, npix FROM n13""",
)
def neighbours(spark, sf_dir):
    """Level 2 meets many face borders and corners, level 13 is the working level."""

    def of(order):
        at = with_sky_cell(P.whole_sky(spark, sf_dir), "cell", order)
        return at.select(
            "star",
            F.lit(order).alias("level"),
            F.posexplode(cell_neighbours("cell", order)).alias("step", "neighbour"),
        )

    return of(2).unionByName(of(13)).filter("neighbour IS NOT NULL")


TAGGED = f"WITH {P.DETECTIONS}, {S.border('det')}"


@register(
    "border_flag",
    TAGGED
    + """ SELECT source_id, cell, CAST(source_id IN (SELECT source_id FROM touch) AS INTEGER)
    AS on_border FROM tagged""",
)
def border_flag(spark, sf_dir):
    tagged = halo.tag_cells(P.detections(spark, sf_dir))
    return tagged.select(
        "source_id", "cell", (F.size("border_cells") > 0).cast("int").alias("on_border")
    )


@register(
    "border_cells",
    TAGGED + " SELECT source_id, cell, border_cell FROM tagged JOIN touch USING (source_id)",
)
def border_tags(spark, sf_dir):
    tagged = halo.tag_cells(P.detections(spark, sf_dir))
    return tagged.select("source_id", "cell", F.explode("border_cells").alias("border_cell"))


@register(
    "halo_replicate",
    TAGGED
    + """ SELECT source_id, epoch, cell AS home_cell, cell FROM tagged
    UNION ALL SELECT source_id, epoch, cell, border_cell FROM tagged JOIN touch USING (source_id)""",
)
def halo_rows(spark, sf_dir):
    tagged = halo.tag_cells(P.detections(spark, sf_dir))
    return halo.halo_replicate(tagged).select(
        "source_id", "epoch", "home_cell", "cell"
    )


@register(
    "cell_layout",
    TAGGED + " SELECT cell, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_partitions FROM tagged GROUP BY cell",
)
def layout(spark, sf_dir):
    """Each cell of ordinary size ends up in exactly one partition."""
    laid = halo.cell_layout(halo.tag_cells(P.detections(spark, sf_dir)))
    return (
        laid.select("cell", F.spark_partition_id().alias("p"))
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("p").alias("n_partitions"))
    )


@register(
    "cell_occupancy",
    TAGGED
    + """ SELECT cell, count(*) AS n_rows, min(epoch) AS first_epoch, max(epoch) AS last_epoch
    FROM tagged GROUP BY cell""",
)
def occupancy(spark, sf_dir):
    return halo.cell_occupancy(halo.tag_cells(P.detections(spark, sf_dir)))


@register(
    "cell_day_one",
    TAGGED
    + """ SELECT cell, epoch AS first_epoch, count(*) AS n_seed FROM tagged t
    WHERE epoch = (SELECT min(epoch) FROM tagged u WHERE u.cell = t.cell) GROUP BY cell, epoch""",
)
def day_one(spark, sf_dir):
    return halo.cell_day_one(halo.tag_cells(P.detections(spark, sf_dir)))


@register(
    "cell_epoch_steps",
    TAGGED
    + """, per AS (SELECT cell, epoch, count(*) AS n_rows FROM tagged GROUP BY cell, epoch)
    SELECT * FROM (SELECT cell, lag(epoch) OVER (PARTITION BY cell ORDER BY epoch) AS previous_epoch,
                          epoch, n_rows FROM per) WHERE previous_epoch IS NOT NULL""",
)
def epoch_steps(spark, sf_dir):
    return halo.cell_epoch_steps(halo.tag_cells(P.detections(spark, sf_dir)))
