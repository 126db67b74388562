"""Distance on the sky as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from starloom.schema import RADIUS_DEG2


def ra_difference(ra1: str, ra2: str) -> str:
    """Absolute difference of two right ascensions, going the short way round."""
    return f"if(abs({ra1} - {ra2}) > 180D, 360D - abs({ra1} - {ra2}), abs({ra1} - {ra2}))"


def separation2_sql(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    along_ra = f"({ra_difference(ra1, ra2)} * cos(radians(({dec1} + {dec2}) / 2D)))"
    along_dec = f"({dec1} - {dec2})"
    return f"({along_ra} * {along_ra} + {along_dec} * {along_dec})"


def separation2(ra1: str, dec1: str, ra2: str, dec2: str) -> Column:
    """Squared planar separation in square degrees of two pairs of columns."""
    return F.expr(separation2_sql(ra1, dec1, ra2, dec2))


def within_radius(
    ra1: str, dec1: str, ra2: str, dec2: str, radius_deg2: float = RADIUS_DEG2
) -> Column:
    """True where two positions match.

    The declination test costs one subtraction and rejects most candidates
    before the cosine is taken.
    """
    return F.expr(
        f"abs({dec1} - {dec2}) <= {radius_deg2**0.5!r}D "
        f"AND {separation2_sql(ra1, dec1, ra2, dec2)} < {radius_deg2!r}D"
    )


def register_sql_functions(spark: SparkSession) -> None:
    """Make the separation callable from SQL; the bodies are inlined by Catalyst."""
    args = "ra1 DOUBLE, dec1 DOUBLE, ra2 DOUBLE, dec2 DOUBLE"
    body = separation2_sql("ra1", "dec1", "ra2", "dec2")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION separation2({args}) RETURNS DOUBLE RETURN {body}"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION within_radius({args}) RETURNS BOOLEAN RETURN "
        f"abs(dec1 - dec2) <= {RADIUS_DEG2**0.5!r}D AND {body} < {RADIUS_DEG2!r}D"
    )
