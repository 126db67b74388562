"""Building blocks of the SQL side: cells, neighbours and pairs by plain formulas."""

from starloom.functions.cells import NEIGHBOUR_FACE, NEIGHBOUR_FLIP, STEPS
from starloom.schema import RADIUS_DEG2


def _d(text: str) -> str:
    return f"CAST({text} AS DOUBLE)"


def distance2(a: str, b: str) -> str:
    gap = f"abs({a}.ra - {b}.ra)"
    along = (
        f"((CASE WHEN {gap} > 180 THEN {_d('360')} - {gap} ELSE {gap} END)"
        f" * cos(radians(({a}.dec + {b}.dec) / {_d('2')})))"
    )
    return f"({along} * {along} + ({a}.dec - {b}.dec) * ({a}.dec - {b}.dec))"


def cell(source: str, name: str, order: int) -> str:
    """CTEs that add ``pix``, the nested cell of level ``order``, to ``source``."""
    n = 2**order
    spread = f"list_sum([(({{0}} >> i) & 1) << (2 * i) for i in range({order})])"
    return f"""
{name}_1 AS (
  SELECT *, cos(radians({_d('90')} - dec)) AS z, sin(radians({_d('90')} - dec)) AS st,
         radians(ra) / (pi() / 2) - floor(radians(ra) / (2 * pi())) * 4 AS tt FROM {source}),
{name}_2 AS (
  SELECT *, abs(z) <= {_d('2')} / 3 AS belt, least(3, CAST(floor(tt) AS BIGINT)) AS ntt,
         CASE WHEN abs(z) <= {_d('2')} / 3 THEN {_d('0.75')} * {n} * z
              WHEN abs(z) < {_d('0.99')} THEN {n} * sqrt(3 * (1 - abs(z)))
              ELSE {n} * st / sqrt((1 + abs(z)) / 3) END AS w FROM {name}_1),
{name}_3 AS (
  SELECT *, CASE WHEN belt THEN CAST(floor({n} * ({_d('0.5')} + tt) - w) AS BIGINT)
                 ELSE least({n - 1}, CAST(floor((tt - ntt) * w) AS BIGINT)) END AS jp,
            CASE WHEN belt THEN CAST(floor({n} * ({_d('0.5')} + tt) + w) AS BIGINT)
                 ELSE least({n - 1}, CAST(floor((1 - (tt - ntt)) * w) AS BIGINT)) END AS jm
  FROM {name}_2),
{name}_4 AS (
  SELECT *, CASE WHEN belt AND jp // {n} = jm // {n} THEN (jp // {n}) | 4
                 WHEN belt AND jp // {n} < jm // {n} THEN jp // {n}
                 WHEN belt THEN jm // {n} + 8
                 WHEN z > 0 THEN ntt ELSE ntt + 8 END AS face,
            CASE WHEN belt THEN jm % {n} WHEN z > 0 THEN {n - 1} - jm ELSE jp END AS px,
            CASE WHEN belt THEN {n - 1} - jp % {n} WHEN z > 0 THEN {n - 1} - jp ELSE jm END AS py
  FROM {name}_3),
{name} AS (
  SELECT * EXCLUDE (z, st, tt, belt, ntt, w, jp, jm),
         CAST(face * {n * n} + {spread.format('px')} + 2 * {spread.format('py')} AS BIGINT) AS pix
  FROM {name}_4)"""


def neighbours(source: str, name: str, order: int) -> str:
    """CTEs with one row per row of ``source`` (with face, px, py) and existing neighbour ``npix``."""
    n = 2**order
    spread = f"list_sum([(({{0}} >> i) & 1) << (2 * i) for i in range({order})])"
    steps = ", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(STEPS))
    faces = str([f for row in NEIGHBOUR_FACE for f in row])
    flips = str([f for row in NEIGHBOUR_FLIP for f in row])
    return f"""
{name}_1 AS (
  SELECT s.*, t.step, (px + dx + {n}) % {n} AS x1, (py + dy + {n}) % {n} AS y1,
         4 + CASE WHEN px + dx < 0 THEN -1 WHEN px + dx >= {n} THEN 1 ELSE 0 END
           + CASE WHEN py + dy < 0 THEN -3 WHEN py + dy >= {n} THEN 3 ELSE 0 END AS way
  FROM {source} s, (VALUES {steps}) t(step, dx, dy)),
{name}_2 AS (
  SELECT *, {faces}[way * 12 + face + 1] AS f2, {flips}[way * 3 + face // 4 + 1] AS flip
  FROM {name}_1),
{name}_3 AS (
  SELECT *, CASE WHEN flip & 1 != 0 THEN {n - 1} - x1 ELSE x1 END AS x2,
            CASE WHEN flip & 2 != 0 THEN {n - 1} - y1 ELSE y1 END AS y2
  FROM {name}_2 WHERE f2 >= 0),
{name}_4 AS (
  SELECT *, CASE WHEN flip & 4 != 0 THEN y2 ELSE x2 END AS x3,
            CASE WHEN flip & 4 != 0 THEN x2 ELSE y2 END AS y3 FROM {name}_3),
{name} AS (
  SELECT *, CAST(f2 * {n * n} + {spread.format('x3')} + 2 * {spread.format('y3')} AS BIGINT) AS npix
  FROM {name}_4)"""


def border(source: str, order: int = 10, fine: int = 13) -> str:
    """CTEs ``tagged`` (rows with ``cell``) and ``touch`` (source_id, border_cell) of a relation."""
    up = 4 ** (fine - order)
    return (
        cell(source, "fine", fine)
        + ","
        + neighbours("fine", "nb", fine)
        + f""",
tagged AS (SELECT * EXCLUDE (pix, face, px, py), pix // {up} AS cell FROM fine),
touch AS (SELECT DISTINCT source_id, npix // {up} AS border_cell FROM nb
          WHERE npix // {up} <> pix // {up})"""
    )


def pairs(left: str, right: str, name: str, condition: str = "true") -> str:
    """A CTE with all pairs (a, b) within the radius, by brute force in small boxes."""
    return f"""
{name}_a AS (SELECT *, unnest([-1, 0, 1]) + CAST(floor(dec / 0.005) AS BIGINT) AS kd FROM {left}),
{name}_l AS (SELECT *, unnest([-1, 0, 1]) + CAST(floor(ra / 0.05) AS BIGINT) AS kr FROM {name}_a),
{name} AS (
  SELECT a, b FROM {name}_l a JOIN {right} b
    ON a.kd = CAST(floor(b.dec / 0.005) AS BIGINT) AND a.kr = CAST(floor(b.ra / 0.05) AS BIGINT)
   AND {distance2('a', 'b')} < {RADIUS_DEG2!r} AND {condition})"""
