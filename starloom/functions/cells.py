"""Sky cells: the nested equal-area pixel scheme of Gorski et al. 2005 (ApJ 622, 759).

Everything is built from SQL expressions (as text, because that is one call to
the JVM instead of hundreds), so cells are computed inside the scan's
code-generated stage. A nested id is ``face * 4**order`` plus the bits of x
and y interleaved (x on the even bits); the parent of a cell is therefore a
plain right shift, and a step to a neighbour can be taken on the interleaved
bits without unpacking them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.schema import RADIUS_DEG2

MAX_ORDER = 18

# Fixed values of the pixel scheme: the face reached when leaving a face in
# each of nine directions (S, SE, E, SW, centre, NE, W, NW, N; -1 = no such
# neighbour), and the flips to apply there by face row (1 = mirror x,
# 2 = mirror y, 4 = swap x and y).
NEIGHBOUR_FACE = [
    [8, 9, 10, 11, -1, -1, -1, -1, 10, 11, 8, 9],
    [5, 6, 7, 4, 8, 9, 10, 11, 9, 10, 11, 8],
    [-1, -1, -1, -1, 5, 6, 7, 4, -1, -1, -1, -1],
    [4, 5, 6, 7, 11, 8, 9, 10, 11, 8, 9, 10],
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11],
    [1, 2, 3, 0, 0, 1, 2, 3, 5, 6, 7, 4],
    [-1, -1, -1, -1, 7, 4, 5, 6, -1, -1, -1, -1],
    [3, 0, 1, 2, 3, 0, 1, 2, 4, 5, 6, 7],
    [2, 3, 0, 1, -1, -1, -1, -1, 0, 1, 2, 3],
]
NEIGHBOUR_FLIP = [
    [0, 0, 3],
    [0, 0, 6],
    [0, 0, 0],
    [0, 0, 5],
    [0, 0, 0],
    [5, 0, 0],
    [0, 0, 0],
    [6, 0, 0],
    [3, 0, 0],
]
# Steps (dx, dy) to the neighbours SW, W, NW, N, NE, E, SE, S.
STEPS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def _even_mask(order: int) -> int:
    return (4**order - 1) // 3


def _check(order: int) -> None:
    if not 0 <= order <= MAX_ORDER:
        raise ValueError(f"cell order must be between 0 and {MAX_ORDER}, got {order}")


def _array(values: list[int], kind: str = "L") -> str:
    return "array(" + ", ".join(f"{v}{kind}" for v in values) + ")"


def _spread(value: str) -> str:
    """Move bit i of an 18-bit number to bit 2i, nine bits per table look-up."""
    table = _array([int(format(i, "b"), 4) for i in range(512)])
    low = f"get({table}, int({value} & 511))"
    high = f"get({table}, int(shiftright({value}, 9)))"
    return f"({low} + shiftleft({high}, 18))"


def with_sky_cell(
    df: DataFrame, name: str, order: int, ra: str = "ra", dec: str = "dec"
) -> DataFrame:
    """Add the nested cell id (bigint) of a position in degrees.

    The formula is a chain of projections: each step refers to the columns of
    the one before, so nothing is computed twice and the generated method stays
    below the size the JIT compiler accepts. A missing coordinate gives cell -1.
    """
    _check(order)
    n = 1 << order
    last = f"{n - 1}L"
    kept = [f"`{c}`" for c in df.columns]
    zone = df.selectExpr(
        *kept,
        f"pmod(radians(`{ra}`), {2.0 * math.pi!r}D) / {math.pi / 2.0!r}D AS _quarter",
        f"radians(90D - `{dec}`) AS _colat",
    ).selectExpr(
        "*", "cos(_colat) AS _z", "abs(cos(_colat)) AS _height", "least(3, int(floor(_quarter))) AS _cap"
    )
    # Lines of constant x and y: straight in (ra, z) on the belt around the
    # equator, scaled by the distance from the pole on the two caps.
    lines = zone.selectExpr(
        "*",
        f"_height <= {2.0 / 3.0!r}D AS _belt",
        f"""if(_height <= {2.0 / 3.0!r}D, _z * {0.75 * n!r}D,
            sin(_colat) * sqrt(3D / (1D + _height)) * {float(n)!r}D) AS _rise""",
        f"(0.5D + _quarter) * {float(n)!r}D AS _slope",
    ).selectExpr(
        "*",
        f"""if(_belt, floor(_slope - _rise),
            least(floor((_quarter - _cap) * _rise), {last})) AS _down""",
        f"""if(_belt, floor(_slope + _rise),
            least(floor((1D - (_quarter - _cap)) * _rise), {last})) AS _up""",
    )
    square = lines.selectExpr(
        "*", f"shiftright(_down, {order}) AS _fd", f"shiftright(_up, {order}) AS _fu"
    ).selectExpr(
        *kept,
        """CASE WHEN _belt AND _fd = _fu THEN _fd | 4L WHEN _belt AND _fd < _fu THEN _fd
                WHEN _belt THEN _fu + 8L WHEN _z > 0 THEN bigint(_cap)
                ELSE bigint(_cap) + 8L END AS _face""",
        f"CASE WHEN _belt THEN _up & {last} WHEN _z > 0 THEN {last} - _up ELSE _down END AS _x",
        f"""CASE WHEN _belt THEN {last} - (_down & {last}) WHEN _z > 0 THEN {last} - _down
                ELSE _up END AS _y""",
    )
    cell = f"shiftleft(_face, {2 * order}) + {_spread('_x')} + shiftleft({_spread('_y')}, 1)"
    # The one-element generator keeps the optimizer from rewriting a later filter
    # on the cell in terms of ra and dec, which would repeat the whole chain.
    return square.selectExpr(
        *[k for k in kept if k != f"`{name}`"],
        f"inline(array(named_struct('{name}', coalesce({cell}, -1L))))",
    )


def cell_parent(cell: str, order: int, parent_order: int) -> Column:
    """The coarser cell that contains a cell."""
    if parent_order > order:
        raise ValueError("a parent cell has a lower order")
    return F.shiftright(cell, 2 * (order - parent_order))


def _on_rim(cell: str, order: int) -> str:
    """True when the last ``2 * order`` bits describe a place on the rim of the square."""
    xs = _even_mask(order)
    ys = xs << 1
    x, y = f"{cell} & {xs}L", f"{cell} & {ys}L"
    return f"(({x}) = 0 OR ({x}) = {xs}L OR ({y}) = 0 OR ({y}) = {ys}L)"


def _moved(cell: str, order: int, dx: int, dy: int) -> str:
    """A step on the interleaved bits.

    A step up carries through the other coordinate's bits (set to one), a step
    down borrows through them (set to zero); both wrap at the rim of a face.
    """
    xs = _even_mask(order)
    ys = xs << 1
    x = {
        -1: f"((({cell} & {xs}L) - 1L) & {xs}L)",
        0: f"({cell} & {xs}L)",
        1: f"((({cell} | {ys}L) + 1L) & {xs}L)",
    }
    y = {
        -1: f"((({cell} & {ys}L) - 2L) & {ys}L)",
        0: f"({cell} & {ys}L)",
        1: f"((({cell} | {xs}L) + 2L) & {ys}L)",
    }
    return f"({x[dx]} + {y[dy]})"


def _inside_face(cell: str, order: int) -> list[str]:
    base = f"shiftleft(shiftright({cell}, {2 * order}), {2 * order})"
    return [f"({base} + {_moved(cell, order, dx, dy)})" for dx, dy in STEPS]


def _any_face(cell: str, order: int) -> str:
    """All eight neighbours of cells on the rim of a face, null where missing.

    Such cells are few, so this is a lambda over the eight steps: short to
    generate, if slower per row.
    """
    xs = _even_mask(order)
    ys = xs << 1
    faces = _array([f for row in NEIGHBOUR_FACE for f in row])
    flips = _array([f for row in NEIGHBOUR_FLIP for f in row], "")
    moves = ", ".join(
        f"named_struct('to', {_moved(cell, order, dx, dy)}, 'way', 4"
        + {-1: f" - int(({cell} & {xs}L) = 0)", 0: "", 1: f" + int(({cell} & {xs}L) = {xs}L)"}[dx]
        + {-1: f" - 3 * int(({cell} & {ys}L) = 0)", 0: "", 1: f" + 3 * int(({cell} & {ys}L) = {ys}L)"}[dy]
        + ")"
        for dx, dy in STEPS
    )
    face = f"int(shiftright({cell}, {2 * order}))"
    crossed = (
        f"transform(array({moves}), m -> named_struct("
        f"'face', get({faces}, m.way * 12 + {face}), "
        f"'flip', get({flips}, m.way * 3 + shiftright({face}, 2)), "
        f"'x', m.to & {xs}L, 'y', m.to & {ys}L))"
    )
    mirrored = (
        f"transform({crossed}, m -> named_struct('face', m.face, 'swap', (m.flip & 4) != 0, "
        f"'x', if((m.flip & 1) != 0, {xs}L - m.x, m.x), "
        f"'y', if((m.flip & 2) != 0, {ys}L - m.y, m.y)))"
    )
    return (
        f"transform({mirrored}, m -> if(m.face >= 0, shiftleft(m.face, {2 * order}) + "
        "if(m.swap, shiftright(m.y, 1) + shiftleft(m.x, 1), m.x + m.y), NULL))"
    )


def cell_neighbours(cell: str, order: int) -> Column:
    """The eight neighbours SW, W, NW, N, NE, E, SE, S; null where none exists."""
    _check(order)
    inside = ", ".join(_inside_face(cell, order))
    return F.expr(f"if({_on_rim(cell, order)}, {_any_face(cell, order)}, array({inside}))")


def border_cells(fine_cell: str, fine_order: int, order: int) -> Column:
    """Foreign cells of level ``order`` that touch the fine cell; empty inside.

    The neighbour search runs only for rows on the rim of their own cell.
    """
    _check(fine_order)
    up = 2 * (fine_order - order)
    own = f"array(shiftright({fine_cell}, {up}))"
    parents = ", ".join(f"shiftright({c}, {up})" for c in _inside_face(fine_cell, fine_order))
    across = f"filter({_any_face(fine_cell, fine_order)}, c -> c IS NOT NULL)"
    across = f"transform({across}, c -> shiftright(c, {up}))"
    on_own_rim = _on_rim(fine_cell, fine_order - order) if up else "true"
    return F.expr(
        f"""CASE WHEN NOT {on_own_rim} THEN CAST(array() AS array<bigint>)
                 WHEN NOT {_on_rim(fine_cell, fine_order)}
                   THEN array_except(array({parents}), {own})
                 ELSE array_except({across}, {own}) END"""
    )


@dataclass(frozen=True)
class MatchGrid:
    """Cell levels used by the positional joins.

    Rows meet in cells of level ``order``; one side is copied into every cell
    that touches its own cell of level ``fine_order``. All partners within the
    radius are found as long as a fine cell is clearly wider than the radius.
    ``micro_order`` is the level used to pick one leading detection per spot.
    """

    order: int = 13
    fine_order: int = 14
    micro_order: int = 16

    def __post_init__(self):
        if not 0 <= self.order <= self.fine_order <= self.micro_order <= MAX_ORDER:
            raise ValueError("levels must rise: order <= fine_order <= micro_order")

    @staticmethod
    def for_radius(radius_deg2: float = RADIUS_DEG2) -> "MatchGrid":
        """Finest levels whose fine cell is at least 2.5 radii wide."""
        radius = radius_deg2**0.5
        side = math.degrees(math.sqrt(math.pi / 3.0))
        fine = int(math.floor(math.log2(side / (2.5 * radius))))
        fine = max(1, min(fine, MAX_ORDER - 2))
        return MatchGrid(fine - 1, fine, min(fine + 2, MAX_ORDER))

    def check_radius(self, radius_deg2: float) -> None:
        side = math.degrees(math.sqrt(math.pi / 3.0)) / (1 << self.fine_order)
        if side < 2.5 * radius_deg2**0.5:
            raise ValueError(
                f"a cell of level {self.fine_order} is too small for this radius; "
                "use MatchGrid.for_radius"
            )
