"""Groups of detections that cannot touch each other, settled inside one task (numpy)."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

STAYS = np.iinfo(np.int64).min
#: Groups of up to so many rows are settled together; in larger ones a step looks at near references only.
MARCH_ROWS = 128


def grid_places(ra: np.ndarray, dec: np.ndarray, radius_deg2: float, first: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of a grid in which detections within the radius are in the same or in touching squares.

    Right ascension is shrunk by the least cosine of the part, so distances in
    the grid are at most the true ones. A part too wide for that has one column.
    """
    side = math.sqrt(radius_deg2) * (1 + 1e-9)
    east = (ra - ra[first][part] + 180.0) % 360.0 - 180.0
    wide = np.maximum.reduceat(east, first) - np.minimum.reduceat(east, first) > 90.0
    shrink = np.where(wide, 0.0, np.maximum(np.cos(np.radians(np.maximum.reduceat(np.abs(dec), first))), 0.0))
    return np.floor(east * shrink[part] / side).astype(np.int64), np.floor(dec / side).astype(np.int64)


def connected_groups(ra: np.ndarray, dec: np.ndarray, radius_deg2: float, part: np.ndarray | None = None) -> np.ndarray:
    """A group number per detection; detections within the radius of each other share it.

    Occupied squares of the grid that touch are joined, so a group may hold more than what the
    radius connects, never less. ``part`` (rising) keeps detections of different parts apart.
    """
    if not len(ra):
        return np.empty(0, dtype=np.int64)
    new = np.append(True, np.diff(part) != 0) if part is not None else np.arange(len(ra)) == 0
    first, part = np.flatnonzero(new), np.cumsum(new) - 1
    x, y = grid_places(ra, dec, radius_deg2, first, part)
    x, y = (c - np.minimum.reduceat(c, first)[part] + 1 for c in (x, y))
    stride = int(y.max()) + 2
    x += part * (int(x.max()) + 2)
    squares, square = np.unique(x * stride + y, return_inverse=True)
    a, b = [], []
    for step in (1, stride - 1, stride, stride + 1):
        at = np.minimum(np.searchsorted(squares, squares + step), len(squares) - 1)
        met = np.flatnonzero(squares[at] == squares + step)
        a.append(met)
        b.append(at[met])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(squares))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        if (new == label).all():
            return label[square]
        label = new


@dataclass
class Field:
    """Rows of one task. ``clocks`` holds the counted epochs of every home cell, in order, or of all (None)."""

    ra: np.ndarray
    dec: np.ndarray
    epoch: np.ndarray
    mag: np.ndarray
    home: np.ndarray
    clocks: dict[int | None, np.ndarray]
    radius_deg2: float
    max_misses: int | None
    mag_limit: float
    #: For references known before: the epoch in which each was seen last; ``STAYS`` for detections.
    last: np.ndarray | None = None

    def known(self) -> np.ndarray:
        return np.zeros(len(self.ra), dtype=bool) if self.last is None else self.last != STAYS

    def __post_init__(self) -> None:
        """All clocks in one sorted list: the number of the home cell, times the span of epochs, plus the epoch."""
        homes = sorted(h for h in self.clocks if h is not None)
        self.homes = np.array(homes, dtype=np.int64)
        clocks = [self.clocks[None]] if None in self.clocks else [self.clocks[h] for h in homes]
        every = np.concatenate([np.asarray(c, dtype=np.int64) for c in clocks]) if clocks else np.empty(0, dtype=np.int64)
        self.least, self.span = (int(every.min()) - 1, int(every.max() - every.min()) + 3) if len(every) else (0, 1)
        self.ticks = np.repeat(np.arange(len(clocks)), [len(c) for c in clocks]) * self.span + every - self.least

    def missed(self, row: np.ndarray, last: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Counted epochs between two hits of the objects found by these rows."""
        if None in self.clocks:
            base, told = 0, True
        else:
            at = np.minimum(np.searchsorted(self.homes, self.home[row]), max(0, len(self.homes) - 1))
            base = at * self.span
            told = self.homes[at] == self.home[row] if len(self.homes) else False
        now, last = (base + np.clip(e - self.least, 0, self.span - 1) for e in (now, np.maximum(last, self.least)))
        return np.where(told, np.searchsorted(self.ticks, now, "left") - np.searchsorted(self.ticks, last, "right"), 0)


@dataclass
class Settled:
    """Founders, known ones included, with the epoch from which they no longer match (``STAYS``: none), and (founder, row) pairs."""

    founders: np.ndarray
    gone: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray]


def simple_groups(field: Field, order: np.ndarray, first: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which groups are one object that is never dropped: all rows match the first, which is alone in its epoch
    or known before.

    ``order`` sorts the rows by group and epoch, ``first`` marks where groups begin in it,
    ``group`` numbers the groups along it.
    """
    head = order[first][group]
    gap = np.abs(field.ra[order] - field.ra[head])
    gap = np.where(gap > 180.0, 360.0 - gap, gap) * np.cos(np.radians((field.dec[order] + field.dec[head]) / 2.0))
    rise = field.dec[order] - field.dec[head]
    later = field.epoch[order] > field.epoch[head]
    known = field.known()
    fits = (gap * gap + rise * rise < field.radius_deg2) & (later | (order == head)) & (~known[order] | (order == head))
    if field.max_misses is not None:
        seen = field.epoch if field.last is None else np.where(known, field.last, field.epoch)
        before = np.roll(seen[order], 1)
        bright = field.mag[head] < field.mag_limit
        fits &= ~(bright & later & (field.missed(head, before, field.epoch[order]) >= field.max_misses))
    return np.logical_and.reduceat(fits, first) if len(first) else np.empty(0, dtype=bool)


def march(field: Field, rows: np.ndarray, group: np.ndarray, told: tuple[list, list, list, list]) -> None:
    """Many groups at once: their first epochs together, then their second ones, and so on.

    ``rows`` are sorted by group, known references first, and epoch; ``group`` rises along them.
    """
    ra, dec, epoch, mag, known = (c[rows] for c in (field.ra, field.dec, field.epoch, field.mag, field.known()))
    last = np.where(known, epoch if field.last is None else field.last[rows], epoch)
    gone = np.full(len(rows), STAYS)
    head = np.append(True, np.diff(group) != 0)
    # Known references are step 0, the epochs of detections follow.
    new = ~known & (head | np.append(True, known[:-1] | (np.diff(epoch) != 0)))
    step = np.cumsum(new)
    starts = np.flatnonzero(head)
    number = np.cumsum(head) - 1
    step -= (step[starts] - new[starts])[number]
    by_step = np.argsort(step, kind="stable")
    cuts = np.searchsorted(step[by_step], np.arange(1, int(step.max()) + 2))
    found = live = np.flatnonzero(known)
    founders, left, right = [found], [], []
    for low, high in zip(cuts[:-1], cuts[1:]):
        now = by_step[low:high]
        # Every detection with all references of its group.
        begin, end = (np.searchsorted(number[live], number[now], side) for side in ("left", "right"))
        count = end - begin
        row = np.repeat(now, count)
        ref = live[np.arange(len(row)) - np.repeat(np.cumsum(count) - count - begin, count)]
        gap = np.abs(ra[ref] - ra[row])
        gap = np.where(gap > 180.0, 360.0 - gap, gap) * np.cos(np.radians((dec[ref] + dec[row]) / 2.0))
        rise = dec[ref] - dec[row]
        met = (gap * gap + rise * rise < field.radius_deg2) & (epoch[ref] < epoch[row])
        ref, row = ref[met], row[met]
        if field.max_misses is not None:
            shut = (mag[ref] < field.mag_limit) & (field.missed(rows[ref], last[ref], epoch[row]) >= field.max_misses)
            gone[ref[shut]] = epoch[row[shut]]
            ref, row = ref[~shut], row[~shut]
            live = live[gone[live] == STAYS]
        last[ref] = epoch[row]
        left.append(ref)
        right.append(row)
        found = now[~np.isin(now, row)]
        founders.append(found)
        live = np.sort(np.concatenate([live, found]))
    every = np.concatenate(founders)
    for some, values in zip(told, (rows[every], gone[every], *(rows[np.concatenate(p)] if p else rows[:0] for p in (left, right)))):
        some += values.tolist()


def walk(field: Field, rows: list[int], told: tuple[list, list, list, list]) -> None:
    """One group, known references first, then epoch by epoch. Founders are found by their square of the grid, so a step costs what it touches."""
    side = math.sqrt(field.radius_deg2) * (1 + 1e-9)
    ra, dec, epoch, mag = field.ra, field.dec, field.epoch, field.mag
    shrink = min(math.cos(math.radians(abs(dec[r]))) for r in rows)
    east0 = ra[rows[0]]
    east = [(ra[r] - east0 + 180.0) % 360.0 - 180.0 for r in rows]
    if max(east) - min(east) > 90.0:
        east = [0.0] * len(rows)
    places = [(math.floor(e * shrink / side), math.floor(dec[r] / side)) for r, e in zip(rows, east)]
    founders, gone, left, right = told
    known = [False] * len(rows) if field.last is None else (field.last[rows] != STAYS).tolist()
    grid: dict[tuple[int, int], list[int]] = defaultdict(list)
    last: dict[int, int] = {}
    dropped: dict[int, int] = {}
    place_of: dict[int, tuple[int, int]] = {}
    at = 0
    while at < len(rows) and known[at]:
        f, place = rows[at], places[at]
        grid[place].append(f)
        place_of[f], last[f] = place, int(field.last[f])
        at += 1
    while at < len(rows):
        end = at
        while end < len(rows) and epoch[rows[end]] == epoch[rows[at]]:
            end += 1
        now = int(epoch[rows[at]])
        met: list[tuple[int, int]] = []
        for row, (x, y) in zip(rows[at:end], places[at:end]):
            for i in (x - 1, x, x + 1):
                for j in (y - 1, y, y + 1):
                    for f in grid.get((i, j), ()):
                        gap = abs(ra[f] - ra[row])
                        gap = min(gap, 360.0 - gap) * math.cos(math.radians((dec[f] + dec[row]) / 2.0))
                        rise = dec[f] - dec[row]
                        if gap * gap + rise * rise < field.radius_deg2 and epoch[f] < now:
                            met.append((f, row))
        for f in {f for f, _ in met}:
            if field.max_misses is not None and mag[f] < field.mag_limit and int(field.missed(f, last[f], now)) >= field.max_misses:
                dropped[f] = now
            else:
                last[f] = now
        claimed = set()
        for f, row in met:
            if f not in dropped:
                left.append(f)
                right.append(row)
                claimed.add(row)
        for f in {f for f, _ in met if f in dropped}:
            grid[place_of[f]].remove(f)
        for row, place in zip(rows[at:end], places[at:end]):
            if row not in claimed:
                grid[place].append(row)
                place_of[row] = place
                last[row] = now
        at = end
    founders += last
    gone += [dropped.get(f, STAYS) for f in last]


def settle_groups(field: Field, rows: np.ndarray, group: np.ndarray) -> Settled:
    """The fold of these rows, whose groups are complete; ``group`` has a number per row of the field."""
    order = rows[np.lexsort((field.epoch[rows], ~field.known()[rows], group[rows]))]
    if not len(order):
        none = np.empty(0, dtype=np.int64)
        return Settled(none, none, (none, none))
    first = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    simple = simple_groups(field, order, first, number)
    head = order[first]
    others = simple[number] & (order != head[number])
    told: tuple[list, list, list, list] = ([], [], [], [])
    ends = np.append(first[1:], len(order))
    small = ~simple & (ends - first <= MARCH_ROWS)
    if small.any():
        march(field, order[small[number]], number[small[number]], told)
    for g in np.flatnonzero(~simple & ~small).tolist():
        walk(field, order[first[g] : ends[g]].tolist(), told)
    founders, gone, left, right = (np.array(t, dtype=np.int64) for t in told)
    return Settled(
        np.concatenate([head[simple], founders]),
        np.concatenate([np.full(int(simple.sum()), STAYS), gone]),
        (np.concatenate([head[number][others], left]), np.concatenate([order[others], right])),
    )
