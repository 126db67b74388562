"""Matching of two small sets of positions inside one task (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PAIRS_AT_ONCE = 2_000_000


def matched_pairs(
    ref_ra: np.ndarray, ref_dec: np.ndarray, ra: np.ndarray, dec: np.ndarray, radius_deg2: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (reference index, observation index) of all pairs within the radius.

    References are sorted by declination, so an observation looks only at the
    strip around it; strips are expanded in portions of bounded size.
    """
    if len(ref_ra) == 0 or len(ra) == 0:
        return
    order = np.argsort(ref_dec, kind="stable")
    sorted_dec = ref_dec[order]
    radius = radius_deg2**0.5
    low = np.searchsorted(sorted_dec, dec - radius, "left")
    count = np.searchsorted(sorted_dec, dec + radius, "right") - low
    ends = np.cumsum(count)
    start = 0
    while start < len(ra):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        part = count[start:stop]
        obs = np.repeat(np.arange(start, stop), part)
        within = np.arange(len(obs)) - np.repeat(np.cumsum(part) - part, part)
        ref = order[np.repeat(low[start:stop], part) + within]
        gap = np.abs(ref_ra[ref] - ra[obs])
        gap = np.where(gap > 180.0, 360.0 - gap, gap)
        gap = gap * np.cos(np.radians((ref_dec[ref] + dec[obs]) / 2.0))
        rise = ref_dec[ref] - dec[obs]
        near = gap * gap + rise * rise < radius_deg2
        yield ref[near], obs[near]
        start = stop


def has_partner(
    ref_ra: np.ndarray, ref_dec: np.ndarray, ra: np.ndarray, dec: np.ndarray, radius_deg2: float
) -> np.ndarray:
    """For each observation, whether any reference is within the radius."""
    found = np.zeros(len(ra), dtype=bool)
    for _, obs in matched_pairs(ref_ra, ref_dec, ra, dec, radius_deg2):
        found[obs] = True
    return found
