"""Plain loops that state what the operators have to compute."""

import numpy as np
import pandas as pd

from starloom.schema import RADIUS_DEG2


def near(a, b, radius_deg2=RADIUS_DEG2):
    gap = np.abs(a.ra - b.ra)
    gap = min(gap, 360.0 - gap) * np.cos(np.radians((a.dec + b.dec) / 2.0))
    return gap * gap + (a.dec - b.dec) ** 2 < radius_deg2


def pairs(left, right):
    return {
        (a.source_id, b.source_id)
        for a in left.itertuples()
        for b in right.itertuples()
        if near(a, b)
    }


def fold(rows: pd.DataFrame, max_misses=None, mag_limit=18.0, clock=None):
    """Step by step through the epochs. ``clock`` gives the epochs that count for a row."""
    refs, result = [], set()
    for epoch, now in rows.groupby("epoch", sort=True):
        now = list(now.itertuples())
        fresh = []
        hit = set()
        for o in now:
            found = [r for r in refs if near(r["row"], o)]
            result |= {(r["row"].source_id, o.source_id) for r in found}
            hit |= {r["row"].source_id for r in found}
            if not found:
                fresh.append({"row": o, "misses": 0})
        for r in refs:
            if r["row"].source_id in hit:
                r["misses"] = 0
            elif clock is None or epoch in clock(r["row"]):
                r["misses"] += 1
        if max_misses is not None:
            refs = [r for r in refs if r["misses"] < max_misses or r["row"].mag >= mag_limit]
        refs += fresh
    return result


def random_sky(seed, stars=25, epochs=30, seen=0.5, ra0=90.0, dec0=-74.0, spread=0.02, jitter=6e-4):
    """Crowded detections around stars: many to many matches and chains occur."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(stars):
        ra = ra0 + rng.uniform(-spread, spread) / np.cos(np.radians(dec0))
        dec = dec0 + rng.uniform(-spread, spread)
        mag = rng.uniform(10, 22)
        for e in range(1, epochs + 1):
            if rng.random() < seen:
                rows.append(
                    (
                        f"s{s}_{e}",
                        e,
                        (ra + rng.normal(0, jitter) / np.cos(np.radians(dec0))) % 360.0,
                        dec + rng.normal(0, jitter),
                        mag,
                    )
                )
    return pd.DataFrame(rows, columns=["source_id", "epoch", "ra", "dec", "mag"])
