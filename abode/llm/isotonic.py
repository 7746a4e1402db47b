"""Isotonic calibration from binned label counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pool_adjacent(x: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing shares of ``good`` in ``n`` over ascending ``x``:
    (mean x, share) of each pool, shares smoothed by half a row of either kind."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, n, good, strict=True):
        pools.append([a * b, b, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools).reshape(-1, 3)
    share = (p[:, 2] + 0.5) / (p[:, 1] + 1)
    return p[:, 0] / p[:, 1], np.maximum.accumulate(share) if len(share) else share


def calibration(scored: DataFrame, raw: Column, label: Column, step: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic map raw -> share of label 1, from counts per bin of ``step``
    within [low, high] (so a bounded number of rows reaches the driver)."""
    at = F.round(F.least(F.greatest(raw, F.lit(low)), F.lit(high)) / step)
    rows = scored.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.sum(label.cast("long")).alias("g")).orderBy("b").collect()
    if not rows:
        return np.zeros(0), np.zeros(0)
    b, n, g = (np.array([r[c] for r in rows], float) for c in ("b", "n", "g"))
    return pool_adjacent(b * step, n, g)


def calibrated(x: np.ndarray, curve: tuple[np.ndarray, np.ndarray], default: float) -> np.ndarray:
    """Shares at ``x``, linear between pools; ``default`` without any."""
    return np.interp(x, *curve) if len(curve[0]) else np.full(len(x), default)
