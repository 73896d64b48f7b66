"""Statistics of single numbers, and of arrays that are small by nature."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

#: Fixed value: the Euler-Mascheroni constant.
EULER = 0.5772156649015329
NORMAL = NormalDist()


def probabilistic_sharpe(n: int, mean: float, sd: float, skew: float, excess: float, benchmark: float = 0.0, periods: int = 252) -> float:
    """Probability that the true Sharpe ratio is above the (yearly) benchmark; moments are per period, kurtosis is in excess of 3."""
    if n < 30 or not sd or sd < 1e-12:
        return 0.0
    s = mean / sd
    spread = 1 - skew * s + (excess + 2) / 4 * s * s
    return NORMAL.cdf((s - benchmark / math.sqrt(periods)) * math.sqrt((n - 1) / spread)) if spread > 0 else 0.0


def expected_best(trials: int, sd: float) -> float:
    """Expected largest Sharpe ratio, per period, of so many trials without skill."""
    if trials < 2 or not sd > 0:
        return 0.0
    a, b = (NORMAL.inv_cdf(1 - 1 / (trials * x)) for x in (1, math.e))
    return sd * (a + EULER * (b - a))


def bootstrap_sharpe(x: np.ndarray, periods: int = 252, n_boot: int = 1000, block: int = 20, alpha: float = 0.05, seed: int = 0) -> tuple[float, float]:
    """Confidence limits of the yearly Sharpe ratio by the stationary bootstrap; NaN for fewer than 60 values."""
    n = len(x)
    if n < 60:
        return math.nan, math.nan
    rng = np.random.default_rng(seed)
    # where each resampled position's block began, and how far into the block it is
    fresh = rng.random((n_boot, n)) < 1 / block
    fresh[:, 0] = True
    at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0), axis=1)
    starts = rng.integers(0, n, (n_boot, n))
    sample = x[(np.take_along_axis(starts, at, axis=1) + np.arange(n) - at) % n]
    sd = sample.std(axis=1, ddof=1)
    ratios = np.divide(sample.mean(axis=1), sd, out=np.zeros(n_boot), where=sd > 0) * math.sqrt(periods)
    low, high = np.quantile(ratios, [alpha / 2, 1 - alpha / 2])
    return float(low), float(high)
