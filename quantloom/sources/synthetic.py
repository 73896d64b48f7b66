"""Synthetic bars: a market factor with regimes and heavy tails, clusters, and assets that load on both.

A ticker is one task's work; what all share (the market and the clusters) is drawn again in each from
the same seed, so tickers need no exchange. No edge is planted, but persistent regimes favour trend rules.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "asset string, date date, open double, high double, low double, close double, volume double"
#: Yearly drift and volatility of rising, flat and falling markets, and daily transitions between them.
DRIFT_VOL = ((0.12, 0.13), (0.02, 0.17), (-0.28, 0.32))
MOVES = ((0.994, 0.004, 0.002), (0.006, 0.990, 0.004), (0.012, 0.010, 0.978))
YEAR = 252


def heavy(rng: np.random.Generator, size, df: int = 5) -> np.ndarray:
    """Student t of unit variance."""
    return rng.standard_t(df, size) * np.sqrt((df - 2) / df)


def _states(u: np.ndarray) -> np.ndarray:
    """A walk through the regimes from the first, by uniform draws."""
    upto, out, state = np.cumsum(MOVES, axis=1), [0], 0
    for x in u[1:]:
        state = min(int((upto[state] <= x).sum()), 2)
        out.append(state)
    return np.array(out)


class World:
    """What all tickers share."""

    def __init__(self, n: int, tickers: list[str], seed: int, regimes: bool):
        rng = np.random.default_rng(seed)
        state = _states(rng.random(n)) if regimes else np.zeros(n, int)
        drift, vol = np.array(DRIFT_VOL)[state].T
        self.market = drift / YEAR + vol / np.sqrt(YEAR) * heavy(rng, n)
        self.clusters = 0.10 / np.sqrt(YEAR) * heavy(rng, (n, max(1, len(tickers) // 3)))


def path(world: World, tickers: list[str], k: int, seed: int, benchmark: str | None, pairs: int) -> np.ndarray:
    """Log prices (from 0) of ticker k. Of `pairs` pairs, the second follows the first by a mean-reverting spread."""
    rng, n = np.random.default_rng([seed, zlib.crc32(tickers[k].encode())]), len(world.market)
    if tickers[k] == benchmark:
        r = world.market + 0.01 / np.sqrt(YEAR) * rng.standard_normal(n)
    elif k % 2 and k // 2 < pairs and tickers[k - 1] != benchmark:
        spread, x = np.zeros(n), 0.0
        for i, e in enumerate(0.012 * rng.standard_normal(n)):
            x = 0.85 * x + e if i else 0.0
            spread[i] = x
        return path(world, tickers, k - 1, seed, benchmark, 0) + spread
    else:
        beta, vol = rng.uniform(0.6, 1.4), rng.uniform(0.10, 0.30)
        r = beta * world.market + world.clusters[:, k % world.clusters.shape[1]] + vol / np.sqrt(YEAR) * heavy(rng, n, 4)
    return np.cumsum(np.log1p(np.clip(r, -0.45, 0.6)))


def bars(ticker: str, dates, log_price: np.ndarray, seed: int) -> pd.DataFrame:
    """Bars that a log price path closes."""
    rng, n = np.random.default_rng([seed, zlib.crc32(ticker.encode()), 1]), len(log_price)
    step = np.diff(log_price, prepend=0.0)
    sd = step.std() + 1e-9
    close = 100 * np.exp(log_price)
    start = close / np.exp(step) * np.exp(0.3 * step + 0.2 * sd * rng.standard_normal(n))
    up, down = np.exp(np.abs(rng.normal(0, 0.5 * sd, (2, n))))
    volume = rng.uniform(2e6, 2e7) * np.exp(rng.normal(0, 0.3, n)) * (1 + 20 * np.abs(np.expm1(step)))
    return pd.DataFrame(
        {
            "asset": ticker,
            "date": dates,
            "open": start,
            "high": np.maximum(start, close) * up,
            "low": np.minimum(start, close) / down,
            "close": close,
            "volume": volume,
        }
    )


def generate(
    spark: SparkSession,
    tickers: list[str],
    start: str,
    end: str | None = None,
    seed: int = 7,
    benchmark: str | None = None,
    pairs: int = 0,
    regimes: bool = True,
) -> DataFrame:
    """Bars of all tickers on weekdays from start to end."""
    end = end or str(pd.Timestamp.today().date())

    def make(batches):
        dates = pd.bdate_range(start, end).date
        world = World(len(dates), tickers, seed, regimes)
        for batch in batches:
            for k in batch["k"]:
                yield bars(tickers[k], dates, path(world, tickers, int(k), seed, benchmark, pairs), seed)

    n = min(len(tickers), spark.sparkContext.defaultParallelism)
    return spark.range(len(tickers)).withColumnRenamed("id", "k").repartition(max(1, n)).mapInPandas(make, SCHEMA)
