"""Sources of raw bars (asset, date, open, high, low, close, volume), by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import ResearchConfig
from ..operators.align import Market, market
from . import csv, synthetic, yahoo

SOURCES = {
    "yahoo": lambda spark, tickers, c: yahoo.fetch(spark, tickers, c.start, c.end, c.cache_dir),
    "csv": lambda spark, tickers, c: csv.read(spark, tickers, c.csv_dir),
    "synthetic": lambda spark, tickers, c: synthetic.generate(spark, tickers, c.start, c.end, c.seed, c.benchmark),
}


def raw_bars(spark: SparkSession, config: ResearchConfig, tickers: list[str] | None = None) -> DataFrame:
    if config.source not in SOURCES:
        raise ValueError(f"no source {config.source!r}; there are {', '.join(SOURCES)}")
    return SOURCES[config.source](spark, tickers or list(dict.fromkeys([*config.universe, config.benchmark])), config)


def load(spark: SparkSession, config: ResearchConfig) -> Market:
    """Aligned market data of a run."""
    return market(raw_bars(spark, config), config.universe, config.benchmark, config.start, config.end, source=config.source)
