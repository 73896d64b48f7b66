"""Yahoo daily bars as a Spark data source, one partition a ticker, with a Parquet cache.

The client is imported by the tasks that need it; a test can pass its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .csv import safe_name

SCHEMA = "asset string, date date, open double, high double, low double, close double, volume double"
FRESH_S = 12 * 3600


def _client(ticker: str, start: str, end: str | None) -> pd.DataFrame:
    try:
        import yfinance
    except ImportError as e:
        raise RuntimeError("the yahoo source needs the package yfinance") from e
    return yfinance.download([ticker], start=start, end=end, auto_adjust=True, actions=False, progress=False, group_by="ticker")


def rows(frame: pd.DataFrame | None, ticker: str) -> list[tuple]:
    """Bars of a downloaded frame: plain or two-level columns, in any case; rows without a close are left out."""
    if frame is None or frame.empty:
        return []
    if isinstance(frame.columns, pd.MultiIndex):
        if ticker not in frame.columns.get_level_values(0):
            return []
        frame = frame[ticker]
    frame = frame.rename(columns=lambda c: str(c).lower())
    out = []
    for stamp, r in frame.iterrows():
        values = [None if pd.isna(v := r.get(f)) else float(v) for f in ("open", "high", "low", "close", "volume")]
        if values[3] is not None:
            out.append((ticker, pd.Timestamp(stamp).tz_localize(None).date(), *values))
    return out


class Ticker(InputPartition):
    def __init__(self, name: str):
        self.name = name


class YahooReader(DataSourceReader):
    def __init__(self, options: dict, client: Callable):
        self.options, self.client = options, client

    def partitions(self):
        return [Ticker(t) for t in self.options["tickers"].split(",")]

    def read(self, partition):
        yield from rows(self.client(partition.name, self.options["start"], self.options.get("end") or None), partition.name)


class YahooSource(DataSource):
    client = staticmethod(_client)

    @classmethod
    def name(cls):
        return "quantloom_yahoo"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return YahooReader(dict(self.options), type(self).client)


def fetch(spark: SparkSession, tickers: list[str], start: str, end: str | None, cache_dir: str, client: Callable | None = None) -> DataFrame:
    """Bars of the tickers. A cached ticker with a fixed end stays; an open one is fresh for twelve hours."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = {t: f"{cache_dir}/{safe_name(t)}_{start}_{end or 'latest'}" for t in tickers}

    def fresh(p: str) -> bool:
        store, done = fs_path(p).getFileSystem(conf), fs_path(f"{p}/_SUCCESS")
        return store.exists(done) and (end is not None or time.time() - store.getFileStatus(done).getModificationTime() / 1000 < FRESH_S)

    todo = [t for t in tickers if not fresh(path[t])]
    if todo:
        kind = type("Source", (YahooSource,), {"client": staticmethod(client)}) if client else YahooSource
        spark.dataSource.register(kind)
        got = spark.read.format("quantloom_yahoo").options(tickers=",".join(todo), start=start, end=end or "").load().cache()
        if got.isEmpty():
            raise RuntimeError(f"no data for {todo}: check tickers and network")
        have = {r.asset for r in got.select("asset").distinct().collect()}
        for t in have:
            got.filter(got.asset == t).coalesce(1).write.mode("overwrite").parquet(path[t])
        got.unpersist()
        path = {t: p for t, p in path.items() if t in have or t not in todo}
    return spark.read.schema(SCHEMA).parquet(*path.values())
