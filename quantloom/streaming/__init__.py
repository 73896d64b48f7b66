"""Bars as a stream: the last row of each asset and date within the watermark, for the batch operators to read.

An addition: batch runs need none of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.align import FIELDS


def latest_bars(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """One row an asset and date from (asset, date, open, high, low, close, volume, ts): the row of the latest ts; later ones than `delay` are left out."""
    rows = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "asset", "date")
    return rows.agg(F.max_by(F.struct(*FIELDS), "ts").alias("b"), F.max("ts").alias("ts")).select("asset", "date", "b.*", F.unix_micros("ts").alias("seq"))
