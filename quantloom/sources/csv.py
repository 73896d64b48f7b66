"""A folder of one CSV file per ticker: headers in any case, adjusted closes applied to the whole bar."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import FIELDS

DATES = ("date", "datetime", "timestamp", "time")
SCHEMA = "asset string, date date, open double, high double, low double, close double, volume double, seq long"


def safe_name(ticker: str) -> str:
    """A ticker as a file name: letters, digits, - _ . stay."""
    return re.sub(r"[^\w\-.]", "_", ticker)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_file(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """One file; columns differ between files, so each has its own projection."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    have = set(df.columns)
    day = next((c for c in DATES if c in have), None)
    if day is None or "close" not in have:
        raise ValueError(f"{path}: a date and a close column are needed")
    number = lambda c: F.col(c).try_cast("double")
    ratio = F.try_divide(number("adj_close"), number("close")) if "adj_close" in have else F.lit(1.0)
    close = number("adj_close") if "adj_close" in have else number("close")
    price = lambda c: (number(c) * ratio if c in have else close).alias(c)
    volume = (number("volume") if "volume" in have else F.lit(None).cast("double")).alias("volume")
    return df.select(
        F.lit(ticker).alias("asset"),
        F.substring(day, 1, 10).cast("date").alias("date"),
        price("open"),
        price("high"),
        price("low"),
        close.alias("close"),
        volume,
        F.monotonically_increasing_id().alias("seq"),
    )


def read(spark: SparkSession, tickers: list[str], folder: str) -> DataFrame:
    """Bars of all tickers that have a file, under their own or their safe name."""
    out = spark.createDataFrame([], SCHEMA)
    for t in tickers:
        path = next((p for p in (f"{folder}/{t}.csv", f"{folder}/{safe_name(t)}.csv") if _exists(spark, p)), None)
        if path is None:
            warnings.warn(f"no CSV file for {t} in {folder}", stacklevel=2)
        else:
            out = out.unionByName(read_file(spark, path, t))
    return out


def write(bars: DataFrame, folder: str) -> None:
    """One folder of CSV parts an asset."""
    bars.select("asset", "date", *FIELDS).write.mode("overwrite").partitionBy("asset").option("header", True).csv(folder)
