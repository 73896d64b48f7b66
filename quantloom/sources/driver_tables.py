"""Daily bars from the line items of a TPC-H-like schema: an asset for each return flag and status, and all of them as the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.align import Market, aligned, quality_report

BENCHMARK = "ALL"


def _bars(rows: DataFrame, *keys: str) -> DataFrame:
    price = lambda x: 100 * F.pow(x, F.lit(0.05))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return rows.groupBy(*keys, "date").agg(
        price(F.min_by(unit, F.struct(F.col("l_orderkey"), F.col("l_linenumber"), unit))).alias("open"),
        price(F.max(unit)).alias("high"),
        price(F.min(unit)).alias("low"),
        price(
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
        ).alias("close"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("volume"),
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, date, open, high, low, close, volume): damped prices a unit, so that returns are of a usable size."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.concat("l_returnflag", "l_linestatus").alias("asset"),
        F.col("l_shipdate").cast("date").alias("date"),
    )
    whole = _bars(rows).select(F.lit(BENCHMARK).alias("asset"), "date", "open", "high", "low", "close", "volume")
    return _bars(rows, "asset").unionByName(whole)


def load(spark: SparkSession, sf_dir: str) -> Market:
    """Aligned bars; sessions are all ship dates, and assets are in alphabetic order."""
    rows = raw(spark, sf_dir).cache()
    days = rows.filter(F.col("asset") == BENCHMARK)
    bench = days.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).cast("long").alias("n"), "date", "close").cache()
    names = sorted(r.asset for r in rows.select("asset").distinct().collect() if r.asset != BENCHMARK)
    order = spark.createDataFrame([(a, k) for k, a in enumerate(names)], "asset string, ord int")
    tickers = spark.createDataFrame([(a,) for a in [*names, BENCHMARK]], "asset string")
    bars = aligned(rows, bench, order).repartition("asset").cache()
    return Market(bars, bench, names, BENCHMARK, "driver tables", quality_report(rows, bench, tickers))
