"""Alignment of raw bars to the benchmark's sessions, and the quality report.

raw: (asset, date, open, high, low, close, volume[, seq]); the last row of a date wins, by seq.
Aligned bars have every asset at every session: (asset, ord, n, date, open, high, low, close, volume).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import along, filled, ratio, series

FIELDS = ("open", "high", "low", "close", "volume")


@dataclass
class Market:
    """Aligned bars, the benchmark (n, date, close), and what is known about them."""

    bars: DataFrame
    bench: DataFrame
    assets: list[str]
    benchmark: str
    source: str = "unknown"
    quality: DataFrame | None = None

    @property
    def has_volume(self) -> bool:
        return bool(self.bars.agg(F.coalesce(F.bool_or(F.col("volume") > 0), F.lit(False))).first()[0])

    def returns(self) -> DataFrame:
        """(asset, n, date, r): close to close, not filled."""
        return self.bars.select("asset", "n", "date", (ratio(F.col("close"), F.lag("close").over(along())) - 1).alias("r"))

    def bench_returns(self) -> DataFrame:
        return self.bench.select("n", "date", F.coalesce(ratio(F.col("close"), F.lag("close").over(series())) - 1, F.lit(0.0)).alias("r"))

    def subset(self, assets: list[str]) -> Market:
        return Market(
            self.bars.filter(F.col("asset").isin(assets)),
            self.bench,
            [a for a in self.assets if a in assets],
            self.benchmark,
            self.source,
            self.quality,
        )

    def between(self, start=None, end=None) -> Market:
        """Sessions from start to end, both included; ordinals stay."""
        keep = lambda df: df.filter(
            (
                F.lit(True) if start is None else F.col("date") >= F.lit(start).cast("date")
            ) & (F.lit(True) if end is None else F.col("date") <= F.lit(end).cast("date"))
        )
        return Market(keep(self.bars), keep(self.bench), self.assets, self.benchmark, self.source, self.quality)

    def sessions(self) -> list:
        """Dates in order."""
        return [r.date for r in self.bench.select("date", "n").orderBy("n").collect()]


def _finite(x: str) -> Column:
    v = F.col(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def clean(raw: DataFrame) -> DataFrame:
    """Typed columns, NaN and infinities as NULL, one row an asset and date."""
    have = set(raw.columns)
    rows = raw.select(
        "asset",
        F.col("date").cast("date").alias("date"),
        *[(_finite(f) if f in have else F.lit(None).cast("double")).alias(f) for f in FIELDS],
        (F.col("seq") if "seq" in have else F.lit(0)).cast("long").alias("seq"),
    )
    # the last row of a date, by seq; rows of equal seq by value, so that reruns agree
    last = F.max_by(F.struct(*FIELDS), F.struct("seq", *FIELDS)).alias("row")
    return rows.groupBy("asset", "date").agg(last).select("asset", "date", "row.*")


def calendar(rows: DataFrame, benchmark: str, start=None, end=None) -> DataFrame:
    """The benchmark's sessions (n, date, close), filled forward without limit."""
    bench = rows.filter((F.col("asset") == benchmark) & F.col("close").isNotNull())
    if start is not None:
        bench = bench.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bench = bench.filter(F.col("date") <= F.lit(end).cast("date"))
    order = Window.partitionBy(F.lit(0)).orderBy("date")
    return bench.select((F.row_number().over(order) - 1).cast("long").alias("n"), "date", "close")


def aligned(rows: DataFrame, sessions: DataFrame, assets: DataFrame, most: int = 5) -> DataFrame:
    """All assets (asset, ord) at all sessions; closes filled over at most `most` missing sessions."""
    grid = sessions.select("n", "date").crossJoin(F.broadcast(assets))
    rows = rows.select("asset", "date", *[F.col(f).alias(f"raw_{f}") for f in FIELDS])
    grid = grid.join(rows, ["asset", "date"], "left")
    w = along()
    last_n = filled(F.when(F.col("raw_close").isNotNull(), F.col("n")), w)
    grid = grid.withColumn("close", F.when(F.col("n") - last_n <= most, filled("raw_close", w)))
    made = F.col("raw_close").isNull() & F.col("close").isNotNull()
    price = lambda f: F.when(made, F.col("close")).otherwise(F.coalesce(f"raw_{f}", "close")).alias(f)
    return grid.select(
        "asset",
        "ord",
        "n",
        "date",
        price("open"),
        price("high"),
        price("low"),
        "close",
        F.when(made, 0.0).otherwise(F.col("raw_volume")).alias("volume"),
    )


def quality_report(rows: DataFrame, sessions: DataFrame, tickers: DataFrame) -> DataFrame:
    """Facts about each ticker's raw closes within the calendar, and flags for what looks wrong. tickers: (asset)."""
    ends = sessions.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    inside = rows.join(F.broadcast(tickers), "asset").crossJoin(F.broadcast(ends)).filter(
        F.col("close").isNotNull() & F.col("date").between(F.col("lo"), F.col("hi"))
    )
    w = Window.partitionBy("asset").orderBy("date")
    inside = inside.withColumn("move", ratio(F.col("close"), F.lag("close").over(w)) - 1).withColumn(
        "flat",
        F.coalesce(F.col("close") == F.lag("close").over(w), F.lit(False)),
    )
    # a stretch of unchanged closes: the number of changes so far names it
    inside = inside.withColumn("stretch", F.sum(F.when(~F.col("flat"), 1).otherwise(0)).over(w))
    inside = inside.withColumn("run", F.sum(F.col("flat").cast("int")).over(Window.partitionBy("asset", "stretch")))
    facts = inside.groupBy("asset").agg(
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        F.count("*").alias("observations"),
        F.max(F.abs("move")).alias("max_abs_daily_move"),
        F.min("close").alias("least"),
        F.sum(F.when(F.abs("move") > 0.25, 1).otherwise(0)).alias("jumps"),
        F.max("run").alias("flat_run"),
        F.first("lo").alias("lo"),
        F.first("hi").alias("hi"),
    )
    spans = facts.select("asset", "first", "last").join(sessions.select("date"), F.col("date").between(F.col("first"), F.col("last")))
    gaps = spans.join(rows.filter("close is not null").select(
        "asset",
        "date",
        F.lit(1).alias("hit"),
    ), ["asset", "date"], "left").groupBy("asset").agg(
        F.count("*").alias("expected"),
        F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("missing_sessions"),
    )
    known = rows.select("asset").distinct().withColumn("known", F.lit(True))
    out = tickers.join(facts, "asset", "left").join(gaps, "asset", "left").join(known, "asset", "left")
    flag = lambda when, text: F.when(when, text)
    flags = F.array_compact(F.array(
        flag(F.col("least") <= 0, F.lit("prices of zero or less")),
        flag(F.col("jumps") > 0, F.concat(F.col("jumps").cast("string"), F.lit(" moves over 25%"))),
        flag(F.col("flat_run") >= 5, F.concat(F.lit("unchanged for "), F.col("flat_run").cast("string"), F.lit(" days"))),
        flag(F.datediff("first", "lo") > 30, F.concat(F.lit("starts "), F.col("first").cast("string"))),
        flag(F.datediff("hi", "last") > 7, F.concat(F.lit("ends "), F.col("last").cast("string"))),
        flag(F.col("missing_sessions") > 0.02 * F.col("expected"), F.concat(F.col("missing_sessions").cast("string"), F.lit(" sessions missing"))),
    ))
    status = F.when(F.col("known").isNull(), "missing").when(
        F.col("observations").isNull(),
        "no data in range",
    ).when(F.size(flags) > 0, "check").otherwise("ok")
    return out.select(
        "asset",
        status.alias("status"),
        "first",
        "last",
        "observations",
        F.col("missing_sessions").cast("long").alias("missing_sessions"),
        "max_abs_daily_move",
        F.when(F.col("observations").isNotNull(), F.array_join(flags, "; ")).alias("flags"),
    )


def market(
    raw: DataFrame,
    universe: list[str],
    benchmark: str,
    start=None,
    end=None,
    most: int = 5,
    source: str = "unknown",
    least_sessions: int = 300,
) -> Market:
    """Aligned market data; raises where the benchmark is missing or short, or nothing of the universe has data."""
    spark, rows = raw.sparkSession, clean(raw)
    universe = list(dict.fromkeys(universe))
    sessions = calendar(rows, benchmark, start, end).cache()
    count = sessions.count()
    have = {r.asset for r in rows.filter(F.col("asset").isin([*universe, benchmark])).select("asset").distinct().collect()}
    if benchmark not in have:
        raise ValueError(f"no data for the benchmark {benchmark!r}")
    if count < least_sessions:
        raise ValueError(f"the benchmark has {count} sessions; {least_sessions} are needed")
    assets = [a for a in universe if a in have]
    if len(assets) < len(universe):
        warnings.warn(f"no data for {sorted(set(universe) - have)}: left out", stacklevel=2)
    if not assets:
        raise ValueError("no member of the universe has data")
    order = spark.createDataFrame([(a, k) for k, a in enumerate(assets)], "asset string, ord int")
    tickers = spark.createDataFrame([(a,) for a in dict.fromkeys([*assets, benchmark])], "asset string")
    return Market(aligned(rows, sessions, order, most), sessions, assets, benchmark, source, quality_report(rows, sessions, tickers))
