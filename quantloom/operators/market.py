"""Context: regimes, the benchmark's and the universe's state, and a scan of assets at the last session."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import along, change, corr, percentile_rank, ratio, rolling, rsi, series
from .align import Market

#: Tickers of the macro series.
MACRO = {
    "^VIX": "Implied volatility of the S&P 500",
    "^TNX": "Ten-year US Treasury yield, times 10",
    "DX-Y.NYB": "US dollar index",
    "CL=F": "Crude oil",
    "GC=F": "Gold",
}


def regimes(bench: DataFrame, periods: int = 252) -> DataFrame:
    """(n, date, trend, vol) of the benchmark (n, date, close); each row uses no later one."""
    w = series()
    rows = bench.withColumn("sma", rolling(F.avg, "close", 200, w, 150)).withColumn("r", ratio(F.col("close"), F.lag("close").over(w)) - 1)
    rows = rows.withColumn("slope", F.col("sma") - F.lag("sma", 20).over(w)).withColumn("v", rolling(F.stddev_samp, "r", 21, w) * math.sqrt(periods))
    rows = rows.withColumn("pct", percentile_rank("v", 756, 252, w))
    trend = F.when(F.col("sma").isNull(), "n/a").when(
        (F.col("close") > F.col("sma")) & (F.col("slope") > 0),
        "bull",
    ).when((F.col("close") < F.col("sma")) & (F.col("slope") < 0), "bear").otherwise("sideways")
    vol = F.when(F.col("pct").isNull(), "n/a").when(F.col("pct") >= 0.67, "high vol").when(F.col("pct") <= 0.33, "low vol").otherwise("normal vol")
    return rows.select("n", "date", trend.alias("trend"), vol.alias("vol"))


def correlations(returns: DataFrame, keys: tuple[str, ...] = (), count: bool = False) -> DataFrame:
    """(keys, a, b, corr) for pairs of assets a before b, over the sessions that both have (with count, m of them). returns: (keys, asset, n, r)."""
    known = returns.filter("r is not null")
    left = known.select(*keys, "n", F.col("asset").alias("a"), F.col("r").alias("x"))
    right = known.select(*keys, "n", F.col("asset").alias("b"), F.col("r").alias("y"))
    pairs = left.join(right, [*keys, "n"]).filter("a < b").groupBy(*keys, "a", "b").agg(F.count("*").alias("m"), corr("x", "y").alias("corr"))
    return pairs.select(*keys, "a", "b", F.when(F.col("m") > 1, F.col("corr")).alias("corr"), *(["m"] if count else []))


def average_correlation(market: Market, window: int = 63, history: int = 756, step: int = 21) -> DataFrame:
    """(last, corr): the mean correlation over the `window` sessions that end at `last`; at the last session, and every `step` before it."""
    total = market.bench.count()
    ends = [total] + [e for e in range(total - history, total, step) if e > window]
    spans = market.bench.sparkSession.createDataFrame([(e,) for e in ends], "last long")
    rows = market.returns().join(F.broadcast(spans), (F.col("n") < F.col("last")) & (F.col("n") >= F.col("last") - window))
    n = len(market.assets)
    return correlations(rows.select("last", "asset", "n", "r"), ("last",)).groupBy("last").agg(
        (2 * F.sum(F.coalesce("corr", F.lit(0.0))) / (n * (n - 1))).alias("corr")
    )


def overview(market: Market, periods: int = 252) -> DataFrame:
    """One row of facts at the last session."""
    w = series()
    rows = market.bench.withColumn("r", ratio(F.col("close"), F.lag("close").over(w)) - 1)
    rows = rows.select(
        "n", "date", "close", *[change("close", k, w).alias(f"return_{m}m") for m, k in ((1, 21), (3, 63), (6, 126), (12, 252))],
        rolling(F.avg, "close", 50, w).alias("sma50"), rolling(F.avg, "close", 200, w).alias("sma200"),
        (F.col("close") / F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("drawdown_from_high"),
        (rolling(F.stddev_samp, "r", 21, w) * math.sqrt(periods)).alias("v"),
    )
    recent = Window.partitionBy(F.lit(0)).orderBy("n").rowsBetween(-755, 0)
    vols = F.collect_list("v").over(recent)
    rows = rows.withColumn("realised_vol_3y_median", _median(vols)).withColumn(
        "below",
        F.size(F.filter(vols, lambda x: x <= F.col("v"))),
    ).withColumn("rows", F.count("*").over(recent))
    last = rows.join(regimes(market.bench, periods).select("n", "trend", "vol"), "n").orderBy(F.desc("n")).limit(1)
    facts = last.select(
        F.col("date").alias("as_of"),
        F.lit(market.benchmark).alias("benchmark"),
        *[f"return_{m}m" for m in (1, 3, 6, 12)],
        (F.col("close") / F.col("sma200") - 1).alias("distance_from_200d_sma"),
        (F.col("sma50") > F.col("sma200")).alias("sma50_above_sma200"),
        "drawdown_from_high",
        F.col("v").alias("realised_vol_21d"),
        "realised_vol_3y_median",
        (F.col("below") / F.col("rows")).alias("vol_percentile_3y"),
        F.col("trend").alias("trend_regime"),
        F.col("vol").alias("vol_regime"),
    )
    if len(market.assets) < 2:
        return facts
    now = breadth(market)
    corr = average_correlation(market)
    top = F.max_by("corr", "last")
    both = corr.crossJoin(F.broadcast(corr.agg(top.alias("now"), F.max("last").alias("end"))))
    ranked = both.groupBy("now").agg(
        F.avg(F.when(F.col("last") < F.col("end"), (F.col("corr") <= F.col("now")).cast("int"))).alias("corr_percentile_3y")
    )
    return facts.crossJoin(now).crossJoin(ranked.select(F.col("now").alias("avg_pairwise_corr_63d"), "corr_percentile_3y"))


def _median(values: Column) -> Column:
    """Of an array: the mean of the middle one or two."""
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def breadth(market: Market) -> DataFrame:
    """Shares of assets above their averages at the last session, and the spread of quarterly returns."""
    w = along()
    rows = market.bars.select(
        "asset",
        "n",
        "close",
        rolling(F.avg, "close", 200, w).alias("a200"),
        rolling(F.avg, "close", 50, w).alias("a50"),
        change("close", 63, w).alias("q"),
    )
    over = lambda a: F.avg(F.coalesce((F.col("close") > F.col(a)).cast("int"), F.lit(0)))
    by_day = rows.groupBy("n").agg(
        over("a200").alias("breadth_above_200d"),
        over("a50").alias("breadth_above_50d"),
        F.stddev_samp("q").alias("dispersion_3m"),
    )
    return by_day.orderBy(F.desc("n")).limit(1).drop("n")


def interpret(f: dict) -> list[str]:
    """What the facts suggest, in sentences."""
    say = [
        {
            "bull": "The benchmark is above a rising long average: following trends and buying dips have had the better odds.",
            "bear": "The benchmark is below a falling long average: keeping capital comes before buying dips.",
        }.get(f["trend_regime"], "The benchmark's trend is unclear; trend rules tend to be whipsawed.")
    ]
    pct, corr, wide = (f.get(k) for k in ("vol_percentile_3y", "corr_percentile_3y", "breadth_above_200d"))
    if pct is not None and pct >= 0.8:
        say.append(f"Volatility is high, at the {pct:.0%} point of three years; scaled books are small.")
    elif pct is not None and pct <= 0.2:
        say.append("Volatility is low; scaled books are near full size, and a shock would hit them whole.")
    if (f.get("drawdown_from_high") or 0) < -0.15:
        say.append(f"The benchmark stands {-f['drawdown_from_high']:.0%} below its high.")
    if corr is not None and corr >= 0.75:
        say.append("Assets move together more than usual, so relative value has little to work with.")
    elif corr is not None and corr <= 0.25:
        say.append("Assets move apart more than usual, which suits relative strength and pairs.")
    if wide is not None and f["trend_regime"] == "bull" and wide < 0.5:
        say.append(f"The rise is narrow: {wide:.0%} of assets are above their long average.")
    elif wide is not None and wide > 0.8:
        say.append(f"Participation is broad: {wide:.0%} of assets are above their long average.")
    return say


def scan(market: Market, periods: int = 252, least: int = 260) -> DataFrame:
    """Signals of each asset with `least` closes or more, at the last session."""
    w = along()
    rows = rsi(market.bars, [14]).withColumn(
        "r",
        ratio(F.col("close"), F.lag("close").over(w)) - 1,
    ).withColumn("r21", change("close", 21, w)).withColumn("end", F.max("n").over(Window.partitionBy("asset")))
    # k-th last close: closes are numbered from the end, gaps left out
    known = rows.withColumn(
        "back",
        F.when(
            F.col("close").isNotNull(),
            F.sum(F.when(F.col("close").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(0, Window.unboundedFollowing)) - 1,
        ),
    )
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("close")))
    tail = lambda k: F.col("n") > F.col("end") - k
    facts = known.groupBy("asset").agg(
        F.count("close").alias("closes"), at(0).alias("c0"), at(21).alias("c21"), at(63).alias("c63"), at(126).alias("c126"), at(252).alias("c252"),
        F.stddev_samp(F.when(tail(63), F.col("r"))).alias("sd"),
        F.max(F.when(F.col("back") < 252, F.col("close"))).alias("high"),
        F.avg(F.when(F.col("back") < 200, F.col("close"))).alias("a200"),
        F.max(F.when(F.col("n") == F.col("end"), F.col("rsi_14"))).alias("rsi14"),
        F.max_by("r21", F.when(F.col("r21").isNotNull(), F.col("n"))).alias("move"),
        F.avg("r21").alias("m"),
        F.stddev_samp("r21").alias("s"),
        F.avg(F.when(tail(20), F.col("volume"))).alias("v20"), F.avg(F.when(tail(120), F.col("volume"))).alias("v120"),
    ).filter(F.col("closes") >= least)
    last = market.bench.select((change("close", 126, series())).alias("b126"), "n").orderBy(F.desc("n")).limit(1).select("b126")
    back = lambda k: F.col("c0") / F.col(f"c{k}") - 1
    out = facts.crossJoin(F.broadcast(last)).select(
        "asset",
        back(21).alias("ret_1m"),
        back(63).alias("ret_3m"),
        back(126).alias("ret_6m"),
        back(252).alias("ret_12m"),
        (back(126) - F.col("b126")).alias("rel_strength_6m"),
        (F.col("sd") * math.sqrt(periods)).alias("vol_3m"),
        (F.col("c0") / F.col("high") - 1).alias("dist_52w_high"),
        "rsi14",
        (F.col("c0") > F.col("a200")).alias("above_200d"),
        F.when(F.col("s") > 0, (F.col("move") - F.col("m")) / F.col("s")).otherwise(0.0).alias("z_1m_move"),
        F.when(F.col("v120") > 0, F.col("v20") / F.col("v120")).alias("volume_trend"),
    )
    flag = lambda when, text: F.when(when, text)
    flags = F.array_join(F.array_compact(F.array(
        flag(F.col("z_1m_move") >= 2, "unusual strength"),
        flag(F.col("z_1m_move") <= -2, "unusual weakness"),
        flag(F.col("volume_trend") >= 1.5, "volume surge"),
        flag((F.col("rsi14") < 30) & F.col("above_200d"), "oversold in uptrend"),
        flag(F.col("rsi14") > 75, "overbought"),
        flag(F.col("dist_52w_high") > -0.02, "at 52w high"),
        flag(~F.col("above_200d") & (F.col("dist_52w_high") < -0.25), "broken trend"),
    )), ", ")
    out = out.withColumn("flags", flags)
    if len(market.assets) < 2:
        return out
    ranked = (sum((_mean_rank(out, c) for c in ("ret_3m", "ret_6m", "ret_12m")), F.lit(0.0)) / 3).alias("score")
    scored = out.select("*", ranked)
    return scored.withColumn("momentum_rank", F.floor(_mean_rank(scored, "score", descending=False)).cast("int")).drop("score")


def _mean_rank(df: DataFrame, x: str, descending: bool = True) -> Column:
    """Rank with ties at their mean; the scan has a row an asset."""
    order = F.desc(x) if descending else F.asc(x)
    return F.rank().over(Window.partitionBy(F.lit(0)).orderBy(order)) + (F.count("*").over(Window.partitionBy(x)) - 1) / 2


def macro_snapshot(raw: DataFrame) -> DataFrame:
    """(series, ticker, last, change_3m, change_12m, as_of) of the macro tickers in raw bars."""
    names = raw.sparkSession.createDataFrame(list(MACRO.items()), "asset string, series string")
    rows = raw.filter(F.col("close").isNotNull() & ~F.isnan("close")).join(F.broadcast(names), "asset")
    w = Window.partitionBy("asset").orderBy(F.desc("date"))
    rows = rows.withColumn("back", F.row_number().over(w) - 1)
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("close")))
    return rows.groupBy("asset", "series").agg(at(0).alias("last"), at(63).alias("c63"), at(252).alias("c252"), F.max("date").alias("as_of")).select(
        "series",
        F.col("asset").alias("ticker"),
        "last",
        (F.col("last") / F.col("c63") - 1).alias("change_3m"),
        (F.col("last") / F.col("c252") - 1).alias("change_12m"),
        "as_of",
    )


__all__ = ["average_correlation", "breadth", "correlations", "interpret", "macro_snapshot", "overview", "regimes", "scan"]
