"""Performance of return streams: (config_id, n, date, r), one aggregation plan for all of them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import bootstrap_sharpe, probabilistic_sharpe
from ..functions.windows import SO_FAR, corr

KEY = ("config_id",)
FLAT = 1e-12


def finite(returns: DataFrame) -> DataFrame:
    return returns.filter(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") < float("inf")))


def sharpe(r: Column | str = "r", periods: int = 252, rf: float = 0.0) -> Column:
    """Yearly Sharpe ratio as an aggregate; 0 for fewer than two values or no variation."""
    sd = F.stddev_samp(r)
    return F.when(sd >= FLAT, (F.avg(r) - rf / periods) / sd * math.sqrt(periods)).otherwise(0.0)


def sortino(r: str = "r", periods: int = 252, rf: float = 0.0) -> Column:
    excess = F.col(r) - rf / periods
    down = F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), 2)))
    return F.when(down >= FLAT, F.avg(excess) / down * math.sqrt(periods)).otherwise(0.0)


def growth(r: str = "r") -> Column:
    return F.product(1 + F.col(r))


def cagr(g: Column, n: Column, periods: int) -> Column:
    return F.when(n == 0, 0.0).when(g > 0, F.pow(g, periods / n) - 1).otherwise(-1.0)


def drawdowns(returns: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Adds equity and dd, its distance from the highest so far; equity counts from after the first return."""
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(*SO_FAR)
    rows = finite(returns).withColumn("equity", F.product(1 + F.col("r")).over(w))
    return rows.withColumn("dd", F.col("equity") / F.max("equity").over(w) - 1)


def max_drawdown(returns: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, max_drawdown, peak, trough, recovery, duration_days, longest_underwater_bars)."""
    rows = drawdowns(returns, keys)
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("trough", F.min_by("n", F.struct("dd", "n")).over(w)).withColumn(
        "island",
        F.sum(F.when(F.col("dd") >= 0, 1).otherwise(0)).over(w.orderBy("n").rowsBetween(*SO_FAR)),
    )
    rows = rows.withColumn("run", F.sum(F.when(F.col("dd") < 0, 1).otherwise(0)).over(Window.partitionBy(*keys, "island")))
    on = lambda what: F.max(F.when(what, F.col("date")))
    low = F.col("n") <= F.col("trough")
    out = rows.groupBy(*keys).agg(
        (-F.min("dd")).alias("max_drawdown"),
        F.coalesce(on(low & (F.col("dd") == 0)), F.min("date")).alias("peak"),
        on(F.col("n") == F.col("trough")).alias("trough"),
        F.min(F.when((F.col("n") >= F.col("trough")) & (F.col("dd") >= 0), F.col("date"))).alias("recovery"),
        F.max("date").alias("end"),
        F.max("run").alias("longest_underwater_bars"),
    )
    return out.select(
        *keys,
        "max_drawdown",
        "peak",
        "trough",
        "recovery",
        F.datediff(F.coalesce("recovery", "end"), "peak").alias("duration_days"),
        "longest_underwater_bars",
    )


def yearly(returns: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    return finite(returns).groupBy(*keys, F.year("date").alias("year")).agg((growth() - 1).alias("r"))


def rolling_sharpe(returns: DataFrame, window: int = 252, periods: int = 252, keys: tuple[str, ...] = KEY) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(-(window - 1), 0)
    value = F.avg("r").over(w) / F.nullif(F.stddev_samp("r").over(w), F.lit(0.0)) * math.sqrt(periods)
    return returns.select(*keys, "n", "date", F.when(F.count("r").over(w) >= window, value).alias("sharpe"))


def summary(
    returns: DataFrame,
    bench: DataFrame | None = None,
    periods: int = 252,
    rf: float = 0.0,
    trades: DataFrame | None = None,
    daily: DataFrame | None = None,
    by_asset: DataFrame | None = None,
) -> DataFrame:
    """One row a configuration of two returns or more. bench: (n, r). daily and by_asset are a simulation's."""
    rows = finite(returns)
    if bench is not None:
        rows = rows.join(bench.select("n", F.col("r").alias("b")), "n", "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    rows = rows.withColumn("q05", F.percentile("r", 0.05).over(Window.partitionBy(*KEY)))
    n, root = F.count("*"), math.sqrt(periods)
    aggs = [
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        n.alias("m"),
        growth().alias("g"),
        (F.stddev_samp("r") * root).alias("ann_vol"),
        sharpe("r", periods, rf).alias("sharpe"),
        sortino("r", periods, rf).alias("sortino"),
        F.avg("r").alias("mean"),
        F.stddev_samp("r").alias("sd"),
        F.coalesce(F.skewness("r"), F.lit(0.0)).alias("skew"),
        F.coalesce(F.kurtosis("r"), F.lit(0.0)).alias("kurtosis"),
        (-F.min("q05")).alias("var_95"),
        (-F.avg(F.when(F.col("r") <= F.col("q05"), F.col("r")))).alias("cvar_95"),
        F.max("r").alias("best_day"), F.min("r").alias("worst_day"), F.avg((F.col("r") > 0).cast("int")).alias("pct_positive_days"),
    ]
    if bench is not None:
        active = F.col("r") - F.col("b")
        beta = F.coalesce(F.covar_samp("r", "b") / F.nullif(F.var_samp("b"), F.lit(0.0)), F.lit(0.0))
        flat = F.lit(rf / periods)
        aggs += [
            growth("b").alias("gb"),
            sharpe("b", periods, rf).alias("benchmark_sharpe"),
            beta.alias("beta"),
            ((F.avg("r") - flat - beta * (F.avg("b") - flat)) * periods).alias("alpha_ann"),
            F.when((F.stddev_samp("r") > 0) & (F.stddev_samp("b") > 0), corr("r", "b")).otherwise(0.0).alias("correlation"),
            (F.stddev_samp(active) * root).alias("tracking_error"),
            F.coalesce(F.avg(active) * root / F.nullif(F.stddev_samp(active), F.lit(0.0)), F.lit(0.0)).alias("information_ratio"),
        ]
    facts = rows.groupBy(*KEY).agg(*aggs).filter("m >= 2")
    years = yearly(rows).groupBy(*KEY).agg(F.avg((F.col("r") > 0).cast("int")).alias("positive_years"), F.min("r").alias("worst_year"))
    falls = max_drawdown(rows).select(*KEY, "max_drawdown", F.col("duration_days").alias("max_dd_duration_days"))
    out = facts.join(years, list(KEY)).join(falls, list(KEY)).withColumn("years", F.col("m") / periods).withColumn("total_return", F.col("g") - 1).withColumn(
        "cagr",
        cagr(F.col("g"), F.col("m"), periods),
    )
    out = out.withColumn("calmar", F.when(F.col("max_drawdown") > 0, F.col("cagr") / F.col("max_drawdown")).otherwise(0.0))
    if bench is not None:
        fall = max_drawdown(rows.select(*KEY, "n", "date", F.col("b").alias("r"))).select(*KEY, F.col("max_drawdown").alias("benchmark_max_drawdown"))
        out = out.join(fall, list(KEY)).withColumn(
            "benchmark_cagr",
            cagr(F.col("gb"), F.col("m"), periods),
        ).withColumn("excess_cagr", F.col("cagr") - F.col("benchmark_cagr")).drop("gb")
    if trades is not None:
        out = out.join(_trade_stats(trades, facts), list(KEY), "left").fillna(0, ["n_trades"])
    if daily is not None:
        inside = rows.select(*KEY, "n").join(daily, [*KEY, "n"])
        out = out.join(
            inside.groupBy(*KEY).agg(
                (F.avg("turnover") * periods).alias("annual_turnover"),
                (F.avg("cost") * periods).alias("annual_cost_drag"),
                F.max("participation").alias("max_participation"),
            ),
            list(KEY),
            "left",
        )
    if by_asset is not None:
        books = rows.select(*KEY, "n").join(by_asset, [*KEY, "n"]).groupBy(*KEY, "n").agg(
            F.sum(F.abs("exposure")).alias("x"),
            F.sum("exposure").alias("y"),
        )
        out = out.join(
            books.groupBy(*KEY).agg(
                F.avg("x").alias("avg_gross_exposure"),
                F.avg("y").alias("avg_net_exposure"),
                F.avg((F.col("x") > 1e-9).cast("int")).alias("time_in_market"),
            ),
            list(KEY),
            "left",
        )
    return out.drop("g")


def _trade_stats(trades: DataFrame, facts: DataFrame) -> DataFrame:
    """Of spells that overlap the period; rates only from ten spells on."""
    own = trades.join(facts.select(*KEY, F.col("start").alias("lo"), F.col("end").alias("hi")), list(KEY)).filter("exit >= lo and entry <= hi")
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") <= 0, F.col("pnl")).otherwise(0.0))
    enough = F.count("*") >= 10
    factor = F.when(loss < 0, gain / F.nullif(-loss, F.lit(0.0))).otherwise(float("inf"))
    return own.groupBy(*KEY).agg(
        F.count("*").alias("n_trades"),
        F.when(enough, F.avg((F.col("pnl") > 0).cast("int"))).alias("win_rate"),
        F.when(enough, factor).alias("profit_factor"),
        F.avg("bars").alias("avg_trade_bars"),
    )


def psr(row, benchmark: float = 0.0, periods: int = 252) -> float:
    """Of a summary row."""
    return probabilistic_sharpe(row["m"], row["mean"], row["sd"], row["skew"], row["kurtosis"], benchmark, periods)


def bootstrap(returns: DataFrame, periods: int = 252, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """(config_id, low, high): confidence limits of the Sharpe ratio, a configuration a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_sharpe(pdf.sort_values("n")["r"].to_numpy(), periods, n_boot, seed=seed)
        return pd.DataFrame({"config_id": [pdf["config_id"].iloc[0]], "low": [low], "high": [high]})

    return finite(returns).select("config_id", "n", "r").groupBy("config_id").applyInPandas(run, "config_id string, low double, high double")
