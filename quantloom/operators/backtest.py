"""Portfolio simulation of target weights, net of costs, as window expressions.

Between two fills, holdings only drift: with weights w0 at the fill and growth C of each asset since, the
book has grown to V = 1 + sum(w0 * (C - 1)) and the weights are w0 * C / V. So growth, exposure and the
sizes of fills come from running products and sums over windows. Only equity is recursive, since
market impact depends on it; that is one scalar a session and configuration, a pandas group of daily rows.

All configurations run in one plan. For a universe of up to ONE_TASK assets it is dealt by configuration, and windows
along assets and across them need no further shuffle; a larger one is dealt by (configuration, asset) and by (configuration,
session) in turn, so that no task holds a whole configuration. Fills are at the next open, the next close, or (optimistic) the same close.

Targets (config_id, asset, n, w) must have every asset at every session; a NULL target or price is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CostModel
from ..functions.windows import SO_FAR, across, along, filled, ratio, rolling
from .align import Market

#: Up to so many assets a configuration (all of its sessions) is one task's work.
ONE_TASK = 500
EXECUTIONS = ("next_open", "next_close", "same_close")
KEY = ("config_id",)
CHANGED, LIVE, SPELL = 1e-12, 1e-12, 1e-9


@dataclass(frozen=True)
class Settings:
    costs: CostModel
    execution: str = "next_open"
    capital: float = 1_000_000.0
    risk_free_rate: float = 0.0
    periods: int = 252

    def but(self, **changes) -> Settings:
        return replace(self, **changes)


@dataclass
class Simulation:
    """daily (config_id, n, ret, gross, cost, turnover, participation, held, equity), and per asset exposure and contribution.

    held is equity before the session, equity after it; both start from 1.
    """

    daily: DataFrame
    by_asset: DataFrame | None


def dealt(rows: DataFrame, n_assets: int) -> DataFrame:
    """Rows by configuration where one is small; else as they are, and each window deals them by its own keys."""
    return rows.repartition("config_id") if n_assets <= ONE_TASK else rows


def inputs(market: Market) -> DataFrame:
    """Return legs, and volatility and traded value known before each session."""
    w = along()
    last = F.lag("close").over(w)
    leg = lambda a, b: F.coalesce(ratio(a, b) - 1, F.lit(0.0))
    rows = market.bars.select(
        "asset",
        "ord",
        "n",
        "close",
        "volume",
        leg(F.col("close"), last).alias("r_cc"),
        leg(F.col("open"), last).alias("r_on"),
        leg(F.col("close"), F.col("open")).alias("r_id"),
    )
    rows = rows.withColumn("sd", rolling(F.stddev_samp, "r_cc", 21, w, 10)).withColumn(
        "value",
        rolling(F.avg, F.col("close") * F.coalesce("volume", F.lit(0.0)), 20, w, 5),
    )
    return rows.select(
        "asset",
        "n",
        F.col("close").isNotNull().alias("priced"),
        "r_cc",
        "r_on",
        "r_id",
        F.coalesce(F.lag("sd").over(w), F.lit(0.02)).alias("sigma"),
        F.lag("value").over(w).alias("adv"),
    )


def _positions(rows: DataFrame, execution: str) -> DataFrame:
    """Adds exposure, end (weight after the session), gross legs g1 and g2, contribution, and delta of fills."""
    along_, across_ = along(*KEY), across(*KEY)
    lag = lambda x: F.lag(x).over(along_)
    rows = rows.withColumn("w", F.when(F.col("priced"), F.coalesce("w", F.lit(0.0))).otherwise(0.0))
    moved = F.abs(F.col("w") - F.coalesce(lag("w"), F.lit(0.0))) > F.when(F.col("n") == F.col("n0"), 0.0).otherwise(CHANGED)
    rows = rows.withColumn("changed", F.max(moved).over(across_))
    late = execution != "same_close"
    rows = rows.withColumn(
        "fill",
        F.coalesce(lag("changed"), F.lit(False)) if late else F.col("changed"),
    ).withColumn("target", lag("w") if late else F.col("w"))
    rows = rows.withColumn("segment", F.sum(F.col("fill").cast("int")).over(along_.rowsBetween(*SO_FAR)))
    rows = rows.withColumn("w0", F.coalesce(filled(F.when(F.col("fill"), F.col("target")), along_), F.lit(0.0)))
    within = Window.partitionBy(*KEY, "asset", "segment").orderBy("n")
    product = lambda x: F.product(x).over(within.rowsBetween(*SO_FAR))
    book = lambda c: 1 + F.sum(F.col("w0") * (F.col(c) - 1)).over(across_)
    if execution == "next_open":
        rows = rows.withColumn("b", product(F.when(F.col("fill"), 1 + F.col("r_id")).otherwise((1 + F.col("r_on")) * (1 + F.col("r_id")))))
        rows = rows.withColumn("a", F.when(F.col("fill"), 1.0).otherwise(F.coalesce(F.lag("b").over(within), F.lit(1.0)) * (1 + F.col("r_on"))))
        rows = rows.withColumn("va", book("a")).withColumn("vb", book("b"))
        rows = rows.withColumn(
            "exposure",
            F.col("w0") * F.col("a") / F.nullif("va", F.lit(0.0)),
        ).withColumn("end", F.col("w0") * F.col("b") / F.nullif("vb", F.lit(0.0)))
        rows = rows.withColumn("start", F.coalesce(lag("end"), F.lit(0.0)))
        rows = rows.withColumn(
            "g1",
            F.sum(F.col("start") * F.col("r_on")).over(across_),
        ).withColumn("g2", F.col("vb") / F.nullif("va", F.lit(0.0)) - 1)
        rows = rows.withColumn("contribution", F.col("start") * F.col("r_on") + F.col("exposure") * F.col("r_id"))
        drifted = F.col("start") * (1 + F.col("r_on")) / F.nullif(1 + F.col("g1"), F.lit(0.0))
    else:
        rows = rows.withColumn("b", product(F.when(F.col("fill"), 1.0).otherwise(1 + F.col("r_cc")))).withColumn("vb", book("b"))
        rows = rows.withColumn(
            "end",
            F.col("w0") * F.col("b") / F.nullif("vb", F.lit(0.0)),
        ).withColumn("exposure", F.coalesce(lag("end"), F.lit(0.0)))
        rows = rows.withColumn(
            "g1",
            F.sum(F.col("exposure") * F.col("r_cc")).over(across_),
        ).withColumn("g2", F.lit(0.0)).withColumn("contribution", F.col("exposure") * F.col("r_cc"))
        drifted = F.col("exposure") * (1 + F.col("r_cc")) / F.nullif(1 + F.col("g1"), F.lit(0.0))
    return rows.withColumn("delta", F.when(F.col("fill"), F.col("target") - F.coalesce(drifted, F.lit(0.0))).otherwise(0.0))


def _equity(settings: Settings):
    """Runs one configuration's days: impact takes the square root of equity at the close before."""
    rf = settings.risk_free_rate / settings.periods
    early = settings.execution == "same_close"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        equity, out, scale = 1.0, [], float(pdf["scale"].iloc[0])
        spread, borrow = (scale * x / 1e4 / settings.periods for x in (settings.costs.financing_spread_bps, settings.costs.borrow_bps))
        for k, d in enumerate(pdf.itertuples(index=False)):
            if equity <= 0 or (k == 0 and not early):
                out.append((0.0, 0.0, 0.0, 0.0, 0.0, equity, equity))
                continue
            held = equity
            cost = scale * (d.linear + d.impact * held**0.5)
            growth = (1 + d.g1) * (1 - cost) * (1 + d.g2) if k else 1 - cost
            gross = (growth / (1 - cost) - 1 if cost < 1 else -1.0) if k else 0.0
            if k:
                growth *= 1 + d.cash * (rf if d.cash >= 0 else rf + spread) - borrow * d.short
            equity *= growth
            out.append((growth - 1 if equity > 0 else -1.0, gross, cost, d.turnover, d.share * held, held, equity))
        return pdf[["config_id", "n"]].assign(
            **dict(zip(("ret", "gross", "cost", "turnover", "participation", "held", "equity"), map(list, zip(*out, strict=True)), strict=True))
        )

    return run


def simulate(targets: DataFrame, market: Market, settings: Settings, features: DataFrame | None = None, scales: tuple[int, ...] = ()) -> Simulation:
    """Simulates all configurations of the targets.

    With scales, each at these multiples of the costs, under the id `configuration|x<scale>`: fills and weights do not depend on
    costs, so they are shared, and only equity differs. Contributions are those of the costs as they are, and left out.
    """
    if settings.execution not in EXECUTIONS:
        raise ValueError(f"execution is one of {EXECUTIONS}")
    costs = settings.costs
    features = inputs(market) if features is None else features
    rows = dealt(targets.select("config_id", "asset", "n", "w").join(features, ["asset", "n"]), len(market.assets))
    # targets have every asset at every session, so an asset's first session is the configuration's
    rows = rows.withColumn("n0", F.min("n").over(along(*KEY).rowsBetween(*SO_FAR)))
    rows = _positions(rows, settings.execution)
    size = F.abs("delta")
    value = F.when((F.col("adv") > 0), F.col("adv"))
    impact = F.lit(0.0)
    if costs.impact_coef > 0:
        impact = F.coalesce(size * costs.impact_coef * F.col("sigma") * F.sqrt(size * settings.capital / value), F.lit(0.0))
    rows = rows.withColumn(
        "linear",
        F.when(F.col("delta") > 0, F.col("delta") * costs.buy_rate).otherwise(-F.col("delta") * costs.sell_rate),
    ).withColumn("impact", impact).withColumn("size", size)
    rows = rows.select(
        "config_id",
        "asset",
        "n",
        "exposure",
        "end",
        "contribution",
        "g1",
        "g2",
        "linear",
        "impact",
        "size",
        (size * settings.capital / value).alias("share"),
    )
    days = rows.groupBy("config_id", "n").agg(
        F.first("g1").alias("g1"),
        F.first("g2").alias("g2"),
        F.sum("linear").alias("linear"),
        F.sum("impact").alias("impact"),
        F.sum("size").alias("turnover"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("share"),
        (1 - F.sum("end")).alias("cash"), F.sum(F.greatest(F.lit(0.0), -F.col("end"))).alias("short"),
    )
    if scales:
        several = days.sparkSession.createDataFrame([(float(k), f"|x{k}") for k in scales], "scale double, mark string")
        days = days.crossJoin(F.broadcast(several)).withColumn("config_id", F.concat("config_id", "mark")).drop("mark")
    else:
        days = days.withColumn("scale", F.lit(1.0))
    kinds = "config_id string, n long, ret double, gross double, cost double, turnover double, participation double, held double, equity double"
    daily = days.groupBy("config_id").applyInPandas(_equity(settings), kinds)
    return Simulation(daily, None if scales else _attributed(rows, daily))


def _attributed(rows: DataFrame, daily: DataFrame) -> DataFrame:
    """(config_id, asset, n, exposure, contribution): costs of a fill go where the position is live: there, on the next session, else on the one before."""
    w = along(*KEY)
    rows = rows.join(daily.select("config_id", "n", "held"), ["config_id", "n"]).withColumn(
        "paid",
        F.col("linear") + F.col("impact") * F.sqrt(F.greatest("held", F.lit(0.0))),
    )
    rows = rows.withColumn("live", F.abs("exposure") > LIVE).withColumn("stray", ~F.col("live") & (F.col("paid") != 0))
    no = F.lit(False)
    ahead = F.col("stray") & F.coalesce(F.lead("live").over(w), no)
    rows = rows.withColumn("ahead", ahead).withColumn("back", F.col("stray") & ~ahead & F.coalesce(F.lag("live").over(w), no))
    paid = lambda flag: F.when(F.col(flag), F.col("paid")).otherwise(0.0)
    here = F.when(F.col("ahead") | F.col("back"), 0.0).otherwise(F.col("paid"))
    cost = here + F.coalesce(F.lag(paid("ahead")).over(w), F.lit(0.0)) + F.coalesce(F.lead(paid("back")).over(w), F.lit(0.0))
    return rows.select("config_id", "asset", "n", "exposure", (F.col("contribution") - cost).alias("contribution"))


def trades(by_asset: DataFrame, sessions: DataFrame) -> DataFrame:
    """Spells of one sign of exposure: (config_id, asset, direction, entry, exit, bars, avg_weight, pnl)."""
    w = along(*KEY)
    sign = F.when(F.abs("exposure") > SPELL, F.signum("exposure")).otherwise(0.0)
    rows = by_asset.withColumn("sign", sign)
    rows = rows.withColumn(
        "spell",
        F.sum(F.when(F.col("sign") != F.coalesce(F.lag("sign").over(w), F.lit(0.0)), 1).otherwise(0)).over(w.rowsBetween(*SO_FAR)),
    ).filter("sign != 0")
    rows = rows.join(F.broadcast(sessions.select("n", "date")), "n")
    spells = rows.groupBy("config_id", "asset", "spell", "sign").agg(
        F.min("date").alias("entry"),
        F.max("date").alias("exit"),
        F.count("*").cast("int").alias("bars"),
        F.avg(F.abs("exposure")).alias("avg_weight"),
        F.sum("contribution").alias("pnl"),
    )
    return spells.select(
        "config_id",
        "asset",
        F.when(F.col("sign") > 0, "long").otherwise("short").alias("direction"),
        "entry",
        "exit",
        "bars",
        "avg_weight",
        "pnl",
    )


def buy_and_hold(market: Market, config_id: str = "buy_and_hold") -> DataFrame:
    """Targets of equal weights from the first session with all prices (the first one, if there is none)."""
    whole = market.bars.groupBy("n").agg(F.count("close").alias("k")).agg(
        F.coalesce(F.min(F.when(F.col("k") == len(market.assets), F.col("n"))), F.min("n")).alias("first")
    )
    rows = market.bars.crossJoin(F.broadcast(whole))
    return rows.select(
        F.lit(config_id).alias("config_id"),
        "asset",
        "ord",
        "n",
        F.when(F.col("n") >= F.col("first"), 1.0 / len(market.assets)).otherwise(0.0).alias("w"),
    )
