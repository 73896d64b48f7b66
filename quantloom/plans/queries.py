"""Queries over the driver's tables (bars from line items), and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COSTS, ResearchConfig
from ..functions.windows import rsi
from ..operators import market as context
from ..operators import metrics
from ..operators.backtest import Settings, buy_and_hold, inputs, simulate, trades
from ..sources import driver_tables
from . import validation
from .research import Research, blend, plan_windows
from .stages import written
from .strategies import STRATEGIES, formations, overlay

PERIODS = 365
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, so that orders of addition do not show."""
    return df.select(*[F.round(c, DIGITS).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _market(spark: SparkSession, sf_dir: str):
    return driver_tables.load(spark, sf_dir)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(driver_tables.raw(spark, sf_dir))


def aligned_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_market(spark, sf_dir).bars)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        _market(spark, sf_dir).quality.select("asset", "status", "first", "last", "observations", "missing_sessions", "max_abs_daily_move", "flags")
    )


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_market(spark, sf_dir).returns())


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.regimes(_market(spark, sf_dir).bench, PERIODS)


def breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(context.breadth(_market(spark, sf_dir)))


def avg_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(context.average_correlation(_market(spark, sf_dir)))


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(context.overview(_market(spark, sf_dir), PERIODS))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(context.scan(_market(spark, sf_dir), PERIODS))


def rsi_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rsi(_market(spark, sf_dir).bars, [14]).select("asset", "n", "rsi_14"))


def _weights(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(STRATEGIES[name].targets(_market(spark, sf_dir)).select("asset", "n", "w"))

    return query


def _overlaid(base: str, kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(overlay(STRATEGIES[base], kind).targets(_market(spark, sf_dir)).select("asset", "n", "w"))

    return query


def grid_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configuration of the grids of two strategies."""
    return rounded(validation.grid_targets([STRATEGIES["low_vol"], STRATEGIES["xs_momentum"]], _market(spark, sf_dir))[0])


def _simulated(spark: SparkSession, sf_dir: str, execution: str = "next_open", names=("trend_tsmom", "vol_managed", "xs_momentum")):
    m = _market(spark, sf_dir)
    books = validation._union([STRATEGIES[s].targets(m, ids=[s]) for s in names] + [buy_and_hold(m)])
    return m, simulate(books, m, Settings(COSTS["us_etf"], execution, periods=PERIODS))


def _bt(execution: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(_simulated(spark, sf_dir, execution)[1].daily)

    return query


def trade_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, sim = _simulated(spark, sf_dir)
    return rounded(trades(sim.by_asset, m.bench))


def _benchmark(spark: SparkSession, sf_dir: str):
    m = _market(spark, sf_dir)
    return m, m.bench_returns().withColumn("config_id", F.lit("benchmark"))


def metrics_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, r = _benchmark(spark, sf_dir)
    got = metrics.summary(r, None, PERIODS)
    return rounded(
        got.select(
            "config_id", "m", "total_return", "cagr", "ann_vol", "sharpe", "sortino", "max_drawdown", "skew", "kurtosis",
            "var_95", "cvar_95", "best_day", "worst_day", "pct_positive_days", "positive_years", "worst_year",
        )
    )


def metrics_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset's returns against the benchmark."""
    m = _market(spark, sf_dir)
    r = m.returns().select(F.col("asset").alias("config_id"), "n", "date", "r")
    got = metrics.summary(r, m.bench_returns(), PERIODS)
    return rounded(got.select("config_id", "m", "ann_vol", "sharpe", "beta", "correlation", "alpha_ann", "tracking_error", "information_ratio"))


def metrics_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, sim = _simulated(spark, sf_dir)
    daily, by_asset = written(sim.daily), written(sim.by_asset)
    return rounded(metrics.summary(validation.dated(daily, m.bench), m.bench_returns(), PERIODS, 0.0, trades(by_asset, m.bench), daily, by_asset))


def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.max_drawdown(_benchmark(spark, sf_dir)[1]))


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.yearly(_benchmark(spark, sf_dir)[1]))


def rolling_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rolling_sharpe(_benchmark(spark, sf_dir)[1], 252, PERIODS).select("n", "sharpe"))


def drawdown_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.drawdown_episodes(_benchmark(spark, sf_dir)[1], least=0.01))


def regime_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    r = m.returns().select(F.col("asset").alias("config_id"), "n", F.coalesce("r", F.lit(0.0)).alias("r"))
    return rounded(validation.regime_breakdown(r, m.bench_returns(), context.regimes(m.bench, PERIODS), PERIODS, 0.0))


def _config(m, **more) -> ResearchConfig:
    return ResearchConfig("driver tables", m.assets, m.benchmark, source="driver tables", cost_preset="us_etf", periods_per_year=PERIODS, **more)


def _grid(spark: SparkSession, sf_dir: str, names=("low_vol", "vol_managed")):
    m = _market(spark, sf_dir)
    strategies = [STRATEGIES[n] for n in names]
    targets, sets = validation.grid_targets(strategies, m)
    targets = written(targets)
    daily = written(simulate(targets, m, Settings(COSTS["us_etf"], periods=PERIODS)).daily)
    return m, strategies, targets, sets, validation.dated(daily, m.bench), plan_windows(m.sessions(), _config(m))


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, _, r, w = _grid(spark, sf_dir)
    return rounded(validation.sensitivity(r, w["start"], w["split"], PERIODS, 0.0))


def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, _, r, w = _grid(spark, sf_dir)
    return rounded(validation.robustness(validation.sensitivity(r, w["start"], w["split"], PERIODS, 0.0)))


def _books(spark: SparkSession, sf_dir: str):
    m, strategies, targets, sets, r, w = _grid(spark, sf_dir)
    spans = {str(k): (x["train_start"], x["train_end"]) for k, x in enumerate(w["wf"])}
    score = {(x.config_id, x.win): x.sharpe for x in validation.windowed(r, spans, PERIODS, 0.0).collect()}
    choices = []
    for s in strategies:
        near = validation.neighbours(sets[s.name], s.grid)
        for k, x in enumerate(w["wf"]):
            j = validation.plateau([score.get((f"{s.name}#{i:02d}", str(k)), 0.0) for i in range(len(sets[s.name]))], near)
            choices.append((s.name, f"{s.name}#{j:02d}", x["test_start"], x["test_end"]))
    return m, written(validation.stitched(targets, choices, m.bench)), choices, w


def select_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_books(spark, sf_dir)[2], "strategy string, config_id string, test_start date, test_end date")


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, books, _, w = _books(spark, sf_dir)
    daily = simulate(books, m, Settings(COSTS["us_etf"], periods=PERIODS)).daily
    return rounded(validation.dated(daily, m.bench, validation.first_day(w["wf"])))


def stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, books, _, w = _books(spark, sf_dir)
    s, start, features = Settings(COSTS["us_etf"], periods=PERIODS), validation.first_day(w["wf"]), written(inputs(m))
    base = validation.dated(simulate(books, m, s, features).daily, m.bench, start)
    return rounded(validation.stress(books, m, s, start, base, features))


def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, books, _, w = _books(spark, sf_dir)
    sim = simulate(books, m, Settings(COSTS["us_etf"], periods=PERIODS))
    return rounded(validation.concentration(validation.contributions(sim.by_asset, m.bench, validation.first_day(w["wf"]))))


def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratios of the walk-forward books with the weights of one of their largest assets at 0."""
    m, books, _, w = _books(spark, sf_dir)
    s, start, features = Settings(COSTS["us_etf"], periods=PERIODS), validation.first_day(w["wf"]), written(inputs(m))
    pnl = written(validation.contributions(simulate(books, m, s, features).by_asset, m.bench, start))
    rows = validation.dated(simulate(validation.leave_one_out(books, pnl), m, s, features).daily, m.bench, start)
    return rounded(rows.groupBy("config_id").agg(metrics.sharpe("r", PERIODS).alias("sharpe")))


def crises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset's return over the benchmark's deepest falls."""
    m = _market(spark, sf_dir)
    r = m.returns().select(F.col("asset").alias("config_id"), "n", "date", F.coalesce("r", F.lit(0.0)).alias("r"))
    return rounded(validation.crises(r, m.bench_returns(), False, m.sessions()[0], least=0.01))


def lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest change of a strategy's targets where its history is cut off."""
    found = validation.lookahead(STRATEGIES.values(), _market(spark, sf_dir))
    return spark.createDataFrame(
        [(k, v["passed"], v["max_abs_diff"]) for k, v in found.items()],
        "strategy string, passed boolean, max_abs_diff double",
    )


def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each asset's returns: the probability of a Sharpe ratio above 0, and bootstrap limits of the ratio."""
    r = _market(spark, sf_dir).returns().select(F.col("asset").alias("config_id"), "n", "date", "r")
    rows = [(x["config_id"], metrics.psr(x, 0.0, PERIODS)) for x in metrics.summary(r, None, PERIODS).collect()]
    return rounded(spark.createDataFrame(rows, "config_id string, psr double").join(metrics.bootstrap(r, PERIODS, 200, 7), "config_id"))


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, sim = _simulated(spark, sf_dir)
    return rounded(blend(validation.dated(sim.daily, m.bench), 4))


def formation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(formations(_market(spark, sf_dir), 252, 63, 3, -3.0))


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A research run without the overlay round (iterate=False), so without its rows and their trials in deflated Sharpe ratios."""
    m = _market(spark, sf_dir)
    found = Research(spark, _config(m, iterate=False), m, log=lambda _: None).run().ranking
    kinds = "rank int, strategy string, status string, score double, wf_sharpe double, wf_cagr double, wf_max_dd double, benchmark_sharpe double, dsr double, psr double, robustness double, cost_x2_sharpe double, annual_turnover double, main_issue string"
    return rounded(spark.createDataFrame(found, kinds))


QUERIES = {
    "bars": bars, "aligned_bars": aligned_bars, "quality": quality, "returns": returns, "regimes": regimes, "breadth": breadth,
    "avg_corr": avg_corr, "overview": overview, "scan": scan, "rsi": rsi_14,
    **{f"weights_{s}": _weights(s) for s in STRATEGIES},
    "overlay_regime": _overlaid("vol_managed", "regime"), "overlay_voltarget": _overlaid("xs_momentum", "voltarget"),
    "grid_weights": grid_weights, "formation_pairs": formation_pairs,
    **{f"bt_daily_{e}": _bt(e) for e in ("next_open", "next_close", "same_close")},
    "trades": trade_spells, "metrics_benchmark": metrics_benchmark, "metrics_assets": metrics_assets, "metrics_books": metrics_books,
    "drawdown": drawdown, "yearly": yearly, "rolling_sharpe": rolling_sharpe, "drawdown_episodes": drawdown_episodes,
    "regime_breakdown": regime_breakdown, "sensitivity": sensitivity, "robustness": robustness, "select_params": select_params,
    "walk_forward": walk_forward, "stress": stress, "concentration": concentration, "leave_one_out": leave_one_out, "crises": crises,
    "lookahead": lookahead, "significance": significance, "blend": blended, "ranking": ranking,
}
