"""A research run: load, context, grids, walk-forward, verdicts, overlays, ranking, selection, blend."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import sources
from ..config import ResearchConfig, cost_model
from ..functions.stats import expected_best
from ..functions.windows import rolling
from ..operators import market as context
from ..operators import metrics
from ..operators.align import Market
from ..operators.backtest import Settings, buy_and_hold, inputs, simulate, trades
from . import evaluation, validation
from .stages import written
from .strategies import STRATEGIES, Strategy, overlay


@dataclass
class Result:
    config: ResearchConfig
    market: Market
    windows: dict
    overview: dict
    scan: pd.DataFrame
    macro: pd.DataFrame | None = None
    strategies: dict[str, dict] = field(default_factory=dict)
    skipped: list[tuple[str, str]] = field(default_factory=list)
    baseline: dict = field(default_factory=dict)
    benchmark: dict = field(default_factory=dict)
    ranking: pd.DataFrame | None = None
    selected: list[str] = field(default_factory=list)
    left_out: dict[str, str] = field(default_factory=dict)
    blend: dict | None = None
    log: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    n_trials: int = 0
    sr_std: float = 0.0
    returns: DataFrame | None = None
    seconds: float = 0.0


def plan_windows(days: list, config: ResearchConfig) -> dict:
    """Start of evaluation after a warm-up, split into samples, and walk-forward windows, shorter ones for a short history."""
    warm = min(300, len(days) // 4)
    start, split = days[warm], days[warm + int((len(days) - warm) * (1 - config.oos_fraction))]
    years = (days[-1] - start).days / 365.25
    train, test = config.wf_train_years, config.wf_test_years
    short = years < train + 2 * test
    if short:
        train, test = max(1.0, round(0.4 * years, 1)), max(0.25, round(0.15 * years, 2))
    windows = validation.walk_forward_windows(days, start, train, test, config.wf_anchored)
    if not windows:
        raise ValueError("the history is too short for a walk-forward")
    return {"start": start, "split": split, "wf": windows, "train_years": train, "test_years": test, "short": short}


class Research:
    def __init__(self, spark, config: ResearchConfig, market: Market | None = None, log: Callable[[str], None] = print):
        self.spark, self.config, self.log = spark, config, log
        self.market = market or sources.load(spark, config)
        self.settings = Settings(cost_model(config.cost_preset), config.execution, config.capital, config.risk_free_rate, config.periods_per_year)

    def run(self) -> Result:
        began, c, m = time.time(), self.config, self.market
        m.bars = written(m.bars)
        periods = c.periods_per_year
        self.features = written(inputs(m))
        self.bench = written(m.bench_returns())
        self.regimes = written(context.regimes(m.bench, periods))
        self.has_volume = m.has_volume
        days = m.sessions()
        self.windows = windows = plan_windows(days, c)
        # what does not wait for the strategies runs beside them
        aside = ThreadPoolExecutor(3)
        facts = aside.submit(lambda: context.overview(m, periods).first().asDict())
        scan = aside.submit(lambda: validation.frame(context.scan(m, periods)))
        out = Result(c, m, windows, {}, pd.DataFrame(), notes=list(c.notes))
        baselines = aside.submit(self._baselines, out)
        if windows["short"]:
            out.notes.append(f"A short history: {windows['train_years']} years of training and {windows['test_years']} of test.")
        if c.source == "synthetic":
            out.notes.insert(0, "Synthetic data: a demonstration of the method, no evidence about any market.")
        if c.source == "yahoo":
            out.macro = self._macro()
        chosen = []
        for name in c.strategies or STRATEGIES:
            ok, why = STRATEGIES[name].applicable(m)
            chosen.append(STRATEGIES[name]) if ok else out.skipped.append((name, why))
        self.log(f"{len(chosen)} strategies, {len(windows['wf'])} windows")
        out.strategies = self._validated(chosen)
        self._significance(out)
        if c.iterate:
            more = self._overlays(out)
            if more:
                out.strategies |= self._validated(more)
                self._significance(out)
        baselines.result()
        out.overview, out.scan = {"facts": facts.result(), "interpretation": context.interpret(facts.result())}, scan.result()
        aside.shutdown()
        rows = [{"strategy": k} | v for k, v in out.strategies.items()]
        out.ranking = evaluation.ranking(rows)
        out.returns = validation._union([v["returns"] for v in out.strategies.values()]) if rows else None
        out.selected, out.left_out = evaluation.select(out.ranking, self._correlations(out), c.top_n)
        out.blend = self._blend(out)
        out.seconds = time.time() - began
        return out

    def _macro(self) -> pd.DataFrame | None:
        """Best effort: none where the series cannot be had."""
        try:
            return validation.frame(context.macro_snapshot(sources.raw_bars(self.spark, self.config, list(context.MACRO))))
        except Exception as e:  # noqa: BLE001
            self.log(f"no macro series: {e}")
            return None

    def _validated(self, strategies: list[Strategy]) -> dict[str, dict]:
        """Everything about each strategy but its significance; all share each simulation."""
        c, m, s, w = self.config, self.market, self.settings, self.windows
        periods, rf, start = s.periods, s.risk_free_rate, validation.first_day(w["wf"])
        # independent jobs run side by side: each is a few short stages, which leave most of a cluster idle
        pool = ThreadPoolExecutor(6)
        # the grid has each strategy's default set, so look-ahead need not compute its targets from the whole history again
        ready: Future = Future()
        looks = pool.submit(validation.lookahead, strategies, m, whole=ready.result)
        try:
            targets, sets = validation.grid_targets(strategies, m, c.max_grid, c.seed)
            targets = written(targets)
            usual = [(f"{st.name}#{sets[st.name].index(st.defaults):02d}", st.name) for st in strategies if st.defaults in sets[st.name]]
            renamed = F.broadcast(self.spark.createDataFrame(usual, "config_id string, name string"))
            whole = targets.join(renamed, "config_id").select(F.col("name").alias("config_id"), "asset", "ord", "n", "w")
            others = [st.targets(m, ids=[st.name]) for st in strategies if st.defaults not in sets[st.name]]
            ready.set_result(validation._union([whole, *others]))
        except BaseException as error:
            ready.set_exception(error)
            raise
        sim = simulate(targets, m, s, self.features)
        daily = written(sim.daily)
        returns = validation.dated(daily, m.bench)
        spans = {"is": (w["start"], w["split"]), "eval": (w["start"], None)} | {
            f"{kind}{k}": (x[f"{kind}_start"], x[f"{kind}_end"]) for k, x in enumerate(w["wf"]) for kind in ("train", "test")
        }
        scores = {(r.config_id, r.win): r for r in validation.windowed(returns, spans, periods, rf).collect()}
        ratio = lambda i, win: scores[i, win].sharpe if (i, win) in scores else 0.0
        choices, picks, best = [], {}, {}
        for st in strategies:
            ids = [f"{st.name}#{k:02d}" for k in range(len(sets[st.name]))]
            near = validation.neighbours(sets[st.name], st.grid)
            best[st.name] = ids[validation.plateau([ratio(i, "is") for i in ids], near)]
            picks[st.name] = []
            for k, x in enumerate(w["wf"]):
                j = validation.plateau([ratio(i, f"train{k}") for i in ids], near)
                choices.append((st.name, ids[j], x["test_start"], x["test_end"]))
                picks[st.name].append(
                    x | {
                        "params": sets[st.name][j],
                        "label": st.label(sets[st.name][j]),
                        "train_sharpe": ratio(ids[j], f"train{k}"),
                        "test_sharpe": ratio(ids[j], f"test{k}"),
                    }
                )
        books = written(validation.stitched(targets, choices, m.bench))
        wf = simulate(books, m, s, self.features)
        wf_daily, wf_assets = written(wf.daily), written(wf.by_asset)
        wf_returns = written(validation.dated(wf_daily, m.bench, start))

        def collected(df: DataFrame) -> list:
            return df.collect()

        def summarised(rows: DataFrame, *more) -> dict[str, dict]:
            return {r.config_id: r.asDict() for r in metrics.summary(rows, self.bench, periods, rf, *more).collect()}

        def left_out() -> dict[str, dict]:
            if len(m.assets) < 2:
                return {}
            rows, found = validation.dated(simulate(validation.leave_one_out(books, pnl), m, s, self.features).daily, m.bench, start), {}
            for r in rows.groupBy("config_id").agg(metrics.sharpe("r", periods, rf).alias("s")).collect():
                name, asset = r.config_id.rsplit("|", 1)
                found.setdefault(name, {})[asset] = r.s
            return found

        own = returns.filter(F.col("config_id").isin(list(best.values())))
        names, last = {v: k for k, v in best.items()}, m.sessions()[-1]
        pnl = written(validation.contributions(wf_assets, m.bench, start))
        summary = pool.submit(summarised, wf_returns, trades(wf_assets, m.bench), wf_daily, wf_assets)
        samples = {
            kind: pool.submit(
                summarised,
                own.filter(F.col("date").between(F.lit(a), F.lit(b))),
            ) for kind, a, b in (("is", w["start"], w["split"]), ("oos", w["split"], last))
        }
        stressed = pool.submit(collected, validation.stress(books, m, s, start, wf_returns, self.features))
        without = pool.submit(left_out)
        regimes = pool.submit(validation.frame, validation.regime_breakdown(wf_returns, self.bench, self.regimes, periods, rf))
        crises = pool.submit(validation.frame, validation.crises(wf_returns, self.bench, c.source != "synthetic", start))
        shares = pool.submit(collected, validation.concentration(pnl))
        sens = written(validation.sensitivity(returns, w["start"], w["split"], periods, rf))
        robust = {r.strategy: r.asDict() for r in validation.robustness(sens).collect()}
        stress: dict = {}
        for r in stressed.result():
            stress.setdefault(r.config_id, {})[r.scenario] = r.sharpe
        summary, without, regimes, crises, looks = (x.result() for x in (summary, without, regimes, crises, looks))
        samples = {kind: {names[k]: v for k, v in x.result().items()} for kind, x in samples.items()}
        shares = {r.config_id: r for r in shares.result()}
        pool.shutdown()
        by_asset = validation.frame(pnl)
        return {
            st.name: {
                "strategy_def": st,
                "sets": sets[st.name],
                "lookahead": looks[st.name],
                "is_choice": best[st.name],
                "windows": picks[st.name],
                "deployed": picks[st.name][-1]["params"],
                "wf": summary.get(st.name, {}),
                "is": samples["is"].get(st.name, {}),
                "oos": samples["oos"].get(st.name, {}),
                "robustness": robust[st.name],
                "robust": robust[st.name]["median_to_best"],
                "stress": stress[st.name],
                "regime_table": regimes[regimes.config_id == st.name],
                "regimes": regimes[(regimes.config_id == st.name) & (regimes.dimension == "trend")].sharpe.tolist(),
                "crises": crises[crises.config_id == st.name],
                "pnl": by_asset[by_asset.config_id == st.name].sort_values("pnl", ascending=False),
                "top_share": shares[st.name].top_asset_share if st.name in shares else None,
                "without": without.get(st.name, {}),
                "n_assets": len(m.assets),
                "thesis": st.thesis,
                "note": "",
                "trials": [
                    (scores[i, "eval"].mean, scores[i, "eval"].sd) for i in (
                        f"{st.name}#{k:02d}" for k in range(len(sets[st.name]))
                    ) if (i, "eval") in scores
                ],
                "returns": wf_returns.filter(F.col("config_id") == st.name),
                "sensitivity": sens.filter(F.col("config_id").startswith(f"{st.name}#")),
                "daily": wf_daily.filter(F.col("config_id") == st.name),
            }
            for st in strategies
        }

    def _significance(self, out: Result) -> None:
        """Ratios against what the best of all trials would show by luck; then verdicts."""
        periods = self.config.periods_per_year
        trials = [mean / sd for v in out.strategies.values() for mean, sd in v["trials"] if sd and sd > 0]
        out.n_trials = sum(len(v["sets"]) for v in out.strategies.values())
        out.sr_std = pd.Series(trials).std(ddof=1) if len(trials) > 1 else 0.0
        luck = expected_best(out.n_trials, out.sr_std) * math.sqrt(periods)
        todo = [v["returns"] for v in out.strategies.values() if "ci" not in v]
        limits = {
            r.config_id: (r.low, r.high) for r in metrics.bootstrap(validation._union(todo), periods, 500, self.config.seed).collect()
        } if todo else {}
        for name, v in out.strategies.items():
            row = v["wf"]
            v["psr"], v["dsr"] = (metrics.psr(row, b, periods) if row else 0.0 for b in (0.0, luck))
            v["t_stat"] = row["mean"] / row["sd"] * math.sqrt(row["m"]) if row and row["sd"] else 0.0
            v.setdefault("ci", limits.get(name, (math.nan, math.nan)))
        verdicts = evaluation.evaluate(self.spark, out.strategies.values(), self.config.criteria, self.has_volume)
        for v, verdict in zip(out.strategies.values(), verdicts, strict=True):
            v["verdict"] = verdict

    def _overlays(self, out: Result) -> list[Strategy]:
        """Overlays for strategies with an edge that fail on risk."""
        more = []
        for name, v in out.strategies.items():
            failed = set(v["verdict"].missed) & evaluation.RISK
            edge = evaluation.number(v["wf"].get("sharpe"), 0.0) > 0.2
            if v["verdict"].status == "VALIDATED":
                out.log.append(f"{name}: kept as it is")
            elif not edge or not failed:
                out.log.append(f"{name}: no overlay, {'its failures are not about risk' if edge else 'there is no edge to mend'}")
            else:
                out.log.append(f"{name}: overlays for {', '.join(sorted(failed))}")
                more += [overlay(v["strategy_def"], kind) for kind in ("regime", "voltarget")]
        return more

    def _baselines(self, out: Result) -> None:
        m, s, w = self.market, self.settings, self.windows
        start = validation.first_day(w["wf"])
        held = simulate(buy_and_hold(m), m, s, self.features)
        rows = validation.dated(held.daily, m.bench, start)
        out.baseline = metrics.summary(rows, self.bench, s.periods, s.risk_free_rate, daily=held.daily).first().asDict()
        bench = self.bench.withColumn("config_id", F.lit("benchmark"))
        for kind, since in (("full", w["start"]), ("wf", start)):
            out.benchmark[kind] = metrics.summary(bench.filter(F.col("date") >= F.lit(since)), None, s.periods, s.risk_free_rate).first().asDict()

    def _correlations(self, out: Result) -> dict:
        if out.returns is None or len(out.strategies) < 2:
            return {}
        rows = out.returns.select("n", F.col("config_id").alias("asset"), "r")
        return {(r.a, r.b): (r.m, r.corr) for r in context.correlations(rows, count=True).filter("corr is not null").collect()}

    def _blend(self, out: Result) -> dict | None:
        """Selected strategies by inverse volatility, set at the first known value of each month."""
        if len(out.selected) < 2:
            return None
        rows = blend(out.returns.filter(F.col("config_id").isin(out.selected)), len(out.selected))
        found = metrics.summary(rows, self.bench, self.config.periods_per_year, self.config.risk_free_rate).first()
        return {"returns": rows, "metrics": found.asDict(), "components": out.selected}


def blend(returns: DataFrame, k: int) -> DataFrame:
    """(config_id = blend, n, date, r) of k strategies' returns, over sessions that all have."""
    rows = returns.withColumn("have", F.count("r").over(Window.partitionBy("n"))).filter(F.col("have") == k)
    w = Window.partitionBy("config_id").orderBy("n")
    rows = rows.withColumn("v", rolling(F.stddev_samp, "r", 63, w, 21)).withColumn("inv", 1 / F.nullif(F.lag("v").over(w), F.lit(0.0)))
    rows = rows.withColumn("share", F.col("inv") / F.sum("inv").over(Window.partitionBy("n")))
    month = Window.partitionBy("config_id", F.trunc("date", "month")).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("share", F.coalesce(F.first("share", ignorenulls=True).over(month), F.lit(1.0 / k)))
    return rows.groupBy("n", "date").agg(F.sum(F.col("share") * F.col("r")).alias("r")).select(F.lit("blend").alias("config_id"), "n", "date", "r")
