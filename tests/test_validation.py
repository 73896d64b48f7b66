"""Windows, selection, robustness, regimes, look-ahead, verdicts and selection."""

import dataclasses
import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.config import COSTS, Criteria, ResearchConfig, from_preset
from quantloom.operators.align import market
from quantloom.operators.market import correlations, regimes
from quantloom.plans import evaluation as E
from quantloom.plans import validation as V
from quantloom.plans.strategies import STRATEGIES, Strategy, overlay, strategy
from quantloom.sources import synthetic


@pytest.fixture(scope="module")
def small(spark):
    raw = synthetic.generate(spark, ["A", "B", "C", "D", "E", "F", "BENCH"], "2012-01-01", "2015-12-31", 11, "BENCH")
    m = market(raw.cache(), ["A", "B", "C", "D", "E", "F"], "BENCH")
    m.bars = m.bars.cache()
    return m


def days(start, end):
    return [d.date() for d in pd.bdate_range(start, end)]


def test_windows():
    got = V.walk_forward_windows(days("2005-01-03", "2020-12-31"), dt.date(2005, 1, 3), 5, 1)
    assert len(got) == 11
    for a, b in zip(got, got[1:], strict=False):
        assert b["test_start"] == a["test_end"] + dt.timedelta(1) and a["train_end"] < a["test_start"]
    assert got[-1]["test_end"] == dt.date(2020, 12, 30)  # a window that would start on the last session is none
    anchored = V.walk_forward_windows(days("2005-01-03", "2020-12-31"), dt.date(2005, 1, 3), 5, 1, True)
    assert {w["train_start"] for w in anchored} == {dt.date(2005, 1, 3)}


def test_short_last_window_joins_the_one_before():
    got = V.walk_forward_windows(days("2010-01-01", "2014-02-10"), dt.date(2010, 1, 1), 1, 1)
    assert len(got) == 3 and got[-1]["test_end"] == dt.date(2014, 2, 10)
    assert all(b["test_start"] == a["test_end"] + dt.timedelta(1) for a, b in zip(got, got[1:], strict=False))


def test_plateau_and_neighbours():
    grid = {"a": [1, 2, 3], "b": [0, 1]}
    sets = [{"a": a, "b": b} for a in grid["a"] for b in grid["b"]] + [{"a": 9, "b": 0}]
    near = V.neighbours(sets, grid)
    assert near[0] == [1, 2] and near[2] == [0, 3, 4] and near[6] == []
    assert V.plateau([0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 1.6], near) == 6
    assert V.plateau([1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.5], near) == 0


def test_grids():
    sizes = [
        len(STRATEGIES[n].combinations()) for n in (
            "trend_tsmom", "donchian_breakout", "xs_momentum", "rsi_pullback", "xs_reversal", "pairs_stat_arb", "low_vol",
            "vol_managed", "turn_of_month",
        )
    ]
    assert sizes == [12, 15, 24, 12, 13, 12, 12, 13, 9]
    for s in STRATEGIES.values():
        assert s.defaults in s.combinations() and all(s.valid(p) for p in s.combinations())
        for kind in ("regime", "voltarget"):
            assert overlay(s, kind).defaults in overlay(s, kind).combinations()
    with pytest.raises(ValueError):
        strategy("low_vol").params(nonsense=1)
    with pytest.raises(KeyError):
        strategy("nothing")
    with pytest.raises(KeyError):
        overlay(strategy("low_vol"), "nothing")


def test_stitched_books_follow_their_windows(spark, small):
    st = STRATEGIES["turn_of_month"]
    targets, sets = V.grid_targets([st], small)
    all_days = small.sessions()
    windows = V.walk_forward_windows(all_days, all_days[200], 1, 0.5)
    choices = [(st.name, f"{st.name}#{k % len(sets[st.name]):02d}", w["test_start"], w["test_end"]) for k, w in enumerate(windows)]
    got = V.stitched(targets, choices, small.bench).toPandas()
    assert len(got) == len(all_days) * 6 and got.groupby(["asset", "n"]).size().max() == 1
    assert got[got.n < all_days.index(next(d for d in all_days if d >= windows[0]["test_start"]))].w.abs().sum() == 0
    assert got.groupby("n").w.sum().max() <= 1 + 1e-9


@pytest.mark.parametrize("name", [*STRATEGIES, "vol_managed+regime", "trend_tsmom+voltarget"])
def test_invariants(small, name):
    base, _, kind = name.partition("+")
    s = overlay(STRATEGIES[base], kind) if kind else STRATEGIES[base]
    w = s.targets(small).toPandas()
    assert len(w) == 6 * len(small.sessions()) and w.w.notna().all() and w.groupby(["asset", "n"]).size().max() == 1
    gross = w.w.abs().groupby(w.n).sum()
    assert gross.max() <= (1.5 if base == "vol_managed" else 1.0) + 1e-9
    assert not s.long_only or w.w.min() >= -1e-12
    assert base in ("pairs_stat_arb", "rsi_pullback") or gross.max() > 0


def test_no_strategy_looks_ahead_and_a_cheat_is_found(small):
    def peek(m, sets):
        last = m.bars.groupBy("asset").agg(F.max_by("close", "n").alias("end"))
        rows = m.bars.join(last, "asset")
        return rows.select(
            F.lit(sets[0]["config_id"]).alias("config_id"),
            "asset",
            "ord",
            "n",
            F.when(F.col("end") > F.col("close"), 0.1).otherwise(0.0).alias("w"),
        )

    cheat = Strategy("cheat", {"x": 1}, {"x": [1]}, peek)
    got = V.lookahead([*STRATEGIES.values(), overlay(STRATEGIES["low_vol"], "regime"), cheat], small, cuts=(0.6,))
    assert not got.pop("cheat")["passed"]
    assert all(g["passed"] for g in got.values()), got


def test_regimes_start_unknown(small):
    rows = regimes(small.bench).orderBy("n").collect()
    assert {r.trend for r in rows[:149]} == {"n/a"} and rows[149].trend != "n/a" and rows[100].vol == "n/a"


def test_robustness(spark):
    rows = [
        (f"plateau#{k:02d}", 1.0 + 0.01 * k, 0.9 + 0.02 * k, 1.0 + 0.01 * k) for k in range(9)
    ] + [(f"spike#{k:02d}", 0.0, 0.0, 2.0 if k == 4 else -0.1) for k in range(9)]
    got = {
        r.strategy: r for r in V.robustness(
            spark.createDataFrame(rows, "config_id string, is_sharpe double, oos_sharpe double, full_sharpe double")
        ).collect()
    }
    assert got["plateau"].median_to_best > 0.8 and got["spike"].median_to_best == 0 and got["spike"].is_oos_rank_corr is None
    assert got["plateau"].is_oos_rank_corr == pytest.approx(1)


def facts(**more):
    wf = {
        "sharpe": 1.2,
        "benchmark_sharpe": 0.5,
        "max_drawdown": 0.1,
        "positive_years": 0.9,
        "excess_cagr": 0.02,
        "max_participation": 0.01,
        "cagr": 0.1,
    }
    return {
        "wf": wf | more.pop("wf", {}),
        "is": {"sharpe": 1.3},
        "stress": {"base": 1.2, "costs_x2": 1.0, "delay_1_session": 1.1},
        "dsr": 0.95,
        "psr": 0.99,
        "robust": 0.8,
        "lookahead": {"passed": True, "max_abs_diff": 0.0},
        "regimes": [1.0, 0.5, 0.2],
        "top_share": 0.3,
        "n_assets": 5,
        "thesis": "x",
    } | more


def test_verdicts(spark):
    cases = [facts(), facts(dsr=0.5), facts(wf={"max_drawdown": 0.4}), facts(dsr=None, top_share=float("nan"), regimes=[], n_assets=1, thesis="")]
    ok, promising, bad, unknown = E.evaluate(spark, cases, Criteria(), True)
    assert ok.status == "VALIDATED" and len(ok.checks) == 16 and not ok.reasons and all(c.passed for c in ok.checks)
    # 30 * 0.8 + 15 * 0.95 + 10 * (0.8 + 0.8 + 1 / 1.2 + 1) + 5 * (0.9 + 1 + 0.7)
    assert ok.score == pytest.approx(85.6, abs=0.051)
    assert promising.status == "PROMISING" and promising.missed == ["Deflated Sharpe"]
    assert bad.status == "REJECTED" and bad.missed == ["Maximum drawdown"] and bad.reasons == ["Maximum drawdown (40.0%, wanted < 30%)"]
    passed = {c.name: c.passed for c in unknown.checks}
    assert unknown.status == "PROMISING" and passed["Gains across trends"] is None and passed[
        "Largest asset's share of gains"
    ] is None and not passed["Has a rationale"]
    (dry,) = E.evaluate(spark, [facts()], Criteria(), False)
    assert next(c for c in dry.checks if "volume" in c.name).passed is None
    assert E.evaluate(spark, [], Criteria(), True) == []


def test_ranking_and_selection(spark):
    cases = {"a": facts(dsr=0.5), "b": facts(), "b+regime": facts(robust=0.7), "c": facts(wf={"sharpe": 0.1}), "d": facts(dsr=0.2)}
    verdicts = E.evaluate(spark, cases.values(), Criteria(), True)
    rows = [{"strategy": n, "verdict": v} | f for (n, f), v in zip(cases.items(), verdicts, strict=True)]
    ranked = E.ranking(rows)
    assert ranked.strategy.tolist() == ["b", "b+regime", "a", "d", "c"] and ranked["rank"].tolist() == [1, 2, 3, 4, 5]
    # a and d share enough sessions to be told alike, a and b do not
    chosen, why = E.select(ranked, {("a", "d"): (500, 0.9), ("a", "b"): (50, 0.99)}, 5)
    assert chosen == ["b", "a"] and set(why) == {"b+regime", "d"}


def test_correlations_count_common_sessions(spark):
    rows = [("a", n, float(n % 5)) for n in range(50)] + [("b", n, float(n % 5) if n != 33 else None) for n in range(30, 80)]
    (got,) = correlations(spark.createDataFrame(rows, "asset string, n long, r double"), count=True).collect()
    assert (got.a, got.b, got.m) == ("a", "b", 19) and got.corr == pytest.approx(1)


def test_presets_and_costs():
    c = from_preset("crypto", capital=5.0, start=None)
    assert c.periods_per_year == 365 and c.capital == 5.0 and c.start == "2018-01-01"
    with pytest.raises(KeyError):
        from_preset("moon")
    assert COSTS["us_etf"].scaled(2).buy_rate == pytest.approx(2 * COSTS["us_etf"].buy_rate)
    assert len(dataclasses.fields(ResearchConfig)) >= 22
