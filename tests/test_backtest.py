"""Simulation against a plain day-by-day one, and hand-computed cases."""

import datetime as dt
import random

import pytest
from simulator import simulate as plain

from quantloom.config import COSTS, CostModel, cost_model
from quantloom.operators import backtest
from quantloom.operators.align import Market
from quantloom.operators.backtest import Settings, buy_and_hold, simulate, trades

ZERO = COSTS["zero"]


def business_days(n):
    day, out = dt.date(2020, 1, 1), []
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


def panel(spark, close, open_=None, volume=1e6):
    days = business_days(len(close))
    rows, n = [], len(close[0])
    for t, day in enumerate(days):
        for i in range(n):
            o = open_[t][i] if open_ else (close[t - 1][i] if t else close[t][i])
            v = volume[t][i] if isinstance(volume, list) else volume
            rows.append((f"A{i}", i, t, day, o, None, None, close[t][i], v))
    bars = spark.createDataFrame(rows, "asset string, ord int, n long, date date, open double, high double, low double, close double, volume double")
    bench = spark.createDataFrame([(t, d, 100.0 + t) for t, d in enumerate(days)], "n long, date date, close double")
    return Market(bars, bench, [f"A{i}" for i in range(n)], "B")


def book(spark, target, config="c"):
    return spark.createDataFrame(
        [(config, f"A{i}", t, w) for t, r in enumerate(target) for i, w in enumerate(r)],
        "config_id string, asset string, n long, w double",
    )


def run(spark, target, close, open_=None, volume=1e6, costs=ZERO, **settings):
    m = panel(spark, close, open_, volume)
    sim = simulate(book(spark, target), m, Settings(costs, **settings))
    return sorted(sim.daily.collect(), key=lambda r: r.n), sim, m


def equity(days):
    e = 1.0
    for d in days:
        e *= 1 + d.ret
    return e


@pytest.mark.parametrize("execution", ["next_open", "next_close", "same_close"])
def test_random_books(spark, execution):
    r = random.Random(hash(execution) % 97)
    for case in range(2):
        days, n = 90, 4
        close, open_, volume, target = [], [], [], []
        p = [100.0] * n
        w = [0.0] * n
        for t in range(days):
            o = [x * (1 + r.gauss(0, 0.01)) for x in p]
            p = [x * (1 + r.gauss(0, 0.01)) for x in o]
            gone = t < 12 and case
            close.append([None if gone and i == 1 else x for i, x in enumerate(p)])
            open_.append([None if gone and i == 1 else x for i, x in enumerate(o)])
            volume.append([r.uniform(1e3, 1e5) for _ in p])
            if r.random() < 0.2:
                w = [r.uniform(-0.6, 0.9) * (r.random() < 0.7) for _ in p]
            target.append([None if r.random() < 0.01 else x for x in w])
        costs = CostModel("t", 2, 4, 1, 3, 0.6, 80, 200)
        want = plain(target, close, open_, volume, costs, execution, rf=0.03)
        got, sim, m = run(spark, target, close, open_, volume, costs, execution=execution, risk_free_rate=0.03)
        for a, b in zip(got, want, strict=True):
            assert (a.ret, a.gross, a.cost, a.turnover, a.participation) == pytest.approx(b, rel=1e-9, abs=1e-12)
        # contributions are gross growth less costs, to first order in the legs
        total = sum(x.contribution for x in sim.by_asset.collect())
        assert total == pytest.approx(sum(b[1] - b[2] for b in want), abs=0.01)


def test_buy_and_hold_is_the_price(spark):
    days, _, _ = run(spark, [[1.0]] * 5, [[100.0], [101.0], [99.0], [105.0], [110.0]], execution="same_close")
    assert equity(days) == pytest.approx(1.10)


@pytest.mark.parametrize("execution", ["next_open", "next_close", "same_close"])
def test_no_gain_on_the_signal_bar(spark, execution):
    days, _, _ = run(spark, [[0.0]] * 2 + [[1.0]] * 3, [[100.0], [100.0], [150.0], [150.0], [150.0]], execution=execution)
    assert equity(days) == pytest.approx(1.0)


def test_fills_at_the_open(spark):
    days, _, _ = run(spark, [[0.0], [1.0], [1.0], [1.0]], [[100.0], [100.0], [120.0], [120.0]], [[100.0], [100.0], [110.0], [120.0]])
    assert equity(days) == pytest.approx(120 / 110)


def test_linear_costs(spark):
    days, _, _ = run(spark, [[0.0], [1.0], [1.0], [0.0], [0.0], [0.0]], [[100.0]] * 6, volume=0.0, costs=CostModel("x", 10, 0, 0, 0, 0, 0, 0))
    assert sum(d.turnover for d in days) == pytest.approx(2) and equity(days) == pytest.approx((1 - 0.001) ** 2)


def test_drift_is_no_turnover(spark):
    x, y = [100, 110, 90, 120, 100], [100, 95, 105, 100, 102]
    days, sim, _ = run(spark, [[0.5, 0.5]] * 5, [[float(a), float(b)] for a, b in zip(x, y, strict=True)], execution="same_close")
    assert sum(d.turnover for d in days[1:]) == pytest.approx(0)
    assert {(r.asset, r.n): r.exposure for r in sim.by_asset.collect()}["A0", 2] > 0.5


def test_short_pays_borrow_and_cash_earns(spark):
    days, _, _ = run(spark, [[-1.0]] * 3, [[100.0], [90.0], [90.0]], volume=0.0, costs=CostModel("b", 0, 0, 0, 0, 0, 252, 0), execution="same_close")
    assert days[1].ret > 0.09 and days[2].ret < 0
    days, _, _ = run(spark, [[0.0]] * 3, [[100.0]] * 3, risk_free_rate=0.0252)
    assert days[1].ret == pytest.approx(1e-4)


def test_impact_grows_with_size(spark):
    close = [[100 + 10 * t / 59] for t in range(60)]
    cost = {}
    for capital in (1e5, 1e7):
        days, _, _ = run(spark, [[0.0]] * 30 + [[1.0]] * 30, close, volume=1000.0, costs=cost_model("us_equity"), capital=capital)
        cost[capital] = sum(d.cost for d in days)
    assert cost[1e7] > cost[1e5] and max(d.participation for d in days) > 1


def test_wipe_out_stops(spark):
    days, _, _ = run(spark, [[3.0]] * 4, [[100.0], [100.0], [60.0], [200.0]], execution="same_close")
    assert [round(d.ret, 6) for d in days] == [0, 0, -1, 0]


def test_spells(spark):
    days = business_days(8)
    weights, pnl = [0, 1, 1, 0, -1, -1, 1, 0], [0, 0.01, 0.02, 0, -0.01, -0.01, 0.05, 0]
    rows = spark.createDataFrame(
        [("c", "A", t, float(w), float(p)) for t, (w, p) in enumerate(zip(weights, pnl, strict=True))],
        "config_id string, asset string, n long, exposure double, contribution double",
    )
    bench = spark.createDataFrame(list(enumerate(days)), "n long, date date")
    got = [(r.direction, r.bars, round(r.pnl, 6)) for r in trades(rows, bench).orderBy("entry").collect()]
    assert got == [("long", 2, 0.03), ("short", 2, -0.02), ("long", 1, 0.05)]


def test_baseline_starts_with_all_prices(spark):
    m = panel(spark, [[1.0, None], [1.0, 2.0], [1.0, 2.0]])
    assert sorted((r.n, r.w) for r in buy_and_hold(m).filter("asset = 'A0'").collect()) == [(0, 0.0), (1, 0.5), (2, 0.5)]


def test_unknown_execution(spark):
    with pytest.raises(ValueError):
        run(spark, [[0.0]] * 2, [[1.0]] * 2, execution="never")
    with pytest.raises(KeyError):
        cost_model("free lunch")


def random_case(spark, days=70, n=3, seed=5):
    r = random.Random(seed)
    close = [[100.0] * n]
    for _ in range(days - 1):
        close.append([x * (1 + r.gauss(0, 0.02)) for x in close[-1]])
    target = [[0.0] * n]
    for _ in range(days - 1):
        target.append(target[-1] if r.random() < 0.7 else [r.uniform(-0.5, 0.8) for _ in range(n)])
    return panel(spark, close, volume=500.0), book(spark, target)


def test_multiples_of_costs_are_simulations_of_their_own(spark):
    m, targets = random_case(spark)
    settings = Settings(COSTS["us_equity"])
    got = {(r.config_id, r.n): r for r in simulate(targets, m, settings, scales=(1, 3)).daily.collect()}
    for k in (1, 3):
        for r in simulate(targets, m, settings.but(costs=settings.costs.scaled(k))).daily.collect():
            own = got[f"c|x{k}", r.n]
            assert own.ret == pytest.approx(r.ret, abs=1e-12) and own.cost == pytest.approx(r.cost, abs=1e-12) and own.equity == pytest.approx(r.equity)
    assert len(got) == 140


@pytest.mark.parametrize("execution", ["next_open", "same_close"])
def test_large_universes_are_dealt_otherwise_with_the_same_result(spark, monkeypatch, execution):
    m, targets = random_case(spark, seed=6)
    settings = Settings(COSTS["us_equity"], execution)
    rows = lambda: {r.n: r for r in simulate(targets, m, settings).daily.collect()}
    want = rows()
    monkeypatch.setattr(backtest, "ONE_TASK", 0)
    assert "hashpartitioning(config_id" not in backtest.dealt(targets, 3)._jdf.queryExecution().toString()
    got = rows()
    assert got.keys() == want.keys() and all(got[n].ret == pytest.approx(want[n].ret, abs=1e-12) for n in want)
    # equity before and after a session
    e = 1.0
    for n in sorted(got):
        assert got[n].held == pytest.approx(e)
        e *= 1 + got[n].ret
        assert got[n].equity == pytest.approx(e)
