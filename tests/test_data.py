"""Sources, alignment, quality, context, metrics, reports and the command line."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom import cli
from quantloom.config import COSTS, ResearchConfig
from quantloom.functions.stats import bootstrap_sharpe, expected_best, probabilistic_sharpe
from quantloom.functions.windows import along, rsi, selected, state, turn_of_month
from quantloom.operators import market as context
from quantloom.operators import align, metrics
from quantloom.operators.align import market
from quantloom.plans import report, strategies
from quantloom.plans.research import Research, blend
from quantloom.plans.strategies import STRATEGIES, formations
from quantloom.sources import csv, synthetic, yahoo

RAW = "asset string, date date, open double, high double, low double, close double, volume double, seq long"


def frame(closes, start="2020-01-01"):
    days = pd.bdate_range(start, periods=len(closes))
    return pd.DataFrame({"Open": closes, "High": closes, "Low": closes, "Close": closes, "Volume": 1.0}, index=days)


def test_csv_adjusts_whole_bars(spark, tmp_path):
    (tmp_path / "A_B.csv").write_text(
        "Date, Open,High,Low,Close,Adj Close,Volume\n2020-01-02,10,10,10,10,5,1\n2020-01-03,11,12,10,11,5.5,\n2020-01-06,12,12,12,12,6,3\n"
    )
    (tmp_path / "C.csv").write_text("timestamp,CLOSE\n2020-01-02,7\nbad\n".replace("bad\n", ""))
    with pytest.warns(UserWarning):
        got = csv.read(spark, ["A/B", "C", "none"], str(tmp_path)).orderBy("asset", "date").collect()
    assert [(r.close, r.open) for r in got[:3]] == [(5, 5), (5.5, 5.5), (6, 6)] and got[1].high == 6 and got[1].volume is None
    assert (got[3].asset, got[3].open, got[3].volume) == ("C", 7, None)


def test_yahoo_client_and_cache(spark, tmp_path):
    made = frame([1.0, float("nan"), 3.0])

    def client(ticker, start, end):
        return made.iloc[:0] if ticker == "GONE" else made

    got = yahoo.fetch(spark, ["X", "GONE"], "2020-01-01", "2020-02-01", str(tmp_path), client)
    assert [r.close for r in got.orderBy("date").collect()] == [1.0, 3.0]

    def fail(ticker, start, end):
        raise AssertionError("the cache is fresh")

    assert yahoo.fetch(spark, ["X"], "2020-01-01", "2020-02-01", str(tmp_path), fail).count() == 2
    two = pd.concat({"X": frame([5.0])}, axis=1)
    assert yahoo.rows(two, "X")[0][4] == 5.0 and yahoo.rows(two, "Y") == [] and yahoo.rows(None, "X") == []


def test_alignment(spark):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=20)]
    rows = [("B", d, None, None, None, float(100 + k), None, 0) for k, d in enumerate(days)]
    rows += [("L", d, 1.0, 2.0, 0.5, float(k), 10.0, 0) for k, d in enumerate(days) if k in (5, 6, 14)]
    rows += [
        ("L", days[6], 1.0, 2.0, 0.5, 66.0, 10.0, 1),
        ("L", days[7], None, None, None, float("nan"), None, 0),
        ("X", days[0], 1.0, 1.0, 1.0, float("inf"), 1.0, 0),
    ]
    with pytest.warns(UserWarning):
        m = market(spark.createDataFrame(rows, RAW), ["L", "X", "L", "none"], "B", least_sessions=10)
    assert m.assets == ["L", "X"] and m.has_volume
    got = {r.n: r for r in m.bars.filter("asset = 'L'").collect()}
    assert len(got) == 20 and [got[k].close for k in (4, 5, 6, 7, 11, 12, 13, 14)] == [None, 5, 66, 66, 66, None, None, 14]
    assert got[8].open == got[8].high == 66 and got[8].volume == 0 and got[6].open == 1.0 and got[4].volume is None
    quality = {r.asset: r for r in m.quality.collect()}
    assert quality["B"].status == "ok" and quality["X"].status == "no data in range" and quality["L"].missing_sessions == 7
    assert m.subset(["X"]).assets == ["X"] and m.between(end=days[3]).bench.count() == 4
    for bad in (("none", ["L"]), ("B", ["none"])):
        with pytest.raises(ValueError):
            market(spark.createDataFrame(rows, RAW), bad[1], bad[0], least_sessions=10)
    with pytest.raises(ValueError):
        market(spark.createDataFrame(rows, RAW), ["L"], "B")


def test_quality_flags(spark):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=60)]
    rows = [("B", d, None, None, None, float(100 + k), None, 0) for k, d in enumerate(days)]
    rows += [("F", d, None, None, None, 5.0 if k < 10 else 5.0 + k, None, 0) for k, d in enumerate(days) if 0 <= k < 40 and k != 20]
    rows += [("N", d, None, None, None, -1.0 if k == 50 else 1.0 + k / 100, None, 0) for k, d in enumerate(days) if k >= 30]
    q = {r.asset: r.flags for r in market(spark.createDataFrame(rows, RAW), ["F", "N"], "B", least_sessions=10).quality.collect()}
    assert "unchanged for 9 days" in q["F"] and "1 moves over 25%" in q["F"] and "ends" in q["F"] and "1 sessions missing" in q["F"]
    assert "prices of zero or less" in q["N"] and "starts" in q["N"] and q["B"] == ""


def test_synthetic_is_repeatable_and_pairs_stay_together(spark):
    args = (spark, ["P1", "P2", "Q1", "Q2", "BENCH"], "2014-01-01", "2017-12-31", 3, "BENCH", 2)
    a, b = (synthetic.generate(*args).orderBy("asset", "date").toPandas() for _ in range(2))
    assert a.equals(b) and (a.high >= a[["open", "close"]].max(axis=1) - 1e-9).all() and (a.low <= a[["open", "close"]].min(axis=1) + 1e-9).all()
    m = market(spark.createDataFrame(a), ["P1", "P2", "Q1", "Q2"], "BENCH")
    found = formations(m, 252, 63, 2, -3.0).toPandas()
    planted = set(zip(found[found.y == "P1"].f_end, found[found.y == "P1"].x, strict=True))
    ends = range(252, len(m.sessions()), 63)
    assert sum((e, "P2") in planted for e in ends) > 0.8 * len(ends)
    x = {k: np.log(a[a.asset == k].close.to_numpy()[:252]) for k in ("P1", "P2")}
    beta = np.cov(x["P1"], x["P2"], bias=True)[0, 1] / np.var(x["P2"])
    e = x["P1"] - beta * x["P2"]
    d, lag = np.diff(e), np.column_stack([np.ones(251), e[:-1]])
    fit, rest = np.linalg.lstsq(lag, d, rcond=None)[:2]
    t = fit[1] / np.sqrt(rest[0] / 249 * np.linalg.inv(lag.T @ lag)[1, 1])
    first = found[(found.f_end == 252) & (found.y == "P1")]
    assert first.beta.iloc[0] == pytest.approx(beta) and first.t.iloc[0] == pytest.approx(t)


def test_window_operators(spark):
    rows = spark.createDataFrame(
        [("A", n, bool(e), bool(x)) for n, (e, x) in enumerate(zip([0, 1, 0, 0, 1, 0], [0, 0, 0, 1, 0, 0], strict=True))],
        "asset string, n long, e boolean, x boolean",
    )
    assert [r.s for r in rows.select("n", state(F.col("e"), F.col("x"), along()).alias("s")).orderBy("n").collect()] == [0, 1, 1, 0, 1, 1]
    rows = spark.createDataFrame([(f"a{k}", k, 0, v) for k, v in enumerate([1.0, 2.0, 3.0, 4.0, None])], "asset string, ord int, n long, s double")
    pick = lambda f, top: [r.i for r in rows.select("ord", selected("s", F.lit(f), F.lit(top), ()).alias("i")).orderBy("ord").collect()]
    assert pick(0.5, True) == [False, False, True, True, False] and pick(0.25, False) == [True, False, False, False, False]
    days = spark.createDataFrame([(dt.date(2024, 1, 24) + dt.timedelta(k),) for k in range(16)], "d date")
    inside = {r.d: r.i for r in days.select("d", turn_of_month(F.col("d"), F.lit(2), F.lit(3)).alias("i")).collect()}
    assert [inside[dt.date(2024, *x)] for x in ((1, 26), (1, 29), (2, 2), (2, 5))] == [False, True, True, False]


def test_rsi_is_wilders(spark):
    r = np.random.default_rng(0)
    close = [None, None, *(100 + r.normal(size=60).cumsum()).tolist()]
    close[30] = None
    got = [
        x.rsi_5 for x in rsi(
            spark.createDataFrame([("A", n, c) for n, c in enumerate(close)], "asset string, n long, close double"),
            [5],
        ).orderBy("n").collect()
    ]
    up = down = None
    decay, k = 0.0, 0
    for n, c in enumerate(close):
        d = c - close[n - 1] if n and c is not None and close[n - 1] is not None else None
        if d is not None:
            k += 1
            u, v = max(d, 0.0), max(-d, 0.0)
            up, down = (u, v) if up is None else ((decay * up + 0.2 * u) / (decay + 0.2), (decay * down + 0.2 * v) / (decay + 0.2))
            decay = 0.8
        else:
            decay *= 0.8
        want = None if k < 5 else 100 * up / (up + down) if down > 0 else 100.0
        assert got[n] == (None if want is None else pytest.approx(want))


def stream(spark, values, name="s"):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=len(values))]
    return spark.createDataFrame(
        [(name, n, d, float(v)) for n, (d, v) in enumerate(zip(days, values, strict=True))],
        "config_id string, n long, date date, r double",
    )


def test_metrics(spark):
    assert metrics.max_drawdown(stream(spark, [0.1, -0.5, 0.2, 1.0])).first().max_drawdown == pytest.approx(0.5)
    flat = metrics.summary(stream(spark, [0.0] * 252)).first()
    assert flat.cagr == 0 and flat.sharpe == 0 and flat.max_drawdown == 0
    assert metrics.summary(stream(spark, [0.01] + [0.0] * 251)).first().cagr == pytest.approx(0.01)
    r = np.random.default_rng(1)
    b = r.normal(0.0005, 0.01, 1500)
    x = 0.5 * b + r.normal(0, 0.002, 1500)
    row = metrics.summary(stream(spark, x), stream(spark, b).select("n", "r")).first()
    assert row.beta == pytest.approx(np.cov(x, b)[0, 1] / b.var(ddof=1)) and 0.45 < row.beta < 0.55
    assert row.sharpe == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252)) and row.var_95 == pytest.approx(-np.quantile(x, 0.05))
    assert row.skew == pytest.approx(
        ((x - x.mean()) ** 3).mean() / x.std() ** 3
    ) and row.cvar_95 == pytest.approx(-x[x <= np.quantile(x, 0.05)].mean())
    few = metrics.rolling_sharpe(stream(spark, x), 252).orderBy("n").collect()
    assert few[250].sharpe is None and few[251].sharpe == pytest.approx(x[:252].mean() / x[:252].std(ddof=1) * math.sqrt(252))


def test_significance(spark):
    p = lambda benchmark: probabilistic_sharpe(1000, 0.001, 0.01, -0.2, 1.0, benchmark)
    assert 0.99 < p(0.0) and p(1.0) > p(2.0) and probabilistic_sharpe(20, 1, 1, 0, 0) == 0
    assert expected_best(1, 0.1) == 0 and expected_best(10, 0.1) < expected_best(100, 0.1) < expected_best(1000, 0.1)
    x = np.random.default_rng(2).normal(0.001, 0.01, 1000)
    low, high = bootstrap_sharpe(x)
    assert low < x.mean() / x.std(ddof=1) * math.sqrt(252) < high and math.isnan(bootstrap_sharpe(x[:50])[0])
    got = metrics.bootstrap(stream(spark, x), n_boot=1000).first()
    assert (got.low, got.high) == pytest.approx((low, high))


def test_pairs_of_blocks(spark, monkeypatch):
    """Blocks of two assets give the pairs that one block gives."""
    r = np.random.default_rng(4)
    common = np.cumsum(r.normal(0, 0.01, 330))
    rows = [
        (
            f"A{i}",
            i,
            t,
            float(100 * np.exp(common[t] * (1 + i % 2) + 0.01 * r.normal())),
        ) for i in range(7) for t in range(330) if not (i == 6 and t < 20)
    ]
    bars = spark.createDataFrame(rows, "asset string, ord int, n long, close double")
    bench = spark.createDataFrame([(t, 1.0) for t in range(330)], "n long, close double")
    m = align.Market(bars, bench, [f"A{i}" for i in range(7)], "B")
    one = sorted(map(tuple, formations(m, 252, 30, 3, -2.0).collect()))
    monkeypatch.setattr(strategies, "BLOCK", 2)
    assert len(one) >= 6 and sorted(map(tuple, formations(m, 252, 30, 3, -2.0).collect())) == one


def test_blend_and_correlations(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(0, 0.01, 120), r.normal(0, 0.03, 120)
    rows = stream(spark, a, "a").union(stream(spark, b, "b"))
    got = {x.n: x.r for x in blend(rows, 2).collect()}
    days = pd.bdate_range("2020-01-01", periods=120)
    later = next(i for i in range(90, 120) if days[i].month != days[i - 1].month)
    # the first month's first known value is on its 22nd session; a month without one has equal parts
    for first, n in ((21, 0), (later, later + 1)):
        inv = [1 / pd.Series(x).rolling(63, min_periods=21).std().shift(1)[first] for x in (a, b)]
        assert got[n] == pytest.approx((inv[0] * a[n] + inv[1] * b[n]) / sum(inv))
    short = blend(rows.filter("n < 15"), 2).collect()
    assert all(x.r == pytest.approx((a[x.n] + b[x.n]) / 2) for x in short)
    c = context.correlations(rows.select("n", F.col("config_id").alias("asset"), "r")).first()
    assert c["corr"] == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_research_end_to_end(spark, tmp_path):
    c = ResearchConfig(
        "small",
        ["A", "B", "C"],
        "BENCH",
        "2012-01-01",
        "2016-12-31",
        "synthetic",
        seed=21,
        max_grid=3,
        strategies=["trend_tsmom", "low_vol", "xs_momentum"],
        output_dir=str(tmp_path),
    )
    r = Research(spark, c, log=lambda _: None).run()
    assert [s for s, _ in r.skipped] == ["xs_momentum"] and r.n_trials == sum(len(v["sets"]) for v in r.strategies.values())
    assert set(r.ranking.status) <= {"VALIDATED", "PROMISING", "REJECTED"} and "VALIDATED" not in set(r.ranking.status)
    for v in r.strategies.values():
        assert v["lookahead"]["passed"] and v["dsr"] <= v["psr"] + 1e-12 and len(v["verdict"].checks) == 16
    path = report.write(r, str(tmp_path))
    text = path.read_text()
    assert all(
        f"## {k}." in text for k in range(1, 11)
    ) and "Appendix A" in text and "Appendix B" in text and (tmp_path / "results/ranking.csv").exists()
    summary = json.loads((tmp_path / "results/summary.json").read_text())
    assert summary["n_trials"] == r.n_trials and summary["costs"]["commission_bps"] == COSTS[c.cost_preset].commission_bps
    assert STRATEGIES["low_vol"].describe()["grid"] == STRATEGIES["low_vol"].grid


def test_command_line(capsys):
    assert cli.main(["list"]) == 0
    said = capsys.readouterr().out
    assert all(s in said for s in STRATEGIES)
    assert cli.literal("a=1.5") == ("a", 1.5) and cli.literal("w=equal") == ("w", "equal")
    args = cli.parser().parse_args(["research", "--preset", "crypto", "--universe", "X,Y", "--benchmark", "Z", "--no-iterate"])
    c = cli.config(args)
    assert c.universe == ["X", "Y"] and c.benchmark == "Z" and not c.iterate
    with pytest.raises(SystemExit):
        cli.config(cli.parser().parse_args(["scan", "--universe", "X"]))
