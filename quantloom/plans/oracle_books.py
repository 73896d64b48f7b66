"""DuckDB SQL of simulated books: a walk from session to session over lists of weights, and what is computed from it.

It shares no formula with the simulation's windows: weights drift, fill and earn a day at a time.
"""

from __future__ import annotations

from ..config import COSTS, CostModel, ResearchConfig
from .oracles import _BARS, _BENCH_DD, _REGIMES, _SHARPE, ORACLES, _chosen, _hold, _roll, _vol, _with
from .strategies import STRATEGIES
from .validation import neighbours

_COSTS = COSTS["us_etf"]
_CAPITAL, _PERIODS = 1_000_000.0, 365


def _plain(name: str) -> str:
    """The weights of a query's oracle, unrounded: a subquery of (asset, n, w)."""
    text = ORACLES[name].removeprefix(f"WITH RECURSIVE {_BARS.strip()}, ")
    return "WITH " + text.replace("SELECT asset, n, round(", "SELECT asset, n, (").replace(", 6) AS w", ") AS w")


_INPUTS = f"""
leg AS (SELECT asset, ord, n, close IS NOT NULL AS priced, coalesce(close / lag(close) OVER w - 1, 0.0) AS r_cc, coalesce(open / lag(close) OVER w - 1, 0.0) AS r_on,
  coalesce(close / open - 1, 0.0) AS r_id, close * coalesce(volume, 0.0) AS traded FROM bars WINDOW w AS (PARTITION BY asset ORDER BY n)),
leg2 AS (SELECT *, {_roll('stddev_samp', 'r_cc', 21, 10)} AS sd, {_roll('avg', 'traded', 20, 5)} AS value FROM leg),
inp AS (SELECT asset, ord, n, priced, r_cc, r_on, r_id, coalesce(lag(sd) OVER w, 0.02) AS sigma, lag(value) OVER w AS adv FROM leg2 WINDOW w AS (PARTITION BY asset ORDER BY n))"""

_BOOKS = f"""
book AS (SELECT 'trend_tsmom' AS config_id, asset, n, w FROM ({_plain('weights_trend_tsmom')}) UNION ALL
  SELECT 'vol_managed', asset, n, w FROM ({_plain('weights_vol_managed')}) UNION ALL SELECT 'xs_momentum', asset, n, w FROM ({_plain('weights_xs_momentum')}) UNION ALL
  SELECT 'buy_and_hold', asset, n, CASE WHEN n >= (SELECT min(n) FROM (SELECT n FROM bars GROUP BY n HAVING count(close) = (SELECT count(*) FROM assets))) THEN 1.0 / (SELECT count(*) FROM assets) ELSE 0.0 END FROM bars)"""


def walk(execution: str, costs: CostModel = _COSTS) -> str:
    """(config_id, n, e, x, ...) from book: equity and weights after each session, by lists in the order of assets."""
    early, opening = execution == "same_close", execution == "next_open"
    each = lambda x: f"list_transform(range(1, len(w) + 1), lambda i: {x})"
    first, legs = ("r_on", "r_id") if opening else ("r_cc", None)
    held = "y" if opening else "x0"
    return f"""
day0 AS (SELECT config_id, n, list(CASE WHEN priced THEN coalesce(w, 0.0) ELSE 0.0 END ORDER BY ord) AS w, list(r_cc ORDER BY ord) AS r_cc, list(r_on ORDER BY ord) AS r_on, list(r_id ORDER BY ord) AS r_id,
  list(sigma ORDER BY ord) AS sigma, list(coalesce(adv, 0.0) ORDER BY ord) AS adv, list(asset ORDER BY ord) AS assets FROM book JOIN inp USING (asset, n) GROUP BY config_id, n),
day1 AS (SELECT *, lag(w) OVER (PARTITION BY config_id ORDER BY n) AS before FROM day0),
day2 AS (SELECT *, CASE WHEN before IS NULL THEN list_max({each('abs(w[i])')}) > 0 ELSE list_max({each('abs(w[i] - before[i])')}) > 1e-12 END AS changed FROM day1),
day AS MATERIALIZED (SELECT config_id, n, w, {'w' if early else 'before'} AS goal, coalesce({'changed' if early else 'lag(changed) OVER (PARTITION BY config_id ORDER BY n)'}, false) AS fill, r_cc, r_on, r_id, sigma, adv, assets FROM day2),
walk(config_id, n, e, x, ret, gross, cost, turnover, share, held, exposure, earned, paid) AS (
  SELECT config_id, CAST(-1 AS BIGINT), 1.0::DOUBLE, list_transform(w, lambda v: 0.0::DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, list_transform(w, lambda v: 0.0::DOUBLE),
    list_transform(w, lambda v: 0.0::DOUBLE), list_transform(w, lambda v: 0.0::DOUBLE) FROM day WHERE n = 0
  UNION ALL
  SELECT config_id, n, CASE WHEN e > 0 THEN e * grown ELSE e END, x2, CASE WHEN e <= 0 THEN 0.0 WHEN e * grown <= 0 THEN -1.0 ELSE grown - 1 END,
    CASE WHEN e <= 0 THEN 0.0 WHEN cost < 1 THEN before / (1 - cost) - 1 ELSE -1.0 END, CASE WHEN e > 0 THEN cost ELSE 0.0 END, CASE WHEN e > 0 THEN turnover ELSE 0.0 END, CASE WHEN e > 0 THEN share ELSE 0.0 END,
    e, {held}, earned, paid FROM (
    SELECT *, CASE WHEN n = 0 THEN 1 - cost ELSE before * (1 + cash * (CASE WHEN cash >= 0 THEN 0.0 ELSE {costs.financing_spread_bps / 1e4 / _PERIODS!r} END) - {costs.borrow_bps / 1e4 / _PERIODS!r} * short) END AS grown FROM (
    SELECT *, (1 + g1) * (1 - cost) * (1 + g2) AS before, 1 - list_sum(x2) AS cash, list_sum({each('greatest(0.0, -x2[i])')}) AS short FROM (
    SELECT *, {each('y[i] * (1 + r_id[i]) / (1 + g2)') if legs else 'y'} AS x2, list_sum(paid) AS cost, list_sum({each('abs(delta[i])')}) AS turnover,
      list_max({each(f'CASE WHEN adv[i] > 0 THEN abs(delta[i]) * e * {_CAPITAL!r} / adv[i] ELSE 0.0 END')}) AS share,
      {each('x0[i] * r_on[i] + y[i] * r_id[i]') if legs else each('x0[i] * r_cc[i]')} AS earned FROM (
    SELECT *, {f"list_sum({each('y[i] * r_id[i]')})" if legs else '0.0::DOUBLE'} AS g2,
      {each(f"CASE WHEN delta[i] > 0 THEN delta[i] * {costs.buy_rate!r} ELSE -delta[i] * {costs.sell_rate!r} END + CASE WHEN adv[i] > 0 THEN abs(delta[i]) * {costs.impact_coef!r} * sigma[i] * sqrt(abs(delta[i]) * greatest(e, 0.0) * {_CAPITAL!r} / adv[i]) ELSE 0.0 END")} AS paid FROM (
    SELECT *, {each('CASE WHEN fill THEN goal[i] - d[i] ELSE 0.0 END')} AS delta, CASE WHEN fill THEN goal ELSE d END AS y FROM (
    SELECT *, {each(f'x0[i] * (1 + {first}[i]) / (1 + g1)')} AS d FROM (
    SELECT day.*, walk.e, walk.x AS x0, list_sum(list_transform(range(1, len(w) + 1), lambda i: walk.x[i] * {first}[i])) AS g1 FROM walk JOIN day ON day.config_id = walk.config_id AND day.n = walk.n + 1
    )))))))),
daily AS (SELECT config_id, n, ret, gross, cost, turnover, share AS participation, held, e AS equity FROM walk WHERE n >= 0)"""


#: Per asset: exposure, and contribution after costs, which go to the next live session, else to the one before, else stay.
_ASSETS = """
spread AS (SELECT walk.config_id, walk.n, unnest(day.assets) AS asset, unnest(exposure) AS exposure, unnest(earned) AS earned, unnest(paid) AS paid FROM walk JOIN day ON day.config_id = walk.config_id AND day.n = walk.n),
alive AS (SELECT *, abs(exposure) > 1e-12 AS live FROM spread),
stray AS (SELECT *, NOT live AND paid <> 0 AND coalesce(lead(live) OVER w, false) AS ahead, NOT live AND paid <> 0 AND NOT coalesce(lead(live) OVER w, false) AND coalesce(lag(live) OVER w, false) AS back
  FROM alive WINDOW w AS (PARTITION BY config_id, asset ORDER BY n)),
by_asset AS (SELECT config_id, asset, n, exposure, earned - CASE WHEN ahead OR back THEN 0.0 ELSE paid END - coalesce(lag(CASE WHEN ahead THEN paid ELSE 0.0 END) OVER w, 0.0)
  - coalesce(lead(CASE WHEN back THEN paid ELSE 0.0 END) OVER w, 0.0) AS contribution FROM stray WINDOW w AS (PARTITION BY config_id, asset ORDER BY n))"""

_TRADES = """
side AS (SELECT *, CASE WHEN abs(exposure) > 1e-9 THEN sign(exposure) ELSE 0 END AS s FROM by_asset),
turn AS (SELECT *, CASE WHEN s <> coalesce(lag(s) OVER (PARTITION BY config_id, asset ORDER BY n), 0) THEN 1 ELSE 0 END AS t FROM side),
spell AS (SELECT *, sum(t) OVER (PARTITION BY config_id, asset ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM turn),
trades AS (SELECT config_id, asset, CASE WHEN s > 0 THEN 'long' ELSE 'short' END AS direction, min(cal.date) AS entry, max(cal.date) AS exit, CAST(count(*) AS INTEGER) AS bars, avg(abs(exposure)) AS avg_weight, sum(contribution) AS pnl
  FROM spell JOIN cal ON cal.n = spell.n WHERE s <> 0 GROUP BY config_id, asset, k, s)"""

_MOVES = ("ret", "gross", "cost", "turnover", "participation", "held", "equity")


def _rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


BOOKS = {
    f"bt_daily_{e}": _with(f"SELECT config_id, n, {_rounded(*_MOVES)} FROM daily", _BARS, _INPUTS, _BOOKS, walk(e)) for e in ("next_open", "next_close", "same_close")
}
_SIMULATED = (_BARS, _INPUTS, _BOOKS, walk("next_open"))
BOOKS["trades"] = _with(f"SELECT config_id, asset, direction, entry, exit, bars, {_rounded('avg_weight', 'pnl')} FROM trades", *_SIMULATED, _ASSETS, _TRADES)

BOOKS["blend"] = _with(
    "SELECT 'blend' AS config_id, n, date, round(sum(share * ret), 6) AS r FROM b4 GROUP BY n, date",
    *_SIMULATED,
    f"""b1 AS (SELECT config_id, n, date, ret, {_roll('stddev_samp', 'ret', 63, 21, 'PARTITION BY config_id ')} AS v FROM daily JOIN cal USING (n)),
b2 AS (SELECT *, 1 / nullif(lag(v) OVER (PARTITION BY config_id ORDER BY n), 0) AS inv FROM b1),
b3 AS (SELECT *, inv / sum(inv) OVER (PARTITION BY n) AS part FROM b2),
b4 AS (SELECT *, coalesce(first_value(part IGNORE NULLS) OVER (PARTITION BY config_id, date_trunc('month', date) ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.25) AS share FROM b3)""",
)

_SUMMARY = f"""
rr AS (SELECT config_id, d.n, bret.date, d.ret AS r, bret.r AS b, turnover, cost, participation FROM daily d JOIN bret ON bret.n = d.n),
q5 AS (SELECT config_id, quantile_cont(r, 0.05) AS q, avg(r) AS mu FROM rr GROUP BY config_id),
fa AS (SELECT config_id, min(date) AS start, max(date) AS "end", count(*) AS m, product(1 + r) AS g, product(1 + b) AS gb, stddev_samp(r) * sqrt(365) AS ann_vol, {_SHARPE.format(x='r')} AS sharpe,
  CASE WHEN sqrt(avg(pow(least(r, 0.0), 2))) >= 1e-12 THEN avg(r) / sqrt(avg(pow(least(r, 0.0), 2))) * sqrt(365) ELSE 0.0 END AS sortino, avg(r) AS mean, stddev_samp(r) AS sd,
  avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5) AS skew, avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2) - 3 AS kurtosis, -any_value(q) AS var_95, -avg(r) FILTER (r <= q) AS cvar_95,
  max(r) AS best_day, min(r) AS worst_day, avg(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS pct_positive_days, {_SHARPE.format(x='b')} AS benchmark_sharpe, covar_samp(r, b) / var_samp(b) AS beta,
  (avg(r) - covar_samp(r, b) / var_samp(b) * avg(b)) * 365 AS alpha_ann, corr(r, b) AS correlation, stddev_samp(r - b) * sqrt(365) AS tracking_error, avg(r - b) * sqrt(365) / stddev_samp(r - b) AS information_ratio,
  avg(turnover) * 365 AS annual_turnover, avg(cost) * 365 AS annual_cost_drag, max(participation) AS max_participation FROM rr JOIN q5 USING (config_id) GROUP BY config_id),
yr AS (SELECT config_id, avg(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS positive_years, min(y) AS worst_year FROM (SELECT config_id, product(1 + r) - 1 AS y FROM rr GROUP BY config_id, year(date)) GROUP BY config_id),
cu AS (SELECT config_id, n, date, product(1 + r) OVER w AS er, product(1 + b) OVER w AS eb FROM rr WINDOW w AS (PARTITION BY config_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fd AS (SELECT *, er / max(er) OVER w - 1 AS dd, eb / max(eb) OVER w - 1 AS db FROM cu WINDOW w AS (PARTITION BY config_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lo AS (SELECT config_id, arg_min(n, dd) AS lowest, -min(dd) AS max_drawdown, -min(db) AS benchmark_max_drawdown, max(date) AS last, min(date) AS begun FROM fd GROUP BY config_id),
du AS (SELECT lo.config_id, any_value(max_drawdown) AS max_drawdown, any_value(benchmark_max_drawdown) AS benchmark_max_drawdown,
  CAST(date_diff('day', coalesce(max(date) FILTER (n <= lowest AND dd = 0), any_value(begun)), coalesce(min(date) FILTER (n >= lowest AND dd >= 0), any_value(last))) AS INTEGER) AS max_dd_duration_days FROM fd JOIN lo USING (config_id) GROUP BY lo.config_id),
tr AS (SELECT config_id, count(*) AS n_trades, CASE WHEN count(*) >= 10 THEN avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) END AS win_rate,
  CASE WHEN count(*) >= 10 THEN CASE WHEN sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0.0 END) < 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0.0 END) / -sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0.0 END) ELSE 'inf'::DOUBLE END END AS profit_factor,
  avg(bars) AS avg_trade_bars FROM trades GROUP BY config_id),
ex AS (SELECT config_id, avg(x) AS avg_gross_exposure, avg(y) AS avg_net_exposure, avg(CASE WHEN x > 1e-9 THEN 1 ELSE 0 END) AS time_in_market FROM (SELECT config_id, n, sum(abs(exposure)) AS x, sum(exposure) AS y FROM by_asset GROUP BY config_id, n) GROUP BY config_id),
al AS (SELECT *, m / 365.0 AS years, g - 1 AS total_return, pow(g, 365.0 / m) - 1 AS cagr, pow(gb, 365.0 / m) - 1 AS benchmark_cagr FROM fa JOIN yr USING (config_id) JOIN du USING (config_id) JOIN ex USING (config_id) LEFT JOIN tr USING (config_id)),
su AS (SELECT *, cagr / nullif(max_drawdown, 0) AS calmar, cagr - benchmark_cagr AS excess_cagr FROM al)"""

_FACTS = (
    "ann_vol", "sharpe", "sortino", "mean", "sd", "skew", "kurtosis", "var_95", "cvar_95", "best_day", "worst_day", "pct_positive_days", "benchmark_sharpe", "beta", "alpha_ann", "correlation", "tracking_error",
    "information_ratio", "positive_years", "worst_year", "max_drawdown", "years", "total_return", "cagr", "calmar", "benchmark_max_drawdown", "benchmark_cagr", "excess_cagr", "win_rate", "profit_factor", "avg_trade_bars",
    "annual_turnover", "annual_cost_drag", "max_participation", "avg_gross_exposure", "avg_net_exposure", "time_in_market",
)
BOOKS["metrics_books"] = _with(
    f'SELECT config_id, start, "end", m, max_dd_duration_days, coalesce(n_trades, 0) AS n_trades, {_rounded(*_FACTS)} FROM su', *_SIMULATED, _ASSETS, _TRADES, _SUMMARY
)

BOOKS["overview"] = _with(
    f"""SELECT ov.date AS as_of, 'ALL' AS benchmark, {_rounded('return_1m', 'return_3m', 'return_6m', 'return_12m')}, round(close / sma200 - 1, 6) AS distance_from_200d_sma, sma50 > sma200 AS sma50_above_sma200,
  round(close / top - 1, 6) AS drawdown_from_high, round(v, 6) AS realised_vol_21d, round(mid, 6) AS realised_vol_3y_median, round(below * 1.0 / rows_, 6) AS vol_percentile_3y, trend AS trend_regime, vol AS vol_regime,
  breadth_above_200d, breadth_above_50d, dispersion_3m, corr AS avg_pairwise_corr_63d, round(part, 6) AS corr_percentile_3y
  FROM ov JOIN reg ON reg.n = ov.n, vs, ({ORACLES['breadth'].removeprefix('WITH RECURSIVE ' + _BARS.strip() + ', ').join(('WITH ', ''))}),
  (SELECT arg_max(corr, last) AS corr, avg(CASE WHEN corr_ <= now THEN 1 ELSE 0 END) FILTER (last < fin) AS part FROM
    (SELECT last, round(corr, 6) AS corr, corr AS corr_, max(last) OVER () AS fin, first_value(corr) OVER (ORDER BY last DESC) AS now FROM ({ORACLES['avg_corr'].removeprefix('WITH RECURSIVE ' + _BARS.strip() + ', ').replace('round(2 *', '(2 *').replace(', 6) AS corr FROM cc', ') AS corr FROM cc').join(('WITH ', ''))})))
  WHERE ov.n = (SELECT max(n) FROM cal)""",
    _BARS,
    _REGIMES,
    f"""ov AS (SELECT n, date, close, close / lag(close, 21) OVER w - 1 AS return_1m, close / lag(close, 63) OVER w - 1 AS return_3m, close / lag(close, 126) OVER w - 1 AS return_6m, close / lag(close, 252) OVER w - 1 AS return_12m,
  {_roll('avg', 'close', 50, 50, '')} AS sma50, {_roll('avg', 'close', 200, 200, '')} AS sma200, max(close) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top, ({_roll('stddev_samp', 'r0', 21, 21, '')}) * sqrt(365) AS v FROM bret WINDOW w AS (ORDER BY n)),
vs AS (SELECT median(v) AS mid, count(*) FILTER (v <= (SELECT v FROM ov WHERE n = (SELECT max(n) FROM cal))) AS below, count(*) AS rows_ FROM ov WHERE n > (SELECT max(n) FROM cal) - 756)""",
)
BOOKS["overlay_voltarget"] = _with(
    "SELECT asset, n, round(w * scale, 6) AS w FROM base JOIN sc USING (n)",
    _BARS,
    f"""base AS ({_plain('weights_xs_momentum')}),
pr AS (SELECT asset, n, coalesce(lag(w) OVER (PARTITION BY asset ORDER BY n), 0.0) AS held FROM base),
pb AS (SELECT n, sum(held * coalesce(r, 0.0)) AS b FROM pr JOIN feat USING (asset, n) GROUP BY n),
pv AS (SELECT n, ({_roll('stddev_samp', 'b', 63, 21, '')}) * sqrt(252) AS v FROM pb),
sc AS (SELECT n, CASE WHEN v IS NULL THEN 1.0 WHEN v = 0 THEN 1.0 ELSE floor(least(1.0, 0.12 / v) * 10) / 10 END AS scale FROM pv)""",
)


BOOKS["crises"] = _with(
    """SELECT asset AS config_id, 'Benchmark drawdown ' || peak || ' to ' || trough AS episode, round(product(1 + coalesce(feat.r, 0.0)) - 1, 6) AS strategy, round(product(1 + bret.r) - 1, 6) AS benchmark
  FROM deep JOIN feat ON feat.date BETWEEN peak AND trough JOIN bret ON bret.n = feat.n GROUP BY asset, peak, trough""",
    _BARS,
    _BENCH_DD,
    "deep AS (SELECT arg_min(prior, n) AS peak, arg_min(date, dd) AS trough FROM isl WHERE dd < 0 GROUP BY island HAVING -min(dd) >= 0.01 ORDER BY -min(dd) DESC, 1 LIMIT 3)",
)


def _low_vol(p: dict) -> str:
    size = "1 / vol" if p["weighting"] == "inverse_vol" else "1.0"
    hold = _hold("share", p["rebalance"], "d").replace("round(", "(").replace(", 6) AS w", ") AS w")
    return (
        f"WITH a AS (SELECT *, {_vol(p['vol_window'])} AS vol FROM feat), b AS ({_chosen('vol', p['frac'], 'ASC', 'a')}), c AS (SELECT *, CASE WHEN chosen THEN {size} ELSE 0.0 END AS raw FROM b), "
        f"d AS (SELECT *, CASE WHEN sum(raw) OVER (PARTITION BY n) > 0 THEN raw / sum(raw) OVER (PARTITION BY n) ELSE 0.0 END AS share FROM c) {hold}"
    )


def _vol_managed(p: dict) -> str:
    hold = _hold("raw", p["rebalance"], "b").replace("round(", "(").replace(", 6) AS w", ") AS w")
    return (
        f"WITH a AS (SELECT *, {_vol(p['vol_window'])} AS vol FROM feat), "
        f"b AS (SELECT *, CASE WHEN vol IS NOT NULL THEN floor(least({p['vol_target']!r} / vol, {p['max_leverage']!r}) * 10) / 10 / avail ELSE 0.0 END AS raw FROM a) {hold}"
    )


def _momentum(p: dict) -> str:
    hold = _hold("raw", p["rebalance"], "c").replace("round(", "(").replace(", 6) AS w", ") AS w")
    keep = "chosen AND score > 0" if p["abs_filter"] else "chosen"
    return (
        f"WITH a AS (SELECT *, lag(close, {p['skip']}) OVER w / lag(close, {p['lookback']}) OVER w - 1 AS score FROM feat WINDOW w AS (PARTITION BY asset ORDER BY n)), b AS ({_chosen('score', p['top_frac'], 'DESC', 'a')}), "
        f"c AS (SELECT *, CASE WHEN {keep} THEN 1.0 ELSE 0.0 END / greatest(count(*) FILTER (chosen) OVER (PARTITION BY n), 1) AS raw FROM b) {hold}"
    )


_RULES = {"low_vol": _low_vol, "vol_managed": _vol_managed, "xs_momentum": _momentum}


def _grid(*names: str) -> str:
    """book of every configuration of the grids."""
    parts = [f"SELECT '{s}#{k:02d}' AS config_id, asset, n, w FROM ({_RULES[s](p)})" for s in names for k, p in enumerate(STRATEGIES[s].combinations())]
    return f"book AS ({' UNION ALL '.join(parts)})"


BOOKS["grid_weights"] = _with("SELECT config_id, asset, ord, n, round(w, 6) AS w FROM book JOIN assets USING (asset)", _BARS, _grid("low_vol", "xs_momentum"))

_SAMPLE = ResearchConfig("", [], "").oos_fraction
_SENSITIVITY = f"""
cut AS (SELECT least(300, count(*) // 4) AS warm, count(*) AS total FROM cal),
samp AS (SELECT config_id, n, date, ret AS r, n <= warm + floor((total - warm) * (1 - {_SAMPLE!r})) AS early, n >= warm + floor((total - warm) * (1 - {_SAMPLE!r})) AS late FROM daily JOIN cal USING (n), cut WHERE n >= warm),
curve AS (SELECT *, product(1 + r) OVER (PARTITION BY config_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM samp),
fell AS (SELECT *, eq / max(eq) OVER (PARTITION BY config_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM curve),
sens AS (SELECT config_id, {_SHARPE.format(x='CASE WHEN early THEN r END')} AS is_sharpe, {_SHARPE.format(x='CASE WHEN late THEN r END')} AS oos_sharpe, {_SHARPE.format(x='r')} AS full_sharpe, -min(dd) AS full_max_dd FROM fell GROUP BY config_id)"""
_GRID = (_BARS, _INPUTS, _grid("low_vol", "vol_managed"), walk("next_open"), _SENSITIVITY)

BOOKS["sensitivity"] = _with(f"SELECT config_id, {_rounded('is_sharpe', 'oos_sharpe', 'full_sharpe', 'full_max_dd')} FROM sens", *_GRID)
BOOKS["robustness"] = _with(
    f"""SELECT strategy, count(*) AS grid_size, round(max(full_sharpe), 6) AS best_sharpe, round(median(full_sharpe), 6) AS median_sharpe,
  round(CASE WHEN max(full_sharpe) > 0 THEN greatest(0.0, median(full_sharpe) / max(full_sharpe)) ELSE 0.0 END, 6) AS median_to_best, round(avg(CASE WHEN full_sharpe > 0 THEN 1 ELSE 0 END), 6) AS frac_positive,
  round(CASE WHEN count(*) > 2 AND stddev_samp(is_sharpe) > 0 AND stddev_samp(oos_sharpe) > 0 THEN corr(i, o) END, 6) AS is_oos_rank_corr FROM ranked GROUP BY strategy""",
    *_GRID,
    """ranked AS (SELECT *, rank() OVER (PARTITION BY strategy ORDER BY is_sharpe) + (count(*) OVER (PARTITION BY strategy, is_sharpe) - 1) / 2.0 AS i, rank() OVER (PARTITION BY strategy ORDER BY oos_sharpe) + (count(*) OVER (PARTITION BY strategy, oos_sharpe) - 1) / 2.0 AS o
  FROM (SELECT *, split_part(config_id, '#', 1) AS strategy FROM sens))""",
)

_NAMES = ("low_vol", "vol_managed")
_NEAR = ", ".join(
    f"('{s}#{k:02d}', '{s}#{j:02d}')" for s in _NAMES for k, near in enumerate(neighbours(STRATEGIES[s].combinations(), STRATEGIES[s].grid)) for j in near
)
#: Walk-forward windows by calendar days, the best plateau of each training period, and the books stitched from them.
_CHOICES = f"""
frame AS (SELECT (SELECT date FROM cal, cut WHERE n = warm) AS start, (SELECT max(date) FROM cal) AS last),
years AS (SELECT *, date_diff('day', start, last) / 365.25 AS y FROM frame),
size AS (SELECT *, CASE WHEN y < 7 THEN greatest(1.0, round(0.4 * y, 1)) ELSE 5.0 END AS train, CASE WHEN y < 7 THEN greatest(0.25, round(0.15 * y, 2)) ELSE 1.0 END AS test FROM years),
steps AS (SELECT *, CAST(round(train * 365.25) AS INTEGER) AS td, CAST(round(test * 365.25) AS INTEGER) AS xd FROM size),
roll(k, a) AS (SELECT 0, start + td FROM steps UNION ALL SELECT k + 1, a + xd FROM roll, steps WHERE a + xd < last),
raw_win AS (SELECT k, a - td AS train_start, a - 1 AS train_end, a AS test_start, least(a + xd, last + 1) - 1 AS test_end, max(k) OVER () AS final FROM roll, steps),
stub AS (SELECT coalesce(max(k) FILTER (k = final AND k > 0 AND date_diff('day', test_start, test_end) < 90 * test), 1000000) AS cut_k, max(test_end) AS upto FROM raw_win, steps),
win AS (SELECT k, train_start, train_end, test_start, CASE WHEN k = cut_k - 1 THEN upto ELSE test_end END AS test_end FROM raw_win, stub WHERE k < cut_k),
score AS (SELECT config_id, k, {_SHARPE.format(x='ret')} AS s FROM daily JOIN cal USING (n) JOIN win ON cal.date BETWEEN train_start AND train_end GROUP BY config_id, k),
near(config_id, other) AS (VALUES {_NEAR}),
about AS (SELECT near.config_id, k, avg(s) AS around FROM near JOIN score ON score.config_id = near.other GROUP BY near.config_id, k),
flat AS (SELECT score.config_id, score.k, round(CASE WHEN around IS NULL THEN s ELSE least(s, (s + around) / 2) END, 12) AS v FROM score LEFT JOIN about ON about.config_id = score.config_id AND about.k = score.k),
picked AS (SELECT split_part(config_id, '#', 1) AS strategy, config_id, test_start, test_end FROM flat JOIN win USING (k) QUALIFY row_number() OVER (PARTITION BY split_part(config_id, '#', 1), k ORDER BY v DESC, config_id) = 1),
stitched AS (SELECT s.strategy AS config_id, b.asset, b.n, coalesce(t.w, 0.0) AS w FROM bars b CROSS JOIN (SELECT DISTINCT strategy FROM picked) s LEFT JOIN picked p ON p.strategy = s.strategy AND b.date BETWEEN test_start AND test_end
  LEFT JOIN book t ON t.config_id = p.config_id AND t.asset = b.asset AND t.n = b.n),
opened AS (SELECT min(test_start) AS day FROM win)"""
_CHOSEN = (*_GRID, _CHOICES)
BOOKS["select_params"] = _with("SELECT strategy, config_id, CAST(test_start AS DATE) AS test_start, CAST(test_end AS DATE) AS test_end FROM picked", *_CHOSEN)


def _walked(body: str, execution: str = "next_open", costs: CostModel = _COSTS, *more: str) -> str:
    """A subquery over the simulation of the stitched books."""
    ctes = ", ".join(c.strip() for c in ("book AS (SELECT * FROM stitched_)", walk(execution, costs), *more))
    return f"(WITH RECURSIVE {ctes} {body})"


def _forward(body: str) -> str:
    return _with(body, *_CHOSEN, "stitched_ AS MATERIALIZED (SELECT * FROM stitched)")


BOOKS["walk_forward"] = _forward(f"SELECT config_id, n, date, round(ret, 6) AS r FROM {_walked('SELECT config_id, n, ret FROM daily')} JOIN cal USING (n), opened WHERE date >= day")
BOOKS["concentration"] = _forward(
    f"""SELECT config_id, arg_max(asset, pnl) FILTER (pnl > 0) AS top_asset, round(max(pnl) FILTER (pnl > 0) / sum(pnl) FILTER (pnl > 0), 6) AS top_asset_share
  FROM (SELECT config_id, asset, sum(contribution) AS pnl FROM {_walked('SELECT * FROM by_asset', 'next_open', _COSTS, _ASSETS)} JOIN cal USING (n), opened WHERE date >= day GROUP BY config_id, asset) GROUP BY config_id"""
)
_SCENARIOS = {
    "base": ("next_open", _COSTS), "costs_x2": ("next_open", _COSTS.scaled(2)), "costs_x3": ("next_open", _COSTS.scaled(3)),
    "delay_1_session": ("next_close", _COSTS), "same_close_optimistic": ("same_close", _COSTS),
}
BOOKS["stress"] = _forward(
    " UNION ALL ".join(
        f"SELECT config_id, '{name}' AS scenario, round({_SHARPE.format(x='ret')}, 6) AS sharpe FROM {_walked('SELECT config_id, n, ret FROM daily', *how)} JOIN cal USING (n), opened WHERE date >= day GROUP BY config_id"
        for name, how in _SCENARIOS.items()
    )
)

_FORMATION = """
ends AS (SELECT unnest(range(252, (SELECT count(*) FROM cal), 63)) AS f_end),
px AS (SELECT f_end, asset, ord, n, ln(close) AS p FROM ends JOIN bars ON bars.n >= f_end - 252 AND bars.n < f_end WHERE close > 0),
full_ AS (SELECT f_end, asset FROM px GROUP BY f_end, asset HAVING count(*) = 252),
pw AS (SELECT px.* FROM px JOIN full_ USING (f_end, asset)),
pp AS (SELECT a.f_end, a.n, a.asset AS y, b.asset AS x, a.ord AS yo, b.ord AS xo, a.p AS py, b.p AS px FROM pw a JOIN pw b ON a.f_end = b.f_end AND a.n = b.n AND a.ord < b.ord),
fit AS (SELECT f_end, y, x, covar_pop(py, px) / nullif(var_pop(px), 0) AS beta FROM pp GROUP BY f_end, y, x),
res AS (SELECT pp.f_end, pp.y, pp.x, yo, xo, n, beta, py - beta * px AS e FROM pp JOIN fit ON fit.f_end = pp.f_end AND fit.y = pp.y AND fit.x = pp.x WHERE beta > 0),
stp AS (SELECT *, lag(e) OVER (PARTITION BY f_end, y, x ORDER BY n) AS l FROM res),
adf AS (SELECT f_end, y, x, any_value(yo) AS yo, any_value(xo) AS xo, any_value(beta) AS beta, regr_slope(e - l, l) / sqrt(greatest(0.0, regr_syy(e - l, l) - regr_slope(e - l, l) * regr_sxy(e - l, l)) / 249 / regr_sxx(e - l, l)) AS t FROM stp WHERE l IS NOT NULL GROUP BY f_end, y, x),
one AS (SELECT * FROM adf WHERE t < -3 QUALIFY row_number() OVER (PARTITION BY f_end ORDER BY t, yo, xo) = 1),
two AS (SELECT c.* FROM adf c JOIN one USING (f_end) WHERE c.t < -3 AND c.y NOT IN (one.y, one.x) AND c.x NOT IN (one.y, one.x) QUALIFY row_number() OVER (PARTITION BY c.f_end ORDER BY c.t, c.yo, c.xo) = 1),
three AS (SELECT c.* FROM adf c JOIN one USING (f_end) JOIN two USING (f_end) WHERE c.t < -3 AND c.y NOT IN (one.y, one.x, two.y, two.x) AND c.x NOT IN (one.y, one.x, two.y, two.x) QUALIFY row_number() OVER (PARTITION BY c.f_end ORDER BY c.t, c.yo, c.xo) = 1),
prs AS (SELECT f_end, y, x, beta, t FROM one UNION ALL SELECT f_end, y, x, beta, t FROM two UNION ALL SELECT f_end, y, x, beta, t FROM three)"""
BOOKS["leave_one_out"] = _with(
    f"""SELECT config_id, round({_SHARPE.format(x='ret')}, 6) AS sharpe FROM (WITH RECURSIVE book AS (SELECT s.config_id || '|' || o.asset AS config_id, s.asset, s.n, CASE WHEN s.asset = o.asset THEN 0.0 ELSE s.w END AS w FROM stitched_ s JOIN largest o ON o.config_id = s.config_id),
  {walk('next_open').strip()} SELECT config_id, n, ret FROM daily) JOIN cal USING (n), opened WHERE date >= day GROUP BY config_id""",
    *_CHOSEN,
    "stitched_ AS MATERIALIZED (SELECT * FROM stitched)",
    f"""gained AS (SELECT config_id, asset, sum(contribution) AS pnl FROM {_walked('SELECT * FROM by_asset', 'next_open', _COSTS, _ASSETS)} JOIN cal USING (n), opened WHERE date >= day GROUP BY config_id, asset),
largest AS (SELECT config_id, asset FROM gained QUALIFY row_number() OVER (PARTITION BY config_id ORDER BY abs(pnl) DESC, asset) <= 6)""",
)
BOOKS["formation_pairs"] = _with("SELECT f_end, y, x, round(beta, 6) AS beta, round(t, 6) AS t FROM prs", _BARS, _FORMATION)

#: A pair's spread from 20 sessions before its period to the period's end; in it, a position of -1, 0 or 1.
BOOKS["weights_pairs_stat_arb"] = _with(
    "SELECT b.asset, b.n, round(coalesce(w, 0.0), 6) AS w FROM bars b LEFT JOIN (SELECT asset, n, sum(w) AS w FROM legs GROUP BY asset, n) l ON l.asset = b.asset AND l.n = b.n",
    _BARS,
    _FORMATION,
    f"""sp AS (SELECT p.f_end, p.y, p.x, p.beta, cal.n, ln(a.close) - p.beta * ln(b.close) AS s FROM prs p JOIN cal ON cal.n >= greatest(0, p.f_end - 20) AND cal.n < p.f_end + 63
  LEFT JOIN bars a ON a.asset = p.y AND a.n = cal.n AND a.close > 0 LEFT JOIN bars b ON b.asset = p.x AND b.n = cal.n AND b.close > 0),
zz AS (SELECT *, (s - ({_roll('avg', 's', 20, 20, 'PARTITION BY f_end, y, x ')})) / nullif({_roll('stddev_samp', 's', 20, 20, 'PARTITION BY f_end, y, x ')}, 0) AS z FROM sp),
pos(f_end, y, x, beta, n, side) AS (SELECT f_end, y, x, beta, f_end - 1, 0 FROM prs UNION ALL
  SELECT q.f_end, q.y, q.x, q.beta, zz.n, CASE WHEN zz.n = q.f_end + 62 THEN 0 WHEN z IS NULL THEN q.side WHEN q.side = 0 THEN CASE WHEN z < -2.0 THEN 1 WHEN z > 2.0 THEN -1 ELSE 0 END WHEN q.side * z >= -0.5 THEN 0 ELSE q.side END
  FROM pos q JOIN zz ON zz.f_end = q.f_end AND zz.y = q.y AND zz.x = q.x AND zz.n = q.n + 1),
legs AS (SELECT y AS asset, n, side / (1 + beta) / 3 AS w FROM pos WHERE n >= f_end UNION ALL SELECT x, n, -side * beta / (1 + beta) / 3 FROM pos WHERE n >= f_end)""",
)


