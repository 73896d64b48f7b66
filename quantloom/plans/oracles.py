"""DuckDB SQL for the queries that SQL can express, with the same columns."""

_RAW = """
li AS (SELECT l_returnflag || l_linestatus AS asset, CAST(l_shipdate AS DATE) AS date, l_orderkey * 100 + l_linenumber AS k, l_extendedprice / l_quantity AS u,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem),
both_ AS (SELECT * FROM li UNION ALL SELECT 'ALL', date, k, u, p, q FROM li),
raw AS (SELECT asset, date, 100 * pow(first(u ORDER BY k, u), 0.05) AS open, 100 * pow(max(u), 0.05) AS high, 100 * pow(min(u), 0.05) AS low,
  100 * pow(CAST(sum(p) AS DOUBLE) / CAST(sum(q) AS DOUBLE), 0.05) AS close, CAST(sum(q) AS DOUBLE) AS volume FROM both_ GROUP BY 1, 2)"""

_BARS = (
    _RAW
    + """,
cal AS (SELECT row_number() OVER (ORDER BY date) - 1 AS n, date, close FROM raw WHERE asset = 'ALL'),
assets AS (SELECT asset, CAST(row_number() OVER (ORDER BY asset) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT asset FROM raw WHERE asset <> 'ALL')),
grid AS (SELECT a.asset, a.ord, c.n, c.date, r.open AS ro, r.high AS rh, r.low AS rl, r.close AS rc, r.volume AS rv FROM cal c CROSS JOIN assets a LEFT JOIN raw r ON r.asset = a.asset AND r.date = c.date),
fill AS (SELECT *, max(CASE WHEN rc IS NOT NULL THEN n END) OVER w AS ln, last_value(rc IGNORE NULLS) OVER w AS fc FROM grid WINDOW w AS (PARTITION BY asset ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
shut AS (SELECT *, CASE WHEN n - ln <= 5 THEN fc END AS close FROM fill),
bars AS (SELECT asset, ord, n, date, CASE WHEN rc IS NULL THEN close ELSE coalesce(ro, close) END AS open, CASE WHEN rc IS NULL THEN close ELSE coalesce(rh, close) END AS high,
  CASE WHEN rc IS NULL THEN close ELSE coalesce(rl, close) END AS low, close, CASE WHEN rc IS NULL AND close IS NOT NULL THEN 0.0 ELSE rv END AS volume FROM shut),
feat AS (SELECT *, close / lag(close) OVER (PARTITION BY asset ORDER BY n) - 1 AS r, greatest(count(close) OVER (PARTITION BY n), 1) AS avail FROM bars),
bret AS (SELECT n, date, close, close / lag(close) OVER (ORDER BY n) - 1 AS r0, coalesce(close / lag(close) OVER (ORDER BY n) - 1, 0.0) AS r FROM cal)"""
)


def _roll(fn: str, x: str, k: int, least: int, key: str = "PARTITION BY asset ") -> str:
    w = f"OVER ({key}ORDER BY n ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {least} THEN {fn}({x}) {w} END"


def _vol(k: int) -> str:
    return f"({_roll('stddev_samp', 'r', k, max(5, k // 2))}) * sqrt(252)"


def _hold(w: str, every: int, source: str) -> str:
    return f"SELECT asset, n, round(coalesce(last_value(CASE WHEN n % {every} = 0 THEN coalesce({w}, 0.0) END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0), 6) AS w FROM {source}"


def _capped(source: str) -> str:
    return f"SELECT *, CASE WHEN sum(abs(raw)) OVER (PARTITION BY n) > 1 THEN raw / sum(abs(raw)) OVER (PARTITION BY n) ELSE raw END AS capped FROM {source}"


def _chosen(score: str, fraction: float, order: str, source: str) -> str:
    return f"SELECT *, {score} IS NOT NULL AND row_number() OVER (PARTITION BY n ORDER BY {score} {order} NULLS LAST, ord) <= greatest(1, ceil(count({score}) OVER (PARTITION BY n) * {fraction})) AS chosen FROM {source}"


_STATE = "coalesce(last_value(CASE WHEN {leave} THEN 0.0 WHEN {enter} THEN 1.0 END IGNORE NULLS) OVER ({key}ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0)"

_REGIMES = f"""
s1 AS (SELECT *, {_roll('avg', 'close', 200, 150, '')} AS sma, ({_roll('stddev_samp', 'r0', 21, 21, '')}) * sqrt(365) AS v FROM bret),
s2 AS (SELECT *, sma - lag(sma, 20) OVER (ORDER BY n) AS slope FROM s1),
s3 AS (SELECT a.n, count(b.v) AS k, count(*) FILTER (b.v < a.v) AS lo, count(*) FILTER (b.v = a.v) AS eq FROM s2 a JOIN s2 b ON b.n BETWEEN a.n - 755 AND a.n WHERE a.v IS NOT NULL GROUP BY a.n),
reg AS (SELECT s2.n, date, CASE WHEN sma IS NULL THEN 'n/a' WHEN close > sma AND slope > 0 THEN 'bull' WHEN close < sma AND slope < 0 THEN 'bear' ELSE 'sideways' END AS trend,
  CASE WHEN k IS NULL OR k < 252 THEN 'n/a' WHEN (lo + (eq + 1) / 2.0) / k >= 0.67 THEN 'high vol' WHEN (lo + (eq + 1) / 2.0) / k <= 0.33 THEN 'low vol' ELSE 'normal vol' END AS vol FROM s2 LEFT JOIN s3 ON s2.n = s3.n)"""


def _rsi(k: int) -> str:
    """Wilder's averages, one row after another; prices have no gap once an asset has begun, or the average keeps decaying."""
    return f"""
d AS (SELECT asset, n, close - lag(close) OVER (PARTITION BY asset ORDER BY n) AS x FROM bars),
e AS (SELECT asset, n, CASE WHEN x IS NULL THEN NULL ELSE greatest(x, 0.0) END AS u, CASE WHEN x IS NULL THEN NULL ELSE greatest(-x, 0.0) END AS v FROM d),
walk(asset, n, up, down, decay, k) AS (
  SELECT asset, n, u, v, CASE WHEN u IS NULL THEN NULL ELSE 1.0 - 1.0 / {k} END, CASE WHEN u IS NULL THEN 0 ELSE 1 END FROM e WHERE n = 0
  UNION ALL
  SELECT e.asset, e.n, CASE WHEN w.up IS NULL THEN e.u WHEN e.u IS NULL THEN w.up ELSE (w.decay * w.up + e.u / {k}) / (w.decay + 1.0 / {k}) END,
    CASE WHEN w.down IS NULL THEN e.v WHEN e.v IS NULL THEN w.down ELSE (w.decay * w.down + e.v / {k}) / (w.decay + 1.0 / {k}) END,
    CASE WHEN e.u IS NOT NULL THEN 1.0 - 1.0 / {k} ELSE w.decay * (1.0 - 1.0 / {k}) END, w.k + CASE WHEN e.u IS NULL THEN 0 ELSE 1 END
  FROM walk w JOIN e ON e.asset = w.asset AND e.n = w.n + 1),
osc AS (SELECT asset, n, CASE WHEN k < {k} OR up IS NULL THEN NULL WHEN down > 0 THEN 100 * up / (up + down) ELSE 100.0 END AS rsi FROM walk)"""


_BENCH_DD = """
eq AS (SELECT n, date, r, product(1 + r) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM bret),
dd AS (SELECT *, e / max(e) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM eq),
isl AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island, coalesce(lag(date) OVER (ORDER BY n), date) AS prior FROM dd)"""


def _with(body: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {', '.join(c.strip() for c in ctes)} {body}"


_SHARPE = "CASE WHEN stddev_samp({x}) >= 1e-12 THEN avg({x}) / stddev_samp({x}) * sqrt(365) ELSE 0.0 END"

ORACLES = {
    "bars": _with("SELECT asset, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM raw", _RAW),
    "aligned_bars": _with("SELECT asset, ord, n, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM bars", _BARS),
    "returns": _with("SELECT asset, n, date, round(r, 6) AS r FROM feat", _BARS),
    "quality": _with(
        """SELECT m.asset, CASE WHEN least_ <= 0 OR jumps > 0 OR flat >= 5 OR date_diff('day', (SELECT min(date) FROM cal), first) > 30 OR date_diff('day', last, (SELECT max(date) FROM cal)) > 7 OR missing > 0.02 * expected THEN 'check' ELSE 'ok' END AS status,
  first, last, observations, missing AS missing_sessions, round(top, 6) AS max_abs_daily_move,
  concat_ws('; ', CASE WHEN least_ <= 0 THEN 'prices of zero or less' END, CASE WHEN jumps > 0 THEN jumps || ' moves over 25%' END, CASE WHEN flat >= 5 THEN 'unchanged for ' || flat || ' days' END,
    CASE WHEN date_diff('day', (SELECT min(date) FROM cal), first) > 30 THEN 'starts ' || first END, CASE WHEN date_diff('day', last, (SELECT max(date) FROM cal)) > 7 THEN 'ends ' || last END,
    CASE WHEN missing > 0.02 * expected THEN missing || ' sessions missing' END) AS flags FROM m JOIN x ON m.asset = x.asset""",
        _BARS,
        """q1 AS (SELECT asset, date, close, close / lag(close) OVER w - 1 AS mv, coalesce(close = lag(close) OVER w, false) AS fl FROM raw WINDOW w AS (PARTITION BY asset ORDER BY date)),
q2 AS (SELECT *, sum(CASE WHEN fl THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY date) AS st FROM q1),
q3 AS (SELECT *, sum(CASE WHEN fl THEN 1 ELSE 0 END) OVER (PARTITION BY asset, st) AS run FROM q2),
m AS (SELECT asset, min(date) AS first, max(date) AS last, count(*) AS observations, max(abs(mv)) AS top, min(close) AS least_, count(*) FILTER (abs(mv) > 0.25) AS jumps, max(run) AS flat FROM q3 GROUP BY asset),
x AS (SELECT m.asset, count(*) AS expected, count(*) FILTER (r.date IS NULL) AS missing FROM m JOIN cal c ON c.date BETWEEN m.first AND m.last LEFT JOIN raw r ON r.asset = m.asset AND r.date = c.date GROUP BY m.asset)""",
    ),
    "regimes": _with("SELECT n, date, trend, vol FROM reg", _BARS, _REGIMES),
    "breadth": _with(
        "SELECT round(avg(CASE WHEN close > a200 THEN 1 ELSE 0 END), 6) AS breadth_above_200d, round(avg(CASE WHEN close > a50 THEN 1 ELSE 0 END), 6) AS breadth_above_50d, round(stddev_samp(q), 6) AS dispersion_3m FROM z WHERE n = (SELECT max(n) FROM cal)",
        _BARS,
        f"z AS (SELECT n, close, {_roll('avg', 'close', 200, 200)} AS a200, {_roll('avg', 'close', 50, 50)} AS a50, close / lag(close, 63) OVER (PARTITION BY asset ORDER BY n) - 1 AS q FROM bars)",
    ),
    "avg_corr": _with(
        "SELECT last, round(2 * sum(coalesce(c, 0.0)) / (6 * 5), 6) AS corr FROM cc GROUP BY last",
        _BARS,
        """t AS (SELECT count(*) AS t FROM cal), ends AS (SELECT t AS last FROM t UNION ALL SELECT e FROM (SELECT unnest(range(t - 756, t, 21)) AS e FROM t) WHERE e > 63),
cc AS (SELECT e.last, a.asset AS x, b.asset AS y, CASE WHEN count(*) > 1 THEN corr(a.r, b.r) END AS c FROM ends e JOIN feat a ON a.n < e.last AND a.n >= e.last - 63 JOIN feat b ON b.n = a.n AND a.asset < b.asset WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2, 3)""",
    ),
    "rsi": _with("SELECT asset, n, round(rsi, 6) AS rsi_14 FROM osc", _BARS, _rsi(14)),
    "weights_trend_tsmom": _with(
        _hold("capped", 5, "c"),
        _BARS,
        f"a AS (SELECT *, close / lag(close, 252) OVER (PARTITION BY asset ORDER BY n) - 1 AS mom, {_vol(63)} AS vol FROM feat), b AS (SELECT *, CASE WHEN mom IS NOT NULL AND vol IS NOT NULL THEN least(1.0, CASE WHEN mom > 0 THEN 0.15 / vol / avail ELSE 0.0 END) ELSE 0.0 END AS raw FROM a), c AS ({_capped('b')})",
    ),
    "weights_vol_managed": _with(_hold("raw", 5, "b"), _BARS, f"a AS (SELECT *, {_vol(21)} AS vol FROM feat), b AS (SELECT *, CASE WHEN vol IS NOT NULL THEN floor(least(0.12 / vol, 1.0) * 10) / 10 / avail ELSE 0.0 END AS raw FROM a)"),
    "weights_donchian_breakout": _with(
        "SELECT asset, n, round(capped, 6) AS w FROM e",
        _BARS,
        f"""a AS (SELECT *, CASE WHEN count(high) OVER u >= 55 THEN max(high) OVER u END AS up, CASE WHEN count(low) OVER l >= 20 THEN min(low) OVER l END AS lo, {_vol(63)} AS vol FROM feat
  WINDOW u AS (PARTITION BY asset ORDER BY n ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING), l AS (PARTITION BY asset ORDER BY n ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, {_STATE.format(leave='close < lo', enter='close > up', key='PARTITION BY asset ')} AS pos FROM a),
c AS (SELECT *, CASE WHEN pos - coalesce(lag(pos) OVER (PARTITION BY asset ORDER BY n), 0.0) > 0 AND vol IS NOT NULL THEN least(1.0, 0.15 / vol / avail) END AS size FROM b),
d AS (SELECT *, coalesce(pos * last_value(size IGNORE NULLS) OVER (PARTITION BY asset ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS raw FROM c), e AS ({_capped('d')})""",
    ),
    "weights_xs_momentum": _with(
        _hold("raw", 21, "c"),
        _BARS,
        f"a AS (SELECT *, lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS score FROM feat WINDOW w AS (PARTITION BY asset ORDER BY n)), b AS ({_chosen('score', 0.33, 'DESC', 'a')}), c AS (SELECT *, CASE WHEN chosen THEN 1.0 ELSE 0.0 END / greatest(count(*) FILTER (chosen) OVER (PARTITION BY n), 1) AS raw FROM b)",
    ),
    "weights_xs_reversal": _with(
        _hold("raw", 5, "c"),
        _BARS,
        f"a AS (SELECT *, close / lag(close, 5) OVER (PARTITION BY asset ORDER BY n) - 1 AS score FROM feat), b AS ({_chosen('score', 0.25, 'ASC', 'a')}), c AS (SELECT *, CASE WHEN chosen THEN 1.0 ELSE 0.0 END / greatest(count(*) FILTER (chosen) OVER (PARTITION BY n), 1) AS raw FROM b)",
    ),
    "weights_low_vol": _with(
        _hold("share", 21, "d"),
        _BARS,
        f"a AS (SELECT *, {_vol(126)} AS vol FROM feat), b AS ({_chosen('vol', 0.33, 'ASC', 'a')}), c AS (SELECT *, CASE WHEN chosen THEN 1 / vol ELSE 0.0 END AS raw FROM b), d AS (SELECT *, CASE WHEN sum(raw) OVER (PARTITION BY n) > 0 THEN raw / sum(raw) OVER (PARTITION BY n) ELSE 0.0 END AS share FROM c)",
    ),
    "weights_turn_of_month": _with(
        "SELECT asset, n, round(CASE WHEN (left_ <= 2 OR ord_ <= 3) AND close IS NOT NULL THEN 1.0 ELSE 0.0 END / avail, 6) AS w FROM feat JOIN t USING (n)",
        _BARS,
        """nx AS (SELECT n, CAST(date + CASE isodow(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE) AS d FROM cal),
t AS (SELECT n, (SELECT count(*) FROM (SELECT unnest(generate_series(date_trunc('month', d), d, INTERVAL 1 DAY)) AS x) WHERE isodow(x) <= 5) AS ord_,
  (SELECT count(*) FROM (SELECT unnest(generate_series(CAST(d AS TIMESTAMP), date_trunc('month', d) + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS x) WHERE isodow(x) <= 5) AS left_ FROM nx)""",
    ),
    "overlay_regime": _with(
        f"SELECT h.asset, h.n, round(h.w * o.on_, 6) AS w FROM ({_hold('raw', 5, 'b').replace('round(', '(').replace(', 6) AS w', ') AS w')}) h JOIN o ON o.n = h.n",
        _BARS,
        f"a AS (SELECT *, {_vol(21)} AS vol FROM feat), b AS (SELECT *, CASE WHEN vol IS NOT NULL THEN floor(least(0.12 / vol, 1.0) * 10) / 10 / avail ELSE 0.0 END AS raw FROM a)",
        f"s AS (SELECT n, close, {_roll('avg', 'close', 200, 200, '')} AS sma FROM cal), o AS (SELECT n, {_STATE.format(leave='close < 0.98 * sma', enter='close > sma', key='')} AS on_ FROM s)",
    ),
    "metrics_benchmark": _with(
        f"""SELECT 'benchmark' AS config_id, m, round(g - 1, 6) AS total_return, round(pow(g, 365.0 / m) - 1, 6) AS cagr, round(vol, 6) AS ann_vol, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(mdd, 6) AS max_drawdown, round(skew, 6) AS skew, round(kurt, 6) AS kurtosis,
  round(-q, 6) AS var_95, round(cvar, 6) AS cvar_95, round(best, 6) AS best_day, round(worst, 6) AS worst_day, round(up, 6) AS pct_positive_days, round((SELECT avg(CASE WHEN y > 0 THEN 1 ELSE 0 END) FROM yr), 6) AS positive_years, round((SELECT min(y) FROM yr), 6) AS worst_year FROM f""",
        _BARS,
        _BENCH_DD,
        f"""q AS (SELECT quantile_cont(r, 0.05) AS q, avg(r) AS mu FROM bret), yr AS (SELECT year(date) AS k, product(1 + r) - 1 AS y FROM bret GROUP BY 1),
f AS (SELECT count(*) AS m, product(1 + r) AS g, stddev_samp(r) * sqrt(365) AS vol, {_SHARPE.format(x='r')} AS sharpe, avg(r) / sqrt(avg(pow(least(r, 0.0), 2))) * sqrt(365) AS sortino, (SELECT -min(dd) FROM dd) AS mdd,
  avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5) AS skew, avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2) - 3 AS kurt, any_value(q) AS q, -avg(r) FILTER (r <= q) AS cvar, max(r) AS best, min(r) AS worst, avg(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS up FROM bret, q)""",
    ),
    "metrics_assets": _with(
        f"""SELECT asset AS config_id, count(*) AS m, round(stddev_samp(a.r) * sqrt(365), 6) AS ann_vol, round({_SHARPE.format(x='a.r')}, 6) AS sharpe, round(covar_samp(a.r, b.r) / var_samp(b.r), 6) AS beta, round(corr(a.r, b.r), 6) AS correlation,
  round((avg(a.r) - covar_samp(a.r, b.r) / var_samp(b.r) * avg(b.r)) * 365, 6) AS alpha_ann, round(stddev_samp(a.r - b.r) * sqrt(365), 6) AS tracking_error, round(avg(a.r - b.r) * sqrt(365) / stddev_samp(a.r - b.r), 6) AS information_ratio FROM feat a JOIN bret b ON a.n = b.n WHERE a.r IS NOT NULL GROUP BY asset""",
        _BARS,
    ),
    "yearly": _with("SELECT 'benchmark' AS config_id, CAST(year(date) AS INTEGER) AS year, round(product(1 + r) - 1, 6) AS r FROM bret GROUP BY 2", _BARS),
    "rolling_sharpe": _with("SELECT n, round(CASE WHEN count(r) OVER w >= 252 THEN avg(r) OVER w / stddev_samp(r) OVER w * sqrt(365) END, 6) AS sharpe FROM bret WINDOW w AS (ORDER BY n ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)", _BARS),
    "drawdown": _with(
        """SELECT 'benchmark' AS config_id, round(-(SELECT dd FROM tr), 6) AS max_drawdown, p AS peak, (SELECT date FROM tr) AS trough, rec AS recovery, CAST(date_diff('day', p, coalesce(rec, last)) AS INTEGER) AS duration_days, (SELECT max(c) FROM (SELECT count(*) FILTER (dd < 0) AS c FROM isl GROUP BY island)) AS longest_underwater_bars FROM f""",
        _BARS,
        _BENCH_DD,
        """tr AS (SELECT n, date, dd FROM dd ORDER BY dd, n LIMIT 1), f AS (SELECT coalesce(max(date) FILTER (n <= (SELECT n FROM tr) AND dd = 0), min(date)) AS p, min(date) FILTER (n >= (SELECT n FROM tr) AND dd >= 0) AS rec, max(date) AS last FROM dd)""",
    ),
    "drawdown_episodes": _with("SELECT arg_min(prior, n) AS peak, arg_min(date, dd) AS trough, round(-min(dd), 6) AS depth FROM isl WHERE dd < 0 GROUP BY island HAVING -min(dd) >= 0.01 ORDER BY -min(dd) DESC, 1 LIMIT 3", _BARS, _BENCH_DD),
    "regime_breakdown": _with(
        f"""SELECT asset AS config_id, dimension, regime, round(count(*) * 1.0 / any_value(t), 6) AS share_of_time, round(avg(r) * 365, 6) AS ann_return, round({_SHARPE.format(x='r')}, 6) AS sharpe, round(avg(b) * 365, 6) AS benchmark_ann_return, round({_SHARPE.format(x='b')}, 6) AS benchmark_sharpe FROM u WHERE regime <> 'n/a' GROUP BY 1, 2, 3 HAVING count(*) >= 40""",
        _BARS,
        _REGIMES,
        """j AS (SELECT asset, coalesce(a.r, 0.0) AS r, b.r AS b, trend, vol, (SELECT count(*) FROM cal) AS t FROM feat a JOIN bret b ON a.n = b.n JOIN reg ON reg.n = a.n),
u AS (SELECT asset, r, b, t, 'trend' AS dimension, trend AS regime FROM j UNION ALL SELECT asset, r, b, t, 'vol', vol FROM j)""",
    ),
}
ORACLES["scan"] = _with(
    """SELECT asset, round(r1, 6) AS ret_1m, round(r3, 6) AS ret_3m, round(r6, 6) AS ret_6m, round(r12, 6) AS ret_12m, round(rs, 6) AS rel_strength_6m, round(v3, 6) AS vol_3m, round(hi, 6) AS dist_52w_high, round(rsi, 6) AS rsi14, above AS above_200d, round(z, 6) AS z_1m_move, round(vt, 6) AS volume_trend,
  concat_ws(', ', CASE WHEN z >= 2 THEN 'unusual strength' END, CASE WHEN z <= -2 THEN 'unusual weakness' END, CASE WHEN vt >= 1.5 THEN 'volume surge' END, CASE WHEN rsi < 30 AND above THEN 'oversold in uptrend' END, CASE WHEN rsi > 75 THEN 'overbought' END, CASE WHEN hi > -0.02 THEN 'at 52w high' END, CASE WHEN NOT above AND hi < -0.25 THEN 'broken trend' END) AS flags,
  CAST(floor(rank() OVER (ORDER BY sc) + (count(*) OVER (PARTITION BY sc) - 1) / 2.0) AS INTEGER) AS momentum_rank FROM sc""",
    _BARS,
    _rsi(14),
    """k AS (SELECT f.*, o.rsi, close / lag(close, 21) OVER (PARTITION BY f.asset ORDER BY f.n) - 1 AS r21, CASE WHEN close IS NOT NULL THEN count(close) OVER (PARTITION BY f.asset ORDER BY f.n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 1 END AS back, (SELECT max(n) FROM cal) AS e FROM feat f JOIN osc o ON o.asset = f.asset AND o.n = f.n),
g AS (SELECT asset, count(close) AS c, max(close) FILTER (back = 0) AS c0, max(close) FILTER (back = 21) AS c1, max(close) FILTER (back = 63) AS c3, max(close) FILTER (back = 126) AS c6, max(close) FILTER (back = 252) AS c12, stddev_samp(r) FILTER (n > e - 63) AS sd, max(close) FILTER (back < 252) AS h, avg(close) FILTER (back < 200) AS a200,
  max(rsi) FILTER (n = e) AS rsi, arg_max(r21, n) FILTER (r21 IS NOT NULL) AS mv, avg(r21) AS m, stddev_samp(r21) AS s, avg(volume) FILTER (n > e - 20) AS v20, avg(volume) FILTER (n > e - 120) AS v120 FROM k GROUP BY asset HAVING count(close) >= 260),
b6 AS (SELECT close / lag(close, 126) OVER (ORDER BY n) - 1 AS b, n FROM cal),
y AS (SELECT asset, c0 / c1 - 1 AS r1, c0 / c3 - 1 AS r3, c0 / c6 - 1 AS r6, c0 / c12 - 1 AS r12, c0 / c6 - 1 - b AS rs, sd * sqrt(365) AS v3, c0 / h - 1 AS hi, rsi, c0 > a200 AS above, CASE WHEN s > 0 THEN (mv - m) / s ELSE 0.0 END AS z, CASE WHEN v120 > 0 THEN v20 / v120 END AS vt FROM g, b6 WHERE b6.n = (SELECT max(n) FROM cal)),
sc AS (SELECT *, ((rank() OVER (ORDER BY r3 DESC) + (count(*) OVER (PARTITION BY r3) - 1) / 2.0) + (rank() OVER (ORDER BY r6 DESC) + (count(*) OVER (PARTITION BY r6) - 1) / 2.0) + (rank() OVER (ORDER BY r12 DESC) + (count(*) OVER (PARTITION BY r12) - 1) / 2.0)) / 3 AS sc FROM y)""",
)

ORACLES["weights_rsi_pullback"] = _with(
    "SELECT h.asset, h.n, round(CASE WHEN age > 0 THEN 1.0 ELSE 0.0 END / avail, 6) AS w FROM held h JOIN feat f ON f.asset = h.asset AND f.n = h.n",
    _BARS,
    _rsi(2),
    f"""sig AS (SELECT f.asset, f.n, coalesce(o.rsi < 10 AND f.close > f.sma, false) AS enter, coalesce(o.rsi > 70, false) AS leave FROM (SELECT *, {_roll('avg', 'close', 200, 200)} AS sma FROM feat) f JOIN osc o ON o.asset = f.asset AND o.n = f.n),
held(asset, n, age) AS (SELECT asset, n, CASE WHEN enter THEN 1 ELSE 0 END FROM sig WHERE n = 0 UNION ALL
  SELECT s.asset, s.n, CASE WHEN h.age > 0 THEN CASE WHEN s.leave OR h.age >= 10 THEN 0 ELSE h.age + 1 END WHEN s.enter THEN 1 ELSE 0 END FROM held h JOIN sig s ON s.asset = h.asset AND s.n = h.n + 1)""",
)
