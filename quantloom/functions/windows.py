"""Row windows over sessions, with the null rules of rolling statistics.

Missing values are NULL throughout. A rolling statistic is NULL until its window holds enough values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def along(*keys: str) -> WindowSpec:
    """Sessions of each asset in order (of each configuration, if that is a key)."""
    return Window.partitionBy(*keys, "asset").orderBy("n")


def across(*keys: str) -> WindowSpec:
    """All assets of a session."""
    return Window.partitionBy(*keys, "n")


def series() -> WindowSpec:
    """One series in order, as the benchmark: a few thousand sessions, whatever the universe."""
    return Window.partitionBy(F.lit(0)).orderBy("n")


def rolling(fn: Callable, x: Column | str, k: int, w: WindowSpec, least: int | None = None) -> Column:
    """fn over the last k rows, if `least` (k) of them have a value."""
    frame = w.rowsBetween(-(k - 1), 0)
    return F.when(F.count(x).over(frame) >= (k if least is None else least), fn(x).over(frame))


def before(fn: Callable, x: Column | str, k: int, w: WindowSpec) -> Column:
    """fn over the k rows before this one, if all have a value."""
    frame = w.rowsBetween(-k, -1)
    return F.when(F.count(x).over(frame) >= k, fn(x).over(frame))


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL for a zero divisor."""
    return a / F.nullif(b, F.lit(0.0))


def change(x: str, k: int, w: WindowSpec) -> Column:
    """Relative change over k rows."""
    return ratio(F.col(x), F.lag(x, k).over(w)) - 1


def filled(x: Column | str, w: WindowSpec) -> Column:
    """The last value so far."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(*SO_FAR))


def state(entry: Column, leave: Column, w: WindowSpec) -> Column:
    """1 from an entry until the next exit, which wins where both hold; else 0."""
    mark = F.when(F.coalesce(leave, F.lit(False)), 0.0).when(F.coalesce(entry, F.lit(False)), 1.0)
    return F.coalesce(filled(mark, w), F.lit(0.0))


def annual_vol(x: str, k: int, w: WindowSpec, periods: int = 252) -> Column:
    return rolling(F.stddev_samp, x, k, w, max(5, k // 2)) * math.sqrt(periods)


def cap_gross(w: str, most: Column, cross: WindowSpec) -> Column:
    gross = F.sum(F.abs(w)).over(cross)
    return F.when(gross > most, F.col(w) * most / gross).otherwise(F.col(w))


def hold(w: str, every: Column, spec: WindowSpec, offset: int = 0) -> Column:
    """Every so many sessions a decision, held in between."""
    decision = F.when(F.col("n") % every == offset, F.coalesce(F.col(w), F.lit(0.0)))
    return F.when(every <= 1, F.col(w)).otherwise(F.coalesce(filled(decision, spec), F.lit(0.0)))


def selected(score: str, fraction: Column, top: Column, cross_keys: Iterable[str], least: int = 1) -> Column:
    """Whether the score is among the best fraction of its session; ties go to the asset that comes first in the universe."""
    w = Window.partitionBy(*cross_keys, "n")
    signed = F.when(top, -F.col(score)).otherwise(F.col(score))
    place = F.row_number().over(w.orderBy(signed.asc_nulls_last(), "ord"))
    valid = F.count(score).over(w)
    return F.col(score).isNotNull() & (place <= F.greatest(F.lit(least), F.ceil(valid * fraction)))


def percentile_rank(x: str, k: int, least: int, w: WindowSpec) -> Column:
    """Average-tie percentile rank of the current value among the last k."""
    frame = w.rowsBetween(-(k - 1), 0)
    values = F.collect_list(x).over(frame)
    below = F.size(F.filter(values, lambda v: v < F.col(x)))
    equal = F.size(F.filter(values, lambda v: v == F.col(x)))
    return F.when(F.col(x).isNotNull() & (F.size(values) >= least), (below + (equal + 1) / 2) / F.size(values))


def rsi(bars: DataFrame, lengths: Iterable[int]) -> DataFrame:
    """Adds rsi_<length> of closes. The recursive average has no built-in form, so each asset's series is a pandas group."""
    lengths = sorted(set(lengths))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        delta = pdf["close"].diff()
        out = pdf[["asset", "n"]].copy()
        for k in lengths:
            up, down = ((delta * s).where(lambda d: d.isna() | (d > 0), 0.0).ewm(alpha=1 / k, adjust=False, min_periods=k).mean() for s in (1, -1))
            value = 100 * up / (up + down).where(down > 0)
            out[f"rsi_{k}"] = value.where(down > 0, 100.0).where(up.notna())
        return out

    kinds = "asset string, n long, " + ", ".join(f"rsi_{k} double" for k in lengths)
    found = bars.select("asset", "n", "close").groupBy("asset").applyInPandas(one, kinds)
    columns = [F.when(~F.isnan(f"rsi_{k}"), F.col(f"rsi_{k}")).alias(f"rsi_{k}") for k in lengths]
    return bars.join(found.select("asset", "n", *columns), ["asset", "n"])


def weekdays(day: Column) -> Column:
    """Number of weekdays before a date, counted from a Monday."""
    days = F.datediff(day, F.lit("1970-01-05").cast("date"))
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))


def turn_of_month(day: Column, ahead: Column, after: Column) -> Column:
    """Whether the next weekday is among the last `ahead` or first `after` weekdays of its month."""
    since = F.pmod(F.datediff(day, F.lit("1970-01-05").cast("date")), F.lit(7))
    following = F.date_add(day, F.when(since >= 4, 7 - since).otherwise(1).cast("int"))
    first = F.trunc(following, "month")
    ordinal = weekdays(following) - weekdays(first) + 1
    left = weekdays(F.add_months(first, 1)) - weekdays(following)
    return (left <= ahead) | (ordinal <= after)


def corr(x: str, y: str) -> Column:
    """Correlation of rows that have both, as an aggregate; NULL without variation."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c)) for c in (x, y))
    return F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))
