"""Column helpers shared by every operator.

Spark 4 runs in ANSI mode, so ``x / 0`` and ``corr`` over a constant raise.
The helpers here return NULL instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-10
TRADING_DAYS = 252


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def series(key: str | list[str] = "ticker", order: str | list[str] = "date") -> Window:
    """The window of one time series.

    Bars are unique on (key, order), so a partition is bounded by the calendar
    (at most one row per day or minute), however many ticks a ticker has.
    """
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*orders)


def rows(w: Window, n: int) -> Window:
    """The last ``n`` rows up to and including this one."""
    return w.rowsBetween(-(n - 1), 0)


def whole(key: str | list[str] = "ticker") -> Window:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys)


def div(a, b) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def seeded(seed: int, *cols: str) -> Column:
    """A number in [0, 2^60) drawn from the row's columns and a seed: the first 15 hex digits of a digest that any engine has."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def clip(c, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (``least``/``greatest`` would drop it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def finite(c) -> Column:
    """NaN and infinities become NULL."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def zero_fill(c) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def pct_change(c, n: int, w: Window) -> Column:
    prev = F.lag(col(c), n).over(w)
    return div(col(c), prev) - 1.0


def lag_or_first(c, n: int, w: Window) -> Column:
    """Previous value; the head of the series repeats its first value."""
    return F.coalesce(F.lag(col(c), n).over(w), F.first(col(c)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rolling(fn, c, w: Window, n: int, min_periods: int = 1) -> Column:
    """``fn`` over the last n rows, NULL while fewer than ``min_periods`` values."""
    frame = rows(w, n)
    value = fn(col(c)).over(frame)
    if min_periods <= 1:
        return value
    return F.when(F.count(col(c)).over(frame) >= min_periods, value)


def sma(c, w: Window, n: int) -> Column:
    """Mean of the last n rows, the expanding mean while under n//2 rows."""
    running = F.avg(col(c)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(rolling(F.avg, c, w, n, max(1, n // 2)), running)


def safe_corr(x, y) -> Column:
    """Pearson correlation, NULL for a constant side.  Both inputs must be NULL together."""
    x, y = col(x), col(y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def add_all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def half_away(c, digits: int) -> Column:
    """Round as SQL engines round doubles: the product with 10^digits goes to the nearest whole number, halves away from zero.

    ``F.round`` reads the shortest decimal text of the number instead: 4.1390625 stands for a
    product of 4139062.4999999995, which is no half.  The remainder of 1 is exact, and spares
    the decimal text that ``F.round`` makes of every number.
    """
    c, unit = col(c).cast("double"), float(10**digits)
    scaled = c * unit
    size = F.abs(scaled)
    part = size % F.lit(1.0)
    whole = (size - part + F.when(part >= 0.5, 1.0).otherwise(0.0)) * F.signum(scaled) + F.lit(0.0)
    return F.when(size < float("inf"), whole / unit).otherwise(c)


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column, for comparisons across engines.

    Adding 0.0 turns -0.0 into 0.0.
    """
    out = []
    for f in df.schema.fields:
        if f.dataType.simpleString() == "double" and f.name not in skip:
            out.append((half_away(f.name, digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
