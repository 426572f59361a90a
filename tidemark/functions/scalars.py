"""Small Column helpers: null-safe arithmetic, time grids, flags."""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"m": 1, "h": 60, "d": 1440}
MINUTES_PER_YEAR = 365 * 24 * 60


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bar_minutes(bar_type: str) -> int:
    """Minutes in a bar type such as ``15m``, ``4h`` or ``1d``."""
    text = bar_type.strip()
    unit = text[-1:].lower()
    if unit not in _UNITS or not text[:-1].isdigit() or int(text[:-1]) <= 0:
        raise ValueError(f"bar type must look like 5m, 4h or 1d: {bar_type!r}")
    return int(text[:-1]) * _UNITS[unit]


def duration_bars(duration: str | int, bar_type: str) -> int:
    """A duration such as ``24h`` in whole bars; integers are bars already."""
    if isinstance(duration, int):
        if duration <= 0:
            raise ValueError("duration must be positive")
        return duration
    minutes, bar = bar_minutes(duration), bar_minutes(bar_type)
    if minutes % bar:
        raise ValueError(f"{duration} is not a whole number of {bar_type} bars")
    return minutes // bar


def annual_scale(bar_type: str) -> float:
    return math.sqrt(MINUTES_PER_YEAR / bar_minutes(bar_type))


def time_literal(when: datetime | str) -> Column:
    """A UTC wall-clock literal; aware datetimes are converted to UTC first."""
    if isinstance(when, datetime):
        if when.tzinfo is not None:
            when = when.astimezone(timezone.utc).replace(tzinfo=None)
        when = when.isoformat(sep=" ")
    return F.lit(when).cast("timestamp_ntz")


def minutes_interval(n: Column | int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n) if isinstance(n, int) else n)


def shift_time(ts: str | Column, minutes: Column | int) -> Column:
    return col(ts) + minutes_interval(minutes)


def epoch_micros(ts: str | Column) -> Column:
    """Microseconds since the epoch; sessions run in UTC, so wall-clock times convert as they are."""
    return F.unix_micros(col(ts).cast("timestamp"))


def epoch_slot(ts: str | Column, minutes: int) -> Column:
    """Number of the epoch-aligned slot of ``minutes`` that holds ``ts``."""
    return F.floor(epoch_micros(ts) / F.lit(minutes * 60_000_000)).cast("long")


def floor_time(ts: str | Column, minutes: int) -> Column:
    """``ts`` floored to an epoch-aligned grid of ``minutes``."""
    at, step = epoch_micros(ts), F.lit(minutes * 60_000_000)
    return F.timestamp_micros(at - F.pmod(at, step)).cast("timestamp_ntz")


def month_start(ts: str | Column) -> Column:
    return F.date_trunc("month", col(ts)).cast("timestamp_ntz")


def day_start(ts: str | Column) -> Column:
    return F.date_trunc("day", col(ts)).cast("timestamp_ntz")


def finite(x: str | Column) -> Column:
    """True for a usable number; false for null, NaN and infinities."""
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def finite_or_null(x: str | Column) -> Column:
    return F.when(finite(x), col(x))


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b``; null where ``b`` is zero."""
    return F.try_divide(col(a), col(b))


def ieee_ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b`` as floating point has it: infinite where only ``b`` is zero, NaN where both are."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def log_pos(x: str | Column) -> Column:
    x = col(x)
    return F.when(x > 0, F.log(x))


def clip(x: str | Column, lo: Column, hi: Column) -> Column:
    """Clip with null bounds ignored and null ``x`` kept null."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo))


def add_flag(flags: str | Column, flag: str) -> Column:
    flags = col(flags)
    return F.when(flags == "", F.lit(flag)).otherwise(F.concat_ws("|", flags, F.lit(flag)))


def corr_safe(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation aggregate over the rows where both are present.

    Null where either side is constant; the built-in ``corr`` raises there under ANSI mode.
    """
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(xx) * F.stddev_samp(yy)
    return F.when(spread > 0, F.try_divide(F.covar_samp(xx, yy), spread))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and widen integers so results compare across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
