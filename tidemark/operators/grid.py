"""Time grids, resampling and time joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import Series, over_series
from tidemark.functions.scalars import col, epoch_slot, floor_time, minutes_interval, shift_time

KEYS = ["venue", "instrument_id"]


def _slot(df: DataFrame, minutes: int, keys: Sequence[str]):
    return df.groupBy(*keys, floor_time("timestamp", minutes).alias("timestamp"))


def bars_from_ticks(
    ticks: DataFrame,
    minutes: int,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("timestamp", "trade_id"),
) -> DataFrame:
    """Ticks (price, size, quote) to bars. Partial aggregation shrinks a hot instrument map-side."""
    key = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])
    return _slot(ticks.withColumn("_key", key), minutes, keys).agg(
        F.min_by("price", "_key").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_key").alias("close"),
        F.sum("size").alias("volume"),
        F.sum("quote").alias("volume_quote"),
    )


def resample_candles(df: DataFrame, minutes: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tumbling epoch-aligned bars of canonical candles (one row per key and time)."""
    aggs = {
        "open": F.min_by("open", "timestamp"),
        "high": F.max("high"),
        "low": F.min("low"),
        "close": F.max_by("close", "timestamp"),
    }
    for name in ("volume", "volume_ccy", "volume_quote"):
        aggs[name] = F.sum(name)
    aggs["confirm"] = F.min("confirm")
    have = [c.alias(n) for n, c in aggs.items() if n in df.columns]
    return _slot(df, minutes, keys).agg(*have)


def resample_taker(df: DataFrame, minutes: int, keys: Sequence[str] = KEYS) -> DataFrame:
    return _slot(df, minutes, keys).agg(
        *[F.sum(c).alias(c) for c in ("buy_volume", "sell_volume", "net_buy_volume")]
    )


def resample_last(
    df: DataFrame, minutes: int, columns: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Value of the last row of each bar, null included."""
    last = F.max_by(F.struct(*columns), "timestamp").alias("_r")
    return _slot(df, minutes, keys).agg(last).select(*keys, "timestamp", "_r.*")


def resample_complete(
    df: DataFrame, minutes: int, expected: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Bars built from exactly ``expected`` source bars."""
    return (
        _slot(df, minutes, keys)
        .agg(
            F.min_by("open", "timestamp").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "timestamp").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("source_bars"),
        )
        .where(F.col("source_bars") == expected)
    )


def resample_ohlcv(df: DataFrame, minutes: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Open, high, low, close and volume; bars with a null are dropped."""
    return resample_candles(df, minutes, keys).select(
        *keys, "timestamp", "open", "high", "low", "close", "volume"
    ).dropna()


@dataclass(frozen=True)
class AsofSource:
    """Right side of an as-of join: rows unique per key and time, and the columns to carry over.

    ``shift_minutes`` is added to the row times before matching, so -60 lets a left row see what
    becomes known up to an hour after its own time.
    """

    rows: DataFrame
    columns: Sequence[str]
    on: str = "timestamp"
    tolerance_minutes: int | None = None
    shift_minutes: int = 0


def asof_many(
    left: DataFrame,
    by: Sequence[str],
    sources: Sequence[AsofSource],
    *,
    left_on: str | Column = "timestamp",
    chunk_minutes: int = 60 * 24 * 90,
) -> DataFrame:
    """Latest row of every source at or before each left time, per ``by``, in one pass.

    All sides are merged in time order and the last row of each source is carried forward; pass a
    written table as ``left``, since it is read twice. Work is split by (``by``, time chunk). Each chunk starts with the last source rows of earlier chunks,
    found from one aggregate row per chunk, so a long series is never one task. Reduce sources
    denser than the left grid with ``last_per_slot`` first.
    """
    by = list(by)
    base = left.withColumn("_t", col(left_on)).withColumn("_side", F.lit(1))
    merged = base
    for i, src in enumerate(sources):
        at = shift_time(src.on, src.shift_minutes) if src.shift_minutes else F.col(src.on)
        row = F.struct(at.alias("_rt"), *[F.col(c) for c in src.columns])
        rows = src.rows.where(F.col(src.on).isNotNull())
        rows = rows.select(*by, at.alias("_t"), row.alias(f"_r{i}"), F.lit(0).alias("_side"))
        merged = merged.unionByName(rows, allowMissingColumns=True)
    merged = merged.withColumn("_chunk", epoch_slot("_t", chunk_minutes))
    names = [f"_r{i}" for i in range(len(sources))]
    ends = merged.groupBy(*by, "_chunk").agg(*[F.max(n).alias(n) for n in names])
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    seeds = ends.select(
        *by, "_chunk", *[F.last(n, ignorenulls=True).over(before).alias(n) for n in names]
    ).where(reduce(or_, [F.col(n).isNotNull() for n in names]))
    # A null time sorts first, ahead of every row of the chunk.
    seeds = seeds.withColumn("_side", F.lit(0))
    merged = merged.unionByName(seeds, allowMissingColumns=True)
    w = Window.partitionBy(*by, "_chunk").orderBy("_t", "_side")
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    hits = merged.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in names})
    hits = hits.where(F.col("_side") == 1)
    out = {}
    for n, src in zip(names, sources, strict=True):
        fresh = F.col(n).isNotNull()
        if src.tolerance_minutes is not None:
            fresh &= F.col(f"{n}._rt") >= F.col("_t") - minutes_interval(src.tolerance_minutes)
        out |= {c: F.when(fresh, F.col(f"{n}.{c}")) for c in src.columns}
    keep = [c for c in left.columns if c not in out]
    return hits.select(*keep, *[c.alias(n) for n, c in out.items()])


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    *,
    left_on: str | Column = "timestamp",
    right_on: str = "timestamp",
    tolerance_minutes: int | None = None,
    chunk_minutes: int = 60 * 24 * 90,
) -> DataFrame:
    """Latest right row at or before each left time, per ``by``."""
    source = AsofSource(right, columns, right_on, tolerance_minutes)
    return asof_many(left, by, [source], left_on=left_on, chunk_minutes=chunk_minutes)


def last_per_slot(
    df: DataFrame, minutes: int, by: Sequence[str], columns: Sequence[str], on: str = "timestamp"
) -> DataFrame:
    """Last row at or before each grid point, stamped with that grid point.

    A row at 10:03 belongs to the 10:05 point of a 5-minute grid. This bounds the right side of an
    as-of join on a grid to one row per slot, however dense the source is.
    """
    floor = floor_time(on, minutes)
    point = F.when(floor == F.col(on), floor).otherwise(shift_time(floor, minutes))
    last = F.max(F.struct(F.col(on).alias("_at"), *[F.col(c) for c in columns])).alias("_r")
    got = df.groupBy(*by, point.alias("_point")).agg(last)
    return got.select(*by, F.col("_point").alias("timestamp"), *[F.col(f"_r.{c}") for c in columns])


def factor_label_join(factors: DataFrame, labels: DataFrame) -> DataFrame:
    return factors.join(labels, ["venue", "instrument_id", "bar_type", "timestamp"])


def left_attach(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left")


def semi_filter(df: DataFrame, allowed: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(allowed.select(*on).distinct(), list(on), "left_semi")


def missing_from(requested: DataFrame, available: DataFrame, on: Sequence[str]) -> DataFrame:
    return requested.join(available.select(*on).distinct(), list(on), "left_anti")


def boundaries_inside(df: DataFrame, entry: str = "timestamp", exit: str = "exit_time"):
    """One row per UTC midnight inside (entry, exit]; no theta join is needed."""
    first = F.date_trunc("day", F.col(entry)).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    last = F.date_trunc("day", F.col(exit)).cast("timestamp_ntz")
    days = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 DAY")))
    return df.withColumn("boundary", F.explode(days))


def common_timeline(df: DataFrame, by: str, on: Sequence[str]) -> DataFrame:
    """Rows at the times every sleeve has."""
    sleeves = df.select(by).distinct().agg(F.count(F.lit(1)).alias("_all"))
    shared = df.groupBy(*on).agg(F.count_distinct(by).alias("_n")).crossJoin(F.broadcast(sleeves))
    return df.join(shared.where(F.col("_n") == F.col("_all")).select(*on), list(on), "left_semi")


def shifted_join(
    df: DataFrame, returns: DataFrame, periods: int, minutes: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Attach the single-bar return that starts p-1 bars later, for p = 1..periods."""
    p = F.explode(F.sequence(F.lit(1), F.lit(periods)))
    ahead = df.withColumn("forward_period", p).withColumn(
        "_at", shift_time("timestamp", (F.col("forward_period") - 1) * minutes)
    )
    target = returns.withColumnRenamed("timestamp", "_at")
    return ahead.join(target, [*keys, "_at"]).drop("_at")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dense_grid(
    df: DataFrame,
    keys: Sequence[str],
    minutes: int,
    columns: Sequence[str],
    on: str = "timestamp",
    *,
    max_rows: int | None = None,
) -> DataFrame:
    """Every grid point from first to last row per key, values carried forward.

    Gaps are filled by repeating each row up to its successor, so no grid table or join is built.
    """
    filled = over_series(
        df, keys, [on], lambda s: {c: s.fill(c) for c in columns} | {"_next": s.lead(on)}, [*keys, on], max_rows=max_rows
    )
    nxt = F.col("_next")
    step = minutes_interval(minutes)
    until = F.when(nxt.isNull(), F.col(on)).otherwise(F.greatest(nxt - step, F.col(on)))
    rows = filled.withColumn("_until", until)
    return rows.withColumn(on, F.explode(F.sequence(F.col(on), F.col("_until"), step))).drop("_until", "_next")
