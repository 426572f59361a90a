"""Coverage, continuity and data-quality reports; violations come back as rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import epoch_slot, minutes_interval, shift_time, time_literal

KEYS = ["venue", "instrument_id"]
BLOCK_SLOTS = 65_536


def coverage_intervals(df: DataFrame, minutes: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Maximal runs of consecutive bars as half-open intervals.

    Runs are found within blocks of ``BLOCK_SLOTS`` bar slots, which bounds the rows of a task, and
    runs that touch across block edges are joined afterwards.
    """
    keys = list(keys)
    block = epoch_slot("timestamp", minutes * BLOCK_SLOTS).alias("_block")
    slots = df.select(*keys, "timestamp", block).distinct()
    slots = slots.select(
        *keys, "_block", F.col("timestamp").alias("start_time"),
        (F.col("timestamp") + minutes_interval(minutes)).alias("end_time"), F.lit(1).alias("bars"),
    )
    return _join_touching(_join_touching(slots, [*keys, "_block"]).drop("_block"), keys)


def _join_touching(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge intervals that start where the previous one of their key ends."""
    w = Window.partitionBy(*keys).orderBy("start_time")
    touches = F.lag("end_time").over(w) == F.col("start_time")
    marked = intervals.withColumn("_new", F.when(touches, 0).otherwise(1))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(
            F.min("start_time").alias("start_time"),
            F.max("end_time").alias("end_time"),
            F.sum("bars").alias("bars"),
        )
        .drop("_island")
    )


def missing_intervals(
    intervals: DataFrame, start: datetime, end: datetime, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Holes of [start, end) left by possibly overlapping covered intervals."""
    keys = list(keys)
    lo, hi = time_literal(start), time_literal(end)
    inside = intervals.where((F.col("end_time") > lo) & (F.col("start_time") < hi)).select(
        *keys,
        F.greatest("start_time", lo).alias("start_time"),
        F.least("end_time", hi).alias("end_time"),
    )
    tail = intervals.select(*keys).distinct().select(
        *keys, hi.alias("start_time"), hi.alias("end_time")
    )
    w = Window.partitionBy(*keys).orderBy("start_time", "end_time")
    reached = F.max("end_time").over(w.rowsBetween(Window.unboundedPreceding, -1))
    swept = inside.unionByName(tail).withColumn("_reached", F.coalesce(reached, lo))
    return swept.where(F.col("start_time") > F.col("_reached")).select(
        *keys, F.col("_reached").alias("start_time"), F.col("start_time").alias("end_time")
    )


def validate_periodic(
    df: DataFrame, start: datetime, end: datetime, minutes: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Keys whose bars are not exactly the expected grid of [start, end), with the reasons."""
    lo, hi = time_literal(start), time_literal(end)
    expected = F.timestamp_diff("MINUTE", lo, hi) / minutes
    confirmed = F.min("confirm") if "confirm" in df.columns else F.lit(1)
    aligned = F.sum(F.when(F.timestamp_diff("MINUTE", lo, F.col("timestamp")) % minutes != 0, 1).otherwise(0))
    stats = (
        df.where((F.col("timestamp") >= lo) & (F.col("timestamp") < hi))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("timestamp").alias("slots"),
            F.min("timestamp").alias("first_time"),
            F.max("timestamp").alias("last_time"),
            aligned.alias("off_grid"),
            confirmed.alias("_confirm"),
        )
    )
    reasons = {
        "wrong_count": F.col("rows") != expected,
        "wrong_start": F.col("first_time") != lo,
        "wrong_end": F.col("last_time") != shift_time(hi, -minutes),
        "broken_step": (F.col("slots") != expected) | (F.col("off_grid") > 0),
        "unconfirmed": F.col("_confirm") != 1,
    }
    flags = F.concat_ws("|", *[F.when(c, F.lit(n)) for n, c in reasons.items()])
    return stats.withColumn("violations", flags).where(F.col("violations") != "").drop("_confirm")


def file_stats(df: DataFrame, partition_by: Sequence[str], on: str = "timestamp") -> DataFrame:
    """Time bounds and row count per partition."""
    return df.groupBy(*partition_by).agg(
        F.min(on).alias("min_time"), F.max(on).alias("max_time"), F.count(F.lit(1)).alias("rows")
    )


def overlap_conflicts(
    a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Equal keys whose values differ, nulls comparing equal."""
    left = a.select(*keys, *[F.col(v).alias(f"{v}_left") for v in values])
    right = b.select(*keys, *[F.col(v).alias(f"{v}_right") for v in values])
    same = F.lit(True)
    for v in values:
        same &= F.col(f"{v}_left").eqNullSafe(F.col(f"{v}_right"))
    return left.join(right, list(keys)).where(~same)


def boundary_continuity(
    previous: DataFrame, current: DataFrame, minutes: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Does each key's current part start one step after the previous part ends?"""
    p = previous.groupBy(*keys).agg(F.max("timestamp").alias("previous_end"))
    c = current.groupBy(*keys).agg(F.min("timestamp").alias("current_start"))
    gap = F.timestamp_diff("MINUTE", F.col("previous_end"), F.col("current_start"))
    return p.join(c, list(keys)).withColumns(
        {"gap_minutes": gap, "is_continuous": gap == minutes}
    )


def window_violations(df: DataFrame, lifecycle: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys with data before listing or at/after expiry."""
    seen = df.groupBy(*keys).agg(
        F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time")
    )
    life = lifecycle.select(*keys, "valid_from", "valid_to")
    early = F.col("first_time") < F.col("valid_from")
    late = F.col("last_time") >= F.col("valid_to")
    reason = F.concat_ws("|", F.when(early, "BEFORE_LISTING"), F.when(late, "AFTER_EXPIRY"))
    return seen.join(life, list(keys), "left").withColumn("violation", reason).where(
        F.col("violation") != ""
    )


def duplicate_report(
    df: DataFrame, pk: Sequence[str], values: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Repeated and conflicting keys per group.

    Rows first collapse to (key, content) counts, so a bar repeated a million times costs one row
    per map task.
    """
    content = F.xxhash64(*[F.col(v) for v in values])
    kinds = df.groupBy(*pk, content.alias("_content")).agg(F.count(F.lit(1)).alias("_rows"))
    per_key = kinds.groupBy(*pk).agg(
        F.sum("_rows").alias("_rows"), F.count(F.lit(1)).alias("_versions")
    )
    return per_key.groupBy(*by).agg(
        F.sum("_rows").alias("input_rows"),
        F.count(F.lit(1)).alias("unique_keys"),
        F.sum(F.col("_rows") - F.col("_versions")).alias("duplicate_rows"),
        F.sum(F.when(F.col("_versions") > 1, 1).otherwise(0)).alias("conflicting_keys"),
        (F.sum(F.col("_rows") - F.col("_versions")) / F.sum("_rows")).alias("duplicate_ratio"),
    )


def source_date_violations(df: DataFrame, date: str = "source_date", hours: int = 8) -> DataFrame:
    """Rows whose time lies outside their source day, which starts ``hours`` before UTC midnight."""
    start = F.col(date).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    end = start + F.expr("INTERVAL 1 DAY")
    return df.where((F.col("timestamp") < start) | (F.col("timestamp") >= end))


MAX_LEAD_DAYS = 730


def futures_expiry(instrument: Column) -> Column:
    """Expiry date encoded at the end of a dated future's name, or null."""
    name = F.split_part(instrument, F.lit("#OLD#"), F.lit(1))
    code = F.regexp_extract(name, r"-(\d{8}|\d{6})$", 1)
    full = F.when(F.length(code) == 6, F.concat(F.lit("20"), code)).when(F.length(code) == 8, code)
    return F.try_to_timestamp(full, F.lit("yyyyMMdd")).cast("date")


def futures_expiry_violations(df: DataFrame, date: str = "source_date") -> DataFrame:
    """Dated futures whose expiry is past or more than two years ahead of the source day."""
    expiry = futures_expiry(F.col("instrument_id"))
    days = F.datediff(F.col("_expiry"), F.col(date))
    return (
        df.where(~F.col("instrument_id").contains("_XPERP-"))
        .withColumn("_expiry", expiry)
        .where(F.col("_expiry").isNotNull())
        .withColumn("days_to_expiry", days)
        .where((days < 0) | (days > MAX_LEAD_DAYS))
        .withColumnRenamed("_expiry", "expiration_date")
    )


def coverage_summary(stats: DataFrame, by: Sequence[str], complete: Column) -> DataFrame:
    """Date range, partitions and rows over the complete partitions of each dataset and scope."""
    return stats.where(complete).groupBy(*by).agg(
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.count(F.lit(1)).alias("partitions"),
        F.sum("rows").alias("rows"),
    )


def availability(
    df: DataFrame, by: Sequence[str], minutes: int, on: str = "timestamp"
) -> DataFrame:
    """First event time and first UTC day with a bar in every slot."""
    day = df.groupBy(*by, F.to_date(on).alias("_date")).agg(
        F.min(on).alias("_first"), F.count_distinct(epoch_slot(on, minutes)).alias("_slots")
    )
    full = F.min(F.when(F.col("_slots") == 1440 // minutes, F.col("_date")))
    return day.groupBy(*by).agg(
        F.min("_first").alias("first_event_time"), full.alias("first_complete_date")
    )
