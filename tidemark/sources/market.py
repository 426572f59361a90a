"""Reading, normalizing, merging and writing canonical market tables."""

from __future__ import annotations

import time as clock
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.groups import latest_row
from tidemark.functions.scalars import bar_minutes, finite, time_literal
from tidemark.sources.schemas import LEGACY_NAMES, PRIMARY_KEYS, STORED_BARS, TABLES


def check_bar(dataset: str, bar_type: str) -> int:
    """Minutes of a requested bar; it must be a whole multiple of the stored bar."""
    want = bar_minutes(bar_type)
    stored = bar_minutes(STORED_BARS.get(dataset, "1m"))
    if want % stored:
        raise ValueError(f"{bar_type} is not a multiple of the stored {stored}m bars of {dataset}")
    return want


def _to_type(name: str, have: T.DataType, want: T.DataType, strict: bool) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(want, T.TimestampNTZType):
        if isinstance(have, (T.LongType, T.IntegerType)):
            return F.timestamp_millis(c.cast("long")).cast("timestamp_ntz")
        if isinstance(have, T.StringType) and not strict:
            millis = F.timestamp_millis(c.try_cast("long")).cast("timestamp_ntz")
            return F.coalesce(millis, c.try_cast("timestamp_ntz"))
    return c.cast(want) if strict else c.try_cast(want)


def canonicalize(df: DataFrame, dataset: str | T.StructType, strict: bool = True) -> DataFrame:
    """Rename legacy columns, cast, convert epoch milliseconds, and order the columns.

    Strict mode needs every column and fails on a bad value; lenient mode adds missing columns as
    null and turns bad values into null.
    """
    schema = TABLES[dataset] if isinstance(dataset, str) else dataset
    names = {o: n for o, n in LEGACY_NAMES.items() if o in df.columns and n not in df.columns}
    df = df.withColumnsRenamed(names)
    missing = sorted(set(schema.names) - set(df.columns))
    if strict and missing:
        raise ValueError(f"missing columns: {missing}")
    out = []
    for field in schema.fields:
        if field.name in missing:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        have = df.schema[field.name].dataType
        out.append(_to_type(field.name, have, field.dataType, strict).alias(field.name))
    return df.select(*out)


def legacy_view(df: DataFrame) -> DataFrame:
    """The same rows under the legacy column names."""
    return df.withColumnsRenamed(
        {n: o for o, n in LEGACY_NAMES.items() if n in df.columns and o not in df.columns}
    )


def between(df: DataFrame, start: datetime | None, end: datetime | None, on: str = "timestamp"):
    """Half-open time range."""
    if start is not None:
        df = df.where(F.col(on) >= time_literal(start))
    if end is not None:
        df = df.where(F.col(on) < time_literal(end))
    return df


def dedup_keep_last(df: DataFrame, pk: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per primary key, the last one by ``order``."""
    return latest_row(df, pk, order)


WRITTEN = "_written"


def write_market(
    df: DataFrame,
    path: str,
    dataset: str,
    mode: str = "append",
    *,
    sequence: int | None = None,
    order: Sequence[str] = (),
) -> None:
    """Write ``venue/year/month`` partitions clustered by instrument.

    Every row carries the number of its write, so that a read keeps the last one written of a key.
    ``sequence`` defaults to the clock in microseconds; it has to rise from write to write. Rows of one
    write that share a key are settled here, by ``order`` (their arrival), then by their values.

    Instruments stay out of the directory tree (thousands of tiny files otherwise); range
    partitioning on (month, instrument, time) gives Parquet min/max statistics that prune instead,
    and splits a month dominated by one instrument over several files.
    """
    time = "timestamp"
    df = latest_row(df, PRIMARY_KEYS[dataset], order)
    number = clock.time_ns() // 1_000 if sequence is None else sequence
    df = df.withColumns(
        {WRITTEN: F.lit(number).cast("long"), "year": F.year(time), "month": F.month(time)}
    )
    cluster = [c for c in ("year", "month", "instrument_id", time) if c in df.columns]
    (
        df.repartitionByRange(*cluster)
        .sortWithinPartitions(*cluster)
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy("venue", "year", "month")
        .parquet(f"{path.rstrip('/')}/{dataset}")
    )


def read_market(
    spark: SparkSession,
    path: str,
    dataset: str,
    *,
    venue: str | None = None,
    instruments: Sequence[str] | None = None,
    bar_type: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Read only the months touching the range, filter, and keep the last row written per key."""
    df = spark.read.parquet(f"{path.rstrip('/')}/{dataset}")
    months = F.col("year") * 12 + F.col("month")
    if start is not None:
        df = df.where(months >= start.year * 12 + start.month)
    if end is not None:
        df = df.where(months <= end.year * 12 + end.month)
    df = between(df, start, end)
    if venue is not None:
        df = df.where(F.col("venue") == venue.upper())
    if instruments is not None:
        df = df.where(F.col("instrument_id").isin(list(instruments)))
    if bar_type is not None and "bar_type" in df.columns:
        df = df.where(F.col("bar_type") == bar_type)
    df = df.select(*TABLES[dataset].names, WRITTEN)
    return latest_row(df, PRIMARY_KEYS[dataset], [WRITTEN]).drop(WRITTEN)


def upsert(
    existing: DataFrame, incoming: DataFrame, pk: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Rows of both sides, incoming replacing existing on equal keys unless ``order`` says otherwise."""
    both = existing.withColumn("_source", F.lit(0)).unionByName(
        incoming.withColumn("_source", F.lit(1)), allowMissingColumns=True
    )
    return latest_row(both, pk, [*order, "_source"]).drop("_source")


def upsert_partitions(
    spark: SparkSession,
    incoming: DataFrame,
    path: str,
    pk: Sequence[str],
    partition_by: Sequence[str],
    order: Sequence[str] = (),
) -> None:
    """Merge into a partitioned table, rewriting only the partitions that receive rows.

    With ``order``, columns of the table that say which row of a key is the last, the greatest wins,
    stored or incoming; on equal order, and without one, incoming rows replace stored ones. Incoming
    rows that are equal in ``order`` too are settled by their values.
    """
    from tidemark.session import materialize

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    incoming = latest_row(incoming, pk, order)
    if fs.exists(hadoop):
        touched = incoming.select(*partition_by).distinct()
        existing = spark.read.parquet(path).join(touched, list(partition_by), "left_semi")
        # The target is read and overwritten, so the merged rows go to a folder of their own first.
        merged = materialize(upsert(existing.select(*incoming.columns), incoming, pk, order))
    else:
        merged = incoming
    (
        merged.repartitionByRange(*partition_by, *pk)
        .sortWithinPartitions(*partition_by, *pk)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def compact(df: DataFrame, pk: Sequence[str], time: str, order: Sequence[str]) -> DataFrame:
    """Deduplicated rows with year and date columns, clustered for one sorted run per UTC day."""
    kept = latest_row(df, pk, order)
    kept = kept.withColumns({"year": F.year(time), "date": F.to_date(time)})
    return kept.repartitionByRange("date", *pk).sortWithinPartitions("date", *pk)


def write_compacted(df: DataFrame, path: str, by: Sequence[str] = ("year", "date")) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def split_by_utc_date(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.withColumn("date", F.to_date(time))


def clean_candles(
    df: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    *,
    order: Sequence[str],
) -> DataFrame:
    """Drop impossible candles and keep the last row per bar by ``order``, the columns of arrival."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    good = finite("open") & finite("high") & finite("low") & finite("close")
    good &= (o > 0) & (h > 0) & (lo > 0) & (c > 0)
    good &= (h >= F.greatest(o, c, lo)) & (lo <= F.least(o, c, h))
    pk = [k for k in PRIMARY_KEYS["candles"] if k in df.columns]
    return latest_row(between(df, start, end).where(good), pk, order)


def build_funding_history(df: DataFrame, *, order: Sequence[str]) -> DataFrame:
    """Confirmed funding rows: a time and a realized rate are needed; the last per key by ``order`` wins."""
    rows = df.where(F.col("timestamp").isNotNull() & F.col("realized_rate").isNotNull())
    return latest_row(rows, PRIMARY_KEYS["funding_rates"], order)


def fill_ratio_type(df: DataFrame) -> DataFrame:
    """Older rows carry no ratio type; they mean all accounts."""
    return df.withColumn("ratio_type", F.coalesce("ratio_type", F.lit("all_account")))


# Known ratio types.
RATIO_TYPES = ["all_account", "top_trader_account", "top_trader_position"]


def unknown_ratio_types(df: DataFrame) -> DataFrame:
    """Ratio types outside the known domain with their row counts."""
    return (
        fill_ratio_type(df)
        .where(~F.col("ratio_type").isin(RATIO_TYPES))
        .groupBy("ratio_type")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def merge_missing_history(
    current: DataFrame, legacy: DataFrame, dataset: str, start: datetime, end: datetime
) -> DataFrame:
    """Add legacy rows of the range at the stored bar; current rows win on equal keys."""
    stored = STORED_BARS[dataset]
    older = between(canonicalize(legacy, dataset), start, end)
    older = older.where(F.col("bar_type") == stored)
    return upsert(older, current.select(*older.columns), PRIMARY_KEYS[dataset])


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Report tables are small aggregates; they are written with a header, or as Parquet."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
