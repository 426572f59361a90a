"""Point-in-time universes: snapshots, lifecycles, selection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.groups import tie_range
from tidemark.functions.rolling import Series, over_series
from tidemark.functions.scalars import minutes_interval, time_literal
from tidemark.session import materialize
from tidemark.sources.schemas import TABLES

KEYS = ["venue", "instrument_id"]


def snapshot_at(df: DataFrame, as_of: datetime, by: Sequence[str] = ("venue",)) -> DataFrame:
    """All rows of the latest snapshot at or before ``as_of``."""
    past = df.where(F.col("timestamp") <= time_literal(as_of))
    latest = past.groupBy(*by).agg(F.max("timestamp").alias("timestamp"))
    # One row per venue.
    return past.join(F.broadcast(latest), [*by, "timestamp"], "left_semi")


def candle_lifetimes(candles: DataFrame, minutes: int = 1) -> DataFrame:
    return candles.groupBy(*KEYS).agg(
        F.min("timestamp").alias("start_time"),
        (F.max("timestamp") + minutes_interval(minutes)).alias("end_time"),
    )


def rebuild_lifecycle(
    snapshots: DataFrame, candles: DataFrame | None = None, minutes: int = 1
) -> DataFrame:
    """Interval in which each instrument could be traded, and where the bounds come from."""
    times = snapshots.groupBy("venue", "timestamp").agg(F.count(F.lit(1)).alias("_n"))
    # One row per venue and snapshot time.
    following = times.select(
        "venue",
        F.col("timestamp").alias("last_seen"),
        F.lead("timestamp").over(Window.partitionBy("venue").orderBy("timestamp")).alias("_missed"),
    )
    static = ["instrument_type", "base_currency", "quote_currency", "settle_currency", "contract_type"]
    life = (
        snapshots.groupBy(*KEYS)
        .agg(
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            F.min("list_time").alias("_listed"),
            F.min("expiration_time").alias("_expires"),
            F.max_by(F.struct(*static), "timestamp").alias("_s"),
        )
        .join(following, ["venue", "last_seen"], "left")
    )
    to_source = (
        F.when(F.col("_expires").isNotNull(), "exchange_expiration_time")
        .when(F.col("_missed").isNotNull(), "first_missing_snapshot")
        .otherwise("")
    )
    listed = F.col("_listed").isNotNull()
    life = life.select(
        *KEYS,
        "_s.*",
        F.coalesce("_listed", "first_seen").alias("valid_from"),
        F.coalesce("_expires", "_missed").alias("valid_to"),
        "first_seen",
        "last_seen",
        F.when(listed, "exchange_list_time").otherwise("first_seen").alias("valid_from_source"),
        to_source.alias("valid_to_source"),
        F.when(listed & (to_source != "first_missing_snapshot"), "exact")
        .otherwise("inferred")
        .alias("confidence"),
    )
    if candles is not None:
        life = _merge_candle_bounds(life, candle_lifetimes(candles, minutes), minutes)
    return life.select(*TABLES["lifecycles"].names)


def _merge_candle_bounds(life: DataFrame, bounds: DataFrame, minutes: int) -> DataFrame:
    df = life.withColumn("_known", F.lit(True)).join(bounds, KEYS, "full_outer")
    known, start, end = F.coalesce("_known", F.lit(False)), F.col("start_time"), F.col("end_time")
    last_bar = end - minutes_interval(minutes)
    part = F.split("instrument_id", "-")
    quote = F.coalesce(F.try_element_at(part, F.lit(2)), F.lit(""))
    guessed = {
        "instrument_type": F.when(F.col("instrument_id").endswith("-SWAP"), "SWAP").otherwise(""),
        "base_currency": F.element_at(part, 1),
        "quote_currency": quote,
        "settle_currency": quote,
        "contract_type": F.when(quote.isin("USDT", "USDC"), "linear").otherwise(""),
        "valid_from": start,
        "valid_to": end,
        "first_seen": start,
        "last_seen": last_bar,
        "valid_from_source": F.lit("first_candle"),
        "valid_to_source": F.lit("last_candle"),
        "confidence": F.lit("inferred"),
    }
    earlier = (F.col("valid_from_source") != "exchange_list_time") & (start < F.col("valid_from"))
    missed = F.col("valid_to_source") == "first_missing_snapshot"
    merged = {
        "valid_from": F.when(earlier, start).otherwise(F.col("valid_from")),
        "valid_from_source": F.when(earlier, "first_candle").otherwise(F.col("valid_from_source")),
        "first_seen": F.least("first_seen", start),
        "valid_to": F.when(missed, F.greatest("valid_to", end)).otherwise(F.col("valid_to")),
        "last_seen": F.greatest("last_seen", last_bar),
    }
    return df.select(
        *KEYS,
        *[
            F.when(known, merged.get(n, F.col(n))).otherwise(g).alias(n)
            for n, g in guessed.items()
        ],
    )


def alive_at(lifecycle: DataFrame, when: datetime | Column) -> DataFrame:
    t = when if isinstance(when, Column) else time_literal(when)
    return lifecycle.where(
        (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))
    )


def add_local_volume(candidates: DataFrame, candles: DataFrame, as_of: datetime) -> DataFrame:
    """Trailing-day candle volume, used only where no candidate of the venue reports a volume."""
    t = time_literal(as_of)
    day = candles.where(
        (F.col("timestamp") >= t - F.expr("INTERVAL 1 DAY")) & (F.col("timestamp") < t)
    )
    local = day.groupBy(*KEYS).agg(F.sum("volume_quote").alias("_local"))
    reported = candidates.groupBy("venue").agg(F.count("volume_usd_24h").alias("_reported"))
    joined = candidates.join(local, KEYS, "left").join(F.broadcast(reported), "venue", "left")
    volume = F.when(F.col("_reported") == 0, F.col("_local")).otherwise(F.col("volume_usd_24h"))
    return joined.withColumn("volume_usd_24h", volume).select(*candidates.columns)


def select_universe(
    candidates: DataFrame,
    as_of: datetime,
    *,
    top_n: int,
    name: str = "universe",
    instrument_type: str = "SWAP",
    settle_currency: str = "USDT",
    contract_type: str = "linear",
    states: Sequence[str] = ("live",),
    min_listing_days: int = 0,
    min_volume_usd: float = 0.0,
    min_open_interest_usd: float = 0.0,
    max_spread_bps: float | None = None,
    by: Sequence[str] = (),
    config_hash: str = "",
) -> DataFrame:
    """Top instruments by volume, then open interest, then name.

    ``row_number() <= N`` lets Spark keep only N rows per task before the shuffle.
    """
    t = time_literal(as_of) if not by else F.col("timestamp")
    keep = (
        (F.col("instrument_type") == instrument_type)
        & (F.col("settle_currency") == settle_currency)
        & (F.lower("contract_type") == contract_type)
        & F.lower("state").isin(list(states))
        & (F.col("list_time") <= t - F.make_dt_interval(days=F.lit(min_listing_days)))
        & (F.col("expiration_time").isNull() | (F.col("expiration_time") > t))
        & (F.coalesce("volume_usd_24h", F.lit(0.0)) >= min_volume_usd)
        & (F.coalesce("open_interest_usd", F.lit(0.0)) >= min_open_interest_usd)
    )
    if max_spread_bps is not None:
        keep &= F.col("spread_bps").isNull() | (F.col("spread_bps") <= max_spread_bps)
    order = [
        F.col("volume_usd_24h").desc_nulls_last(),
        F.col("open_interest_usd").desc_nulls_last(),
        F.col("instrument_id"),
    ]
    rank = F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy(*order))
    top = candidates.where(keep).withColumn("rank", rank).where(F.col("rank") <= top_n)
    return top.select(
        F.lit(name).alias("universe_name"),
        "venue",
        t.alias("timestamp"),
        F.col("timestamp").alias("source_snapshot_timestamp"),
        "instrument_id",
        "rank",
        "list_time",
        "volume_usd_24h",
        "open_interest_usd",
        "spread_bps",
        F.lit(config_hash).alias("config_hash"),
    )


def read_universe(saved: DataFrame, name: str, as_of: datetime, config_hash: str | None = None):
    """The latest saved universe of that name at or before ``as_of``."""
    rows = saved.where(F.col("universe_name") == name)
    if config_hash is not None:
        rows = rows.where(F.col("config_hash") == config_hash)
    return snapshot_at(rows, as_of)


def rolling_universe(
    bars: DataFrame,
    lookback: int,
    top_n: int,
    *,
    volume: str = "volume_quote",
    shifted: bool = True,
    keys: Sequence[str] = KEYS,
    max_rows: int | None = None,
) -> DataFrame:
    """Trailing mean volume (of earlier bars only when ``shifted``), rank per time, top-N flag."""

    def trailing(s: Series) -> dict[str, Column]:
        mean = s.mean(volume, lookback)
        return {"trailing_volume": s.lag(mean, 1) if shifted else mean}

    scored = over_series(bars, keys, ["timestamp"], trailing, max_rows=max_rows)
    scored = materialize(
        scored.where(F.col("trailing_volume").isNotNull()).withColumn(
            "_sort", -F.col("trailing_volume")
        )
    )
    ranked = tie_range(
        scored,
        ["timestamp"],
        ["_sort", "instrument_id"],
        first="volume_rank",
    ).drop("_last", "_size", "_sort")
    return ranked.withColumn("in_universe", F.col("volume_rank") <= top_n)


def universe_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("timestamp", "in_universe").agg(F.count(F.lit(1)).alias("instruments"))


def merge_registry(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert sightings: bounds widen, attributes take the newest non-null value."""
    both = known.unionByName(batch)
    attributes = [c for c in known.columns if c not in (*KEYS, "first_seen", "last_seen")]
    newest = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("last_seen"))).alias(c)
        for c in attributes
    ]
    merged = both.groupBy(*KEYS).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *newest
    )
    return merged.select(*known.columns)


def active_on(registry: DataFrame, day: datetime) -> DataFrame:
    """Listed before the day ends and not expired when it starts."""
    start = time_literal(day)
    end = start + F.expr("INTERVAL 1 DAY")
    return registry.where(
        (F.col("listed_at").isNull() | (F.col("listed_at") < end))
        & (F.col("expires_at").isNull() | (F.col("expires_at") > start))
    )
