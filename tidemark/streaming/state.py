"""Latest state per instrument from landed messages, minute snapshots and their sinks.

Batch and stream share the same column logic. The streaming form keeps one row per key in Spark's
state store and emits it whenever a newer message arrives; snapshots and idempotent writes happen in
``foreachBatch``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from datetime import datetime
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.scalars import floor_time, minutes_interval, shift_time
from tidemark.operators.grid import AsofSource, asof_many, last_per_slot
from tidemark.sources.market import upsert_partitions

# A websocket message outranks a REST row of the same time.
SOURCE_PRIORITY = {"rest": 0, "websocket": 1}
STALE_SECONDS = 120
MESSAGE = "instrument_id string, exchange_ts long, received_at long, value string, source string"


def parse_messages(df: DataFrame, payload: str = "payload", schema: str = MESSAGE) -> DataFrame:
    """JSON messages to typed rows plus the reason a row cannot be used."""
    m = df.withColumn("_m", F.from_json(payload, schema)).select(*df.columns, "_m.*")
    value = F.col("value").try_cast("double")
    reason = (
        F.when(F.coalesce(F.col("instrument_id"), F.lit("")) == "", "MISSING_ID")
        .when(F.col("received_at").isNull(), "MISSING_TIME")
        .when(value.isNull() & F.col("value").isNotNull(), "BAD_NUMBER")
    )

    def ms(name: str) -> Column:
        return F.timestamp_millis(F.col(name)).cast("timestamp_ntz").alias(name)

    return m.select(
        "instrument_id", ms("exchange_ts"), ms("received_at"), value.alias("value"),
        F.col("source"), reason.alias("reject_reason"),
    )


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, parsed.where(F.col("reject_reason").isNotNull())


def event_order(with_priority: bool = True) -> list[Column]:
    """What makes a message newer: its time, then its source, then its arrival."""
    if not with_priority:
        return [F.col("exchange_ts"), F.col("received_at")]
    priority = F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv])
    return [
        F.coalesce("exchange_ts", "received_at"),
        F.coalesce(F.try_element_at(priority, F.col("source")), F.lit(0)),
        F.col("received_at"),
    ]


def latest_state(
    events: DataFrame, keys: Sequence[str] = ("instrument_id",), with_priority: bool = True
) -> DataFrame:
    """Newest message per key; late and lower-priority messages lose.

    A plain maximum, so a key with most of the messages combines map-side.
    """
    rest = [c for c in events.columns if c not in keys]
    order = [c.alias(f"_o{i}") for i, c in enumerate(event_order(with_priority))]
    best = F.max(F.struct(*order, *[F.col(c) for c in rest])).alias("_b")
    return events.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}") for c in rest])


def minute_snapshots(
    events: DataFrame,
    *,
    columns: Sequence[str],
    keys: Sequence[str] = ("instrument_id",),
    minutes: int = 1,
    stale_seconds: int = STALE_SECONDS,
    on: str = "received_at",
    until: datetime | None = None,
) -> DataFrame:
    """State of every key at each grid minute from its first message on, marked fresh or stale by age.

    The grid ends for all keys at ``until``, by default the last message of any: a key that falls
    silent turns stale. Messages reduce to the last one per key and grid point before the as-of pass.
    """
    points = last_per_slot(events, minutes, keys, [on, *columns], on=on)
    span = points.groupBy(*keys).agg(F.min("timestamp").alias("_from"))
    if until is None:
        # One row, whatever the number of messages.
        span = span.crossJoin(F.broadcast(points.agg(F.max("timestamp").alias("_to"))))
    else:
        end = floor_time(F.lit(until).cast("timestamp_ntz"), minutes)
        span = span.withColumn("_to", end).where(F.col("_from") <= F.col("_to"))
    grid = span.select(
        *keys,
        F.explode(F.sequence("_from", "_to", minutes_interval(minutes))).alias("timestamp"),
    )
    state = asof_many(grid, keys, [AsofSource(points, [on, *columns])])
    age = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col(on), F.col("timestamp")))
    return state.withColumns(
        {"age_seconds": age, "status": F.when(age <= stale_seconds, "fresh").otherwise("stale")}
    )


def stale_or_missing(
    universe: DataFrame, state: DataFrame, now: Column, *, keys: Sequence[str] = ("instrument_id",),
    stale_seconds: int = STALE_SECONDS, on: str = "received_at",
) -> DataFrame:
    """Expected keys without a recent state."""
    joined = universe.select(*keys).distinct().join(state.select(*keys, on), list(keys), "left")
    age = F.timestamp_diff("SECOND", F.col(on), now)
    status = F.when(F.col(on).isNull(), "missing").when(age > stale_seconds, "stale")
    return joined.withColumn("status", status).where(F.col("status").isNotNull())


def retain(state: DataFrame, live: DataFrame, keys: Sequence[str] = ("instrument_id",)):
    return state.join(live.select(*keys).distinct(), list(keys), "left_semi")


def snapshot_time(ts: str | Column, minutes: int = 1) -> Column:
    return floor_time(ts, minutes)


def pending_settlements(
    expected: DataFrame, confirmed: DataFrame, now: Column, delay_minutes: int = 0
) -> DataFrame:
    """Funding times that are due but not confirmed yet."""
    keys = ["instrument_id", "timestamp"]
    due = expected.where(shift_time("timestamp", delay_minutes) <= now)
    return due.join(confirmed.select(*keys).distinct(), keys, "left_anti")


def latest_confirmed(history: DataFrame) -> DataFrame:
    rows = history.where(F.col("realized_rate").isNotNull())
    return rows.groupBy("instrument_id").agg(F.max("timestamp").alias("latest_time"))


# -- streaming -----------------------------------------------------------------------------
# Instruments share their state by hashed buckets: a call of Python for each would cost more than its rows.
BUCKETS = 1_024
_STATE = "ids array<string>, order_time array<long>, priority array<int>, received_at array<long>, value array<double>"
_KINDS = {"ids": object, "order_time": np.int64, "priority": np.int64, "received_at": np.int64, "value": float}
_OUT = "instrument_id string, order_time timestamp, value double, source_priority int"


def _micros(times: pd.Series) -> np.ndarray:
    """Times as numbers; a missing one is the lowest."""
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def _fold(kept: dict[str, np.ndarray], pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """The newest row of each instrument among the kept ones and those of ``pdf``.

    The order is that of the batch form: time, source, arrival, and null values lowest; a kept row stays
    where none is newer. ``seen`` marks instruments with a message, ``changed`` those with a newer one.
    """
    yes = np.ones(len(pdf), bool)
    rows = {
        "ids": pdf["instrument_id"].to_numpy(object), "order_time": _micros(pdf["order_time"]),
        "priority": pdf["priority"].to_numpy(np.int64), "received_at": _micros(pdf["received_at"]),
        "value": pdf["value"].to_numpy(float), "seen": yes, "changed": yes,
    }
    both = {c: np.concatenate([kept[c], v]) for c, v in rows.items()}
    was_kept = np.arange(len(both["ids"])) < len(kept["ids"])
    code = pd.factorize(both["ids"], use_na_sentinel=False)[0]
    known = ~np.isnan(both["value"])
    value = np.where(known, both["value"], 0.0)
    times = both["received_at"], both["priority"], both["order_time"]
    order = np.lexsort((was_kept, value, known, *times, code))
    last = order[np.flatnonzero(np.append(np.diff(code[order]) != 0, True))]
    seen = np.bincount(code, both["seen"]) > 0
    return {c: v[last] for c, v in both.items()} | {"seen": seen[code[last]]}


def _keep_newest(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, retain_ms: int
) -> Iterator[pd.DataFrame]:
    """One remembered row per instrument; emits it when a newer message replaces it, drops it when silent."""
    found = state.get if state.exists else [[] for _ in _KINDS]
    kept = {c: np.array(v, kind) for (c, kind), v in zip(_KINDS.items(), found, strict=True)}
    kept |= {c: np.zeros(len(kept["ids"]), bool) for c in ("seen", "changed")}
    if not state.hasTimedOut:
        for pdf in batches:
            kept = _fold(kept, pdf)
    out = {c: v[kept["changed"]] for c, v in kept.items()}
    if len(out["ids"]):
        yield pd.DataFrame(
            {"instrument_id": out["ids"], "order_time": out["order_time"].view("datetime64[us]"),
             "value": out["value"], "source_priority": out["priority"]}
        )
    now = state.getCurrentWatermarkMs()
    forget = kept["order_time"] // 1_000 + retain_ms
    stay = kept["seen"] | (forget >= now)
    if not stay.any():
        state.remove()
        return
    left = [kept[c][stay].tolist() for c in _KINDS]
    left[-1] = [None if math.isnan(v) else v for v in left[-1]]
    state.update(tuple(left))
    state.setTimeoutTimestamp(max(int(forget[stay].min()), now + 1))


def stream_latest_state(
    events: DataFrame, late: str = "10 minutes", retain_days: float = 30.0, buckets: int = BUCKETS
) -> DataFrame:
    """Streaming ``latest_state``: changes of the newest message per instrument.

    The rule is that of the batch form. A key silent for ``retain_days`` of event time is forgotten.
    ``buckets`` is fixed for the life of a checkpoint; give more for millions of instruments.
    """
    keep = partial(_keep_newest, retain_ms=int(retain_days * 86_400_000))
    order = event_order()
    rows = events.select(
        "instrument_id",
        order[0].cast("timestamp").alias("order_time"),
        order[1].cast("int").alias("priority"),
        F.col("received_at").cast("timestamp").alias("received_at"),
        F.col("value"),
        F.pmod(F.xxhash64("instrument_id"), F.lit(buckets)).alias("_bucket"),
    ).withWatermark("order_time", late)
    return rows.groupBy("_bucket").applyInPandasWithState(
        keep, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def write_snapshots(
    stream: DataFrame, path: str, checkpoint: str, pk: Sequence[str], date_from: str,
    trigger: dict | None = None, order: Sequence[str] = (),
) -> StreamingQuery:
    """Idempotent sink: each micro-batch is merged by key into daily partitions.

    ``order`` names the columns that make a row the last of its key, in whatever batch it comes.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("date", F.to_date(date_from))
        upsert_partitions(batch.sparkSession, rows, path, [*pk], ["date"], order)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()
