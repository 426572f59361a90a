"""Latest state from messages, snapshots, streams and whole studies."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import floor_time
from tidemark.operators import quality
from tidemark.operators.combine import CombinationRequest
from tidemark.plans import experiments as ex
from tidemark.queries.base import bars, final, query, table
from tidemark.queries.q_analytics import DS, SERIES, SUMMARY, SUMMARY_OUT
from tidemark.queries.q_combine import _scaled
from tidemark.queries.q_portfolio import LONG_SHORT, metrics_sql
from tidemark.queries.q_processing import SPECS
from tidemark.session import materialize, shared_folder
from tidemark.streaming import state as st

# Messages: received up to an hour after the exchange time, which one in six lacks.
MSG = """ms AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id, value, CASE WHEN event_id % 6 <> 0 THEN date_trunc('second', ts) END AS ex,
  date_trunc('second', ts) + INTERVAL 1 MINUTE * (event_id % 60) AS rc, CASE WHEN event_id % 2 = 0 THEN 'rest' ELSE 'websocket' END AS src FROM events)"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    ts = F.date_trunc("second", "ts").cast("timestamp_ntz")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("instrument_id"),
        F.when(k % 6 != 0, ts).alias("exchange_ts"),
        (ts + F.make_dt_interval(mins=(k % 60).cast("int"))).alias("received_at"),
        F.col("value"),
        F.when(k % 2 == 0, "rest").otherwise("websocket").alias("source"),
        F.col("event_type").alias("ratio_type"),
    )


@query(
    "parse_messages",
    final(
        "x AS (SELECT event_id, CAST(user_id AS VARCHAR) AS id, value, event_id % 10 = 0 AS bad, date_trunc('millisecond', ts) AS r FROM events)", "x",
        d="value=CASE WHEN NOT bad THEN value END", o="instrument_id=id; received_at=r; reject_reason=CASE WHEN bad THEN 'BAD_NUMBER' END",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.col("event_id") % 10 == 0
    payload = F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("instrument_id"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("received_at"),
            F.when(bad, "oops").otherwise(F.col("value").cast("string")).alias("value"),
            F.lit("rest").alias("source"),
        )
    )
    raw = table(spark, sf, "events").select(payload.alias("payload"))
    return st.parse_messages(raw).select("instrument_id", "received_at", "value", "reject_reason")


@query(
    "latest_state",
    final(
        f"{MSG}, rn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(ex, rc) DESC, (src = 'websocket')::INT DESC, rc DESC, ex DESC NULLS LAST, value DESC) AS k FROM ms)",
        "rn", d="value", o="instrument_id=id; exchange_ts=ex; received_at=rc; source=src", where="k = 1",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return st.latest_state(messages(spark, sf).drop("ratio_type"))


@query(
    "latest_ratio_state",
    final(
        "x AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('second', ts) DESC, date_trunc('second', ts) + INTERVAL 1 MINUTE * (event_id % 60) DESC, value DESC) AS k FROM events)",
        "x", d="value", o="instrument_id=CAST(user_id AS VARCHAR); ratio_type=event_type", where="k = 1",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.date_trunc("second", "ts").cast("timestamp_ntz")
    m = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("instrument_id"), F.col("event_type").alias("ratio_type"),
        ts.alias("exchange_ts"),
        (ts + F.make_dt_interval(mins=(F.col("event_id") % 60).cast("int"))).alias("received_at"), "value",
    )
    got = st.latest_state(m, ["instrument_id", "ratio_type"], with_priority=False)
    return got.select("instrument_id", "ratio_type", "value")


@query(
    "minute_snapshots",
    final(
        "x AS (SELECT CAST(user_id AS VARCHAR) AS id, ts, value FROM events), "
        "pt AS (SELECT id, CASE WHEN time_bucket(INTERVAL '6 hours', ts) = ts THEN ts ELSE time_bucket(INTERVAL '6 hours', ts) + INTERVAL 6 HOUR END AS p FROM x), "
        "gr AS (SELECT id, unnest(generate_series(min(p), (SELECT max(p) FROM pt), INTERVAL 6 HOUR)) AS t FROM pt GROUP BY id), "
        "j AS (SELECT gr.id, gr.t, x.ts, x.value FROM gr ASOF JOIN x ON gr.id = x.id AND gr.t >= x.ts)",
        "j", d="value", o="instrument_id=id; timestamp=t; status=CASE WHEN t - ts < INTERVAL 43201 SECOND THEN 'fresh' ELSE 'stale' END",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("instrument_id"), F.col("ts").alias("received_at"), "value"
    )
    snap = st.minute_snapshots(materialize(e), columns=["value"], minutes=360, stale_seconds=43_200)
    return snap.select("instrument_id", "timestamp", "value", "status")


@query(
    "stale_or_missing",
    final(
        "ls AS (SELECT user_id, max(ts) AS m FROM events WHERE event_type = 'click' GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events), "
        "j AS (SELECT user_id, m, CASE WHEN m IS NULL THEN 'missing' WHEN date_diff('second', m, TIMESTAMP '2024-01-30') > 86400 THEN 'stale' END AS s FROM u LEFT JOIN ls USING (user_id))",
        "j", o="instrument_id=CAST(user_id AS VARCHAR); received_at=m; status=s", where="s IS NOT NULL",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("instrument_id"), F.col("ts").alias("received_at"), "event_type"
    )
    clicks = e.where("event_type = 'click'").groupBy("instrument_id").agg(
        F.max("received_at").alias("received_at")
    )
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    return st.stale_or_missing(e, clicks, now, stale_seconds=86_400)


@query(
    "retain_live_state",
    final(
        "x AS (SELECT user_id, max(value) AS v FROM events GROUP BY 1)", "x", d="value=v", o="instrument_id=CAST(user_id AS VARCHAR)",
        where="user_id IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30')",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("instrument_id", F.col("user_id").cast("string"))
    now = e.groupBy("instrument_id").agg(F.max("value").alias("value"))
    return st.retain(now, e.where(F.col("ts") >= "2024-01-30"))


@query("snapshot_grid_times", final("", "events", i="event_id", o="m1=time_bucket(INTERVAL '1 minute', ts); m5=time_bucket(INTERVAL '5 minutes', ts)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", st.snapshot_time("ts").alias("m1"), st.snapshot_time("ts", 5).alias("m5")
    )


@query(
    "pending_settlements",
    final(
        "x AS (SELECT DISTINCT user_id, time_bucket(INTERVAL '1 day', ts) AS t FROM events), c AS (SELECT DISTINCT user_id, time_bucket(INTERVAL '1 day', ts) AS t FROM events WHERE event_type <> 'click'), "
        "p AS (SELECT x.* FROM x ANTI JOIN c USING (user_id, t) WHERE x.t + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-25')",
        "p", o="instrument_id=CAST(user_id AS VARCHAR); timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("instrument_id"), floor_time("ts", 1440).alias("timestamp"), "event_type"
    )
    expected = e.select("instrument_id", "timestamp").distinct()
    now = F.lit("2024-01-25").cast("timestamp_ntz")
    return st.pending_settlements(expected, e.where("event_type <> 'click'"), now, 60)


@query(
    "latest_confirmed",
    final("x AS (SELECT user_id, max(ts) AS m FROM events WHERE value > 60 GROUP BY 1)", "x", o="instrument_id=CAST(user_id AS VARCHAR); latest_time=m"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("instrument_id"), F.col("ts").alias("timestamp"),
        F.when(F.col("value") > 60, F.col("value")).alias("realized_rate"),
    )
    return st.latest_confirmed(e)


# -- streams -------------------------------------------------------------------------------
def _landed(spark: SparkSession, df: DataFrame, files: int) -> DataFrame:
    """The rows as a file stream read in several micro-batches."""
    path = f"{shared_folder(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query(
    "stream_latest_state",
    final(
        f"{MSG}, rn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(ex, rc) DESC, (src = 'websocket')::INT DESC, rc DESC, value DESC) AS k FROM ms)",
        "rn", d="value", o="instrument_id=id", where="k = 1",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    base = f"{shared_folder(spark).rstrip('/')}/state-{uuid.uuid4().hex}"
    stream = st.stream_latest_state(_landed(spark, messages(spark, sf), 6), "60 days")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{base}/out")

    q = (
        stream.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    changes = spark.read.parquet(f"{base}/out")
    return changes.groupBy("instrument_id").agg(
        F.max_by("value", F.struct("order_time", "source_priority", "epoch")).alias("value")
    )


@query(
    "stream_snapshot_sink",
    final(
        "x AS (SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS t, arg_max(value, event_id) AS value FROM events GROUP BY ALL)", "x", d="value", i="user_id",
        o="timestamp=t; date=CAST(t AS DATE)",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    base = f"{shared_folder(spark).rstrip('/')}/sink-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("user_id", floor_time("ts", 1440).alias("timestamp"), "event_id", "value")
    # Micro-batches overlap in keys; the merge keeps the last event per user and day.
    q = st.write_snapshots(
        _landed(spark, e, 4), f"{base}/out", f"{base}/ckpt", ["user_id", "timestamp"], "timestamp",
        {"availableNow": True}, ["event_id"],
    )
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "timestamp", "date", "value")


# -- studies -------------------------------------------------------------------------------
WHOLE = (datetime(2000, 1, 1), datetime(2100, 1, 1))


def study(**more) -> ex.Study:
    return ex.Study(SPECS, "1d", *WHOLE, horizons=(1, 2), **more)


@query("factor_experiment_ic_summary", final(f"{DS},\n{SERIES},\n{SUMMARY}", "su", **SUMMARY_OUT))
def _(spark: SparkSession, sf: str) -> DataFrame:
    b = materialize(bars(spark, sf))
    return ex.factor_experiment(b, study())["ic_summary"]


_WEIGHTS = {s.name: w for s, w in zip(SPECS, (3.0, 1.7, 1.1), strict=True)}
_MIX = "0.0" + "".join(f" + q{i} * CAST({w / 5.8!r} AS DOUBLE)" for i, w in enumerate((3.0, 1.7, 1.1)))
# Z-scores keep the order within a time, so ranks of raw factors give the same combined score.
_XS = ", ".join(
    f"max(v) FILTER (WHERE factor_name = '{s.name}') AS x{i}" for i, s in enumerate(SPECS)
)
_MIXED = (
    f"wx AS (SELECT venue, instrument_id, bar_type, t, {_XS} FROM ds GROUP BY ALL), "
    + "wr AS (SELECT *, " + ", ".join(f"{_scaled(f'x{i}')} AS q{i}, count(x{i}) OVER (PARTITION BY t) AS k{i}" for i in range(3)) + " FROM wx), "
    "wz AS (SELECT *, CASE WHEN k0 >= 5 AND k1 >= 5 AND k2 >= 5 THEN " + _MIX + " END AS z FROM wr), "
    "mix AS (SELECT l.*, z AS v FROM (SELECT DISTINCT venue, instrument_id, bar_type, t, label_name, h, exit_time, gross, ok FROM ds) l JOIN wz USING (venue, instrument_id, bar_type, t) WHERE ok AND z IS NOT NULL)"
)


def _strategy_sql() -> str:
    text = LONG_SHORT.replace(
        f"FROM ds WHERE valid AND factor_name = '{SPECS[0].name}' AND", "FROM mix WHERE"
    ).replace("TIMESTAMP '2024-01-01', t) % h", "TIMESTAMP '2000-01-01', t) % h")
    return text.replace("sel AS (", f"{_MIXED},\nsel AS (", 1)


@query(
    "strategy_experiment_metrics",
    final(
        f"{_strategy_sql()},\n{metrics_sql('pf', 'label_name, h')}", "me",
        d="total_return=total_return; sharpe=sharpe; max_drawdown=max_drawdown; turnover=turnover; win_rate=win_rate",
        i="horizon_bars=h; periods=periods", o="factor_name='mix'; label_name",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    request = CombinationRequest("rank", tuple(s.name for s in SPECS), name="mix", params={"weights": _WEIGHTS})
    b = materialize(bars(spark, sf, "calm_user"))
    out = ex.strategy_experiment(
        b, study(standard={"method": "zscore"}), request, cost_bps=ex.round_trip_cost(5.0, 3.0)
    )
    return out["portfolio_metrics"].select(
        "factor_name", "label_name", "horizon_bars", "periods", "total_return", "sharpe", "max_drawdown",
        "turnover", "win_rate",
    )


@query(
    "data_fingerprint",
    final(
        "g AS (SELECT event_type, CAST(ts AS DATE) AS d, min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM events GROUP BY ALL), "
        "h AS (SELECT sha256(event_type || '|' || d || '|' || lo || '|' || hi || '|' || n) AS digest FROM g), "
        "x AS (SELECT count(*) AS n, "
        + ", ".join(f"bit_xor(CAST('0x' || substr(digest, {1 + 15 * i}, 15) AS BIGINT)) AS l{i}" for i in range(4))
        + " FROM h)",
        "x", i="partitions=n", o="fingerprint=sha256(n || '|' || l0 || '|' || l1 || '|' || l2 || '|' || l3)",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    stats = quality.file_stats(df, ["event_type", "date"], "ts")
    return ex.data_fingerprint(stats, ["event_type", "date"])


@query(
    "resolve_universe_explicit",
    final(
        f"{DS}, x AS (SELECT count(*) AS n, count(DISTINCT instrument_id) AS k FROM bars WHERE instrument_id IN ('1', '2', '5'))", "x", i="rows=n; instruments=k",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    chosen = ex.resolve_universe(spark, venue="SIM", instruments=["1", "2", "5", "2"])
    df = bars(spark, sf).join(F.broadcast(chosen), ["venue", "instrument_id"], "left_semi")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("instrument_id").alias("instruments")
    )


