"""Point-in-time universes from order snapshots and event panels."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import universe as un
from tidemark.queries.base import bars, bars_sql, final, lag, query, roll, series_rows, table
from tidemark.session import materialize
from tidemark.sources.schemas import TABLES

AS_OF = datetime(2024, 1, 20, 12)

# A snapshot per five days lists the users seen in them.
SNAP = """sv AS (
  SELECT user_id, time_bucket(INTERVAL '5 days', ts, TIMESTAMP '1970-01-01') AS t, sum(value) AS vol, max(value) * 10 AS oi, min(value) AS lo
  FROM events GROUP BY ALL),
sn AS (
  SELECT 'SIM' AS venue, CAST(user_id AS VARCHAR) || '-USDT-SWAP' AS instrument_id, t,
    CASE WHEN user_id % 4 <> 0 THEN TIMESTAMP '2023-12-01' + INTERVAL 1 DAY * (user_id % 60) END AS list_time,
    CASE WHEN user_id % 9 = 0 THEN TIMESTAMP '2024-01-10' + INTERVAL 1 DAY * (user_id % 30) END AS exp,
    CASE WHEN user_id % 7 = 0 THEN 'suspend' ELSE 'LIVE' END AS state, vol, oi, CASE WHEN user_id % 5 <> 0 THEN lo END AS spread, user_id
  FROM sv)"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    e = table(spark, sf, "events")
    slot = F.window("ts", "5 days").start.alias("timestamp")
    got = e.groupBy("user_id", slot).agg(
        F.sum("value").alias("volume_usd_24h"), (F.max("value") * 10).alias("open_interest_usd"),
        F.min("value").alias("_lo"),
    )
    day = F.make_dt_interval
    listed = F.lit("2023-12-01").cast("timestamp_ntz") + day(days=(u % 60).cast("int"))
    expires = F.lit("2024-01-10").cast("timestamp_ntz") + day(days=(u % 30).cast("int"))
    made = {
        "venue": F.lit("SIM"),
        "instrument_id": F.concat(u.cast("string"), F.lit("-USDT-SWAP")),
        "instrument_type": F.lit("SWAP"),
        "settle_currency": F.lit("USDT"),
        "contract_type": F.lit("Linear"),
        "state": F.when(u % 7 == 0, "suspend").otherwise("LIVE"),
        "list_time": F.when(u % 4 != 0, listed),
        "expiration_time": F.when(u % 9 == 0, expires),
        "spread_bps": F.when(u % 5 != 0, F.col("_lo")),
    }
    df = got.withColumns(made)
    for f in TABLES["instrument_snapshots"].fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*TABLES["instrument_snapshots"].names)


@query(
    "snapshot_at",
    final(
        f"{SNAP}, lt AS (SELECT max(t) AS t FROM sn WHERE t <= TIMESTAMP '2024-01-20 12:00:00')", "sn",
        d="volume_usd_24h=vol; open_interest_usd=oi", o="instrument_id; timestamp=t", where="t = (SELECT t FROM lt)",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    snap = un.snapshot_at(materialize(snapshots(spark, sf)), AS_OF)
    return snap.select("instrument_id", "timestamp", "volume_usd_24h", "open_interest_usd")


@query(
    "candle_lifetimes",
    final(
        f"{bars_sql('user')}, cl AS (SELECT venue, instrument_id, min(t) AS a, max(t) + INTERVAL 1 DAY AS b FROM bars GROUP BY ALL)",
        "cl", o="venue; instrument_id; start_time=a; end_time=b",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return un.candle_lifetimes(bars(spark, sf), 1440)


_LIFE = f"""{SNAP}, tm AS (SELECT DISTINCT t FROM sn),
nx AS (SELECT t, lead(t) OVER (ORDER BY t) AS miss FROM tm),
ag AS (SELECT venue, instrument_id, min(t) AS fs, max(t) AS ls, min(list_time) AS li, min(exp) AS ex FROM sn GROUP BY ALL),
lf AS (SELECT ag.*, miss, coalesce(li, fs) AS vf, coalesce(ex, miss) AS vt, CASE WHEN ex IS NOT NULL THEN 'exchange_expiration_time' WHEN miss IS NOT NULL THEN 'first_missing_snapshot' ELSE '' END AS src
  FROM ag LEFT JOIN nx ON nx.t = ag.ls)"""


@query(
    "rebuild_lifecycle",
    final(
        _LIFE, "lf", o="venue; instrument_id; valid_from=vf; valid_to=vt; first_seen=fs; last_seen=ls; valid_from_source=CASE WHEN li IS NOT NULL THEN 'exchange_list_time' ELSE 'first_seen' END; "
        "valid_to_source=src; confidence=CASE WHEN li IS NOT NULL AND src <> 'first_missing_snapshot' THEN 'exact' ELSE 'inferred' END",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return un.rebuild_lifecycle(materialize(snapshots(spark, sf))).select(
        "venue", "instrument_id", "valid_from", "valid_to", "first_seen", "last_seen", "valid_from_source",
        "valid_to_source", "confidence",
    )


# Candles exist for users above 20 only, and for a few names no snapshot ever listed.
_CB = """cb AS (SELECT 'SIM' AS venue, CASE WHEN user_id % 10 = 3 THEN 'X' ELSE '' END || CAST(user_id AS VARCHAR) || '-USDT-SWAP' AS instrument_id,
  min(time_bucket(INTERVAL '1 day', ts)) AS a, max(time_bucket(INTERVAL '1 day', ts)) AS b FROM events WHERE user_id > 20 GROUP BY ALL),
mg AS (SELECT coalesce(lf.venue, cb.venue) AS venue, coalesce(lf.instrument_id, cb.instrument_id) AS instrument_id, lf.fs IS NOT NULL AS known, a, b, fs, ls, li, vf, vt, src
  FROM lf FULL JOIN cb ON lf.instrument_id = cb.instrument_id)"""


@query(
    "rebuild_lifecycle_with_candles",
    final(
        f"{_LIFE}, {_CB}", "mg",
        o="venue; instrument_id; valid_from=CASE WHEN NOT known THEN a WHEN li IS NULL AND a < vf THEN a ELSE vf END; "
        "valid_to=CASE WHEN NOT known THEN b + INTERVAL 1 DAY WHEN src = 'first_missing_snapshot' THEN greatest(vt, b + INTERVAL 1 DAY) ELSE vt END; "
        "first_seen=CASE WHEN NOT known THEN a ELSE least(fs, a) END; last_seen=CASE WHEN NOT known THEN b ELSE greatest(ls, b) END; "
        "valid_from_source=CASE WHEN NOT known THEN 'first_candle' WHEN li IS NOT NULL THEN 'exchange_list_time' WHEN a < vf THEN 'first_candle' ELSE 'first_seen' END; "
        "valid_to_source=CASE WHEN NOT known THEN 'last_candle' ELSE src END; settle_currency='USDT'",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("instrument_id").cast("int")
    prefix = F.when(u % 10 == 3, "X").otherwise("")
    name = F.concat(prefix, F.col("instrument_id"), F.lit("-USDT-SWAP"))
    raw = table(spark, sf, "events").where("user_id > 20").select(
        F.lit("SIM").alias("venue"), F.col("user_id").cast("string").alias("instrument_id"),
        F.window("ts", "1 day").start.alias("timestamp"),
    )
    candles = raw.withColumn("instrument_id", name)
    return un.rebuild_lifecycle(materialize(snapshots(spark, sf)), candles, 1440).select(
        "venue", "instrument_id", "valid_from", "valid_to", "first_seen", "last_seen", "valid_from_source",
        "valid_to_source", "settle_currency",
    )


@query(
    "alive_at",
    final(
        _LIFE, "lf", o="instrument_id; valid_from=vf; valid_to=vt",
        where="vf <= TIMESTAMP '2024-01-20 12:00:00' AND (vt IS NULL OR vt > TIMESTAMP '2024-01-20 12:00:00')",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    life = un.rebuild_lifecycle(materialize(snapshots(spark, sf)))
    return un.alive_at(life, AS_OF).select("instrument_id", "valid_from", "valid_to")


@query(
    "add_local_volume",
    final(
        f"{SNAP}, lt AS (SELECT max(t) AS t FROM sn WHERE t <= TIMESTAMP '2024-01-20 12:00:00'), "
        "lv AS (SELECT CAST(user_id AS VARCHAR) || '-USDT-SWAP' AS instrument_id, sum(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-19 12:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL), "
        "j AS (SELECT sn.instrument_id, lv.v FROM sn LEFT JOIN lv USING (instrument_id) WHERE t = (SELECT t FROM lt))",
        "j", d="volume_usd_24h=v", o="instrument_id",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    snap = un.snapshot_at(materialize(snapshots(spark, sf)), AS_OF)
    snap = snap.withColumn("volume_usd_24h", F.lit(None).cast("double"))
    candles = table(spark, sf, "events").select(
        F.lit("SIM").alias("venue"),
        F.concat(F.col("user_id").cast("string"), F.lit("-USDT-SWAP")).alias("instrument_id"),
        F.col("ts").alias("timestamp"), F.col("value").alias("volume_quote"),
    )
    return un.add_local_volume(snap, candles, AS_OF).select("instrument_id", "volume_usd_24h")


_SELECT = (
    f"{SNAP}, lt AS (SELECT max(t) AS t FROM sn WHERE t <= TIMESTAMP '2024-01-20 12:00:00'), "
    "ok AS (SELECT * FROM sn WHERE t = (SELECT t FROM lt) AND lower(state) = 'live' AND list_time <= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY "
    "AND (exp IS NULL OR exp > TIMESTAMP '2024-01-20 12:00:00') AND vol >= 50 AND oi >= 100 AND (spread IS NULL OR spread <= 30)), "
    "us AS (SELECT *, row_number() OVER (ORDER BY vol DESC NULLS LAST, oi DESC NULLS LAST, instrument_id) AS rk FROM ok)"
)


def selected(spark: SparkSession, sf: str) -> DataFrame:
    snap = un.snapshot_at(materialize(snapshots(spark, sf)), AS_OF)
    return un.select_universe(
        snap, AS_OF, top_n=20, name="main", min_listing_days=7, min_volume_usd=50.0, min_open_interest_usd=100.0,
        max_spread_bps=30.0,
    )


@query(
    "select_universe",
    final(
        _SELECT, "us", d="volume_usd_24h=vol; open_interest_usd=oi; spread_bps=spread", i="rank=rk", where="rk <= 20",
        o="universe_name='main'; instrument_id; timestamp=TIMESTAMP '2024-01-20 12:00:00'; source_snapshot_timestamp=t; list_time",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return selected(spark, sf).drop("venue", "config_hash")


@query("read_universe", final(_SELECT, "us", i="rank=rk", o="instrument_id", where="rk <= 20"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    saved = materialize(selected(spark, sf))
    older = saved.withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 3 DAY"))
    later = saved.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 3 DAY"))
    both = older.where("rank <= 5").unionByName(saved).unionByName(later)
    return un.read_universe(both, "main", datetime(2024, 1, 21)).select("instrument_id", "rank")


_ROLL = (
    f"{bars_sql('user')}, tv AS (SELECT *, {roll('avg', 'volume_quote', 4)} AS m FROM bars), tl AS (SELECT *, {lag('m')} AS tvol FROM tv), "
    "ru AS (SELECT instrument_id, t, tvol, row_number() OVER (PARTITION BY t ORDER BY tvol DESC, instrument_id) AS rk FROM tl WHERE tvol IS NOT NULL)"
)


def rolled(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return un.rolling_universe(bars(spark, sf), 4, 30, max_rows=series_rows(spark, sf), **kw)


@query("rolling_universe", final(_ROLL, "ru", d="trailing_volume=tvol", i="volume_rank=rk", o="instrument_id; timestamp=t; in_universe=rk <= 30"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rolled(spark, sf).select(
        "instrument_id", "timestamp", "trailing_volume", "volume_rank", "in_universe"
    )


@query(
    "rolling_universe_unshifted",
    final(
        f"{bars_sql('user')}, tv AS (SELECT *, {roll('avg', 'volume_quote', 4)} AS m FROM bars), "
        "ru AS (SELECT instrument_id, t, m, row_number() OVER (PARTITION BY t ORDER BY m DESC, instrument_id) AS rk FROM tv WHERE m IS NOT NULL)",
        "ru", d="trailing_volume=m", i="volume_rank=rk", o="instrument_id; timestamp=t; in_universe=rk <= 30",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rolled(spark, sf, shifted=False).select(
        "instrument_id", "timestamp", "trailing_volume", "volume_rank", "in_universe"
    )


@query("universe_counts", final(f"{_ROLL}, uc2 AS (SELECT t, rk <= 30 AS u, count(*) AS n FROM ru GROUP BY ALL)", "uc2", i="instruments=n", o="timestamp=t; in_universe=u"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return un.universe_counts(rolled(spark, sf))


_REG = """a AS (SELECT c_custkey, TIMESTAMP '2024-01-01' AS fs, TIMESTAMP '2024-01-05' AS ls, CASE WHEN c_custkey % 2 = 0 THEN DATE '2023-01-01' + c_nationkey END AS li, CAST(NULL AS DATE) AS ex FROM customer WHERE c_custkey % 3 <> 0),
b AS (SELECT c_custkey, TIMESTAMP '2024-01-03' AS fs, TIMESTAMP '2024-01-09' AS ls, CASE WHEN c_custkey % 5 = 0 THEN DATE '2023-06-01' + c_nationkey END AS li, CASE WHEN c_custkey % 7 = 0 THEN DATE '2024-02-01' END AS ex FROM customer WHERE c_custkey % 2 = 0),
rg2 AS (SELECT c_custkey AS k, least(a.fs, b.fs) AS fs, greatest(a.ls, b.ls) AS ls, CAST(coalesce(b.li, a.li) AS TIMESTAMP) AS li, CAST(coalesce(b.ex, a.ex) AS TIMESTAMP) AS ex FROM a FULL JOIN b USING (c_custkey))"""


def registry(spark: SparkSession, sf: str) -> DataFrame:
    c, k = table(spark, sf, "customer"), F.col("c_custkey")

    def batch(first: str, last: str, listed, expires) -> DataFrame:
        return c.select(
            F.lit("SIM").alias("venue"), k.cast("string").alias("instrument_id"),
            F.lit(first).cast("timestamp_ntz").alias("first_seen"), F.lit(last).cast("timestamp_ntz").alias("last_seen"),
            listed.alias("listed_at"), expires.alias("expires_at"), k.alias("_k"),
        )

    def since(day: str, when):
        start = F.lit(day).cast("timestamp_ntz")
        return F.when(when, start + F.make_dt_interval(days=F.col("c_nationkey")))

    none = F.lit(None).cast("timestamp_ntz")
    known = batch("2024-01-01", "2024-01-05", since("2023-01-01", k % 2 == 0), none)
    seen = batch(
        "2024-01-03", "2024-01-09", since("2023-06-01", k % 5 == 0),
        F.when(k % 7 == 0, F.lit("2024-02-01").cast("timestamp_ntz")),
    )
    return un.merge_registry(known.where("_k % 3 <> 0").drop("_k"), seen.where("_k % 2 = 0").drop("_k"))


@query("merge_registry", final(_REG, "rg2", o="instrument_id=CAST(k AS VARCHAR); first_seen=fs; last_seen=ls; listed_at=li; expires_at=ex"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return registry(spark, sf).drop("venue")


@query(
    "active_on",
    final(
        _REG, "rg2", o="instrument_id=CAST(k AS VARCHAR); listed_at=li; expires_at=ex",
        where="(li IS NULL OR li < TIMESTAMP '2023-06-11') AND (ex IS NULL OR ex > TIMESTAMP '2023-06-10')",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return un.active_on(registry(spark, sf), datetime(2023, 6, 10)).select(
        "instrument_id", "listed_at", "expires_at"
    )
