"""Tables, merging, quality reports, time grids and joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import floor_time
from tidemark.operators import grid, quality
from tidemark.queries.base import bars, bars_sql, final, lag, query, table
from tidemark.queries.q_factors import source_events
from tidemark.session import materialize, shared_folder
from tidemark.sources import files, market, payloads

K2 = ["venue", "instrument_id"]


# -- tables --------------------------------------------------------------------------------
@query(
    "canonicalize_candles",
    final(
        bars_sql("type"), "bars", d="open high low close volume volume_quote",
        i="confirm=1", o="venue; instrument_id; bar_type; timestamp=t; volume_ccy=CAST(NULL AS DOUBLE)",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    raw = bars(spark, sf, "type").withColumnsRenamed(
        {"venue": "exchange", "instrument_id": "inst_id", "bar_type": "bar", "timestamp": "ts"}
    )
    raw = raw.withColumn("confirm", F.lit("1"))
    return market.canonicalize(raw, "candles", strict=False)


@query(
    "canonicalize_epoch_millis",
    final(
        "", "events", d="funding_rate=value", o="venue='SIM'; "
        "instrument_id=CAST(user_id AS VARCHAR); timestamp=date_trunc('millisecond', ts); "
        "realized_rate=CAST(NULL AS DOUBLE); method=event_type; formula_type=CAST(NULL AS VARCHAR)",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select(
        F.lit("SIM").alias("exchange"),
        F.col("user_id").alias("inst_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("value").cast("string").alias("funding_rate"),
        F.col("event_type").alias("method"),
    )
    return market.canonicalize(raw, "funding_rates", strict=False)


@query(
    "legacy_view",
    final(bars_sql("type"), "bars", d="close", o="exchange=venue; inst_id=instrument_id; bar=bar_type; ts=t"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = bars(spark, sf, "type").select("venue", "instrument_id", "bar_type", "timestamp", "close")
    return market.legacy_view(df)


_LINE_ORDER = "l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, " \
    "l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC"
_LINE_COLS = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


@query(
    "dedup_keep_last",
    final(
        f"x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) AS rn FROM lineitem)",
        "x", d="l_quantity l_extendedprice", i="l_orderkey l_linenumber l_partkey l_suppkey",
        o="l_shipdate", where="rn = 1",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    order = [w.split()[0] for w in _LINE_ORDER.split(", ")]
    kept = market.dedup_keep_last(df, ["l_orderkey", "l_linenumber"], order)
    return kept.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_shipdate",
    )


_UPSERT = """a AS (SELECT o_orderkey AS k, o_totalprice AS price, 'old' AS side FROM orders WHERE o_orderdate < DATE '1999-01-01'),
b AS (SELECT o_orderkey AS k, o_totalprice * 2 AS price, 'new' AS side FROM orders WHERE o_orderdate >= DATE '1998-01-01'),
u AS (SELECT k, price, side FROM b UNION ALL SELECT k, price, side FROM a WHERE k NOT IN (SELECT k FROM b))"""


def _upsert_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders")
    price, day = F.col("o_totalprice"), F.col("o_orderdate")
    key = F.col("o_orderkey").alias("k")
    old = o.where(day < "1999-01-01").select(key, price.alias("price"), F.lit("old").alias("side"))
    new = o.where(day >= "1998-01-01").select(
        key, (price * 2).alias("price"), F.lit("new").alias("side")
    )
    return old, new


@query("upsert_rows", final(_UPSERT, "u", d="price", i="k", o="side"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return market.upsert(*_upsert_sides(spark, sf), ["k"])


@query(
    "upsert_partitions",
    final(
        _UPSERT, "u",
        d="price=CASE WHEN side = 'new' AND k % 5 = 0 THEN price / 4 ELSE price END", i="k; part=k % 4", o="side",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    old, new = (
        d.withColumns({"part": F.col("k") % 4, "arrival": F.lit(i)})
        for i, d in enumerate(_upsert_sides(spark, sf))
    )
    # A later, lower correction of every fifth order comes in the same batch.
    fixed = new.where("k % 5 = 0").withColumns({"price": F.col("price") / 4, "arrival": F.lit(2)})
    path = f"{shared_folder(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    for rows in (old, new.unionByName(fixed)):
        market.upsert_partitions(spark, rows, path, ["k"], ["part"], ["arrival"])
    return spark.read.parquet(path).select("k", "price", "side", "part")


@query(
    "read_market_range",
    final(
        bars_sql("user"), "bars",
        d="open; close=CASE WHEN CAST(instrument_id AS INT) % 3 = 0 THEN close / 2 ELSE close END; volume",
        o="venue; instrument_id; timestamp=t",
        where="t >= TIMESTAMP '2024-01-10' AND t < TIMESTAMP '2024-01-20'",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    path = f"{shared_folder(spark).rstrip('/')}/market-{uuid.uuid4().hex}"
    df = market.canonicalize(bars(spark, sf), "candles", strict=False)
    market.write_market(df, path, "candles")
    # A lower close of every third instrument, written later.
    third = df.where(F.col("instrument_id").cast("int") % 3 == 0)
    market.write_market(third.withColumn("close", F.col("close") / 2), path, "candles")
    got = market.read_market(
        spark, path, "candles", venue="sim", bar_type="1d",
        start=datetime(2024, 1, 10), end=datetime(2024, 1, 20),
    )
    return got.select("venue", "instrument_id", "timestamp", "open", "close", "volume")


@query(
    "compact_by_date",
    final(
        f"x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) AS rn FROM lineitem), "
        "y AS (SELECT CAST(l_shipdate AS DATE) AS date, year(l_shipdate) AS year, count(*) AS rows, sum(l_quantity) AS quantity FROM x WHERE rn = 1 GROUP BY ALL)",
        "y", d="quantity", i="year rows", o="date",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    order = [w.split()[0] for w in _LINE_ORDER.split(", ")]
    done = market.compact(
        table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", order
    )
    return done.groupBy("year", "date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity")
    )


@query(
    "write_compacted",
    final(
        f"x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) AS rn FROM lineitem)",
        "x", d="l_quantity; l_extendedprice", i="l_orderkey; l_linenumber; l_partkey; l_suppkey; year=year(l_shipdate)",
        o="date=CAST(l_shipdate AS DATE)", where="rn = 1",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    order = [w.split()[0] for w in _LINE_ORDER.split(", ")]
    path = f"{shared_folder(spark).rstrip('/')}/compacted-{uuid.uuid4().hex}"
    done = market.compact(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", order)
    market.write_compacted(done, path)
    return spark.read.parquet(path).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "year", "date"
    )


@query(
    "csv_price_klines",
    final(
        bars_sql("type"), "bars", d="open=round(open, 4); close=round(close, 4)", i="confirm=1",
        o="venue='BINANCE'; instrument_id; bar_type='1H'; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf, "type")
    raw = b.select(
        F.unix_millis(F.col("timestamp").cast("timestamp")).cast("string").alias("open_time"),
        *[F.round(c, 4).cast("string").alias(c) for c in ("open", "high", "low", "close")],
        F.col("instrument_id").alias("symbol"),
    )
    out = files.csv_price_klines(raw, F.col("symbol"))
    return out.select("venue", "instrument_id", "bar_type", "timestamp", "open", "close", "confirm")


@query(
    "split_by_utc_date",
    final(
        "x AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL)",
        "x", d="v", i="n", o="date",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = market.split_by_utc_date(table(spark, sf, "events"), "ts")
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))


@query(
    "clean_candles",
    final(
        bars_sql("user"), "bars", d="open; high; low; close=low", o="instrument_id; timestamp=t",
        where="t >= TIMESTAMP '2024-01-03' AND CAST(instrument_id AS INT) % 3 <> 0",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    # Every third instrument gets an impossible high.
    spoiled = F.col("instrument_id").cast("int") % 3 == 0
    df = bars(spark, sf).withColumn(
        "high", F.when(spoiled, F.col("low") / 2).otherwise(F.col("high"))
    )
    # The bar arrives again with its close at the low: a lower, later correction.
    later = df.withColumns({"close": F.col("low"), "arrival": F.lit(1)})
    df = df.withColumn("arrival", F.lit(0)).unionByName(later)
    clean = market.clean_candles(df, datetime(2024, 1, 3), order=["arrival"])
    return clean.select("instrument_id", "timestamp", "open", "high", "low", "close")


@query(
    "funding_history",
    final(
        "x AS (SELECT CAST(user_id AS VARCHAR) AS instrument_id, time_bucket(INTERVAL '8 hours', ts) AS t, "
        "arg_max(value, (ts, event_id)) AS realized_rate FROM events WHERE event_type = 'error' AND value > 20 GROUP BY ALL)",
        "x", d="realized_rate", o="instrument_id; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    raw = source_events(spark, sf, "error").select(
        "venue", "instrument_id", floor_time("timestamp", 480).alias("timestamp"),
        F.when(F.col("value") > 20, F.col("value")).alias("realized_rate"),
        F.col("timestamp").alias("arrived"), "event_id",
    )
    rows = market.build_funding_history(raw, order=["arrived", "event_id"])
    return rows.select("instrument_id", "timestamp", "realized_rate")


@query(
    "ratio_type_backfill",
    final(
        "x AS (SELECT coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'all_account') AS ratio_type, count(*) AS rows FROM events GROUP BY ALL)",
        "x", i="rows", o="ratio_type", where="ratio_type NOT IN ('all_account', 'top_trader_account', 'top_trader_position')",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    df = table(spark, sf, "events").select(F.when(kind != "view", kind).alias("ratio_type"))
    return market.unknown_ratio_types(df)


@query(
    "merge_missing_history",
    final(
        f"{bars_sql('user')}, cur AS (SELECT * FROM bars WHERE t >= TIMESTAMP '2024-01-15'), "
        "old AS (SELECT venue, instrument_id, t, close * 2 AS close FROM bars WHERE t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-20'), "
        "m AS (SELECT instrument_id, t, close FROM cur UNION ALL SELECT instrument_id, t, close FROM old WHERE (instrument_id, t) NOT IN (SELECT (instrument_id, t) FROM cur))",
        "m", d="close", o="instrument_id; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = market.canonicalize(bars(spark, sf).withColumn("bar_type", F.lit("1m")), "candles", False)
    df = materialize(df)
    current = df.where(F.col("timestamp") >= "2024-01-15")
    legacy = df.withColumn("close", F.col("close") * 2)
    merged = market.merge_missing_history(
        current, legacy, "candles", datetime(2024, 1, 5), datetime(2024, 1, 20)
    )
    return merged.select("instrument_id", "timestamp", "close")


# -- landed messages -----------------------------------------------------------------------
@query(
    "csv_aggregate_trades",
    final(
        "", "events", d="price=round(value, 2); size=round(value / 10, 4)",
        o="venue='BINANCE'; market_type='UM'; instrument_id='U' || user_id; "
        "aggregate_trade_id=CAST(event_id AS VARCHAR); timestamp=date_trunc('millisecond', ts); "
        "side=CASE WHEN event_id % 2 = 0 THEN 'sell' ELSE 'buy' END; buyer_is_maker=event_id % 2 = 0",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    path = f"{shared_folder(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    e = table(spark, sf, "events")
    text = e.select(
        F.col("event_id").alias("agg_trade_id"),
        F.round("value", 2).alias("price"),
        F.round(F.col("value") / 10, 4).alias("quantity"),
        F.lit(1).alias("first_trade_id"),
        F.lit(2).alias("last_trade_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("transact_time"),
        F.when(F.col("event_id") % 2 == 0, "true").otherwise("false").alias("is_buyer_maker"),
        F.concat(F.lit("U"), F.col("user_id")).alias("symbol"),
    )
    # A folder a symbol would be a file for each task and symbol: both grow with the table.
    text.write.option("header", True).csv(path)
    raw = files.read_csv_archive(spark, path, "aggregate_trades", ["symbol"])
    out = files.csv_aggregate_trades(raw, F.col("symbol"))
    return out.select(
        "venue", "market_type", "instrument_id", "aggregate_trade_id", "timestamp", "price", "size",
        "side", "buyer_is_maker",
    )


@query(
    "csv_klines",
    final(
        bars_sql("type"), "bars", d="open=round(open, 4); close=round(close, 4); volume; volume_ccy=volume",
        o="venue='BINANCE'; instrument_id; bar_type='1H'; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf, "type")
    open_time = F.unix_millis(F.col("timestamp").cast("timestamp")).cast("string")
    cols = {n: F.lit("0") for n in files.CSV_COLUMNS["candles"]}
    cols |= {n: F.round(n, 4).cast("string") for n in ("open", "high", "low", "close")}
    cols |= {"open_time": open_time, "volume": F.col("volume").cast("string")}
    raw = b.select("instrument_id", *[c.alias(n) for n, c in cols.items()])
    out = files.csv_klines(raw, F.col("instrument_id"))
    return out.select(
        "venue", "instrument_id", "bar_type", "timestamp", "open", "close", "volume", "volume_ccy"
    )


@query(
    "csv_funding",
    final(
        "", "events", d="funding_rate=round(value / 1000, 5); realized_rate=round(value / 1000, 5)",
        i="funding_interval_hours=8", where="event_type = 'error'",
        o="instrument_id=CAST(user_id AS VARCHAR); timestamp=date_trunc('millisecond', ts); method='historical'",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = source_events(spark, sf, "error")
    raw = e.select(
        "instrument_id",
        F.unix_millis(F.col("timestamp").cast("timestamp")).cast("string").alias("calc_time"),
        F.lit("8").alias("funding_interval_hours"),
        F.round(F.col("value") / 1000, 5).cast("string").alias("last_funding_rate"),
    )
    out = files.csv_funding(raw, F.col("instrument_id"))
    return out.select(
        "instrument_id", "timestamp", "funding_rate", "realized_rate", "method",
        "funding_interval_hours",
    )


@query(
    "archive_candles",
    final(
        bars_sql("type"), "bars", d="open=round(open, 4); close=round(close, 4)", i="confirm=1",
        o="venue='OKX'; instrument_id=upper(instrument_id) || '-USDT-SWAP'; instrument_type='SWAP'; bar_type='1m'; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf, "type")
    raw = b.select(
        F.lit("").alias("instId"),
        F.concat(F.lit("all-"), F.col("instrument_id"), F.lit("-USDT-SWAP-2024.csv")).alias("file"),
        F.unix_millis(F.col("timestamp").cast("timestamp")).cast("string").alias("ts"),
        F.round("open", 4).cast("string").alias("o"),
        F.lit("").alias("c"),
        F.round("close", 4).cast("string").alias("Close"),
    )
    name = F.regexp_replace("file", "^all-", "")
    out = files.archive_candles(raw, name)
    return out.select(
        "venue", "instrument_id", "instrument_type", "bar_type", "timestamp", "open", "close",
        "confirm",
    )


@query(
    "archive_funding",
    final(
        "", "events", d="funding_rate=round(value, 2); realized_rate=round(CASE WHEN event_id % 2 = 0 THEN value * 2 ELSE value END, 2)",
        o="instrument_id=CAST(user_id AS VARCHAR); timestamp=date_trunc('millisecond', ts)",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e, v = table(spark, sf, "events"), F.col("value")
    even = F.col("event_id") % 2 == 0
    raw = e.select(
        F.col("user_id").cast("string").alias("instId"),
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("fundingTime"),
        F.round(v, 2).cast("string").alias("fundingRate"),
        F.when(even, F.round(v * 2, 2).cast("string")).otherwise("").alias("realizedRate"),
    )
    out = files.archive_funding(raw)
    return out.select("instrument_id", "timestamp", "funding_rate", "realized_rate")


def _array_rows(spark: SparkSession, sf: str, *values) -> DataFrame:
    e = table(spark, sf, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    return e.select(
        F.col("user_id").cast("string").alias("instrument_id"),
        F.array(ms, *[v.cast("string") for v in values]).alias("row"),
    )


_TS = "instrument_id=CAST(user_id AS VARCHAR); timestamp=date_trunc('millisecond', ts)"

def _v():
    return F.col("value")


@query(
    "rows_to_taker",
    final("", "events", d="sell_volume=value; buy_volume=value * 2; net_buy_volume=value", o=f"{_TS}; bar_type='5m'"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.rows_to_taker(_array_rows(spark, sf, _v(), _v() * 2)).drop("venue")


@query(
    "rows_to_open_interest",
    final("", "events", d="open_interest_usd=value; volume_usd=value * 3", o=f"{_TS}; bar_type='5m'"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.rows_to_open_interest(_array_rows(spark, sf, _v(), _v() * 3)).drop("venue")


@query("rows_to_ratio", final("", "events", d="long_short_ratio=value", o=_TS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.rows_to_ratio(_array_rows(spark, sf, _v())).drop("venue", "bar_type")


@query(
    "rows_to_candles",
    final(
        "", "events", d="open=value; high=value * 2; low=value / 2; close=value + 1; volume=value; "
        "volume_ccy=value * 4; volume_quote=value * 5", i="confirm=event_id % 2", o=_TS,
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _array_rows(
        spark, sf, _v(), _v() * 2, _v() / 2, _v() + 1, _v(), _v() * 4, _v() * 5, F.col("event_id") % 2
    )
    return payloads.rows_to_candles(rows).drop("venue", "bar_type")


@query(
    "rows_to_candles_short",
    final(
        "", "events", d="open=value; high=value * 2; low=value / 2; close=value + 1; volume=value",
        i="confirm=1", o=f"{_TS}; volume_ccy=CAST(NULL AS DOUBLE); volume_quote=CAST(NULL AS DOUBLE)",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _array_rows(spark, sf, _v(), _v() * 2, _v() / 2, _v() + 1, _v())
    return payloads.rows_to_candles(rows, layout="plain").drop("venue", "bar_type")


@query(
    "rows_to_funding",
    final("", "events", d="funding_rate=value; realized_rate=value / 2", o=f"{_TS}; method=event_type"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    raw = e.select(
        F.col("user_id").cast("string").alias("instId"),
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("fundingTime"),
        _v().cast("string").alias("fundingRate"),
        (_v() / 2).cast("string").alias("realizedRate"),
        F.col("event_type").alias("method"),
        F.lit("").alias("formulaType"),
    )
    return payloads.rows_to_funding(raw).drop("venue", "formula_type")


@query(
    "build_basis",
    final(
        "m AS (SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS t, avg(value) AS p FROM events WHERE event_type = 'click' GROUP BY ALL), "
        "x AS (SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS t, avg(value) AS p FROM events WHERE event_type = 'view' GROUP BY ALL), "
        "j AS (SELECT user_id, t, m.p AS mark_price, x.p AS index_price FROM m JOIN x USING (user_id, t))",
        "j", d="mark_price; index_price; basis=mark_price - index_price; basis_rate=CASE WHEN index_price <> 0 THEN (mark_price - index_price) / index_price END",
        o="instrument_id=CAST(user_id AS VARCHAR); timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    def price(kind: str) -> DataFrame:
        e = source_events(spark, sf, kind).withColumn("bar_type", F.lit("1d"))
        slot = floor_time("timestamp", 1440).alias("timestamp")
        return e.groupBy(*K2, "bar_type", slot).agg(F.avg("value").alias("close"))

    return payloads.build_basis(price("click"), price("view")).drop("venue", "bar_type")


@query(
    "build_liquidations",
    final(
        "x AS (SELECT user_id, ts, event_id, value, CAST(epoch_ms(date_trunc('millisecond', ts)) AS VARCHAR) || '|sell|long|' || CAST(event_id AS VARCHAR) || '|2|' AS text FROM events WHERE event_type = 'purchase')",
        "x", d="bankruptcy_price=event_id; size=2", o="instrument_id=CAST(user_id AS VARCHAR); "
        "timestamp=date_trunc('millisecond', ts); liquidation_id=substring(sha256(text), 1, 24); "
        "side='sell'; position_side='long'; bankruptcy_loss=CAST(NULL AS DOUBLE)",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = source_events(spark, sf, "purchase")
    detail = F.struct(
        F.unix_millis(F.col("timestamp").cast("timestamp")).cast("string").alias("ts"),
        F.lit("sell").alias("side"), F.lit("long").alias("posSide"),
        F.col("event_id").cast("string").alias("bkPx"), F.lit("2").alias("sz"),
    )
    msg = F.to_json(F.struct(F.col("instrument_id").alias("instId"), F.array(detail).alias("details")))
    return payloads.build_liquidations(e.select(msg.alias("payload"))).drop("venue")


@query(
    "build_market_cap",
    final(
        "x AS (SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS t, max(value) FILTER (WHERE event_type = 'click') AS a, "
        "max(value) FILTER (WHERE event_type = 'view') AS b, max(value) FILTER (WHERE event_type = 'error') AS c FROM events GROUP BY ALL)",
        "x", d="market_cap_usd=a; price_usd=b; volume_24h_usd=c", where="a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL",
        o="instrument_id=CAST(user_id AS VARCHAR); timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    def series(kind: str) -> DataFrame:
        e = source_events(spark, sf, kind)
        slot = floor_time("timestamp", 1440).alias("timestamp")
        return e.groupBy("instrument_id", slot).agg(F.max("value").alias("value"))

    out = payloads.build_market_cap(series("click"), series("view"), series("error"))
    return out.drop("venue", "bar_type")


@query(
    "instrument_snapshot",
    final(
        "v AS (SELECT user_id, max(value) AS hi, min(value) AS lo, avg(value) AS mid, sum(value) AS vol FROM events GROUP BY user_id), "
        "j AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'USDT' ELSE 'BTC' END AS settle, lo, hi, mid, vol FROM v)",
        "j", d="last_price=mid; bid_price=lo; ask_price=hi; spread_bps=CASE WHEN hi + lo > 0 THEN (hi - lo) / ((hi + lo) / 2) * 10000 END; "
        "volume_currency_24h=vol; volume_usd_24h=CASE WHEN settle = 'USDT' THEN vol * mid END; open_interest_usd=CASE WHEN user_id % 3 = 0 THEN vol * 2 END",
        o="instrument_id='C' || user_id || '-USD-SWAP'; base_currency='C' || user_id; quote_currency='USD'; settle_currency=settle",
        digits=4,
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "events").groupBy("user_id").agg(
        F.max("value").alias("hi"), F.min("value").alias("lo"), F.avg("value").alias("mid"),
        F.sum("value").alias("vol"),
    )
    v = materialize(v.withColumn("instId", F.concat(F.lit("C"), F.col("user_id"), F.lit("-USD-SWAP"))))
    blank = F.lit("")
    names = ("uly baseCcy quoteCcy instType instFamily ctType state ctValCcy ctVal tickSz lotSz minSz "
             "listTime expTime").split()
    instruments = v.select(
        "instId", F.when(F.col("user_id") % 2 == 0, "USDT").otherwise("BTC").alias("settleCcy"),
        *[blank.alias(n) for n in names],
    )
    text = {"last": "mid", "bidPx": "lo", "askPx": "hi", "vol24h": "vol", "volCcy24h": "vol"}
    tickers = v.select("instId", *[F.col(c).cast("string").alias(n) for n, c in text.items()])
    oi = v.where(F.col("user_id") % 3 == 0).select(
        "instId", (F.col("vol") * 2).cast("string").alias("oiUsd")
    )
    at = F.lit("2024-01-31").cast("timestamp_ntz")
    snap = payloads.build_instrument_snapshot(instruments, tickers, oi, at)
    out = snap.select(
        "instrument_id", "base_currency", "quote_currency", "settle_currency", "last_price",
        "bid_price", "ask_price", "spread_bps", "volume_currency_24h", "volume_usd_24h",
        "open_interest_usd",
    )
    return out.select(
        *[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes]
    )


@query(
    "account_fills",
    final(
        "", "events", d="fill_price=round(value, 2); fill_size=event_id",
        o="venue='OKX'; account_alias='main'; instrument_id=CAST(user_id AS VARCHAR); trade_id=CAST(event_id AS VARCHAR); "
        "fill_time=date_trunc('millisecond', ts); fee=CAST(NULL AS DOUBLE)",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    raw = e.select(
        F.col("event_id").cast("string").alias("tradeId"),
        F.col("user_id").cast("string").alias("instId"),
        F.round("value", 2).cast("string").alias("fillPx"),
        F.col("event_id").cast("string").alias("fillSz"),
        F.lit("").alias("fee"),
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("fillTime"),
    )
    out = payloads.account_rows(raw, "private_fills", "main")
    number = ("fill_price", "fill_size", "fee")
    return out.select(
        "venue", "account_alias", "instrument_id", "trade_id", "fill_time",
        *[F.col(c).cast("double").alias(c) for c in number],
    )


@query(
    "account_orders",
    final(
        "", "orders", d="price=round(o_totalprice, 2)",
        o="instrument_id=CAST(o_custkey AS VARCHAR); order_id=CAST(o_orderkey AS VARCHAR); state=o_orderstatus; created_at=o_orderdate; updated_at=o_orderdate",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("ordId"),
        F.col("o_custkey").cast("string").alias("instId"),
        F.col("o_orderstatus").alias("state"),
        F.round("o_totalprice", 2).cast("string").alias("px"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string").alias("cTime"),
    )
    out = payloads.account_rows(raw, "private_orders", "main")
    return out.select(
        "instrument_id", "order_id", "state", F.col("price").cast("double").alias("price"),
        "created_at", "updated_at",
    )


@query(
    "account_bills",
    final(
        "", "orders", d="balance_change=round(o_totalprice, 2); balance=round(o_totalprice * 2, 2)",
        o="instrument_id=CAST(o_custkey AS VARCHAR); bill_id=CAST(o_orderkey AS VARCHAR); currency='USDT'; timestamp=o_orderdate",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("billId"),
        F.col("o_custkey").cast("string").alias("instId"),
        F.lit("USDT").alias("ccy"),
        F.round("o_totalprice", 2).cast("string").alias("balChg"),
        F.round(F.col("o_totalprice") * 2, 2).cast("string").alias("bal"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string").alias("ts"),
    )
    out = payloads.account_rows(raw, "private_bills", "main")
    return out.select(
        "instrument_id", "bill_id", "currency", "timestamp",
        F.col("balance_change").cast("double").alias("balance_change"),
        F.col("balance").cast("double").alias("balance"),
    )


@query(
    "report_csv_sink",
    final(
        "x AS (SELECT event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY ALL)",
        "x", d="v", i="n", o="event_type",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    path = f"{shared_folder(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    df = table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v")
    )
    market.write_report(df, path)
    return spark.read.schema("event_type string, n long, v double").option("header", True).csv(path)


# -- quality -------------------------------------------------------------------------------
_ISLANDS = f"""{bars_sql('user')},
g AS (SELECT *, CASE WHEN {lag('t')} = t - INTERVAL 1 DAY THEN 0 ELSE 1 END AS n FROM bars),
h AS (SELECT *, sum(n) OVER (PARTITION BY instrument_id ORDER BY t) AS island FROM g),
cov AS (SELECT venue, instrument_id, island, min(t) AS a, max(t) + INTERVAL 1 DAY AS b, count(*) AS bars FROM h GROUP BY ALL)"""


@query(
    "coverage_intervals",
    final(_ISLANDS, "cov", i="bars", o="venue; instrument_id; start_time=a; end_time=b"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.coverage_intervals(bars(spark, sf), 1440)


@query(
    "missing_intervals",
    final(
        f"{_ISLANDS}, lohi AS (SELECT TIMESTAMP '2024-01-05' AS lo, TIMESTAMP '2024-01-25' AS hi), "
        "days AS (SELECT DISTINCT venue, instrument_id, unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-24', INTERVAL 1 DAY)) AS t FROM cov), "
        "holes AS (SELECT d.* FROM days d ANTI JOIN bars b ON d.instrument_id = b.instrument_id AND d.t = b.t), "
        f"hg AS (SELECT *, CASE WHEN {lag('t')} = t - INTERVAL 1 DAY THEN 0 ELSE 1 END AS n FROM holes), "
        "hh AS (SELECT *, sum(n) OVER (PARTITION BY instrument_id ORDER BY t) AS k FROM hg), "
        "m AS (SELECT venue, instrument_id, k, min(t) AS a, max(t) + INTERVAL 1 DAY AS b FROM hh GROUP BY ALL)",
        "m", o="venue; instrument_id; start_time=a; end_time=b",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    covered = materialize(quality.coverage_intervals(bars(spark, sf), 1440))
    return quality.missing_intervals(covered, datetime(2024, 1, 5), datetime(2024, 1, 25))


@query(
    "validate_periodic",
    final(
        f"{bars_sql('user')}, st AS (SELECT venue, instrument_id, count(*) AS n, min(t) AS a, max(t) AS b FROM bars "
        "WHERE t >= TIMESTAMP '2024-01-02' AND t < TIMESTAMP '2024-01-30' GROUP BY ALL)",
        "st", i="rows=n; slots=n; off_grid=0",
        o="venue; instrument_id; first_time=a; last_time=b; violations=concat_ws('|', CASE WHEN n <> 28 THEN 'wrong_count' END, "
        "CASE WHEN a <> TIMESTAMP '2024-01-02' THEN 'wrong_start' END, CASE WHEN b <> TIMESTAMP '2024-01-29' THEN 'wrong_end' END, "
        "CASE WHEN n <> 28 THEN 'broken_step' END)",
        where="n <> 28 OR a <> TIMESTAMP '2024-01-02' OR b <> TIMESTAMP '2024-01-29'",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.validate_periodic(
        bars(spark, sf), datetime(2024, 1, 2), datetime(2024, 1, 30), 1440
    )


@query(
    "file_stats",
    final(
        "x AS (SELECT event_type, CAST(ts AS DATE) AS date, min(ts) AS a, max(ts) AS b, count(*) AS n FROM events GROUP BY ALL)",
        "x", i="rows=n", o="event_type; date; min_time=a; max_time=b",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    return quality.file_stats(df, ["event_type", "date"], "ts")


@query(
    "overlap_conflicts",
    final(
        "", "orders", d="o_totalprice_left=o_totalprice; o_totalprice_right=CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END",
        i="o_orderkey", o="o_orderstatus_left=o_orderstatus; o_orderstatus_right=o_orderstatus",
        where="o_orderkey % 10 = 0 OR o_orderkey % 11 = 0",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    b = a.withColumn("o_totalprice", F.when(k % 10 == 0, p + 1).when(k % 11 != 0, p))
    return quality.overlap_conflicts(a, b, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query(
    "boundary_continuity",
    final(
        f"{bars_sql('user')}, p AS (SELECT venue, instrument_id, max(t) AS a FROM bars WHERE t < TIMESTAMP '2024-01-16' GROUP BY ALL), "
        "c AS (SELECT venue, instrument_id, min(t) AS b FROM bars WHERE t >= TIMESTAMP '2024-01-16' GROUP BY ALL), "
        "j AS (SELECT venue, instrument_id, a, b, date_diff('minute', a, b) AS g FROM p JOIN c USING (venue, instrument_id))",
        "j", i="gap_minutes=g", o="venue; instrument_id; previous_end=a; current_start=b; is_continuous=g = 1440",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = bars(spark, sf)
    early = F.col("timestamp") < "2024-01-16"
    return quality.boundary_continuity(df.where(early), df.where(~early), 1440)


_LIFE = (
    "life AS (SELECT 'SIM' AS venue, CAST(user_id AS VARCHAR) AS instrument_id, "
    "TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (user_id % 5) AS vf, "
    "CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-01-20' + INTERVAL 1 DAY * (user_id % 7) END AS vt "
    "FROM (SELECT DISTINCT user_id FROM events))"
)


def _lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "events").select("user_id").distinct()
    base = F.lit("2024-01-01").cast("timestamp_ntz")
    days = F.make_dt_interval(days=(F.col("user_id") % 5).cast("int"))
    last = F.lit("2024-01-20").cast("timestamp_ntz") + F.make_dt_interval(
        days=(F.col("user_id") % 7).cast("int")
    )
    return u.select(
        F.lit("SIM").alias("venue"), F.col("user_id").cast("string").alias("instrument_id"),
        (base + days).alias("valid_from"),
        F.when(F.col("user_id") % 3 == 0, last).alias("valid_to"),
    )


@query(
    "window_violations",
    final(
        f"{bars_sql('user')}, {_LIFE}, s AS (SELECT venue, instrument_id, min(t) AS a, max(t) AS b FROM bars GROUP BY ALL), "
        "j AS (SELECT s.*, vf, vt, concat_ws('|', CASE WHEN a < vf THEN 'BEFORE_LISTING' END, CASE WHEN b >= vt THEN 'AFTER_EXPIRY' END) AS v FROM s LEFT JOIN life USING (venue, instrument_id))",
        "j", o="venue; instrument_id; first_time=a; last_time=b; valid_from=vf; valid_to=vt; violation=v", where="v <> ''",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.window_violations(bars(spark, sf), _lifecycle(spark, sf))


@query(
    "duplicate_report",
    final(
        "k AS (SELECT l_returnflag AS f, l_orderkey, l_linenumber, l_partkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL), "
        "p AS (SELECT f, l_orderkey, l_linenumber, sum(n) AS n, count(*) AS v FROM k GROUP BY ALL), "
        "r AS (SELECT f, sum(n) AS input_rows, count(*) AS unique_keys, sum(n - v) AS duplicate_rows, "
        "sum(CASE WHEN v > 1 THEN 1 ELSE 0 END) AS conflicting_keys, sum(n - v) / sum(n) AS duplicate_ratio FROM p GROUP BY f)",
        "r", d="duplicate_ratio", i="input_rows unique_keys duplicate_rows conflicting_keys", o="l_returnflag=f",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_report(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_orderkey", "l_linenumber"],
        ["l_partkey", "l_quantity"], ["l_returnflag"],
    )


@query(
    "source_date_violations",
    final(
        "x AS (SELECT event_id, ts, CAST(ts AS DATE) AS d FROM events)",
        "x", i="event_id", o="timestamp=ts", where="ts < d - INTERVAL 8 HOUR OR ts >= d + INTERVAL 16 HOUR",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("timestamp"), F.to_date("ts").alias("source_date")
    )
    return quality.source_date_violations(e).select("event_id", "timestamp")


@query(
    "futures_expiry_violations",
    final(
        "x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '1998-06-30' AS e, o_custkey % 3 AS k FROM orders)",
        "x", i="o_orderkey; days_to_expiry=date_diff('day', d, e)", o="expiration_date=e",
        where="k < 2 AND (date_diff('day', d, e) < 0 OR date_diff('day', d, e) > 730)",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("o_custkey") % 3
    name = (
        F.when(kind == 0, "BTC-USD-19980630").when(kind == 1, "BTC-USD-19980630#OLD#1").otherwise("BTC-USD_XPERP-980630")
    )
    o = table(spark, sf, "orders").select(
        "o_orderkey", name.alias("instrument_id"), F.to_date("o_orderdate").alias("source_date")
    )
    return quality.futures_expiry_violations(o).select(
        "o_orderkey", "expiration_date", "days_to_expiry"
    )


_STATS = "st AS (SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS rows FROM events GROUP BY ALL)"


@query(
    "coverage_summary",
    final(
        f"{_STATS}, c AS (SELECT event_type, min(date) AS a, max(date) AS b, count(*) AS p, sum(rows) AS n FROM st WHERE rows >= 60 GROUP BY ALL)",
        "c", i="partitions=p; rows=n", o="event_type; min_date=a; max_date=b",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    stats = quality.file_stats(df, ["event_type", "date"], "ts")
    return quality.coverage_summary(stats, ["event_type"], F.col("rows") >= 60)


@query(
    "availability",
    final(
        "d AS (SELECT event_type, CAST(ts AS DATE) AS date, min(ts) AS a, count(DISTINCT time_bucket(INTERVAL '4 hours', ts)) AS n FROM events GROUP BY ALL), "
        "r AS (SELECT event_type, min(a) AS a, min(CASE WHEN n = 6 THEN date END) AS f FROM d GROUP BY ALL)",
        "r", o="event_type; first_event_time=a; first_complete_date=f",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.availability(table(spark, sf, "events"), ["event_type"], 240, "ts")


# -- grids and joins -----------------------------------------------------------------------
_OHLCV = "open high low close volume volume_quote"


@query("bars_from_ticks", final(bars_sql("user"), "bars", d=_OHLCV, o="venue; instrument_id; bar_type; timestamp=t"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf)


_DAILY = (
    "dly AS (SELECT venue, instrument_id, time_bucket(INTERVAL '1 day', t) AS d, first(open ORDER BY t) AS open, max(high) AS high, "
    "min(low) AS low, last(close ORDER BY t) AS close, sum(volume) AS volume, sum(volume_quote) AS volume_quote, count(*) AS n FROM bars GROUP BY ALL)"
)


@query(
    "resample_candles",
    final(f"{bars_sql('hour')}, {_DAILY}", "dly", d=_OHLCV, i="confirm=1", o="venue; instrument_id; timestamp=d"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return grid.resample_candles(bars(spark, sf, "hour").withColumn("confirm", F.lit(1)), 1440)


@query(
    "resample_complete",
    final(
        f"{bars_sql('hour')}, {_DAILY}", "dly", d="open high low close volume", i="source_bars=n",
        o="venue; instrument_id; timestamp=d", where="n = 22",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return grid.resample_complete(bars(spark, sf, "hour"), 1440, 22)


@query(
    "resample_ohlcv",
    final(f"{bars_sql('hour')}, {_DAILY}", "dly", d="open high low close volume", o="venue; instrument_id; timestamp=d"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return grid.resample_ohlcv(bars(spark, sf, "hour"), 1440)


@query(
    "resample_taker",
    final(
        "x AS (SELECT CAST(user_id AS VARCHAR) AS i, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS t, sum(value) AS b, sum(value / 2) AS s, sum(value / 2) AS n FROM events GROUP BY ALL)",
        "x", d="buy_volume=b; sell_volume=s; net_buy_volume=n", o="instrument_id=i; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("instrument_id"), F.col("ts").alias("timestamp"),
        F.col("value").alias("buy_volume"), (F.col("value") / 2).alias("sell_volume"),
        (F.col("value") / 2).alias("net_buy_volume"),
    )
    return grid.resample_taker(e, 7 * 1440, ["instrument_id"])


@query(
    "resample_last",
    final(
        "x AS (SELECT CAST(user_id AS VARCHAR) AS i, time_bucket(INTERVAL '1 day', ts) AS t, ts, value, CASE WHEN event_type <> 'view' THEN value END AS v FROM events), "
        "y AS (SELECT i, t, arg_max(value, ts) AS value, last(v ORDER BY ts) AS masked FROM x GROUP BY ALL)",
        "y", d="value masked", o="instrument_id=i; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("instrument_id"), F.col("ts").alias("timestamp"), v,
        F.when(F.col("event_type") != "view", v).alias("masked"),
    )
    return grid.resample_last(e, 1440, ["value", "masked"], ["instrument_id"])


@query(
    "asof_backward_tolerance",
    final(
        f"{bars_sql('user')}, f AS (SELECT CAST(user_id AS VARCHAR) AS instrument_id, ts, value FROM events WHERE event_type = 'signup'), "
        "j AS (SELECT b.*, CASE WHEN f.ts >= b.t - INTERVAL 2 DAY THEN f.value END AS value FROM bars b ASOF LEFT JOIN f ON b.instrument_id = f.instrument_id AND b.t >= f.ts)",
        "j", d="close value", o="instrument_id; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    right = source_events(spark, sf, "signup")
    # Short chunks, so that carried rows cross chunk edges here too.
    got = grid.asof_backward(
        bars(spark, sf), right, K2, ["value"], tolerance_minutes=2 * 1440, chunk_minutes=5 * 1440
    )
    return got.select("instrument_id", "timestamp", "close", "value")


@query(
    "last_per_slot",
    final(
        "x AS (SELECT CAST(user_id AS VARCHAR) AS i, CASE WHEN time_bucket(INTERVAL '1 day', ts) = ts THEN ts ELSE time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY END AS t, arg_max(value, ts) AS value FROM events GROUP BY ALL)",
        "x", d="value", o="instrument_id=i; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("instrument_id"), F.col("ts").alias("timestamp"), "value"
    )
    return grid.last_per_slot(e, 1440, ["instrument_id"], ["value"])


@query(
    "semi_filter",
    final("", "orders", d="o_totalprice", i="o_orderkey", where="o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return grid.semi_filter(o, c, ["c_custkey"]).select("o_orderkey", "o_totalprice")


@query(
    "missing_from",
    final("", "customer", i="c_custkey", where="c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01')"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where(F.col("o_orderdate") >= "2001-01-01")
    o = o.select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey")
    return grid.missing_from(c, o, ["c_custkey"])


@query(
    "left_attach",
    final(
        "n AS (SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3)",
        "n", i="c_custkey", o="n_name",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").where("n_regionkey < 3").withColumnRenamed("n_nationkey", "c_nationkey")
    c = table(spark, sf, "customer")
    return grid.left_attach(c, n.select("c_nationkey", "n_name"), ["c_nationkey"]).select(
        "c_custkey", "n_name"
    )


@query(
    "boundaries_inside",
    final(
        "x AS (SELECT event_id, ts, ts + INTERVAL 1 HOUR * CAST(floor(value) AS BIGINT) AS e FROM events), "
        "b AS (SELECT event_id, unnest(generate_series(date_trunc('day', ts) + INTERVAL 1 DAY, date_trunc('day', e), INTERVAL 1 DAY)) AS boundary FROM x)",
        "b", i="event_id", o="boundary",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    hours = F.make_dt_interval(hours=F.floor("value").cast("int"))
    e = table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("timestamp"), (F.col("ts") + hours).alias("exit_time")
    )
    return grid.boundaries_inside(e).select("event_id", "boundary")


@query(
    "common_timeline",
    final(
        f"{bars_sql('type')}, n AS (SELECT count(DISTINCT instrument_id) AS k FROM bars), c AS (SELECT t FROM bars GROUP BY t HAVING count(DISTINCT instrument_id) = (SELECT k FROM n))",
        "bars", d="close", o="instrument_id; timestamp=t", where="t IN (SELECT t FROM c)",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = grid.common_timeline(bars(spark, sf, "type"), "instrument_id", ["timestamp"])
    return df.select("instrument_id", "timestamp", "close")


@query(
    "shifted_join",
    final(
        f"{bars_sql('user')}, p AS (SELECT b.instrument_id, b.t, p.p FROM bars b, (SELECT unnest([1, 2, 3]) AS p) p), "
        "j AS (SELECT p.instrument_id, p.t, p.p, b.close FROM p JOIN bars b ON b.instrument_id = p.instrument_id AND b.t = p.t + INTERVAL 1 DAY * (p.p - 1))",
        "j", d="future_close=close", i="forward_period=p", o="instrument_id; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = bars(spark, sf)
    left = df.select(*K2, "timestamp")
    right = df.select(*K2, "timestamp", F.col("close").alias("future_close"))
    return grid.shifted_join(left, right, 3, 1440).drop("venue")


@query(
    "dense_grid",
    final(
        f"{bars_sql('user')}, g AS (SELECT instrument_id, unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS t FROM bars GROUP BY instrument_id), "
        "j AS (SELECT g.instrument_id, g.t, b.close FROM g LEFT JOIN bars b USING (instrument_id, t)), "
        "f AS (SELECT instrument_id, t, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS close FROM j)",
        "f", d="close", o="instrument_id; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return grid.dense_grid(bars(spark, sf), ["instrument_id"], 1440, ["close"])


@query(
    "floor_time_grid",
    final(
        "", "events", i="event_id",
        o="m15=time_bucket(INTERVAL '15 minutes', ts); h4=time_bucket(INTERVAL '4 hours', ts); month=date_trunc('month', ts)",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.functions.scalars import month_start

    return table(spark, sf, "events").select(
        "event_id", floor_time("ts", 15).alias("m15"), floor_time("ts", 240).alias("h4"),
        month_start("ts").alias("month"),
    )


@query(
    "union_frames",
    final(
        "u AS (SELECT user_id, value AS a, NULL AS b FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, NULL, value FROM events WHERE event_type = 'view'), "
        "r AS (SELECT user_id, count(a) AS a, count(b) AS b FROM u GROUP BY user_id)",
        "r", i="user_id a b",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    a = e.where("event_type = 'click'").select("user_id", F.col("value").alias("a"))
    b = e.where("event_type = 'view'").select("user_id", F.col("value").alias("b"))
    return grid.union_all(a, b).groupBy("user_id").agg(F.count("a").alias("a"), F.count("b").alias("b"))


@query(
    "json_props_by_type",
    final(
        "x AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), "
        "y AS (SELECT event_type, sum(k) AS total, count(DISTINCT k) AS kinds FROM x GROUP BY ALL)",
        "y", i="total kinds", o="event_type",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    e = table(spark, sf, "events").select("event_type", k.alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count_distinct("k").alias("kinds"))


