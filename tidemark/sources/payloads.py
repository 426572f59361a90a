"""Landed API messages (JSON or string arrays) to canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.sources.schemas import TABLES


def _at(row: Column, i: int) -> Column:
    return F.try_element_at(row, F.lit(i + 1))


def _num(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("double")


def _ms(c: Column) -> Column:
    return F.timestamp_millis(F.nullif(c, F.lit("")).try_cast("long")).cast("timestamp_ntz")


def _bars(df: DataFrame, row: Column, venue: str, bar_type: str) -> list[Column]:
    return [
        F.lit(venue).alias("venue"),
        F.col("instrument_id"),
        F.lit(bar_type).alias("bar_type"),
        _ms(_at(row, 0)).alias("timestamp"),
    ]


def rows_to_candles(df: DataFrame, row: str = "row", bar_type: str = "1m", layout: str = "okx"):
    """``[ts, o, h, l, c, vol, volCcy, volQuote, confirm]``; the short layout stops at vol."""
    r = F.col(row)
    full = layout == "okx"
    tail = [
        _num(_at(r, 5)).alias("volume"),
        (_num(_at(r, 6)) if full else F.lit(None).cast("double")).alias("volume_ccy"),
        (_num(_at(r, 7)) if full else F.lit(None).cast("double")).alias("volume_quote"),
        (F.coalesce(_at(r, 8), F.lit("1")) if full else F.lit("1")).try_cast("byte").alias("confirm"),
    ]
    prices = [_num(_at(r, i + 1)).alias(n) for i, n in enumerate(("open", "high", "low", "close"))]
    return df.where(F.size(r) >= 6).select(*_bars(df, r, "OKX", bar_type), *prices, *tail)


def rows_to_prices(df: DataFrame, row: str = "row", bar_type: str = "1m") -> DataFrame:
    """Mark or index candles: ``[ts, o, h, l, c, confirm]``."""
    r = F.col(row)
    prices = [_num(_at(r, i + 1)).alias(n) for i, n in enumerate(("open", "high", "low", "close"))]
    done = F.coalesce(_at(r, 5), F.lit("1")).try_cast("byte").alias("confirm")
    return df.where(F.size(r) >= 5).select(*_bars(df, r, "OKX", bar_type), *prices, done)


def rows_to_open_interest(df: DataFrame, row: str = "row", bar_type: str = "5m") -> DataFrame:
    r = F.col(row)
    return df.where(F.size(r) >= 3).select(
        *_bars(df, r, "OKX", bar_type),
        _num(_at(r, 1)).alias("open_interest_usd"),
        _num(_at(r, 2)).alias("volume_usd"),
    )


def rows_to_ratio(df: DataFrame, row: str = "row", bar_type: str = "5m") -> DataFrame:
    r = F.col(row)
    return df.where(F.size(r) >= 2).select(
        *_bars(df, r, "OKX", bar_type), _num(_at(r, 1)).alias("long_short_ratio")
    )


def rows_to_taker(df: DataFrame, row: str = "row", bar_type: str = "5m") -> DataFrame:
    """The message order is sell then buy."""
    r = F.col(row)
    sell, buy = _num(_at(r, 1)), _num(_at(r, 2))
    return df.where(F.size(r) >= 3).select(
        *_bars(df, r, "OKX", bar_type),
        buy.alias("buy_volume"),
        sell.alias("sell_volume"),
        (buy - sell).alias("net_buy_volume"),
    )


def rows_to_funding(df: DataFrame) -> DataFrame:
    """Funding history messages with text fields."""
    return df.select(
        F.lit("OKX").alias("venue"),
        F.col("instId").alias("instrument_id"),
        _ms(F.col("fundingTime")).alias("timestamp"),
        _num(F.col("fundingRate")).alias("funding_rate"),
        _num(F.col("realizedRate")).alias("realized_rate"),
        F.col("method"),
        F.col("formulaType").alias("formula_type"),
    )


def build_basis(mark: DataFrame, index: DataFrame) -> DataFrame:
    """Mark less index close per instrument and minute, absolute and relative."""
    keys = ["venue", "instrument_id", "bar_type", "timestamp"]
    m = mark.select(*keys, F.col("close").alias("mark_price"))
    i = index.select(*keys, F.col("close").alias("index_price"))
    basis = F.col("mark_price") - F.col("index_price")
    rate = F.when(F.col("index_price") != 0, ratio(basis, "index_price"))
    return m.join(i, keys).withColumns({"basis": basis, "basis_rate": rate})


_DETAIL = ["ts", "side", "posSide", "bkPx", "sz", "bkLoss"]
LIQUIDATION_JSON = (
    "instId string, details array<struct<" + ", ".join(f"{f}: string" for f in _DETAIL) + ">>"
)


def liquidation_id(*parts: Column) -> Column:
    """Stable id: hash of the joined text fields, missing ones as empty text."""
    text = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, 24)


def build_liquidations(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per detail of a JSON message ``{instId, details: [...]}``."""
    msg = df.select(F.from_json(payload, LIQUIDATION_JSON).alias("m"))
    rows = msg.select(F.col("m.instId").alias("instrument_id"), F.explode("m.details").alias("d"))
    rows = rows.where(F.coalesce(F.col("d.ts"), F.lit("")) != "")
    d = {f: F.col(f"d.{f}") for f in _DETAIL}
    return rows.select(
        F.lit("OKX").alias("venue"),
        "instrument_id",
        _ms(d["ts"]).alias("timestamp"),
        liquidation_id(*d.values()).alias("liquidation_id"),
        F.nullif(d["side"], F.lit("")).alias("side"),
        F.nullif(d["posSide"], F.lit("")).alias("position_side"),
        _num(d["bkPx"]).alias("bankruptcy_price"),
        _num(d["sz"]).alias("size"),
        _num(d["bkLoss"]).alias("bankruptcy_loss"),
    )


def build_market_cap(caps: DataFrame, prices: DataFrame, volumes: DataFrame) -> DataFrame:
    """Three (instrument, time, value) series joined where all are present."""
    on = ["instrument_id", "timestamp"]
    out = caps.where(F.col("value").isNotNull()).select(*on, F.col("value").alias("market_cap_usd"))
    for frame, name in ((prices, "price_usd"), (volumes, "volume_24h_usd")):
        out = out.join(
            frame.where(F.col("value").isNotNull()).select(*on, F.col("value").alias(name)), on
        )
    return out.select(
        F.lit("GLOBAL").alias("venue"), "instrument_id", F.lit("1d").alias("bar_type"), "timestamp",
        "market_cap_usd", "price_usd", "volume_24h_usd",
    )


# Settlement currencies whose 24h currency volume converts with the last price.
USD_SETTLED = ["USD", "USDT", "USDC"]


def build_instrument_snapshot(
    instruments: DataFrame, tickers: DataFrame, interest: DataFrame, captured_at: Column
) -> DataFrame:
    """Join three endpoint listings by instrument into one snapshot."""
    base = instruments.where(F.coalesce(F.col("instId"), F.lit("")) != "")
    df = base.join(
        tickers.select("instId", "last", "bidPx", "askPx", "vol24h", "volCcy24h"), "instId", "left"
    ).join(interest.select("instId", "oiUsd"), "instId", "left")
    part = F.split(F.coalesce(F.nullif(F.col("uly"), F.lit("")), F.col("instId")), "-")
    ccy = {
        "base_currency": F.coalesce(F.nullif(F.col("baseCcy"), F.lit("")), F.try_element_at(part, F.lit(1))),
        "quote_currency": F.coalesce(F.nullif(F.col("quoteCcy"), F.lit("")), F.try_element_at(part, F.lit(2))),
    }
    bid, ask, last = _num(F.col("bidPx")), _num(F.col("askPx")), _num(F.col("last"))
    mid = (bid + ask) / 2
    settle = F.upper(F.coalesce(F.nullif(F.col("settleCcy"), F.lit("")), ccy["quote_currency"]))
    vol = _num(F.col("volCcy24h"))
    text = {
        "instrument_type": "instType", "instrument_family": "instFamily", "contract_type": "ctType",
        "state": "state", "contract_value_currency": "ctValCcy",
    }
    number = {"contract_value": "ctVal", "tick_size": "tickSz", "lot_size": "lotSz",
              "min_size": "minSz"}
    out = {
        "venue": F.lit("OKX"),
        "instrument_id": F.col("instId"),
        "timestamp": captured_at,
        **{k: F.upper(v) for k, v in ccy.items()},
        "settle_currency": settle,
        **{k: F.coalesce(F.col(v), F.lit("")) for k, v in text.items()},
        **{k: _num(F.col(v)) for k, v in number.items()},
        "list_time": _ms(F.col("listTime")),
        "expiration_time": _ms(F.col("expTime")),
        "last_price": last,
        "bid_price": bid,
        "ask_price": ask,
        "spread_bps": F.when(mid > 0, (ask - bid) / mid * 10_000),
        "volume_24h": _num(F.col("vol24h")),
        "volume_currency_24h": vol,
        "volume_usd_24h": F.when(settle.isin(USD_SETTLED), vol * last),
        "open_interest_usd": _num(F.col("oiUsd")),
    }
    schema = TABLES["instrument_snapshots"]
    return df.select(*[out[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


# Message field of each account-table column.
ACCOUNT_FIELDS = {
    "private_orders": {
        "instrument_type": "instType", "instrument_id": "instId", "order_id": "ordId",
        "client_order_id": "clOrdId", "state": "state", "side": "side",
        "position_side": "posSide", "order_type": "ordType", "trade_mode": "tdMode",
        "price": "px", "size": "sz", "accumulated_fill_size": "accFillSz",
        "average_price": "avgPx", "fee": "fee", "fee_currency": "feeCcy", "pnl": "pnl",
        "created_at": "cTime", "updated_at": "uTime,fillTime,cTime", "fill_time": "fillTime",
        "tag": "tag",
    },
    "private_fills": {
        "instrument_type": "instType", "instrument_id": "instId", "trade_id": "tradeId",
        "order_id": "ordId", "client_order_id": "clOrdId", "side": "side",
        "position_side": "posSide", "execution_type": "execType", "fill_price": "fillPx",
        "fill_size": "fillSz", "fee": "fee", "fee_currency": "feeCcy", "fill_pnl": "fillPnl",
        "fill_time": "fillTime,ts", "generated_at": "ts,fillTime", "tag": "tag",
    },
    "private_bills": {
        "instrument_type": "instType", "instrument_id": "instId", "bill_id": "billId",
        "bill_type": "type", "bill_sub_type": "subType", "timestamp": "ts", "currency": "ccy",
        "balance_change": "balChg", "position_balance_change": "posBalChg", "balance": "bal",
        "position_balance": "posBal", "size": "sz", "price": "px", "pnl": "pnl", "fee": "fee",
        "margin_mode": "mgnMode", "order_id": "ordId", "client_order_id": "clOrdId",
        "trade_id": "tradeId", "execution_type": "execType", "notes": "notes", "tag": "tag",
    },
}
_REQUIRED = {
    "private_orders": ["order_id", "updated_at"],
    "private_fills": ["trade_id", "fill_time"],
    "private_bills": ["bill_id", "timestamp"],
}


def account_rows(df: DataFrame, dataset: str, account: str) -> DataFrame:
    """Order, fill or bill messages (text columns) with exact decimals and the raw message."""
    fields = ACCOUNT_FIELDS[dataset]

    def text(spec: str) -> Column:
        got = [F.nullif(F.col(s), F.lit("")) for s in spec.split(",") if s in df.columns]
        return F.coalesce(*got) if got else F.lit(None).cast("string")

    out = []
    for f in TABLES[dataset].fields:
        if f.name == "venue":
            c = F.lit("OKX")
        elif f.name == "account_alias":
            c = F.lit(account)
        elif f.name == "raw_json":
            c = F.to_json(F.struct(*[F.col(x) for x in sorted(df.columns)]))
        elif f.dataType.typeName() == "timestamp_ntz":
            c = _ms(text(fields[f.name]))
        else:
            c = text(fields[f.name]).try_cast(f.dataType)
        out.append(c.alias(f.name))
    rows = df.select(*out)
    for name in _REQUIRED[dataset]:
        rows = rows.where(F.col(name).isNotNull())
    return rows
