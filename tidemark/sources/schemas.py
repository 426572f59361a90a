"""Canonical market tables: columns, primary keys and stored bar sizes."""

from __future__ import annotations

from pyspark.sql import types as T

STR, DBL, LNG, BOOL = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()
BYTE, SHORT, INT = T.ByteType(), T.ShortType(), T.IntegerType()
MONEY = T.DecimalType(38, 18)
TS = T.TimestampNTZType()


def _table(text: str) -> T.StructType:
    """Build a schema from ``name:type`` words; a bare name takes the type of the next one."""
    short = {"s": STR, "d": DBL, "t": TS, "l": LNG, "b": BOOL, "y": BYTE, "h": SHORT, "i": INT,
             "m": MONEY}
    fields, waiting = [], []
    for word in text.split():
        name, _, kind = word.partition(":")
        waiting.append(name)
        if kind:
            fields += [T.StructField(n, short[kind]) for n in waiting]
            waiting = []
    return T.StructType(fields)


_BAR = "venue instrument_id bar_type:s timestamp:t"
_LIVE = "instrument_type state base_currency quote_currency settle_currency contract_type:s"

# Dataset names, column names and types of the canonical tables.
TABLES: dict[str, T.StructType] = {
    "candles": _table(
        f"{_BAR} open high low close volume volume_ccy volume_quote:d confirm:y"
    ),
    "funding_rates": _table(
        "venue instrument_id:s timestamp:t funding_rate realized_rate:d method formula_type:s"
    ),
    "contract_basis": _table(f"{_BAR} mark_price index_price basis basis_rate:d"),
    "open_interest": _table(f"{_BAR} open_interest_usd volume_usd:d"),
    "long_short_ratio": _table(f"{_BAR} long_short_ratio:d"),
    "market_cap": _table(f"{_BAR} market_cap_usd price_usd volume_24h_usd:d"),
    "liquidations": _table(
        "venue instrument_id:s timestamp:t liquidation_id side position_side:s"
        " bankruptcy_price size bankruptcy_loss:d"
    ),
    "taker_volume": _table(f"{_BAR} buy_volume sell_volume net_buy_volume:d"),
    "price_candles": _table(f"{_BAR} open high low close:d confirm:y"),
    "aggregate_open_interest": _table(
        "venue metric_scope base_currency bar_type:s timestamp:t open_interest_usd volume_usd:d"
    ),
    "ratio_history": _table(
        "venue instrument_id bar_type:s timestamp:t ratio_type:s long_short_ratio:d"
    ),
    "aggregate_trades": _table(
        "venue market_type instrument_type instrument_id aggregate_trade_id:s timestamp:t"
        " price size:d first_trade_id last_trade_id side:s buyer_is_maker:b"
    ),
    "instrument_snapshots": _table(
        f"venue instrument_id:s timestamp:t instrument_family {_LIVE} list_time expiration_time:t"
        " contract_value:d contract_value_currency:s tick_size lot_size min_size last_price"
        " bid_price ask_price spread_bps volume_24h volume_currency_24h volume_usd_24h"
        " open_interest_usd:d"
    ),
    "lifecycles": _table(
        "venue instrument_id instrument_type base_currency quote_currency settle_currency"
        " contract_type:s valid_from valid_to first_seen last_seen:t"
        " valid_from_source valid_to_source confidence:s"
    ),
    "universes": _table(
        "universe_name venue:s timestamp source_snapshot_timestamp:t instrument_id:s rank:i"
        " list_time:t volume_usd_24h open_interest_usd spread_bps:d config_hash:s"
    ),
    "private_orders": _table(
        "venue account_alias instrument_type instrument_id order_id client_order_id state side"
        " position_side order_type trade_mode:s price size accumulated_fill_size average_price"
        " fee:m fee_currency:s pnl:m created_at updated_at fill_time:t tag raw_json:s"
    ),
    "private_fills": _table(
        "venue account_alias instrument_type instrument_id trade_id order_id client_order_id side"
        " position_side execution_type:s fill_price fill_size fee:m fee_currency:s fill_pnl:m"
        " fill_time generated_at:t tag raw_json:s"
    ),
    "private_bills": _table(
        "venue account_alias instrument_type instrument_id bill_id bill_type bill_sub_type:s"
        " timestamp:t currency:s balance_change position_balance_change balance position_balance"
        " size price pnl fee:m margin_mode order_id client_order_id trade_id execution_type notes"
        " tag raw_json:s"
    ),
}

_BAR_KEY = ["venue", "instrument_id", "bar_type", "timestamp"]
# Primary keys.
PRIMARY_KEYS: dict[str, list[str]] = {
    "candles": _BAR_KEY,
    "funding_rates": ["venue", "instrument_id", "timestamp"],
    "contract_basis": _BAR_KEY,
    "open_interest": _BAR_KEY,
    "long_short_ratio": _BAR_KEY,
    "market_cap": _BAR_KEY,
    "liquidations": ["venue", "instrument_id", "liquidation_id"],
    "taker_volume": _BAR_KEY,
    "price_candles": _BAR_KEY,
    "aggregate_open_interest": ["venue", "base_currency", "bar_type", "timestamp"],
    "ratio_history": ["venue", "instrument_id", "ratio_type", "bar_type", "timestamp"],
    "aggregate_trades": ["venue", "instrument_id", "aggregate_trade_id"],
    "instrument_snapshots": ["venue", "instrument_id", "timestamp"],
    "lifecycles": ["venue", "instrument_id"],
    "universes": ["universe_name", "venue", "timestamp", "instrument_id"],
    "private_orders": ["venue", "account_alias", "order_id"],
    "private_fills": ["venue", "account_alias", "instrument_id", "trade_id", "fill_time"],
    "private_bills": ["venue", "account_alias", "bill_id"],
}

# Bar size in which each dataset is stored.
STORED_BARS = {
    "candles": "1m",
    "contract_basis": "1m",
    "open_interest": "5m",
    "long_short_ratio": "5m",
    "taker_volume": "5m",
    "market_cap": "1d",
}

# Legacy column names and their canonical ones.
LEGACY_NAMES = {
    "exchange": "venue",
    "inst_id": "instrument_id",
    "bar": "bar_type",
    "ts": "timestamp",
}
