"""One query per factor, and the factor engine as a whole."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import ieee_ratio, shift_time
from tidemark.operators.factors import (
    DEFAULT,
    Factor,
    FactorSpec,
    Registry,
    attach_sources,
    compute_factors,
    factor_columns,
    factor_rows,
    liquidations_per_bar,
)
from tidemark.queries.base import (
    PANELS,
    bars,
    bars_sql,
    ewm,
    final,
    lag,
    over,
    query,
    roll,
    series_rows,
    staged,
    table,
)
from tidemark.session import materialize

LNC = {"lc": "ln(close)"}
RET = [LNC, {"r": f"lc - {lag('lc')}"}]
TR = [
    {"pc": lag("close")},
    {"tr": "greatest(high - low, abs(high - pc), abs(low - pc))"},
]

# name -> (parameters, SQL stages, final expression, panel)
PRICE_FACTORS: dict[str, tuple[dict, list, str, str]] = {
    "momentum": ({"lookback": "24h"}, [LNC], f"lc - {lag('lc', 6)}", "type"),
    "ma_spread": (
        {"fast_period": 5, "slow_period": 20},
        [{"f": roll("avg", "close", 5), "m": roll("avg", "close", 20)}],
        "CASE WHEN m <> 0 THEN (f - m) / m END", "type",
    ),
    "kdj": (
        {"lookback": 9, "k_smoothing": 3, "d_smoothing": 3, "component": "j"},
        [
            {"lo": roll("min", "low", 9), "hi": roll("max", "high", 9)},
            {"rsv": "CASE WHEN hi - lo > 0 THEN (close - lo) / (hi - lo) END"},
            {"k": ewm("rsv", "(1.0/3)", 3)},
            {"d": ewm("k", "(1.0/3)", 3)},
        ],
        "3 * k - 2 * d", "type",
    ),
    "trend_slope": (
        {"period": 20, "weight_r2": True},
        [
            LNC,
            {"idx": f"CAST(row_number() {over()} AS DOUBLE)"},
            {
                "b": f"regr_slope(lc, idx) {over(20)}",
                "r2": f"regr_r2(lc, idx) {over(20)}",
                "n": f"count(lc) {over(20)}",
            },
        ],
        "CASE WHEN n >= 20 THEN b * 19 * greatest(0, coalesce(r2, 0)) END", "type",
    ),
    "breakout": (
        {"period": 20},
        [
            {"h0": roll("max", "high", 20), "l0": roll("min", "low", 20)},
            {"hi": lag("h0"), "lo": lag("l0")},
        ],
        "CASE WHEN hi - lo > 0 THEN 2 * (close - lo) / (hi - lo) - 1 END", "type",
    ),
    "mean_reversion": (
        {"period": 20},
        [LNC, {"m": roll("avg", "lc", 20), "sd": roll("stddev_samp", "lc", 20)}],
        "CASE WHEN sd > 0 THEN -(lc - m) / sd END", "type",
    ),
    "historical_volatility": (
        {"period": 24, "annualize": True},
        [*RET, {"sd": roll("stddev_samp", "r", 24)}],
        "sd * sqrt(365 * 6.0)", "type",
    ),
    "atr": (
        {"period": 14, "normalized": True},
        [*TR, {"a": ewm("tr", "(1.0/14)", 14)}],
        "CASE WHEN close <> 0 THEN a / close END", "type",
    ),
    "volatility_change": (
        {"short_period": 24, "long_period": 72},
        [*RET, {"a": roll("stddev_samp", "r", 24), "b": roll("stddev_samp", "r", 72)}],
        "CASE WHEN b > 0 THEN a / b - 1 END", "type",
    ),
    "up_down_volatility_asymmetry": (
        {"period": 24},
        [
            *RET,
            {"u0": "CASE WHEN r > 0 THEN r * r ELSE 0.0 END", "d0": "CASE WHEN r < 0 THEN r * r ELSE 0.0 END"},
            {"u": f"sqrt({roll('avg', 'u0', 24)})", "d": f"sqrt({roll('avg', 'd0', 24)})"},
        ],
        "CASE WHEN u + d > 0 THEN (d - u) / (d + u) END", "type",
    ),
    "realized_skewness": (
        {"period": 100},
        [
            *RET,
            {"r2": "r * r", "r3": "r * r * r"},
            {"a": roll("sum", "r2", 100), "b": roll("sum", "r3", 100)},
        ],
        "CASE WHEN a > 0 THEN sqrt(100.0) * b / pow(a, 1.5) END", "type",
    ),
    "realized_kurtosis": (
        {"period": 100},
        [
            *RET,
            {"r2": "r * r", "r4": "r * r * r * r"},
            {"a": roll("sum", "r2", 100), "b": roll("sum", "r4", 100)},
        ],
        "CASE WHEN a > 0 THEN 100 * b / (a * a) END", "type",
    ),
    "volume_change": (
        {"period": 24},
        [{"v": roll("sum", "volume_quote", 24)}, {"p": lag("v", 24)}],
        "CASE WHEN v > 0 AND p > 0 THEN ln(v / p) END", "type",
    ),
    "turnover": (
        {"period": 24}, [{"v": roll("sum", "volume_quote", 24)}], "ln(1 + v)", "type",
    ),
    "amihud": (
        {"period": 24, "log_transform": True, "scale": 1000.0},
        [*RET, {"x": "abs(r) / volume_quote"}, {"m": roll("avg", "x", 24)}],
        "ln(1 + m * 1000)", "type",
    ),
    "volume_price_divergence": (
        {"period": 12},
        [
            LNC,
            {"p": f"lc - {lag('lc', 12)}", "v0": f"ln({roll('sum', 'volume_quote', 12)})"},
            {"v": f"v0 - {lag('v0', 12)}"},
            {
                "pm": roll("avg", "p", 12), "ps": roll("stddev_samp", "p", 12),
                "vm": roll("avg", "v", 12), "vs": roll("stddev_samp", "v", 12),
            },
        ],
        "CASE WHEN ps > 0 AND vs > 0 THEN (p - pm) / ps - (v - vm) / vs END", "type",
    ),
    "relative_volume": (
        {"period": 60},
        [{"m": roll("avg", "volume_quote", 60)}],
        "CASE WHEN m > 0 THEN volume_quote / m END", "type",
    ),
    "quarter_hour_volume_pressure": (
        {"volume_period": 20, "boundary_minutes": 15},
        [{"m": roll("avg", "volume_quote", 20)}],
        "CASE WHEN m > 0 THEN CASE WHEN minute(t) % 15 = 0 AND high > low "
        "THEN (2 * close - high - low) / (high - low) * volume_quote / m ELSE 0.0 END END",
        "type",
    ),
    "volume_confirmed_reversal_event": (
        {
            "momentum_lookback": 2, "normalization_window": 80, "normalization_min_periods": 20,
            "smoothing_period": 3, "volume_period": 10, "signal_threshold": 0.5,
            "minimum_relative_volume": 0.8,
        },
        [
            LNC,
            {"mv": f"lc - {lag('lc', 2)}"},
            {"mm": roll("avg", "mv", 80, 20), "ms": roll("stddev_samp", "mv", 80, 20)},
            {"z": "CASE WHEN ms > 0 THEN (mv - mm) / ms END"},
            {"sc": f"-{roll('avg', 'z', 3)}", "vm": roll("avg", "volume_quote", 10)},
            {"ps": lag("sc"), "rv": "CASE WHEN vm > 0 THEN volume_quote / vm END"},
        ],
        "CASE WHEN sc IS NOT NULL AND rv IS NOT NULL THEN "
        "CASE WHEN sc > 0.5 AND ps <= 0.5 AND rv > 0.8 THEN sc ELSE 0.0 END END",
        "type",
    ),
    "report_momentum": (
        {"window": 5}, [{"m": f"close / {lag('close', 5)} - 1"}], lag("m"), "user",
    ),
    "report_breakout": (
        {"window": 5},
        [
            {"seen": f"list(close) {over(5)}"},
            {"b": "CASE WHEN len(seen) = 5 THEN list_position(seen, list_max(seen)) - 1 - 2.0 END"},
        ],
        lag("b"), "user",
    ),
}


def _price_factor(name: str, params: dict, panel: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        p, spec = PANELS[panel], FactorSpec(name, params)
        wide = factor_columns(
            bars(spark, sf, panel), [spec], p.bar, max_rows=series_rows(spark, sf, panel)
        )
        return wide.select(
            "instrument_id", shift_time("timestamp", p.minutes).alias("timestamp"),
            F.col(f"`{spec.name}`").alias("raw_value"),
        )

    return run


def _factor_sql(stages: list, expr: str, panel: str) -> str:
    step = PANELS[panel].step
    ctes = f"{bars_sql(panel)},\n{staged('bars', [*stages, {'raw_value': expr}])}"
    return final(
        ctes, f"s{len(stages)}", d="raw_value",
        o=f"instrument_id; timestamp=t + INTERVAL '{step}'",
    )


for _name, (_params, _stages, _expr, _panel) in PRICE_FACTORS.items():
    query(f"factor_{_name}", _factor_sql(_stages, _expr, _panel))(
        _price_factor(_name, _params, _panel)
    )


# -- derivative sources: events of one type, per user --------------------------------------
def source_events(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return table(spark, sf, "events").where(F.col("event_type") == kind).select(
        F.lit("SIM").alias("venue"),
        F.col("user_id").cast("string").alias("instrument_id"),
        F.col("ts").alias("timestamp"),
        "event_id",
        "value",
    )


def derivative_sources(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    def of(kind: str, **cols) -> DataFrame:
        df = source_events(spark, sf, kind)
        # Several messages at one instant: the highest one stands.
        best = df.groupBy("venue", "instrument_id", "timestamp").agg(F.max("value").alias("value"))
        return best.select(
            "venue", "instrument_id", "timestamp", *[c.alias(n) for n, c in cols.items()]
        )

    v = F.col("value")
    slot = F.window("timestamp", "1 day").start
    taker = (
        table(spark, sf, "events")
        .select(
            F.lit("SIM").alias("venue"), F.col("user_id").cast("string").alias("instrument_id"),
            F.col("ts").alias("timestamp"), "event_type", "value",
        )
        .groupBy("venue", "instrument_id", slot.alias("slot"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("event_type").isin("click", "view"), v)), F.lit(0.0)).alias("buy_volume"),
            F.coalesce(F.sum(F.when(F.col("event_type").isin("error", "purchase"), v)), F.lit(0.0)).alias("sell_volume"),
        )
        .withColumnRenamed("slot", "timestamp")
    )
    liq = source_events(spark, sf, "purchase").select(
        "venue", "instrument_id", "timestamp",
        F.when(F.col("event_id") % 2 == 0, "short").otherwise("long").alias("position_side"),
        v.alias("bankruptcy_price"), F.lit(2.0).alias("size"), (v / 10).alias("bankruptcy_loss"),
    )
    caps = of("signup", market_cap_usd=v * 1000.0)
    caps = caps.withColumn("venue", F.lit("GLOBAL"))
    return {
        "funding_rates": of("error", funding_rate=(v - 50) / 1000, realized_rate=v / 1000),
        "contract_basis": of("click", basis_rate=(v - 50) / 100),
        "open_interest": of("view", open_interest_usd=v),
        "long_short_ratio": of("purchase", long_short_ratio=v / 40),
        "market_cap": caps,
        "liquidations": liq,
        "taker_volume": taker,
    }


def _src_sql(kind: str, cols: str) -> str:
    return (
        "SELECT CAST(user_id AS VARCHAR) AS instrument_id, ts, "
        f"{cols} FROM (SELECT user_id, ts, max(value) AS v FROM events "
        f"WHERE event_type = '{kind}' GROUP BY ALL)"
    )


def _asof_sql(kind: str, cols: str, names: str, shift: str = "INTERVAL 0 DAY", fresh: str = "") -> str:
    """Bars with the latest source row; ``fresh`` blanks rows that are too old."""
    got = ", ".join(
        f"CASE WHEN {fresh or 'true'} THEN f.{n} END AS {n}" for n in names.split()
    )
    return (
        f"src AS ({_src_sql(kind, cols)}),\n"
        f"j AS (SELECT b.*, {got} FROM bars b ASOF LEFT JOIN src f "
        f"ON b.instrument_id = f.instrument_id AND b.t + {shift} >= f.ts)"
    )


_DAY, _FRESH = "INTERVAL 1 DAY", "f.ts >= b.t + INTERVAL 1 DAY - INTERVAL 3 DAY"
_LIQ = (
    "liq AS (SELECT CAST(user_id AS VARCHAR) AS instrument_id, time_bucket(INTERVAL '1 day', ts) AS t, "
    "coalesce(sum(CASE WHEN event_id % 2 = 0 THEN value / 10 END), 0.0) AS s, "
    "coalesce(sum(CASE WHEN event_id % 2 <> 0 THEN value / 10 END), 0.0) AS l "
    "FROM events WHERE event_type = 'purchase' GROUP BY ALL),\n"
    "j AS (SELECT b.*, coalesce(s, 0.0) AS s, coalesce(l, 0.0) AS l FROM bars b LEFT JOIN liq USING (instrument_id, t))"
)
_TAKER = (
    "tk AS (SELECT CAST(user_id AS VARCHAR) AS instrument_id, time_bucket(INTERVAL '1 day', ts) AS t, "
    "coalesce(sum(CASE WHEN event_type IN ('click', 'view') THEN value END), 0.0) AS bv, "
    "coalesce(sum(CASE WHEN event_type IN ('error', 'purchase') THEN value END), 0.0) AS sv "
    "FROM events GROUP BY ALL),\n"
    "j AS (SELECT b.*, bv, sv FROM bars b LEFT JOIN tk USING (instrument_id, t))"
)
# name -> (parameters, source, CTEs, stages, expression)
SOURCE_FACTORS = {
    "funding_rate": (
        {"smoothing": 3, "annualize": True}, "funding_rates",
        _asof_sql("error", "(v - 50) / 1000 AS funding_rate", "funding_rate", _DAY, _FRESH),
        [{"m": roll("avg", "funding_rate", 3)}], "m * 1095",
    ),
    "basis": (
        {}, "contract_basis",
        _asof_sql("click", "(v - 50) / 100 AS basis_rate", "basis_rate"), [], "basis_rate",
    ),
    "open_interest": (
        {"lookback": "2d"}, "open_interest",
        _asof_sql("view", "v AS oi", "oi"),
        [{"p": lag("oi", 2)}], "CASE WHEN oi > 0 AND p > 0 THEN ln(oi / p) END",
    ),
    "market_cap": (
        {}, "market_cap",
        _asof_sql("signup", "v * 1000 AS cap", "cap", fresh="f.ts >= b.t - INTERVAL 3 DAY"),
        [], "CASE WHEN cap > 0 THEN ln(cap) END",
    ),
    "long_short_ratio": (
        {}, "long_short_ratio", _asof_sql("purchase", "v / 40 AS lsr", "lsr"), [],
        "CASE WHEN lsr > 0 THEN ln(lsr) END",
    ),
    "liquidation_imbalance": (
        {"measure": "bankruptcy_loss"}, "liquidations", _LIQ, [],
        "CASE WHEN s + l > 0 THEN (s - l) / (s + l) ELSE 0.0 END",
    ),
    "taker_imbalance": (
        {}, "taker_volume", _TAKER, [], "CASE WHEN bv + sv > 0 THEN (bv - sv) / (bv + sv) END",
    ),
    "report_carry": (
        {}, "funding_rates",
        _asof_sql("error", "(v - 50) / 1000 AS funding_rate", "funding_rate", _DAY, _FRESH),
        [{"c": "last_value(funding_rate IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY t "
               "ROWS UNBOUNDED PRECEDING)"}],
        lag("c"),
    ),
}


def _source_factor(name: str, params: dict, source: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spec = FactorSpec(name, params)
        # The source join and the windows both read the bars.
        panel = materialize(bars(spark, sf, "user"))
        joined = attach_sources(panel, {source: derivative_sources(spark, sf)[source]}, "1d")
        wide = factor_columns(joined, [spec], "1d", max_rows=series_rows(spark, sf, "user"))
        return wide.select(
            "instrument_id", shift_time("timestamp", 1440).alias("timestamp"),
            F.col(f"`{spec.name}`").alias("raw_value"),
        )

    return run


for _name, (_params, _source, _ctes, _stages, _expr) in SOURCE_FACTORS.items():
    _all = f"{bars_sql('user')},\n{_ctes},\n{staged('j', [*_stages, {'raw_value': _expr}])}"
    query(
        f"factor_{_name}",
        final(
            _all, f"s{len(_stages)}", d="raw_value",
            o="instrument_id; timestamp=t + INTERVAL 1 DAY",
        ),
    )(_source_factor(_name, _params, _source))


@query(
    "liquidations_per_bar",
    final(
        "x AS (SELECT CAST(user_id AS VARCHAR) AS instrument_id, "
        "time_bucket(INTERVAL '1 day', ts) AS t, value AS v, event_id % 2 = 0 AS s "
        "FROM events WHERE event_type = 'purchase'), "
        "y AS (SELECT instrument_id, t, "
        "coalesce(sum(v / 10) FILTER (WHERE s), 0) AS short_bankruptcy_loss, "
        "coalesce(sum(v / 10) FILTER (WHERE NOT s), 0) AS long_bankruptcy_loss, "
        "coalesce(sum(v * 2) FILTER (WHERE s), 0) AS short_notional, "
        "coalesce(sum(v * 2) FILTER (WHERE NOT s), 0) AS long_notional, "
        "coalesce(sum(2.0) FILTER (WHERE s), 0) AS short_size, "
        "coalesce(sum(2.0) FILTER (WHERE NOT s), 0) AS long_size FROM x GROUP BY ALL)",
        "y",
        d="short_bankruptcy_loss long_bankruptcy_loss short_notional long_notional short_size long_size",
        o="venue='SIM'; instrument_id; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return liquidations_per_bar(derivative_sources(spark, sf)["liquidations"], 1440)


START, END = datetime(2024, 1, 8), datetime(2024, 1, 25)
_ENGINE = f"""{bars_sql('user')},
scan AS (SELECT * FROM bars WHERE t >= TIMESTAMP '2024-01-08' - INTERVAL 7 DAY AND t < TIMESTAMP '2024-01-25'),
{staged('scan', [LNC, {
    'momentum': f"lc - {lag('lc', 3)}",
    'f': roll('avg', 'close', 2), 'm': roll('avg', 'close', 6),
}])},
tall AS (
  SELECT *, 'momentum[lookback=3]' AS factor_name, 'momentum' AS factor_key, momentum AS raw_value FROM s1
  UNION ALL
  SELECT *, 'ma_spread[fast_period=2,slow_period=6]' AS factor_name, 'ma_spread' AS factor_key,
         CASE WHEN m <> 0 THEN (f - m) / m END AS raw_value FROM s1)"""


@query(
    "compute_factors_request",
    final(
        _ENGINE, "tall", d="raw_value",
        o="venue; instrument_id; bar_type; timestamp=t + INTERVAL 1 DAY; factor_name; factor_key; "
          "factor_version='1'",
        where="t + INTERVAL 1 DAY >= TIMESTAMP '2024-01-08' AND t + INTERVAL 1 DAY < TIMESTAMP '2024-01-25'",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    specs = [
        FactorSpec("momentum", {"lookback": 3}),
        FactorSpec("ma_spread", {"fast_period": 2, "slow_period": 6}),
    ]
    return factor_rows(compute_factors(bars(spark, sf), specs, "1d", start=START, end=END))


@query(
    "factor_user_registered",
    _factor_sql([], "(high - low) / close", "user"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    registry = Registry([DEFAULT.get(n) for n in DEFAULT.names()])
    registry.register(
        Factor("bar_range", lambda s, p, bar: s.add(ieee_ratio(F.col("high") - F.col("low"), "close")))
    )
    tall = compute_factors(
        bars(spark, sf), [FactorSpec("bar_range")], "1d", registry=registry,
        start=datetime(2000, 1, 1), end=datetime(2100, 1, 1),
    )
    return tall.select("instrument_id", "timestamp", "raw_value")


