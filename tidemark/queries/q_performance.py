"""Wealth curves, allocation, ledgers and parameter studies."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators import performance as perf
from tidemark.operators import portfolio as pf
from tidemark.operators import signals as sig
from tidemark.queries.base import bars, bars_sql, final, query, series_rows, staged, table
from tidemark.queries.q_indicators import AVERAGES, EXTREMA, MACD, _PEAK, _TROUGH, cross_sql, hold_sql
from tidemark.queries.q_portfolio import BOOK, START, TK, TKEYS, threshold_book, threshold_sql
from tidemark.queries.q_processing import MOM, dataset
from tidemark.session import materialize

SPLIT = datetime(2024, 1, 20)

# -- daily wealth --------------------------------------------------------------------------
INTERVAL = """iv AS (SELECT *, coalesce(lag(w2) OVER (PARTITION BY {k} ORDER BY t), 1.0) AS base, lag(exit_time) OVER (PARTITION BY {k} ORDER BY t) AS lx
  FROM (SELECT *, product(1 + pr - cost) OVER (PARTITION BY {k} ORDER BY t ROWS UNBOUNDED PRECEDING) AS w2 FROM {s})),
mk AS (SELECT *, unnest(generate_series(date_trunc('day', t) + INTERVAL 1 DAY, date_trunc('day', exit_time), INTERVAL 1 DAY)) AS b FROM iv
  UNION ALL SELECT *, t FROM iv WHERE t = date_trunc('day', t) AND (lx IS NULL OR lx < t)),
iw AS (SELECT {m}, mk.b, base * (1 + p * (n.open / e.open - 1) - 2 * cost) AS wealth FROM mk
  JOIN bars e ON e.instrument_id = mk.instrument_id AND e.t = mk.t JOIN bars n ON n.instrument_id = mk.instrument_id AND n.t = mk.b)"""


def _iv(keys: str, source: str) -> str:
    named = ", ".join(f"mk.{k.strip()}" for k in keys.split(","))
    return INTERVAL.format(k=keys, s=source, m=named)


@query(
    "interval_daily_wealth",
    final(f"{BOOK}, {_iv('instrument_id', 'tp')}", "iw", d="wealth", o="instrument_id; date=b"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    book = threshold_book(spark, sf)
    return perf.interval_daily_wealth(book, bars(spark, sf, "calm_type"), ["instrument_id"], 2.0)


STREAM = (
    "sw0 AS (SELECT instrument_id, t, product(1 + pr - 0.5 * cost) OVER (PARTITION BY instrument_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS w FROM tp), "
    "sw AS (SELECT instrument_id, date_trunc('day', t) + INTERVAL 1 DAY AS d, arg_max(w, t) AS wealth FROM sw0 GROUP BY ALL)"
)


@query(
    "streaming_daily_wealth",
    final(f"{BOOK}, {STREAM}", "sw", d="wealth", o="instrument_id; date=CAST(d AS TIMESTAMP)"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return perf.streaming_daily_wealth(threshold_book(spark, sf), ["instrument_id"], 1.5)


def daily_wealth(spark: SparkSession, sf: str) -> DataFrame:
    book = threshold_book(spark, sf)
    return materialize(perf.streaming_daily_wealth(book, ["instrument_id"], 1.5))


ALIGNED = (
    f"{BOOK}, {STREAM}, cd AS (SELECT d FROM sw GROUP BY d HAVING count(*) = (SELECT count(DISTINCT instrument_id) FROM sw)), "
    "dr0 AS (SELECT instrument_id, d, wealth / lag(wealth) OVER (PARTITION BY instrument_id ORDER BY d) - 1 AS r FROM sw WHERE d IN (SELECT d FROM cd)), "
    "dr AS (SELECT instrument_id, CAST(d AS TIMESTAMP) AS d, r FROM dr0 WHERE r IS NOT NULL)"
)


def daily_returns(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(perf.aligned_daily_returns(daily_wealth(spark, sf), "instrument_id"))


@query("aligned_daily_returns", final(ALIGNED, "dr", d="daily_return=r", o="instrument_id; date=d"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return daily_returns(spark, sf)


@query(
    "equal_weight_daily_wealth",
    final(
        f"{ALIGNED}, eq AS (SELECT d, avg(r) AS r FROM dr GROUP BY d UNION ALL SELECT CAST(min(d) AS TIMESTAMP), 0.0 FROM cd), "
        "ew AS (SELECT d, product(1 + r) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS w FROM eq)",
        "ew", d="wealth=w", o="date=d",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return perf.equal_weight_daily_wealth(daily_wealth(spark, sf), "instrument_id")


def perf_sql(keys: str, source: str, value: str = "r", on: str = "d", year: str = "365.25", out: str = "pp") -> str:
    w = f"(PARTITION BY {keys} ORDER BY {on} ROWS UNBOUNDED PRECEDING)"
    return (
        f"{out}0 AS (SELECT *, product(1 + {value}) OVER {w} AS w FROM {source}), {out}1 AS (SELECT *, w / greatest(max(w) OVER {w}, 1.0) - 1 AS fall FROM {out}0), "
        f"{out} AS (SELECT {keys}, count(*) AS days, product(1 + {value}) - 1 AS tot, CASE WHEN product(1 + {value}) > 0 THEN pow(product(1 + {value}), {year} / count(*)) - 1 ELSE -1 END AS ann, "
        f"CASE WHEN stddev_samp({value}) > 0 THEN avg({value}) / stddev_samp({value}) * sqrt({year}) ELSE 0.0 END AS sh, least(min(fall), 0) AS dd FROM {out}1 GROUP BY ALL)"
    )


PERF_OUT = "total_return=tot; annual_return=ann; sharpe=sh; max_drawdown=dd"


@query("performance_daily", final(f"{ALIGNED}, {perf_sql('instrument_id', 'dr')}", "pp", d=PERF_OUT, i="days", o="instrument_id"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return perf.performance(daily_returns(spark, sf), ["instrument_id"])


@query(
    "calendar_returns_month",
    final(
        f"{ALIGNED}, cr AS (SELECT instrument_id, strftime(d, '%Y-%m') AS period, product(1 + r) - 1 AS pr, count(*) AS n FROM dr GROUP BY ALL)",
        "cr", d="period_return=pr", i="days=n", o="instrument_id; period", where="n >= 2",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return perf.calendar_returns(daily_returns(spark, sf), ["instrument_id"], "month", least=2)


@query(
    "calendar_returns_half_year",
    final(
        f"{ALIGNED}, cr AS (SELECT instrument_id, year(d) || CASE WHEN month(d) <= 6 THEN '-H1' ELSE '-H2' END AS period, product(1 + r) - 1 AS pr, count(*) AS n FROM dr GROUP BY ALL)",
        "cr", d="period_return=pr", i="days=n", o="instrument_id; period",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return perf.calendar_returns(daily_returns(spark, sf), ["instrument_id"], "half_year")


@query(
    "period_comparison",
    final(
        f"{ALIGNED}, tagd AS (SELECT *, unnest(['full', CASE WHEN d < TIMESTAMP '2024-01-20' THEN 'development' ELSE 'holdout' END]) AS period FROM dr), "
        f"{perf_sql('instrument_id, period', 'tagd')}",
        "pp", d=PERF_OUT, i="days", o="instrument_id; period",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return perf.period_comparison(daily_returns(spark, sf), ["instrument_id"], SPLIT)


_SLEEVES = ["click", "view", "error", "purchase", "signup"]
_SLEEVE_WEIGHTS = dict(zip(_SLEEVES, (0.4, 0.3, 0.1, 0.1, 0.1), strict=True))
_GRID_COLS = ", ".join(f"{n}_weight" for n in _SLEEVES)
_GRID_PICK = (
    "SELECT " + ", ".join(f"x{i} / 4.0 AS {n}_weight" for i, n in enumerate(_SLEEVES)) + " FROM "
    + ", ".join(f"range(5) t{i}(x{i})" for i in range(5)) + " WHERE x0 + x1 + x2 + x3 + x4 = 4 AND x0 / 4.0 BETWEEN 0.25 AND 0.75"
)
_GRID_MIX = " + ".join(f"{n}_weight * {n}" for n in _SLEEVES)
_WIDE = (
    f"{ALIGNED}, wd AS (SELECT d, " + ", ".join(f"max(r) FILTER (WHERE instrument_id = '{s}') AS {s}" for s in _SLEEVES)
    + " FROM dr GROUP BY d)"
)


def sleeve_table(spark: SparkSession, sf: str) -> DataFrame:
    df = daily_returns(spark, sf)
    return df.groupBy("date").pivot("instrument_id", _SLEEVES).agg(F.first("daily_return"))


@query(
    "weight_grid_screen",
    final(
        f"{_WIDE}, gr AS ({_GRID_PICK}), "
        f"gx AS (SELECT gr.*, d, {_GRID_MIX} AS r FROM gr, wd WHERE d < TIMESTAMP '2024-01-25'), "
        f"{perf_sql(_GRID_COLS, 'gx')}, "
        f"hb AS (SELECT {_GRID_COLS}, product(1 + r) - 1 AS b FROM gx GROUP BY ALL), gs AS (SELECT * FROM pp JOIN hb USING ({_GRID_COLS}))",
        "gs", d=PERF_OUT + "; " + _GRID_COLS.replace(", ", "; ") + "; worst_half_return=b; positive_half_rate=(b > 0)::INT", i="days",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return perf.weight_grid_screen(
        sleeve_table(spark, sf), _SLEEVES, 4, bounds={"click": (0.25, 0.75)},
        development_end=datetime(2024, 1, 25), least_days=1,
    )


@query(
    "adaptive_allocation",
    final(
        f"{_WIDE}, al AS (SELECT *, row_number() OVER (ORDER BY d) AS k, product(1 + view) OVER (ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) - 1 AS tr FROM wd), "
        "wt AS (SELECT *, CASE WHEN k > 5 AND tr < 0 THEN 0.6 ELSE 0.4 END AS w1, CASE WHEN k > 5 AND tr < 0 THEN 0.1 ELSE 0.3 END AS w2 FROM al), "
        "ct AS (SELECT *, 2 * 0.0005 * (abs(w1 - coalesce(lag(w1) OVER (ORDER BY d), 0.4)) + abs(w2 - coalesce(lag(w2) OVER (ORDER BY d), 0.3))) AS c FROM wt)",
        "ct", d="click_weight=w1; view_weight=w2; error_weight=0.1; purchase_weight=0.1; signup_weight=0.1; allocation_cost=c; daily_return=2 * (w1 * click + w2 * view + 0.1 * (error + purchase + signup)) - c", o="date=d",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return perf.adaptive_allocation(
        sleeve_table(spark, sf), _SLEEVE_WEIGHTS, "view", lookback=5,
        losing_scale=1 / 3, transfer_to="click", leverage=2.0, one_way_cost=0.0005,
    )


# -- staggered phases ----------------------------------------------------------------------
_PHASE_KEYS = "phase, instrument_id, label_name, h"


def _phases() -> str:
    text = threshold_sql()
    text = text.replace("rb AS (SELECT * FROM ob WHERE date_diff('hour', TIMESTAMP '2024-01-01', t) // 4 % h = 0)",
                        "rb AS (SELECT * FROM (SELECT *, unnest([0, 1]) AS phase FROM ob) WHERE date_diff('hour', TIMESTAMP '2024-01-01', t) // 4 >= phase AND (date_diff('hour', TIMESTAMP '2024-01-01', t) // 4 - phase) % h = 0)")
    head, tail = text.split("sg AS (", 1)
    return head + "sg AS (" + tail.replace(f"PARTITION BY {TK}", f"PARTITION BY {_PHASE_KEYS}")


PHASED = _phases()


@query(
    "staggered_phases",
    final(
        f"{PHASED}, dg AS (SELECT phase, instrument_id, count(*) AS n, product(1 + pr) - 1 AS tot, sum((turnover > 0)::INT) AS ch FROM tp GROUP BY ALL)",
        "dg", d="total_return=tot", i="phase; periods=n; position_changes=ch", o="instrument_id",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    book = phased_book(spark, sf)
    return book.groupBy("phase", "instrument_id").agg(
        (F.product(1 + F.col("portfolio_return")) - 1).alias("total_return"),
        F.count(F.lit(1)).alias("periods"),
        F.sum((F.col("turnover") > 0).cast("long")).alias("position_changes"),
    )


def phased_book(spark: SparkSession, sf: str) -> DataFrame:
    ds = perf.phase_offsets(dataset(spark, sf, "calm_type", (2,)), 2, 1)
    return materialize(
        pf.threshold_portfolio(
            ds, MOM, start=START, timeframe="4h", cost_bps=10.0, signal_multiplier=-1.0, smoothing=2,
            position_size=0.5, long_threshold=0.01, short_threshold=0.01, keys=["phase", *TKEYS],
            offset=F.col("phase"), max_rows=series_rows(spark, sf, "calm_type"),
        )
    )


@query(
    "staggered_equal_weight_wealth",
    final(
        f"{PHASED}, {_iv('phase, instrument_id', 'tp')}, "
        "cdx AS (SELECT instrument_id, b FROM iw GROUP BY ALL HAVING count(DISTINCT phase) = 2), "
        "rr AS (SELECT phase, instrument_id, b, wealth / lag(wealth) OVER (PARTITION BY phase, instrument_id ORDER BY b) - 1 AS r FROM iw JOIN cdx USING (instrument_id, b)), "
        "av AS (SELECT instrument_id, b, coalesce(avg(r), 0.0) AS r FROM rr GROUP BY ALL), "
        "ew AS (SELECT instrument_id, b, product(1 + r) OVER (PARTITION BY instrument_id ORDER BY b ROWS UNBOUNDED PRECEDING) AS w FROM av)",
        "ew", d="wealth=w", o="instrument_id; date=b",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    curves = perf.interval_daily_wealth(
        phased_book(spark, sf), bars(spark, sf, "calm_type"), ["phase", "instrument_id"], 2.0
    )
    return perf.equal_weight_daily_wealth(curves, "phase", ["instrument_id"])


# -- ledgers -------------------------------------------------------------------------------
FEE, CASH = 0.0005, 10_000.0
_FADE = [*MACD, *EXTREMA, {"ev": f"CASE WHEN {_PEAK} THEN -1 WHEN {_TROUGH} THEN 1 END"}, {"target": hold_sql("ev")}]
TARGETS = f"{bars_sql('calm_type')},\n{staged('bars', _FADE)},\ntg AS (SELECT instrument_id, t, open, close, target FROM s{len(_FADE) - 1})"


def ledger_sql(source: str, keys: str) -> str:
    """``ld``: trades; ``ec``: equity curve, for targets in ``source``."""
    p = f"PARTITION BY {keys} ORDER BY t"
    return f"""ls0 AS (SELECT *, coalesce(lag(target) OVER ({p}), 0) AS sd, row_number() OVER ({p}) AS bar, lead(open) OVER ({p}) AS no, lead(t) OVER ({p}) AS nt,
  max(t) OVER (PARTITION BY {keys}) AS lt FROM {source}),
ls1 AS (SELECT *, (sd <> 0 AND sd <> coalesce(lag(sd) OVER ({p}), 0))::INT AS op FROM ls0),
ls AS (SELECT *, sum(op) OVER ({p} ROWS UNBOUNDED PRECEDING) AS k FROM ls1),
ld0 AS (SELECT {keys}, k, min(sd) AS sd, min(t) AS entry_time, arg_min(open, t) AS pin, arg_max(coalesce(nt, t), t) AS exit_time, arg_max(coalesce(no, close), t) AS pout,
  bool_or(nt IS NULL) AS at_end, max(bar + (nt IS NOT NULL)::INT) - min(bar) AS held FROM ls WHERE sd <> 0 GROUP BY ALL),
ld1 AS (SELECT *, 1 - {FEE} + sd * (pout / pin - 1) - {FEE} * pout / pin AS f FROM ld0),
ld2 AS (SELECT *, product(f) OVER (PARTITION BY {keys} ORDER BY k ROWS UNBOUNDED PRECEDING) AS gw FROM ld1),
ld AS (SELECT *, {CASH} * coalesce(lag(gw) OVER (PARTITION BY {keys} ORDER BY k), 1.0) AS e0, {CASH} * gw AS e1 FROM ld2),
ec AS (SELECT ls.*, pin, e0, e1, CASE WHEN ls.sd <> 0 AND ls.t = lt THEN e1 WHEN ls.sd <> 0 THEN e0 * (1 - {FEE} + ls.sd * (close / pin - 1)) ELSE coalesce(e1, {CASH}) END AS equity,
  CASE WHEN ls.sd <> 0 AND ls.t = lt THEN 0 ELSE ls.sd END AS held_side FROM ls LEFT JOIN ld USING ({keys}, k))"""


LEDGER = f"{TARGETS},\n{ledger_sql('tg', 'instrument_id')}"


def targets(spark: SparkSession, sf: str) -> DataFrame:
    rows = series_rows(spark, sf, "calm_type")
    df = ind.add(bars(spark, sf, "calm_type"), ind.macd(), max_rows=rows)
    return materialize(ind.add(df, sig.extrema_fade(), max_rows=rows))


def ledger(spark: SparkSession, sf: str, df: DataFrame | None = None, keys=("instrument_id",)):
    df = targets(spark, sf) if df is None else df
    kw = {"fee_rate": FEE, "starting_balance": CASH, "max_rows": series_rows(spark, sf, "calm_type")}
    trades = materialize(perf.trade_ledger(df, keys, **kw))
    return trades, materialize(perf.equity_curve(df, trades, keys, **kw))


@query(
    "trade_ledger",
    final(
        LEDGER, "ld", d="entry_price=pin; exit_price=pout; entry_equity=e0; pnl=e1 - e0; return_pct=(f - 1) * 100; fees=e0 * 0.0005 * (1 + pout / pin)",
        i="trade_id=k; holding_bars=held", o="instrument_id; entry_time; exit_time; side=CASE WHEN sd > 0 THEN 'long' ELSE 'short' END; closed_at_end=at_end",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf)[0]


@query("equity_curve", final(LEDGER, "ec", d="open close equity", i="held=held_side", o="instrument_id; timestamp=t"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf)[1]


def sharpe_sql(source: str, keys: str) -> str:
    return (
        f"sh0 AS (SELECT {keys}, date_trunc('day', t) AS d, arg_max(equity, t) AS e FROM {source} GROUP BY ALL), "
        f"sg0 AS (SELECT {keys}, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM sh0 GROUP BY {keys}), "
        f"sg1 AS (SELECT sg0.*, last_value(e IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY d ROWS UNBOUNDED PRECEDING) AS e FROM sg0 LEFT JOIN sh0 USING ({keys}, d)), "
        f"sr AS (SELECT {keys}, e / lag(e) OVER (PARTITION BY {keys} ORDER BY d) - 1 AS r FROM sg1), "
        f"sx AS (SELECT {keys}, CASE WHEN count(r) >= 2 AND stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252) ELSE 0.0 END AS sharpe FROM sr GROUP BY ALL)"
    )


@query("daily_equity_sharpe", final(f"{LEDGER}, {sharpe_sql('ec', 'instrument_id')}", "sx", d="sharpe_ratio=sharpe", o="instrument_id"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return perf.daily_equity_sharpe(ledger(spark, sf)[1], ["instrument_id"])


def summary_sql(keys: str) -> str:
    return (
        f"{sharpe_sql('ec', keys)}, fl AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING), {CASH}) - 1 AS fall FROM ec), "
        f"pa AS (SELECT {keys}, min(t) AS a, max(t) AS b, count(*) AS bars, arg_max(equity, t) AS fe, greatest(date_diff('second', min(t), max(t)) / (365.25 * 86400), 1 / 365.25) AS yrs, -least(min(fall), 0) * 100 AS dd FROM fl GROUP BY ALL), "
        f"de AS (SELECT {keys}, count(*) AS trades, avg((e1 > e0)::INT) * 100 AS wr, coalesce(sum(e1 - e0) FILTER (WHERE e1 > e0), 0) AS won, coalesce(-sum(e1 - e0) FILTER (WHERE e1 < e0), 0) AS lost, "
        "sum(e0 * 0.0005 * (1 + pout / pin)) AS fees, sum((sd > 0)::INT) AS lt, coalesce(sum(e1 - e0) FILTER (WHERE sd > 0), 0) AS lp, sum((sd < 0)::INT) AS st, coalesce(sum(e1 - e0) FILTER (WHERE sd < 0), 0) AS sp FROM ld GROUP BY ALL), "
        f"sy AS (SELECT * FROM pa LEFT JOIN de USING ({keys}) LEFT JOIN sx USING ({keys}))"
    )


SUMMARY_D = (
    f"final_equity=fe; total_return_pct=(fe / {CASH} - 1) * 100; cagr_pct=(pow(fe / {CASH}, 1 / yrs) - 1) * 100; max_drawdown_pct=dd; win_rate_pct=coalesce(wr, 0); "
    "profit_factor=CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END; total_fees=coalesce(fees, 0); long_pnl=coalesce(lp, 0); short_pnl=coalesce(sp, 0); sharpe_ratio=sharpe"
)
SUMMARY_I = "bars; trades=coalesce(trades, 0); long_trades=coalesce(lt, 0); short_trades=coalesce(st, 0)".replace("bars;", "bars=bars;")


@query(
    "ledger_summary",
    final(f"{LEDGER}, {summary_sql('instrument_id')}", "sy", d=SUMMARY_D, i=SUMMARY_I, o="instrument_id; start_time=a; end_time=b"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    trades, curve = ledger(spark, sf)
    return perf.ledger_summary(curve, trades, ["instrument_id"], starting_balance=CASH)


PERIODS = (
    "pd0 AS (SELECT *, strftime(t, '{f}') AS period FROM ec), pd1 AS (SELECT *, close / lag(close) OVER (PARTITION BY instrument_id, period ORDER BY t) - 1 AS cr, "
    "max(equity) OVER (PARTITION BY instrument_id, period ORDER BY t ROWS UNBOUNDED PRECEDING) AS pk FROM pd0), "
    "en AS (SELECT instrument_id, period, arg_max(equity, t) AS ee FROM pd0 GROUP BY ALL), ep AS (SELECT *, coalesce(lag(ee) OVER (PARTITION BY instrument_id ORDER BY period), 10000.0) AS pe FROM en), "
    "pr AS (SELECT instrument_id, period, (max(ee) / max(pe) - 1) * 100 AS sr, max(ee) AS ee, -least(min(equity / greatest(pk, pe) - 1), 0) * 100 AS dd, (arg_max(close, t) / arg_min(open, t) - 1) * 100 AS er, "
    "CASE WHEN sum(abs(cr)) > 0 THEN abs(arg_max(close, t) / arg_min(open, t) - 1) / sum(abs(cr)) ELSE 0.0 END AS pf, coalesce(stddev_samp(cr), 0) * sqrt(2190) * 100 AS rv, count(*) AS n FROM pd1 JOIN ep USING (instrument_id, period) GROUP BY ALL)"
)


@query(
    "period_results",
    final(
        f"{LEDGER}, {PERIODS.format(f='%Y-%m')}", "pr", d="strategy_return_pct=sr; end_equity=ee; max_drawdown_pct=dd; price_return_pct=er; path_efficiency=pf; realized_vol_pct=rv",
        i="bars=n", o="instrument_id; period",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return perf.period_results(ledger(spark, sf)[1], ["instrument_id"], starting_balance=CASH)


REGIME = (
    "rg0 AS (SELECT *, (row_number() OVER (ORDER BY pf, instrument_id) - 1) / (count(*) OVER () - 1) AS pl FROM pr), "
    "rg AS (SELECT 'efficiency_regime' AS dim, CASE WHEN pl <= 1 / 3 THEN 'choppy_low' WHEN pl <= 2 / 3 THEN 'mixed_mid' ELSE 'trending_high' END AS reg, * FROM rg0 "
    "UNION ALL SELECT 'direction_regime', CASE WHEN er <= -10 THEN 'down_below_-10pct' WHEN er <= 10 THEN 'range_-10_to_10pct' ELSE 'up_above_10pct' END, * FROM rg0), "
    "rr AS (SELECT dim, reg, count(*) AS n, sum((sr > 0)::INT) AS pm, avg(sr) AS a, median(sr) AS md, avg(er) AS b, avg(pf) AS c, avg(rv) AS d FROM rg GROUP BY ALL)"
)


@query(
    "regime_results",
    final(
        f"{LEDGER}, {PERIODS.format(f='%Y-%m')}, {REGIME}", "rr",
        d="avg_strategy_return_pct=a; median_strategy_return_pct=md; avg_price_return_pct=b; avg_path_efficiency=c; avg_realized_vol_pct=d",
        i="months=n; profitable_months=pm", o="dimension=dim; regime=reg",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    monthly = perf.period_results(ledger(spark, sf)[1], ["instrument_id"], starting_balance=CASH)
    return perf.regime_results(monthly)


@query(
    "regime_correlations",
    final(
        f"{LEDGER}, {PERIODS.format(f='%Y-%m')}, rc AS (SELECT corr(sr, pf) AS a, corr(sr, abs(er)) AS b, corr(sr, rv) AS c FROM pr)", "rc",
        d="strategy_vs_path_efficiency=a; strategy_vs_abs_price_return=b; strategy_vs_realized_vol=c",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    monthly = perf.period_results(ledger(spark, sf)[1], ["instrument_id"], starting_balance=CASH)
    return perf.regime_correlations(monthly)


@query(
    "trades_by_year_side",
    final(
        f"{LEDGER}, ys AS (SELECT instrument_id, year(exit_time) AS y, CASE WHEN sd > 0 THEN 'long' ELSE 'short' END AS side, count(*) AS n, sum((e1 > e0)::INT) AS w, sum(e1 - e0) AS pnl, avg((f - 1) * 100) AS r, avg(held) AS hb FROM ld GROUP BY ALL)",
        "ys", d="pnl; avg_return_pct=r; avg_holding_bars=hb", i="year=y; trades=n; wins=w", o="instrument_id; side",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return perf.trades_by_year_side(ledger(spark, sf)[0], ["instrument_id"])


# -- variants ------------------------------------------------------------------------------
_VARIANTS = ["cross", "confirm", "wide"]
_VT = [
    *AVERAGES,
    {"c0": cross_sql("spread"), "c1": cross_sql("spread_pct", 0.002), "c2": cross_sql("spread_pct", 0.004)},
]
VARIANTS = (
    f"{bars_sql('calm_type')},\n{staged('bars', _VT)},\nvt AS (SELECT instrument_id, t, open, close, unnest([('cross', c0), ('confirm', c1), ('wide', c2)]) AS v FROM s{len(_VT) - 1}), "
    "vh AS (SELECT instrument_id, t, open, close, v[1] AS variant, coalesce(last_value(nullif(v[2], 0) IGNORE NULLS) OVER (PARTITION BY instrument_id, v[1] ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS target FROM vt), "
)
SEGMENTS = VARIANTS + (
    "sgm AS (SELECT *, unnest(['full', CASE WHEN t < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END]) AS segment FROM vh),\n"
)
VKEYS = "variant, instrument_id, segment"


def variant_targets(spark: SparkSession, sf: str) -> DataFrame:
    rows = series_rows(spark, sf, "calm_type")
    df = ind.add(bars(spark, sf, "calm_type"), ind.moving_averages(), max_rows=rows)

    def signals(s):
        return {
            "cross": sig.cross(s, "spread"), "confirm": sig.cross(s, "spread_pct", 0.002),
            "wide": sig.cross(s, "spread_pct", 0.004),
        }

    df = sig.variants_tall(ind.add(df, signals, max_rows=rows), _VARIANTS, "signal")
    held = ind.add(df, sig.held_target(), keys=["variant", "instrument_id"], max_rows=rows)
    return materialize(held.select("variant", "instrument_id", "timestamp", "open", "close", "target"))


_VS = f"{SEGMENTS}{ledger_sql('sgm', VKEYS)}, {summary_sql(VKEYS)}"
_COLS = ["total_return_pct", "cagr_pct", "max_drawdown_pct", "sharpe_ratio", "trades"]
_EXPR = {
    "total_return_pct": f"(fe / {CASH} - 1) * 100", "cagr_pct": f"(pow(fe / {CASH}, 1 / yrs) - 1) * 100", "max_drawdown_pct": "dd",
    "sharpe_ratio": "sharpe", "trades": "coalesce(trades, 0)",
}
_PIV = ", ".join(
    f"max({_EXPR[c]}) FILTER (WHERE segment = '{s}') AS {s}_{c}" for s in ("full", "train", "test") for c in _COLS
)
COMPARE = (
    f"{_VS}, vc0 AS (SELECT variant, instrument_id, {_PIV} FROM sy GROUP BY ALL), "
    "vc AS (SELECT *, train_cagr_pct / greatest(train_max_drawdown_pct, 1e-9) AS train_score, test_cagr_pct / greatest(test_max_drawdown_pct, 1e-9) AS test_score FROM vc0)"
)


def compare(spark: SparkSession, sf: str) -> DataFrame:
    df = perf.split_segments(variant_targets(spark, sf), SPLIT)
    keys = ["variant", "instrument_id", "segment"]
    trades, curve = ledger(spark, sf, materialize(df), keys)
    summaries = perf.ledger_summary(curve, trades, keys, starting_balance=CASH)
    return perf.variant_comparison(summaries, ["variant", "instrument_id"])


@query(
    "variant_comparison",
    final(
        COMPARE, "vc",
        d="; ".join(
            f"{s}_log_growth=ln(1 + {s}_cagr_pct / 100)" if c == "cagr_pct" else f"{s}_{c}={s}_{c}"
            for s in ("full", "train", "test") for c in _COLS if c != "trades"
        ),
        i="full_trades=full_trades; train_trades=train_trades; test_trades=test_trades", o="variant; instrument_id",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    # Two weeks annualize to twelve digits before the point; logs compare across engines.
    df = compare(spark, sf).drop("train_score", "test_score")
    for s in ("full", "train", "test"):
        df = df.withColumn(f"{s}_log_growth", F.log1p(F.col(f"{s}_cagr_pct") / 100)).drop(f"{s}_cagr_pct")
    return df


@query(
    "variant_selection",
    final(
        f"{COMPARE}, vx AS (SELECT *, train_total_return_pct > 0 AND test_total_return_pct > 0 AS g, least(train_score, test_score) AS sc FROM vc), "
        "vy AS (SELECT *, max(g::INT) OVER (PARTITION BY instrument_id) AS ag FROM vx), "
        "vz AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY sc DESC NULLS LAST, variant) AS rk FROM vy WHERE ag = 0 OR g)",
        "vz", i="selection_rank=rk", o="variant; instrument_id; gains_in_both=g", where="rk <= 2",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    best = perf.select_variants(compare(spark, sf), ["instrument_id"], 2)
    return best.select("variant", "instrument_id", "gains_in_both", "selection_rank")


MKEYS = "variant, instrument_id, month"
_RESTART = (
    f"{VARIANTS}vm AS (SELECT *, strftime(t + INTERVAL 10 DAY, '%Y-%m') AS month FROM vh), "
    "en2 AS (SELECT variant, instrument_id, month FROM vm GROUP BY ALL HAVING count(*) >= 30), "
    f"rs AS (SELECT * FROM vm SEMI JOIN en2 USING ({MKEYS})),\n{ledger_sql('rs', MKEYS)}, {summary_sql(MKEYS)}"
)


def restarted(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly restarts; the series is moved by ten days so that it spans two months."""
    shifted = variant_targets(spark, sf)
    moved = shifted.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 10 DAY"))
    rows = perf.monthly_restarts(moved, 30, ["variant", "instrument_id"])
    keys = ["variant", "instrument_id", "month"]
    trades, curve = ledger(spark, sf, materialize(rows), keys)
    return materialize(perf.ledger_summary(curve, trades, keys, starting_balance=CASH))


@query(
    "monthly_strategy_summary",
    final(
        f"{_RESTART}, mr AS (SELECT *, (fe / {CASH} - 1) * 100 AS ret FROM sy), "
        "mz AS (SELECT variant, count(*) AS n, sum((ret > 0)::INT) AS w, avg(ret) AS a, sum(ret) AS s, min(ret) AS lo, max(ret) AS hi, avg(dd) AS dd, avg(sharpe) AS sh, avg(coalesce(fees, 0)) AS fe, avg(coalesce(trades, 0)) AS tr FROM mr GROUP BY ALL)",
        "mz", d="avg_return_pct=a; sum_return_pct=s; worst_month_pct=lo; best_month_pct=hi; avg_drawdown_pct=dd; avg_fees=fe; avg_trades=tr", i="months=n; win_months=w", o="variant",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    # The Sharpe column depends on calendar days, which the shift above moves.
    return perf.strategy_summary(restarted(spark, sf)).drop("avg_sharpe_ratio")


@query(
    "best_strategy_by_month",
    final(
        f"{_RESTART}, mr AS (SELECT *, instrument_id || ':' || variant AS strategy, (fe / {CASH} - 1) * 100 AS ret FROM sy), "
        "mb AS (SELECT month, arg_max(strategy, (ret, strategy)) AS strategy, max(ret) AS ret, arg_max(dd, (ret, strategy)) AS dd FROM mr GROUP BY ALL)",
        "mb", d="total_return_pct=ret; max_drawdown_pct=dd", o="month; strategy",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    monthly = restarted(spark, sf).withColumn(
        "strategy", F.concat_ws(":", "instrument_id", "variant")
    )
    return perf.best_by_month(monthly, "strategy")


# -- smaller reports -----------------------------------------------------------------------
@query(
    "trade_markers",
    final(
        f"{BOOK}, pv AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY {TK} ORDER BY t), 0.0) AS q FROM tp), "
        "mk AS (SELECT instrument_id, time_bucket(INTERVAL '1 day', t) AS m, max(t) AS a, arg_max(p, t) AS p, count(*) AS n FROM pv WHERE p <> q GROUP BY ALL)",
        "mk", d="position=p", i="event_count=n", o="instrument_id; marker_time=m; actual_time=a; action=CASE WHEN p > 0 THEN 'long' WHEN p < 0 THEN 'short' ELSE 'exit' END",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return perf.trade_markers(threshold_book(spark, sf), ["instrument_id"], 1440)


@query(
    "commission_totals",
    final("", "events", d="total=round(value / 100, 4) + 0.25", i="event_id"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    amount = F.concat(F.format_string("%.4f", F.round(F.col("value") / 100, 4)), F.lit(" USDT"))
    items = F.array(amount, F.lit("0.25 USDT"), F.lit("n/a"))
    return table(spark, sf, "events").select(
        "event_id", perf.commission_total(items).cast("double").alias("total")
    )


@query(
    "equity_after_orders",
    final(
        "o AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * 2.0 AS q, round(value, 2) AS p, event_type IN ('click', 'view', 'purchase') AS ok FROM events), "
        "c AS (SELECT *, sum(CASE WHEN ok THEN q * p + 0.1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent, sum(CASE WHEN ok THEN q END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM o)",
        "c", d="equity=CASE WHEN ok THEN 1000 - spent + pos * p END", i="event_id",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(~F.col("event_type").isin("click", "view", "purchase"), "NONE").when(
        F.col("event_id") % 2 == 0, "BUY"
    ).otherwise("SELL")
    orders = table(spark, sf, "events").select(
        "user_id", "event_id", "ts", side.alias("side"), F.lit("2.0").alias("filled_qty"),
        F.format_string("%.2f", F.round("value", 2)).alias("avg_px"),
        F.array(F.lit("0.1 USDT")).alias("commissions"),
    )
    out = perf.equity_after_orders(orders, ["user_id"], ["ts", "event_id"], 1000.0)
    return out.select("event_id", F.col("equity_after_order").cast("double").alias("equity"))


@query(
    "bootstrap_monthly_returns",
    final(
        "o AS (SELECT CAST(o_orderdate AS DATE) AS d, (avg(o_totalprice) / 250000 - 1) / 100 AS r FROM orders GROUP BY 1), "
        "m AS (SELECT row_number() OVER (ORDER BY strftime(d, '%Y-%m')) - 1 AS k, product(1 + r) - 1 AS r FROM o GROUP BY strftime(d, '%Y-%m')), "
        "n AS (SELECT count(*) AS n FROM m), "
        "dr AS (SELECT s, CAST('0x' || substr(md5('7|' || s || '|' || g), 1, 12) AS BIGINT) % n AS k "
        "FROM n, (SELECT unnest(range(500)) AS s), LATERAL (SELECT unnest(range(n)) AS g)), "
        "tot AS (SELECT s, count(*) AS c, product(1 + m.r) - 1 AS r FROM dr JOIN m USING (k) GROUP BY s), "
        "x AS (SELECT max(c) AS months, avg(CAST(r > 0 AS INT)) AS p, avg(r) AS m, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM tot)",
        "x", d="probability_positive=p; mean_return=m; q05_return=lo; q95_return=hi", i="months",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.avg("o_totalprice") / 250_000 - 1).alias("daily_return")
    )
    monthly = perf.calendar_returns(
        o.withColumn("daily_return", F.col("daily_return") / 100), [], "month"
    )
    return perf.bootstrap_summary(perf.bootstrap_monthly(spark, materialize(monthly), 500, 7))


