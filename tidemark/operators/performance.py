"""Ledgers, wealth curves, calendar returns, allocation and parameter studies.

Return and wealth series hold one row per strategy key and period, so windows over them are bounded
by the number of periods. Ledgers run over bars per (variant, instrument).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.groups import running_totals
from tidemark.functions.rolling import Series, over_series, series_bound
from tidemark.functions.scalars import (
    corr_safe,
    day_start,
    floor_time,
    ratio,
    time_literal,
)
from tidemark.operators.grid import boundaries_inside, common_timeline, dense_grid

YEAR_SECONDS = 365.25 * 24 * 3600


# -- daily wealth --------------------------------------------------------------------------
def interval_daily_wealth(
    portfolio: DataFrame, bars: DataFrame, keys: Sequence[str], cost_multiplier: float = 1.0,
    max_rows: int | None = None,
) -> DataFrame:
    """Wealth at each UTC midnight, marking the open interval to market.

    A midnight on an exit belongs to the interval that ends there.
    """
    keys = list(keys)
    stressed = F.col("portfolio_return") - (cost_multiplier - 1.0) * F.col("transaction_cost")

    def make(s: Series) -> dict[str, Column]:
        wealth = s.cumprod(s.add(1 + stressed))
        return {"_base": F.coalesce(s.lag(wealth), F.lit(1.0)), "_left": s.lag("exit_time")}

    base = over_series(portfolio, keys, ["timestamp"], make, max_rows=max_rows)
    marks = boundaries_inside(base)
    # An entry at midnight is marked there unless the previous interval ends on it.
    at_entry = base.where(
        (day_start("timestamp") == F.col("timestamp"))
        & (F.col("_left").isNull() | (F.col("_left") < F.col("timestamp")))
    )
    marks = marks.unionByName(at_entry.withColumn("boundary", F.col("timestamp")))
    price = bars.select("instrument_id", "timestamp", "open")
    joined = marks.join(
        price.withColumnRenamed("open", "_entry"), ["instrument_id", "timestamp"]
    ).join(
        price.withColumnsRenamed({"timestamp": "boundary", "open": "_now"}),
        ["instrument_id", "boundary"],
    )
    cost = F.col("transaction_cost") * cost_multiplier
    gain = F.col("position") * (ratio("_now", "_entry") - 1) - cost
    return joined.select(
        *keys, F.col("boundary").alias("date"), (F.col("_base") * (1 + gain)).alias("wealth")
    )


def streaming_daily_wealth(
    portfolio: DataFrame, keys: Sequence[str], cost_multiplier: float = 1.0,
    max_rows: int | None = None,
) -> DataFrame:
    """Last compounded wealth of each day, stamped with the following midnight."""
    r = F.col("portfolio_return") - (cost_multiplier - 1.0) * F.col("transaction_cost")
    df = over_series(
        portfolio, keys, ["timestamp"], lambda s: {"_wealth": s.cumprod(s.add(1 + r))}, max_rows=max_rows
    )
    next_day = day_start("timestamp") + F.expr("INTERVAL 1 DAY")
    return df.groupBy(*keys, next_day.alias("date")).agg(
        F.max_by("_wealth", "timestamp").alias("wealth")
    )


def aligned_daily_returns(wealth: DataFrame, by: str) -> DataFrame:
    """Daily returns of each curve over the dates all curves share."""
    shared = common_timeline(wealth, by, ["date"])
    s = Series(shared, [by], ["date"])
    change = ratio("wealth", s.lag("wealth")) - 1
    return s.build({"daily_return": change}, [by, "date"]).where(F.col("daily_return").isNotNull())


def equal_weight_daily_wealth(wealth: DataFrame, by: str, over: Sequence[str] = ()) -> DataFrame:
    """Curve of the equally weighted, daily rebalanced sleeves; it starts at 1."""
    shared = common_timeline(wealth, by, [*over, "date"])
    s = Series(shared, [*over, by], ["date"])
    moved = s.build({"_r": ratio("wealth", s.lag("wealth")) - 1})
    daily = moved.groupBy(*over, "date").agg(F.avg("_r").alias("_r"))
    t = Series(daily.withColumn("_one", F.lit(1)), [*over, "_one"], ["date"])
    growth = t.cumprod(t.add(1 + F.coalesce(F.col("_r"), F.lit(0.0))))
    return t.build({"wealth": growth}, [*over, "date"])


# -- return statistics ---------------------------------------------------------------------
def performance(
    returns: DataFrame, keys: Sequence[str], value: str = "daily_return",
    on: str = "date", per_year: float = 365.25,
) -> DataFrame:
    """Days, total and annual return, Sharpe and drawdown per key."""
    s = Series(returns, keys, [on])
    wealth = s.cumprod(s.add(1 + F.col(value)))
    fall = wealth / F.greatest(s.cummax(wealth), F.lit(1.0)) - 1
    df = s.build({"_fall": fall}, [*keys, value])
    total, n = F.product(1 + F.col(value)), F.count(F.lit(1))
    std = F.stddev_samp(value)
    annual = F.when(total > 0, F.pow(total, F.lit(per_year) / n) - 1).otherwise(-1.0)
    sharpe = F.when(std > 0, ratio(F.avg(value), std) * F.sqrt(F.lit(per_year))).otherwise(0.0)
    return df.groupBy(*keys).agg(
        n.alias("days"),
        (total - 1).alias("total_return"),
        annual.alias("annual_return"),
        sharpe.alias("sharpe"),
        F.least(F.min("_fall"), F.lit(0.0)).alias("max_drawdown"),
    )


def calendar_returns(
    returns: DataFrame, keys: Sequence[str], period: str, value: str = "daily_return",
    on: str = "date", least: int = 1,
) -> DataFrame:
    """Compounded return per month, half-year or year with at least ``least`` rows."""
    year = F.year(on).cast("string")
    half = F.concat(year, F.when(F.month(on) <= 6, "-H1").otherwise("-H2"))
    label = {"month": F.date_format(on, "yyyy-MM"), "half_year": half, "year": year}[period]
    out = returns.groupBy(*keys, label.alias("period")).agg(
        (F.product(1 + F.col(value)) - 1).alias("period_return"), F.count(F.lit(1)).alias("days")
    )
    return out.where(F.col("days") >= least)


def period_comparison(
    returns: DataFrame, keys: Sequence[str], split: datetime, value: str = "daily_return",
    on: str = "date",
) -> DataFrame:
    """Performance over the full, development and holdout parts in one pass."""
    early = F.col(on) < time_literal(split)
    tags = F.array(F.lit("full"), F.when(early, "development").otherwise("holdout"))
    tagged = returns.withColumn("period", F.explode(tags))
    return performance(tagged, [*keys, "period"], value, on)


def daily_equity_sharpe(curve: DataFrame, keys: Sequence[str], per_year: int = 252) -> DataFrame:
    """Sharpe of daily equity changes: last value per day, missing days carried forward."""
    daily = curve.groupBy(*keys, day_start("timestamp").alias("timestamp")).agg(
        F.max_by("equity", "timestamp").alias("equity")
    )
    filled = dense_grid(daily, keys, 1440, ["equity"])
    s = Series(filled, keys, ["timestamp"])
    changes = s.build({"_r": ratio("equity", s.lag("equity")) - 1}, keys)
    std = F.stddev_samp("_r")
    sharpe = F.when(
        (F.count("_r") >= 2) & (std > 0), ratio(F.avg("_r"), std) * F.sqrt(F.lit(float(per_year)))
    ).otherwise(0.0)
    return changes.groupBy(*keys).agg(sharpe.alias("sharpe_ratio"))


# -- allocation ----------------------------------------------------------------------------
def weight_grid(spark: SparkSession, sleeves: Sequence[str], units: int) -> DataFrame:
    """Every split of 1 into multiples of 1/units, one row per split with an array of weights.

    The table grows with the number of splits, never with the data.
    """
    grid = spark.range(1).select(F.array().cast("array<int>").alias("u"), F.lit(0).alias("used"))
    for _ in sleeves[:-1]:
        grid = grid.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(units) - F.col("used"))))
        grid = grid.select(
            F.concat("u", F.array("n")).alias("u"), (F.col("used") + F.col("n")).alias("used")
        )
    full = F.concat("u", F.array(F.lit(units) - F.col("used")))
    return grid.select(F.transform(full, lambda n: n / F.lit(float(units))).alias("weights"))


# Weight splits of a block that one row carries.
GRID_BLOCK = 1_024


def weight_grid_screen(
    daily: DataFrame,
    sleeves: Sequence[str],
    units: int,
    *,
    bounds: Mapping[str, tuple[float, float]] | None = None,
    leverage: float = 1.0,
    development_end: datetime | None = None,
    least_days: int = 150,
) -> DataFrame:
    """Rank sleeve weights by half-year consistency.

    ``daily`` has one row per date and a column per sleeve. Grid and dates meet as two keyed tables: the grid is
    dealt over blocks of about ``GRID_BLOCK`` splits, each date is sent to every block, and neither side is broadcast whole.
    """
    spark = daily.sparkSession
    grid = weight_grid(spark, sleeves, units)
    names = [f"{n}_weight" for n in sleeves]
    grid = grid.select(*[F.element_at("weights", i + 1).alias(n) for i, n in enumerate(names)])
    for sleeve, (low, high) in (bounds or {}).items():
        grid = grid.where(F.col(f"{sleeve}_weight").between(low, high))
    if development_end is not None:
        daily = daily.where(F.col("date") < time_literal(development_end))
    mixed = F.lit(0.0)
    for sleeve, n in zip(sleeves, names, strict=True):
        mixed = mixed + F.col(n) * F.col(sleeve)
    splits = comb(units + len(sleeves) - 1, len(sleeves) - 1)
    blocks_of_grid = -(-splits // GRID_BLOCK)
    grid = grid.withColumn("_block", F.pmod(F.xxhash64(*names), F.lit(blocks_of_grid)))
    grid = grid.groupBy("_block").agg(F.array_agg(F.struct(*names)).alias("_grid"))
    dealt = daily.select("date", *sleeves, F.explode(F.sequence(F.lit(0), F.lit(blocks_of_grid - 1))).alias("_block"))
    dealt = dealt.withColumn("_block", F.col("_block").cast("long"))
    expanded = dealt.hint("shuffle_hash").join(grid, "_block").select("date", *sleeves, F.inline("_grid"))
    returns = expanded.select(*names, "date", (mixed * leverage).alias("daily_return"))
    blocks = calendar_returns(returns, names, "half_year", least=least_days)
    halves = blocks.groupBy(*names).agg(
        F.min("period_return").alias("worst_half_return"),
        F.avg((F.col("period_return") > 0).cast("double")).alias("positive_half_rate"),
    )
    return performance(returns, names).join(halves, names, "left")


def adaptive_allocation(
    daily: DataFrame,
    weights: Mapping[str, float],
    watched: str,
    *,
    lookback: int,
    losing_scale: float,
    transfer_to: str,
    leverage: float = 1.0,
    one_way_cost: float = 0.0,
) -> DataFrame:
    """Scale a sleeve down while its trailing compound return is negative; pay for the moves."""
    one = daily.withColumn("_one", F.lit(1))
    s = Series(one, ["_one"], ["date"])
    past = s.window.rowsBetween(-lookback, -1)
    trailing = s.add(F.product(1 + F.col(watched)).over(past) - 1)
    losing = s.add((s.position() > lookback) & (trailing < 0))
    released = weights[watched] * (1 - losing_scale)
    made: dict[str, Column] = {}
    for sleeve, base in weights.items():
        low = base
        if sleeve == watched:
            low = base * losing_scale
        elif sleeve == transfer_to:
            low = base + released
        made[sleeve] = s.add(F.when(losing, F.lit(float(low))).otherwise(F.lit(float(base))))
    moved, gross = F.lit(0.0), F.lit(0.0)
    for sleeve, w in made.items():
        moved = moved + F.abs(w - F.coalesce(s.lag(w), F.lit(float(weights[sleeve]))))
        gross = gross + w * F.col(sleeve)
    cost = moved * (leverage * one_way_cost)
    out = {f"{n}_weight": w for n, w in made.items()}
    out |= {"allocation_cost": cost, "daily_return": gross * leverage - cost}
    return s.build(out, ["date"])


# -- ledger --------------------------------------------------------------------------------
def _stints(bars: DataFrame, keys: Sequence[str], max_rows: int | None) -> DataFrame:
    """Bars with the position held (the target of the previous bar) and its stint number."""

    def make(s: Series) -> dict[str, Column]:
        side = s.add(F.coalesce(s.lag("target"), F.lit(0)))
        begins = s.add(
            F.when((side != 0) & (side != F.coalesce(s.lag(side), F.lit(0))), 1).otherwise(0)
        )
        return {
            "_side": side,
            "_stint": s.cumsum(begins).cast("long"),
            "_bar": s.position(),
            "_next_open": s.lead("open"),
            "_next_time": s.lead("timestamp"),
        }

    return over_series(bars, keys, ["timestamp"], make, max_rows=max_rows)


def trade_ledger(
    bars: DataFrame, keys: Sequence[str], *, fee_rate: float, starting_balance: float,
    max_rows: int | None = None,
) -> DataFrame:
    """All-in trades filled at the next open, fees on both legs, flips closed and reopened.

    With sizing all-in, a trade multiplies equity by a factor of its entry and exit price, so equity
    is a running product over trades and no bar loop is needed. ``max_rows`` is a known bound on bars per
    series; longer ones are cut, with the same result.
    """
    keys = list(keys)
    if max_rows is None:
        max_rows = series_bound(bars, keys)
    held = _stints(bars, keys, max_rows).where(F.col("_side") != 0)
    b, e = F.col("_bar"), F.col("timestamp")
    is_open = F.col("_next_time").isNull()
    trades = held.groupBy(*keys, F.col("_stint").alias("trade_id")).agg(
        F.min("_side").alias("_side"),
        F.min(e).alias("entry_time"),
        F.min_by("open", e).alias("entry_price"),
        F.max_by(F.coalesce("_next_time", e), e).alias("exit_time"),
        F.max_by(F.coalesce("_next_open", F.col("close")), e).alias("exit_price"),
        F.max_by(is_open, e).alias("closed_at_end"),
        (F.max(b + F.when(is_open, 0).otherwise(1)) - F.min(b)).alias("holding_bars"),
    )
    r = ratio("exit_price", "entry_price")
    factor = 1 - fee_rate + F.col("_side") * (r - 1) - fee_rate * r

    def make(s: Series) -> dict[str, Column]:
        grown = s.cumprod(s.add(factor))
        entry_equity = s.add(F.lit(float(starting_balance)) * F.coalesce(s.lag(grown), F.lit(1.0)))
        return {
            "side": F.when(F.col("_side") > 0, "long").otherwise("short"),
            "entry_equity": entry_equity,
            "pnl": entry_equity * (factor - 1),
            "return_pct": (factor - 1) * 100,
            "fees": entry_equity * fee_rate * (1 + r),
        }

    kept = ["trade_id", "entry_time", "exit_time", "entry_price", "exit_price", "closed_at_end", "holding_bars"]
    return over_series(trades, keys, ["trade_id"], make, [*keys, *kept], max_rows=max_rows)


def equity_curve(
    bars: DataFrame, trades: DataFrame, keys: Sequence[str], *, fee_rate: float,
    starting_balance: float, max_rows: int | None = None,
) -> DataFrame:
    """Equity at each close; the final bar shows it after closing an open position."""
    keys = list(keys)
    df = _stints(bars, keys, max_rows)
    t = trades.select(
        *keys, F.col("trade_id").alias("_stint"), F.col("entry_price").alias("_in"),
        F.col("entry_equity").alias("_start"), (F.col("entry_equity") + F.col("pnl")).alias("_done"),
    )
    got = df.join(t, [*keys, "_stint"], "left")
    inside = F.col("_side") != 0
    final = inside & F.col("_next_time").isNull()
    marked = F.col("_start") * (1 - fee_rate + F.col("_side") * (ratio("close", "_in") - 1))
    flat = F.coalesce("_done", F.lit(float(starting_balance)))
    equity = F.when(final, F.col("_done")).when(inside, marked).otherwise(flat)
    return got.select(
        *keys, "timestamp", "open", "close",
        F.when(final, 0).otherwise(F.col("_side")).alias("held"),
        equity.alias("equity"),
    )


def _max_fall(df: DataFrame, keys: Sequence[str], start: Column) -> DataFrame:
    """``_fall``: equity below its running peak, which starts at ``start``."""
    return over_series(
        df, keys, ["timestamp"], lambda s: {"_fall": ratio("equity", F.greatest(s.cummax("equity"), start)) - 1}
    )


def ledger_summary(
    curve: DataFrame, trades: DataFrame, keys: Sequence[str], *, starting_balance: float
) -> DataFrame:
    """Return, drawdown, Sharpe, win rate, profit factor and sides per key."""
    keys, base = list(keys), F.lit(float(starting_balance))
    falls = _max_fall(curve, keys, base)
    seconds = F.timestamp_diff("SECOND", F.min("timestamp"), F.max("timestamp"))
    years = F.greatest(seconds / F.lit(YEAR_SECONDS), F.lit(1 / 365.25))
    final = F.max_by("equity", "timestamp")
    paths = falls.groupBy(*keys).agg(
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.count(F.lit(1)).alias("bars"),
        final.alias("final_equity"),
        ((final / base - 1) * 100).alias("total_return_pct"),
        ((F.pow(final / base, 1 / years) - 1) * 100).alias("cagr_pct"),
        (-F.least(F.min("_fall"), F.lit(0.0)) * 100).alias("max_drawdown_pct"),
    )
    pnl, side = F.col("pnl"), F.col("side")
    won = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0))
    lost = F.coalesce(-F.sum(F.when(pnl < 0, pnl)), F.lit(0.0))
    zero = F.lit(0.0)
    deals = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        (F.avg((pnl > 0).cast("double")) * 100).alias("win_rate_pct"),
        F.when(lost > 0, ratio(won, lost)).when(won > 0, F.lit(float("inf"))).otherwise(0.0).alias(
            "profit_factor"
        ),
        F.sum("fees").alias("total_fees"),
        F.sum((side == "long").cast("long")).alias("long_trades"),
        F.coalesce(F.sum(F.when(side == "long", pnl)), zero).alias("long_pnl"),
        F.sum((side == "short").cast("long")).alias("short_trades"),
        F.coalesce(F.sum(F.when(side == "short", pnl)), zero).alias("short_pnl"),
    )
    sharpe = daily_equity_sharpe(curve, keys)
    out = paths.join(deals, keys, "left").join(sharpe, keys, "left")
    return out.fillna(
        0, ["trades", "win_rate_pct", "profit_factor", "total_fees", "long_trades", "long_pnl",
            "short_trades", "short_pnl"]
    )


def period_results(
    curve: DataFrame, keys: Sequence[str], *, starting_balance: float, period: str = "month",
    bars_per_year: float = 6 * 365,
) -> DataFrame:
    """Chained strategy returns next to price path statistics per calendar period."""
    keys = list(keys)
    label = F.date_format("timestamp", "yyyy-MM" if period == "month" else "yyyy")
    df = curve.withColumn("period", label)
    s = Series(df, [*keys, "period"], ["timestamp"])
    change = ratio("close", s.lag("close")) - 1
    first = s.add(F.first("equity").over(s.window))
    df = s.build({"_change": change, "_peak": s.cummax("equity"), "_open_equity": first})
    ends = df.groupBy(*keys, "period").agg(F.max_by("equity", "timestamp").alias("end_equity"))
    chain = Series(ends, keys, ["period"])
    ends = chain.build(
        {"_previous": F.coalesce(chain.lag("end_equity"), F.lit(float(starting_balance)))}
    )
    got = df.join(ends.select(*keys, "period", "_previous"), [*keys, "period"])
    fall = ratio("equity", F.greatest("_peak", "_previous")) - 1
    price = F.max_by("close", "timestamp") / F.min_by("open", "timestamp") - 1
    path = F.sum(F.abs("_change"))
    vol = F.coalesce(F.stddev_samp("_change"), F.lit(0.0)) * F.sqrt(F.lit(float(bars_per_year)))
    end, before = F.max_by("equity", "timestamp"), F.max("_previous")
    return got.withColumn("_fall", fall).groupBy(*keys, "period").agg(
        ((end / before - 1) * 100).alias("strategy_return_pct"),
        end.alias("end_equity"),
        (-F.least(F.min("_fall"), F.lit(0.0)) * 100).alias("max_drawdown_pct"),
        (price * 100).alias("price_return_pct"),
        F.coalesce(F.when(path > 0, F.abs(price) / path), F.lit(0.0)).alias("path_efficiency"),
        (vol * 100).alias("realized_vol_pct"),
        F.count(F.lit(1)).alias("bars"),
    )


def regime_results(monthly: DataFrame) -> DataFrame:
    """Monthly results by tercile of path efficiency and by price direction."""
    # One row per key and month: the whole table is a few thousand rows.
    w = Window.orderBy("path_efficiency", *[c for c in monthly.columns if c != "path_efficiency"])
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    r = F.row_number().over(w)
    place = (r - 1) / (n - 1)
    eff = (
        F.when(place <= 1 / 3, "choppy_low").when(place <= 2 / 3, "mixed_mid").otherwise(
            "trending_high"
        )
    )
    p = F.col("price_return_pct")
    way = (
        F.when(p <= -10, "down_below_-10pct").when(p <= 10, "range_-10_to_10pct").otherwise(
            "up_above_10pct"
        )
    )
    tags = F.array(
        F.struct(F.lit("efficiency_regime").alias("dimension"), F.col("_eff").alias("regime")),
        F.struct(F.lit("direction_regime").alias("dimension"), F.col("_way").alias("regime")),
    )
    tall = monthly.withColumns({"_eff": eff, "_way": way}).select(*monthly.columns, F.inline(tags))
    return tall.groupBy("dimension", "regime").agg(
        F.count(F.lit(1)).alias("months"),
        F.sum((F.col("strategy_return_pct") > 0).cast("long")).alias("profitable_months"),
        F.avg("strategy_return_pct").alias("avg_strategy_return_pct"),
        F.percentile("strategy_return_pct", 0.5).alias("median_strategy_return_pct"),
        F.avg("price_return_pct").alias("avg_price_return_pct"),
        F.avg("path_efficiency").alias("avg_path_efficiency"),
        F.avg("realized_vol_pct").alias("avg_realized_vol_pct"),
    )


def regime_correlations(monthly: DataFrame) -> DataFrame:
    r = "strategy_return_pct"
    return monthly.agg(
        corr_safe(r, "path_efficiency").alias("strategy_vs_path_efficiency"),
        corr_safe(r, F.abs("price_return_pct")).alias("strategy_vs_abs_price_return"),
        corr_safe(r, "realized_vol_pct").alias("strategy_vs_realized_vol"),
    )


def trades_by_year_side(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    pnl = F.col("pnl")
    return trades.groupBy(*keys, F.year("exit_time").alias("year"), "side").agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum((pnl > 0).cast("long")).alias("wins"),
        F.sum(pnl).alias("pnl"),
        F.avg("return_pct").alias("avg_return_pct"),
        F.avg("holding_bars").alias("avg_holding_bars"),
    )


# -- parameter studies ---------------------------------------------------------------------
def split_segments(bars: DataFrame, split: datetime) -> DataFrame:
    """Every bar in the full segment and in either train or test, as a key column."""
    tag = F.when(F.col("timestamp") < time_literal(split), "train").otherwise("test")
    return bars.withColumn("segment", F.explode(F.array(F.lit("full"), tag)))


def variant_comparison(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per variant with full, train and test numbers; score is return over drawdown."""
    names = ["total_return_pct", "cagr_pct", "max_drawdown_pct", "sharpe_ratio", "trades"]
    wide = summaries.groupBy(*keys).pivot("segment", ["full", "train", "test"]).agg(
        *[F.first(n).alias(n) for n in names]
    )
    for part in ("train", "test"):
        score = F.col(f"{part}_cagr_pct") / F.greatest(f"{part}_max_drawdown_pct", F.lit(1e-9))
        wide = wide.withColumn(f"{part}_score", score)
    return wide


def select_variants(
    comparison: DataFrame, by: Sequence[str] = (), top: int = 50
) -> DataFrame:
    """Variants that gain in both segments (all if none do), best worst-segment score first."""
    both = (F.col("train_total_return_pct") > 0) & (F.col("test_total_return_pct") > 0)
    part = [*by] or [F.lit(0)]
    w = Window.partitionBy(*part)
    # One row per variant; the grid of variants is fixed by the study.
    scored = comparison.withColumns(
        {
            "gains_in_both": F.coalesce(both, F.lit(False)),
            "selection_score": F.least("train_score", "test_score"),
        }
    ).withColumn("_any", F.max(F.col("gains_in_both").cast("int")).over(w))
    kept = scored.where((F.col("_any") == 0) | F.col("gains_in_both")).drop("_any")
    order = [F.col("selection_score").desc_nulls_last()]
    order += [F.col(c) for c in comparison.columns if c not in by][:3]
    ranked = kept.withColumn("selection_rank", F.row_number().over(w.orderBy(*order)))
    return ranked.where(F.col("selection_rank") <= top)


def strategy_summary(monthly: DataFrame, by: str = "variant") -> DataFrame:
    """Monthly restarts summarized per strategy."""
    r = F.col("total_return_pct")
    return monthly.groupBy(by).agg(
        F.count(F.lit(1)).alias("months"),
        F.sum((r > 0).cast("long")).alias("win_months"),
        F.avg(r).alias("avg_return_pct"),
        F.sum(r).alias("sum_return_pct"),
        F.min(r).alias("worst_month_pct"),
        F.max(r).alias("best_month_pct"),
        F.avg("max_drawdown_pct").alias("avg_drawdown_pct"),
        F.avg("sharpe_ratio").alias("avg_sharpe_ratio"),
        F.avg("total_fees").alias("avg_fees"),
        F.avg("trades").alias("avg_trades"),
    )


def best_by_month(monthly: DataFrame, by: str = "variant") -> DataFrame:
    best = F.max_by(
        F.struct(by, "total_return_pct", "max_drawdown_pct"), F.struct("total_return_pct", by)
    )
    return monthly.groupBy("month").agg(best.alias("_b")).select("month", "_b.*")


def monthly_restarts(bars: DataFrame, least: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Bars keyed by month, months with too few bars left out."""
    df = bars.withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    enough = df.groupBy(*keys, "month").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") >= least
    )
    return df.join(enough.drop("_n"), [*keys, "month"], "left_semi")


# -- smaller reports -----------------------------------------------------------------------
def trade_markers(portfolio: DataFrame, keys: Sequence[str], minutes: int) -> DataFrame:
    """Position changes truncated to the chart bar; the last one per bar is shown."""
    s = Series(portfolio, keys, ["timestamp"])
    before = F.coalesce(s.lag("position"), F.lit(0.0))
    changed = s.build({"_before": before}).where(F.col("position") != F.col("_before"))
    shown = changed.groupBy(*keys, floor_time("timestamp", minutes).alias("marker_time")).agg(
        F.max("timestamp").alias("actual_time"),
        F.max_by("position", "timestamp").alias("position"),
        F.count(F.lit(1)).alias("event_count"),
    )
    p = F.col("position")
    return shown.withColumn(
        "action", F.when(p > 0, "long").when(p < 0, "short").otherwise("exit")
    )


def commission_total(c: str | Column) -> Column:
    """Sum of amounts in a list of texts such as ``0.1 USDT``; unreadable items count as 0."""
    amounts = F.transform(
        F.col(c) if isinstance(c, str) else c,
        lambda t: F.coalesce(
            F.split(F.trim(t), r"\s+")[0].try_cast("decimal(38,10)"),
            F.lit(0).cast("decimal(38,10)"),
        ),
    )
    zero = F.lit(0).cast("decimal(38,10)")
    total = F.aggregate(amounts, zero, lambda a, b: (a + b).cast("decimal(38,10)"))
    return F.coalesce(total, zero)


def equity_after_orders(
    orders: DataFrame, keys: Sequence[str], order: Sequence[str], starting_balance: float,
    *, bounded: bool | None = None,
) -> DataFrame:
    """Cash, position and equity after each filled order, as running sums per account."""
    money = "decimal(38,10)"
    size, price = F.col("filled_qty").try_cast("decimal(18,8)"), F.col("avg_px").try_cast("decimal(18,8)")
    side = F.upper("side")
    filled = side.isin("BUY", "SELL") & size.isNotNull() & price.isNotNull()
    signed = F.when(side == "BUY", size).otherwise(-size)
    totals = {
        "_position": F.when(filled, signed),
        "_spent": F.when(filled, (signed * price).cast(money) + commission_total("commissions")),
    }
    df = running_totals(orders, keys, order, totals, bounded=bounded)
    cash = F.lit(starting_balance).cast(money) - F.coalesce("_spent", F.lit(0).cast(money))
    position = F.col("_position").cast("decimal(18,8)")
    equity = F.when(filled, cash + (position * price).cast(money)).cast(money)
    return df.withColumn("equity_after_order", equity).select(*orders.columns, "equity_after_order")


def bootstrap_monthly(
    spark: SparkSession, monthly: DataFrame, samples: int, seed: int, value: str = "period_return"
) -> DataFrame:
    """Resampled compound returns: months drawn by a seeded hash, not by a task's generator.

    The month table is small by nature (one row per calendar month) and is numbered once.
    """
    numbered = monthly.select(
        (F.row_number().over(Window.orderBy("period")) - 1).alias("_k"), F.col(value).alias("_r")
    )
    months = numbered.agg(F.count(F.lit(1)).alias("_n"))
    draws = spark.range(samples).withColumnRenamed("id", "sample").crossJoin(F.broadcast(months))
    draws = draws.select(
        "sample", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("draw")
    )
    text = F.concat_ws("|", F.lit(str(seed)), F.col("sample").cast("string"), F.col("draw").cast("string"))
    pick = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") % F.col("_n")
    drawn = draws.withColumn("_k", pick).join(F.broadcast(numbered), "_k")
    return drawn.groupBy("sample").agg(
        F.count(F.lit(1)).alias("months"), (F.product(1 + F.col("_r")) - 1).alias("total_return")
    )


def bootstrap_summary(draws: DataFrame) -> DataFrame:
    r = F.col("total_return")
    return draws.agg(
        F.max("months").alias("months"),
        F.avg((r > 0).cast("double")).alias("probability_positive"),
        F.avg(r).alias("mean_return"),
        F.percentile(r, 0.05).alias("q05_return"),
        F.percentile(r, 0.95).alias("q95_return"),
    )


def phase_offsets(df: DataFrame, horizon: int, step: int) -> DataFrame:
    """Copies of the rows for staggered starts; the phase becomes a key."""
    phases = F.explode(F.sequence(F.lit(0), F.lit(horizon - 1), F.lit(step)))
    return df.withColumn("phase", phases)


