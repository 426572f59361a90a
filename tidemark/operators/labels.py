"""Forward-return labels, research datasets and time splits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.groups import fits, latest_row, tie_range, with_group_stats
from tidemark.functions.rolling import Series, over_series
from tidemark.functions.scalars import (
    bar_minutes,
    finite,
    minutes_interval,
    ratio,
    shift_time,
    time_literal,
)

BAR_KEYS = ["venue", "instrument_id", "bar_type"]
KEYS = [*BAR_KEYS, "timestamp"]
LABEL_COLUMNS = [
    "label_name", "horizon_bars", "round_trip_cost_bps", "entry_time", "exit_time", "entry_price",
    "exit_price", "gross_return", "net_return", "label_value", "label_is_valid",
    "label_quality_flags",
]


def label_name(horizon: int, cost_bps: float = 0.0) -> str:
    name = f"execution_return_{horizon}bars"
    return f"{name}_cost={cost_bps:g}bps" if cost_bps else name


def label_rows(
    s: Series, horizons: Sequence[int], bar_type: str, cost_bps: float = 0.0, ahead: int = 0,
    has_volume: bool = True,
) -> Column:
    """Array of label structs, one per horizon, for the bar ``ahead`` rows later.

    The h-th row after the entry bar must lie exactly h bars later. Returns over bars that cannot be
    traded stay visible as gross return but give no label. With ``ahead=1`` the entry bar must be the
    next grid slot; otherwise there is no label row and the array is null.
    """
    minutes = bar_minutes(bar_type)

    def at(name: str, n: int) -> Column:
        return s.lead(name, n) if n else F.col(name)

    entry_time = shift_time("timestamp", ahead * minutes) if ahead else F.col("timestamp")
    entry = at("open", ahead).cast("double")
    entry_volume = at("volume", ahead).cast("double") if has_volume else F.lit(1.0)
    items = []
    for h in horizons:
        leave = s.lead("open", h + ahead).cast("double")
        exit_volume = s.lead("volume", h + ahead).cast("double") if has_volume else F.lit(1.0)
        exit_time = shift_time("timestamp", (h + ahead) * minutes)
        priced = finite(entry) & finite(leave) & (entry > 0) & (leave > 0)
        contiguous = F.coalesce(s.lead("timestamp", h + ahead) == exit_time, F.lit(False))
        in_ok = finite(entry_volume) & (entry_volume > 0)
        out_ok = finite(exit_volume) & (exit_volume > 0)
        gross = F.when(priced & contiguous, ratio(leave, entry) - 1)
        valid = F.coalesce(priced & contiguous & in_ok & out_ok, F.lit(False))
        net = F.when(valid, gross - cost_bps / 10_000)
        flags = (
            F.when(leave.isNull(), "MISSING_FUTURE_PRICE")
            .when(~contiguous, "NON_CONTIGUOUS_HORIZON")
            .when(~priced, "INVALID_PRICE")
            .when(~in_ok, "NON_TRADING_ENTRY")
            .when(~out_ok, "NON_TRADING_EXIT")
            .otherwise("")
        )
        made = {
            "label_name": F.lit(label_name(h, cost_bps)),
            "horizon_bars": F.lit(h),
            "round_trip_cost_bps": F.lit(float(cost_bps)),
            "entry_time": entry_time,
            "exit_time": exit_time,
            "entry_price": entry,
            "exit_price": leave,
            "gross_return": gross,
            "net_return": net,
            "label_value": net,
            "label_is_valid": valid,
            "label_quality_flags": flags,
        }
        items.append(F.struct(*[made[n].alias(n) for n in LABEL_COLUMNS]))
    rows = F.array(*items)
    if ahead:
        rows = F.when(s.lead("timestamp", ahead) == entry_time, rows)
    return s.add(rows)


def execution_return(
    bars: DataFrame,
    horizons: Sequence[int],
    bar_type: str,
    *,
    cost_bps: float = 0.0,
    max_rows: int | None = None,
) -> DataFrame:
    """Open-to-open return over h bars for several horizons, one row per bar and horizon."""
    has_volume = "volume" in bars.columns
    base = bars.select(*KEYS, "open", *(["volume"] if has_volume else []))

    def ahead(s: Series) -> dict[str, Column]:
        return {"labels": label_rows(s, horizons, bar_type, cost_bps, has_volume=has_volume)}

    df = over_series(base, BAR_KEYS, ["timestamp"], ahead, max_rows=max_rows)
    return df.select(*KEYS, F.inline("labels"))


def explode_labels(factors: DataFrame) -> DataFrame:
    """Dataset from factor rows that already carry their ``labels`` array."""
    f = factors.withColumnsRenamed(
        {"is_valid": "factor_is_valid", "quality_flags": "factor_quality_flags"}
    )
    keep = [c for c in f.columns if c not in ("labels", "exposures")]
    rows = f.select(*keep, F.inline("labels"))
    return rows.withColumn("is_valid", F.col("factor_is_valid") & F.col("label_is_valid"))


def build_dataset(factors: DataFrame, labels: DataFrame) -> DataFrame:
    """Factor rows joined to label rows at equal times; valid where both sides are."""
    f = factors.withColumnsRenamed(
        {"is_valid": "factor_is_valid", "quality_flags": "factor_quality_flags"}
    )
    joined = f.join(labels, KEYS)
    return joined.withColumn("is_valid", F.col("factor_is_valid") & F.col("label_is_valid"))


def valid_rows(dataset: DataFrame) -> DataFrame:
    return dataset.where(F.col("is_valid"))


def purged_time_split(dataset: DataFrame, at: datetime, embargo_minutes: int = 0):
    """Training rows whose labels ended before ``at``; validation rows after the embargo."""
    t = time_literal(at)
    train = dataset.where(F.col("exit_time") < t)
    return train, dataset.where(F.col("timestamp") >= t + minutes_interval(embargo_minutes))


def factors_wide(factors: DataFrame, names: Sequence[str], value: str = "value") -> DataFrame:
    """One column per factor. Names are given, so no extra job looks them up."""
    return factors.groupBy(*KEYS).pivot("factor_name", list(names)).agg(F.first(value))


def dataset_wide(dataset: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """Factor columns next to the rows of one label."""
    rows = dataset.where(F.col("label_name") == label)
    features = factors_wide(rows, names)
    labels = latest_row(rows.select(*KEYS, *LABEL_COLUMNS), KEYS, ["exit_time"])
    return features.join(labels, KEYS, "left")


def funding_returns(
    bars: DataFrame,
    horizon: int,
    minutes: int,
    *,
    keys: Sequence[str] = ("venue", "instrument_id"),
    max_rows: int | None = None,
) -> DataFrame:
    """Open-to-open return over h bars, with and without the funding a long position pays."""
    if horizon <= 0:
        raise ValueError(f"no return over {horizon} bars")

    def ahead(s: Series) -> dict[str, Column]:
        cash = F.coalesce(F.col("funding_cashflow"), F.lit(0.0))
        paid = F.sum(cash).over(s.window.rowsBetween(1, horizon))
        return {
            "_exit_price": s.lead("open", horizon),
            "_seen_exit": s.lead("timestamp", horizon),
            "_paid": s.add(paid, back=0, ahead=horizon),
        }

    df = over_series(bars, keys, ["timestamp"], ahead, max_rows=max_rows)
    exit_time = shift_time("timestamp", horizon * minutes)
    whole = F.coalesce(F.col("_seen_exit") == exit_time, F.lit(False))
    plain = F.when(whole, ratio("_exit_price", "open") - 1)
    paid = F.when(whole, F.coalesce("_paid", F.lit(0.0)))
    net = plain - paid
    return df.select(
        *bars.columns,
        exit_time.alias("exit_time"),
        whole.alias("return_is_valid"),
        paid.alias("funding_paid"),
        plain.alias("rets_without_funding"),
        net.alias("rets_with_funding"),
        F.when(plain > -1, F.log1p(plain)).alias("log_rets_without_funding"),
        F.when(net > -1, F.log1p(net)).alias("log_rets_with_funding"),
    )


def cross_section_quantile(
    df: DataFrame, value: str, quantiles: int, out: str = "quantile", *,
    by: Sequence[str] = ("timestamp",), bounded: bool | None = None,
) -> DataFrame:
    """Ordinal rank per time mapped to 1..Q by ceil(rank * Q / n); nulls stay unranked."""
    if bounded is None:
        bounded = fits(df, by)
    bucket = F.ceil(F.col("_r") * F.lit(quantiles) / F.col("_size")).cast("int")
    if bounded:
        w = Window.partitionBy(*by)
        o = w.orderBy(F.col(value).asc_nulls_last(), "instrument_id")
        seen = df.withColumns({"_r": F.row_number().over(o), "_size": F.count(value).over(w)})
        found = F.when(F.col(value).isNotNull(), bucket)
        return seen.withColumn(out, found).drop("_r", "_size")
    ranked = tie_range(
        df.where(F.col(value).isNotNull()), by, [value, "instrument_id"], first="_r", bounded=False
    )
    kept = ranked.withColumn(out, bucket).drop("_r", "_last", "_size")
    empty = df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("int"))
    return kept.unionByName(empty)


def demean_zscore(
    df: DataFrame, value: str, by: Sequence[str] = ("timestamp",), *, bounded: bool | None = None
) -> DataFrame:
    """Cross-sectional mean removal and z-score."""
    stats = {"_mean": F.avg(value), "_std": F.stddev_samp(value)}
    got = with_group_stats(df, by, stats, bounded=bounded)
    away = F.col(value) - F.col("_mean")
    z = F.when(F.col("_std") > 0, ratio(away, "_std"))
    return got.withColumns({f"{value}_demeaned": away, f"{value}_z": z}).drop("_mean", "_std")


def base_panel(
    bars: DataFrame,
    funding: DataFrame,
    *,
    keys: Sequence[str] = ("venue", "instrument_id"),
    max_rows: int | None = None,
) -> DataFrame:
    """Bars with funding: the rate carried forward, the cash flow zero where none is due."""
    on = [*keys, "timestamp"]
    joined = bars.join(funding.select(*on, "funding_rate"), on, "left")
    return over_series(
        joined,
        keys,
        ["timestamp"],
        lambda s: {
            "carry": s.fill("funding_rate"),
            "funding_cashflow": F.coalesce("funding_rate", F.lit(0.0)),
        },
        max_rows=max_rows,
    )


