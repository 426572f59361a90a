"""Factor cleaning: outliers, standardization, neutralization.

Cross-sections are keyed by (factor, time) and may hold any number of instruments: their statistics
are aggregates joined back, their ranks and medians come from ``functions.groups``. Time-series
steps are row windows per (factor, venue, instrument).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.groups import average_rank, fits, with_group_stats, with_quantiles
from tidemark.functions.moments import group_betas
from tidemark.functions.rolling import Series, over_series
from tidemark.functions.scalars import add_flag, clip, finite, ratio
from tidemark.session import materialize

CROSS_KEYS = ["factor_name", "timestamp"]
TIME_KEYS = ["factor_name", "venue", "instrument_id"]
MAD_SCALE = 1.4826


def mark_non_finite(df: DataFrame) -> DataFrame:
    """Start the cleaned value: null, invalid and flagged where the raw value is unusable."""
    good = finite("raw_value")
    return df.withColumns(
        {
            "value": F.when(good, F.col("raw_value")),
            "is_valid": good,
            "quality_flags": F.when(good, "").otherwise("NON_FINITE_RAW_VALUE"),
        }
    )


def _with_median(df: DataFrame, keys: Sequence[str], value: str, out: str, bounded: bool):
    return with_quantiles(df, keys, value, {out: 0.5}, bounded=bounded)


def _with_mad(df: DataFrame, keys: Sequence[str], bounded: bool) -> DataFrame:
    """Group median as ``_center`` and median absolute deviation as ``_mad``."""
    df = _with_median(df, keys, "value", "_center", bounded)
    df = df.withColumn("_away", F.abs(F.col("value") - F.col("_center")))
    return _with_median(df, keys, "_away", "_mad", bounded).drop("_away")


def _rolling(df: DataFrame, make, max_rows: int | None) -> DataFrame:
    return over_series(df, TIME_KEYS, ["timestamp"], make, max_rows=max_rows)


def clip_outliers(
    df: DataFrame,
    method: str,
    *,
    scope: str = "cross_sectional",
    threshold: float = 5.0,
    lower: float = 0.01,
    upper: float = 0.99,
    window: int = 60,
    min_periods: int = 20,
    bounded: bool | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Clip ``value`` to bounds from ``mad``, ``std`` or ``winsorize``; null bounds do nothing."""
    if method == "none":
        return df
    columns = df.columns
    if scope == "time_series":

        def make(s: Series):
            if method == "mad":
                return {"_center": s.median("value", window, min_periods),
                        "_mad": s.mad("value", window, min_periods)}
            if method == "std":
                return {"_center": s.mean("value", window, min_periods),
                        "_scale": s.std("value", window, min_periods)}
            return {"_lo": s.quantile_nearest("value", window, lower, min_periods),
                    "_hi": s.quantile_nearest("value", window, upper, min_periods)}

        df = _rolling(df, make, max_rows)
    elif method == "mad":
        df = _with_mad(df, CROSS_KEYS, bounded)
    elif method == "std":
        stats = {"_center": F.avg("value"), "_scale": F.stddev_samp("value")}
        df = with_group_stats(df, CROSS_KEYS, stats, bounded=bounded)
    else:
        df = with_quantiles(
            df, CROSS_KEYS, "value", {"_lo": lower, "_hi": upper}, nearest=["_lo", "_hi"],
            bounded=bounded,
        )
    if method == "winsorize":
        low, high = F.col("_lo"), F.col("_hi")
    else:
        scale = F.col("_mad") * MAD_SCALE if method == "mad" else F.col("_scale")
        low, high = F.col("_center") - threshold * scale, F.col("_center") + threshold * scale
    return df.withColumn("value", clip("value", low, high)).select(*columns)


def _finish(df: DataFrame, scored, enough, flag: str, columns: Sequence[str]) -> DataFrame:
    value = F.when(enough, scored)
    flags = F.when(enough, F.col("quality_flags")).otherwise(add_flag("quality_flags", flag))
    df = df.withColumns({"value": value, "quality_flags": flags})
    failed = F.col("value").isNull() & (F.col("quality_flags") == "")
    flags = F.when(failed, "STANDARDIZATION_FAILED").otherwise(F.col("quality_flags"))
    return df.withColumn("quality_flags", flags).select(*columns)


def standardize(
    df: DataFrame,
    method: str,
    *,
    scope: str = "cross_sectional",
    min_cross_section: int = 5,
    window: int = 60,
    min_periods: int = 20,
    bounded: bool | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """``zscore``, ``robust_zscore`` or ``rank`` (to [-1, 1]) of ``value``, with flags."""
    if method == "none":
        return df
    columns = df.columns
    x = F.col("value")
    if scope == "time_series":

        def make(s: Series):
            out = {"_count": s.count("value", window)}
            # Rows seen in the frame decide whether the count itself is defined.
            out["_rows"] = s.count(F.lit(1), window)
            if method == "rank":
                out["_rank"] = s.rank_last("value", window, min_periods)
            elif method == "robust_zscore":
                out["_center"] = s.median("value", window, min_periods)
                out["_mad"] = s.mad("value", window, min_periods)
            else:
                out["_mean"] = s.mean("value", window, min_periods)
                out["_std"] = s.std("value", window, min_periods)
            return out

        df = _rolling(df, make, max_rows)
        enough = F.coalesce(F.col("_count") >= min_periods, F.lit(False))
        if method == "rank":
            # The window's length, nulls included, scales the rank.
            n = F.col("_rows")
            scored = F.when(n > 1, 2 * ratio(F.col("_rank") - 1, n - 1) - 1)
        elif method == "robust_zscore":
            width = F.col("_mad") * MAD_SCALE
            scored = F.when(width > 0, ratio(x - F.col("_center"), width))
        else:
            scored = F.when(F.col("_std") > 0, ratio(x - F.col("_mean"), "_std"))
        return _finish(df, scored, enough, "WARMUP_INCOMPLETE", columns)

    if method == "rank":
        df = with_group_stats(df, CROSS_KEYS, {"_count": F.count("value")}, bounded=bounded)
        df = average_rank(df, CROSS_KEYS, "value", "_rank", bounded=bounded)
        n = F.col("_count")
        scored = F.when(n > 1, 2 * ratio(F.col("_rank") - 1, n - 1) - 1)
    elif method == "robust_zscore":
        df = with_group_stats(df, CROSS_KEYS, {"_count": F.count("value")}, bounded=bounded)
        df = _with_mad(df, CROSS_KEYS, bounded)
        width = F.col("_mad") * MAD_SCALE
        scored = F.when(width > 0, ratio(x - F.col("_center"), width))
    else:
        stats = {"_count": F.count("value"), "_mean": F.avg("value"), "_std": F.stddev_samp("value")}
        df = with_group_stats(df, CROSS_KEYS, stats, bounded=bounded)
        scored = F.when(F.col("_std") > 0, ratio(x - F.col("_mean"), "_std"))
    enough = F.col("_count") >= min_cross_section
    return _finish(df, scored, enough, "INSUFFICIENT_CROSS_SECTION", columns)


def exposures_wide(exposures: DataFrame, names: Sequence[str]) -> DataFrame:
    keys = ["venue", "instrument_id", "timestamp"]
    return exposures.groupBy(*keys).pivot("factor_key", list(names)).agg(F.first("raw_value"))


def neutralize(
    df: DataFrame,
    exposures: DataFrame | None,
    names: Sequence[str],
    *,
    min_observations: int = 5,
    ridge: float = 0.0,
) -> DataFrame:
    """Residuals of ``value`` on raw exposures within each (factor, time) cross-section.

    Exposures come from a tall table, or (None) from the struct the factor rows carry, which needs no
    join. Only moments per cross-section are gathered; the coefficients come back by a join.
    """
    names, columns = list(names), df.columns
    if exposures is None:
        joined = df.withColumns({n: F.col(f"exposures.`{n}`") for n in names})
    else:
        wide = exposures_wide(exposures, names)
        joined = df.join(wide, ["venue", "instrument_id", "timestamp"], "left")
    # Read twice: for the moments and for the residuals.
    joined = materialize(joined)
    usable = finite("value")
    for n in names:
        usable &= finite(n)
    minimum = max(min_observations, len(names) + 2)
    betas = group_betas(
        joined.where(usable), CROSS_KEYS, names, "value", ridge=ridge, min_rows=minimum
    )
    got = joined.join(betas.drop("rows", "r2"), CROSS_KEYS, "left")
    fitted = F.col("b0")
    for i, n in enumerate(names, start=1):
        fitted = fitted + F.col(f"b{i}") * F.col(n)
    solved = F.col("b0").isNotNull()
    value = F.when(solved & usable, F.col("value") - fitted)
    lost = value.isNull() & (F.col("quality_flags") == "")
    flags = (
        F.when(~solved, add_flag("quality_flags", "NEUTRALIZATION_FAILED"))
        .when(lost, "NEUTRALIZATION_FAILED")
        .otherwise(F.col("quality_flags"))
    )
    return got.withColumns({"value": value, "quality_flags": flags}).select(*columns)


def final_validity(df: DataFrame) -> DataFrame:
    return df.withColumn("is_valid", F.col("is_valid") & finite("value"))


def process(
    raw: DataFrame,
    *,
    outlier: dict | None = None,
    standard: dict | None = None,
    exposures: DataFrame | None = None,
    exposure_names: Sequence[str] = (),
    neutral: dict | None = None,
    bounded: bool | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Outliers, then standardization, then neutralization, then the final validity."""
    df = mark_non_finite(raw)
    steps = [s for s in (outlier, standard) if s and s.get("method") != "none"]
    if bounded is None and any(s.get("scope", "cross_sectional") == "cross_sectional" for s in steps):
        # Group sizes stay the same through all steps, so one check serves them.
        df = materialize(df)
        bounded = fits(df, CROSS_KEYS)
    both = {"bounded": bounded, "max_rows": max_rows}
    if outlier:
        df = clip_outliers(df, **outlier, **both)
    if standard:
        df = standardize(df, **standard, **both)
    if exposure_names:
        if exposures is None and "exposures" not in df.columns:
            raise ValueError("neutralization needs exposures")
        df = neutralize(df, exposures, exposure_names, **(neutral or {}))
    return final_validity(df)
