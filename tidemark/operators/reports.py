"""Multi-factor report: quantile tables, IC tables, rolling regressions, blended weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.groups import fits, tie_range, with_group_stats
from tidemark.functions.moments import PIVOT_FLOOR, solve_rows
from tidemark.functions.rolling import Series
from tidemark.functions.scalars import corr_safe, day_start, finite, ratio
from tidemark.operators.grid import asof_backward, shifted_join
from tidemark.session import materialize


def quantile_table(
    df: DataFrame, quantile: str, returns: str, by_year: bool = False
) -> DataFrame:
    """Mean, spread and count of returns per bucket, optionally per year."""
    rows = df.where(F.col(quantile).isNotNull() & finite(returns))
    keys = [F.col(quantile).alias("quantile")]
    if by_year:
        keys.insert(0, F.year("timestamp").alias("year"))
    return rows.groupBy(*keys).agg(
        F.avg(returns).alias("mean_return"),
        F.stddev_samp(returns).alias("return_std"),
        F.count(F.lit(1)).alias("observations"),
    )


def correlation_table(df: DataFrame, columns: Sequence[str], least: int = 3) -> DataFrame:
    """Pairwise-complete Pearson correlations of columns, one row per pair, in one aggregate."""
    names = list(dict.fromkeys(columns))
    aggs = {}
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            both = finite(a) & finite(b)
            aggs[f"n{i}_{j}"] = F.sum(both.cast("long"))
            if i != j:
                aggs[f"c{i}_{j}"] = corr_safe(F.when(both, F.col(a)), F.when(both, F.col(b)))
    row = df.agg(*[c.alias(n) for n, c in aggs.items()])
    items = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            hi, lo = max(i, j), min(i, j)
            value = F.lit(1.0) if i == j else F.col(f"c{hi}_{lo}")
            items.append(
                F.struct(
                    F.lit(a).alias("factor"), F.lit(b).alias("other"),
                    F.when(F.col(f"n{hi}_{lo}") >= least, value).alias("correlation"),
                )
            )
    return row.select(F.inline(F.array(*items)))


def correlation_matrix(df: DataFrame, columns: Sequence[str], least: int = 3) -> DataFrame:
    tall = correlation_table(df, columns, least)
    return tall.groupBy("factor").pivot("other", list(columns)).agg(F.first("correlation"))


def ic_table(df: DataFrame, columns: Sequence[str], returns: str) -> DataFrame:
    """Pearson IC per time for several factor columns."""
    tall = df.select("timestamp", returns, *columns).unpivot(
        ["timestamp", returns], list(columns), "factor", "factor_value"
    )
    rows = tall.where(finite("factor_value") & finite(returns))
    ic = rows.groupBy("timestamp", "factor").agg(corr_safe("factor_value", returns).alias("ic"))
    return ic.where(F.col("ic").isNotNull())


def ic_table_summary(series: DataFrame, by: Sequence[str] = ("factor",)) -> DataFrame:
    return series.groupBy(*by).agg(
        F.avg("ic").alias("mean_ic"),
        F.stddev_samp("ic").alias("ic_std"),
        F.count(F.lit(1)).alias("periods"),
    ).withColumn("ic_ir", ratio("mean_ic", "ic_std"))


def forward_period_ic(
    factors: DataFrame, columns: Sequence[str], returns: DataFrame, value: str, periods: int,
    minutes: int, least: int = 3,
) -> DataFrame:
    """IC against the single-bar return that starts 0..P-1 bars after the factor time."""
    tall = factors.select("instrument_id", "timestamp", *columns).unpivot(
        ["instrument_id", "timestamp"], list(columns), "factor", "factor_value"
    )
    target = returns.select("instrument_id", "timestamp", F.col(value).alias("forward_return"))
    joined = shifted_join(tall, target, periods, minutes, ["instrument_id"])
    rows = joined.where(finite("factor_value") & finite("forward_return"))
    ic = rows.groupBy("timestamp", "factor", "forward_period").agg(
        corr_safe("factor_value", "forward_return").alias("ic"), F.count(F.lit(1)).alias("assets")
    )
    return ic.where((F.col("assets") >= least) & finite("ic"))


def requantile(df: DataFrame, column: str, quantiles: int) -> DataFrame:
    """Replace a column by its centred ordinal bucket per time."""
    ok = df.where(finite(column))
    ranked = tie_range(ok, ["timestamp"], [column, "instrument_id"], first="_r")
    bucket = F.ceil(F.col("_r") * F.lit(quantiles) / F.col("_size"))
    centred = ranked.withColumn(column, bucket - F.lit((quantiles + 1) / 2)).select(*df.columns)
    return centred.unionByName(
        df.where(~finite(column)).withColumn(column, F.lit(None).cast("double"))
    )


# -- rolling regression --------------------------------------------------------------------
def _sums(names: Sequence[str], target: str) -> dict[str, Column]:
    cols = [F.lit(1.0), *[F.col(n) for n in names], F.col(target)]
    out = {}
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            out[f"s{i}_{j}"] = F.sum(a * cols[j])
    return out


def rolling_ols(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    *,
    lookback_days: int = 30,
    refit_days: int = 10,
    least: int = 100,
    available: str = "exit_time",
    label: str = "xs",
) -> DataFrame:
    """Pooled OLS refitted every k days on the rows that became available in the window.

    Rows shrink to cross-product sums per day slice; each refit adds the slices of its window, so
    overlapping windows never copy raw rows. A refit is at midnight and its window is (start, end],
    so a row belongs to the slice that ends at the first midnight at or after its availability.
    """
    features = list(features)
    good = finite(target) & F.col(available).isNotNull() & F.col("timestamp").isNotNull()
    for f in features:
        good &= finite(f)
    clean = df.where(good)
    floor = day_start(available)
    edge = F.when(floor == F.col(available), floor).otherwise(floor + F.expr("INTERVAL 1 DAY"))
    sums = _sums(features, target)
    slices = materialize(
        clean.groupBy(edge.alias("slice")).agg(
            *[c.alias(n) for n, c in sums.items()], F.min(available).alias("first_available")
        )
    )
    back = F.make_dt_interval(days=F.lit(lookback_days))
    start = slices.agg((F.min("first_available") + back).alias("from_time"))
    days = clean.select(day_start("timestamp").alias("estimate_at")).distinct()
    # One row per calendar day: numbering them in one task is fine.
    nth = F.row_number().over(Window.orderBy("estimate_at")) - 1
    refits = (
        days.crossJoin(F.broadcast(start))
        .where(F.col("estimate_at") >= F.col("from_time"))
        .withColumn("_nth", nth)
        .where(F.col("_nth") % refit_days == 0)
        .select("estimate_at")
    )
    step = F.expr("INTERVAL 1 DAY")
    wanted = refits.withColumn(
        "slice",
        F.explode(F.sequence(F.col("estimate_at") - back + step, F.col("estimate_at"), step)),
    )
    total = wanted.join(slices, "slice").groupBy("estimate_at").agg(
        *[F.sum(n).alias(n) for n in sums]
    )
    k = len(features) + 1

    def fit(rec: dict) -> list[list]:
        m = np.zeros((k + 1, k + 1))
        for i in range(k + 1):
            for j in range(i, k + 1):
                m[i, j] = m[j, i] = rec[f"s{i}_{j}"]
        n = int(round(m[0, 0]))
        if n < least:
            return []
        # Centre before solving: the intercept row then drops out.
        mean = m[0, 1:] / m[0, 0]
        cov = m[1:, 1:] - m[0, 0] * np.outer(mean, mean)
        a, b = cov[: k - 1, : k - 1], cov[: k - 1, k - 1]
        if np.linalg.matrix_rank(a, tol=PIVOT_FLOOR * max(1.0, np.abs(a).max())) < k - 1:
            return []
        beta = np.linalg.solve(a, b)
        spread = cov[k - 1, k - 1]
        r2 = float(beta @ b / spread) if spread > 0 else None
        return [[n, float(mean[k - 1] - beta @ mean[: k - 1]), r2, *map(float, beta)]]

    schema = f"observations long, {label}_intercept double, {label}_r2 double, " + ", ".join(
        f"coef_{f} double" for f in features
    )
    fitted = solve_rows(total, ["estimate_at"], list(sums), schema, fit)
    return fitted.withColumns(
        {"window_start": F.col("estimate_at") - back, "window_end": F.col("estimate_at")}
    )


def daily_coefficients(coefficients: DataFrame, model: DataFrame) -> DataFrame:
    """The latest estimate for each day the model has rows."""
    days = model.select(day_start("timestamp").alias("date")).distinct().withColumn("_k", F.lit(1))
    columns = [c for c in coefficients.columns if c != "estimate_at"]
    right = coefficients.withColumns({"_k": F.lit(1), "last_refit_at": F.col("estimate_at")})
    got = asof_backward(
        days, right, ["_k"], [*columns, "last_refit_at"], left_on="date", right_on="estimate_at"
    )
    return got.where(F.col("last_refit_at").isNotNull()).drop("_k")


def expected_returns(
    model: DataFrame, daily: DataFrame, features: Sequence[str], intercept: str = "xs_intercept"
) -> DataFrame:
    """Coefficient times feature, per feature and in total."""
    keep = ["date", intercept, *[f"coef_{f}" for f in features]]
    joined = model.withColumn("date", day_start("timestamp")).join(daily.select(*keep), "date")
    terms = {
        f"expected_{f.removesuffix('_weight')}_return": F.col(f) * F.col(f"coef_{f}")
        for f in features
    }
    total = F.col(intercept)
    for t in terms.values():
        total = total + F.coalesce(t, F.lit(0.0))
    return joined.withColumns({**terms, "expected_return": total})


# -- blended weights -----------------------------------------------------------------------
def blended_weights(
    df: DataFrame,
    *,
    quantiles: int,
    returns: str,
    min_universe: int = 1,
    carry_coefficient: float = 1.0,
    momentum_coefficient: float = 1.0,
    breakout_coefficient: float = 0.3,
    breakout_scale: float = 2.0,
) -> DataFrame:
    """Combined factor weights, scaled to unit gross per time, from the first wide-enough time."""
    rows = materialize(
        df.where(
            F.col("in_universe")
            & F.col("quantile_carry").isNotNull()
            & F.col("quantile_momo").isNotNull()
            & finite("breakout")
            & finite(returns)
        )
    )
    sizes = rows.groupBy("timestamp").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.where(F.col("_n") >= min_universe).agg(F.min("timestamp").alias("_first"))
    rows = rows.crossJoin(F.broadcast(first)).where(F.col("timestamp") >= F.col("_first"))
    centre = (quantiles + 1) / 2
    weights = {
        "carry_weight": F.col("quantile_carry") - centre,
        "momo_weight": F.col("quantile_momo") - centre,
        "breakout_weight": F.col("breakout") / breakout_scale,
    }
    scale = {"carry": carry_coefficient, "momo": momentum_coefficient,
             "breakout": breakout_coefficient}
    rows = rows.drop("_first").withColumns(weights)
    parts = {f"{n}_contribution": F.col(f"{n}_weight") * c for n, c in scale.items()}
    rows = rows.withColumns(parts).withColumn(
        "combined_weight",
        F.col("carry_contribution") + F.col("momo_contribution") + F.col("breakout_contribution"),
    )
    rows = with_group_stats(
        rows, ["timestamp"], {"gross_weight": F.sum(F.abs("combined_weight"))},
        bounded=fits(rows, ["timestamp"]),
    )
    named = {"scaled_weight": "combined_weight"}
    named |= {f"scaled_{n}_weight": f"{n}_contribution" for n in scale}
    gross = F.col("gross_weight")
    return rows.withColumns(
        {n: F.when(gross > 0, ratio(c, gross)).otherwise(0.0) for n, c in named.items()}
    )


def net_weight(df: DataFrame, weight: str = "scaled_weight") -> DataFrame:
    return df.groupBy("timestamp").agg(F.sum(weight).alias("net_weight"))


def equity_curves(df: DataFrame, returns: Sequence[str], weight: str = "scaled_weight"):
    """Weighted portfolio return per time and its compounded equity."""
    sums = df.groupBy("timestamp").agg(
        *[F.sum(F.col(c) * F.col(weight)).alias(f"portfolio_{c}") for c in returns]
    )
    s = Series(sums.withColumn("_one", F.lit(1)), ["_one"], ["timestamp"])
    out = {f"equity_{c}": s.cumprod(s.add(1 + F.col(f"portfolio_{c}"))) for c in returns}
    return s.build(out, sums.columns)


def factor_attribution(df: DataFrame, returns: str) -> DataFrame:
    """Return contribution of each factor sleeve per time, and its running sum."""
    parts = ["carry", "momo", "breakout"]
    sums = df.groupBy("timestamp").agg(
        *[F.sum(F.col(returns) * F.col(f"scaled_{p}_weight")).alias(f"{p}_return") for p in parts]
    )
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(F.col(f"{p}_return"), F.lit(0.0))
    sums = sums.withColumns({"portfolio_return": total, "_one": F.lit(1)})
    s = Series(sums, ["_one"], ["timestamp"])
    names = [f"{p}_return" for p in parts] + ["portfolio_return"]
    out = {f"cumulative_{n}": s.cumsum(n) for n in names}
    return s.build(out, ["timestamp", *names])
