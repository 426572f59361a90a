"""Factor redundancy: inflation factors, unique contribution, clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.groups import average_rank, fits
from tidemark.functions.moments import (
    fit_quality,
    fit_quality_stack,
    moment_aggs,
    residual_stack,
    scaled,
    scaled_stack,
    slopes,
    slopes_stack,
    solve_batches,
    solve_rows,
    unpack,
    unpack_stack,
)
from tidemark.functions.scalars import finite, ratio
from tidemark.session import materialize

OBSERVATION = ["venue", "instrument_id", "timestamp"]


def _wide(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    # Of repeated rows the greatest value counts.
    return df.where(F.col("factor_name").isin(list(names))).groupBy(*keys).agg(
        *[F.max(F.when(F.col("factor_name") == n, F.col("value"))).alias(f"x{i}") for i, n in enumerate(names)]
    )


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    ok = F.lit(True)
    for c in columns:
        ok &= finite(c)
    return df.where(ok)


def vif(
    dataset: DataFrame,
    factors: Sequence[str],
    *,
    min_observations: int = 20,
    ridge: float = 1e-8,
    moderate: float = 5.0,
    high: float = 10.0,
) -> DataFrame:
    """Variance inflation of each factor given the others, from one moment row of all rows."""
    names = sorted(factors)
    k = len(names)
    xs = [f"x{i}" for i in range(k)]
    rows = _complete(_wide(dataset.where("factor_is_valid"), OBSERVATION, names), xs)
    aggs = moment_aggs(xs)
    moments = rows.agg(*[c.alias(n) for n, c in aggs.items()])

    def solve(rec: dict) -> list[list]:
        n = rec["n"]
        r = scaled(unpack(rec, k)[2]) if n > 0 else None
        out = []
        for t in range(k):
            others = [i for i in range(k) if i != t]
            r2 = value = None
            if others and n >= max(min_observations, len(others) + 3):
                beta = slopes(n, r, others, t, ridge)
                r2 = fit_quality(n, r, others, t, beta) if beta is not None else None
                if r2 is not None:
                    value = float(np.inf) if r2 >= 1 - 1e-12 else 1 / (1 - r2)
            elif not others and n >= min_observations:
                r2, value = 0.0, 1.0
            if value is None:
                status = "UNAVAILABLE"
            else:
                status = "HIGH" if value >= high else "MODERATE" if value >= moderate else "LOW"
            controls = ",".join(names[i] for i in others)
            out.append([names[t], controls, int(n), r2, value, status])
        return out

    schema = (
        "factor_name string, controls string, observations long, r_squared double, vif double, "
        "status string"
    )
    return solve_rows(moments, [], list(aggs), schema, solve)


def unique_contribution(
    dataset: DataFrame,
    factors: Sequence[str],
    *,
    targets: Sequence[str] | None = None,
    controls: Sequence[str] | None = None,
    method: str = "spearman",
    min_observations: int = 5,
    ridge: float = 1e-8,
    bounded: bool | None = None,
) -> DataFrame:
    """Conditional IC and incremental R2 of each target per cross-section.

    Targets that share a set of variables share one ranking pass and one moment row; the systems of all
    cross-sections of a batch are solved together.
    """
    names = sorted(factors)
    at = {n: i for i, n in enumerate(names)}
    plan: dict[tuple[str, ...], list[tuple[str, list[str]]]] = {}
    for t in targets or names:
        given = [c for c in (controls if controls is not None else names) if c != t]
        plan.setdefault(tuple(sorted({t, *given})), []).append((t, given))
    group = ["venue", "label_name", "horizon_bars", "timestamp"]
    keys = [*OBSERVATION, "label_name", "horizon_bars", "label_value"]
    wide = materialize(_wide(dataset.where("is_valid"), keys, names))
    out = None
    for used, wanted in plan.items():
        cols = [*[f"x{at[n]}" for n in used], "label_value"]
        part = _contribution(
            _complete(wide, cols).select(*group, "instrument_id", *cols), group, cols, list(used), wanted,
            method, min_observations, ridge, bounded,
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("method", F.lit(method))


def _contribution(
    rows, group, cols, used, wanted, method, min_observations, ridge, bounded
) -> DataFrame:
    if method == "spearman":
        if bounded is None:
            bounded = fits(rows, group)
        if bounded:  # plain windows on one key set share a shuffle
            for c in cols:
                rows = average_rank(rows, group, c, f"r_{c}", bounded=True)
            rows = rows.select(*group, *[F.col(f"r_{c}").alias(c) for c in cols])
        else:  # slices are cut once, for all variables
            rows = _tall_ranks(rows, group, cols)
    aggs = moment_aggs(cols)
    moments = rows.groupBy(*group).agg(*[c.alias(n) for n, c in aggs.items()])
    k, place = len(cols), {n: i for i, n in enumerate(used)}

    def pearson(n, left, right, cross):
        flat = (n * left <= 1e-16) | (n * right <= 1e-16)
        return cross / np.sqrt(np.where(flat, 1.0, left * right)), ~flat

    def explained(n, r, xs, y):
        b, sound = slopes_stack(n, r, xs, y, ridge)
        share, given = fit_quality_stack(n, r, xs, y, b)
        return share, sound & given

    def cells(values, known):
        return [v if ok else None for v, ok in zip(values.tolist(), known.tolist(), strict=True)]

    def solve(frame) -> list[list[list]]:
        n, _, cov = unpack_stack(frame, k)
        r, y, out = scaled_stack(cov), k - 1, [[] for _ in n]
        for target, given in wanted:
            t, cs = place[target], [place[c] for c in given]
            raw, has_raw = pearson(n, r[:, t, t], r[:, y, y], r[:, t, y])
            b, sound = slopes_stack(n, r, cs, t, ridge)
            cross = r[:, t, y] - np.einsum("bi,bi->b", b, r[:, cs, y])
            conditional, has_conditional = pearson(n, residual_stack(r, cs, t, b), r[:, y, y], cross)
            base, has_base = explained(n, r, cs, y) if cs else (np.zeros(len(n)), np.ones(len(n), bool))
            full, has_full = explained(n, r, [*cs, t], y)
            columns = [
                cells(raw, has_raw), cells(conditional, sound & has_conditional), cells(base, has_base),
                cells(full, has_full), cells(np.maximum(0.0, full - base), has_full & has_base),
            ]
            for i in np.flatnonzero(n >= max(min_observations, len(given) + 3)).tolist():
                out[i].append([target, ",".join(given), int(n[i]), *(c[i] for c in columns)])
        return out

    schema = (
        "factor_name string, controls string, observations long, raw_ic double, "
        "conditional_ic double, baseline_r_squared double, full_r_squared double, "
        "incremental_r_squared double"
    )
    return solve_batches(moments, group, list(aggs), schema, solve)


def _tall_ranks(rows: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """Average ranks of several columns in their group, ranked as one tall table of column and value."""
    ids = [*group, "instrument_id"]
    pairs = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).alias("_value")) for c in cols])
    tall = average_rank(rows.select(*ids, F.inline(pairs)), [*group, "_column"], "_value", "_rank", bounded=False)
    return tall.groupBy(*ids).pivot("_column", cols).agg(F.first("_rank")).select(*group, *cols)


def unique_contribution_summary(series: DataFrame) -> DataFrame:
    keys = ["factor_name", "controls", "label_name", "horizon_bars", "method"]
    c = F.col("conditional_ic")
    base = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"),
        F.avg("raw_ic").alias("mean_raw_ic"),
        F.avg(c).alias("mean_conditional_ic"),
        F.stddev_samp(c).alias("std_conditional_ic"),
        F.avg(F.when(c > 0, 1.0).when(c.isNotNull(), 0.0)).alias("conditional_positive_rate"),
        F.avg("incremental_r_squared").alias("mean_incremental_r_squared"),
        F.percentile("incremental_r_squared", 0.5).alias("median_incremental_r_squared"),
    )
    mean, std, n = F.col("mean_conditional_ic"), F.col("std_conditional_ic"), F.col("periods")
    return base.withColumns(
        {
            "mean_ic_change": mean - F.col("mean_raw_ic"),
            "conditional_ic_t_stat": F.when((std > 0) & (n > 1), ratio(mean, std / F.sqrt(n))),
        }
    )


def clusters(correlations: DataFrame, overall: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Connected components of strongly correlated factors and their representatives.

    Components spread the least factor name along edges until nothing changes. The tables hold one
    row per factor or pair, so a round costs little, and each round is written out to keep the plan
    short.
    """
    correlations = materialize(correlations)
    pairs = materialize(
        correlations.where(F.col("factor_left") != F.col("factor_right")).select(
            "factor_left", "factor_right", F.abs("correlation").alias("strength")
        )
    )
    nodes = correlations.select(F.col("factor_left").alias("factor_name")).union(
        correlations.select("factor_right")
    ).distinct()
    strong = pairs.where(F.col("strength") >= threshold)
    edges = materialize(
        strong.select(F.col("factor_left").alias("a"), F.col("factor_right").alias("b")).union(
            strong.select("factor_right", "factor_left")
        )
    )
    labels = materialize(nodes.withColumn("root", F.col("factor_name")))
    changed = 1
    while changed:  # the least name has at most as far to go as there are factors
        reach = labels.join(edges, labels.factor_name == edges.b).select(
            F.col("a").alias("factor_name"), "root"
        )
        # Also hop from the root itself, which halves the remaining path length each round.
        hop = labels.join(
            labels.select(F.col("factor_name").alias("root"), F.col("root").alias("upper")), "root"
        ).select("factor_name", F.col("upper").alias("root"))
        spread = labels.union(reach).union(hop).groupBy("factor_name")
        nxt = materialize(spread.agg(F.min("root").alias("root")))
        changed = nxt.join(labels, ["factor_name", "root"], "left_anti").limit(1).count()
        labels = nxt
    score = overall.groupBy("factor_name").agg(F.avg(F.abs("ic")).alias("mean_abs_ic"))
    inside = pairs.join(labels.withColumnRenamed("factor_name", "factor_left"), "factor_left").join(
        labels.select(F.col("factor_name").alias("factor_right"), F.col("root").alias("other")),
        "factor_right",
    )
    peak = inside.where(F.col("root") == F.col("other")).groupBy("root").agg(
        F.max("strength").alias("max_abs_correlation")
    )
    rated = labels.join(score, "factor_name", "left")
    best = rated.groupBy("root").agg(
        F.count(F.lit(1)).alias("cluster_size"),
        F.max_by(
            "factor_name", F.struct(F.coalesce("mean_abs_ic", F.lit(-1.0)), F.col("factor_name"))
        ).alias("representative"),
    )
    numbered = best.withColumn(
        "cluster_id",
        F.concat(F.lit("R"), F.row_number().over(Window.orderBy("root")).cast("string")),
    )
    return (
        rated.join(numbered, "root")
        .join(peak, "root", "left")
        .select(
            "cluster_id",
            "factor_name",
            "cluster_size",
            "representative",
            (F.col("factor_name") == F.col("representative")).alias("is_representative"),
            "mean_abs_ic",
            "max_abs_correlation",
            F.lit(float(threshold)).alias("threshold"),
        )
    )


def redundancy_report(
    dataset: DataFrame,
    correlations: DataFrame,
    overall: DataFrame,
    factors: Sequence[str],
    *,
    method: str = "spearman",
    min_observations: int = 5,
    ridge: float = 1e-8,
    threshold: float = 0.8,
) -> dict[str, DataFrame]:
    series = materialize(
        unique_contribution(
            dataset, factors, method=method, min_observations=min_observations, ridge=ridge
        )
    )
    return {
        "pairwise_correlation": correlations,
        "vif": vif(dataset, factors, min_observations=min_observations, ridge=ridge),
        "unique_contribution": series,
        "unique_contribution_summary": unique_contribution_summary(series),
        "clusters": clusters(correlations, overall, threshold),
    }
