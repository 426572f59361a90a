"""Walk-forward regressions on factor features.

A row of the panel trains every fit from the time its label is known until its period leaves the training
window. Both are events on one time line: running sums of the rows' moments over the events give the moments of
the window at every time, the schedule of refits follows from them, and each refit's linear model is solved from
its own row of moments. Scores look the fit in force up by time. Nothing of this is a loop over refits. Trees are
those of pyspark.ml, which fits one model a call.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.groups import group_quantiles
from tidemark.functions.rolling import Series, over_series
from tidemark.functions.scalars import bar_minutes, finite, shift_time, time_literal
from tidemark.operators.combine import (
    KEYS,
    CombinationRequest,
    prepare_features,
    prepare_target,
    register,
)
from tidemark.session import materialize

TREES = 200
SEED = 42
MODELS = ["ridge", "elastic_net", "random_forest", "gradient_boosting", "hist_gradient_boosting"]


LINEAR = ("ridge", "elastic_net")
# The deepest tree that Spark grows, where no depth is asked for.
DEEPEST = 30


def _regressor(model: str, params: dict[str, Any]):
    """The tree estimator; a forest tries every feature at each split."""
    base = {"featuresCol": "features", "labelCol": "label_value", "predictionCol": "prediction"}
    depth, seed = params.get("max_depth"), int(params.get("random_state", SEED))
    if model == "random_forest":
        trees = int(params.get("n_estimators", TREES))
        return RandomForestRegressor(
            **base, numTrees=trees, maxDepth=DEEPEST if depth is None else int(depth), seed=seed,
            featureSubsetStrategy="all",
        )
    if model in ("gradient_boosting", "hist_gradient_boosting"):
        rounds = int(params.get("n_estimators", params.get("max_iter", 100)))
        rate = float(params.get("learning_rate", 0.1))
        return GBTRegressor(
            **base, maxIter=rounds, maxDepth=3 if depth is None else int(depth), stepSize=rate,
            seed=seed,
        )
    raise ValueError(f"unknown model {model!r}; choose from {MODELS}")


def transform_target(rows: DataFrame, kind: str) -> DataFrame:
    """Raw, demeaned or z-scored (population) training target."""
    if kind == "none":
        return rows
    if kind not in ("demean", "zscore"):
        raise ValueError("target_transform must be none, demean or zscore")
    stats = rows.agg(
        F.avg("label_value").alias("_mean"), F.stddev_pop("label_value").alias("_std")
    )
    # One row.
    got = rows.crossJoin(F.broadcast(stats))
    y = F.col("label_value") - F.col("_mean")
    if kind == "zscore":
        y = F.when(F.col("_std") > 0, y / F.col("_std")).otherwise(F.lit(0.0))
    return got.withColumn("label_value", y).drop("_mean", "_std")


def _columns(n: int) -> tuple[list[str], list[str]]:
    return [f"x{i}" for i in range(n)], [f"m{i}" for i in range(n)]


@dataclass(frozen=True)
class Fit:
    """A fitted tree pipeline with the medians for missing features."""

    medians: list[float]
    weights: list[float]
    trees: PipelineModel


@dataclass(frozen=True)
class Schedule:
    """What a fit may train on, and when it is made again."""

    least_rows: int
    least_periods: int
    window: int | None
    every: int

    @classmethod
    def of(cls, p: dict[str, Any]) -> Schedule:
        window = p.get("train_window_periods")
        return cls(
            int(p.get("min_train_observations", 500)), int(p.get("min_train_periods", 20)),
            None if window is None else int(window), int(p.get("retrain_every", 24)),
        )


# -- moments over time ---------------------------------------------------------------------
def _row_moments(n: int) -> dict[str, Column]:
    """Sums that make up the moments of ``n`` features and the label, missing features apart.

    ``s`` sums a feature (0 where missing), ``q`` counts missing ones; two letters are sums of products, ``y`` is
    the label.
    """
    x = [F.coalesce(F.col(f"x{i}"), F.lit(0.0)) for i in range(n)]
    q = [F.when(F.col(f"x{i}").isNull(), 1.0).otherwise(0.0) for i in range(n)]
    y = F.col("label_value")
    out = {"n": F.lit(1.0), "y": y, "yy": y * y}
    for i in range(n):
        out |= {f"s{i}": x[i], f"q{i}": q[i], f"sy{i}": x[i] * y, f"qy{i}": q[i] * y}
        for j in range(n):
            if i <= j:
                out[f"ss{i}_{j}"] = x[i] * x[j]
            if i < j:
                out[f"qq{i}_{j}"] = q[i] * q[j]
            if i != j:
                out[f"qs{i}_{j}"] = q[i] * x[j]
    return out


def trained_rows(ready: DataFrame, window: int | None) -> DataFrame:
    """Labelled rows with ``_leave``: when their period leaves the window of the last ``window`` known periods.

    A period is known with its first label; it waits for the periods before it.
    """
    if window is None:
        return ready.withColumn("_leave", F.lit(None).cast("timestamp_ntz"))
    periods = ready.groupBy("timestamp").agg(F.min("_known").alias("_seen")).withColumn("_one", F.lit(1))
    periods = over_series(
        periods, ["_one"], ["timestamp"], lambda s: {"_leave": s.lead(s.cummax("_seen"), window)}, ["timestamp"]
    )
    return ready.join(periods, "timestamp")


def window_moments(rows: DataFrame, ready: DataFrame, n: int) -> DataFrame:
    """One row per time of the panel: its number from 1, and the sums over the rows that may train a fit there."""
    sums = _row_moments(n)
    stays = F.col("_leave").isNull() | (F.col("_leave") > F.col("_known"))
    ends = F.array(
        F.struct(F.col("_known").alias("at"), F.lit(1.0).alias("sign")),
        F.struct(F.col("_leave").alias("at"), F.lit(-1.0).alias("sign")),
    )
    sides = ready.where(stays).select("*", F.inline(ends)).where(F.col("at").isNotNull())
    moved = sides.groupBy("at").agg(*[F.sum(F.col("sign") * c).alias(k) for k, c in sums.items()])
    periods = ready.groupBy("timestamp").agg(F.min("_known").alias("_known"), F.first("_leave").alias("_leave"))
    counted = periods.where(stays).select(F.inline(ends)).where(F.col("at").isNotNull())
    counted = counted.groupBy("at").agg(F.sum("sign").alias("periods"))
    times = rows.select(F.col("timestamp").alias("at")).distinct().withColumn("_time", F.lit(1))
    events = moved.unionByName(counted, allowMissingColumns=True).unionByName(times, allowMissingColumns=True)
    names = [*sums, "periods"]
    line = events.groupBy("at").agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names], F.coalesce(F.max("_time"), F.lit(0)).alias("_time")
    )
    running = over_series(
        line.withColumn("_one", F.lit(1)), ["_one"], ["at"],
        lambda s: {c: s.cumsum(c) for c in names} | {"number": s.cumsum("_time")}, ["at", "_time"],
    )
    return running.where(F.col("_time") == 1).drop("_time")


def refit_times(moments: DataFrame, n: int, plan: Schedule) -> DataFrame:
    """The times at which a model is fitted, with their moments and ``fit``, its number.

    A fit takes place where it can (enough rows and periods, no feature missing throughout) and ``every`` times have
    passed since the last one. Times at which it can form stretches; the schedule goes through the stretches,
    of which there is one unless data stop.
    """
    able = (F.col("number") > plan.least_periods) & (F.col("periods") >= plan.least_periods)
    able &= F.col("n") >= plan.least_rows
    for i in range(n):
        able &= F.col("n") > F.col(f"q{i}")
    can = moments.where(able).withColumn("_one", F.lit(1))
    can = over_series(can, ["_one"], ["number"], lambda s: {"_stretch": s.add(F.col("number") - s.position())})
    stretches = can.groupBy("_stretch").agg(F.min("number").alias("a"), F.max("number").alias("b"))
    listed = stretches.agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("all"))
    every = F.lit(plan.every).cast("long")

    def walk(acc: Column, it: Column) -> Column:
        first = F.greatest(it["a"], acc["next"])
        last = first + F.floor((it["b"] - first) / every) * every
        fits = first <= it["b"]
        return F.struct(
            F.when(fits, last + every).otherwise(acc["next"]).alias("next"),
            F.when(fits, F.concat(acc["out"], F.array(F.struct(first.alias("a"), it["b"].alias("b"))))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("out"))
    parts = listed.select(F.inline(F.aggregate("all", start, walk, lambda acc: acc["out"])))
    numbers = parts.select(F.explode(F.sequence("a", "b", every)).alias("number"))
    chosen = can.join(numbers, "number", "left_semi")
    return over_series(chosen, ["_one"], ["at"], lambda s: {"fit": s.position()}).drop("_one", "_stretch")


def window_medians(ready: DataFrame, refits: DataFrame, features: Sequence[int]) -> DataFrame:
    """Exact medians of features at each refit: at, d0, d1, ...

    Each value goes to every refit whose window holds it: as many rows as the fits themselves train on.
    """
    cells = ready.select("timestamp", "_known", "_leave").distinct()
    inside = (F.col("_known") <= F.col("at")) & (F.col("_leave").isNull() | (F.col("_leave") > F.col("at")))
    pairs = cells.join(refits.select("at"), inside).select("timestamp", "_known", "at")
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("v")) for i in features])
    tall = ready.join(pairs, ["timestamp", "_known"]).select("at", F.inline(values))
    found = group_quantiles(tall, ["at", "i"], "v", {"m": 0.5})
    return found.groupBy("at").agg(*[F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"d{i}") for i in features])


def solve_fits(refits: DataFrame, n: int, model: str, target: str, params: dict[str, Any]) -> DataFrame:
    """at, fit, b (intercept), and per feature d (median), c (centre), s (scale), w (slope): one row per refit."""
    per_feature = [f"{p}{i}" for p in "dcsw" for i in range(n)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v = {c: rows[c].to_numpy(float) for c in rows.columns if c not in ("at", "fit")}
            size, d = v["n"], [v[f"d{i}"] for i in range(n)]
            mean = np.stack([(v[f"s{i}"] + d[i] * v[f"q{i}"]) / size for i in range(n)], axis=1)
            gram = np.empty((len(rows), n, n))
            for i in range(n):
                for j in range(i, n):
                    both = v[f"ss{i}_{j}"] + (
                        d[i] ** 2 * v[f"q{i}"] if i == j
                        else d[i] * v[f"qs{i}_{j}"] + d[j] * v[f"qs{j}_{i}"] + d[i] * d[j] * v[f"qq{i}_{j}"]
                    )
                    gram[:, i, j] = gram[:, j, i] = both / size - mean[:, i] * mean[:, j]
            y = v["y"] / size
            spread = np.sqrt(np.maximum(v["yy"] / size - y * y, 0.0))
            cross = np.stack([(v[f"sy{i}"] + d[i] * v[f"qy{i}"]) / size for i in range(n)], axis=1) - mean * y[:, None]
            if target != "none":
                y = np.zeros(len(rows))
            if target == "zscore":
                cross = np.where(spread[:, None] > 0, cross / np.where(spread > 0, spread, 1.0)[:, None], 0.0)
            var = np.einsum("rii->ri", gram)
            # A feature without spread keeps scale 1 and gets slope 0. (What rounding leaves of it counts as none.)
            square = np.stack([v[f"ss{i}_{i}"] + d[i] ** 2 * v[f"q{i}"] for i in range(n)], axis=1) / size[:, None]
            flat = var <= 1e-14 * square
            scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var)))
            gram = np.where(flat[:, :, None] | flat[:, None, :], 0.0, gram / (scale[:, :, None] * scale[:, None, :]))
            cross = np.where(flat, 0.0, cross / scale)
            weights = linear_weights(model, size, gram, cross, params)
            found = {"at": rows["at"], "fit": rows["fit"], "b": y}
            for p, m in zip("dcsw", (np.stack(d, axis=1), mean, scale, weights), strict=True):
                found |= {f"{p}{i}": m[:, i] for i in range(n)}
            yield pd.DataFrame(found)

    kinds = ", ".join(["at timestamp_ntz", "fit int", "b double", *[f"{c} double" for c in per_feature]])
    return refits.mapInPandas(run, kinds)


def linear_weights(
    model: str, n: np.ndarray, gram: np.ndarray, cross: np.ndarray, params: dict[str, Any]
) -> np.ndarray:
    """Slopes on standardized features from their correlations and covariances with the target, fit by fit.

    Ridge minimizes the sum of squares plus alpha times the squared slopes; the elastic net half the
    mean of squares plus its two penalties, by coordinate descent on all fits abreast.
    """
    k = cross.shape[1]
    if model == "ridge":
        left = n[:, None, None] * gram + float(params.get("alpha", 1.0)) * np.eye(k)
        # (Without a penalty a flat feature's equation is empty: it keeps slope 0.)
        left += np.where(np.einsum("rii->ri", left) == 0, 1.0, 0.0)[:, :, None] * np.eye(k)
        return np.linalg.solve(left, (n[:, None] * cross)[:, :, None])[:, :, 0]
    alpha, share = float(params.get("alpha", 0.001)), float(params.get("l1_ratio", 0.5))
    w = np.zeros_like(cross)
    live = np.arange(len(cross))
    for _ in range(int(params.get("max_iter", 5000))):
        before = w[live].copy()
        now = before.copy()
        for j in range(k):
            own = gram[live, j, j]
            rest = cross[live, j] - np.einsum("ri,ri->r", gram[live, j], now) + own * now[:, j]
            below = own + alpha * (1 - share)
            step = np.sign(rest) * np.maximum(np.abs(rest) - alpha * share, 0.0)
            now[:, j] = np.where(below > 0, step / np.where(below > 0, below, 1.0), 0.0)
        w[live] = now
        size = np.maximum(1.0, np.abs(now).max(axis=1, initial=0.0))
        live = live[np.abs(now - before).max(axis=1, initial=0.0) > 1e-14 * size]
        if not len(live):
            break
    return w


# -- trees -----------------------------------------------------------------------------------
def _tree_fit(rows: DataFrame, n: int, model: str, params: dict[str, Any]) -> Fit:
    raw, filled = _columns(n)
    medians = list(rows.agg(*[F.percentile(x, 0.5) for x in raw]).first())
    whole = rows.select(
        *[F.coalesce(x, F.lit(m)).alias(f) for x, f, m in zip(raw, filled, medians, strict=True)],
        "label_value",
    )
    steps = [VectorAssembler(inputCols=filled, outputCol="features"), _regressor(model, params)]
    trees = Pipeline(stages=steps).fit(whole)
    return Fit(medians, list(trees.stages[-1].featureImportances.toArray()), trees)


def _tree_scores(part: DataFrame, fit: Fit, n: int) -> DataFrame:
    """Rows with the prediction of one tree model as ``raw_value``."""
    raw, filled = _columns(n)
    whole = part.withColumns(
        {f: F.coalesce(x, F.lit(m)) for x, f, m in zip(raw, filled, fit.medians, strict=True)}
    )
    return fit.trees.transform(whole).select(*KEYS, *raw, F.col("prediction").alias("raw_value"))


# -- walk forward ----------------------------------------------------------------------------
def walk_forward(
    dataset: DataFrame, request: CombinationRequest
) -> tuple[DataFrame, DataFrame]:
    """Scores, and model weights, from models refitted as labels become available.

    A label trains a fit once its exit time, the label lag and the embargo have passed; with a training window,
    the rows of the last periods of which a label is known. Linear models are one plan over all refits; of tree
    models the driver holds the refit times and fits one after the other.
    """
    p = dict(request.params)
    names, model = list(request.factor_names), str(p.get("model", "ridge")).lower()
    target, params = str(p.get("target_transform", "none")), p.get("model_params", {})
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; choose from {MODELS}")
    if target not in ("none", "demean", "zscore"):
        raise ValueError("target_transform must be none, demean or zscore")
    n, plan = len(names), Schedule.of(p)
    lag = (int(p.get("label_lag_bars", 1)) + int(p.get("embargo_bars", 0))) * bar_minutes(
        str(p["bar_type"])
    )
    raw, _ = _columns(n)
    features = prepare_features(dataset, names)
    renamed = features.select(
        *KEYS,
        *[F.when(finite(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(x) for c, x in zip(names, raw, strict=True)],
    )
    rows = materialize(renamed.join(prepare_target(dataset, request.training_horizon), KEYS, "left"))
    ready = rows.where(F.col("label_is_valid") & F.col("label_value").isNotNull()).withColumn(
        "_known", shift_time("exit_time", lag)
    )
    ready = trained_rows(ready, plan.window)
    present = sum((F.col(x).isNotNull().cast("int") for x in raw), F.lit(0))
    enough = present >= int(p.get("min_present_factors", 1))
    if model in LINEAR:
        scored, table = _linear_walk(rows, ready, names, model, target, params, plan)
    else:
        scored, table = _tree_walk(rows, ready, names, model, target, params, plan)
    good = F.coalesce(finite("raw_value") & enough, F.lit(False))
    flag = F.when(good, "").when(F.col("_fitted"), "MISSING_COMPONENT_FACTOR").otherwise("MODEL_WARMUP_INCOMPLETE")
    out = scored.select(
        *KEYS, F.when(good, F.col("raw_value")).alias("raw_value"), good.alias("factor_is_valid"),
        flag.alias("factor_quality_flags"),
    )
    return out, table


def _linear_walk(
    rows: DataFrame, ready: DataFrame, names: list[str], model: str, target: str, params: dict[str, Any],
    plan: Schedule,
) -> tuple[DataFrame, DataFrame]:
    n = len(names)
    raw, _ = _columns(n)
    # Moments are taken about one point per column: sums of squares of what lies far from 0 lose digits.
    about = [F.coalesce(F.avg(x), F.lit(0.0)).alias(f"_o{i}") for i, x in enumerate(raw)]
    gaps = [F.max(F.col(x).isNull()).alias(f"_g{i}") for i, x in enumerate(raw)]
    one = rows.agg(*about, *gaps).first()  # one row
    origin = [one[f"_o{i}"] for i in range(n)]
    missing = [i for i in range(n) if one[f"_g{i}"]]
    moved = ready.withColumns({x: F.col(x) - F.lit(o) for x, o in zip(raw, origin, strict=True)})
    moments = materialize(window_moments(rows, moved, n))
    refits = refit_times(moments, n, plan)
    if missing:
        refits = materialize(refits)
        refits = refits.join(window_medians(moved, refits, missing), "at")
    refits = refits.withColumns({f"d{i}": F.lit(0.0) for i in range(n) if i not in missing})
    fits = materialize(solve_fits(refits, n, model, target, params))

    def in_force(s: Series) -> dict[str, Column]:
        return {"_fit_at": s.fill("_own_fit")}

    times = moments.select("at").join(fits.select("at", F.col("at").alias("_own_fit")), "at", "left")
    times = over_series(times.withColumn("_one", F.lit(1)), ["_one"], ["at"], in_force, ["at"])
    got = rows.join(times.withColumnRenamed("at", "timestamp"), "timestamp", "left")
    got = got.join(fits.withColumnRenamed("at", "_fit_at"), "_fit_at", "left")
    value = F.col("b")
    for i, (x, o) in enumerate(zip(raw, origin, strict=True)):
        value = value + F.col(f"w{i}") * (F.coalesce(F.col(x) - F.lit(o), f"d{i}") - F.col(f"c{i}")) / F.col(f"s{i}")
    scored = got.select(*KEYS, *raw, value.alias("raw_value"), F.col("_fit_at").isNotNull().alias("_fitted"))
    listed = F.array(*[F.struct(F.lit(c).alias("factor_name"), F.col(f"w{i}").alias("weight")) for i, c in enumerate(names)])
    table = fits.select(F.col("at").alias("timestamp"), "fit", F.inline(listed)).withColumn("kind", F.lit("coefficient"))
    return scored, table


def _tree_walk(
    rows: DataFrame, ready: DataFrame, names: list[str], model: str, target: str, params: dict[str, Any],
    plan: Schedule,
) -> tuple[DataFrame, DataFrame]:
    n, spark = len(names), rows.sparkSession
    raw, _ = _columns(n)
    moments = materialize(window_moments(rows, ready, n))
    begins = [r["at"] for r in refit_times(moments, n, plan).select("at").orderBy("at").collect()]  # one per fit
    first = time_literal(begins[0]) if begins else F.lit(None).cast("timestamp_ntz")
    warm = rows.where(F.coalesce(F.col("timestamp") < first, F.lit(True)))
    scored = warm.select(*KEYS, *raw, F.lit(None).cast("double").alias("raw_value"), F.lit(False).alias("_fitted"))
    weights: list[tuple] = []
    for number, (at, end) in enumerate(zip(begins, [*begins[1:], None], strict=True), 1):
        now = time_literal(at)
        train = ready.where((F.col("_known") <= now) & (F.col("_leave").isNull() | (F.col("_leave") > now)))
        fitted = _tree_fit(transform_target(train, target), n, model, params)
        weights += [(at, number, c, float(v), "importance") for c, v in zip(names, fitted.weights, strict=True)]
        part = rows.where(F.col("timestamp") >= now)
        if end is not None:
            part = part.where(F.col("timestamp") < time_literal(end))
        scored = scored.unionByName(_tree_scores(part, fitted, n).withColumn("_fitted", F.lit(True)))
    table = spark.createDataFrame(
        weights, "timestamp timestamp_ntz, fit int, factor_name string, weight double, kind string"
    )
    return scored, table


register("machine_learning", lambda dataset, request: walk_forward(dataset, request)[0])
