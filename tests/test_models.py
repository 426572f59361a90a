"""Walk-forward models against a plain loop over refits."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.operators.combine import CombinationRequest, prepare_features

TALL = (
    "venue string, instrument_id string, bar_type string, timestamp timestamp_ntz, factor_name string, value double, "
    "factor_is_valid boolean, horizon_bars int, exit_time timestamp_ntz, label_value double, label_is_valid boolean"
)
NAMES = ("fa", "fb", "fc")
START = datetime(2024, 1, 1)


def panel(gaps=True, times=60, seed=0):
    """Rows (instrument, time index, features, exit index, label, label valid)."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(times):
        for i in range(7):
            if rng.random() < 0.15:
                continue
            x = rng.normal(size=3) * [3.0, 0.5, 1e-3] + [1.0, -2.0, 50.0]
            y = 0.004 * x[0] - 0.02 * x[1] + 3.0 * (x[2] - 50) + 0.01 * rng.normal()
            if gaps:
                x[rng.random(3) < 0.1] = np.nan
            # Exits are late where bars are missing.
            late = 2 + (rng.random() < 0.1) * 3
            rows.append((f"I{i}", t, x, t + int(late), y, rng.random() > 0.1))
    return rows


def frame(spark, rows):
    at = [START + timedelta(hours=h) for h in range(200)]
    tall = [
        ("X", who, "1h", at[t], name, None if np.isnan(v) else float(v), not np.isnan(v), 1, at[end], float(y), bool(ok))
        for who, t, x, end, y, ok in rows
        for name, v in zip(NAMES, x, strict=True)
    ]
    return spark.createDataFrame(tall, TALL)


def plain_fit(model, x, y, params):
    med = np.nanmedian(x, axis=0)
    x = np.where(np.isnan(x), med, x)
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    z, n = (x - mean) / sd, len(y)
    if model == "ridge":
        w = np.linalg.solve(z.T @ z + params["alpha"] * np.eye(3), z.T @ (y - y.mean()))
    else:
        alpha, share, w = params["alpha"], params["l1_ratio"], np.zeros(3)
        for _ in range(5000):
            for j in range(3):
                r = y - y.mean() - z @ w + z[:, j] * w[j]
                c = z[:, j] @ r / n
                w[j] = np.sign(c) * max(abs(c) - alpha * share, 0) / (z[:, j] @ z[:, j] / n + alpha * (1 - share))
    return lambda q: y.mean() + ((np.where(np.isnan(q), med, q) - mean) / sd) @ w, w


def plain_walk(rows, model, p):
    """Scores by (instrument, time) and slopes by time, refit by refit."""
    lag = p.get("label_lag_bars", 1) + p.get("embargo_bars", 0)
    scores, slopes, last, predict = {}, {}, None, None
    for i, t in enumerate(sorted({r[1] for r in rows})):
        if i >= p["min_train_periods"] and (last is None or i - last >= p["retrain_every"]):
            train = [r for r in rows if r[5] and r[3] + lag <= t]
            window = p.get("train_window_periods")
            if window:
                kept = sorted({r[1] for r in train})[-window:]
                train = [r for r in train if r[1] in kept]
            x = np.array([r[2] for r in train]).reshape(-1, 3)
            periods = len({r[1] for r in train})
            if len(train) >= p["min_train_observations"] and periods >= p["min_train_periods"] and not np.isnan(x).all(0).any():
                y = np.array([r[4] for r in train])
                if p["target_transform"] != "none":
                    y = y - y.mean()
                if p["target_transform"] == "zscore" and y.std() > 0:
                    y = y / y.std()
                predict, slopes[t] = plain_fit(model, x, y, p["model_params"])
                last = i
        for who, at, q, *_ in rows:
            if at == t:
                ok = predict is not None and np.isfinite(q).sum() >= p.get("min_present_factors", 1)
                scores[who, t] = float(predict(q)) if ok else None
    return scores, slopes


def walked(spark, rows, p):
    request = CombinationRequest("machine_learning", NAMES, name="model", params={"bar_type": "1h", **p})
    out, table = models.walk_forward(frame(spark, rows), request)
    hour = lambda t: int((t - START).total_seconds() // 3600)
    scores = {(r["instrument_id"], hour(r["timestamp"])): r["raw_value"] for r in out.collect()}
    slopes = {}
    for r in table.collect():
        slopes.setdefault(hour(r["timestamp"]), {})[r["factor_name"]] = (r["fit"], r["weight"])
    return scores, slopes, out


BASE = {"min_train_observations": 30, "min_train_periods": 6, "retrain_every": 5}
CASES = [
    {"model": "ridge", "target_transform": "none", "model_params": {"alpha": 2.0}},
    {"model": "ridge", "target_transform": "zscore", "model_params": {"alpha": 1.0}, "train_window_periods": 12, "embargo_bars": 2},
    {"model": "elastic_net", "target_transform": "demean", "model_params": {"alpha": 0.002, "l1_ratio": 0.5}, "train_window_periods": 20,
     "min_present_factors": 2},
]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("gaps", [True, False])
def test_walk_is_the_plain_loop(spark, case, gaps):
    rows, p = panel(gaps), BASE | case
    want, slopes = plain_walk(rows, case["model"], p)
    got, found, _ = walked(spark, rows, p)
    assert got.keys() == want.keys() and found.keys() == slopes.keys() and len(slopes) > 5
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, rel=1e-8, abs=1e-11))
    for number, t in enumerate(sorted(slopes), 1):
        for name, w in zip(NAMES, slopes[t], strict=True):
            assert found[t][name] == (number, pytest.approx(w, rel=1e-7, abs=1e-10))


def test_schedule_waits_where_data_stop(spark):
    """Where the window runs out of rows no fit takes place, and the old one stays in force."""
    rows = [r for r in panel(False, 90, seed=1) if not 25 <= r[1] < 60 or r[0] == "I0"]
    p = BASE | {"model": "ridge", "target_transform": "none", "model_params": {"alpha": 1.0}, "train_window_periods": 8}
    want, slopes = plain_walk(rows, "ridge", p)
    got, found, out = walked(spark, rows, p)
    assert found.keys() == slopes.keys() and max(np.diff(sorted(slopes))) > 5
    assert all(got[k] == pytest.approx(v, rel=1e-8) for k, v in want.items() if v is not None)
    flags = {r["factor_quality_flags"] for r in out.collect()}
    assert flags == {"", "MODEL_WARMUP_INCOMPLETE"}


def test_cut_time_line_changes_nothing(spark, monkeypatch):
    rows = panel(True, 40)
    p = BASE | CASES[1]
    whole, slopes, _ = walked(spark, rows, p)
    monkeypatch.setattr("tidemark.functions.rolling.TASK_ROWS", 17)
    cut, other, _ = walked(spark, rows, p)
    assert slopes.keys() == other.keys()
    assert all(cut[k] == pytest.approx(v, rel=1e-9) if v is not None else cut[k] is None for k, v in whole.items())


def test_flat_and_missing_features(spark):
    rows = [(a, t, np.array([1.5, x[1], np.nan]), e, y, ok) for a, t, x, e, y, ok in panel(False, 20)]
    p = BASE | CASES[0]
    scores, slopes, _ = walked(spark, rows, p)
    assert slopes == {} and set(scores.values()) == {None}
    rows = [(a, t, np.array([1.5, x[1], x[2]]), e, y, ok) for a, t, x, e, y, ok in rows]
    rows = [(a, t, np.where(np.isnan(x), 50.0 + t % 3, x), e, y, ok) for a, t, x, e, y, ok in rows]
    _, slopes, _ = walked(spark, rows, p)
    assert slopes and all(s["fa"][1] == 0.0 for s in slopes.values())


@pytest.mark.parametrize("model", ["random_forest", "hist_gradient_boosting"])
def test_trees_follow_the_same_schedule(spark, model):
    rows = panel(True, 24)
    p = BASE | {"model": model, "target_transform": "demean", "model_params": {"n_estimators": 2, "max_depth": 2, "max_iter": 2}, "retrain_every": 9}
    _, slopes = plain_walk(rows, "ridge", p | {"model_params": {"alpha": 1.0}})
    scores, found, _ = walked(spark, rows, p)
    assert found.keys() == slopes.keys()
    first = min(slopes)
    assert all((v is not None) == (k[1] >= first) for k, v in scores.items() if np.isfinite([r[2] for r in rows if r[:2] == k][0]).any())


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError, match="unknown model"):
        walked(spark, panel(False, 3), BASE | {"model": "oracle"})
    with pytest.raises(ValueError, match="target_transform must be"):
        walked(spark, panel(False, 3), BASE | {"target_transform": "rank"})


def test_features_are_one_aggregate(spark):
    """Neither a sort aggregate nor a pivot of the tall rows; the greatest of repeated values counts (F19)."""
    rows = panel(True, 4)
    tall = frame(spark, rows)
    twice = tall.unionByName(tall.withColumn("value", F.col("value") - 1))
    got = prepare_features(twice, NAMES, check=False)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "pivot" not in plan.lower()
    want = {(f"I{r[0][1:]}", START + timedelta(hours=r[1])): [None if np.isnan(v) else v for v in r[2]] for r in rows}
    assert {(r.instrument_id, r.timestamp): [r[n] for n in NAMES] for r in got.collect()} == want
