"""Windows: running-sum form, exponential means, long series cut into runs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import candles
from tidemark.functions.rolling import FRAME_ROWS, Series, over_series
from tidemark.operators.factors import DEFAULT, Factor, FactorSpec, Registry, factor_columns, factor_history
from tidemark.operators.grid import asof_backward
from tidemark.operators.indicators import variable_ema


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(1)
    values = 100 + np.cumsum(rng.normal(size=700))
    pdf = pd.DataFrame({"k": "a", "t": range(700), "x": values})
    pdf.loc[:4, "x"] = np.nan
    df = spark.createDataFrame(pdf.astype({"x": object}).where(pdf.notna(), None), "k string, t int, x double")
    return df, pdf


def column(df, name):
    return df.orderBy("t").toPandas()[name].to_numpy(dtype=float)


@pytest.mark.parametrize("n", [10, 200])
def test_rolling_moments(walk, n):
    df, pdf = walk
    s = Series(df, ["k"], ["t"])
    out = s.build({"m": s.mean("x", n, 3), "s": s.std("x", n, 3), "t0": s.sum("x", n)})
    x = pdf["x"].rolling(n, min_periods=3)
    np.testing.assert_allclose(column(out, "m"), x.mean(), rtol=1e-9)
    np.testing.assert_allclose(column(out, "s"), x.std(), rtol=1e-6)
    np.testing.assert_allclose(column(out, "t0"), pdf["x"].rolling(n).sum(), rtol=1e-9)


def test_rolling_std_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([("a", t, 1e6 + 0.1) for t in range(300)], "k string, t int, x double")
    s = Series(df, ["k"], ["t"])
    out = column(s.build({"s": s.std("x", 100)}), "s")
    assert np.nanmax(out) == 0.0


@pytest.mark.parametrize("alpha", [1 / 3, 1 / 14, 2 / 27])
def test_ewm_forms_agree(walk, alpha):
    df, pdf = walk
    s = Series(df, ["k"], ["t"])
    out = s.build({"fold": s.ewm("x", alpha, 5), "block": s.ewm("x", alpha, 5, gapless=True)})
    want = pdf["x"].ewm(alpha=alpha, adjust=False, min_periods=5).mean()
    np.testing.assert_allclose(column(out, "fold"), want, rtol=1e-10)
    np.testing.assert_allclose(column(out, "block"), want, rtol=1e-10)


def test_ewm_with_inner_gaps(spark):
    x = [1.0, None, None, 4.0, 2.0, None, 3.0]
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(x)], "k string, t int, x double")
    s = Series(df, ["k"], ["t"])
    got = column(s.build({"y": s.ewm("x", 0.5), "z": s.ewm_adjusted("x", 0.5)}), "y")
    want = pd.Series(x, dtype=float).ewm(alpha=0.5, adjust=False, ignore_na=False).mean()
    mask = [v is not None for v in x]
    np.testing.assert_allclose(got[mask], want[mask])
    assert np.isnan(got[1])


def test_long_series_cut_into_runs_gives_the_same(spark, walk):
    df, _ = walk

    def make(s):
        event = s.add(F.when(F.col("t") % 150 == 7, F.col("t")))
        return {
            "m": s.mean("x", 20), "nxt": s.lead("x", 2), "lo": s.min("x", 7), "wide": s.std("x", 90, 3),
            "last": s.fill(event), "never": s.fill(s.add(F.when(F.col("t") < 0, F.col("t")))),
            "y": s.ewm("x", 0.3), "z": s.ewm_adjusted("x", 0.2), "deep": s.lag(s.mean(s.diff("x", 3), 70), 2),
        }

    whole = over_series(df, ["k"], ["t"], make, max_rows=700).orderBy("t").toPandas()
    cut = over_series(df, ["k"], ["t"], make, task_rows=37)
    pd.testing.assert_frame_equal(whole, cut.orderBy("t").toPandas()[whole.columns], rtol=1e-9)


def odd_series(spark, kind):
    rng = np.random.default_rng(11)
    x = [float(v) for v in 100 + np.cumsum(rng.normal(size=600))]
    if kind == "gappy":
        x = [v if t % 100 == 40 or 210 <= t < 230 else None for t, v in enumerate(x)]
    if kind == "nan":
        x[3] = float("nan")
    if kind == "late nan":
        x[450], x[100] = float("nan"), None
    rows = [("a", t, v) for t, v in enumerate(x)] + [("b", t, 2.0 * t) for t in range(90)] + [(None, t, 1.0) for t in range(50)]
    return spark.createDataFrame(rows, "k string, t int, x double"), x


def scans(s):
    event = s.add(F.when(F.col("t") % 97 == 5, F.col("t")))
    out = {f"e{n}": s.ewm("x", a, 5) for n, a in enumerate((0.5, 0.002, 1.0))} | {"j": s.ewm_adjusted("x", 0.01, 2)}
    total, wealth = s.cumsum("x"), s.cumprod(s.add(1 + F.col("x") * 1e-4))
    return out | {
        "twice": s.ewm(s.ewm("x", 0.2, 2), 0.1, 3), "total": total, "wealth": wealth, "fall": s.add(wealth / s.cummax(wealth)),
        "before": s.lag(total, 3), "last": s.fill(event), "older": s.lag(s.fill(event), 2), "peak": s.cummax_since("x", event.isNotNull()),
        "vary": variable_ema(s, "x", s.add(F.when(F.col("t") % 50 != 9, 0.1 + (F.col("t") % 7) * 0.15)), 0.1), "nth": s.seen("x"), "mean": s.running_mean("x"),
        "wide": s.mean(s.ewm("x", 0.4), 70, 1), "at": s.position(), "ahead": s.lead(total, 2),
    }


@pytest.mark.parametrize("kind", ["plain", "gappy", "nan", "late nan"])
def test_scans_are_the_same_whole_and_cut(spark, kind):
    df, _ = odd_series(spark, kind)
    whole = over_series(df, ["k"], ["t"], scans, max_rows=600).orderBy("k", "t").toPandas()
    for task_rows in (37,) if kind == "gappy" else (200,):
        cut = over_series(df, ["k"], ["t"], scans, task_rows=task_rows).orderBy("k", "t").toPandas()
        pd.testing.assert_frame_equal(whole, cut[whole.columns], rtol=1e-9)


def recursion(x, alpha, least):
    y, weight, seen, out = None, 1.0, 0, []
    for v in x:
        weight *= 1 - alpha
        if v is not None:
            y = v if y is None else (weight * y + alpha * v) / (weight + alpha)
            weight, seen = 1.0, seen + 1
        out.append(y if v is not None and seen >= least else None)
    return out


@pytest.mark.parametrize("kind", ["plain", "gappy", "nan", "late nan"])
# Alphas on both sides of what was once a limit (a weight of 1e-16 after 127 and 129 rows).
@pytest.mark.parametrize("alpha", [0.5, 0.2538, 0.2502, 0.05, 0.002])
def test_exponential_mean_is_the_plain_recursion(spark, kind, alpha):
    df, x = odd_series(spark, kind)
    s = Series(df.where("k = 'a'"), ["k"], ["t"])
    got = [r["y"] for r in s.build({"y": s.ewm("x", alpha, 5)}).orderBy("t").collect()]
    want = recursion(x, alpha, 5)
    assert [v is None for v in got] == [v is None for v in want]
    np.testing.assert_allclose([v for v in got if v is not None], [v for v in want if v is not None], rtol=1e-11)


def test_adaptive_mean_is_the_plain_recursion(spark):
    df, x = odd_series(spark, "gappy")
    alphas = [None if t % 50 == 9 else 0.1 + (t % 7) * 0.15 for t in range(600)]
    s = Series(df.where("k = 'a'"), ["k"], ["t"])
    alpha = s.add(F.when(F.col("t") % 50 != 9, 0.1 + (F.col("t") % 7) * 0.15))
    got = [r["y"] for r in s.build({"y": variable_ema(s, "x", alpha, 0.1)}).orderBy("t").collect()]
    y, seen, want = None, [], []
    for v, a in zip(x, alphas, strict=True):
        seen += [] if v is None else [v]
        if v is not None and a is not None:
            y = sum(seen) / len(seen) if y is None else y + a * (v - y)
        want.append(y)
    np.testing.assert_allclose(np.array(got, float), np.array(want, float), rtol=1e-11)


def test_a_window_of_unknown_reach_keeps_its_series_whole(spark, walk):
    df, pdf = walk
    got = over_series(df, ["k"], ["t"], lambda s: {"c": s.add(F.sum("x").over(s.running))}, task_rows=37)
    np.testing.assert_allclose(column(got, "c")[5:], pdf["x"].cumsum()[5:])


SOURCES = {
    "funding_rate": [0.01, None], "realized_rate": [0.02, None], "basis_rate": [0.1, 0.2], "open_interest_usd": [1e6, 2e6],
    "long_short_ratio": [1.2, 0.8], "market_cap_usd": [1e9, 2e9], "buy_volume": [60.0, 10.0], "sell_volume": [40.0, 20.0],
    "short_bankruptcy_loss": [1.0, 3.0], "long_bankruptcy_loss": [2.0, 1.0],
}
SMALL = {
    "realized_skewness": {"period": 70}, "realized_kurtosis": {"period": 70},
    "volume_confirmed_reversal_event": {"normalization_window": 80, "normalization_min_periods": 20, "smoothing_period": 5},
}


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(2)
    bars = candles(spark, 100 + np.cumsum(rng.normal(size=400)), quote=list(1000 + 50 * rng.random(400)))
    n = F.hour("timestamp") + F.day("timestamp") * 24
    # Funding is known once, early: a fill has to carry it through every run.
    values = {c: F.when(n % 3 == 0, F.lit(v[1])).otherwise(F.lit(v[0])) for c, v in SOURCES.items()}
    values["funding_rate"] = F.when(F.col("timestamp") == F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"), 0.01)
    return bars.withColumns({c: v.cast("double") for c, v in values.items()})


def specs():
    return [FactorSpec(n, SMALL.get(n, {})) for n in DEFAULT.names()] + [FactorSpec("own_mean")]


@pytest.fixture
def registry():
    own = Registry([DEFAULT.get(n) for n in DEFAULT.names()])
    own.register(Factor("own_mean", lambda s, p, bar: s.mean("close", 4)))
    return own


def test_every_factor_is_the_same_whole_and_cut(panel, registry, monkeypatch):
    whole = factor_columns(panel, specs(), "1h", registry=registry, max_rows=400).orderBy("timestamp").toPandas()
    monkeypatch.setattr("tidemark.functions.rolling.TASK_ROWS", 45)
    cut = factor_columns(panel, specs(), "1h", registry=registry).orderBy("timestamp").toPandas()
    names = [s.name for s in specs()]
    pd.testing.assert_frame_equal(whole[names], cut[names], rtol=1e-7, atol=1e-10)
    assert whole["report_carry"].notna().sum() > 300


def test_no_factor_looks_ahead(panel, registry):
    late = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    changed = panel.withColumns(
        {c: F.when(F.col("timestamp") >= late, F.col(c) * 1000 + 7).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume_quote")}
    )
    names = [s.name for s in specs()]
    both = [
        factor_columns(p, specs(), "1h", registry=registry, max_rows=400).where(F.col("timestamp") < late).orderBy("timestamp").toPandas()[names]
        for p in (panel, changed)
    ]
    pd.testing.assert_frame_equal(*both, rtol=1e-12, atol=0)


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), None])
def test_moments_on_both_sides_of_the_frame_limit(spark, odd):
    rng = np.random.default_rng(5)
    x = [float(v) for v in rng.normal(size=260) * 1e-7]
    x[199] = 1.0
    if odd is None or odd == odd:
        x[90] = odd
    else:
        x[90] = odd
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(x)], "k string, t int, x double")
    short, long = FRAME_ROWS, FRAME_ROWS + 1
    for n in (short, long):
        s = Series(df, ["k"], ["t"])
        got = s.build({"s": s.sum("x", n, 1), "m": s.mean("x", n, 1), "d": s.std("x", n, 2)}).orderBy("t").toPandas()
        for t in (64, 89, 90 + n - 1, 90 + n, 150 + n // 8, 198, 199, 259):
            window = [v for v in x[max(0, t - n + 1) : t + 1] if v is not None]
            np.testing.assert_allclose(got["s"][t], np.sum(window), rtol=1e-9, atol=1e-20)
            np.testing.assert_allclose(got["m"][t], np.mean(window), rtol=1e-9, atol=1e-20)
            with np.errstate(invalid="ignore"):
                np.testing.assert_allclose(got["d"][t], np.std(window, ddof=1), rtol=1e-8)


def test_no_bound_means_no_history(spark, panel):
    own = Registry([Factor("running", lambda s, p, bar: s.cumsum("close"))])
    with pytest.raises(ValueError, match="declare its history"):
        factor_history(own.get("running"), {}, "1h", panel)
    assert factor_history(Factor("own", lambda s, p, bar: s.lag(s.mean("close", 4))), {}, "1h", panel) == 4


def test_asof_does_not_depend_on_chunks(spark):
    rng = np.random.default_rng(4)
    base = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"k": rng.choice(list("ab"), 300), "i": range(300)})
    left["timestamp"] = base + pd.to_timedelta(rng.integers(0, 50_000, 300), unit="min")
    right = pd.DataFrame({"k": rng.choice(list("ab"), 40), "v": rng.normal(size=40)})
    right["timestamp"] = base + pd.to_timedelta(rng.permutation(50_000)[:40], unit="min")
    schema = "timestamp timestamp_ntz"
    lf = spark.createDataFrame(left[["k", "i", "timestamp"]], f"k string, i int, {schema}")
    rf = spark.createDataFrame(right[["k", "v", "timestamp"]], f"k string, v double, {schema}")
    want = pd.merge_asof(
        left.sort_values("timestamp"), right.sort_values("timestamp"), on="timestamp", by="k"
    ).sort_values("i")["v"].to_numpy()
    for chunk in (600, 10_000, 10_000_000):
        got = asof_backward(lf, rf, ["k"], ["v"], chunk_minutes=chunk).orderBy("i").toPandas()["v"]
        np.testing.assert_allclose(got.to_numpy(dtype=float), want)
    fresh = asof_backward(lf, rf, ["k"], ["v"], tolerance_minutes=500, chunk_minutes=900)
    assert fresh.where(F.col("v").isNotNull()).count() < np.isfinite(want).sum()
