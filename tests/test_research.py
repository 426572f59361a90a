"""Labels, analytics, redundancy and combinations on tiny datasets."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import hours
from tidemark.functions import moments
from tidemark.operators import analytics, combine, labels, redundancy
from tidemark.operators.analytics import factor_correlation

LB = "venue string, instrument_id string, bar_type string, timestamp timestamp_ntz, open double, volume double"


def label_bars(spark, opens, volumes=None, skip=()):
    rows = [
        ("X", "A", "1h", t, float(o), float(v))
        for i, (t, o, v) in enumerate(zip(hours(len(opens)), opens, volumes or [1] * len(opens), strict=True))
        if i not in skip
    ]
    return spark.createDataFrame(rows, LB)


def run(bars, h, **kw):
    return labels.execution_return(bars, [h], "1h", max_rows=100, **kw).orderBy("timestamp").collect()


def test_label_return_and_cost(spark):
    row = run(label_bars(spark, [100, 101, 102, 103, 106, 107]), 4, cost_bps=10.0)[0]
    assert row.gross_return == pytest.approx(0.06) and row.net_return == pytest.approx(0.059)
    assert row.label_name == "execution_return_4bars_cost=10bps"


def test_label_gap(spark):
    row = run(label_bars(spark, [100] * 6, skip=[2]), 2)[0]
    assert row.label_quality_flags == "NON_CONTIGUOUS_HORIZON" and row.label_value is None


def test_label_zero_volume(spark):
    rows = run(label_bars(spark, [100, 101, 102], [1, 0, 1]), 1)
    assert [r.label_quality_flags for r in rows] == [
        "NON_TRADING_EXIT", "NON_TRADING_ENTRY", "MISSING_FUTURE_PRICE"
    ]
    assert rows[0].gross_return == pytest.approx(0.01) and rows[0].label_value is None


DS = (
    "venue string, instrument_id string, bar_type string, timestamp timestamp_ntz, factor_name string, "
    "factor_key string, factor_version string, raw_value double, value double, factor_is_valid boolean, "
    "factor_quality_flags string, label_name string, horizon_bars int, round_trip_cost_bps double, "
    "entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, "
    "gross_return double, net_return double, label_value double, label_is_valid boolean, "
    "label_quality_flags string, is_valid boolean"
)


def dataset(spark, n_hours=3, factors=None, label=lambda a, h: a + h):
    factors = factors or {"positive": lambda a, h: a + h, "negative": lambda a, h: -(a + h)}
    rows = []
    for h, t in enumerate(hours(n_hours)):
        for a in range(5):
            y = float(label(a, h))
            for name, f in factors.items():
                v = float(f(a, h))
                rows.append(
                    ("X", f"ASSET-{a}", "1h", t, name, name, "1", v, v, True, "", "execution_return_1bars", 1,
                     0.0, t, t + timedelta(hours=1), 100.0, 100.0 + y, y, y, y, True, "", True)
                )
    return spark.createDataFrame(rows, DS)


def test_ic_and_quantiles(spark):
    ds = dataset(spark)
    ic = {r.factor_name: r.ic for r in analytics.ic_series(ds).collect()}
    assert ic == {"positive": pytest.approx(1.0), "negative": pytest.approx(-1.0)}
    five = analytics.quantile_returns(ds, 5).where("factor_name = 'positive'").orderBy("quantile")
    assert [r.mean_return for r in five.collect()] == [1.0, 2.0, 3.0, 4.0, 5.0]
    two = analytics.quantile_returns(ds, 2).where("factor_name = 'positive'").orderBy("quantile")
    assert [r.observations for r in two.collect()] == [9, 6]
    spread = analytics.quantile_spread(analytics.quantile_returns(ds, 5)).where(
        "factor_name = 'positive'"
    ).first()
    assert spread.long_short_return == 4.0 and spread.monotonicity == pytest.approx(1.0)
    pairs = analytics.factor_correlation(ds, ["positive", "negative"]).collect()
    cross = [r for r in pairs if r.factor_left != r.factor_right][0]
    assert cross.correlation == pytest.approx(-1.0) and len(pairs) == 3


def test_constant_factor_has_no_ic(spark):
    ds = dataset(spark, factors={"flat": lambda a, h: 1.0})
    assert analytics.ic_series(ds, "pearson").count() == 0
    assert analytics.overall_ic(ds).first().ic is None


def test_purged_split(spark):
    ds = dataset(spark)
    train, valid = labels.purged_time_split(ds, hours(3)[2], 0)
    assert train.select("timestamp").distinct().count() == 1
    assert valid.select("timestamp").distinct().count() == 1


def test_redundancy_of_mirrored_factors(spark):
    ds = dataset(spark, 20)
    rows = redundancy.vif(ds, ["positive", "negative"]).collect()
    assert all(r.vif > 1000 and r.status == "HIGH" for r in rows)
    series = redundancy.unique_contribution(ds, ["positive", "negative"], min_observations=5)
    assert series.agg(F.max("incremental_r_squared")).first()[0] < 1e-8
    corr = analytics.factor_correlation(ds, ["positive", "negative"])
    groups = redundancy.clusters(corr, analytics.overall_ic(ds), 0.8).collect()
    assert {r.cluster_id for r in groups} == {"R1"}
    assert {r.representative for r in groups} == {"positive"}


def test_chain_of_factors_is_one_cluster(spark):
    names = [f"f{i:02d}" for i in range(9)]
    rows = [(a, b, 0.9 if j - i == 1 else 0.0) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    corr = spark.createDataFrame(rows, "factor_left string, factor_right string, correlation double")
    ic = spark.createDataFrame([(n, 0.1) for n in names], "factor_name string, ic double")
    out = redundancy.clusters(corr, ic).collect()
    assert {r.cluster_size for r in out} == {9} and {r.representative for r in out} == {"f08"}


PAIR = ("quality", "reversal")


def pair(spark, n=1):
    fs = {"quality": lambda a, h: a, "reversal": lambda a, h: -a}
    return dataset(spark, n, fs, label=lambda a, h: a)


def score(df):
    return {r.instrument_id: r.raw_value for r in df.collect()}


def test_static_combinations(spark):
    ds = pair(spark)
    weights = {"weights": {"quality": 1.0, "reversal": 0.0}}
    feats = combine.prepare_features(ds, PAIR)
    linear = score(combine.linear(feats, combine.CombinationRequest("linear", PAIR, params={"weights": {"quality": 3.0, "reversal": 1.0}})))
    assert linear["ASSET-4"] == pytest.approx(2.0)
    ranked = score(combine.rank(feats, combine.CombinationRequest("rank", PAIR, params=weights)))
    assert ranked["ASSET-4"] == pytest.approx(1.0) and ranked["ASSET-0"] == pytest.approx(-1.0)
    rules = {"conditions": [{"factor": "quality", "operator": "ge", "value": 1}], "pass_score": 1.0}
    got = combine.rule(feats, combine.CombinationRequest("rule", PAIR, params=rules))
    assert got.where("factor_is_valid").count() == 4
    assert {r.factor_quality_flags for r in got.collect()} == {"", "RULE_NOT_MATCHED"}
    with pytest.raises(ValueError):
        combine.prepare_features(ds, ("quality", "absent"))


def test_ic_weights_use_matured_labels_only(spark):
    ds = pair(spark, 8)
    request = combine.CombinationRequest(
        "ic_weighted", PAIR, params={"window": 3, "min_periods": 2, "bar_type": "1h"}
    )
    w = combine.ic_weights(ds, combine.prepare_features(ds, PAIR), request, "1h").collect()
    assert min(r.timestamp for r in w) == hours(8)[3]
    assert all(r.latest_label_exit_time + timedelta(hours=1) <= r.timestamp for r in w)
    assert {r.factor_name: r.weight for r in w} == {"quality": pytest.approx(0.5), "reversal": pytest.approx(-0.5)}
    combined = combine.combine(ds, request)
    early = combined.where(F.col("timestamp") < F.lit(str(hours(8)[3])).cast("timestamp_ntz"))
    assert {r.factor_quality_flags for r in early.collect()} == {"IC_WARMUP_INCOMPLETE"}


def test_walk_forward_ridge_learns_and_waits(spark):
    from tidemark.operators import models

    ds = dataset(spark, 14, {"f": lambda a, h: a + 0.1 * h, "g": lambda a, h: (a * 7 + h) % 5}, lambda a, h: 2.0 * a)
    request = combine.CombinationRequest(
        "machine_learning", ("f", "g"),
        params={"bar_type": "1h", "min_train_observations": 10, "min_train_periods": 3, "retrain_every": 4},
    )
    scores, weights = models.walk_forward(ds, request)
    rows = scores.collect()
    assert {r.factor_quality_flags for r in rows if r.timestamp < hours(14)[4]} == {"MODEL_WARMUP_INCOMPLETE"}
    late = [r for r in rows if r.timestamp == hours(14)[13]]
    order = sorted(late, key=lambda r: r.raw_value)
    assert [r.instrument_id for r in order] == [f"ASSET-{i}" for i in range(5)]
    assert weights.select("fit").distinct().count() >= 2


def test_report_tables(spark):
    tables = analytics.report(dataset(spark, 4), ["positive", "negative"], period_minimum=5)
    counts = {n: t.count() for n, t in tables.items()}
    assert counts["ic_summary"] == 2 and counts["factor_correlation"] == 3
    assert np.all([c > 0 for c in counts.values()])


def test_study_neutralizes_and_labels(spark):
    from conftest import BARS, candles
    from tidemark.operators.factors import FactorSpec
    from tidemark.plans.experiments import Study, factor_experiment

    rng = np.random.default_rng(8)
    bars = None
    for i in range(8):
        one = candles(
            spark, 100 + np.cumsum(rng.normal(size=60)), quote=list(rng.uniform(10, 90, 60)), name=f"I{i}"
        )
        bars = one if bars is None else bars.unionByName(one)
    assert BARS.startswith("venue")
    study = Study(
        (FactorSpec("momentum", {"lookback": 2}), FactorSpec("turnover", {"period": 3})), "1h",
        hours(60)[10], hours(60)[50], horizons=(1, 2), exposures=("turnover",),
    )
    tables = factor_experiment(bars, study)
    ds = tables["dataset"].where("horizon_bars = 1")
    assert ds.groupBy("factor_name").count().count() == 2
    assert ds.agg(F.min("timestamp")).first()[0] == hours(60)[10]
    left = ds.alias("a").where("factor_key = 'momentum'").select("instrument_id", "timestamp", "value")
    size = ds.where("factor_key = 'turnover'").select("instrument_id", "timestamp", "raw_value")
    rest = left.join(size, ["instrument_id", "timestamp"]).groupBy("timestamp").agg(
        F.abs(F.covar_pop("value", "raw_value")).alias("c")
    )
    assert rest.agg(F.max("c")).first()[0] < 1e-9
    assert tables["ic_summary"].count() > 0


def gappy_panel(spark, n=400, seed=0):
    """Four factors of which two have the same gaps, one others and one none; values tie."""
    rng = np.random.default_rng(seed)
    gaps, other = rng.random(n) < 0.2, rng.random(n) < 0.3
    wide = pd.DataFrame({"a": rng.integers(0, 30, n), "b": rng.integers(0, 9, n), "c": rng.normal(size=n).round(1), "d": rng.normal(size=n)}).astype(float)
    wide.loc[gaps, ["a", "b"]] = np.nan
    wide.loc[other, "c"] = np.nan
    rows = [
        ("v", f"i{i % 20}", datetime(2024, 1, 1 + i // 20), name, float(wide[name][i]))
        for i in range(n) for name in wide if not np.isnan(wide[name][i])
    ]
    df = spark.createDataFrame(rows, "venue string, instrument_id string, timestamp timestamp, factor_name string, value double")
    return wide, df


@pytest.mark.parametrize("method", ["spearman", "pearson"])
@pytest.mark.parametrize("bounded", [True, False])
def test_factor_correlation_with_gaps(spark, method, bounded):
    wide, df = gappy_panel(spark)
    got = {(r["factor_left"], r["factor_right"]): r for r in factor_correlation(df, [*wide, "absent"], method, bounded=bounded).collect()}
    assert len(got) == 15
    for i, a in enumerate(wide):
        for b in [*wide][i:]:
            both = wide[[a, b]].dropna() if a != b else wide[[a]].dropna()
            row = got[a, b]
            assert row["observations"] == len(both)
            want = 1.0 if a == b else (both.rank() if method == "spearman" else both)[a].corr((both.rank() if method == "spearman" else both)[b])
            assert row["correlation"] == pytest.approx(want, abs=1e-9), (a, b)
    assert got["a", "absent"]["observations"] == 0 and got["a", "absent"]["correlation"] is None


def test_stacked_systems_match_single_ones():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 40, 4))
    x[3, :, 1] = x[3, :, 0]  # collinear
    x[4, :, 2] = 1.0  # without spread
    x[5] *= 1e-14
    cov = np.stack([np.cov(one, rowvar=False, bias=True) for one in x])
    cov[6, 0, 0] = np.nan
    n = rng.integers(5, 50, 30).astype(float)
    for c in (cov, moments.scaled_stack(cov)):
        if c is not cov:
            assert np.array_equal(c, np.stack([moments.scaled(one) for one in cov]), equal_nan=True)
        for xs, y in (([], 0), ([0], 3), ([0, 1, 2], 3), ([2, 0], 1)):
            beta, sound = moments.slopes_stack(n, c, xs, y, 0.0)
            share, given = moments.fit_quality_stack(n, c, xs, y, beta)
            for i in range(30):
                want = moments.slopes(n[i], c[i], xs, y, 0.0)
                assert sound[i] == (want is not None)
                if want is not None:
                    assert np.allclose(beta[i], want, rtol=1e-6)
                    quality = moments.fit_quality(n[i], c[i], xs, y, want)
                    assert given[i] == (quality is not None)
                    assert quality is None or share[i] == pytest.approx(quality, abs=1e-9, nan_ok=True)
