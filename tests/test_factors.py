"""Factor expectations on tiny panels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import candles, hours
from tidemark.operators import processing
from tidemark.operators.factors import (
    DEFAULT,
    Factor,
    FactorSpec,
    Registry,
    compute_factors,
    factor_columns,
)
from tidemark.queries import REGISTRY


def values(df, name):
    return df.orderBy("timestamp").toPandas()[name].to_numpy(dtype=float)


def one(bars, key, bar="1h", **params):
    spec = FactorSpec(key, params)
    return values(factor_columns(bars, [spec], bar, max_rows=1000), spec.name)


def test_momentum_warm_up(spark):
    got = one(candles(spark, range(100, 140)), "momentum")
    assert np.isnan(got[23])
    assert got[24] == pytest.approx(math.log(124 / 100))


def test_realized_moments(spark):
    closes = [100, 101, 99, 102, 101]
    bars = candles(spark, closes)
    r = np.diff(np.log(closes))
    skew = one(bars, "realized_skewness", period=4)
    kurt = one(bars, "realized_kurtosis", period=4)
    assert skew[4] == pytest.approx(2 * (r**3).sum() / (r**2).sum() ** 1.5)
    assert kurt[4] == pytest.approx(4 * (r**4).sum() / (r**2).sum() ** 2)
    assert np.isnan(skew[3])


def test_quarter_hour_pressure(spark):
    bars = candles(spark, [101] * 75, quote=[1000] * 75, minutes=1, high=102, low=98, open_=100)
    got = one(bars, "quarter_hour_volume_pressure", "1m")
    assert np.isnan(got[58])
    assert list(got[59:62]) == [0.0, 0.5, 0.0]


def test_relative_volume(spark):
    got = one(candles(spark, [100] * 5, quote=[10, 10, 10, 10, 30]), "relative_volume", period=3)
    assert np.isnan(got[1]) and got[2] == 1.0 and got[4] == pytest.approx(1.8)


def test_reversal_event_fires_once(spark):
    closes = [100, 101, 102, 103, 104, 105, 106, 80, 79, 78]
    bars = candles(spark, closes, quote=[10] * 7 + [40] * 3)
    got = one(
        bars, "volume_confirmed_reversal_event", momentum_lookback=1, normalization_window=6,
        normalization_min_periods=3, smoothing_period=1, volume_period=3, signal_threshold=1.5,
        minimum_relative_volume=1.5,
    )
    fired = [i for i, v in enumerate(got) if np.isfinite(v) and v > 0]
    assert fired == [7] and got[7] > 1.5


def test_every_factor_returns_one_row_per_bar(spark):
    bars = candles(spark, range(100, 160))
    extra = {
        "funding_rate": 0.0001, "realized_rate": 0.0001, "basis_rate": 0.01, "open_interest_usd": 1e6,
        "long_short_ratio": 1.2, "market_cap_usd": 1e9, "buy_volume": 60.0, "sell_volume": 40.0,
    }
    bars = bars.withColumns({n: F.lit(v) for n, v in extra.items()})
    for m in ("bankruptcy_loss", "notional", "size"):
        bars = bars.withColumns({f"short_{m}": F.lit(1.0), f"long_{m}": F.lit(3.0)})
    specs = [FactorSpec(n) for n in DEFAULT.names()]
    out = factor_columns(bars, specs, "1h", max_rows=100)
    assert out.count() == 60
    last = out.orderBy(F.desc("timestamp")).first()
    assert last["taker_imbalance"] == pytest.approx(0.2)
    assert last["liquidation_imbalance"] == pytest.approx(-0.5)


def test_future_does_not_change_the_past(spark):
    closes = list(100 + np.sin(np.arange(80)) * 5)
    changed = closes[:60] + [c * 3 for c in closes[60:]]
    names = [n for n in DEFAULT.names() if not DEFAULT.get(n).needs]
    small = {"period": 10, "long_period": 20, "short_period": 5, "volume_period": 5,
             "normalization_window": 20, "normalization_min_periods": 5, "smoothing_period": 2}
    specs = [FactorSpec(n, small) for n in names]
    a = factor_columns(candles(spark, closes), specs, "1h", max_rows=100).orderBy("timestamp").toPandas()
    b = factor_columns(candles(spark, changed), specs, "1h", max_rows=100).orderBy("timestamp").toPandas()
    for s in specs:
        np.testing.assert_allclose(
            a[s.name][:60].to_numpy(dtype=float), b[s.name][:60].to_numpy(dtype=float), rtol=1e-9,
            err_msg=s.name,
        )


def test_request_shifts_and_cuts(spark):
    bars = candles(spark, range(100, 148))
    at = hours(48)
    out = compute_factors(bars, [FactorSpec("momentum", {"lookback": 2})], "1h", start=at[10], end=at[20])
    rows = out.orderBy("timestamp").collect()
    assert [r.timestamp for r in rows] == at[10:20]
    assert rows[0].raw_value == pytest.approx(math.log(109 / 107))


def test_attached_labels_belong_to_the_stamped_bar(spark):
    bars = candles(spark, [100, 101, 102, 104, 108, 116])
    out = compute_factors(
        bars, [FactorSpec("momentum", {"lookback": 1})], "1h", horizons=[1], max_rows=10
    ).orderBy("timestamp").collect()
    first = out[0]
    assert first.timestamp == hours(2)[1]
    assert first.labels[0].entry_price == 100.5
    assert first.labels[0].gross_return == pytest.approx(101.5 / 100.5 - 1)
    assert out[-1].labels is None


def test_registry_guards_names():
    r = Registry()
    f = Factor("mine", lambda s, p, bar: F.col("close"))
    r.register(f)
    with pytest.raises(ValueError):
        r.register(f)
    r.register(f, replace=True)
    with pytest.raises(KeyError):
        r.get("other")


RAW = (
    "venue string, instrument_id string, bar_type string, timestamp timestamp_ntz, factor_name string, "
    "factor_key string, factor_version string, raw_value double"
)


def section(spark, values, factor="f"):
    at = hours(1)[0]
    rows = [("X", f"I{i}", "1h", at, factor, factor, "1", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, RAW)


def test_small_cross_section_is_flagged(spark):
    out = processing.process(section(spark, [1.0, 2.0, 3.0]), standard={"method": "zscore"}).collect()
    assert all(r.value is None and r.quality_flags == "INSUFFICIENT_CROSS_SECTION" for r in out)


def test_non_finite_values_are_flagged(spark):
    out = processing.process(section(spark, [1.0, float("nan"), float("inf"), None, 2.0]))
    flags = [r.quality_flags for r in out.orderBy("instrument_id").collect()]
    assert flags == ["", *["NON_FINITE_RAW_VALUE"] * 3, ""]


def test_neutralized_residuals_vanish(spark):
    df = section(spark, [1 + 2.0 * x for x in range(6)])
    exposure = section(spark, [float(x) for x in range(6)], "size")
    out = processing.process(df, exposures=exposure, exposure_names=["size"], neutral={"min_observations": 3})
    assert max(abs(r.value) for r in out.collect()) < 1e-7


def test_rolling_zscore_warm_up(spark):
    rows = [("X", "A", "1h", t, "f", "f", "1", float(i)) for i, t in enumerate(hours(10))]
    out = processing.process(
        spark.createDataFrame(rows, RAW),
        standard={"method": "zscore", "scope": "time_series", "window": 5, "min_periods": 5},
        max_rows=10,
    ).orderBy("timestamp").collect()
    assert [r.quality_flags for r in out[:4]] == ["WARMUP_INCOMPLETE"] * 4
    assert out[4].value == pytest.approx(2 / math.sqrt(2.5))


@pytest.mark.parametrize("outlier", ["mad", "std", "winsorize"])
@pytest.mark.parametrize("standard", ["zscore", "robust_zscore", "rank"])
def test_sliced_and_whole_sections_agree(spark, monkeypatch, outlier, standard):
    rng = np.random.default_rng(9)
    df = section(spark, [float(round(v, 1)) for v in rng.normal(size=120)])
    steps = dict(outlier={"method": outlier, "threshold": 1.0}, standard={"method": standard})
    a = processing.process(df, bounded=True, **steps).orderBy("instrument_id").toPandas()
    monkeypatch.setattr("tidemark.functions.groups.TASK_ROWS", 25)
    b = processing.process(df, bounded=False, **steps).orderBy("instrument_id").toPandas()
    np.testing.assert_allclose(a["value"], b["value"], rtol=1e-9)


def test_registered_factor_takes_zero_closes(spark, tmp_path):
    """A day that closes at 0 has an infinite range, or none at all where it was 0 throughout."""
    rows = [(1, hours(1)[0], 7, "view", 5.0), (2, hours(2)[1], 7, "view", 0.0), (3, hours(1)[0], 8, "view", 0.0)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = REGISTRY["factor_user_registered"].run(spark, str(tmp_path)).collect()
    by_name = {r.instrument_id: r.raw_value for r in got}
    assert by_name["7"] == math.inf and math.isnan(by_name["8"])


def test_report_momentum_from_a_zero_close(spark):
    got = one(candles(spark, [0, 5, 7, 0, 0, 3]), "report_momentum", window=2)
    assert got[3] == math.inf and got[4] == -1.0 and got[5] == -1.0
