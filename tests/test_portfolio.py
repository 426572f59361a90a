"""Portfolio accounting on tiny books."""

from datetime import datetime, timedelta

import pytest

from conftest import hours
from tidemark.operators import performance as perf
from tidemark.operators import portfolio as pf

DS = (
    "factor_name string, label_name string, horizon_bars int, timestamp timestamp_ntz, "
    "exit_time timestamp_ntz, instrument_id string, value double, gross_return double, entry_price double, "
    "factor_is_valid boolean, label_is_valid boolean, is_valid boolean"
)
START = datetime(2024, 1, 1)


def section(spark, n=2):
    rows = []
    for t in hours(n):
        for i in range(5):
            rows.append(
                ("f", "execution_return_1bars", 1, t, t + timedelta(hours=1), f"A{i}", float(i - 2),
                 0.02 - 0.01 * i, 100.0, True, True, True)
            )
    return spark.createDataFrame(rows, DS)


def test_quantile_portfolio_accounting(spark):
    book = pf.quantile_portfolio(
        section(spark), "f", start=START, timeframe="1h", quantiles=5, cost_bps=16.0
    ).orderBy("timestamp").collect()
    assert book[0].turnover == pytest.approx(0.5)
    assert book[0].transaction_cost == pytest.approx(0.0008)
    assert [r.portfolio_return for r in book] == [pytest.approx(-0.0208), pytest.approx(-0.02)]
    assert book[0].drawdown == pytest.approx(-0.0208)
    assert book[1].turnover == pytest.approx(0.0)


def series(spark, signals, returns, tradable=None):
    rows = []
    for i, (v, r) in enumerate(zip(signals, returns, strict=True)):
        t = hours(len(signals))[i]
        ok = True if tradable is None else tradable[i]
        rows.append(("f", "execution_return_1bars", 1, t, t + timedelta(hours=1), "A", float(v), float(r),
                     100.0 + i, True, ok, ok))
    return spark.createDataFrame(rows, DS)


def book(spark, signals, returns, tradable=None, **kw):
    df = pf.threshold_portfolio(
        series(spark, signals, returns, tradable), "f", start=START, timeframe="1h",
        **({"long_threshold": 0.5, "short_threshold": 0.5, "cost_bps": 20.0} | kw),
    )
    return df


def test_positions_carry_through_untradable_rows(spark):
    rows = book(spark, [1, 1, -1, -1, 0], [0.01] * 5, [True, False, False, True, True]).orderBy(
        "timestamp"
    ).collect()
    assert [r.position for r in rows] == [1.0, 1.0, 1.0, -1.0, 0.0]
    assert [r.turnover for r in rows] == [0.5, 0.0, 0.0, 1.0, 0.5]


def test_zscore_needs_history(spark):
    rows = book(spark, [1, 2, 3, 4, 9], [0.0] * 5, standardize=3, standardize_min=3).orderBy("timestamp").collect()
    assert [r.signal_value is None for r in rows] == [True, True, False, False, False]


def test_trade_log_splits_flip_costs(spark):
    df = book(spark, [1, 1, -1, 0, 1], [0.01, 0.02, 0.03, 0.0, 0.05])
    trades = pf.trade_log(df, "1h").orderBy("trade_id").collect()
    assert [t.side for t in trades] == ["long", "short", "long"]
    first, second, last = trades
    # Opening costs 10 bps; the flip costs 20 bps, half of it to each trade.
    assert first.strategy_return == pytest.approx((1 + 0.01 - 0.001) * 1.02 * (1 - 0.001) - 1)
    assert second.strategy_return == pytest.approx((1 - 0.03 - 0.001) * (1 - 0.001) - 1)
    assert first.is_closed and not last.is_closed and first.holding_periods == 2
    assert first.gross_return == pytest.approx(1.01 * 1.02 - 1)
    monthly = pf.monthly_metrics(df, pf.trade_log(df, "1h"), "1h").first()
    assert (monthly.entries, monthly.exits, monthly.closed_trades) == (3, 2, 2)


def test_blend(spark):
    a = book(spark, [1, 1], [0.01, 0.02], cost_bps=0.0)
    b = book(spark, [-1, 1], [0.01, 0.02], cost_bps=0.0)
    out = pf.blend({"a": a, "b": b}, {"a": 0.75, "b": 0.25}).orderBy("timestamp").collect()
    assert [r.portfolio_return for r in out] == [pytest.approx(0.005), pytest.approx(0.02)]
    with pytest.raises(ValueError):
        pf.blend({"a": a, "b": b}, {"a": 0.9, "b": 0.2})


def test_interval_marks_use_open_prices(spark):
    t0 = datetime(2024, 1, 1, 12)
    steps = [t0 + timedelta(hours=24 * i) for i in range(3)]
    rows = [("A", steps[0], steps[1], 1.0, 0.001, 0.099), ("A", steps[1], steps[2], -1.0, 0.002, 0.05)]
    p = spark.createDataFrame(
        rows, "instrument_id string, timestamp timestamp_ntz, exit_time timestamp_ntz, position double, "
        "transaction_cost double, portfolio_return double",
    )
    opens = [(("A"), t0 + timedelta(hours=12 * i), v) for i, v in enumerate([100.0, 105.0, 110.0, 99.0, 104.5])]
    bars = spark.createDataFrame(opens, "instrument_id string, timestamp timestamp_ntz, open double")
    got = perf.interval_daily_wealth(p, bars, ["instrument_id"]).orderBy("date").collect()
    assert [r.wealth for r in got] == [
        pytest.approx(1 + 0.05 - 0.001), pytest.approx(1.099 * (1 - (99 / 110 - 1) - 0.002))
    ]


def test_ledger_matches_a_cash_loop(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    price = 100 * np.exp(np.cumsum(rng.normal(scale=0.01, size=200)))
    open_, close = price[:-1], price[1:]
    target = np.sign(rng.normal(size=199)).astype(int) * (rng.random(199) > 0.3)
    rows = [("A", t, float(o), float(c), int(k)) for t, o, c, k in zip(hours(199), open_, close, target, strict=True)]
    df = spark.createDataFrame(rows, "k string, timestamp timestamp_ntz, open double, close double, target int")
    kw = dict(fee_rate=0.001, starting_balance=1000.0)
    trades = perf.trade_ledger(df, ["k"], **kw)
    curve = perf.equity_curve(df, trades, ["k"], **kw).orderBy("timestamp").collect()
    cash, qty, want, held = 1000.0, 0.0, [], 0
    for i in range(199):
        side = 0 if i == 0 else target[i - 1]
        if side != held:
            cash += qty * open_[i] - abs(qty) * open_[i] * 0.001
            qty = side * cash / open_[i]
            cash -= qty * open_[i] + abs(qty) * open_[i] * 0.001
            held = side
        want.append(cash + qty * close[i])
    want[-1] = cash + qty * close[-1] - abs(qty) * close[-1] * 0.001
    np.testing.assert_allclose([r.equity for r in curve], want, rtol=1e-9)


def test_performance(spark):
    rows = [("a", datetime(2024, 1, 1) + timedelta(days=i), r) for i, r in enumerate([0.10, -0.10])]
    df = spark.createDataFrame(rows, "k string, date timestamp_ntz, daily_return double")
    row = perf.performance(df, ["k"], per_year=2).first()
    assert row.total_return == pytest.approx(-0.01) and row.annual_return == pytest.approx(-0.01)
    assert row.max_drawdown == pytest.approx(-0.10)


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([("1", 0.01), ("2", 0.02), ("3", -0.01)], "period string, period_return double")
    a, b = (perf.bootstrap_summary(perf.bootstrap_monthly(spark, df, 100, 7)).first() for _ in range(2))
    assert a == b and a.months == 3 and a.probability_positive > 0.5


def both_ways(monkeypatch, make, order, rows=23):
    """The same frame from whole series and from series cut into runs of a few rows."""
    import pandas as pd

    whole = make().orderBy(*order).toPandas()
    monkeypatch.setattr("tidemark.functions.rolling.TASK_ROWS", rows)
    cut = make().orderBy(*order).toPandas()
    assert len(whole) > 3 * rows
    pd.testing.assert_frame_equal(whole, cut[whole.columns], rtol=1e-9)


def wave(n=150, seed=3):
    import numpy as np

    rng = np.random.default_rng(seed)
    return [float(np.sin(i / 5) + 0.2 * rng.normal()) for i in range(n)], [float(v) for v in 0.01 * rng.normal(size=n)]


def test_threshold_portfolio_is_the_same_cut(spark, monkeypatch):
    signals, returns = wave()
    tradable = [i % 7 != 3 and not 40 <= i < 75 for i in range(150)]
    both_ways(
        monkeypatch,
        lambda: book(spark, signals, returns, tradable, smoothing=2, standardize=10, trend_bars=3, trend_min_return=-1.0),
        ["timestamp"],
    )


def test_wealth_paths_are_the_same_cut(spark, monkeypatch):
    signals, returns = wave(seed=4)
    paths = book(spark, signals, returns)
    both_ways(monkeypatch, lambda: pf.enrich(paths), ["timestamp"])


def test_trade_log_is_the_same_cut(spark, monkeypatch):
    signals, returns = wave(400, seed=5)
    made = book(spark, signals, returns)
    both_ways(monkeypatch, lambda: pf.trade_log(made, "1h"), ["label_name", "trade_id"], rows=5)


def ledger_bars(spark, n=260):
    signals, returns = wave(n, seed=6)
    price, rows = 100.0, []
    for i, t in enumerate(hours(n)):
        price *= 1 + returns[i]
        rows.append(("A", t, price, price * 1.001, 1 if signals[i] > 0.4 else -1 if signals[i] < -0.4 else 0))
        rows.append(("B", t, price, price * 0.999, 1))
    return spark.createDataFrame(rows, "instrument_id string, timestamp timestamp_ntz, open double, close double, target int")


def test_ledger_and_equity_are_the_same_cut(spark, monkeypatch):
    bars = ledger_bars(spark)
    kw = {"fee_rate": 0.0005, "starting_balance": 1000.0}
    trades = perf.trade_ledger(bars, ["instrument_id"], **kw, max_rows=1000).toPandas()
    fixed = spark.createDataFrame(trades)
    with monkeypatch.context() as m:
        both_ways(m, lambda: perf.trade_ledger(bars, ["instrument_id"], **kw), ["instrument_id", "trade_id"], rows=6)
    with monkeypatch.context() as m:
        both_ways(m, lambda: perf.equity_curve(bars, fixed, ["instrument_id"], **kw), ["instrument_id", "timestamp"], rows=40)


def test_scale_in_is_the_same_cut(spark, monkeypatch):
    from tidemark.functions.rolling import over_series
    from tidemark.operators import signals as sig

    spread, _ = wave(200, seed=7)
    rows = [("A", i, None if i % 31 == 30 else v * 0.05, None if i % 17 == 16 else 0.01) for i, v in enumerate(spread)]
    df = spark.createDataFrame(rows, "k string, t int, spread_pct double, atr_pct double")
    both_ways(
        monkeypatch,
        lambda: over_series(df, ["k"], ["t"], sig.scale_in([0.01, 0.03, 0.05], [0.3, 0.6, 1.0])), ["k", "t"],
    )


def test_no_registered_window_reaches_a_whole_series(spark, monkeypatch):
    """Windows of unknown reach would keep a series whole: none is left among the series queries."""
    from tidemark.functions import rolling
    from tidemark.queries import REGISTRY

    seen = []
    build = rolling.Series.build

    def watched(self, outputs, keep=None):
        seen.append(self.span())
        return build(self, outputs, keep)

    monkeypatch.setattr(rolling.Series, "build", watched)
    for name in ("trade_ledger", "equity_curve", "threshold_portfolio", "portfolio_trade_log", "signal_scale_in", "factor_kdj",
                 "adaptive_macd_er_scaled_wide"):
        REGISTRY[name].run(spark, "/root/testdata/sf0.001")
    assert seen and max(seen) < rolling.UNBOUNDED
