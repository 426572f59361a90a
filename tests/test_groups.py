"""Order statistics on groups that are cut into slices, against brute force."""

import random
import signal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import groups
from tidemark.functions.moments import group_betas
from tidemark.session import materialize


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows and many ties, many small ones, some nulls."""
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        g = "hot" if i % 3 else f"g{i % 17}"
        tied = rng.random() < 0.4
        v = 7.0 if tied and g == "hot" else round(rng.gauss(0, 3), 1)
        rows.append((i, g, None if rng.random() < 0.03 else v))
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(7)


def frame(df):
    return df.toPandas().sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("mode", [dict(bounded=True), dict(bounded=False, task_rows=100), {}])
def test_average_rank(skewed, mode):
    got = frame(groups.average_rank(skewed, ["g"], "v", "r", size="n", **mode))
    want = got.groupby("g")["v"].rank(method="average")
    pd.testing.assert_series_equal(got["r"], want, check_names=False)
    n = got.groupby("g")["v"].transform("count").where(got["v"].notna())
    np.testing.assert_array_equal(got["n"].fillna(-1), n.fillna(-1))


def test_hot_groups_are_really_cut(skewed):
    cut = groups.slice_hot(skewed.where("v is not null"), ["g"], ["v"], 100)
    sizes = cut.where("not _tie").groupBy("g", "_slice").count().toPandas()
    assert (sizes[sizes.g == "hot"]["_slice"] > 0).any()
    assert sizes["count"].max() < 700
    # Rows tied on one value spread over several tasks.
    ties = cut.where("_tie and v = 7.0")
    assert ties.select("_salt").distinct().count() > 5


@pytest.mark.parametrize("mode", [dict(bounded=True), dict(bounded=False, task_rows=64)])
def test_quantiles(skewed, mode):
    probs = {"q10": 0.1, "q50": 0.5, "near": 0.9}
    got = groups.group_quantiles(skewed, ["g"], "v", probs, nearest=["near"], **mode).toPandas()
    rows = skewed.toPandas().dropna()
    for _, r in got.iterrows():
        v = np.sort(rows[rows.g == r.g]["v"].to_numpy())
        assert r.q10 == pytest.approx(np.quantile(v, 0.1))
        assert r.q50 == pytest.approx(np.median(v))
        spot = (len(v) - 1) * 0.9
        assert r.near == v[int(np.floor(spot + 0.5))]


def test_with_quantiles_same_both_ways(skewed):
    probs = {"m": 0.5}
    a = frame(groups.with_quantiles(skewed, ["g"], "v", probs, bounded=True))
    b = frame(groups.with_quantiles(skewed, ["g"], "v", probs, bounded=False, task_rows=90))
    pd.testing.assert_frame_equal(a[["id", "m"]], b[["id", "m"]])


def test_positions_with_tie_break(skewed):
    rows = skewed.where("v is not null")
    kw = dict(first="p")
    a = frame(groups.tie_range(rows, ["g"], ["v", "id"], bounded=True, **kw))
    b = frame(groups.tie_range(rows, ["g"], ["v", "id"], bounded=False, task_rows=50, **kw))
    pd.testing.assert_frame_equal(a[["id", "p", "_size"]], b[["id", "p", "_size"]])


def test_running_totals_both_ways(skewed):
    x = {"s": F.col("v"), "n": F.lit(1)}
    a = frame(groups.running_totals(skewed, ["g"], ["id"], x, bounded=True))
    b = frame(groups.running_totals(skewed, ["g"], ["id"], x, bounded=False, task_rows=60))
    np.testing.assert_allclose(a["s"], b["s"], rtol=1e-9)
    np.testing.assert_array_equal(a["n"], b["n"])


def test_latest_row_ignores_input_order(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", 2, None)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k string, o int, p string").repartition(3)
        got = {(r.k, r.o, r.p) for r in groups.latest_row(df, ["k"], ["o"]).collect()}
        assert got == {("a", 3, "z"), ("b", 2, None)}


def test_group_betas_match_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) + 1000
    y = 5 + x @ [2.0, -1.5] + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x1": x[:, 0], "x2": x[:, 1], "y": y}))
    row = group_betas(df, ["g"], ["x1", "x2"], "y").first()
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    np.testing.assert_allclose([row.b0, row.b1, row.b2], want, rtol=1e-6)
    fit = np.column_stack([np.ones(200), x]) @ want
    assert row.r2 == pytest.approx(1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    single = group_betas(df, ["g"], ["x1"], "y").first()
    assert single.b1 == pytest.approx(np.polyfit(x[:, 0], y, 1)[0])
    wide = df.withColumn("x3", F.sin("x1"))
    three = group_betas(wide, ["g"], ["x1", "x2", "x3"], "y").first()
    full = np.column_stack([np.ones(200), x, np.sin(x[:, 0])])
    np.testing.assert_allclose(
        [three.b0, three.b1, three.b2, three.b3], np.linalg.lstsq(full, y, rcond=None)[0], rtol=1e-5
    )
    flat = df.withColumn("x2", F.lit(1.0))
    assert group_betas(flat, ["g"], ["x1", "x2"], "y").count() == 0


def test_slicing_neither_sorts_the_table_nor_interprets_a_search(spark, skewed, monkeypatch):
    """The sample is filtered, cut points are few and searched by compiled columns, one a halving (F18)."""
    written = []

    def noted(df):
        written.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df)

    monkeypatch.setattr(groups, "materialize", noted)
    rows = skewed.where("v is not null")
    cut = groups.slice_hot(rows, ["g"], ["v"], 1000)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan
    assert len(written) > 1 and not any("SortAggregate" in p for p in written)
    assert cut.count() == rows.count()


@pytest.fixture
def deadline():
    """Fails a test that does not end; an optimizer that does not end cannot be told to."""

    def late(*_):
        raise TimeoutError("still running after 120 s")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(120)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


def test_thousands_of_slices_are_planned_in_bounded_memory(spark, deadline):
    """Columns of one search put into each other doubled twice per halving: 4,000 cut points took all memory (r04 F1)."""
    rng = np.random.default_rng(4)
    v = np.round(rng.exponential(50, 12_600), 2)
    v[:40] = np.nan
    rows = pd.DataFrame({"g": ["hot"] * 12_000 + ["b"] * 597 + ["c"] * 3, "v": v})
    df = spark.createDataFrame([*rows.itertuples(index=False, name=None)], "g string, v double").repartition(5)
    probs = {"q50": 0.5, "q90": 0.9, "near": 0.25}
    got = groups.group_quantiles(df, ["g"], "v", probs, nearest=["near"], bounded=False, task_rows=3)
    got = {r.g: r for r in got.collect()}
    assert set(got) == {"hot", "b", "c"}
    for g, r in got.items():
        x = np.sort(rows[rows.g == g]["v"].to_numpy())  # NaN last, as in Spark
        for q, found in ((0.5, r.q50), (0.9, r.q90)):
            spot = (len(x) - 1) * q
            lo, hi = x[int(np.floor(spot))], x[int(np.ceil(spot))]
            assert found == pytest.approx(lo + (hi - lo) * (spot - np.floor(spot)))
        assert r.near == x[int(np.floor((len(x) - 1) * 0.25 + 0.5))]


def test_cut_points_of_a_very_long_list(spark, deadline):
    """Place times size of the sample passed the range of an int."""
    df = spark.range(70_000).selectExpr("'a' AS g", "id * 7919 % 70000 AS v")
    got = groups.tie_range(df, ["g"], ["v"], bounded=False, task_rows=2)
    assert got.where("_first = v + 1 and _last = v + 1 and _size = 70000").count() == 70_000


@pytest.mark.parametrize("fan", [3, 7])
def test_search_tree_of_many_levels(skewed, monkeypatch, fan):
    monkeypatch.setattr(groups, "_FAN", fan)
    rows = skewed.withColumn("w", F.when(F.col("id") % 9 > 0, F.col("v")))
    for order in (["v"], ["w", "id"]):
        kw = dict(task_rows=40)
        a = frame(groups.tie_range(rows, ["g"], order, bounded=True, **kw))
        b = frame(groups.tie_range(rows, ["g"], order, bounded=False, **kw))
        pd.testing.assert_frame_equal(a[["id", "_first", "_last", "_size"]], b[["id", "_first", "_last", "_size"]])
