"""Factor analytics and redundancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.groups import average_rank, group_quantiles
from tidemark.operators import analytics, redundancy
from tidemark.session import materialize
from tidemark.queries.base import bars, bars_sql, final, query, series_rows
from tidemark.queries.q_processing import NAMES, dataset, dataset_sql

DS = f"{dataset_sql()},\nva AS (SELECT * FROM ds WHERE valid)"
G = "factor_name, label_name, h"
GO = "factor_name; label_name"


def avg_rank(x: str, keys: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + "
        f"(count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"
    )


def corr(x: str, y: str) -> str:
    s = f"(stddev_samp({x}) * stddev_samp({y}))"
    return f"(CASE WHEN {s} > 0 THEN covar_samp({x}, {y}) / {s} END)"


def spearman_sql(keys: str, name: str = "ic", source: str = "va") -> str:
    return (
        f"{name}r AS (SELECT {keys}, {avg_rank('v', keys)} AS rx, {avg_rank('y', keys)} AS ry FROM {source}),\n"
        f"{name} AS (SELECT {keys}, count(*) AS n, {corr('rx', 'ry')} AS ic FROM {name}r GROUP BY ALL)"
    )


SERIES = f"{spearman_sql(G + ', t', 'ics')},\nser AS (SELECT * FROM ics WHERE n >= 5 AND ic IS NOT NULL)"
SUMMARY = """su AS (SELECT factor_name, label_name, h, count(*) AS n, avg(ic) AS m, stddev_samp(ic) AS s,
  median(ic) AS md, avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END) AS pr FROM ser GROUP BY ALL)"""
SUMMARY_OUT = dict(
    d="mean_ic=m; std_ic=s; median_ic=md; positive_rate=pr; icir=CASE WHEN s > 0 THEN m / s END; "
      "t_stat=CASE WHEN s > 0 AND n > 1 THEN m / (s / sqrt(n)) END",
    i="horizon_bars=h; periods=n", o=f"{GO}; method='spearman'",
)


@query("ic_summary_spearman", final(f"{DS},\n{SERIES},\n{SUMMARY}", "su", **SUMMARY_OUT))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.ic_summary(analytics.ic_series(dataset(spark, sf)))


@query(
    "ic_series_spearman",
    final(f"{DS},\n{SERIES}", "ser", d="ic", i="horizon_bars=h; observations=n", o=f"{GO}; timestamp=t; method='spearman'"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.ic_series(dataset(spark, sf))


@query(
    "ic_series_pearson",
    final(
        f"{DS},\nics AS (SELECT {G}, t, count(*) AS n, {corr('v', 'y')} AS ic FROM va GROUP BY ALL)", "ics",
        d="ic", i="horizon_bars=h; observations=n", o=f"{GO}; timestamp=t; method='pearson'",
        where="n >= 5 AND ic IS NOT NULL",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.ic_series(dataset(spark, sf), "pearson")


_OVERALL = f"{DS},\n{spearman_sql(G, 'ovr')}"


@query("overall_ic", final(_OVERALL, "ovr", d="ic", i="horizon_bars=h; observations=n", o=f"{GO}; method='spearman'", where="n >= 5"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.overall_ic(dataset(spark, sf))


_NEAR = "list_sort(list(v) FILTER (WHERE valid))"


@query(
    "factor_summary",
    final(
        f"{DS}, x AS (SELECT {G}, count(*) AS n, sum(fv::INT) AS fv, sum(ok::INT) AS lv, sum(valid::INT) AS nv, "
        "avg(v) FILTER (WHERE valid) AS fm, stddev_samp(v) FILTER (WHERE valid) AS fs, median(v) FILTER (WHERE valid) AS md, "
        f"{_NEAR} AS xs, avg(y) FILTER (WHERE valid) AS lm, stddev_samp(y) FILTER (WHERE valid) AS ls, "
        "avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE valid) AS pr FROM ds GROUP BY ALL)",
        "x",
        d="factor_mean=fm; factor_std=fs; factor_median=md; factor_q01=xs[CAST(round((len(xs) - 1) * 0.01) AS BIGINT) + 1]; "
          "factor_q99=xs[CAST(round((len(xs) - 1) * 0.99) AS BIGINT) + 1]; label_mean=lm; label_std=ls; label_positive_rate=pr; coverage=nv / n",
        i="horizon_bars=h; observations=n; factor_valid_observations=fv; label_valid_observations=lv; valid_observations=nv",
        o=GO,
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.summary(dataset(spark, sf))


def _quantiles_sql(keys: str, scope: str) -> tuple[str, dict]:
    ctes = (
        f"{DS}, rk AS (SELECT *, {avg_rank('v', keys)} AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM va), "
        "qt AS (SELECT *, greatest(1, least(5, CAST(floor((r - 1) * 5 / n) AS INT) + 1)) AS q FROM rk WHERE n >= 5), "
        f"qr AS (SELECT {G}, q, count(*) AS n, avg(y) AS m, stddev_samp(y) AS s, median(y) AS md, "
        "avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS w, avg(v) AS f FROM qt GROUP BY ALL)"
    )
    out = dict(
        d="mean_return=m; std_return=s; median_return=md; win_rate=w; mean_factor=f",
        i="horizon_bars=h; quantile=q; observations=n", o=f"{GO}; scope='{scope}'",
    )
    return ctes, out


_QC, _QO = _quantiles_sql("factor_name, label_name, t", "cross_sectional")
_QT, _QTO = _quantiles_sql("factor_name, label_name, venue, instrument_id", "time_series")


@query("quantile_returns_cross_section", final(_QC, "qr", **_QO))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.quantile_returns(dataset(spark, sf))


@query("quantile_returns_time_series", final(_QT, "qr", **_QTO))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.quantile_returns(dataset(spark, sf), scope="time_series")


_SPREAD = (
    f"qk AS (SELECT *, {avg_rank('m', G)} AS rm FROM qr), sp AS (SELECT {G}, max(m) FILTER (WHERE q = 5) AS hi, "
    f"max(m) FILTER (WHERE q = 1) AS lo, {corr('q', 'rm')} AS mono FROM qk GROUP BY ALL)"
)


@query(
    "quantile_spread",
    final(f"{_QC}, {_SPREAD}", "sp", d="top_return=hi; bottom_return=lo; monotonicity=mono; long_short_return=hi - lo", i="horizon_bars=h", o=f"{GO}; scope='cross_sectional'"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.quantile_spread(analytics.quantile_returns(dataset(spark, sf)))


_FR = (
    f"{DS}, fr AS (SELECT {G}, t, count(*) AS n, CASE WHEN var_samp(v) > 0 THEN regr_slope(y, v) END AS b, "
    "CASE WHEN var_samp(v) > 0 THEN regr_intercept(y, v) END AS a FROM va GROUP BY ALL HAVING count(*) >= 5)"
)


@query("factor_returns", final(_FR, "fr", d="factor_return=b; intercept=a", i="horizon_bars=h; observations=n", o=f"{GO}; timestamp=t", where="b IS NOT NULL"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.factor_returns(dataset(spark, sf))


@query(
    "factor_return_summary",
    final(
        f"{_FR}, fs AS (SELECT {G}, count(*) AS n, avg(b) AS m, stddev_samp(b) AS s, median(b) AS md, "
        "avg(CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END) AS pr FROM fr WHERE b IS NOT NULL GROUP BY ALL)",
        "fs", d="mean_factor_return=m; std_factor_return=s; median_factor_return=md; positive_rate=pr; "
        "t_stat=CASE WHEN s > 0 AND n > 1 THEN m / (s / sqrt(n)) END", i="horizon_bars=h; periods=n", o=GO,
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.factor_return_summary(analytics.factor_returns(dataset(spark, sf)))


@query(
    "periodic_ic_month",
    final(
        f"{DS}, vp AS (SELECT *, date_trunc('month', t) AS p FROM va), {spearman_sql(G + ', p', 'pic', 'vp')}", "pic",
        d="ic", i="horizon_bars=h; observations=n", o=f"{GO}; period=CAST(p AS TIMESTAMP); method='spearman'", where="n >= 20",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.periodic_ic(dataset(spark, sf))


@query(
    "periodic_ic_six_days",
    final(
        f"{DS}, vp AS (SELECT *, time_bucket(INTERVAL '6 days', t, TIMESTAMP '1970-01-01') AS p FROM va), {spearman_sql(G + ', p', 'pic', 'vp')}",
        "pic", d="ic", i="horizon_bars=h; observations=n", o=f"{GO}; period=p; method='spearman'", where="n >= 20",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.periodic_ic(dataset(spark, sf), "6d")


@query(
    "ic_decay",
    final(
        f"{_QC}, {_SPREAD}, {spearman_sql(G, 'ovr')}, dc AS (SELECT * FROM ovr LEFT JOIN sp USING ({G}))", "dc",
        d="ic; long_short_return=hi - lo; monotonicity=mono", i="horizon_bars=h; observations=n", o=f"{GO}; method='spearman'",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    ds = dataset(spark, sf)
    spread = analytics.quantile_spread(analytics.quantile_returns(ds))
    return analytics.decay(analytics.overall_ic(ds, min_observations=2), spread)


_WIDE = "max(v) FILTER (WHERE factor_name = '{n}') AS x{i}"
_WIDES = ", ".join(_WIDE.format(n=n, i=i) for i, n in enumerate(NAMES))
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS fl, '{b}' AS fr, x{i} AS v, x{j} AS y FROM wd WHERE x{i} IS NOT NULL AND x{j} IS NOT NULL"
    for i, a in sorted(enumerate(NAMES), key=lambda p: p[1])
    for j, b in sorted(enumerate(NAMES), key=lambda p: p[1])
    if a <= b
)
_CORR = f"{DS}, wd AS (SELECT instrument_id, t, {_WIDES} FROM ds GROUP BY ALL), pr AS ({_PAIRS}), {spearman_sql('fl, fr', 'fc', 'pr')}"


@query(
    "factor_correlation",
    final(_CORR, "fc", d="correlation=CASE WHEN fl = fr THEN 1.0 ELSE ic END", i="observations=n", o="factor_left=fl; factor_right=fr; method='spearman'"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.factor_correlation(dataset(spark, sf), NAMES)


@query(
    "factor_autocorrelation",
    final(
        f"{DS}, u AS (SELECT DISTINCT factor_name, venue, instrument_id, t, v FROM ds), "
        "l AS (SELECT *, lag(v, 2) OVER (PARTITION BY factor_name, venue, instrument_id ORDER BY t) AS p FROM u), "
        f"a AS (SELECT factor_name, venue, instrument_id, count(*) FILTER (WHERE v IS NOT NULL AND p IS NOT NULL) AS n, "
        "stddev_samp(v) FILTER (WHERE p IS NOT NULL) * stddev_samp(p) FILTER (WHERE v IS NOT NULL) AS s, covar_samp(v, p) AS c FROM l GROUP BY ALL)",
        "a", d="autocorrelation=CASE WHEN s > 0 THEN c / s END", i="observations=n; lag_bars=2", o="factor_name; venue; instrument_id",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.autocorrelation(dataset(spark, sf), 2, max_rows=series_rows(spark, sf))


@query(
    "primary_metrics",
    final(
        f"{_QC}, {_SPREAD}, {SERIES}, {SUMMARY}, cv AS (SELECT {G}, avg(valid::INT) AS c FROM ds GROUP BY ALL), "
        f"pm AS (SELECT * FROM cv LEFT JOIN su USING ({G}) LEFT JOIN sp USING ({G}))",
        "pm", d="coverage=c; mean_ic=m; icir=m / s; t_stat=m / (s / sqrt(n)); positive_rate=pr; long_short_return=hi - lo; monotonicity=mono",
        i="periods=n", o=GO, where="h = 1",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    ds = dataset(spark, sf)
    spread = analytics.quantile_spread(analytics.quantile_returns(ds))
    tables = {
        "summary": analytics.summary(ds),
        "ic_summary": analytics.ic_summary(analytics.ic_series(ds)),
        "quantile_spread": spread,
    }
    return analytics.primary_metrics(tables, 1)


# -- order statistics ----------------------------------------------------------------------
@query(
    "average_rank_of_bars",
    final(
        f"{bars_sql('user')}, x AS (SELECT instrument_id, t, volume, {avg_rank('volume', 't')} AS r, count(*) OVER (PARTITION BY t) AS n FROM bars)",
        "x", d="volume; rank=r", i="size=n", o="instrument_id; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    # Small slices, so that the sliced way runs here as it does on large groups.
    df = average_rank(
        bars(spark, sf), ["timestamp"], "volume", "rank", size="size", bounded=False, task_rows=40
    )
    return df.select("instrument_id", "timestamp", "volume", "rank", "size")


@query(
    "group_quantiles_of_events",
    final(
        "x AS (SELECT event_type, list_sort(list(value)) AS xs, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.9) AS q90 FROM events GROUP BY ALL)",
        "x", d="median=md; q90; near25=xs[CAST(round((len(xs) - 1) * 0.25) AS BIGINT) + 1]", o="event_type",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.queries.base import table

    probs = {"median": 0.5, "q90": 0.9, "near25": 0.25}
    return group_quantiles(
        table(spark, sf, "events"), ["event_type"], "value", probs, nearest=["near25"],
        bounded=False, task_rows=300,
    )


# -- redundancy ----------------------------------------------------------------------------
def _r2_one(t: str, a: str, b: str) -> str:
    """R2 of t on a and b from correlations."""
    ta, tb, ab = f"corr({t}, {a})", f"corr({t}, {b})", f"corr({a}, {b})"
    return f"(({ta}) ** 2 + ({tb}) ** 2 - 2 * {ta} * {tb} * {ab}) / (1 - ({ab}) ** 2)"


_ORDER = sorted(range(3), key=lambda i: NAMES[i])


def _vif_rows() -> str:
    rows = []
    for i in _ORDER:
        a, b = [j for j in _ORDER if j != i]
        rows.append(
            f"SELECT '{NAMES[i]}' AS f, '{NAMES[a]},{NAMES[b]}' AS c, count(*) AS n, {_r2_one(f'x{i}', f'x{a}', f'x{b}')} AS r2 FROM cw"
        )
    return " UNION ALL ".join(rows)


_VIF = (
    f"{DS}, wd AS (SELECT instrument_id, t, {_WIDES} FROM ds WHERE fv GROUP BY ALL), "
    f"cw AS (SELECT * FROM wd WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL), vf AS ({_vif_rows()})"
)


@query(
    "vif",
    final(
        _VIF, "vf", d="r_squared=r2; vif=1 / (1 - r2)", i="observations=n",
        o="factor_name=f; controls=c; status=CASE WHEN 1 / (1 - r2) >= 10 THEN 'HIGH' WHEN 1 / (1 - r2) >= 5 THEN 'MODERATE' ELSE 'LOW' END",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return redundancy.vif(dataset(spark, sf), NAMES)


def _contribution_sql() -> str:
    keys = "venue, label_name, h, t"
    ranks = ", ".join(f"{avg_rank(f'x{i}', keys)} AS r{i}" for i in range(3))
    rows = []
    for i in _ORDER:
        a, b = [j for j in _ORDER if j != i]
        ty, ay, by = (f"corr(r{k}, ry)" for k in (i, a, b))
        ta, tb, ab = f"corr(r{i}, r{a})", f"corr(r{i}, r{b})", f"corr(r{a}, r{b})"
        d = f"(1 - ({ab}) ** 2)"
        ba, bb = f"(({ta} - {tb} * {ab}) / {d})", f"(({tb} - {ta} * {ab}) / {d})"
        rest = f"(1 - {ba} * {ta} - {bb} * {tb})"
        cond = f"(({ty} - {ba} * {ay} - {bb} * {by}) / sqrt({rest}))"
        base = _r2_one("ry", f"r{a}", f"r{b}")
        rows.append(
            f"SELECT {keys}, '{NAMES[i]}' AS f, '{NAMES[a]},{NAMES[b]}' AS c, count(*) AS n, {ty} AS raw, {cond} AS cond, "
            f"{base} AS base FROM cr GROUP BY ALL HAVING count(*) >= 10"
        )
    return (
        f"{DS}, wd AS (SELECT venue, instrument_id, label_name, h, t, y, {_WIDES} FROM ds WHERE valid GROUP BY ALL), "
        "cw AS (SELECT * FROM wd WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL), "
        f"cr AS (SELECT *, {ranks}, {avg_rank('y', keys)} AS ry FROM cw), uc AS ({' UNION ALL '.join(rows)})"
    )


# The gain in R2 equals the squared conditional IC (up to the tiny ridge).
_UC = _contribution_sql()
_UC_OUT = dict(
    d="raw_ic=raw; conditional_ic=cond; baseline_r_squared=base; incremental_r_squared=cond ** 2; full_r_squared=base + cond ** 2",
    i="horizon_bars=h; observations=n", o="venue; factor_name=f; controls=c; label_name; timestamp=t; method='spearman'",
)


@query("unique_contribution", final(_UC, "uc", **_UC_OUT))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return redundancy.unique_contribution(dataset(spark, sf), NAMES, min_observations=10)


@query("redundancy_report", final(_UC, "uc", **_UC_OUT))
def _(spark: SparkSession, sf: str) -> DataFrame:
    ds = materialize(dataset(spark, sf))
    tables = redundancy.redundancy_report(
        ds, analytics.factor_correlation(ds, NAMES), analytics.overall_ic(ds), NAMES, min_observations=10
    )
    return tables["unique_contribution"]


@query(
    "unique_contribution_summary",
    final(
        f"{_UC}, us AS (SELECT f, c, label_name, h, count(*) AS n, avg(raw) AS mr, avg(cond) AS mc, stddev_samp(cond) AS sc, "
        "avg(CASE WHEN cond > 0 THEN 1.0 ELSE 0.0 END) AS pr, avg(cond ** 2) AS mi, median(cond ** 2) AS mdi FROM uc GROUP BY ALL)",
        "us", d="mean_raw_ic=mr; mean_conditional_ic=mc; std_conditional_ic=sc; conditional_positive_rate=pr; mean_incremental_r_squared=mi; "
        "median_incremental_r_squared=mdi; mean_ic_change=mc - mr; conditional_ic_t_stat=mc / (sc / sqrt(n))",
        i="horizon_bars=h; periods=n", o="factor_name=f; controls=c; label_name; method='spearman'",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    series = redundancy.unique_contribution(dataset(spark, sf), NAMES, min_observations=10)
    return redundancy.unique_contribution_summary(series)


_CLUSTER = (
    f"{_CORR}, {spearman_sql(G, 'ovr')}, sc AS (SELECT factor_name, avg(abs(ic)) AS s FROM ovr WHERE n >= 5 GROUP BY 1), "
    "ed AS (SELECT fl AS a, fr AS b, abs(ic) AS w FROM fc WHERE fl <> fr), "
    "nb AS (SELECT a, b FROM ed WHERE w >= 0.3 UNION SELECT b, a FROM ed WHERE w >= 0.3 UNION SELECT fl, fl FROM fc UNION SELECT fr, fr FROM fc), "
    "h1 AS (SELECT DISTINCT x.a, y.b FROM nb x JOIN nb y ON x.b = y.a), h2 AS (SELECT DISTINCT x.a, y.b FROM h1 x JOIN h1 y ON x.b = y.a), "
    "rt AS (SELECT a AS f, min(b) AS root FROM h2 GROUP BY a), "
    "rp AS (SELECT root, count(*) AS k, arg_max(f, (coalesce(s, -1), f)) AS rep FROM rt LEFT JOIN sc ON f = factor_name GROUP BY root), "
    "pk AS (SELECT p.root, max(w) AS w FROM ed JOIN rt p ON p.f = a JOIN rt q ON q.f = b WHERE p.root = q.root GROUP BY 1), "
    "nm AS (SELECT *, 'R' || row_number() OVER (ORDER BY root) AS id FROM rp), "
    "cl AS (SELECT id, f, k, rep, s, w FROM rt JOIN nm USING (root) LEFT JOIN pk USING (root) LEFT JOIN sc ON f = factor_name)"
)


@query(
    "factor_clusters",
    final(
        _CLUSTER, "cl", d="mean_abs_ic=s; max_abs_correlation=w; threshold=0.3", i="cluster_size=k",
        o="cluster_id=id; factor_name=f; representative=rep; is_representative=f = rep",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    ds = dataset(spark, sf)
    corr_table = analytics.factor_correlation(ds, NAMES)
    return redundancy.clusters(corr_table, analytics.overall_ic(ds), 0.3)


