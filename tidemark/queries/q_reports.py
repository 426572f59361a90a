"""Multi-factor report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.groups import fits
from tidemark.operators import factors as fac
from tidemark.operators import labels, reports, universe
from tidemark.queries.base import KEYS, bars, bars_sql, final, lag, over, query, roll, series_rows, staged
from tidemark.queries.q_analytics import corr
from tidemark.session import materialize

K2 = ["venue", "instrument_id"]
QUANTILES, TOP = 5, 60
RETURNS = "rets_without_funding"

# Funding: one settlement per user and day with an "error" event.
PANEL = f"""{bars_sql('calm_user')},
fund AS (SELECT CAST(user_id AS VARCHAR) AS instrument_id, time_bucket(INTERVAL '1 day', ts) AS t, max(value - 50) / 10000 AS rate FROM events WHERE event_type = 'error' GROUP BY ALL),
pn0 AS (SELECT b.*, f.rate AS funding_rate, coalesce(f.rate, 0.0) AS cash FROM bars b LEFT JOIN fund f USING (instrument_id, t)),
{staged('pn0', [
    {
        "carry0": "last_value(funding_rate IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY t ROWS UNBOUNDED PRECEDING)",
        "tv0": roll("avg", "volume_quote", 3), "xo": f"lead(open, 2) {over()}", "xt": f"lead(t, 2) {over()}",
        "paid0": "sum(cash) OVER (PARTITION BY instrument_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)",
        "mo0": f"close / {lag('close', 3)} - 1", "seen": f"list(close) {over(3)}",
    },
    {
        "tvol": lag("tv0"), "carry": lag("carry0"), "momo": lag("mo0"),
        "br0": "CASE WHEN len(seen) = 3 THEN CAST(list_position(seen, list_max(seen)) - 1 - 1.0 AS DOUBLE) END",
        "whole": "coalesce(xt = t + INTERVAL 2 DAY, false)",
    },
    {
        "breakout": lag("br0"), "r0": "CASE WHEN whole THEN xo / open - 1 END",
        "r1": "CASE WHEN whole THEN xo / open - 1 - coalesce(paid0, 0.0) END",
    },
], 'pn_')},
un AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY tvol DESC, instrument_id) AS vr FROM pn_2 WHERE tvol IS NOT NULL),
an0 AS (SELECT *, vr <= {TOP} AS in_universe FROM un WHERE whole AND vr <= {TOP}),
an AS (SELECT *, r0 - avg(r0) OVER (PARTITION BY t) AS dm,
  CASE WHEN stddev_samp(momo) OVER (PARTITION BY t) > 0 THEN (momo - avg(momo) OVER (PARTITION BY t)) / stddev_samp(momo) OVER (PARTITION BY t) END AS z_momo,
  CASE WHEN stddev_samp(carry) OVER (PARTITION BY t) > 0 THEN (carry - avg(carry) OVER (PARTITION BY t)) / stddev_samp(carry) OVER (PARTITION BY t) END AS z_carry,
  CASE WHEN momo IS NOT NULL THEN CAST(ceil(row_number() OVER (PARTITION BY t, momo IS NULL ORDER BY momo, instrument_id) * 5.0 / count(momo) OVER (PARTITION BY t)) AS INT) END AS quantile_momo,
  CASE WHEN carry IS NOT NULL THEN CAST(ceil(row_number() OVER (PARTITION BY t, carry IS NULL ORDER BY carry, instrument_id) * 5.0 / count(carry) OVER (PARTITION BY t)) AS INT) END AS quantile_carry
  FROM an0)"""


def base_panel(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.queries.q_factors import source_events

    fund = source_events(spark, sf, "error").groupBy(
        *K2, F.window("timestamp", "1 day").start.alias("timestamp")
    ).agg((F.max(F.col("value") - 50) / 10_000).alias("funding_rate"))
    return materialize(labels.base_panel(bars(spark, sf, "calm_user"), fund, keys=KEYS[:2]))


def full_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Factors, forward returns and universe membership on the base panel."""
    rows = series_rows(spark, sf, "calm_user")
    base = base_panel(spark, sf)
    specs = [
        fac.FactorSpec("report_momentum", {"window": 3}),
        fac.FactorSpec("report_breakout", {"window": 3}),
    ]
    wide = fac.factor_columns(base, specs, "1d", max_rows=rows).withColumnsRenamed(
        {specs[0].name: "momo", specs[1].name: "breakout"}
    )
    wide = fac.factor_columns(
        wide.drop("funding_rate").withColumnRenamed("carry", "funding_rate"),
        [fac.FactorSpec("report_carry")], "1d", max_rows=rows,
    ).withColumnRenamed("report_carry", "carry")
    rets = labels.funding_returns(wide, 2, 1440, max_rows=rows)
    return universe.rolling_universe(rets, 3, TOP, max_rows=rows)


def analysis_panel(spark: SparkSession, sf: str) -> DataFrame:
    df = materialize(full_panel(spark, sf).where("return_is_valid AND in_universe"))
    # One check of the cross-section sizes serves all steps.
    kw = {"bounded": fits(df, ["timestamp"])}
    df = labels.demean_zscore(df, RETURNS, **kw).withColumnRenamed(f"{RETURNS}_demeaned", "demeaned")
    df = df.drop(f"{RETURNS}_z")
    for name in ("momo", "carry"):
        df = labels.demean_zscore(df, name, **kw).drop(f"{name}_demeaned")
        df = df.withColumnRenamed(f"{name}_z", f"z_{name}")
        df = labels.cross_section_quantile(df, name, QUANTILES, f"quantile_{name}", **kw)
    return materialize(df)


@query(
    "report_base_panel",
    final(PANEL, "pn_0", d="close; carry=carry0; funding_cashflow=cash", o="instrument_id; timestamp=t"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return base_panel(spark, sf).select(
        "instrument_id", "timestamp", "close", "carry", "funding_cashflow"
    )


@query(
    "report_forward_returns",
    final(
        PANEL, "pn_2", d="rets_without_funding=r0; rets_with_funding=r1; log_rets_with_funding=ln(1 + r1)",
        o="instrument_id; timestamp=t; exit_time=t + INTERVAL 2 DAY; return_is_valid=whole",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = labels.funding_returns(
        base_panel(spark, sf), 2, 1440, max_rows=series_rows(spark, sf, "calm_user")
    )
    return df.select(
        "instrument_id", "timestamp", "exit_time", "return_is_valid", "rets_without_funding",
        "rets_with_funding", "log_rets_with_funding",
    )


@query(
    "report_analysis_panel",
    final(
        PANEL, "an", d="demeaned=dm; z_momo; z_carry; breakout; momo; carry", i="quantile_momo quantile_carry",
        o="instrument_id; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return analysis_panel(spark, sf).select(
        "instrument_id", "timestamp", "demeaned", "z_momo", "z_carry", "breakout", "momo", "carry",
        "quantile_momo", "quantile_carry",
    )


@query(
    "report_quantile_table",
    final(
        f"{PANEL}, qt2 AS (SELECT quantile_momo AS q, avg(dm) AS m, stddev_samp(dm) AS s, count(*) AS n FROM an WHERE quantile_momo IS NOT NULL GROUP BY ALL)",
        "qt2", d="mean_return=m; return_std=s", i="quantile=q; observations=n",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.quantile_table(analysis_panel(spark, sf), "quantile_momo", "demeaned")


@query(
    "report_quantile_table_by_year",
    final(
        f"{PANEL}, qt2 AS (SELECT year(t) AS y, quantile_carry AS q, avg(dm) AS m, stddev_samp(dm) AS s, count(*) AS n FROM an WHERE quantile_carry IS NOT NULL GROUP BY ALL)",
        "qt2", d="mean_return=m; return_std=s", i="year=y; quantile=q; observations=n",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.quantile_table(analysis_panel(spark, sf), "quantile_carry", "demeaned", True)


_NAMES = ["momo", "carry", "breakout"]

def _pairwise() -> str:
    rows = []
    for a in _NAMES:
        cols = []
        for b in _NAMES:
            if a == b:
                cols.append(f"1.0 AS {b}")
            else:
                x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
                cols.append(f"{corr(x, y)} AS {b}")
        rows.append(f"SELECT '{a}' AS f, {', '.join(cols)} FROM an")
    return " UNION ALL ".join(rows)


@query("report_correlation_matrix", final(f"{PANEL}, cmx AS ({_pairwise()})", "cmx", d="momo carry breakout", o="factor=f"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.correlation_matrix(analysis_panel(spark, sf), _NAMES)


_ICT = (
    f"{PANEL}, up AS (SELECT t, 'z_momo' AS f, z_momo AS x, dm FROM an UNION ALL SELECT t, 'quantile_carry', quantile_carry, dm FROM an), "
    f"ict AS (SELECT t, f, {corr('x', 'dm')} AS ic FROM up WHERE x IS NOT NULL GROUP BY ALL)"
)


def ic_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = analysis_panel(spark, sf).withColumn("quantile_carry", F.col("quantile_carry").cast("double"))
    return reports.ic_table(df, ["z_momo", "quantile_carry"], "demeaned")


@query("report_ic_series", final(_ICT, "ict", d="ic", o="timestamp=t; factor=f", where="ic IS NOT NULL"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ic_rows(spark, sf)


@query(
    "report_ic_summary",
    final(
        f"{_ICT}, isu AS (SELECT f, avg(ic) AS m, stddev_samp(ic) AS s, count(*) AS n FROM ict WHERE ic IS NOT NULL GROUP BY f)", "isu",
        d="mean_ic=m; ic_std=s; ic_ir=m / s", i="periods=n", o="factor=f",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.ic_table_summary(ic_rows(spark, sf))


@query(
    "report_forward_period_ic",
    final(
        f"{PANEL}, b1 AS (SELECT instrument_id, t, CASE WHEN lead(t) {over()} = t + INTERVAL 1 DAY THEN lead(open) {over()} / open - 1 END AS r FROM bars), "
        "fp AS (SELECT an.t, an.z_momo AS x, p.p, b1.r FROM an, (SELECT unnest([1, 2, 3]) AS p) p, b1 WHERE b1.instrument_id = an.instrument_id AND b1.t = an.t + INTERVAL 1 DAY * (p.p - 1) AND z_momo IS NOT NULL AND r IS NOT NULL), "
        f"fi AS (SELECT t, p, {corr('x', 'r')} AS ic, count(*) AS n FROM fp GROUP BY ALL)",
        "fi", d="ic", i="forward_period=p; assets=n", o="timestamp=t; factor='z_momo'", where="n >= 3 AND ic IS NOT NULL",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = series_rows(spark, sf, "calm_user")
    single = labels.funding_returns(base_panel(spark, sf), 1, 1440, max_rows=rows)
    return reports.forward_period_ic(
        analysis_panel(spark, sf), ["z_momo"], single, "rets_without_funding", 3, 1440
    )


# -- blended weights and regression --------------------------------------------------------
WEIGHTS = f"""{PANEL},
el AS (SELECT * FROM an WHERE quantile_carry IS NOT NULL AND quantile_momo IS NOT NULL AND breakout IS NOT NULL),
st AS (SELECT min(t) AS f FROM (SELECT t FROM el GROUP BY t HAVING count(*) >= 10)),
bw0 AS (SELECT *, quantile_carry - 3.0 AS carry_weight, quantile_momo - 3.0 AS momo_weight, breakout / 2 AS breakout_weight FROM el, st WHERE t >= f),
bw1 AS (SELECT *, carry_weight + momo_weight + 0.3 * breakout_weight AS cw FROM bw0),
bw2 AS (SELECT *, sum(abs(cw)) OVER (PARTITION BY t) AS gw FROM bw1),
bw AS (SELECT *, CASE WHEN gw > 0 THEN cw / gw ELSE 0.0 END AS sw, CASE WHEN gw > 0 THEN carry_weight / gw ELSE 0.0 END AS scw,
  CASE WHEN gw > 0 THEN momo_weight / gw ELSE 0.0 END AS smw, CASE WHEN gw > 0 THEN 0.3 * breakout_weight / gw ELSE 0.0 END AS sbw FROM bw2)"""


def weights(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(
        reports.blended_weights(
            analysis_panel(spark, sf), quantiles=QUANTILES, returns="log_rets_without_funding", min_universe=10
        )
    )


@query(
    "report_blended_weights",
    final(
        WEIGHTS, "bw", d="carry_weight; momo_weight; breakout_weight; combined_weight=cw; gross_weight=gw; scaled_weight=sw; scaled_momo_weight=smw",
        o="instrument_id; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return weights(spark, sf).select(
        "instrument_id", "timestamp", "carry_weight", "momo_weight", "breakout_weight", "combined_weight",
        "gross_weight", "scaled_weight", "scaled_momo_weight",
    )


@query(
    "report_net_weight",
    final(f"{WEIGHTS}, nw AS (SELECT t, sum(sw) AS w FROM bw GROUP BY t)", "nw", d="net_weight=w", o="timestamp=t"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.net_weight(weights(spark, sf))


@query(
    "report_equity_curves",
    final(
        f"{WEIGHTS}, eqs AS (SELECT t, sum(r0 * sw) AS a, sum(r1 * sw) AS b FROM bw GROUP BY t), "
        "eqc AS (SELECT *, product(1 + a) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS ea, product(1 + b) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS eb FROM eqs)",
        "eqc", d="portfolio_rets_without_funding=a; portfolio_rets_with_funding=b; equity_rets_without_funding=ea; equity_rets_with_funding=eb", o="timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.equity_curves(weights(spark, sf), ["rets_without_funding", "rets_with_funding"])


@query(
    "report_factor_attribution",
    final(
        f"{WEIGHTS}, ats AS (SELECT t, sum(r0 * scw) AS a, sum(r0 * smw) AS b, sum(r0 * sbw) AS c FROM bw GROUP BY t), "
        "atc AS (SELECT *, a + b + c AS p, sum(a) OVER (ORDER BY t) AS ca, sum(b) OVER (ORDER BY t) AS cb, sum(c) OVER (ORDER BY t) AS cc, sum(a + b + c) OVER (ORDER BY t) AS cp FROM ats)",
        "atc", d="carry_return=a; momo_return=b; breakout_return=c; portfolio_return=p; cumulative_carry_return=ca; cumulative_momo_return=cb; cumulative_breakout_return=cc; cumulative_portfolio_return=cp",
        o="timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.factor_attribution(weights(spark, sf), "rets_without_funding")


REG = f"""{WEIGHTS},
rg1 AS (SELECT *, ceil(row_number() OVER (PARTITION BY t ORDER BY breakout_weight, instrument_id) * 5.0 / count(*) OVER (PARTITION BY t)) - 3.0 AS bq FROM bw),
days AS (SELECT DISTINCT date_trunc('day', t) AS e FROM rg1),
fa AS (SELECT min(t + INTERVAL 2 DAY) AS f FROM rg1),
rf AS (SELECT CAST(e AS TIMESTAMP) AS e, row_number() OVER (ORDER BY e) AS k FROM days, fa WHERE e >= f + INTERVAL 8 DAY),
wn AS (SELECT rf.e, r0 AS y, carry_weight AS a, bq AS b FROM rf JOIN rg1 ON t + INTERVAL 2 DAY > e - INTERVAL 8 DAY AND t + INTERVAL 2 DAY <= e WHERE (k - 1) % 4 = 0),
mo2 AS (SELECT e, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, var_pop(y) AS vy FROM wn GROUP BY e),
co AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM mo2 WHERE n >= 50),
cf AS (SELECT *, my - ca * ma - cb * mb AS c0, (ca * ay + cb * byy) / vy AS r2 FROM co)"""
FEATURES = ["carry_weight", "breakout_weight"]


def regression(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df = materialize(reports.requantile(weights(spark, sf), "breakout_weight", QUANTILES))
    fit = reports.rolling_ols(
        df, "rets_without_funding", FEATURES, lookback_days=8, refit_days=4, least=50
    )
    return df, materialize(fit)


@query("report_requantile", final(REG, "rg1", d="breakout_weight=bq", o="instrument_id; timestamp=t"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = reports.requantile(weights(spark, sf), "breakout_weight", QUANTILES)
    return df.select("instrument_id", "timestamp", "breakout_weight")


@query(
    "report_rolling_ols",
    final(
        REG, "cf", d="xs_intercept=c0; xs_r2=r2; coef_carry_weight=ca; coef_breakout_weight=cb", i="observations=n",
        o="estimate_at=e; window_start=e - INTERVAL 8 DAY; window_end=e",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return regression(spark, sf)[1]


DAILY = f"{REG}, dco AS (SELECT CAST(d.e AS TIMESTAMP) AS date, cf.e AS refit, ca, cb, c0 FROM days d ASOF JOIN cf ON d.e >= cf.e)"


@query("report_daily_coefficients", final(DAILY, "dco", d="coef_carry_weight=ca; coef_breakout_weight=cb; xs_intercept=c0", o="date; last_refit_at=refit"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    df, fit = regression(spark, sf)
    return reports.daily_coefficients(fit, df).select(
        "date", "last_refit_at", "coef_carry_weight", "coef_breakout_weight", "xs_intercept"
    )


@query(
    "report_expected_returns",
    final(
        f"{DAILY}, exr AS (SELECT instrument_id, t, carry_weight * ca AS a, bq * cb AS b, c0 + carry_weight * ca + bq * cb AS e FROM rg1 JOIN dco ON date_trunc('day', t) = dco.date)",
        "exr", d="expected_carry_return=a; expected_breakout_return=b; expected_return=e", o="instrument_id; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df, fit = regression(spark, sf)
    daily = reports.daily_coefficients(fit, df)
    return reports.expected_returns(df, daily, FEATURES).select(
        "instrument_id", "timestamp", "expected_carry_return", "expected_breakout_return", "expected_return"
    )
