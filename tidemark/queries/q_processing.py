"""Factor cleaning, labels and research datasets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import labels, processing
from tidemark.operators.factors import FactorSpec, compute_factors, factor_rows
from tidemark.queries.base import (
    PANELS,
    bars,
    bars_sql,
    final,
    lag,
    over,
    query,
    roll,
    series_rows,
    staged,
)
from tidemark.queries.q_factors import _src_sql, derivative_sources
from tidemark.session import materialize

SPECS = (
    FactorSpec("momentum", {"lookback": 3}),
    FactorSpec("ma_spread", {"fast_period": 2, "slow_period": 5}),
    FactorSpec("turnover", {"period": 4}),
)
NAMES = [s.name for s in SPECS]
MOM, SPREAD, TURN = NAMES


def raw_factors(spark: SparkSession, sf: str, panel: str = "user", source=None) -> DataFrame:
    b = bars(spark, sf, panel) if source is None else source
    return factor_rows(
        compute_factors(b, SPECS, PANELS[panel].bar, max_rows=series_rows(spark, sf, panel))
    )


def factors_sql(panel: str = "user") -> str:
    """``fac``: the three raw factors as tall rows, stamped one bar later."""
    step = PANELS[panel].step
    stages = [
        {"lc": "ln(close)"},
        {
            "x0": f"lc - {lag('lc', 3)}",
            "fa": roll("avg", "close", 2), "sl": roll("avg", "close", 5),
            "tq": roll("sum", "volume_quote", 4),
        },
    ]
    cols = {MOM: "x0", SPREAD: "CASE WHEN sl <> 0 THEN (fa - sl) / sl END", TURN: "ln(1 + tq)"}
    tall = "\n  UNION ALL ".join(
        f"SELECT venue, instrument_id, bar_type, t + INTERVAL '{step}' AS t, '{n}' AS factor_name, "
        f"{e} AS raw_value FROM q1" for n, e in cols.items()
    )
    return f"{bars_sql(panel)},\n{staged('bars', stages, 'q')},\nfac AS (\n  {tall})"


def labels_sql(panel: str = "user", horizons=(1, 2), cost: float = 0.0) -> str:
    """``lab``: open-to-open labels."""
    step = PANELS[panel].step
    parts = []
    for h in horizons:
        name = labels.label_name(h, cost)
        parts.append(
            f"SELECT venue, instrument_id, bar_type, t, '{name}' AS label_name, {h} AS h, "
            f"t + INTERVAL '{step}' * {h} AS exit_time, open AS entry_price, "
            f"lead(open, {h}) {over()} AS exit_price, lead(t, {h}) {over()} AS seen FROM bars"
        )
    rows = "\n  UNION ALL ".join(parts)
    return f"""lab0 AS (
  {rows}),
lab AS (
  SELECT *, coalesce(seen = exit_time, false) AS cont,
         exit_price IS NOT NULL AND coalesce(seen = exit_time, false) AS ok,
         CASE WHEN coalesce(seen = exit_time, false) THEN exit_price / entry_price - 1 END AS gross,
         CASE WHEN coalesce(seen = exit_time, false) THEN exit_price / entry_price - 1 - {cost / 1e4} END AS y,
         CASE WHEN exit_price IS NULL THEN 'MISSING_FUTURE_PRICE'
              WHEN NOT coalesce(seen = exit_time, false) THEN 'NON_CONTIGUOUS_HORIZON' ELSE '' END AS flags
  FROM lab0)"""


def dataset_sql(panel: str = "user", horizons=(1, 2), cost: float = 0.0, fac: str = "fac") -> str:
    """``ds``: unprocessed factors joined to labels (``v`` value, ``y`` label)."""
    return f"""{factors_sql(panel)},
{labels_sql(panel, horizons, cost)},
ds AS (
  SELECT f.venue, f.instrument_id, f.bar_type, f.t, f.factor_name, f.raw_value AS v,
         f.raw_value IS NOT NULL AS fv, l.* EXCLUDE (venue, instrument_id, bar_type, t),
         f.raw_value IS NOT NULL AND l.ok AS valid
  FROM {fac} f JOIN lab l USING (venue, instrument_id, bar_type, t))"""


def dataset(spark: SparkSession, sf: str, panel: str = "user", horizons=(1, 2), cost: float = 0.0):
    """Unprocessed factors with labels, written once because several passes follow."""
    raw = compute_factors(
        bars(spark, sf, panel), SPECS, PANELS[panel].bar, max_rows=series_rows(spark, sf, panel),
        horizons=horizons, cost_bps=cost,
    )
    cleaned = processing.final_validity(processing.mark_non_finite(factor_rows(raw)))
    return materialize(labels.explode_labels(cleaned))


# -- cleaning ------------------------------------------------------------------------------
_OUT = dict(
    d="raw_value; value=v", o="instrument_id; timestamp=t; factor_name; is_valid=v IS NOT NULL; quality_flags=flags",
)
_CROSS = "(PARTITION BY factor_name, t)"


def _show(df: DataFrame) -> DataFrame:
    return df.select(
        "instrument_id", "timestamp", "factor_name", "raw_value", "value", "is_valid",
        "quality_flags",
    )


def _clean_sql(panel: str, stages: list[dict[str, str]]) -> str:
    base = "m0 AS (SELECT *, raw_value AS x0, CASE WHEN raw_value IS NULL THEN 'NON_FINITE_RAW_VALUE' ELSE '' END AS f0 FROM fac)"
    return f"{factors_sql(panel)},\n{base},\n{staged('m0', stages, 'c')}"


def _finish(enough: str, scored: str, flag: str) -> list[dict[str, str]]:
    return [
        {
            "v": f"CASE WHEN {enough} THEN {scored} END",
            "f1": f"CASE WHEN {enough} THEN f0 WHEN f0 = '' THEN '{flag}' ELSE f0 || '|{flag}' END",
        },
        {"flags": "CASE WHEN v IS NULL AND f1 = '' THEN 'STANDARDIZATION_FAILED' ELSE f1 END"},
    ]


_MAD = [
    {"c": f"median(x0) OVER {_CROSS}"},
    {"m": f"median(abs(x0 - c)) OVER {_CROSS}"},
]


def _register_clean(name: str, panel: str, stages: list, **steps) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = series_rows(spark, sf, panel)
        return _show(processing.process(raw_factors(spark, sf, panel), max_rows=rows, **steps))

    sql = final(_clean_sql(panel, stages), f"c{len(stages) - 1}", **_OUT)
    query(name, sql)(run)


_register_clean("mark_non_finite", "user", [{"v": "x0", "flags": "f0"}])
_register_clean(
    "outlier_mad_cross_section", "user",
    [*_MAD, {
        "v": "CASE WHEN x0 IS NOT NULL THEN greatest(least(x0, c + 1.5 * 1.4826 * m), c - 1.5 * 1.4826 * m) END",
        "flags": "f0",
    }],
    outlier={"method": "mad", "threshold": 1.5},
)
_register_clean(
    "outlier_std_cross_section", "user",
    [
        {"c": f"avg(x0) OVER {_CROSS}", "s": f"stddev_samp(x0) OVER {_CROSS}"},
        {"v": "CASE WHEN x0 IS NOT NULL THEN greatest(least(x0, c + 1.2 * s), c - 1.2 * s) END", "flags": "f0"},
    ],
    outlier={"method": "std", "threshold": 1.2},
)
_NEAREST = "list_sort(list(x0) FILTER (WHERE x0 IS NOT NULL) OVER {w})"
_register_clean(
    "outlier_winsorize_cross_section", "user",
    [
        {"xs": _NEAREST.format(w=_CROSS)},
        {
            "lo": "xs[CAST(round((len(xs) - 1) * 0.1) AS BIGINT) + 1]",
            "hi": "xs[CAST(round((len(xs) - 1) * 0.9) AS BIGINT) + 1]",
        },
        {"v": "CASE WHEN x0 IS NOT NULL THEN greatest(least(x0, hi), lo) END", "flags": "f0"},
    ],
    outlier={"method": "winsorize", "lower": 0.1, "upper": 0.9},
)
_TIME = "factor_name, venue, instrument_id"
_W = "(PARTITION BY factor_name, venue, instrument_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_N = f"count(x0) OVER {_W}"
_ROLL = {"window": 10, "min_periods": 5, "scope": "time_series"}
_ABS = "list_sort(list_transform(list(x0) FILTER (WHERE x0 IS NOT NULL) OVER {w}, lambda a: abs(a - c)))"
_MAD_T = [
    {"k": _N, "c": f"median(x0) OVER {_W}"},
    {"ab": _ABS.format(w=_W)},
    {"m": "CASE WHEN k >= 5 THEN (ab[(k + 1) // 2] + ab[k // 2 + 1]) / 2 END"},
]
_register_clean(
    "outlier_mad_rolling", "type",
    [
        *_MAD_T,
        {"v": "CASE WHEN x0 IS NULL THEN NULL WHEN k >= 5 THEN greatest(least(x0, c + 1.5 * 1.4826 * m), c - 1.5 * 1.4826 * m) ELSE x0 END",
         "flags": "f0"},
    ],
    outlier={"method": "mad", "threshold": 1.5, **_ROLL},
)
_register_clean(
    "outlier_std_rolling", "type",
    [
        {"c": roll("avg", "x0", 10, 5, _TIME), "s": roll("stddev_samp", "x0", 10, 5, _TIME)},
        {"v": "CASE WHEN x0 IS NULL THEN NULL WHEN c IS NOT NULL THEN greatest(least(x0, c + 1.2 * s), c - 1.2 * s) ELSE x0 END",
         "flags": "f0"},
    ],
    outlier={"method": "std", "threshold": 1.2, **_ROLL},
)
_register_clean(
    "outlier_winsorize_rolling", "type",
    [
        {"xs": _NEAREST.format(w=_W)},
        {
            "lo": "CASE WHEN len(xs) >= 5 THEN xs[CAST(round((len(xs) - 1) * 0.2) AS BIGINT) + 1] END",
            "hi": "CASE WHEN len(xs) >= 5 THEN xs[CAST(round((len(xs) - 1) * 0.8) AS BIGINT) + 1] END",
        },
        {"v": "CASE WHEN x0 IS NULL THEN NULL ELSE greatest(least(x0, coalesce(hi, x0)), coalesce(lo, x0)) END",
         "flags": "f0"},
    ],
    outlier={"method": "winsorize", "lower": 0.2, "upper": 0.8, **_ROLL},
)
_COUNT = {"n": f"count(x0) OVER {_CROSS}"}
_register_clean(
    "zscore_cross_section", "user",
    [
        {**_COUNT, "c": f"avg(x0) OVER {_CROSS}", "s": f"stddev_samp(x0) OVER {_CROSS}"},
        *_finish("n >= 5", "CASE WHEN s > 0 THEN (x0 - c) / s END", "INSUFFICIENT_CROSS_SECTION"),
    ],
    standard={"method": "zscore"},
)
_register_clean(
    "robust_zscore_cross_section", "user",
    [
        {**_COUNT, "c": f"median(x0) OVER {_CROSS}"},
        {"m": f"1.4826 * median(abs(x0 - c)) OVER {_CROSS}"},
        *_finish("n >= 5", "CASE WHEN m > 0 THEN (x0 - c) / m END", "INSUFFICIENT_CROSS_SECTION"),
    ],
    standard={"method": "robust_zscore"},
)
_AVG_RANK = (
    "(CASE WHEN x0 IS NOT NULL THEN rank() OVER (PARTITION BY factor_name, t ORDER BY x0 NULLS LAST) + "
    "(count(*) OVER (PARTITION BY factor_name, t, x0) - 1) / 2.0 END)"
)
_register_clean(
    "rank_cross_section", "user",
    [
        {**_COUNT, "r": _AVG_RANK},
        *_finish("n >= 20", "CASE WHEN n > 1 THEN 2 * (r - 1) / (n - 1) - 1 END", "INSUFFICIENT_CROSS_SECTION"),
    ],
    standard={"method": "rank", "min_cross_section": 20},
)
_register_clean(
    "zscore_rolling", "type",
    [
        {"n": _N, "c": roll("avg", "x0", 10, 5, _TIME), "s": roll("stddev_samp", "x0", 10, 5, _TIME)},
        *_finish("n >= 5", "CASE WHEN s > 0 THEN (x0 - c) / s END", "WARMUP_INCOMPLETE"),
    ],
    standard={"method": "zscore", **_ROLL},
)
_register_clean(
    "robust_zscore_rolling", "type",
    [
        *_MAD_T,
        *_finish("k >= 5", "CASE WHEN m > 0 THEN (x0 - c) / (1.4826 * m) END", "WARMUP_INCOMPLETE"),
    ],
    standard={"method": "robust_zscore", **_ROLL},
)
_register_clean(
    "rank_rolling", "type",
    [
        {
            "n": _N, "len": f"count(*) OVER {_W}",
            "xs": f"list(x0) FILTER (WHERE x0 IS NOT NULL) OVER {_W}",
        },
        {"r": "CASE WHEN x0 IS NOT NULL AND n >= 5 THEN len(list_filter(xs, lambda a: a < x0)) + "
              "(len(list_filter(xs, lambda a: a = x0)) + 1) / 2.0 END"},
        *_finish("n >= 5", "CASE WHEN len > 1 THEN 2 * (r - 1) / (len - 1) - 1 END", "WARMUP_INCOMPLETE"),
    ],
    standard={"method": "rank", **_ROLL},
)

# Two exposures: turnover and the carried basis, against momentum.
_NEUTRAL = f"""{factors_sql('user')},
src AS ({_src_sql('click', '(v - 50) / 100 AS basis')}),
bx AS (SELECT b.instrument_id, b.t + INTERVAL 1 DAY AS t, f.basis FROM bars b
  ASOF LEFT JOIN src f ON b.instrument_id = f.instrument_id AND b.t >= f.ts),
tx AS (SELECT instrument_id, t, raw_value AS turn FROM fac WHERE factor_name = '{TURN}'),
j AS (SELECT f.*, turn, basis, f.raw_value IS NOT NULL AND turn IS NOT NULL AND basis IS NOT NULL AS ok
  FROM fac f LEFT JOIN tx USING (instrument_id, t) LEFT JOIN bx USING (instrument_id, t)
  WHERE f.factor_name <> '{TURN}'),
g AS (SELECT factor_name, t, count(*) AS n, avg(raw_value) AS my, avg(turn) AS m1, avg(basis) AS m2,
  covar_pop(turn, turn) AS a, covar_pop(turn, basis) AS b, covar_pop(basis, basis) AS c,
  covar_pop(turn, raw_value) AS p, covar_pop(basis, raw_value) AS q FROM j WHERE ok GROUP BY ALL),
s AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS b1, (q * a - p * b) / (a * c - b * b) AS b2
  FROM g WHERE n >= 10),
r AS (SELECT j.*, CASE WHEN ok THEN raw_value - (my + b1 * (turn - m1) + b2 * (basis - m2)) END AS v,
  s.n IS NOT NULL AS solved FROM j LEFT JOIN s USING (factor_name, t))"""


_NEUTRAL_OUT = dict(
    d="raw_value; value=v",
    o="instrument_id; timestamp=t; factor_name; quality_flags=CASE WHEN raw_value IS NULL AND NOT solved "
    "THEN 'NON_FINITE_RAW_VALUE|NEUTRALIZATION_FAILED' WHEN raw_value IS NULL THEN 'NON_FINITE_RAW_VALUE' "
    "WHEN v IS NULL THEN 'NEUTRALIZATION_FAILED' ELSE '' END",
)


def _neutral_show(df: DataFrame) -> DataFrame:
    return df.select(
        "instrument_id", "timestamp", "factor_name", "raw_value", "value", "quality_flags"
    )


@query("neutralize_two_exposures", final(_NEUTRAL, "r", **_NEUTRAL_OUT))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = series_rows(spark, sf)
    sources = {"contract_basis": derivative_sources(spark, sf)["contract_basis"]}
    raw = compute_factors(
        bars(spark, sf), SPECS, "1d", sources=sources, exposures=["turnover", "basis"], max_rows=rows
    )
    targets = factor_rows(raw).where(F.col("factor_key").isin("momentum", "ma_spread"))
    return _neutral_show(
        processing.process(
            targets, exposure_names=["turnover", "basis"], neutral={"min_observations": 10}
        )
    )


@query("neutralize_exposure_table", final(_NEUTRAL, "r", **_NEUTRAL_OUT))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = series_rows(spark, sf)
    sources = {"contract_basis": derivative_sources(spark, sf)["contract_basis"]}
    raw = materialize(
        compute_factors(
            bars(spark, sf), [*SPECS, FactorSpec("basis")], "1d", sources=sources, max_rows=rows
        )
    )
    exposed = raw.where(F.col("factor_key").isin("turnover", "basis"))
    targets = factor_rows(raw).where(F.col("factor_key").isin("momentum", "ma_spread"))
    return _neutral_show(
        processing.process(
            targets, exposures=exposed, exposure_names=["turnover", "basis"],
            neutral={"min_observations": 10},
        )
    )


@query(
    "factors_wide",
    final(
        f"{factors_sql('user')}, w AS (SELECT instrument_id, t, max(raw_value) FILTER (WHERE factor_name = '{MOM}') AS a, "
        f"max(raw_value) FILTER (WHERE factor_name = '{TURN}') AS b FROM fac GROUP BY ALL)",
        "w", d="momentum=a; turnover=b", o="instrument_id; timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = processing.mark_non_finite(raw_factors(spark, sf))
    wide = labels.factors_wide(df, [MOM, TURN])
    return wide.select(
        "instrument_id", "timestamp", F.col(f"`{MOM}`").alias("momentum"),
        F.col(f"`{TURN}`").alias("turnover"),
    )


# -- labels --------------------------------------------------------------------------------
@query(
    "execution_return_labels",
    final(
        f"{bars_sql('user')}, {labels_sql('user', (1, 3), 10.0)}", "lab",
        d="entry_price; exit_price; gross_return=gross; label_value=y", i="horizon_bars=h",
        o="instrument_id; timestamp=t; label_name; exit_time; label_is_valid=ok; label_quality_flags=flags",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lab = labels.execution_return(
        bars(spark, sf), [1, 3], "1d", cost_bps=10.0, max_rows=series_rows(spark, sf)
    )
    return lab.select(
        "instrument_id", "timestamp", "label_name", "horizon_bars", "exit_time", "entry_price",
        "exit_price", "gross_return", "label_value", "label_is_valid", "label_quality_flags",
    )


_DS_OUT = dict(
    d="value=v; label_value=y", i="horizon_bars=h",
    o="instrument_id; timestamp=t; factor_name; label_name; is_valid=valid",
)


def _ds_show(df: DataFrame) -> DataFrame:
    return df.select(
        "instrument_id", "timestamp", "factor_name", "label_name", "horizon_bars", "value",
        "label_value", "is_valid",
    )


@query("research_dataset", final(dataset_sql(), "ds", **_DS_OUT))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _ds_show(dataset(spark, sf))


@query("research_dataset_by_join", final(dataset_sql(), "ds", **_DS_OUT))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = series_rows(spark, sf)
    b = materialize(bars(spark, sf))
    cleaned = processing.process(raw_factors(spark, sf, "user", b), bounded=True)
    lab = labels.execution_return(b, (1, 2), "1d", max_rows=rows)
    return _ds_show(labels.build_dataset(cleaned, lab))


@query("dataset_valid_rows", final(dataset_sql(), "ds", where="valid", **_DS_OUT))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _ds_show(labels.valid_rows(dataset(spark, sf)))


@query(
    "purged_time_split",
    final(
        f"{dataset_sql()}, x AS (SELECT factor_name, h, count(*) FILTER (WHERE exit_time < TIMESTAMP '2024-01-15') AS a, "
        "count(*) FILTER (WHERE t >= TIMESTAMP '2024-01-17') AS b FROM ds GROUP BY ALL)",
        "x", i="horizon_bars=h; train=a; valid=b", o="factor_name",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, valid = labels.purged_time_split(dataset(spark, sf), datetime(2024, 1, 15), 2 * 1440)
    both = train.withColumn("part", F.lit("train")).unionByName(
        valid.withColumn("part", F.lit("valid"))
    )
    return both.groupBy("factor_name", "horizon_bars").pivot("part", ["train", "valid"]).count()


@query(
    "dataset_wide",
    final(
        f"{dataset_sql()}, w AS (SELECT instrument_id, t, max(v) FILTER (WHERE factor_name = '{MOM}') AS a, "
        f"max(v) FILTER (WHERE factor_name = '{SPREAD}') AS b, max(y) AS y, bool_or(ok) AS ok FROM ds WHERE h = 2 GROUP BY ALL)",
        "w", d="momentum=a; spread=b; label_value=y", o="instrument_id; timestamp=t; label_is_valid=ok",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    wide = labels.dataset_wide(dataset(spark, sf), [MOM, SPREAD], labels.label_name(2))
    return wide.select(
        "instrument_id", "timestamp", F.col(f"`{MOM}`").alias("momentum"),
        F.col(f"`{SPREAD}`").alias("spread"), "label_value", "label_is_valid",
    )
