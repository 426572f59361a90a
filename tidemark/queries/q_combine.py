"""Factor combinations and walk-forward models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import combine as cb
from tidemark.operators import models
from tidemark.queries.base import final, query
from tidemark.queries.q_analytics import avg_rank, corr
from tidemark.queries.q_processing import MOM, SPREAD, TURN, dataset, dataset_sql
from tidemark.session import materialize

PAIR = (MOM, SPREAD)
_COLS = f"max(v) FILTER (WHERE factor_name = '{MOM}') AS x0, max(v) FILTER (WHERE factor_name = '{SPREAD}') AS x1"
FEATURES = (
    f"{dataset_sql()}, ft AS (SELECT venue, instrument_id, bar_type, t, {_COLS} FROM ds WHERE factor_name IN ('{MOM}', '{SPREAD}') GROUP BY ALL)"
)
T = "instrument_id; timestamp=t"


def features(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(cb.prepare_features(dataset(spark, sf), PAIR))


def scores(df: DataFrame) -> DataFrame:
    return df.select("instrument_id", "timestamp", "raw_value", "factor_is_valid", "factor_quality_flags")


def score_out(expr: str, flag: str) -> dict:
    return dict(
        d=f"raw_value={expr}",
        o=f"{T}; factor_is_valid=({expr}) IS NOT NULL; factor_quality_flags=CASE WHEN ({expr}) IS NULL THEN '{flag}' ELSE '' END",
    )


MISSING = "MISSING_COMPONENT_FACTOR"


@query("combine_features", final(FEATURES, "ft", d="momentum=x0; spread=x1", o=T))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).select(
        "instrument_id", "timestamp", F.col(f"`{MOM}`").alias("momentum"),
        F.col(f"`{SPREAD}`").alias("spread"),
    )


@query(
    "combine_target",
    final(
        f"{dataset_sql()}, tgt AS (SELECT DISTINCT instrument_id, t, exit_time, y, ok FROM ds WHERE h = 2)", "tgt",
        d="label_value=y", o=f"{T}; exit_time; label_is_valid=ok",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cb.prepare_target(dataset(spark, sf), 2).drop("venue", "bar_type")


@query(
    "combine_impute_median",
    final(
        f"{FEATURES}, im AS (SELECT *, median(x0) OVER (PARTITION BY venue, bar_type, t) AS m0, median(x1) OVER (PARTITION BY venue, bar_type, t) AS m1 FROM ft)",
        "im", d="momentum=coalesce(x0, m0); spread=coalesce(x1, m1)", o=T,
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = cb.impute(features(spark, sf), PAIR, "cross_sectional_median")
    return df.select(
        "instrument_id", "timestamp", F.col(f"`{MOM}`").alias("momentum"),
        F.col(f"`{SPREAD}`").alias("spread"),
    )


_RULES = {
    "rules": [
        {"conditions": [{"factor": MOM, "operator": "gt", "value": 0.5}, {"factor": SPREAD, "operator": "lt", "value": 0}], "score": 2.0},
        {"conditions": [{"factor": MOM, "operator": "between", "value": -0.5, "upper": 0.5}, {"factor": SPREAD, "operator": "ge", "value": 0.4}], "logic": "any", "score_factor": SPREAD},
    ],
}
_RULE_SQL = "CASE WHEN coalesce(x0 > 0.5, false) AND coalesce(x1 < 0, false) THEN 2.0 WHEN coalesce(x0 BETWEEN -0.5 AND 0.5, false) OR coalesce(x1 >= 0.4, false) THEN x1 END"


@query("combine_rule", final(FEATURES, "ft", **score_out(_RULE_SQL, "RULE_NOT_MATCHED")))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scores(cb.rule(features(spark, sf), cb.CombinationRequest("rule", PAIR, params=_RULES)))


_WEIGHTED = {"weights": {MOM: 3.0, SPREAD: -1.0}}


@query("combine_linear", final(FEATURES, "ft", **score_out("0.1 + x0 * 0.75 - x1 * 0.25", MISSING)))
def _(spark: SparkSession, sf: str) -> DataFrame:
    request = cb.CombinationRequest("linear", PAIR, params={**_WEIGHTED, "intercept": 0.1})
    return scores(cb.linear(features(spark, sf), request))


@query("combine_linear_zero_fill", final(FEATURES, "ft", **score_out("coalesce(x0, 0) * 0.75 - coalesce(x1, 0) * 0.25", MISSING)))
def _(spark: SparkSession, sf: str) -> DataFrame:
    request = cb.CombinationRequest("linear", PAIR, params={**_WEIGHTED, "missing": "zero"})
    return scores(cb.linear(features(spark, sf), request))


def _scaled(x: str) -> str:
    k = f"venue, bar_type, t, {x} IS NULL"
    n = f"count({x}) OVER (PARTITION BY {k})"
    return f"CASE WHEN {x} IS NOT NULL AND {n} > 1 THEN 2 * ({avg_rank(x, k)} - 1) / ({n} - 1) - 1 END"


RANKED = f"{FEATURES}, rkx AS (SELECT *, {_scaled('x0')} AS r0, {_scaled('x1')} AS r1 FROM ft)"


@query("combine_rank", final(RANKED, "rkx", **score_out("r0 * 0.75 - r1 * 0.25", MISSING)))
def _(spark: SparkSession, sf: str) -> DataFrame:
    request = cb.CombinationRequest("rank", PAIR, params=_WEIGHTED)
    return scores(cb.rank(features(spark, sf), request))


# -- rolling IC weights --------------------------------------------------------------------
_K = "factor_name, t"
HISTORY = (
    f"{FEATURES}, tv AS (SELECT * FROM ds WHERE valid AND h = 1 AND factor_name IN ('{MOM}', '{SPREAD}')), "
    f"ir AS (SELECT {_K}, exit_time, {avg_rank('v', _K)} AS rx, {avg_rank('y', _K)} AS ry FROM tv), "
    f"ih0 AS (SELECT {_K}, count(*) AS n, max(exit_time) AS exit_time, {corr('rx', 'ry')} AS ic FROM ir GROUP BY ALL), "
    "ih AS (SELECT * FROM ih0 WHERE n >= 5 AND ic IS NOT NULL)"
)


def weights_sql(half_life: str = "") -> str:
    """``es``: the estimate per factor and feature time."""
    w = "(PARTITION BY factor_name ORDER BY exit_time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
    if half_life:
        items = f"list(ic) OVER {w}"
        num = f"list_sum(list_transform({items}, lambda a, i: a * power(0.5, (len({items}) - i) / {half_life})))"
        den = f"list_sum(list_transform({items}, lambda a, i: power(0.5, (len({items}) - i) / {half_life})))"
        mean = f"{num} / {den}"
    else:
        mean = f"avg(ic) OVER {w}"
    return (
        f"{HISTORY}, ro AS (SELECT factor_name, exit_time, exit_time + INTERVAL 1 DAY AS av, count(ic) OVER {w} AS k, greatest(-0.05, least(0.05, {mean})) AS e FROM ih), "
        f"gd AS (SELECT DISTINCT f.t, n.factor_name FROM ft f, (SELECT unnest(['{MOM}', '{SPREAD}']) AS factor_name) n), "
        "es AS (SELECT g.t, g.factor_name, r.e, r.k, r.exit_time FROM gd g ASOF JOIN ro r ON g.factor_name = r.factor_name AND g.t >= r.av WHERE r.k >= 2)"
    )


_PARAMS = {
    "window": 6, "min_periods": 2, "clip": 0.05, "bar_type": "1d", "min_cross_section": 5,
}


def ic_request(**more) -> cb.CombinationRequest:
    return cb.CombinationRequest("ic_weighted", PAIR, params={**_PARAMS, **more})


@query("ic_history", final(HISTORY, "ih", d="ic", i="observations=n", o="factor_name; timestamp=t; exit_time"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cb.ic_history(dataset(spark, sf), PAIR, 1, "spearman", 5)


def _weight_query(name: str, expr: str, decay: str = "", where: str = "", **more) -> None:
    ctes = (
        f"{weights_sql(decay)}, sm AS (SELECT *, sum(abs(e)) OVER (PARTITION BY t) AS sa, sum(greatest(e, 0)) OVER (PARTITION BY t) AS sp, "
        "count(*) FILTER (WHERE e <> 0) OVER (PARTITION BY t) AS nz, max(e) OVER (PARTITION BY t) AS mx FROM es), "
        "sx2 AS (SELECT *, sum(exp((e - mx) / 0.1)) OVER (PARTITION BY t) AS se FROM sm)"
    )
    sql = final(
        ctes, "sx2", d=f"weight={expr}; rolling_ic=e", i="ic_observations=k",
        o="timestamp=t; factor_name; latest_label_exit_time=exit_time", where=where,
    )

    def run(spark: SparkSession, sf: str) -> DataFrame:
        ds = dataset(spark, sf)
        return cb.ic_weights(ds, cb.prepare_features(ds, PAIR), ic_request(**more), "1d")

    query(name, sql)(run)


_weight_query("ic_weights_sum_abs", "e / sa", where="sa > 0")
_weight_query("ic_weights_half_life", "e / sa", "3.0", "sa > 0", half_life=3.0)
_weight_query("ic_weights_equal_sign", "sign(e) / nz", where="e <> 0", normalization="equal_sign")
_weight_query("ic_weights_long_only", "greatest(e, 0) / sp", where="sp > 0", normalization="long_only")
_weight_query("ic_weights_softmax", "exp((e - mx) / 0.1) / se", normalization="softmax")


SCORED = (
    f"{weights_sql()}, ww AS (SELECT t, max(e / sa) FILTER (WHERE factor_name = '{MOM}') AS w0, max(e / sa) FILTER (WHERE factor_name = '{SPREAD}') AS w1, count(*) AS k "
    "FROM (SELECT *, sum(abs(e)) OVER (PARTITION BY t) AS sa FROM es) WHERE sa > 0 GROUP BY t HAVING count(*) >= 2), "
    "sc0 AS (SELECT ft.*, w0, w1, k, coalesce(w0 * x0, 0) + coalesce(w1 * x1, 0) AS tot, "
    "CASE WHEN x0 IS NOT NULL THEN abs(w0) ELSE 0 END + CASE WHEN x1 IS NOT NULL THEN abs(w1) ELSE 0 END AS gr, (x0 IS NOT NULL)::INT + (x1 IS NOT NULL)::INT AS np FROM ft LEFT JOIN ww USING (t))"
)


def _score_query(policy: str, expr: str) -> None:
    sql = final(
        f"{SCORED}, sc1 AS (SELECT *, CASE WHEN k IS NOT NULL THEN {expr} END AS z FROM sc0)", "sc1", d="raw_value=z",
        o=f"{T}; factor_is_valid=z IS NOT NULL; factor_quality_flags=CASE WHEN k IS NULL THEN 'IC_WARMUP_INCOMPLETE' WHEN z IS NULL THEN '{MISSING}' ELSE '' END",
    )

    def run(spark: SparkSession, sf: str) -> DataFrame:
        ds = dataset(spark, sf)
        feats = materialize(cb.prepare_features(ds, PAIR))
        request = ic_request(missing=policy)
        return scores(cb.weighted_scores(feats, cb.ic_weights(ds, feats, request, "1d"), request))

    query(f"ic_scores_{policy}", sql)(run)


_score_query("renormalize", "CASE WHEN gr > 0 THEN tot / gr END")
_score_query("zero", "tot")
_score_query("drop", "CASE WHEN gr > 0 AND np = 2 THEN tot / gr END")


@query(
    "combine_assemble",
    final(
        f"{FEATURES}, lb AS (SELECT DISTINCT instrument_id, t, label_name, h, y, ok FROM ds), "
        "cm AS (SELECT lb.*, 0.75 * x0 - 0.25 * x1 AS z FROM lb LEFT JOIN ft USING (instrument_id, t))",
        "cm", d="value=z; label_value=y", i="horizon_bars=h",
        o=f"{T}; label_name; factor_name='mix'; factor_key='linear'; factor_is_valid=z IS NOT NULL; is_valid=z IS NOT NULL AND ok",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    request = cb.CombinationRequest("linear", PAIR, name="mix", params=_WEIGHTED)
    return cb.combine(dataset(spark, sf), request).select(
        "instrument_id", "timestamp", "label_name", "horizon_bars", "factor_name", "factor_key", "value",
        "label_value", "factor_is_valid", "is_valid",
    )


@query(
    "combine_user_registered",
    final(FEATURES, "ft", d="raw_value=greatest(x0, x1)", o=T, where="x0 IS NOT NULL AND x1 IS NOT NULL"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    def best(ds: DataFrame, request: cb.CombinationRequest) -> DataFrame:
        feats = cb.prepare_features(ds, request.factor_names).dropna()
        top = F.greatest(*[F.col(f"`{n}`") for n in request.factor_names])
        return feats.select(
            *cb.KEYS, top.alias("raw_value"), F.lit(True).alias("factor_is_valid"), F.lit("").alias("factor_quality_flags")
        )

    cb.register("best_of", best, replace=True)
    combined = cb.combine(dataset(spark, sf), cb.CombinationRequest("best_of", PAIR))
    return combined.where("horizon_bars = 1 AND raw_value IS NOT NULL").select("instrument_id", "timestamp", "raw_value")


# -- models --------------------------------------------------------------------------------
def model_request(model: str, **more) -> cb.CombinationRequest:
    params = {
        "model": model, "bar_type": "1d", "min_train_observations": 50, "min_train_periods": 5,
        "retrain_every": 10, "target_transform": "zscore",
        "model_params": {"n_estimators": 8, "max_depth": 3, "alpha": 1.0 if model == "ridge" else 0.001},
        **more,
    }
    return cb.CombinationRequest("machine_learning", (MOM, SPREAD, TURN), name="model", params=params)


_TRIO = ", ".join(f"max(v) FILTER (WHERE factor_name = '{n}') AS x{i}" for i, n in enumerate((MOM, SPREAD, TURN)))


def _each(text: str, sep: str = ", ") -> str:
    """``text`` for each of the three features."""
    return sep.join(text.replace("#", str(i)) for i in range(3))


# Training rows of every refit, standardized, and their correlations. (Without a window, a time at which a fit can be
# made is followed by such times only.)
_WALK = f"""{dataset_sql()},
ft AS (SELECT venue, instrument_id, bar_type, t, {_TRIO} FROM ds GROUP BY ALL),
tg AS (SELECT DISTINCT venue, instrument_id, bar_type, t, exit_time, y, ok FROM ds WHERE h = 1),
rw AS (SELECT ft.*, exit_time, y, ok FROM ft LEFT JOIN tg USING (venue, instrument_id, bar_type, t)),
rd AS (SELECT *, exit_time + INTERVAL 1 DAY AS known FROM rw WHERE ok AND y IS NOT NULL),
tm AS (SELECT t AS due, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM rw)),
ct AS (SELECT due, i, count(*) AS n, count(DISTINCT t) AS periods, least({_each('count(x#)')}) AS least_seen
  FROM tm JOIN rd ON known <= due GROUP BY ALL),
ab AS (SELECT *, min(i) OVER () AS i0 FROM ct WHERE i >= 5 AND periods >= 5 AND n >= 50 AND least_seen > 0),
rf AS (SELECT due, n, CAST(row_number() OVER (ORDER BY due) AS INTEGER) AS fit FROM ab WHERE (i - i0) % 10 = 0),
tr AS (SELECT due, fit, n, {_each('x#')}, y FROM rf JOIN rd ON known <= due),
md AS (SELECT due, {_each('median(x#) AS d#')} FROM tr GROUP BY due),
im AS (SELECT tr.due, fit, n, y, {_each('coalesce(x#, d#) AS x#')} FROM tr JOIN md USING (due)),
st AS (SELECT due, avg(y) AS ym, stddev_pop(y) AS ys, {_each('avg(x#) AS c#')}, {_each('stddev_pop(x#) AS s#')} FROM im GROUP BY due),
zz AS (SELECT im.due, fit, n, {_each('(x# - c#) / s# AS z#')}, (y - ym) / ys AS u FROM im JOIN st USING (due)),
mo AS (SELECT due, fit, CAST(n AS DOUBLE) AS n, avg(z0 * z1) AS g, avg(z0 * z2) AS k, avg(z1 * z2) AS l, {_each('avg(z# * u) AS r#')} FROM zz GROUP BY ALL)"""
# The ridge system by cofactors: diagonal n + 1, right side n times the correlations.
_RIDGE = f"""{_WALK},
ws AS (
  SELECT due, fit,
    (n * r0 * (a * a - n * l * n * l) - n * g * (n * r1 * a - n * l * n * r2) + n * k * (n * r1 * n * l - a * n * r2)) / det AS w0,
    (a * (n * r1 * a - n * l * n * r2) - n * r0 * (n * g * a - n * l * n * k) + n * k * (n * g * n * r2 - n * r1 * n * k)) / det AS w1,
    (a * (a * n * r2 - n * r1 * n * l) - n * g * (n * g * n * r2 - n * r1 * n * k) + n * r0 * (n * g * n * l - a * n * k)) / det AS w2
  FROM (SELECT *, n + 1.0 AS a,
    (n + 1.0) * ((n + 1.0) * (n + 1.0) - n * l * n * l) - n * g * (n * g * (n + 1.0) - n * l * n * k)
      + n * k * (n * g * n * l - (n + 1.0) * n * k) AS det FROM mo))"""
# The elastic net by 200 rounds over its three coordinates: alpha 0.001, half of it on the absolute slopes.
_SOFT = "sign({0}) * greatest(abs({0}) - 0.0005, 0) / 1.0005"
_NET = f"""{_WALK},
cd AS (
  SELECT due, 0 AS step, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM mo
  UNION ALL
  SELECT due, step + 1, v0, v1, {_SOFT.format('(r2 - k * v0 - l * v1)')} FROM (
    SELECT *, {_SOFT.format('(r1 - g * v0 - l * w2)')} AS v1 FROM (
      SELECT cd.*, r0, r1, r2, g, k, l, {_SOFT.format('(r0 - g * w1 - k * w2)')} AS v0 FROM cd JOIN mo USING (due) WHERE step < 200))),
ws AS (SELECT due, fit, w0, w1, w2 FROM cd JOIN mo USING (due) WHERE step = 200)"""
_SCORE = f""",
fs AS (SELECT ws.*, {_each('d#')}, {_each('c#')}, {_each('s#')} FROM ws JOIN md USING (due) JOIN st USING (due)),
fo AS (SELECT rw.*, fs.* FROM rw ASOF LEFT JOIN fs ON rw.t >= fs.due),
sc AS (SELECT *, CASE WHEN {_each('x# IS NOT NULL', ' OR ')} THEN {_each('w# * (coalesce(x#, d#) - c#) / s#', ' + ')} END AS raw FROM fo)"""
_FLAG = "CASE WHEN due IS NULL THEN 'MODEL_WARMUP_INCOMPLETE' WHEN raw IS NULL THEN 'MISSING_COMPONENT_FACTOR' ELSE '' END"
_SCORED = dict(d="raw_value=raw", o=f"{T}; factor_quality_flags={_FLAG}")


def _linear_scores(spark: SparkSession, sf: str, model: str) -> DataFrame:
    out, _ = models.walk_forward(dataset(spark, sf), model_request(model))
    return out.select("instrument_id", "timestamp", "raw_value", "factor_quality_flags")


@query("walk_forward_ridge", final(_RIDGE + _SCORE, "sc", **_SCORED))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _linear_scores(spark, sf, "ridge")


@query("walk_forward_elastic_net", final(_NET + _SCORE, "sc", **_SCORED).replace("WITH", "WITH RECURSIVE", 1))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _linear_scores(spark, sf, "elastic_net")


@query(
    "walk_forward_weights",
    final(
        f"{_RIDGE}, wt AS (" + " UNION ALL ".join(
            f"SELECT due, fit, '{n}' AS factor_name, w{i} AS weight FROM ws" for i, n in enumerate((MOM, SPREAD, TURN))
        ) + ")",
        "wt", d="weight", i="fit", o="timestamp=due; factor_name; kind='coefficient'",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return models.walk_forward(dataset(spark, sf), model_request("ridge"))[1]


# Trees are compared by where they score: their splits differ between engines.
_TREES = f"""{_WALK},
tc AS (
  SELECT t, CASE WHEN due IS NULL THEN 'MODEL_WARMUP_INCOMPLETE' WHEN {_each('x# IS NULL', ' AND ')} THEN 'MISSING_COMPONENT_FACTOR' ELSE '' END AS flags
  FROM rw ASOF LEFT JOIN rf ON rw.t >= rf.due),
tn AS (SELECT t, flags, count(*) AS n, count(*) FILTER (WHERE flags = '') AS scored FROM tc GROUP BY ALL)"""


def _tree_query(model: str) -> None:
    @query(f"walk_forward_{model}", final(_TREES, "tn", i="rows=n", o="timestamp=t; factor_quality_flags=flags; scored"))
    def _(spark: SparkSession, sf: str) -> DataFrame:
        out, _ = models.walk_forward(dataset(spark, sf), model_request(model))
        return out.groupBy("timestamp", "factor_quality_flags").agg(
            F.count(F.lit(1)).alias("rows"), F.count("raw_value").alias("scored")
        )


for _m in ("random_forest", "gradient_boosting", "hist_gradient_boosting"):
    _tree_query(_m)


@query(
    "target_transform_zscore",
    final(
        f"{dataset_sql()}, tt AS (SELECT instrument_id, t, y FROM (SELECT DISTINCT instrument_id, t, y, ok FROM ds WHERE h = 1) WHERE ok), "
        "ts2 AS (SELECT *, avg(y) OVER () AS m, stddev_pop(y) OVER () AS s FROM tt)",
        "ts2", d="label_value=(y - m) / s", o=T,
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    target = cb.prepare_target(dataset(spark, sf), 1).where("label_is_valid")
    return models.transform_target(target, "zscore").select("instrument_id", "timestamp", "label_value")

