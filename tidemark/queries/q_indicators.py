"""Indicators and signals on 4h bars per event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators import signals as sig
from tidemark.queries.base import bars, bars_sql, ewm, final, lag, over, query, roll, series_rows, staged

K = ["venue", "instrument_id"]
T = "instrument_id; timestamp=t"
TR = [
    {"pc": lag("close")},
    {"tr": "greatest(high - low, abs(high - pc), abs(low - pc))"},
]


def run_on(spark: SparkSession, sf: str, *builders, df: DataFrame | None = None, **kw) -> DataFrame:
    base = bars(spark, sf, "type") if df is None else df
    return ind.add(base, *builders, keys=K, max_rows=series_rows(spark, sf, "type"), **kw)


def show(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("instrument_id", "timestamp", *columns)


def sql(stages: list[dict[str, str]], **out) -> str:
    out.setdefault("o", T)
    ctes = f"{bars_sql('type')},\n{staged('bars', stages)}"
    return final(ctes, f"s{len(stages) - 1}", **out)


def span(n: int) -> str:
    return f"(2.0 / {n + 1})"


def macd_stages(fast: int, slow: int, signal: int) -> list[dict[str, str]]:
    return [
        {"ef": ewm("close", span(fast), fast), "es": ewm("close", span(slow), slow)},
        {"dif": "ef - es"},
        {"dea": ewm("dif", span(signal), signal)},
        {"macd": "(dif - dea) * 2"},
    ]


MACD = macd_stages(12, 26, 9)


@query("indicator_macd", sql(MACD, d="dif dea macd"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return show(run_on(spark, sf, ind.macd()), "dif", "dea", "macd")


def _adjusted(x: str, com: int) -> str:
    w = f"(PARTITION BY instrument_id ORDER BY t ROWS UNBOUNDED PRECEDING)"
    n = f"list_reduce(list({x}) OVER {w}, lambda a, b: a * ({com} / {com + 1}.0) + b)"
    d = f"list_reduce(list(CAST(1.0 AS DOUBLE)) OVER {w}, lambda a, b: a * ({com} / {com + 1}.0) + b)"
    return f"({n}) / ({d})"


@query(
    "indicator_macd_adjusted",
    sql(
        [
            {"fe": _adjusted("close", 5), "se": _adjusted("close", 12)},
            {"df": "fe - se"},
            {"de": _adjusted("df", 4)},
        ],
        d="fast_ema=fe; slow_ema=se; diff=df; dea=de; macd=df - de",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, ind.macd_adjusted(5, 12, 4))
    return show(df, "fast_ema", "slow_ema", "diff", "dea", "macd")


def er_stages(n: int) -> list[dict[str, str]]:
    return [
        {"dc": f"abs(close - {lag('close')})", "mv": f"abs(close - {lag('close', n)})"},
        {"pa": roll("sum", "dc", n)},
        {"er": "CASE WHEN pa <> 0 AND mv IS NOT NULL THEN greatest(0, least(1, mv / pa)) END"},
    ]


@query("indicator_efficiency_ratio", sql(er_stages(12), d="efficiency_ratio=er"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return show(run_on(spark, sf, ind.efficiency_ratio(12)), "efficiency_ratio")


def _variable(alpha: str) -> str:
    """Fold of (value, alpha) pairs; the first pair carries the mean of the values seen."""
    w = "(PARTITION BY instrument_id ORDER BY t ROWS UNBOUNDED PRECEDING)"
    item = (
        "{'x': CAST(CASE WHEN nth = 1 THEN mean ELSE close END AS DOUBLE), "
        f"'a': CAST(CASE WHEN nth = 1 THEN 1.0 ELSE {alpha} END AS DOUBLE)}}"
    )
    pairs = f"list({item}) FILTER (WHERE er IS NOT NULL) OVER {w}"
    fold = (
        f"list_reduce({pairs}, lambda p, q: "
        "{'x': p.x + q.a * (q.x - p.x), 'a': q.a})"
    )
    return f"(CASE WHEN nth >= 1 THEN ({fold}).x END)"


def _adaptive(fa: str, sa: str) -> list[dict[str, str]]:
    return [
        *er_stages(6),
        {
            "nth": f"count(er) {over()}",
            "mean": "avg(close) OVER (PARTITION BY instrument_id ORDER BY t ROWS UNBOUNDED PRECEDING)",
        },
        {"af": _variable(fa), "sl": _variable(sa)},
        {"line": "af - sl"},
        {"sg": ewm("line", span(5), 5)},
    ]


def _kama(quick: int, slowest: int) -> str:
    return f"power(er * ({span(quick)} - {span(slowest)}) + {span(slowest)}, 2)"


_ADAPTIVE = {
    "er_scaled_balanced": (f"least(1.0, {span(6)} * (0.5 + er))", f"least(1.0, {span(13)} * (0.5 + er))"),
    "er_scaled_wide": (
        f"least(1.0, {span(6)} * (0.25 + 1.75 * er))", f"least(1.0, {span(13)} * (0.25 + 1.75 * er))"
    ),
    "kama_separate_bounds": (_kama(2, 6), _kama(6, 13)),
    "kama_shared_fast_bound": (_kama(2, 6), _kama(2, 13)),
}


def _adaptive_query(model: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = run_on(spark, sf, ind.adaptive_macd(model, 6, 6, 13, 5))
        return show(df, "adaptive_fast", "adaptive_slow", "macd", "macd_signal", "macd_histogram")

    return run


for _model, (_fa, _sa) in _ADAPTIVE.items():
    query(
        f"adaptive_macd_{_model}",
        sql(
            _adaptive(_fa, _sa),
            d="adaptive_fast=af; adaptive_slow=sl; macd=line; macd_signal=sg; macd_histogram=line - sg",
        ),
    )(_adaptive_query(_model))

AVERAGES = [
    {"ma_fast": roll("avg", "close", 5), "ma_slow": roll("avg", "close", 20), "volume_ma": roll("avg", "volume", 20)},
    {"spread": "ma_fast - ma_slow", "pb": lag("ma_slow", 6)},
    {"spread_pct": "spread / ma_slow", "ma_slope": "(ma_slow - pb) / pb"},
]


@query("indicator_moving_averages", sql(AVERAGES, d="ma_fast ma_slow spread spread_pct ma_slope volume_ma"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, ind.moving_averages())
    return show(df, "ma_fast", "ma_slow", "spread", "spread_pct", "ma_slope", "volume_ma")


ATR = [*TR, {"atr14": ewm("tr", "(1.0/14)", 14)}, {"atr_pct": "atr14 / close"}]


@query("indicator_atr", sql(ATR, d="atr14 atr_pct"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return show(run_on(spark, sf, ind.atr14()), "atr14", "atr_pct")


_A14 = "(1.0/14)"
ADX = [
    *ATR,
    {"up": f"high - {lag('high')}", "dn": f"{lag('low')} - low"},
    {"pdm": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END", "mdm": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END"},
    {"ep": ewm("pdm", _A14, 14), "em": ewm("mdm", _A14, 14)},
    {"pdi": "100 * ep / atr14", "mdi": "100 * em / atr14"},
    {"dx": "CASE WHEN pdi + mdi <> 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) END"},
    {"adx14": ewm("dx", _A14, 14)},
]


@query("indicator_adx", sql(ADX, d="plus_di=pdi; minus_di=mdi; adx14"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return show(run_on(spark, sf, ind.adx14()), "plus_di", "minus_di", "adx14")


def pct_stage(x: str, n: int, m: int, out: str) -> list[dict[str, str]]:
    w = over(n)
    return [
        {"xs": f"list({x}) FILTER (WHERE {x} IS NOT NULL) {w}"},
        {
            out: f"CASE WHEN {x} IS NOT NULL AND len(xs) >= {m} THEN (len(list_filter(xs, lambda a: a < {x})) + "
                 f"(len(list_filter(xs, lambda a: a = {x})) + 1) / 2.0) / len(xs) END"
        },
    ]


@query("indicator_percentile_rank", sql(pct_stage("volume", 30, 10, "p"), d="volume_percentile=p"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return show(run_on(spark, sf, ind.percentile_rank("volume", 30, 10)), "volume_percentile")


@query(
    "indicator_median_expansion",
    sql([*ATR, {"md": roll("median", "atr_pct", 30, 10)}], d="atr_expansion=atr_pct / md"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, ind.atr14())
    return show(run_on(spark, sf, ind.median_expansion("atr_pct", 30, 10), df=df), "atr_expansion")


VOLUME = [
    {"pv": lag("volume"), "sv": f"coalesce(sign(close - {lag('close')}), 0.0) * volume"},
    {"pm": roll("median", "pv", 10), "fl": f"{roll('sum', 'sv', 6)} / {roll('sum', 'volume', 6)}"},
    *pct_stage("volume", 10, 10, "vp"),
]


@query("indicator_volume_features", sql(VOLUME, d="relative_volume=volume / pm; volume_percentile=vp; volume_flow=fl"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, ind.volume_features(10, 6))
    return show(df, "relative_volume", "volume_percentile", "volume_flow")


@query(
    "indicator_confirmation",
    sql(
        [*ADX, {"vm": roll("avg", "volume", 20), "mh": roll("max", "high", 12), "ml": roll("min", "low", 12)},
         {"pvm": lag("vm"), "ph": lag("mh"), "pl": lag("ml"), "pa": lag("adx14", 3)}],
        d="volume_ratio=volume / pvm; prior_high=ph; prior_low=pl; adx_rise_3h=adx14 - pa",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, ind.adx14())
    df = run_on(spark, sf, ind.confirmation_features(12, adx="adx14"), df=df)
    return show(df, "volume_ratio", "prior_high", "prior_low", "adx_rise_3h")


@query("indicator_rounded_average", sql([{"m": roll("avg", "close", 7)}], d="value=round(m, 8)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return show(run_on(spark, sf, ind.rounded_average(7)), "value")


@query(
    "indicator_trend_table",
    sql(
        [
            *TR,
            {"lo": roll("min", "low", 9), "hi": roll("max", "high", 9), "a": ewm("tr", "(1.0/24)")},
            {"rsv": "CASE WHEN hi - lo <> 0 THEN (close - lo) / (hi - lo) END"},
            {"k": ewm("rsv", "(1.0/3)", 3)},
            {"dd": ewm("k", "(1.0/3)", 3)},
            {"ms": f"{roll('avg', 'close', 5)} / {roll('avg', 'close', 20)} - 1",
             "nr": f"lead(open, 2) {over()} / lead(open, 1) {over()} - 1", "et": f"lead(t, 1) {over()}"},
        ],
        d="ma_spread=ms; atr_pct=a / close; kdj_j_minus_d=3 * (k - dd); next_open_return=nr",
        o=f"{T}; entry_time=et",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, ind.trend_indicators(5, 20))
    return show(df, "ma_spread", "atr_pct", "kdj_j_minus_d", "next_open_return", "entry_time")


# -- signals -------------------------------------------------------------------------------
def cross_sql(x: str, level: float = 0.0, mask: str = "true") -> str:
    p = lag(x)
    return (
        f"(CASE WHEN {p} <= {level} AND {x} > {level} AND ({mask}) THEN 1 "
        f"WHEN {p} >= -{level} AND {x} < -{level} AND ({mask}) THEN -1 ELSE 0 END)"
    )


def averaged(spark: SparkSession, sf: str, *more) -> DataFrame:
    return run_on(spark, sf, ind.moving_averages(), *more)


@query("signal_cross", sql([*AVERAGES, {"s": cross_sql("spread")}], i="signal=s"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return show(run_on(spark, sf, sig.cross_signal(), df=averaged(spark, sf)), "signal")


@query("signal_threshold_cross", sql([*AVERAGES, {"s": cross_sql("spread_pct", 0.05)}], i="signal=s"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return show(run_on(spark, sf, sig.threshold_cross(0.05), df=averaged(spark, sf)), "signal")


_FULL = [*AVERAGES, *ADX]


@query(
    "signal_filter_set",
    sql(
        [
            *_FULL,
            {
                "b0": cross_sql("spread"), "b1": cross_sql("spread_pct", 0.003), "b2": cross_sql("spread_pct", 0.0035),
                "b4": cross_sql("spread_pct", 0.004), "b5": cross_sql("spread", 0.0, "volume >= volume_ma * 1.2"),
            },
        ],
        i="baseline=b0; spread_030=b1; spread_035=b2; spread_035_atr=CASE WHEN atr_pct >= 0.005 THEN b2 ELSE 0 END; "
          "spread_040_adx20=CASE WHEN adx14 >= 20 THEN b4 ELSE 0 END; volume_12x=b5",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = averaged(spark, sf, ind.atr14(), ind.adx14())
    names = ["baseline", "spread_030", "spread_035", "spread_035_atr", "spread_040_adx20", "volume_12x"]
    return show(run_on(spark, sf, sig.filter_set(), df=df), *names)


@query(
    "signal_slope_cross",
    sql(
        [*AVERAGES, {"c": cross_sql("spread")}],
        i="signal=CASE WHEN (c > 0 AND ma_slope > 0.01) OR (c < 0 AND ma_slope < -0.01) THEN c ELSE 0 END",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return show(run_on(spark, sf, sig.slope_cross(0.01), df=averaged(spark, sf)), "signal")


@query(
    "signal_ema_cross",
    sql(
        [
            {"a": ewm("close", span(5)), "b": ewm("close", span(12))},
            {"sd": "CASE WHEN a > b THEN 1 ELSE -1 END"},
            {"ps": lag("sd")},
        ],
        i="signal=CASE WHEN ps = sd THEN 0 ELSE sd END",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return show(run_on(spark, sf, sig.ema_cross(5, 12)), "signal")


def hold_sql(x: str) -> str:
    return (
        f"coalesce(last_value({x} IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY t ROWS UNBOUNDED PRECEDING), 0)"
    )


@query(
    "signal_held_target",
    sql([*AVERAGES, {"s": cross_sql("spread")}, {"e": "nullif(s, 0)"}, {"h": hold_sql("e")}], i="target=h"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, sig.cross_signal(), df=averaged(spark, sf))
    return show(run_on(spark, sf, sig.held_target(), df=df), "target")


@query(
    "signal_adaptive_target",
    sql(
        [
            *AVERAGES, *ATR, *er_stages(12), *pct_stage("atr_pct", 40, 20, "ap"),
            {"z": "spread / atr14"},
            {"s": cross_sql("z", 0.1, "ap >= 0.2 AND er >= 0.02")},
            {"e": "nullif(s, 0)"},
            {"h": hold_sql("e")},
        ],
        i="target=h",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = averaged(spark, sf, ind.atr14(), ind.efficiency_ratio(12))
    df = run_on(spark, sf, ind.percentile_rank("atr_pct", 40, 20, "atr_percentile"), df=df)
    return show(run_on(spark, sf, sig.adaptive_target(0.1, 0.2, 0.02), df=df), "target")


EXTREMA = [{"m1": lag("dif", 1), "m2": lag("dif", 2)}]
_PEAK, _TROUGH = "(m1 > m2 AND m1 > dif)", "(m1 < m2 AND m1 < dif)"
FADE = [*MACD, *EXTREMA, {"ev": f"CASE WHEN {_PEAK} THEN -1 WHEN {_TROUGH} THEN 1 END"}, {"target": hold_sql("ev")}]


@query("signal_extrema_fade", sql(FADE, i="target"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, ind.macd())
    return show(run_on(spark, sf, sig.extrema_fade(), df=df), "target")


@query(
    "signal_extrema_fade_sign_rule",
    sql(
        [*MACD, *EXTREMA, {"ev": f"CASE WHEN {_PEAK} AND m1 > 0 THEN -1 WHEN {_TROUGH} AND m1 < 0 THEN 1 END"}, {"h": hold_sql("ev")}],
        i="target=h",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, ind.macd())
    return show(run_on(spark, sf, sig.extrema_fade(sign_rule=True), df=df), "target")


@query(
    "signal_extrema_follow",
    sql([*MACD, *EXTREMA], i=f"target=CASE WHEN {_PEAK} THEN 1 WHEN {_TROUGH} THEN -1 ELSE 0 END"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, ind.macd())
    return show(run_on(spark, sf, sig.extrema_follow("dif"), df=df), "target")


@query(
    "signal_extrema_entry",
    sql(
        [
            *ATR, *MACD, *EXTREMA, *pct_stage("atr_pct", 40, 20, "ap"),
            {"ok": "coalesce(ap >= 0.5, false)"},
            {"ev": f"CASE WHEN {_PEAK} THEN CASE WHEN ok THEN -1 ELSE 0 END WHEN {_TROUGH} THEN CASE WHEN ok THEN 1 ELSE 0 END END"},
            {"h": hold_sql("ev")},
        ],
        i="target=h",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, ind.macd(), ind.atr14())
    df = run_on(spark, sf, ind.percentile_rank("atr_pct", 40, 20, "atr_percentile"), df=df)
    return show(
        run_on(spark, sf, sig.extrema_entry(F.col("atr_percentile") >= 0.5, "dif"), df=df), "target"
    )


_CONDITIONS = ["baseline_no_atr", "atr_percentile_ge_50", "macd_atr_ge_0.25", "atr_expansion_ge_1.10"]


@query(
    "signal_entry_conditions",
    sql(
        [
            *ATR, *MACD, *pct_stage("atr_pct", 40, 20, "ap"),
            {"md": roll("median", "atr_pct", 40, 20), "st": f"abs({lag('macd')}) / {lag('atr14')}"},
            {"variants": "[('baseline_no_atr', true), ('atr_percentile_ge_50', coalesce(ap >= 0.5, false)), "
                  "('macd_atr_ge_0.25', coalesce(st >= 0.25, false)), ('atr_expansion_ge_1.10', coalesce(atr_pct / md >= 1.1, false))]"},
            {"v": "unnest(variants)"},
        ],
        o=f"{T}; variant=v[1]; allowed=v[2]",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, ind.macd(), ind.atr14())
    df = run_on(
        spark, sf, ind.percentile_rank("atr_pct", 40, 20, "atr_percentile"),
        ind.median_expansion("atr_pct", 40, 20), df=df,
    )
    df = run_on(spark, sf, sig.entry_conditions(), df=df)
    tall = sig.variants_tall(df, _CONDITIONS, "allowed")
    return show(tall, "variant", "allowed")


@query(
    "signal_direction_consensus",
    sql(
        [*FADE, {"a": roll("avg", "close", 10), "b": roll("avg", "close", 20)}],
        i="target=CASE WHEN (target > 0 AND close > a AND close > b) OR (target < 0 AND close < a AND close < b) THEN target ELSE 0 END",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, sig.extrema_fade(), df=run_on(spark, sf, ind.macd()))
    return show(run_on(spark, sf, sig.direction_consensus(10, 20), df=df), "target")


_DIR = "(CASE WHEN close > open THEN 1 ELSE -1 END)"


@query(
    "signal_volume_gate",
    sql(
        VOLUME,
        o=f"{T}; relative=coalesce(volume / pm >= 1.1, false); percentile=coalesce(vp >= 0.6, false); "
          f"flow=coalesce({_DIR} * fl >= 0.1, false); both=coalesce(volume / pm >= 1.1 AND {_DIR} * fl >= 0.1, false)",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, ind.volume_features(10, 6))
    way = F.when(F.col("close") > F.col("open"), 1).otherwise(-1)
    gates = {
        "relative": sig.volume_gate("relative_volume", way, 1.1),
        "percentile": sig.volume_gate("volume_percentile", way, 0.6),
        "flow": sig.volume_gate("directional_flow", way, flow_threshold=0.1),
        "both": sig.volume_gate("relative_and_flow", way, 1.1, 0.1),
    }
    return show(df.withColumns(gates), *gates)


@query("signal_one_sided", sql(FADE, i="long_only=greatest(target, 0); short_only=least(target, 0)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = run_on(spark, sf, sig.extrema_fade(), df=run_on(spark, sf, ind.macd()))
    sides = {"long_only": sig.one_sided("target", "long"), "short_only": sig.one_sided("target", "short")}
    return show(df.withColumns(sides), *sides)


_LEVELS, _FRACTIONS = [0.05, 0.1, 0.2], [0.4, 0.7, 1.0]
_REACHED = "greatest(0.0, " + ", ".join(
    f"CASE WHEN rdy AND sd * spread_pct > {a} THEN {b} ELSE 0.0 END" for a, b in zip(_LEVELS, _FRACTIONS, strict=True)
) + ")"


@query(
    "signal_scale_in",
    sql(
        [
            *AVERAGES, *ATR,
            {"rdy": "spread_pct IS NOT NULL AND atr_pct IS NOT NULL", "ps": lag("spread_pct")},
            {"ev": "CASE WHEN rdy AND atr_pct >= 0.005 AND ps <= 0.05 AND spread_pct > 0.05 THEN 1 "
                   "WHEN rdy AND atr_pct >= 0.005 AND ps >= -0.05 AND spread_pct < -0.05 THEN -1 END"},
            {"sd": hold_sql("ev"), "rg": f"count(ev) {over()}"},
            {"nw": f"CASE WHEN ev IS NOT NULL THEN 0.4 ELSE {_REACHED} END"},
            {"pk": "max(nw) OVER (PARTITION BY instrument_id, rg ORDER BY t ROWS UNBOUNDED PRECEDING)"},
        ],
        d="target=sd * pk",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = averaged(spark, sf, ind.atr14())
    out = run_on(spark, sf, sig.scale_in(_LEVELS, _FRACTIONS), df=df)
    return show(out, F.col("target").cast("double").alias("target"))
