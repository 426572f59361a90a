"""Portfolios from factors, and their accounts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import portfolio as pf
from tidemark.queries.base import final, query, series_rows
from tidemark.queries.q_processing import MOM, SPREAD, dataset, dataset_sql
from tidemark.session import materialize

START = datetime(2024, 1, 1)
PATH = "label_name, h"

QUANTILE = f"""{dataset_sql('calm_user', (1, 2))},
sel AS (SELECT * FROM ds WHERE valid AND factor_name = '{MOM}' AND date_diff('day', TIMESTAMP '2024-01-01', t) % h = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY {PATH}, t ORDER BY v, instrument_id) AS r, count(*) OVER (PARTITION BY {PATH}, t) AS n FROM sel),
tl AS (SELECT *, greatest(1, n // 5) AS b, CASE WHEN r <= greatest(1, n // 5) THEN -1 WHEN r > n - greatest(1, n // 5) THEN 1 ELSE 0 END AS tail FROM rk WHERE n >= 5),
sec AS (SELECT {PATH}, t, min(exit_time) AS exit_time, count(*) FILTER (WHERE tail = 1) AS lc, count(*) FILTER (WHERE tail = -1) AS sc,
  avg(gross) FILTER (WHERE tail = 1) AS gl, -avg(gross) FILTER (WHERE tail = -1) AS gs, avg(gross) AS bm FROM tl GROUP BY ALL),
wt AS (SELECT {PATH}, t, instrument_id, tail * 0.5 / b AS w FROM tl WHERE tail <> 0),
ts AS (SELECT {PATH}, t, lead(t) OVER (PARTITION BY {PATH} ORDER BY t) AS nx FROM sec),
mv AS (SELECT {PATH}, t, instrument_id, w FROM wt UNION ALL SELECT {PATH}, nx, instrument_id, -w FROM wt JOIN ts USING ({PATH}, t) WHERE nx IS NOT NULL),
ch AS (SELECT {PATH}, t, instrument_id, sum(w) AS w FROM mv GROUP BY ALL),
tv AS (SELECT {PATH}, t, sum(abs(w)) / 2 AS turnover FROM ch GROUP BY ALL),
pa AS (SELECT *, 0.5 * (gl + gs) AS g, turnover * 0.0016 AS cost FROM sec JOIN tv USING ({PATH}, t)),
pb AS (SELECT *, g - cost AS pr, g - cost AS ar FROM pa)"""


def wealth_sql(source: str, keys: str = PATH, out: str = "pf") -> str:
    """Compounded wealth and drawdowns of ``pr``, ``ar`` and ``bm``."""
    w = f"(PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING)"
    return f"""{out}0 AS (SELECT *, product(1 + pr) OVER {w} AS w, product(1 + ar) OVER {w} AS aw, product(1 + bm) OVER {w} AS bw FROM {source}),
{out} AS (SELECT *, w / greatest(max(w) OVER {w}, 1.0) - 1 AS dd, aw / greatest(max(aw) OVER {w}, 1.0) - 1 AS add, bw / greatest(max(bw) OVER {w}, 1.0) - 1 AS bdd FROM {out}0)"""


LONG_SHORT = f"{QUANTILE},\n{wealth_sql('pb')}"


def long_short(spark: SparkSession, sf: str, mode: str = "long_short") -> DataFrame:
    return pf.quantile_portfolio(
        dataset(spark, sf, "calm_user"), MOM, start=START, timeframe="1d", quantiles=5, cost_bps=16.0, mode=mode,
        max_rows=series_rows(spark, sf, "calm_user"),
    )


@query(
    "quantile_portfolio_long_short",
    final(
        LONG_SHORT, "pf",
        d="gross_long_return=gl; gross_short_return=gs; net_long_return=gl - 0.0016; net_short_return=gs - 0.0016; gross_portfolio_return=g; "
          "benchmark_return=bm; gross_active_return=g; transaction_cost=cost; portfolio_return=pr; portfolio_active_return=ar; turnover; "
          "wealth=w; active_wealth=aw; benchmark_wealth=bw; drawdown=dd; active_drawdown=add; benchmark_drawdown=bdd",
        i="horizon_bars=h; long_count=lc; short_count=sc", o=f"factor_name='{MOM}'; label_name; timestamp=t; exit_time",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return long_short(spark, sf)


@query(
    "quantile_portfolio_long_only",
    final(
        f"{QUANTILE}, lw AS (SELECT {PATH}, t, instrument_id, 1.0 / b AS w FROM tl WHERE tail = 1), "
        f"lm AS (SELECT {PATH}, t, instrument_id, w FROM lw UNION ALL SELECT {PATH}, nx, instrument_id, -w FROM lw JOIN ts USING ({PATH}, t) WHERE nx IS NOT NULL), "
        f"lcg AS (SELECT {PATH}, t, instrument_id, sum(w) AS w FROM lm GROUP BY ALL), lt AS (SELECT {PATH}, t, sum(abs(w)) / 2 AS tn FROM lcg GROUP BY ALL), "
        f"lo AS (SELECT * FROM sec JOIN lt USING ({PATH}, t))",
        "lo", d="gross_portfolio_return=gl; turnover=tn; portfolio_return=gl - tn * 0.0016; portfolio_active_return=gl - bm - tn * 0.0016",
        i="horizon_bars=h; long_count=lc; short_count=0", o="timestamp=t",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return long_short(spark, sf, "long_only").select(
        "timestamp", "horizon_bars", "long_count", "short_count", "gross_portfolio_return",
        "turnover", "portfolio_return", "portfolio_active_return",
    )


@query("portfolio_turnover", final(QUANTILE, "tv", d="turnover", i="horizon_bars=h", o="label_name; timestamp=t"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    members = materialize(
        pf.quantile_members(dataset(spark, sf, "calm_user"), MOM, start=START, timeframe="1d", quantiles=5)
    )
    return pf.turnover(pf.tail_weights(members, "long_short"))


def _metric(prefix: str, r: str, dd: str) -> str:
    year = "(365.0 / max(h))"
    return (
        f"product(1 + {r}) - 1 AS {prefix}total_return, CASE WHEN product(1 + {r}) > 0 THEN pow(product(1 + {r}), {year} / count(*)) - 1 ELSE -1 END AS {prefix}annual_return, "
        f"CASE WHEN stddev_samp({r}) > 0 THEN avg({r}) / stddev_samp({r}) * sqrt({year}) END AS {prefix}sharpe, min({dd}) AS {prefix}max_drawdown"
    )


_RATES = (
    "avg((lc > 0)::INT) AS long_rate, avg((sc > 0)::INT) AS short_rate, avg((lc = 0 AND sc = 0)::INT) AS flat_rate"
)


def metrics_sql(source: str, keys: str) -> str:
    return (
        f"me AS (SELECT {keys}, count(*) AS periods, {_metric('', 'pr', 'dd')}, {_metric('active_', 'ar', 'add')}, {_metric('benchmark_', 'bm', 'bdd')}, "
        f"product(1 + pr) / product(1 + bm) - 1 AS relative_total_return, avg(turnover) AS turnover, avg((pr > 0)::INT) AS win_rate, {_RATES} FROM {source} GROUP BY ALL)"
    )


_METRICS = " ".join(
    f"{p}{m}" for p in ("", "active_", "benchmark_") for m in ("total_return", "annual_return", "sharpe", "max_drawdown")
)


@query(
    "portfolio_metrics",
    final(
        f"{LONG_SHORT},\n{metrics_sql('pf', PATH)}", "me",
        d="; ".join(f"{c}={c}" for c in (_METRICS + " relative_total_return turnover win_rate long_rate short_rate flat_rate").split()),
        i="horizon_bars=h; periods=periods", o=f"factor_name='{MOM}'; label_name",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pf.portfolio_metrics(long_short(spark, sf), "1d")


@query(
    "portfolio_wealth_paths",
    final(
        f"{LONG_SHORT}, wk AS (SELECT {PATH}, arg_max(w, t) AS w, min(dd) AS dd FROM pf GROUP BY ALL)", "wk",
        d="wealth=w; drawdown=dd", i="horizon_bars=h", o="label_name",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pf.enrich(
        long_short(spark, sf).drop(
            "wealth", "drawdown", "active_wealth", "active_drawdown", "benchmark_wealth", "benchmark_drawdown"
        )
    ).groupBy("label_name", "horizon_bars").agg(
        F.max_by("wealth", "timestamp").alias("wealth"), F.min("drawdown").alias("drawdown")
    )


# -- threshold portfolios on the dense panel -----------------------------------------------
TKEYS = ["instrument_id", "label_name", "horizon_bars"]
TK = "instrument_id, label_name, h"
_TW = f"(PARTITION BY {TK} ORDER BY t"


def threshold_sql(source: str = "", standardize: bool = False, trend: bool = False) -> str:
    """``tp``: positions and returns of the threshold rule; ``pf`` adds wealth."""
    signal = "sm"
    z = ""
    if standardize:
        zw = f"{_TW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
        z = (
            f", zn AS (SELECT *, count(sm) OVER {zw} AS zc, avg(sm) OVER {zw} AS zm, stddev_samp(sm) OVER {zw} AS zs FROM sg), "
            "zz AS (SELECT *, CASE WHEN zc >= 10 THEN CASE WHEN zs > 0 THEN (sm - zm) / zs ELSE 0.0 END END AS z FROM zn)"
        )
        signal = "z"
    lo, hi = ("0.8", "0.8") if standardize else ("0.01", "0.01")
    ok = "coalesce(tr > -0.01, false)" if trend else "true"
    return f"""{dataset_sql('calm_type', (2,))},
ob AS (SELECT *, lag(entry_price, 1) OVER {_TW}) / lag(entry_price, 5) OVER {_TW}) - 1 AS tr FROM ds WHERE fv AND factor_name = '{MOM}' AND gross IS NOT NULL),
rb AS (SELECT * FROM ob WHERE date_diff('hour', TIMESTAMP '2024-01-01', t) // 4 % h = 0),
sg AS (SELECT *, avg(v * -1) OVER {_TW} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS sm FROM rb){z},
tg AS (SELECT *, {signal} AS sv, CASE WHEN ok THEN CASE WHEN {signal} > {lo} AND {ok} THEN 0.5 WHEN {signal} < -{hi} THEN -0.5 ELSE 0.0 END END AS tgt FROM {'zz' if standardize else 'sg'}),
ps AS (SELECT *, coalesce(last_value(tgt IGNORE NULLS) OVER {_TW} ROWS UNBOUNDED PRECEDING), 0.0) AS p FROM tg),
pt AS (SELECT *, abs(p - coalesce(lag(p) OVER {_TW}), 0.0)) / 2 AS turnover FROM ps),
tp AS (SELECT *, gross AS bm, p * gross AS g, turnover * 0.001 AS cost, p * gross - turnover * 0.001 AS pr,
  p * gross - gross - turnover * 0.001 AS ar, (p > 0)::INT AS lc, (p < 0)::INT AS sc FROM pt),
{wealth_sql('tp', TK)}"""


def threshold_book(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return materialize(
        pf.threshold_portfolio(
            dataset(spark, sf, "calm_type", (2,)), MOM, start=START, timeframe="4h", cost_bps=10.0,
            signal_multiplier=-1.0, smoothing=2, position_size=0.5, keys=TKEYS,
            max_rows=series_rows(spark, sf, "calm_type"),
            **({"long_threshold": 0.01, "short_threshold": 0.01} | kw),
        )
    )


_BOOK_OUT = dict(
    d="signal_value=sv; position=p; turnover; transaction_cost=cost; gross_portfolio_return=g; portfolio_return=pr; portfolio_active_return=ar; wealth=w; drawdown=dd; benchmark_drawdown=bdd",
    i="horizon_bars=h; long_count=lc; short_count=sc", o="instrument_id; timestamp=t; exit_time",
)
_BOOK = [
    "instrument_id", "timestamp", "exit_time", "horizon_bars", "signal_value", "position", "turnover",
    "transaction_cost", "gross_portfolio_return", "portfolio_return", "portfolio_active_return", "wealth",
    "drawdown", "benchmark_drawdown", "long_count", "short_count",
]
BOOK = threshold_sql()


@query("threshold_portfolio", final(BOOK, "pf", **_BOOK_OUT))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return threshold_book(spark, sf).select(*_BOOK)


@query("threshold_portfolio_zscore", final(threshold_sql(standardize=True), "pf", **_BOOK_OUT))
def _(spark: SparkSession, sf: str) -> DataFrame:
    book = threshold_book(
        spark, sf, standardize=20, standardize_min=10, long_threshold=0.8, short_threshold=0.8
    )
    return book.select(*_BOOK)


@query("threshold_portfolio_trend_filter", final(threshold_sql(trend=True), "pf", **_BOOK_OUT))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return threshold_book(spark, sf, trend_bars=4, trend_min_return=-0.01).select(*_BOOK)


_YEAR = "(365.0 * 6 / max(h))"


def calendar_sql(unit: str, fmt: str, out: str = "cal") -> str:
    w = f"(PARTITION BY {TK}, u ORDER BY t ROWS UNBOUNDED PRECEDING)"
    return f"""cu AS (SELECT *, {fmt} AS u, sign(p) AS sd, coalesce(sign(lag(p) OVER {_TW})), 0) AS pd FROM tp),
cw AS (SELECT *, product(1 + pr) OVER {w} AS rw FROM cu),
cd AS (SELECT *, rw / greatest(max(rw) OVER {w}, 1.0) - 1 AS fall FROM cw),
{out} AS (SELECT {TK}, u AS {unit}, count(*) AS periods, product(1 + g) - 1 AS gross_total_return, product(1 + pr) - 1 AS strategy_return,
  product(1 + bm) - 1 AS benchmark_return, product(1 + pr) / product(1 + bm) - 1 AS relative_total_return,
  CASE WHEN stddev_samp(pr) > 0 THEN avg(pr) / stddev_samp(pr) * sqrt({_YEAR}) END AS sharpe, least(min(fall), 0) AS max_drawdown,
  sum(cost) AS transaction_cost, avg(turnover) AS turnover, sum(turnover) AS total_turnover, sum((turnover > 0)::INT) AS position_changes,
  sum((sd <> 0 AND sd <> pd)::INT) AS entries, sum((pd <> 0 AND sd <> pd)::INT) AS exits, {_RATES} FROM cd GROUP BY ALL)"""


_CAL = "gross_total_return strategy_return benchmark_return relative_total_return sharpe max_drawdown transaction_cost turnover long_rate short_rate flat_rate"


@query(
    "portfolio_yearly",
    final(
        f"{BOOK},\n{calendar_sql('yr', 'year(t)')}", "cal", d="; ".join(f"{c}={c}" for c in _CAL.split()),
        i="horizon_bars=h; year=yr; periods=periods; position_changes=position_changes", o=f"factor_name='{MOM}'; instrument_id; label_name",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pf.yearly_metrics(threshold_book(spark, sf), "4h", TKEYS)


TRADES = f"""rel AS (SELECT *, sign(p) AS sd FROM tp WHERE p <> 0 OR turnover > 0),
bf AS (SELECT *, coalesce(lag(sd) OVER {_TW}), 0) AS pd FROM rel),
nm AS (SELECT *, (sd <> 0 AND sd <> pd)::INT AS op, sum((sd <> 0 AND sd <> pd)::INT) OVER {_TW} ROWS UNBOUNDED PRECEDING) AS k,
  last_value(exit_time) OVER (PARTITION BY {TK} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_exit FROM bf),
lg AS (SELECT {TK}, t, sd, last_exit, sv, 'c' AS kind, k - op AS k, 0.0 AS gr, CASE WHEN sd <> 0 THEN cost / 2 ELSE cost END AS c, 0 AS one FROM nm WHERE pd <> 0 AND sd <> pd
  UNION ALL SELECT {TK}, t, sd, last_exit, sv, 'r', k, g, CASE WHEN pd <> 0 AND sd <> pd THEN cost / 2 ELSE cost END, 1 FROM nm WHERE sd <> 0),
lw AS (SELECT *, product(1 + gr - c) OVER (PARTITION BY {TK}, k ORDER BY t ROWS UNBOUNDED PRECEDING) AS w FROM lg),
lf AS (SELECT *, w / greatest(max(w) OVER (PARTITION BY {TK}, k ORDER BY t ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS fall FROM lw),
tr AS (SELECT {TK}, k, min(t) FILTER (WHERE kind = 'r') AS entry_time, coalesce(max(t) FILTER (WHERE kind = 'c'), max(last_exit)) AS exit_time,
  count(*) FILTER (WHERE kind = 'c') > 0 AS closed, sum(one) AS held, product(1 + gr) - 1 AS gross, product(1 + gr - c) - 1 AS net, sum(c) AS cost,
  least(min(fall), 0) AS dd, arg_min(sd, t) FILTER (WHERE kind = 'r') AS side, arg_min(sv, t) FILTER (WHERE kind = 'r') AS sv FROM lf GROUP BY ALL)"""


@query(
    "portfolio_trade_log",
    final(
        f"{BOOK},\n{TRADES}", "tr", d="holding_hours=held * h * 4; gross_return=gross; strategy_return=net; transaction_cost=cost; max_drawdown=dd; entry_signal_value=sv",
        i="horizon_bars=h; trade_id=k; holding_periods=held",
        o=f"factor_name='{MOM}'; instrument_id; label_name; side=CASE WHEN side > 0 THEN 'long' ELSE 'short' END; entry_time; exit_time; is_closed=closed",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pf.trade_log(threshold_book(spark, sf), "4h", TKEYS, series_rows(spark, sf, "calm_type"))


MONTHLY = f"""{calendar_sql('month', "strftime(t, '%Y-%m')", 'mm')},
mt AS (SELECT {TK}, strftime(exit_time, '%Y-%m') AS month, count(*) AS ct, sum((net > 0)::INT) AS wt, avg((net > 0)::INT) AS wr, avg(net) AS ar, min(net) AS wo, max(net) AS be, avg(held * h * 4) AS ah
  FROM tr WHERE closed GROUP BY ALL),
mo AS (SELECT * FROM mm LEFT JOIN mt USING ({TK}, month))"""


@query(
    "portfolio_monthly",
    final(
        f"{BOOK},\n{TRADES},\n{MONTHLY}", "mo",
        d="; ".join(f"{c}={c}" for c in _CAL.split()) + "; total_turnover=total_turnover; trade_win_rate=wr; average_trade_return=ar; worst_trade_return=wo; best_trade_return=be; average_holding_hours=ah",
        i="horizon_bars=h; periods=periods; position_changes=position_changes; entries=entries; exits=exits; closed_trades=coalesce(ct, 0); winning_trades=coalesce(wt, 0)",
        o=f"factor_name='{MOM}'; instrument_id; label_name; month",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    book = threshold_book(spark, sf)
    return pf.monthly_metrics(book, pf.trade_log(book, "4h", TKEYS, series_rows(spark, sf, "calm_type")), "4h", TKEYS)


@query(
    "portfolio_monthly_summary",
    final(
        f"{BOOK},\n{TRADES},\n{MONTHLY},\nms AS (SELECT {TK}, count(*) AS n, avg((strategy_return > 0)::INT) AS pm, avg((strategy_return < 0)::INT) AS nm, avg((strategy_return = 0)::INT) AS fm, "
        "avg(strategy_return) AS am, median(strategy_return) AS md, min(strategy_return) AS lo, max(strategy_return) AS hi, product(1 + strategy_return) - 1 AS tot, "
        "sum(transaction_cost) AS tc, avg(entries) AS en FROM mo GROUP BY ALL), "
        f"tt AS (SELECT {TK}, count(*) AS ct, avg((net > 0)::INT) AS wr, avg(net) AS ar, median(net) AS mr, avg(held * h * 4) AS ah FROM tr WHERE closed GROUP BY ALL), "
        f"sm2 AS (SELECT * FROM ms LEFT JOIN tt USING ({TK}))",
        "sm2", d="positive_month_rate=pm; negative_month_rate=nm; flat_month_rate=fm; average_monthly_return=am; median_monthly_return=md; monthly_sharpe=CAST(NULL AS DOUBLE); "
        "worst_month_return=lo; best_month_return=hi; total_return=tot; total_transaction_cost=tc; average_monthly_entries=en; trade_win_rate=wr; average_trade_return=ar; median_trade_return=mr; average_holding_hours=ah",
        i="horizon_bars=h; months=n; closed_trades=coalesce(ct, 0)", o=f"factor_name='{MOM}'; instrument_id; label_name",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    book = threshold_book(spark, sf)
    trades = materialize(pf.trade_log(book, "4h", TKEYS, series_rows(spark, sf, "calm_type")))
    return pf.monthly_summary(pf.monthly_metrics(book, trades, "4h", TKEYS), trades, TKEYS)


@query(
    "average_absolute_position",
    final(f"{BOOK}, aa AS (SELECT {TK}, avg(abs(p)) AS a FROM tp GROUP BY ALL)", "aa", d="average_position=a", i="horizon_bars=h", o="instrument_id; label_name"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pf.average_absolute_position(threshold_book(spark, sf), TKEYS)


# Two sleeves of the same instrument: the two momentum-like factors.
def _sleeve(name: str, factor: str) -> str:
    sql = threshold_sql().replace(f"factor_name = '{MOM}'", f"factor_name = '{factor}'")
    body = sql[sql.index("ob AS") : sql.index("pf0 AS")].rstrip().rstrip(",")
    for cte in ("ob", "rb", "sg", "tg", "ps", "pt", "tp"):
        body = body.replace(f"{cte} AS (SELECT", f"{name}_{cte} AS (SELECT").replace(f"FROM {cte})", f"FROM {name}_{cte})").replace(f"FROM {cte} ", f"FROM {name}_{cte} ")
    return body


_BLEND = f"""{dataset_sql('calm_type', (2,))},
{_sleeve('a', MOM)},
{_sleeve('b', SPREAD)},
bl AS (SELECT a.label_name, a.h, a.t, a.exit_time, 0.6 * a.pr + 0.4 * b.pr AS pr, 0.6 * a.g + 0.4 * b.g AS g, 0.6 * a.p + 0.4 * b.p AS p,
  0.6 * a.cost + 0.4 * b.cost AS cost, a.bm, 0.6 * a.ar + 0.4 * b.ar AS ar FROM a_tp a JOIN b_tp b USING (label_name, h, t) WHERE a.instrument_id = 'click' AND b.instrument_id = 'click'),
{wealth_sql('bl')}"""


@query(
    "blend_sleeves",
    final(
        _BLEND, "pf", d="portfolio_return=pr; gross_portfolio_return=g; position=p; transaction_cost=cost; benchmark_return=bm; wealth=w; drawdown=dd; active_wealth=aw",
        i="horizon_bars=h; long_count=(p > 0)::INT; short_count=(p < 0)::INT", o="factor_name='strategy_ensemble'; label_name; timestamp=t; exit_time",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    ds = dataset(spark, sf, "calm_type", (2,))
    books = {}
    for name, factor in (("a", MOM), ("b", SPREAD)):
        book = pf.threshold_portfolio(
            ds.where(F.col("instrument_id") == "click"), factor, start=START, timeframe="4h", cost_bps=10.0,
            signal_multiplier=-1.0, smoothing=2, position_size=0.5, long_threshold=0.01, short_threshold=0.01,
        )
        books[name] = materialize(book)
    return pf.blend(books, {"a": 0.6, "b": 0.4}).select(
        "factor_name", "label_name", "horizon_bars", "timestamp", "exit_time", "portfolio_return",
        "gross_portfolio_return", "position", "transaction_cost", "benchmark_return", "wealth", "drawdown",
        "active_wealth", "long_count", "short_count",
    )
