"""Whole studies: from bars to factor tables, and from signals to portfolio tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import bar_minutes
from tidemark.operators import analytics, portfolio
from tidemark.operators.combine import CombinationRequest, combine
from tidemark.operators.factors import DEFAULT, FactorSpec, Registry, compute_factors, factor_rows
from tidemark.operators.labels import explode_labels
from tidemark.operators.processing import process
from tidemark.operators.universe import select_universe, snapshot_at
from tidemark.session import materialize


@dataclass(frozen=True)
class Study:
    """What to compute; ranges are half-open and in UTC."""

    factors: tuple[FactorSpec, ...]
    bar_type: str
    start: datetime
    end: datetime
    horizons: tuple[int, ...] = (1,)
    outlier: dict | None = None
    standard: dict | None = None
    exposures: tuple[str, ...] = ()
    quantiles: int = 5
    min_cross_section: int = 5
    method: str = "spearman"
    scope: str = "cross_sectional"
    params: dict = field(default_factory=dict)


def round_trip_cost(fee_bps: float, slippage_bps: float) -> float:
    """Both legs pay fee and slippage."""
    return 2 * (fee_bps + slippage_bps)


def resolve_universe(
    spark: SparkSession,
    *,
    venue: str = "OKX",
    instruments: Sequence[str] | None = None,
    snapshots: DataFrame | None = None,
    as_of: datetime | None = None,
    **rules,
) -> DataFrame:
    """A given list of instruments, or the selection from the snapshot before the start."""
    if instruments is not None:
        return spark.createDataFrame(
            [(venue, i) for i in dict.fromkeys(instruments)], "venue string, instrument_id string"
        )
    if snapshots is None or as_of is None:
        raise ValueError("give instruments, or snapshots with a time")
    chosen = select_universe(snapshot_at(snapshots, as_of), as_of, **rules)
    return chosen.select("venue", "instrument_id")


def build_research_dataset(
    bars: DataFrame,
    study: Study,
    *,
    universe: DataFrame | None = None,
    sources: Mapping[str, DataFrame] | None = None,
    registry: Registry = DEFAULT,
) -> DataFrame:
    """Processed factors with zero-cost labels, written once for the analyses that follow.

    Labels come out of the factors' own windows and ride along through the processing, so the whole
    build shuffles by instrument once and by cross-section once. Costs are charged on turnover later.
    """
    if universe is not None:
        bars = bars.join(universe, ["venue", "instrument_id"], "left_semi")
    raw = compute_factors(
        bars, study.factors, study.bar_type, start=study.start, end=study.end, sources=sources,
        exposures=study.exposures, registry=registry, horizons=study.horizons,
    )
    slots = int((study.end - study.start).total_seconds() // (60 * bar_minutes(study.bar_type))) + 1
    cleaned = process(
        factor_rows(raw),
        outlier=study.outlier,
        standard=study.standard,
        exposure_names=study.exposures,
        max_rows=slots,
    )
    return materialize(explode_labels(cleaned))


def factor_experiment(bars: DataFrame, study: Study, **kw) -> dict[str, DataFrame]:
    """All analysis tables of a set of factors."""
    dataset = build_research_dataset(bars, study, **kw)
    tables = analytics.report(
        dataset,
        [f.name for f in study.factors],
        method=study.method,
        min_cross_section=study.min_cross_section,
        quantiles=study.quantiles,
        scope=study.scope,
    )
    return {"dataset": dataset, **tables}


def strategy_experiment(
    bars: DataFrame,
    study: Study,
    request: CombinationRequest,
    *,
    cost_bps: float = 0.0,
    mode: str = "long_short",
    threshold: dict | None = None,
    **kw,
) -> dict[str, DataFrame]:
    """Combine factors into a signal, trade it, and account for it."""
    dataset = build_research_dataset(bars, study, **kw)
    combined = materialize(combine(dataset, request))
    common = {"start": study.start, "timeframe": study.bar_type, "cost_bps": cost_bps}
    if threshold is None:
        book = portfolio.quantile_portfolio(
            combined, request.name, quantiles=study.quantiles, mode=mode, **common
        )
    else:
        book = portfolio.threshold_portfolio(combined, request.name, **common, **threshold)
    book = materialize(book)
    out = {
        "dataset": combined,
        "portfolio_returns": book,
        "portfolio_metrics": portfolio.portfolio_metrics(book, study.bar_type),
        "portfolio_yearly": portfolio.yearly_metrics(book, study.bar_type),
        "ic_summary": analytics.ic_summary(
            analytics.ic_series(combined, study.method, study.min_cross_section)
        ),
    }
    if "position" in book.columns:
        trades = materialize(portfolio.trade_log(book, study.bar_type))
        monthly = portfolio.monthly_metrics(book, trades, study.bar_type)
        out |= {
            "trades": trades,
            "portfolio_monthly": monthly,
            "portfolio_monthly_summary": portfolio.monthly_summary(monthly, trades),
        }
    return out


def write_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """One Parquet directory per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def data_fingerprint(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One hash over per-partition statistics, independent of row order.

    Partition digests are folded lane by lane with xor, which combines map-side; nothing is gathered.
    """
    fields = [*keys, "min_time", "max_time", "rows"]
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    digests = stats.select(F.sha2(text, 256).alias("digest"))
    lanes = [
        F.bit_xor(F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("long")).cast("string")
        for i in range(4)
    ]
    count = F.count(F.lit(1))
    return digests.agg(
        F.sha2(F.concat_ws("|", count.cast("string"), *lanes), 256).alias("fingerprint"),
        count.alias("partitions"),
    )
