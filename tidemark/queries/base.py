"""Query registry, input panels, and the SQL fragments of the matching checks.

Two panels come from the event table: ``user`` (one instrument per user, daily bars: a wide market
with gaps) and ``type`` (one instrument per event type, 4h bars: few dense series).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rolling import slots_between
from tidemark.functions.scalars import tidy
from tidemark.operators.grid import bars_from_ticks
from tidemark.session import ship_package

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query; its result is rounded and its integers widened."""

    def wrap(fn: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return tidy(fn(spark, sf_dir))

        REGISTRY[name] = Query(name, run, sql)
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@dataclass(frozen=True)
class Panel:
    by: str
    minutes: int
    bar: str
    step: str
    lift: float = 0.0


PANELS = {
    "user": Panel("user_id", 1440, "1d", "1 day"),
    "type": Panel("event_type", 240, "4h", "4 hours"),
    "hour": Panel("event_type", 60, "1h", "1 hour"),
    # Prices lifted by a constant: moves of a few percent, so wealth paths keep a sane scale.
    "calm_user": Panel("user_id", 1440, "1d", "1 day", 1000.0),
    "calm_type": Panel("event_type", 240, "4h", "4 hours", 1000.0),
}
KEYS = ["venue", "instrument_id", "bar_type"]


def ticks(spark: SparkSession, sf: str, panel: str = "user") -> DataFrame:
    """Events as trades of size 1; a value of 0 is a trade too."""
    p = PANELS[panel]
    return table(spark, sf, "events").select(
        F.lit("SIM").alias("venue"),
        F.col(p.by).cast("string").alias("instrument_id"),
        F.lit(p.bar).alias("bar_type"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("trade_id"),
        (F.col("value") + p.lift).alias("price"),
        F.lit(1.0).alias("size"),
        F.col("value").alias("quote"),
    )


def bars(spark: SparkSession, sf: str, panel: str = "user") -> DataFrame:
    return bars_from_ticks(ticks(spark, sf, panel), PANELS[panel].minutes, KEYS)


def series_rows(spark: SparkSession, sf: str, panel: str = "user") -> int:
    """Bound on bars per instrument: the slots between the first and last event."""
    return slots_between(table(spark, sf, "events"), "ts", PANELS[panel].minutes)


# -- SQL -----------------------------------------------------------------------------------
def bars_sql(panel: str = "user") -> str:
    p = PANELS[panel]
    return f"""ticks AS (
  SELECT 'SIM' AS venue, CAST({p.by} AS VARCHAR) AS instrument_id, '{p.bar}' AS bar_type,
         ts, event_id, value + {p.lift} AS price, value AS quote
  FROM events),
bars AS (
  SELECT venue, instrument_id, bar_type, time_bucket(INTERVAL '{p.step}', ts) AS t,
         first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, event_id) AS close,
         CAST(count(*) AS DOUBLE) AS volume, sum(quote) AS volume_quote
  FROM ticks GROUP BY ALL)"""


def staged(source: str, stages: Sequence[dict[str, str]], prefix: str = "s") -> str:
    """CTEs that add columns in stages: later stages may use window results of earlier ones."""
    out, last = [], source
    for i, stage in enumerate(stages):
        name = f"{prefix}{i}"
        cols = ", ".join(f"{e} AS {n}" for n, e in stage.items())
        out.append(f"{name} AS (SELECT *, {cols} FROM {last})")
        last = name
    return ",\n".join(out)


def over(n: int | None = None, part: str = "instrument_id", end: str = "CURRENT ROW") -> str:
    base = f"PARTITION BY {part} ORDER BY t"
    if n is None:
        return f"OVER ({base})"
    return f"OVER ({base} ROWS BETWEEN {n - 1} PRECEDING AND {end})"


def lag(x: str, n: int = 1, part: str = "instrument_id") -> str:
    return f"lag({x}, {n}) {over(None, part)}"


def roll(agg: str, x: str, n: int, m: int | None = None, part: str = "instrument_id") -> str:
    w = over(n, part)
    return f"(CASE WHEN count({x}) {w} >= {n if m is None else m} THEN {agg}({x}) {w} END)"


def ewm(x: str, alpha: str, m: int = 1, part: str = "instrument_id") -> str:
    """Recursive mean of a column whose nulls only lead."""
    w = f"OVER (PARTITION BY {part} ORDER BY t ROWS UNBOUNDED PRECEDING)"
    fold = (
        f"list_reduce(list(CAST({x} AS DOUBLE)) FILTER (WHERE {x} IS NOT NULL) {w}, "
        f"lambda a, b: (1 - {alpha}) * a + {alpha} * b)"
    )
    return f"(CASE WHEN {x} IS NOT NULL AND count({x}) {w} >= {m} THEN {fold} END)"


def final(
    ctes: str, source: str, d: str = "", i: str = "", o: str = "", where: str = "", digits: int = 6
) -> str:
    """Select with doubles rounded, integers widened and other columns as they are.

    Items are names or ``name=expression`` separated by ``;`` or, for plain names, by spaces.
    """

    def items(text: str) -> list[tuple[str, str]]:
        parts = text.split(";") if (";" in text or "=" in text) else text.split()
        got = []
        for part in filter(None, (p.strip() for p in parts)):
            name, _, expr = part.partition("=")
            got.append((name.strip(), (expr or name).strip()))
        return got

    cols = [f'round(CAST({e} AS DOUBLE), {digits}) + 0.0 AS "{n}"' for n, e in items(d)]
    cols += [f'CAST({e} AS BIGINT) AS "{n}"' for n, e in items(i)]
    cols += [f'{e} AS "{n}"' for n, e in items(o)]
    with_ = f"WITH {ctes}\n" if ctes else ""
    tail = f" WHERE {where}" if where else ""
    return f"{with_}SELECT {', '.join(cols)} FROM {source}{tail}"
