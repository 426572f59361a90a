"""Trading signals: crossings, extrema, gates and held targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rolling import Series
from tidemark.functions.scalars import col, ratio
from tidemark.operators.indicators import Build, span_alpha


def cross(s: Series, x: str | Column, level: float = 0.0, mask: Column | None = None) -> Column:
    """+1 where ``x`` rises through ``level``, -1 where it falls through ``-level``, else 0."""
    x = s.add(x)
    before = s.lag(x)
    buy, sell = (before <= level) & (x > level), (before >= -level) & (x < -level)
    if mask is not None:
        buy, sell = buy & mask, sell & mask
    return s.add(F.when(buy, 1).when(sell, -1).otherwise(0))


def cross_signal(mask: Column | None = None, out: str = "signal") -> Build:
    return lambda s: {out: cross(s, "spread", 0.0, mask)}


def threshold_cross(level: float, out: str = "signal") -> Build:
    """A crossing confirmed by the relative spread passing a level."""
    return lambda s: {out: cross(s, "spread_pct", level)}


def gated(signal: Column, mask: Column) -> Column:
    return F.when(mask, signal).otherwise(0)


def slope_cross(level: float, out: str = "signal") -> Build:
    """Crossings in the direction of the slow average."""

    def build(s: Series) -> dict[str, Column]:
        raw, slope = cross(s, "spread"), F.col("ma_slope")
        ok = ((raw > 0) & (slope > level)) | ((raw < 0) & (slope < -level))
        return {out: F.when(ok, raw).otherwise(0)}

    return build


def filter_set() -> Build:
    """The fixed set of plain and filtered crossings, one column each."""

    def build(s: Series) -> dict[str, Column]:
        confirmed = cross(s, "spread_pct", 0.0035)
        loud = F.col("volume") >= F.col("volume_ma") * 1.2
        return {
            "baseline": cross(s, "spread"),
            "spread_030": cross(s, "spread_pct", 0.003),
            "spread_035": confirmed,
            "spread_035_atr": gated(confirmed, F.col("atr_pct") >= 0.005),
            "spread_040_adx20": gated(cross(s, "spread_pct", 0.004), F.col("adx14") >= 20),
            "volume_12x": cross(s, "spread", 0.0, loud),
        }

    return build


def ema_cross(fast: int = 10, slow: int = 30, out: str = "signal") -> Build:
    """Side of the fast mean, emitted when it changes (and on the first bar)."""

    def build(s: Series) -> dict[str, Column]:
        a = s.ewm("close", span_alpha(fast), gapless=True)
        b = s.ewm("close", span_alpha(slow), gapless=True)
        side = s.add(F.when(a > b, 1).otherwise(-1))
        same = s.lag(side) == side
        return {out: F.when(F.coalesce(same, F.lit(False)), 0).otherwise(side)}

    return build


def hold(s: Series, events: Column) -> Column:
    """Last event up to now, 0 before the first; null means no event."""
    return s.add(F.coalesce(s.fill(events), F.lit(0)))


def held_target(signal: str = "signal", out: str = "target") -> Build:
    return lambda s: {out: hold(s, s.add(F.nullif(F.col(signal), F.lit(0))))}


def adaptive_target(spread: float, percentile: float, efficiency: float) -> Build:
    """Crossings of the spread in ATR units, accepted only in an active and directed market."""

    def build(s: Series) -> dict[str, Column]:
        regime = (F.col("atr_percentile") >= percentile) & (F.col("efficiency_ratio") >= efficiency)
        scaled = s.add(ratio("spread", "atr14"))
        events = cross(s, scaled, spread, regime)
        return {"target": hold(s, s.add(F.nullif(events, F.lit(0))))}

    return build


def _extrema(s: Series, column: str, sign_rule: bool) -> tuple[Column, Column]:
    x, mid, old = F.col(column), s.lag(column, 1), s.lag(column, 2)
    peak, trough = (mid > old) & (mid > x), (mid < old) & (mid < x)
    if sign_rule:
        peak, trough = peak & (mid > 0), trough & (mid < 0)
    return peak, trough


def extrema_fade(column: str = "dif", sign_rule: bool = False, out: str = "target") -> Build:
    """Short after a confirmed peak, long after a confirmed trough, held until the opposite."""

    def build(s: Series) -> dict[str, Column]:
        peak, trough = _extrema(s, column, sign_rule)
        return {out: hold(s, s.add(F.when(peak, -1).when(trough, 1)))}

    return build


def extrema_follow(column: str = "macd", sign_rule: bool = False, out: str = "target") -> Build:
    """The inverted rule without holding: 0 on every bar that confirms nothing."""

    def build(s: Series) -> dict[str, Column]:
        peak, trough = _extrema(s, column, sign_rule)
        return {out: F.when(peak, 1).when(trough, -1).otherwise(0)}

    return build


def extrema_entry(allowed: Column, column: str = "macd", out: str = "target") -> Build:
    """Leave at every extremum; enter the opposite side only where the condition allows."""

    def build(s: Series) -> dict[str, Column]:
        peak, trough = _extrema(s, column, False)
        ok = F.coalesce(allowed, F.lit(False))
        event = F.when(peak, F.when(ok, -1).otherwise(0)).when(trough, F.when(ok, 1).otherwise(0))
        return {out: hold(s, s.add(event))}

    return build


# Thresholds of the entry-condition grid.
ATR_PERCENTILES = [0.10, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60, 0.70, 0.75, 0.80, 0.90]
MACD_STRENGTHS = [0.25, 0.50, 0.75, 1.00, 1.50, 2.00]
ATR_EXPANSIONS = [0.90, 1.00, 1.10, 1.25]


def entry_conditions() -> Build:
    """Named condition columns: ATR percentile, MACD in ATR units, ATR expansion, combinations."""

    def build(s: Series) -> dict[str, Column]:
        pct, grow = F.col("atr_percentile"), F.col("atr_expansion")
        strength = s.add(ratio(F.abs(s.lag("macd")), s.lag("atr14")))
        out: dict[str, Column] = {"baseline_no_atr": F.lit(True)}
        for t in ATR_PERCENTILES:
            out[f"atr_percentile_ge_{int(t * 100)}"] = pct >= t
            out[f"atr_percentile_le_{int(t * 100)}"] = pct <= t
        for t in MACD_STRENGTHS:
            out[f"macd_atr_ge_{t:.2f}"] = strength >= t
        for t in ATR_EXPANSIONS:
            out[f"atr_expansion_ge_{t:.2f}"] = grow >= t
        for t in (0.50, 1.00):
            for p in (0.50, 0.75):
                name = f"macd_atr_ge_{t:.2f}_and_atr_percentile_ge_{int(p * 100)}"
                out[name] = (strength >= t) & (pct >= p)
        return {n: F.coalesce(c, F.lit(False)) for n, c in out.items()}

    return build


def variants_tall(df: DataFrame, columns: Sequence[str], value: str, name: str = "variant"):
    """One row per bar and variant, so later steps treat the variant as a key."""
    items = [F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in columns]
    keep = [c for c in df.columns if c not in columns]
    return df.select(*[f"`{c}`" for c in keep], F.inline(F.array(*items)))


def direction_consensus(fast: int, slow: int, target: str = "target", out: str = "target") -> Build:
    """Keep a position only where price lies on its side of both averages."""

    def build(s: Series) -> dict[str, Column]:
        a, b, c = s.mean("close", fast), s.mean("close", slow), F.col("close")
        t = F.col(target)
        ok = ((t > 0) & (c > a) & (c > b)) | ((t < 0) & (c < a) & (c < b))
        return {out: F.when(F.coalesce(ok, F.lit(False)), t).otherwise(0)}

    return build


def volume_gate(
    family: str, direction: str | Column, threshold: float = 0.0, flow_threshold: float = 0.0
) -> Column:
    """Does the volume rule allow an entry in this direction?"""
    flow = col(direction) * F.col("volume_flow") >= flow_threshold
    loud = F.col("relative_volume") >= threshold
    tests = {
        "baseline": F.lit(True),
        "relative_volume": loud,
        "volume_percentile": F.col("volume_percentile") >= threshold,
        "directional_flow": flow,
        "relative_and_flow": loud & flow,
    }
    if family not in tests:
        raise ValueError(f"unknown volume rule: {family}")
    return F.coalesce(tests[family], F.lit(False))


def one_sided(target: str | Column, side: str) -> Column:
    """Clip a target to long only or short only."""
    return F.greatest(col(target), F.lit(0)) if side == "long" else F.least(col(target), F.lit(0))


def scale_in(
    levels: Sequence[float], fractions: Sequence[float], atr_minimum: float = 0.005
) -> Build:
    """Exposure that only grows with the spread until the next accepted reversal.

    From one accepted crossing to the next, the fraction is the running maximum of the
    levels passed. Rows without a spread or ATR keep the exposure and break the crossing test.
    """

    def build(s: Series) -> dict[str, Column]:
        spread, atr, entry = F.col("spread_pct"), F.col("atr_pct"), float(levels[0])
        ready = spread.isNotNull() & atr.isNotNull()
        before = s.lag("spread_pct")
        strong = ready & (atr >= atr_minimum)
        up, down = strong & (before <= entry) & (spread > entry), strong & (before >= -entry) & (
            spread < -entry
        )
        event = s.add(F.when(up, 1).when(down, -1))
        side = hold(s, event)
        reached = F.lit(0.0)
        for level, share in zip(levels, fractions, strict=True):
            passed = ready & (side * spread > level)
            reached = F.greatest(reached, F.when(passed, F.lit(float(share))).otherwise(0.0))
        now = s.add(F.when(event.isNotNull(), F.lit(float(fractions[0]))).otherwise(reached))
        return {"target": side * s.cummax_since(now, event.isNotNull())}

    return build
