"""Per-series windows: lags, rolling moments, exponential means, forward fill.

A series is one instrument's rows in time order. ``Series`` collects window columns in stages, so
that many factors over one panel share a single shuffle and sort, and each stage is one projection.

Rolling moments over more than ``FRAME_ROWS`` rows are put together from two running aggregates: Spark
recomputes a sliding frame for every row, which costs rows x window. Rows fall into blocks as long as
the window, so that a window is the tail of one block and the head of the next. Only rows inside the
window take part: a later row, or a NaN outside it, changes nothing.

Every staged column knows how many rows it reaches back and ahead; ``over_series`` cuts long series by
that reach. What depends on all rows before (running sums, products and extremes, the last value, exponential
means) is a *scan*: each run of a cut series yields one row, its map from the state before it to the state after
it; the maps of a series are composed in order, and every run goes on from the state it is handed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.groups import TASK_ROWS, fits, tie_range
from tidemark.functions.scalars import ratio
from tidemark.session import materialize

FRAME_ROWS = 64
UNBOUNDED = 1 << 60
_TINY = 1e-16
_TEMP = re.compile(r"_t\d+")
_RUN, _OWN, _AT = "_run", "_own", "_at"
# Decay (as a logarithm) of a block of an affine scan: terms are scaled by at most its exponential.
_DECAY = 13.8


class Series:
    """Window columns over ``keys`` ordered by ``order``; every result is a named column."""

    def __init__(
        self, df: DataFrame, keys: Sequence[str], order: Sequence[str], cut: tuple[int, int] | None = None
    ) -> None:
        """``cut`` names the rows of a run and the rows it copies from before it, for the runs of a cut series."""
        self.df, self._cut = df, cut
        self.keys, self.order = list(keys), list(order)
        self.part = Window.partitionBy(*self.keys)
        self.window = self.part.orderBy(*self.order)
        self.running = self.window.rowsBetween(Window.unboundedPreceding, 0)
        self._stages: list[dict[str, Column]] = []
        self._level: dict[str, int] = {}
        self._seen: dict[str, str] = {}
        self._back: dict[str, int] = {}
        self._ahead: dict[str, int] = {}
        # Rows that a window itself copies from before; a scan reaches back further than it copies.
        self._span: dict[str, int] = {}
        # Scans: how the states of runs are put together, the rows their inputs copy, names of their own columns.
        self._scans: dict[str, tuple[str, int, dict[str, str]]] = {}

    # -- staging ---------------------------------------------------------------------------
    def add(
        self, expr: str | Column, back: int | None = None, ahead: int = 0, span: int | None = None
    ) -> Column:
        """Stage an expression after the columns it mentions and return a reference to it.

        ``back`` and ``ahead`` are the rows its own window reaches, ``span`` those of ``back`` that a run of a cut
        series has to hold (default: all). A window of which nothing is said may reach the whole series.
        """
        if isinstance(expr, str):
            return F.col(expr)
        text = str(expr)
        if back is None:
            back = UNBOUNDED if " OVER (" in text else 0
        if text in self._seen:
            return F.col(self._seen[text])
        name = f"_t{len(self._seen)}"
        parts = [t for t in _TEMP.findall(text) if t in self._level]
        level = 1 + max((self._level[t] for t in parts), default=-1)
        while len(self._stages) <= level:
            self._stages.append({})
        self._stages[level][name] = expr
        self._level[name] = level
        self._seen[text] = name
        self._back[name] = min(UNBOUNDED, back + max((self._back[t] for t in parts), default=0))
        self._ahead[name] = min(UNBOUNDED, ahead + max((self._ahead[t] for t in parts), default=0))
        own = back if span is None else span
        self._span[name] = min(UNBOUNDED, own + max((self._span[t] for t in parts), default=0))
        return F.col(name)

    def reach(self) -> tuple[int, int]:
        """Rows that any staged column reaches back and ahead."""
        return max(self._back.values(), default=0), max(self._ahead.values(), default=0)

    def span(self) -> int:
        """Rows before it that a run of a cut series has to hold."""
        return max(self._span.values(), default=0)

    def build(self, outputs: dict[str, Column], keep: Sequence[str] | None = None) -> DataFrame:
        """Apply the staged columns and return ``keep`` (default: all input columns) + outputs."""
        df = self.df
        keep = list(df.columns if keep is None else keep)
        for stage in self._stages:
            df = df.withColumns(stage)
            scans = [n for n in stage if n in self._scans]
            if scans and self._cut is not None:
                df = self._handed_on(df, scans)
        keep = [c for c in keep if c not in outputs]
        return df.select(*keep, *[c.alias(n) for n, c in outputs.items()])

    def _live(self, *inputs: Column) -> tuple[int, Column]:
        """Rows that the inputs of a scan copy, and the rows of a run from which on they are right."""
        span = max(self._span.get(_name(x) or "", 0) for x in inputs)
        if self._cut is None:
            return span, F.lit(True)
        return span, F.col(_AT) > F.col(_RUN) * self._cut[0] - (self._cut[1] - span)

    def _scan(self, expr: Column, kind: str, span: int, back: int = UNBOUNDED, **own: str) -> Column:
        """Stage a window over all rows up to the current one, which a cut series puts together over runs."""
        out = self.add(expr, back=back, span=0)
        self._scans[_name(out)] = (kind, span, own)
        return out

    def _running(self, make: Callable[[Column], Column], x: str | Column, kind: str, back: int = UNBOUNDED) -> Column:
        x = self.add(x)
        span, live = self._live(x)
        return self._scan(make(x if self._cut is None else F.when(live, x)).over(self.running), kind, span, back)

    def _handed_on(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        """Scans of a cut series: each run goes on from the state that the runs before it reach.

        A scan begins at the first row of a run where its inputs are right. The row before that is the last one of
        the run before which it does not see, and that run's scan up to there is the map handed on: one row per run.
        """
        df = materialize(df)  # read twice
        for span in sorted({self._scans[n][1] for n in names}):
            df = self._handed(df, [n for n in names if self._scans[n][1] == span], span)
        return df

    def _handed(self, df: DataFrame, names: Sequence[str], span: int) -> DataFrame:
        task_rows, copied = self._cut
        series = [k for k in self.keys if k != _RUN]
        upto = Window.partitionBy(*series).orderBy(_RUN).rowsBetween(Window.unboundedPreceding, 0)
        ends = df.where(F.col(_AT) == (F.col(_RUN) + 1) * task_rows - (copied - span))
        states, fixed = [], {}
        for n in names:
            kind, _, own = self._scans[n]
            value, before = F.col(n), F.col(f"{n}_in")
            if kind in ("sum", "product"):
                whole = (F.sum if kind == "sum" else F.product)(value).over(upto)
                both = before + value if kind == "sum" else before * value
                fixed[n] = F.when(before.isNull(), value).when(value.isNull(), before).otherwise(both)
            elif kind == "max":
                whole, fixed[n] = F.max(value).over(upto), F.greatest(before, value)
            elif kind == "last":
                whole, fixed[n] = F.last(value, ignorenulls=True).over(upto), F.coalesce(value, before)
            elif kind == "affine":
                decay = F.exp(-F.col(own["decay"]))
                maps = F.collect_list(F.struct(decay.alias("a"), value.alias("b"))).over(upto)
                whole = F.aggregate(maps, F.lit(0.0), lambda acc, it: it["a"] * acc + it["b"])
                fixed[n] = F.when(before.isNull(), value).otherwise(value + decay * before)
            else:  # the maximum since the last reset
                fresh = F.col(own["resets"]) > 0
                maps = F.collect_list(F.struct(fresh.alias("a"), value.alias("b"))).over(upto)
                whole = F.aggregate(
                    maps, F.lit(None).cast("double"),
                    lambda acc, it: F.when(it["a"], it["b"]).otherwise(F.greatest(acc, it["b"])),
                )
                fixed[n] = F.when(fresh, value).otherwise(F.greatest(before, value))
            states.append(whole.alias(f"{n}_in"))
        ends = ends.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(series)], (F.col(_RUN) + 1).alias("_next"), *states
        )
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(series)]
        both = df.join(ends, [*on, F.col(_RUN) == F.col("_next")], "left").withColumns(fixed)
        return both.drop("_next", *[f"_k{i}" for i in range(len(series))], *[f"{n}_in" for n in names])

    def frame(self, n: int):
        return self.window.rowsBetween(-(n - 1), 0)

    # -- offsets ---------------------------------------------------------------------------
    def lag(self, x: str | Column, n: int = 1) -> Column:
        return self.add(F.lag(self.add(x), n).over(self.window), back=n)

    def lead(self, x: str | Column, n: int = 1) -> Column:
        return self.add(F.lead(self.add(x), n).over(self.window), back=0, ahead=n)

    def diff(self, x: str | Column, n: int = 1) -> Column:
        x = self.add(x)
        return self.add(x - self.lag(x, n))

    def fill(self, x: str | Column) -> Column:
        """Last non-null value up to the current row, however far back; null where there is none."""
        return self._running(lambda v: F.last(v, ignorenulls=True), x, "last", back=0)

    def position(self) -> Column:
        """Number of the row in its series, from 1."""
        if self._cut is not None:
            return self.add(F.when(F.lit(True), F.col(_AT).cast("int")))
        return self.add(F.row_number().over(self.window), back=0)

    # -- rolling ---------------------------------------------------------------------------
    def _part(self, x: Column, n: int, kind: str) -> tuple[Column, Column]:
        """An aggregate over the head and the tail of a window of ``n`` rows.

        The head is the current block up to this row, the tail the rest of the window in the block
        before (null for the last row of a block, whose head is the whole window).
        """
        at = self.add(F.row_number().over(self.window) - 1, back=0)
        block = self.add(F.floor(at / n))
        inside = Window.partitionBy(*self.keys, block)
        whole = (Window.unboundedPreceding, 0)
        make = {"sum": F.sum, "count": F.count, "avg": F.avg, "var": F.var_pop}[kind]
        head = self.add(make(x).over(inside.orderBy(*self.order).rowsBetween(*whole)), back=0)
        down = inside.orderBy(*[F.col(c).desc() for c in self.order]).rowsBetween(*whole)
        rest = self.add(make(x).over(down), back=0)
        tail = F.when(at % n != n - 1, F.lag(rest, n - 1).over(self.window))
        return head, self.add(tail, back=n - 1)

    def count(self, x: str | Column, n: int) -> Column:
        x = self.add(x)
        if n <= FRAME_ROWS:
            return self.add(F.count(x).over(self.frame(n)), back=n - 1)
        head, tail = self._part(x, n, "count")
        return self.add(head + F.coalesce(tail, F.lit(0)))

    def _enough(self, x: Column, n: int, m: int | None, value: Column) -> Column:
        return self.add(F.when(self.count(x, n) >= (n if m is None else m), value))

    def sum(self, x: str | Column, n: int, m: int | None = None) -> Column:
        x = self.add(x)
        if n <= FRAME_ROWS:
            value = self.add(F.sum(x).over(self.frame(n)), back=n - 1)
        else:
            head, tail = self._part(x, n, "sum")
            value = self.add(F.when(head.isNull(), tail).when(tail.isNull(), head).otherwise(head + tail))
        return self._enough(x, n, m, value)

    def _moments(self, x: Column, n: int) -> tuple[Column, Column, Column]:
        """Count, mean and summed squared deviations of a long window, joined from its two parts."""
        k1, k2 = (F.coalesce(k, F.lit(0)) for k in self._part(x, n, "count"))
        m1, m2 = self._part(x, n, "avg")
        v1, v2 = self._part(x, n, "var")
        k = self.add(k1 + k2)
        gap = m2 - m1
        mean = F.when(k1 == 0, m2).when(k2 == 0, m1).otherwise(m1 + gap * (k2 / k))
        both = v1 * k1 + v2 * k2 + gap * gap * (k1 * k2 / k)
        spread = F.when(k1 == 0, v2 * k2).when(k2 == 0, v1 * k1).otherwise(both)
        return k, self.add(F.when(k > 0, mean)), self.add(F.when(k > 0, spread))

    def mean(self, x: str | Column, n: int, m: int | None = None) -> Column:
        x = self.add(x)
        if n <= FRAME_ROWS:
            return self._enough(x, n, m, self.add(F.avg(x).over(self.frame(n)), back=n - 1))
        return self._enough(x, n, m, self._moments(x, n)[1])

    def std(self, x: str | Column, n: int, m: int | None = None) -> Column:
        """Sample standard deviation of the last ``n`` rows; exactly 0 on constant input."""
        x = self.add(x)
        if n <= FRAME_ROWS:
            return self._enough(x, n, m, self.add(F.stddev_samp(x).over(self.frame(n)), back=n - 1))
        k, mean, spread = self._moments(x, n)
        # What rounding of equal values leaves, measured by the window's own size.
        flat = ~F.isnan(spread) & (spread <= F.lit(1e-28) * k * mean * mean)
        spread = F.when(flat, F.lit(0.0)).otherwise(spread)
        return self._enough(x, n, m, F.when(k > 1, F.sqrt(spread / (k - 1))))

    def min(self, x: str | Column, n: int, m: int | None = None) -> Column:
        x = self.add(x)
        return self._enough(x, n, m, self.add(F.min(x).over(self.frame(n)), back=n - 1))

    def max(self, x: str | Column, n: int, m: int | None = None) -> Column:
        x = self.add(x)
        return self._enough(x, n, m, self.add(F.max(x).over(self.frame(n)), back=n - 1))

    def values(self, x: str | Column, n: int) -> Column:
        """The non-null values of the last ``n`` rows, oldest first."""
        return self.add(F.collect_list(self.add(x)).over(self.frame(n)), back=n - 1)

    def median(self, x: str | Column, n: int, m: int | None = None) -> Column:
        x = self.add(x)
        return self._enough(x, n, m, self.add(F.percentile(x, 0.5).over(self.frame(n)), back=n - 1))

    def quantile_nearest(self, x: str | Column, n: int, q: float, m: int | None = None) -> Column:
        """The observation nearest to quantile ``q`` of the last ``n`` rows."""
        x = self.add(x)
        ordered = self.add(F.array_sort(self.values(x, n)))
        spot = F.round((F.size(ordered) - 1) * F.lit(float(q))).cast("int") + 1
        return self._enough(x, n, m, F.try_element_at(ordered, spot))

    def mad(self, x: str | Column, n: int, m: int | None = None) -> Column:
        """Median absolute deviation from the median of the last ``n`` rows."""
        x = self.add(x)
        centre = self.add(F.percentile(x, 0.5).over(self.frame(n)), back=n - 1)
        away = self.add(F.array_sort(F.transform(self.values(x, n), lambda v: F.abs(v - centre))))
        k = F.size(away)
        half = F.floor((k + 1) / 2).cast("int")
        upper = F.floor(k / 2).cast("int") + 1
        mid = (F.try_element_at(away, half) + F.try_element_at(away, upper)) / 2
        return self._enough(x, n, m, F.when(k > 0, mid))

    def rank_last(self, x: str | Column, n: int, m: int | None = None) -> Column:
        """Average rank of the current value among the last ``n`` rows."""
        x = self.add(x)
        seen = self.values(x, n)
        less = F.size(F.filter(seen, lambda v: v < x))
        same = F.size(F.filter(seen, lambda v: v == x))
        return self._enough(x, n, m, F.when(x.isNotNull(), less + (same + 1) / F.lit(2.0)))

    # -- exponential means -----------------------------------------------------------------
    def affine(self, a: str | Column, b: str | Column, back: int = UNBOUNDED) -> Column:
        """The recursion ``y = a * y + b`` from 0, with ``a`` in 0..1 and no nulls; linear in rows.

        A term weighs the exponential of the decay since; an ``a`` of 0 counts as 1e-300. Terms are summed in blocks
        of bounded decay, and four blocks back a weight is below 1e-17. After a NaN in ``b`` all values are NaN.
        """
        a, b = self.add(a), self.add(b)
        span, live = self._live(a, b)
        if self._cut is not None:
            a, b = self.add(F.when(live, a).otherwise(1.0)), self.add(F.when(live, b).otherwise(0.0))
        decay = self.add(F.sum(-F.ln(F.greatest(a, F.lit(1e-300)))).over(self.running), back=back, span=0)
        spoilt = self.add(F.max(F.isnan(b)).over(self.running), back=back, span=0)
        block = self.add(F.floor(decay / _DECAY))
        scaled = self.add(F.when(F.isnan(b), 0.0).otherwise(b) * F.exp(decay - block * _DECAY))
        inside = Window.partitionBy(*self.keys, block).orderBy(*self.order)
        # (Both windows are met by one sort.)
        blocks = self.part.orderBy(block)
        total = self.add(F.sum(scaled).over(inside.rowsBetween(Window.unboundedPreceding, 0)), back=0)
        value = total * F.exp(block * _DECAY - decay)
        for i in range(1, 4):
            one = self.add(F.sum(scaled).over(blocks.rangeBetween(-i, -i)), back=0)
            value = value + F.coalesce(one, F.lit(0.0)) * F.exp((block - i) * _DECAY - decay)
        value = F.when(spoilt, F.lit(float("nan"))).otherwise(value)
        return self._scan(value, "affine", span, back=0, decay=_name(decay))

    def ewm(
        self, x: str | Column, alpha: float, min_samples: int = 1, *, gapless: bool = False
    ) -> Column:
        """Recursive exponential mean ``y = (1-a) y + a x`` started at the first value.

        A gap of g rows decays the old mean to weight (1-a)^g before renormalizing; a null input gives a null
        output; after a NaN all values are NaN. ``gapless`` promises that nulls only lead.
        """
        x, keep, rows = self.add(x), 1.0 - alpha, fold_rows(alpha)
        if gapless:
            before, weight = self.lag(x), F.lit(keep)
        else:
            at = self.position()
            before = self.lag(self.fill(F.when(x.isNotNull(), at)))
            weight = F.pow(F.lit(keep), (at - before).cast("double"))
        # The first value is taken whole: there is nothing before it.
        held = x.isNull() | before.isNull()
        a = F.when(held, 1.0).otherwise(weight / (weight + alpha))
        b = F.when(x.isNull(), 0.0).when(before.isNull(), x).otherwise(x * alpha / (weight + alpha))
        y = self.affine(a, b, back=rows - 1) if alpha < 1 else x
        return self.add(F.when(x.isNotNull() & (self.seen(x) >= min_samples), y))

    def seen(self, x: str | Column) -> Column:
        """Number of values up to the current row."""
        return self._running(F.count, x, "sum", back=0)

    def running_mean(self, x: str | Column) -> Column:
        """Mean of the values up to the current row."""
        x = self.add(x)
        total = self._running(F.sum, x, "sum", back=0)
        return self.add(F.try_divide(total, self.seen(x)))

    def ewm_adjusted(self, x: str | Column, alpha: float, min_samples: int = 1) -> Column:
        """Weighted mean with weights (1-a)^age over the rows seen (``adjust=True``)."""
        x, keep, back = self.add(x), F.lit(1.0 - alpha), fold_rows(alpha) - 1
        n = self.affine(keep, F.coalesce(x, F.lit(0.0)), back=back)
        d = self.affine(keep, F.when(x.isNull(), 0.0).otherwise(1.0), back=back)
        return self.add(F.when(x.isNotNull() & (self.seen(x) >= min_samples), F.try_divide(n, d)))

    # -- running ---------------------------------------------------------------------------
    def cumsum(self, x: str | Column) -> Column:
        return self._running(F.sum, x, "sum")

    def cumprod(self, x: str | Column) -> Column:
        return self._running(F.product, x, "product")

    def cummax(self, x: str | Column) -> Column:
        return self._running(F.max, x, "max")

    def cummax_since(self, x: str | Column, reset: Column) -> Column:
        """Maximum since the last row where ``reset`` holds, that row included."""
        x, reset = self.add(x), self.add(F.when(reset, 1).otherwise(0))
        span, live = self._live(x, reset)
        if self._cut is not None:
            x, reset = self.add(F.when(live, x)), self.add(F.when(live, reset).otherwise(0))
        resets = self.add(F.sum(reset).over(self.running), back=UNBOUNDED, span=0)
        since = Window.partitionBy(*self.keys, resets).orderBy(*self.order)
        peak = F.max(x).over(since.rowsBetween(Window.unboundedPreceding, 0))
        return self._scan(peak, "peak", span, back=0, resets=_name(resets))

    def zscore(self, x: str | Column, n: int, m: int | None = None) -> Column:
        x = self.add(x)
        mean, std = self.mean(x, n, m), self.std(x, n, m)
        return self.add(F.when(std > 0, ratio(x - mean, std)))


def _name(column: Column) -> str | None:
    """The name of a plain column reference."""
    found = re.fullmatch(r"Column<'(\w+)'>", str(column))
    return found[1] if found else None


def fold_rows(alpha: float) -> int:
    """Rows after which an exponential weight drops below 1e-16."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    return 2 if alpha == 1 else math.ceil(math.log(_TINY) / math.log(1 - alpha)) + 1


Make = Callable[["Series"], dict[str, Column]]


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    make: Make,
    keep: Sequence[str] | None = None,
    *,
    max_rows: int | None = None,
    task_rows: int | None = None,
) -> DataFrame:
    """The columns that ``make`` stages on a ``Series``, for series of any length.

    ``max_rows`` is the caller's bound on rows per series; bars in a time range have one by
    construction. Within ``task_rows`` the series stay whole. Longer ones are cut into runs of
    ``task_rows`` consecutive rows, each with a copy of the neighbouring rows that the staged windows
    reach; scans go on from the runs before. The copies are dropped afterwards. Order keys must be unique
    per series. Only a staged window of which nothing is said keeps a series whole.
    """
    keys, order = list(keys), list(order)
    task_rows = task_rows or TASK_ROWS
    whole = Series(df, keys, order)
    outputs = make(whole)
    span, lookahead = whole.span(), whole.reach()[1]
    if max(span, lookahead) >= UNBOUNDED or (max_rows is not None and max_rows <= task_rows):
        return whole.build(outputs, keep)
    bounded = fits(df, keys, task_rows)
    if bounded:
        return whole.build(outputs, keep)
    at = tie_range(df, keys, order, first=_AT, bounded=False, task_rows=task_rows).drop("_last", "_size")
    slot = F.col(_AT) - 1
    home = F.floor(slot / task_rows).cast("long")
    low = F.floor((slot - lookahead) / task_rows).cast("long")
    high = F.floor((slot + span) / task_rows).cast("long")
    runs = at.withColumn(_RUN, F.explode(F.sequence(F.greatest(low, F.lit(0)), high))).withColumn(
        _OWN, F.col(_RUN) == home
    )
    cut = Series(runs, [*keys, _RUN], order, cut=(task_rows, span))
    outputs = make(cut)
    kept = list(df.columns if keep is None else keep)
    out = cut.build(outputs, [*kept, _RUN, _OWN])
    return out.where(_OWN).drop(_RUN, _OWN)


def series_bound(df: DataFrame, keys: Sequence[str]) -> int | None:
    """A bound on rows per series that keeps series whole, where they are short enough (one counting job)."""
    return TASK_ROWS if fits(df, keys) else None


def slots_between(df: DataFrame, on: str, minutes: int) -> int:
    """Grid slots between the first and last time: a bound on bars per series (one small job)."""
    lo, hi = df.agg(F.min(on), F.max(on)).first()
    return 0 if lo is None else int((hi - lo).total_seconds() // (60 * minutes)) + 2


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Replace nulls by the last value seen in the series."""
    return over_series(df, keys, order, lambda s: {c: s.fill(c) for c in columns})
