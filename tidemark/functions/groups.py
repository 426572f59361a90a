"""Order statistics inside groups of any size.

A cross-section (all instruments at one time) or a factor's whole history can hold a third of all
rows, so a plain ``Window.partitionBy(group)`` would put them into one task. Here a group above
``TASK_ROWS`` is cut into ordered slices first:

1. one counting aggregate finds the hot groups;
2. for those only, a deterministic sample of rows (those of one hash class)
   yields cut points, one per ``TASK_ROWS`` rows, so a value many rows share becomes a cut point;
3. rows get their slice number by search in a tree of the cut points. Rows *equal* to a cut point get
   a slice of their own, whose ranks follow from its count alone, so they may be spread over tasks;
4. slice counts give each slice its starting position, and ranks inside a slice use a window.

The broadcast tables hold at most ``rows / TASK_ROWS`` entries, whatever the distribution. The input is
written out first and rows are hashed by their place in the files, so equal rows differ and a
recomputed task agrees with the others.

Every function takes ``bounded``: True when the caller knows that no group exceeds ``TASK_ROWS`` (a
requested list of instruments, a check made once for a whole pipeline), False for the sliced way,
None to check here with one counting job over the key columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

TASK_ROWS = 1_000_000
_SAMPLES_PER_SLICE = 16
_FAN = 255  # cut points in a list; one less than a power of 2


def fits(df: DataFrame, keys: Sequence[str], task_rows: int | None = None) -> bool:
    """Does every group fit into one task? One counting job; only its maximum reaches the driver."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    return largest <= (task_rows or TASK_ROWS)


def _search(
    df: DataFrame, keys: Sequence[str], cuts: DataFrame, probe: Column, most: int, out: str, tie: str
) -> DataFrame:
    """Add ``out``: how many cut points of the row's group are at or below ``probe``; ``tie``: is one equal to it?

    ``cuts`` has, per hot group, the ascending list ``_cuts`` of ``most`` entries at most; its other columns are
    added too. Lists longer than ``_FAN`` are searched as a tree: lists of ``_FAN`` cut points, above them lists of
    the first ones of these, and so on. A level is one join, and in a list one plain column per halving: they
    compile, where a lambda over a fixed number of steps is interpreted for every row. The optimizer follows keys
    of later joins down by putting columns into each other, up to the join below, and a halving doubles what it
    builds; so ``_FAN`` bounds the halvings between two joins, not the number of cut points.
    """
    steps = [1]
    while steps[0] * _FAN < most:
        steps.insert(0, steps[0] * _FAN)
    lists, on = cuts.withColumnRenamed("_cuts", "_list"), keys
    for step in steps:
        if len(steps) > 1:
            lists = materialize(_lists(cuts, step))
        if step < steps[0]:
            lists, on = lists.select(*keys, "_node", "_list"), [*keys, "_node"]
        else:
            lists, df = lists.drop("_node"), df.withColumn("_node", F.lit(0))
        df = df.join(F.broadcast(lists), on, "left").withColumn("_hits", F.lit(0))
        for power in reversed(range(min(most, _FAN).bit_length())):
            # (Null past the end of the list, and without one.)
            inside = F.try_element_at("_list", F.col("_hits") + (1 << power)) <= probe
            df = df.withColumn("_hits", F.col("_hits") + F.when(inside, 1 << power).otherwise(0))
        equal = F.try_element_at("_list", F.greatest("_hits", F.lit(1))) == probe
        # The last entry at or below the probe begins the next list; negative if there is none.
        last = F.col("_node") * _FAN + F.col("_hits") - 1
        df = df.withColumns({"_node": last, tie: F.coalesce(equal, F.lit(False))}).drop("_list", "_hits")
    return df.withColumn(out, F.greatest(F.col("_node") + 1, F.lit(0))).drop("_node")


def _lists(cuts: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th cut point, in lists of ``_FAN`` numbered by ``_node``."""
    size, width = F.size("_cuts"), step * _FAN
    lists = F.transform(
        F.sequence(F.lit(0), size - 1, F.lit(width)),
        lambda i: F.transform(
            F.sequence(i, F.least(i + width, size) - 1, F.lit(step)), lambda j: F.get("_cuts", j)
        ),
    )
    return cuts.select("*", F.posexplode(lists).alias("_node", "_list")).drop("_cuts")


def slice_hot(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], task_rows: int | None = None
) -> DataFrame:
    """Add ``_slice`` (0 for ordinary groups, order-preserving otherwise), ``_tie`` and ``_salt``.

    The rows come from a table written for this purpose, see the module notes.
    """
    keys, order = list(keys), list(order)
    task_rows = task_rows or TASK_ROWS
    place = F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    df = materialize(df).withColumn("_row", place)
    parts = F.ceil(F.col("_rows") / F.lit(task_rows)).cast("int")
    # One row in so many is sampled.
    every = F.greatest(F.lit(1), F.floor(F.col("_rows") / (parts * _SAMPLES_PER_SLICE))).cast("long")
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > task_rows)
        .select(*keys, parts.alias("_parts"), every.alias("_every"))
    )
    probe = F.struct(*[F.col(c) for c in order])
    # (A filter, not an aggregate per hash class: that one sorts the whole table by its class.)
    sample = (
        df.select(*keys, *_missing(order, keys), "_row")
        .join(F.broadcast(hot), keys)
        .where(F.pmod("_row", "_every") == 0)
        .select(*keys, "_parts", probe.alias("_p"))
    )
    picked = F.array_sort(F.collect_list("_p"))

    def cut(i: Column) -> Column:
        at = F.floor(i.cast("long") * F.size("_all") / F.col("_parts")).cast("int")
        return F.element_at("_all", F.greatest(F.lit(1), at))

    # (Not array_distinct, which compares every pair of structs.)
    new = F.filter(
        F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: (i == 1) | (cut(i) != cut(i - 1))
    )
    cuts = (
        sample.groupBy(*keys, "_parts")
        .agg(picked.alias("_all"))
        .select(*keys, "_parts", F.transform(new, cut).alias("_cuts"))
    )
    cuts = materialize(cuts)  # read by every pass over the slices
    most = cuts.agg(F.max(F.size("_cuts"))).first()[0] or 0
    return (
        _search(df, keys, cuts, probe, most, "_below", "_tie")
        .withColumn(
            "_slice", F.col("_below") * 2 - F.when(F.col("_tie"), F.lit(1)).otherwise(F.lit(0))
        )
        .withColumn(
            "_salt",
            F.when(F.col("_tie"), F.pmod("_row", F.col("_parts"))).otherwise(F.lit(0)),
        )
        .drop("_below", "_row")
    )


def _missing(names: Sequence[str], present: Sequence[str]) -> list[str]:
    return [n for n in names if n not in present]


_WORK = ["_parts", "_slice", "_tie", "_salt"]


def tie_range(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    first: str = "_first",
    last: str = "_last",
    size: str = "_size",
    bounded: bool | None = None,
    task_rows: int | None = None,
) -> DataFrame:
    """Add each row's 1-based position range among equal order keys, and the group size."""
    keys, order = list(keys), list(order)
    if bounded is None:
        bounded = fits(df, keys, task_rows)
    if bounded:
        w = Window.partitionBy(*keys)
        o = w.orderBy(*order)
        return df.withColumns(
            {
                first: F.rank().over(o).cast("long"),
                last: F.count(F.lit(1)).over(o),
                size: F.count(F.lit(1)).over(w),
            }
        )
    cut = slice_hot(df, keys, order, task_rows)
    part = [*keys, "_slice", "_salt"]
    w = Window.partitionBy(*part)
    o = w.orderBy(*order)
    rows = cut.withColumns(
        {
            first: F.rank().over(o).cast("long"),
            last: F.count(F.lit(1)).over(o),
            size: F.count(F.lit(1)).over(w),
        }
    )
    starts = (
        cut.where(F.col("_parts").isNotNull())
        .groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    upto = Window.partitionBy(*keys).orderBy("_slice")
    starts = starts.select(
        *keys,
        "_slice",
        "_n",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    rows = rows.join(F.broadcast(starts), [*keys, "_slice"], "left")
    tie = F.col("_tie")
    return rows.withColumns(
        {
            first: F.when(tie, F.col("_before") + 1).otherwise(
                F.coalesce("_before", F.lit(0)) + F.col(first)
            ),
            last: F.when(tie, F.col("_before") + F.col("_n")).otherwise(
                F.coalesce("_before", F.lit(0)) + F.col(last)
            ),
            size: F.coalesce("_total", F.col(size)),
        }
    ).drop("_n", "_before", "_total", *_WORK)


def average_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    *,
    size: str | None = None,
    bounded: bool | None = None,
    task_rows: int | None = None,
) -> DataFrame:
    """Average rank of ``value`` in its group; rows with a null value get a null rank.

    ``size`` names a column for the number of ranked rows in the group (null on null values).
    """
    if bounded is None:
        bounded = fits(df, keys, task_rows)
    n = size or "_size"
    if bounded:
        # Nulls sort last and so do not move the others; ranks on one key set share a shuffle.
        return _ranked(df, keys, value, n).withColumn(
            out, (F.col("_first") + F.col("_last")) / F.lit(2.0)
        ).drop("_first", "_last", *([] if size else ["_size"]))
    # Null values take part as a group of their own and are blanked afterwards.
    present = F.col(value).isNotNull()
    ranked = tie_range(
        df.withColumn("_has", present), [*keys, "_has"], [value], size=n, bounded=False,
        task_rows=task_rows,
    )
    ranked = ranked.withColumn(
        out, F.when(F.col("_has"), (F.col("_first") + F.col("_last")) / F.lit(2.0))
    )
    ranked = ranked.withColumn(n, F.when(F.col("_has"), F.col(n)))
    return ranked.drop("_first", "_last", "_has", *([] if size else ["_size"]))


def _ranked(df: DataFrame, keys: Sequence[str], value: str, size: str) -> DataFrame:
    """Position range and group size of the non-null values of bounded groups."""
    w = Window.partitionBy(*keys)
    o = w.orderBy(F.col(value).asc_nulls_last())
    has = F.col(value).isNotNull()
    return df.withColumns(
        {
            "_first": F.when(has, F.rank().over(o).cast("long")),
            "_last": F.when(has, F.count(F.lit(1)).over(o)),
            size: F.when(has, F.count(F.col(value)).over(w)),
        }
    )


def _quantile_aggs(value: str, probs: dict[str, float], nearest: Sequence[str]):
    """Aggregates over ranked rows, and the quantile expressions built from them."""
    n = F.max("_size")

    def at(position: Column) -> Column:
        hit = (F.col("_first") <= position) & (F.col("_last") >= position)
        return F.max(F.when(hit, F.col(value)))

    aggs, outs = {"_qn": n}, {}
    for i, (name, q) in enumerate(probs.items()):
        spot = (F.col("_size") - 1) * F.lit(float(q))
        if name in nearest:
            aggs[f"_q{i}"] = at(F.round(spot) + 1)
            outs[name] = F.col(f"_q{i}")
            continue
        aggs[f"_lo{i}"], aggs[f"_hi{i}"] = at(F.floor(spot) + 1), at(F.ceil(spot) + 1)
        whole = (F.col("_qn") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        outs[name] = lo + (hi - lo) * (whole - F.floor(whole))
    return aggs, outs


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    *,
    nearest: Sequence[str] = (),
    bounded: bool | None = None,
    task_rows: int | None = None,
) -> DataFrame:
    """Exact quantiles of the non-null values per group, one row per group.

    Linear interpolation, or the nearest observation for the names listed in ``nearest``.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    ranked = tie_range(rows, keys, [value], bounded=bounded, task_rows=task_rows)
    aggs, outs = _quantile_aggs(value, probs, nearest)
    table = ranked.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return table.select(*keys, *[c.alias(n) for n, c in outs.items()])


def with_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    *,
    nearest: Sequence[str] = (),
    bounded: bool | None = None,
    task_rows: int | None = None,
) -> DataFrame:
    """``group_quantiles`` attached to every row; one shuffle when groups are bounded."""
    keys, columns = list(keys), df.columns
    if bounded is None:
        bounded = fits(df, keys, task_rows)
    if not bounded:
        df = materialize(df)
        table = group_quantiles(
            df, keys, value, probs, nearest=nearest, bounded=False, task_rows=task_rows
        )
        return df.join(table, keys, "left")
    ranked = _ranked(df, keys, value, "_size")
    aggs, outs = _quantile_aggs(value, probs, nearest)
    w = Window.partitionBy(*keys)
    staged = ranked.withColumns({n: c.over(w) for n, c in aggs.items()})
    return staged.select(*columns, *[c.alias(n) for n, c in outs.items()])


def with_group_stats(
    df: DataFrame, keys: Sequence[str], stats: dict[str, Column], *, bounded: bool | None = None
) -> DataFrame:
    """Attach per-group aggregates to every row.

    Bounded groups use a window, which shares its shuffle with the ranks around it. Otherwise the
    aggregate combines map-side into one row per group and is joined back; adaptive execution
    broadcasts that table when it is small and splits skewed partitions when it is not.
    """
    keys = list(keys)
    if bounded is None:
        bounded = fits(df, keys)
    if bounded:
        w = Window.partitionBy(*keys)
        return df.withColumns({n: c.over(w) for n, c in stats.items()})
    df = materialize(df)
    small = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(small, keys, "left")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    *,
    bounded: bool | None = None,
    task_rows: int | None = None,
) -> DataFrame:
    """Running sums per group in ``order``, which must be unique within the group.

    Hot groups add up inside their slices; each slice then starts from the sum of the slices before
    it, taken from one small row per slice.
    """
    keys, order = list(keys), list(order)
    if bounded is None:
        bounded = fits(df, keys, task_rows)
    named = df.withColumns({f"_x_{n}": c for n, c in totals.items()})
    cut = named if bounded else slice_hot(named, keys, order, task_rows)
    part = keys if bounded else [*keys, "_slice"]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumns({n: F.sum(f"_x_{n}").over(w) for n in totals})
    if not bounded:
        before = (
            Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        )
        sums = cut.where(F.col("_parts").isNotNull()).groupBy(*part).agg(
            *[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in totals]
        )
        starts = sums.select(*part, *[F.sum(f"_s_{n}").over(before).alias(f"_b_{n}") for n in totals])
        rows = rows.join(F.broadcast(starts), part, "left")
        # A sum stays null only while neither part has seen a value.
        rows = rows.withColumns(
            {
                n: F.coalesce(F.col(n) + F.col(f"_b_{n}"), F.col(n), F.col(f"_b_{n}"))
                for n in totals
            }
        )
    return rows.select(*df.columns, *totals)


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the row with the greatest ``order`` per key.

    An aggregate, not ``row_number``: a key repeated a billion times shrinks map-side to one row per
    task. Remaining columns break ties, so the survivor never depends on input order.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    ranked = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in ranked])).alias("_b"))
    return best.select(*[c if c in keys else F.col(f"_b.`{c}`").alias(c) for c in df.columns])
