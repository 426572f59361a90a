"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SLICES = 4_096
SALTS = 64


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source and size in words; a null text has none."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def source_targets(
    sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """One row per source: source_size, target.

    Sources in code point order, null last, take the weights in turn and share ``share`` of all
    words. A target stops at ``most`` times its source and the excess goes to the others by weight:
    with the sources in order of ``most * size / weight``, the first whose share at the common level
    stays within its cap sets the level for itself and all after it.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Binary order is code point order; the windows run over one row per source.
    first = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    n = F.pmod(F.row_number().over(first) - 1, F.lit(len(weights)))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (n + 1).cast("int")))
    by = by.withColumn("cap", most * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "cap", F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    by = by.select(
        "*",
        (share * F.sum("source_size").over(every)).alias("total"),
        F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"),
        F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
    )
    level = (F.col("total") - F.col("capped")) / F.col("open_weight")
    by = by.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    by = by.withColumn("level", F.max("level").over(every))
    return by.select(
        "source",
        "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def with_source(t: DataFrame, by: DataFrame, how: str = "inner") -> DataFrame:
    """``t`` with the columns of ``by``, which has one row per source.

    A source may hold a third of all rows, so documents meet ``SALTS`` copies of its row by their id.
    """
    names = [c for c in by.columns if c != "source"]
    salted = by.select(
        F.col("source").alias("_source"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), *names
    )
    salt = F.pmod(F.xxhash64(t["doc_id"], t["size"]), F.lit(SALTS)).cast("int")
    on = t["source"].eqNullSafe(salted["_source"]) & (salt == salted["_salt"])
    return t.join(salted, on, how).drop("_source", "_salt")


def uniform(*cols: str, seed: int) -> F.Column:
    """A number in (0, 1) from the text of the columns: the same on every run and in any SQL with md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    hexed = F.substring(F.md5(text.cast("binary")), 1, 12)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def pareto_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every document.

    A document is due ``target / source_size`` copies, tilted towards longer texts by a factor of at
    most two and never above ``most``. Its whole copies are certain. The rest, its inclusion
    probability p, enters a Pareto order sample of fixed size: documents rank by the odds of a random
    number over the odds of p, and a source takes its lowest ranks until its words are reached. A
    last document or two, each the unsampled one nearest in size to the words still missing, close the
    gap if that brings the source nearer its target.

    No source is ordered in one task: ranks fall into slices, slice sums give each source's critical
    slice, and only that slice is ordered. Documents without words have size 0 and take none; a null
    source is a source; repeated rows are equal and are taken alike; an empty table gives no rows.
    """
    sized = materialize(sizes(docs, id_col, text_col, source_col))
    targets = materialize(source_targets(sized, weights, share, most))
    t = with_source(sized, targets)
    # Due copies d = min(most, c * tilt); c solves sum(d * size) = target by halving on slice sums of the tilt.
    tilt = 1.0 + F.col("size") / (F.col("size") + F.lit(200.0))
    t = t.withColumn("tilt", F.floor(tilt * 64) / 64.0)
    t = with_source(t, _scales(t, most))
    due = F.least(F.lit(float(most)), F.col("c") * F.col("tilt"))
    t = t.withColumn("due", F.when(F.col("source_size") > 0, due).otherwise(F.lit(0.0)))
    t = t.withColumn("whole", F.floor(F.col("due") + 1e-9)).withColumn("p", F.greatest(F.lit(0.0), F.col("due") - F.col("whole")))
    u = uniform("doc_id", seed=seed)
    q = (u / (1 - u)) * ((1 - F.col("p")) / F.col("p"))
    t = t.withColumn("key", F.when((F.col("p") > 1e-9) & (F.col("size") > 0), q / (1 + q)))
    t = materialize(t.select("doc_id", "source", "size", "source_size", "target", "whole", "key"))

    cell = F.least(F.lit(SLICES - 1), F.floor(F.col("key") * SLICES)).cast("int")
    t = t.withColumn("cell", F.when(F.col("key").isNotNull(), cell))
    certain = t.groupBy("source").agg(
        F.max("target").alias("goal"), F.sum(F.col("whole") * F.col("size")).alias("sure")
    )
    cells = t.where("key IS NOT NULL").groupBy("source", "cell").agg(F.sum("size").alias("words"))
    j = cells.join(certain.withColumnRenamed("source", "c_source"), F.col("source").eqNullSafe(F.col("c_source")))
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    j = j.withColumn("room", F.col("goal") - F.col("sure") - F.col("before"))
    # The critical slice is the first that does not fit whole.
    critical = j.where((F.col("room") >= 0) & (F.col("room") < F.col("words")))
    critical = critical.groupBy("source").agg(
        F.min("cell").alias("k_cell"), F.min_by("room", "cell").alias("k_room")
    )
    t = with_source(t, critical, "left")
    inside = t.where(F.col("cell") == F.col("k_cell"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("picked", F.sum("size").over(order) <= F.col("k_room"))
    outside = t.where(F.col("cell").isNull() | F.col("k_cell").isNull() | (F.col("cell") != F.col("k_cell")))
    outside = outside.withColumn(
        "picked", F.col("cell").isNotNull() & (F.col("k_cell").isNull() | (F.col("cell") < F.col("k_cell")))
    )
    t = materialize(
        inside.unionByName(outside).select(
            "doc_id", "source", "size", "source_size", "target", "whole", "key", "picked"
        )
    )
    t = materialize(_closer(t))
    t = _closer(t)
    copies = F.col("whole") + F.col("picked").cast("long")
    return t.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        "source",
        copies.cast("long").alias("copies"),
        (F.col("size") * copies).cast("long").alias("taken"),
    )


def _scales(t: DataFrame, most: float) -> DataFrame:
    """Per source the factor c; the tilt has at most 65 values, so a source is 65 sums at most."""
    steps = t.groupBy("source", "tilt").agg(F.sum("size").alias("words"), F.max("target").alias("goal"))
    up = Window.partitionBy("source").orderBy(F.col("tilt").desc())
    steps = steps.select(
        "source",
        "tilt",
        "goal",
        F.coalesce(F.sum("words").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum(F.col("words") * F.col("tilt")).over(up.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    # With every larger tilt held at the cap: valid where this tilt itself stays within the cap.
    c = F.when(F.col("rest") > 0, (F.col("goal") - most * F.col("full")) / F.col("rest")).otherwise(F.lit(0.0))
    steps = steps.withColumn("c", c)
    fits = steps.where(F.col("c") * F.col("tilt") <= most + 1e-9)
    return fits.groupBy("source").agg(F.max_by("c", "tilt").alias("c"))


def _closer(t: DataFrame) -> DataFrame:
    """Per source, the unsampled document nearest in size to the missing words, if it narrows the gap."""
    taken = F.col("size") * (F.col("whole") + F.col("picked").cast("long"))
    gap = t.groupBy("source").agg(F.max("target").alias("goal"), F.sum(taken).alias("have"))
    gap = gap.select("source", (F.col("goal") - F.col("have")).alias("gap"))
    near = with_source(t.where((F.col("key").isNotNull()) & ~F.col("picked")), gap)
    off = F.abs(F.col("size") - F.col("gap"))
    near = near.where(off < F.col("gap")).groupBy("source").agg(
        F.min_by("doc_id", F.struct(off, F.col("key"), F.col("doc_id"))).alias("last_id"),
        F.first(F.lit(True)).alias("closes"),
    )
    t = with_source(t, near, "left")
    last = F.col("closes") & F.col("doc_id").eqNullSafe(F.col("last_id")) & F.col("key").isNotNull()
    t = t.withColumn("picked", F.col("picked") | F.coalesce(last, F.lit(False)))
    return t.drop("last_id", "closes")
