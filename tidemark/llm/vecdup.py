"""Near-copies of vectors: all pairs of blocks of a sorted projection order that a distance bound leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, components
from tidemark.llm.vectors import cosine, matrix, usable
from tidemark.session import materialize

BITS = 48
WINDOW = 48
SEED = 29
# A block is one row of the block table: its vectors as doubles fill at most this.
BLOCK_ROWS, BLOCK_BYTES = 4_096, 4 << 20
# Vectors read to centre the projections; fewer of a label than LEAST_SAMPLED give no centre.
SAMPLE, LEAST_SAMPLED = 2_000, 16
SALTS = 16


def _planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((BITS, dim))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Rows whose squares leave the range of a double have no cosine: they become NaN."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        size = (x * x).sum(axis=1, keepdims=True)
        return np.where(np.isfinite(size), x / np.sqrt(size), np.nan)


def _balls(unit: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre and radius of each run of ``window`` rows; rows without a cosine take no part."""
    centres, radii = [], []
    for lo in range(0, len(unit), window):
        part = unit[lo : lo + window]
        part = part[~np.isnan(part).any(axis=1)]
        centre = part.mean(axis=0) if len(part) else np.zeros(unit.shape[1])
        centres.append(centre)
        radii.append(np.sqrt(((part - centre) ** 2).sum(axis=1)).max(initial=0.0))
    return np.array(centres), np.array(radii)


def _reach(least: float) -> float:
    """Unit vectors farther apart than this have a smaller cosine than ``least``, rounding included."""
    return float(np.sqrt(max(0.0, 2.0 - 2.0 * least + 1e-6))) + 1e-4


def block_links(
    x: np.ndarray, y: np.ndarray | None, nx: np.ndarray, ny: np.ndarray, least: float, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links of the rows of ``x`` with those of ``y``, or with each other where ``y`` is None.

    Gives the weight of each row's linked rows (those of ``x``, then those of ``y``), and positions (i, j)
    of links that join the same components as all of them do. Runs of ``window`` rows whose balls lie
    farther apart than a link reaches are passed over.
    """
    same = y is None
    y = x if y is None else y
    ux = _unit(x)
    uy = ux if same else _unit(y)
    cx, rx = _balls(ux, window)
    cy, ry = (cx, rx) if same else _balls(uy, window)
    shift = 0 if same else len(x)
    linked = np.zeros(len(x) + (0 if same else len(y)), np.int64)
    group = np.arange(len(linked))
    joins: list[tuple[int, int]] = []
    reach = _reach(least)
    for t in range(len(cx)):
        lo = t * window
        near = np.sqrt(((cy - cx[t]) ** 2).sum(axis=1)) <= rx[t] + ry + reach
        if same:
            near[:t] = False
        cols = np.flatnonzero(np.repeat(near, window)[: len(y)])
        if not len(cols):
            continue
        rows = np.arange(lo, min(lo + window, len(x)))
        score = ux[rows] @ uy[cols].T
        hit = score >= least + 1e-9
        p, q = np.nonzero((score >= least - 1e-9) & ~hit)  # too close to call by matrix products
        for k in range(0, len(p), 10_000):
            a, b = p[k : k + 10_000], q[k : k + 10_000]
            hit[a, b] = cosine(x[rows[a]], y[cols[b]]) >= least
        if same:
            hit &= cols[None, :] > rows[:, None]
        if not hit.any():
            continue
        linked[rows] += (hit @ ny[cols].astype(float)).astype(np.int64)
        linked[cols + shift] += (nx[rows].astype(float) @ hit).astype(np.int64)
        for k in np.flatnonzero(hit.any(axis=1)):
            i = rows[k]
            to = cols[hit[k]] + shift
            others, first = np.unique(group[to], return_index=True)
            first = first[others != group[i]]
            if len(first):
                joins += [(i, j) for j in to[first]]
                group[np.isin(group, others)] = group[i]
    at = np.array(joins, np.int64).reshape(-1, 2)
    return linked, at[:, 0], at[:, 1]


def _blocks(classes: DataFrame, window: int, seed: int) -> DataFrame:
    """Rows of ``classes`` packed into blocks: at most ``BLOCK_ROWS`` that follow each other in the order of
    label, length and concatenated sign hashes of random projections, centred on the label's mean.

    The order is made by ranges, not by label, so a hot label is spread over tasks; a block ends with
    its range. The order only decides which vectors lie close together, not which are compared.
    """
    kind = classes.schema["vec"].dataType.elementType.simpleString()
    name, vec_type, store = ("float", pa.float32(), "<f4") if kind == "float" else ("double", pa.float64(), "<f8")
    rows = classes.select("label", F.size("vec").alias("dim"), "id", "n", F.col("vec").cast(f"array<{name}>").alias("vec"))
    found: dict[tuple[str, int], list] = {}
    for r in classes.orderBy("h1", "h2").limit(SAMPLE).select("label", "vec").collect():
        found.setdefault((r["label"], len(r["vec"])), []).append(r["vec"])
    means = {}
    for key, vecs in found.items():
        unit = _unit(np.array(vecs, float))
        unit = unit[~np.isnan(unit).any(axis=1)]
        if len(unit) >= LEAST_SAMPLED:
            means[key] = unit.mean(axis=0)
    powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    coded = pa.schema(
        [("label", pa.string()), ("dim", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("vec", pa.list_(vec_type)), ("code", pa.int64())]
    )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for dim in map(int, np.unique(dims)):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                unit = _unit(matrix(part.column(4)))
                centre = np.zeros(dim)
                unit = unit - np.array([means.get((label, dim), centre) for label in part.column(0).to_pylist()])
                if dim not in planes:
                    planes = {dim: _planes(dim, seed)}  # one at a time: dimensions may be many
                codes = (unit @ planes[dim].T >= 0) @ powers
                cols = [*(part.column(k) for k in range(4)), part.column(4).cast(coded.field("vec").type), pa.array(codes, pa.int64())]
                yield pa.record_batch(cols, schema=coded)

    order = ["label", "dim", "code", "id"]
    ordered = rows.mapInArrow(code, f"label string, dim int, id long, n long, vec array<{name}>, code long")
    # The whole code takes part in the ranges: a code that many vectors share is cut by id.
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = pa.schema(
        [
            ("block", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()),
            ("ids", pa.binary()), ("ns", pa.binary()), ("vecs", pa.binary()),
        ]
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        done = 0
        held: list[pa.RecordBatch] = []
        count = 0
        last = None

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = matrix(t.column("vec").combine_chunks())
            centre, radius = _balls(_unit(x), len(x))
            row = [part + done, last[0], last[1], centre[0], radius[0]]
            row += [t.column(k).to_numpy().astype("<i8").tobytes() for k in ("id", "n")] + [x.astype(store).tobytes()]
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                while lo < hi:
                    full = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * keys[lo][1])))
                    if held and (keys[lo] != last or count >= full):
                        yield close()
                        held, count, done = [], 0, done + 1
                    last = keys[lo]
                    take = min(hi - lo, full - count)
                    held.append(batch.slice(lo, take))
                    count += take
                    lo += take
        if held:
            yield close()

    return ordered.mapInArrow(
        fill, "block long, label string, dim int, centre array<double>, radius double, ids binary, ns binary, vecs binary"
    )


def linked_classes(classes: DataFrame, least: float, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id, other, linked): links that join the components of the classes, and the number of vectors that
    each class links with as parts that sum up (``other`` null).

    Every pair of blocks of a label and length meets in a row of its own, unless their balls lie farther
    apart than a link reaches: no link is lost, and a hot label is compared by many tasks.
    """
    bounded_batches(classes.sparkSession)
    store = "<f4" if classes.schema["vec"].dataType.elementType.simpleString() == "float" else "<f8"
    blocks = materialize(_blocks(classes, window, seed))
    ball = blocks.select("block", "label", "dim", "centre", "radius")
    a = ball.toDF("a", "label", "dim", "ca", "ra").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    b = ball.toDF("b", "label", "dim", "cb", "rb").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gap = F.aggregate(F.zip_with("ca", "cb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    pairs = a.join(b, ["label", "dim", "salt"]).where("a <= b")
    pairs = pairs.where(F.sqrt(gap) <= F.col("ra") + F.col("rb") + F.lit(_reach(least))).select("a", "b")
    data = blocks.select("block", "dim", "ids", "ns", "vecs")
    left = data.toDF("a", "dim", "ids", "ns", "vecs")
    # A block meets itself: its vectors are not sent twice.
    right = data.select(F.col("block").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("ids", "ns", "vecs")))
    # A fixed number of parts: pairs are a few bytes before the join and hours of work after it.
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = pairs.repartition(parts, "a", "b").join(left, "a").join(right, "b")
    met = met.select("dim", "ids", "ns", "vecs", *(F.when(F.col("a") != F.col("b"), F.col(f"{c}_b")) for c in ("ids", "ns", "vecs")))
    out = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("linked", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim, ids, ns, vecs, ids_b, ns_b, vecs_b = (c[k].as_py() for c in batch.columns)
                ids, ns = np.frombuffer(ids, "<i8"), np.frombuffer(ns, "<i8")
                x, y, ny, names = np.frombuffer(vecs, store).reshape(-1, dim).astype(float), None, ns, ids
                if ids_b is not None:
                    y = np.frombuffer(vecs_b, store).reshape(-1, dim).astype(float)
                    ny, names = np.frombuffer(ns_b, "<i8"), np.concatenate((ids, np.frombuffer(ids_b, "<i8")))
                linked, i, j = block_links(x, y, ns, ny, least, window)
                some = np.flatnonzero(linked)
                yield pa.record_batch([pa.array(names[some]), pa.nulls(len(some), pa.int64()), pa.array(linked[some])], schema=out)
                yield pa.record_batch([pa.array(names[i]), pa.array(names[j]), pa.nulls(len(i), pa.int64())], schema=out)

    return met.mapInArrow(compare, "id long, other long, linked long")


def near_vectors(
    table: DataFrame,
    least: float = 0.98,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    window: int = WINDOW,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector.

    Links join vectors of equal label, length and a cosine of at least ``least`` in double precision.
    Every such pair is found: ``window`` only sets how many rows are passed over or compared at a time.
    Equal vectors of a label are one class before that, so copies cost nothing and their links are
    counted exactly; they link only where their cosine, 1 up to rounding, reaches ``least``.
    Vectors that are null, zero or not finite, and those of a null label, link with nothing. An empty
    table gives no rows.
    """
    vec = F.transform(F.col(vec_col), lambda x: x + F.lit(0).cast(table.schema[vec_col].dataType.elementType))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    takes = usable(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # -0.0 became 0.0 above; two hashes name a vector well past the number of vectors.
    rows = rows.withColumns({"h1": F.when(takes, F.xxhash64("vec")), "h2": F.when(takes, F.hash("vec"))})
    classes = (
        rows.where("h1 IS NOT NULL")
        .groupBy("label", "h1", "h2")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("vec").alias("vec"))
    )
    classes = materialize(classes)
    links = materialize(linked_classes(classes, least, window))
    others = links.where("other IS NULL").groupBy("id").agg(F.sum("linked").alias("linked"))
    roots = components(links.where("other IS NOT NULL"), "id", "other").withColumnRenamed("node", "id")
    info = (
        classes.select("label", "h1", "h2", "id", "n")
        .join(others, "id", "left")
        .join(roots, "id", "left")
        .select(
            "label",
            "h1",
            "h2",
            (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    placed = rows.select("vec_id", "label", "h1", "h2").join(info, ["label", "h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return placed.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
