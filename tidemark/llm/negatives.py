"""Hard negatives by inner product, sifted with segment summaries.

Each vector is stored with the mean and the deviation of its segments, on levels of 1, 4, 16, ... segments. Over
a segment of n components the inner product of x and y lies within n * (mean x * mean y -+ dev x * dev y), so the
sums over a level's segments bound the score. A pair is scored exactly only if its bounds meet the scores that are
still wanted on every level, from the coarsest on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import blocks_of, bounded_batches
from tidemark.llm.vectors import matrix
from tidemark.session import materialize

# Rows and anchors that meet in a task, fewer where vectors are long: at most so many components of each.
BLOCK, WAVE, COMPONENTS = 16_384, 8_192, 4 << 20
# Rows and anchors that are sifted at a time.
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 4_096, 256
# Where more of a chunk's pairs are left, scoring all of it at once is the cheaper way.
DENSE = 0.05
# Vectors up to this squared length have exact scores in double precision.
LONGEST = 2.0**53


def levels(dim: int) -> list[np.ndarray]:
    """Borders of the segments of each level, the coarsest first; each level cuts a segment in four."""
    out, n = [], 1
    while 2 * n <= dim:
        out.append(np.linspace(0, dim, n + 1).astype(np.int64))
        n *= 4
    return out


def summaries(x: np.ndarray) -> np.ndarray:
    """Means, then deviations, of the segments of each level, times the root of the segment's length."""
    parts = []
    for edges in levels(x.shape[1]):
        size = np.diff(edges)
        mean = np.add.reduceat(x, edges[:-1], axis=1) / size
        gap = x - np.repeat(mean, size, axis=1)
        parts += [mean * np.sqrt(size), np.sqrt(np.add.reduceat(gap * gap, edges[:-1], axis=1))]
    return np.concatenate(parts, axis=1) if parts else np.zeros((len(x), 0))


class Side(NamedTuple):
    """Vectors of one side of a meeting: ids, labels, exact components, summaries, lengths."""

    ids: np.ndarray
    labels: np.ndarray
    vec: np.ndarray
    summary: np.ndarray
    norm: np.ndarray

    def take(self, at: slice) -> Side:
        return Side(*(part[at] for part in self))


def read_side(table: pa.Table) -> Side:
    n = table.num_rows
    vec = np.frombuffer(b"".join(table["vec"].to_pylist()), "<f8").reshape(n, -1)
    summary = np.frombuffer(b"".join(table["summary"].to_pylist()), "<f4").reshape(n, -1)
    norm = np.sqrt((vec * vec).sum(axis=1))
    return Side(table["id"].to_numpy(), table["label"].to_numpy(), vec, summary, norm)


def sift(asked: Side, rows: Side, live: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, int]:
    """Scores of the live pairs that may lie in low..high (one of each per anchor), minus infinity elsewhere.

    Also the number of pairs scored. Bounds come in single precision and are widened by its error.
    """
    at = 0
    live = live.copy()
    for edges in levels(rows.vec.shape[1]):
        i, j = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
        if not len(i):
            break
        n = len(edges) - 1
        mean, dev = slice(at, at + n), slice(at + n, at + 2 * n)
        at += 2 * n
        middle = asked.summary[i, mean] @ rows.summary[j, mean].T
        reach = asked.summary[i, dev] @ rows.summary[j, dev].T
        reach += 0.5 + 2e-5 * asked.norm[i, None] * rows.norm[None, j]
        live[np.ix_(i, j)] &= (middle + reach >= low[i, None]) & (middle - reach <= high[i, None])
    out = np.full(live.shape, -np.inf)
    i, j = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
    if not len(i):
        return out, 0
    cell = np.ix_(i, j)
    if live[cell].mean() > DENSE:
        out[cell] = np.where(live[cell], asked.vec[i] @ rows.vec[j].T, -np.inf)
    else:
        a, b = np.nonzero(live)
        for lo in range(0, len(a), 65_536):
            p, r = a[lo : lo + 65_536], b[lo : lo + 65_536]
            out[p, r] = np.einsum("ij,ij->i", asked.vec[p], rows.vec[r])
    return out, int(live.sum())


class Best:
    """The best ``k`` rows of each of ``n`` places so far: highest score, then smallest id."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.place, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(n, -np.inf)

    def add(self, places: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in a score for each place (rows) and id (columns); minus infinity is none."""
        if scores.shape[1] > self.k:
            bar = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            bar = np.maximum(bar, self.least[places])
        else:
            bar = self.least[places]
        p, r = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
        if not len(p):
            return
        place = np.concatenate((self.place, places[p]))
        found = np.concatenate((self.ids, ids[r]))
        score = np.concatenate((self.score, scores[p, r]))
        order = np.lexsort((found, -score, place))
        place = place[order]
        nth = np.arange(len(place)) - np.searchsorted(place, place)
        order = order[nth < self.k]
        self.place, self.ids, self.score = place[nth < self.k], found[order], score[order]
        full = nth[nth < self.k] == self.k - 1
        self.least[self.place[full]] = self.score[full]


def best_same(asked: Side, rows: Side, k: int) -> Best:
    """The best rows of each anchor's own label, its own id left out."""
    best = Best(len(asked.ids), k)
    for i in range(0, len(asked.ids), ANCHORS_AT_ONCE):
        some = asked.take(slice(i, i + ANCHORS_AT_ONCE))
        places = np.arange(i, i + len(some.ids))
        for j in range(0, len(rows.ids), ROWS_AT_ONCE):
            part = rows.take(slice(j, j + ROWS_AT_ONCE))
            live = (some.labels[:, None] == part.labels) & (some.ids[:, None] != part.ids)
            scores, _ = sift(some, part, live, best.least[places], np.full(len(places), np.inf))
            best.add(places, part.ids, scores)
    return best


def best_other(asked: Side, limits: np.ndarray, rows: Side, k: int, percent: int) -> Best:
    """For each anchor and each of its limits (NaN: none) the best rows of other labels.

    Their scores lie between ``percent`` of the limit and the limit. Places number the limits row by row.
    """
    slots = limits.shape[1]
    best = Best(len(asked.ids) * slots, k)
    floor = np.where(np.isnan(limits), np.inf, percent * limits / 100)
    for i in range(0, len(asked.ids), ANCHORS_AT_ONCE):
        some = asked.take(slice(i, i + ANCHORS_AT_ONCE))
        n = len(some.ids)
        top = limits[i : i + n]
        places = (np.arange(i, i + n) * slots)[:, None] + np.arange(slots)
        for j in range(0, len(rows.ids), ROWS_AT_ONCE):
            part = rows.take(slice(j, j + ROWS_AT_ONCE))
            live = (some.labels[:, None] != part.labels) & (some.ids[:, None] != part.ids)
            low = np.maximum(floor[i : i + n], best.least[places]).min(axis=1)
            high = np.where(np.isnan(top), -np.inf, top).max(axis=1)
            scores, _ = sift(some, part, live, low, high)
            for slot in range(slots):
                limit = top[:, slot, None]
                # (A missing limit compares as false.)
                right = (100 * scores >= percent * limit) & (scores <= limit)
                best.add(places[:, slot], part.ids, np.where(right, scores, -np.inf))
    return best


def summarized(rows: DataFrame, scale: int) -> DataFrame:
    """id, label, anchor, dim, vec, summary: vectors in whole numbers with their segment summaries, packed."""
    schema = pa.schema([
        ("id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("dim", pa.int32()), ("vec", pa.binary()),
        ("summary", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = matrix(part.column(4)) if dim else np.zeros((part.num_rows, 0))
                x = np.floor(scale * x)
                if ((x * x).sum(axis=1) >= LONGEST).any():
                    raise ValueError("a vector is too long for exact scores")
                short = summaries(x).astype("<f4")
                cols = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x.astype("<f8"), short)]
                yield pa.record_batch([*part.columns[:4], *cols], schema=schema)

    kinds = "id long, label long, anchor boolean, dim int, vec binary, summary binary"
    return rows.select("id", "label", "anchor", "dim", "vec").mapInArrow(run, kinds)


def hard_negatives(
    table: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    block_rows: int = BLOCK,
    wave_rows: int = WAVE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is their inner product. An anchor's positives are the first
    ``positives`` rows of its label, by falling score, then smaller id; for each of them
    come the first ``negatives`` rows of other labels whose score lies between ``percent`` of the positive's score
    and that score. Rows of an anchor's own id are neither. All rows meet all anchors: rows are dealt evenly by position over blocks and anchors over
    waves, and a task holds one of each, so no label, id or repeated vector gathers. The best of each task
    are merged per anchor.

    Rows with a null id, label, vector or component, or one that is not finite, take no part; vectors of
    different lengths do not meet. Each of several rows of one id counts as a row, as anchor, positive or
    negative. Fewer rows than asked for give all there are; an empty table gives none. A vector whose scaled
    length exceeds 2 ** 26.5 is an error, since its scores could not be exact.
    """
    bounded_batches(table.sparkSession)
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    valid = (
        table.select(
            F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"),
            F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        )
        .where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
        .where(~bad)
        .withColumn("dim", F.size("vec"))
    )
    index = materialize(summarized(valid, scale))
    longest = index.agg(F.max("dim")).first()[0] or 1
    block_rows = max(1, min(block_rows, COMPONENTS // max(1, longest)))
    wave_rows = max(1, min(wave_rows, COMPONENTS // max(1, longest)))
    rows = blocks_of(index, block_rows, "block")
    asked = index.where("anchor").withColumn("place", F.monotonically_increasing_id())
    asked = materialize(asked.drop("anchor"))
    waves = max(1, -(-asked.count() // wave_rows))
    blocks = max(1, -(-index.count() // block_rows))

    left = rows.drop("anchor").withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    wave = F.pmod(F.xxhash64("place"), F.lit(waves)).cast("int")

    def meeting(anchors: DataFrame, kernel, kinds: str) -> DataFrame:
        right = anchors.withColumn("wave", wave).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = right.withColumn("block", F.col("block").cast("long"))
        keys = ("dim", "block", "wave")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, kinds)

    found = pa.schema([("place", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def rows_of(best: Best, places: np.ndarray, slots: int) -> pa.Table:
        return pa.table(
            [places[best.place // slots], (best.place % slots).astype(np.int32), best.ids, best.score.astype(np.int64)],
            schema=found,
        )

    def same(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return found.empty_table()
        return rows_of(best_same(read_side(anchors), read_side(rows), positives), anchors["place"].to_numpy(), 1)

    def other(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return found.empty_table()
        limits = np.full((anchors.num_rows, positives), np.nan)
        for i, scores in enumerate(anchors["scores"].to_pylist()):
            limits[i, : len(scores)] = scores
        best = best_other(read_side(anchors), limits, read_side(rows), negatives, percent)
        return rows_of(best, anchors["place"].to_numpy(), positives)

    kinds = "place long, slot int, id long, score long"
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("id"))
    near = meeting(asked, same, kinds).withColumn("rank", F.row_number().over(order))
    near = near.where(F.col("rank") <= positives)
    near = near.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))
    asked = materialize(
        asked.join(near, "place").withColumn("positives", F.col("near.id")).withColumn("scores", F.col("near.score")).drop("near")
    )
    order = Window.partitionBy("place", "slot").orderBy(F.col("score").desc(), F.col("id"))
    hard = meeting(asked.drop("positives"), other, kinds).withColumn("rank", F.row_number().over(order))
    hard = hard.where(F.col("rank") <= negatives)
    names = asked.select("place", F.col("id").alias("anchor_id"), "positives", "scores")
    at = F.col("slot") + 1
    return hard.join(names, "place").select(
        "anchor_id",
        F.element_at("positives", at).alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.element_at("scores", at).alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
