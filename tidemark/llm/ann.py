"""Approximate nearest neighbours: an inverted file whose lists are read by an adaptive dimension scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vectors import cosine, matrix, usable
from tidemark.session import materialize

SAMPLE = 20_000
LISTS = 1_024
TUNED_ON = 400
RECALL = 0.97
BLOCK = 4_096
QUERIES = 1_024
COLUMNS = 16
EPSILON = 2.1
SEED = 41


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_lists(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Spherical k-means centres of a bounded sample."""
    x = _unit(sample)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(axis=1))
        live = size > 0
        centres[live] = total[live] / size[live, None]
    return centres


def tune_probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float = RECALL, seed: int = SEED) -> int:
    """Lists to read so that, on the sample, ``recall`` of the true neighbours lie in them."""
    x = _unit(sample)
    home = np.argmax(x @ centres.T, axis=1)
    at = np.random.default_rng(seed).choice(len(x), min(TUNED_ON, len(x)), replace=False)
    sims = x[at] @ x.T
    sims[np.arange(len(at)), at] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(centres)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    order = np.argsort(np.argsort(-(x[at] @ centres.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(order, home[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def scan_list(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, turn: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of one list for each query: (query position, row position, cosine).

    Rows and queries are scaled to length 1 and rotated, then read in blocks of columns. After a
    block of d of D columns, a row leaves when its partial squared distance exceeds
    ``t * d / D * (1 + EPSILON / sqrt(d)) ** 2``, t being the squared distance of the query's k-th
    best so far: the hypothesis that it is nearer than that is rejected. Rows are read in chunks, so
    that t is known after the first. Those that stay to the last column are scored exactly.
    """
    dim = vectors.shape[1]
    x = _unit(vectors) @ turn
    q = _unit(queries) @ turn
    edges = [*range(0, dim, COLUMNS), dim]
    out_q, out_r, out_s = [], [], []
    chunks = np.array_split(np.arange(len(ids)), max(1, -(-len(ids) // 512)))
    for n in range(len(q)):
        limit = np.inf
        rows_kept, score_kept = np.zeros(0, np.int64), np.zeros(0)
        for chunk in chunks:
            live = chunk[ids[chunk] != query_ids[n]]
            part = np.zeros(len(live))
            for lo, hi in zip(edges, edges[1:], strict=False):
                gap = x[live, lo:hi] - q[n, lo:hi]
                part = part + np.einsum("ij,ij->i", gap, gap)
                if np.isfinite(limit):
                    bound = limit * (hi / dim) * (1 + EPSILON / np.sqrt(hi)) ** 2 if hi < dim else limit
                    stay = part <= bound + 1e-9
                    live, part = live[stay], part[stay]
                if not len(live):
                    break
            if not len(live):
                continue
            score = cosine(vectors[live], np.broadcast_to(queries[n], (len(live), dim)))
            rows_kept, score_kept = np.concatenate((rows_kept, live)), np.concatenate((score_kept, score))
            best = np.lexsort((ids[rows_kept], -score_kept))[:k]
            rows_kept, score_kept = rows_kept[best], score_kept[best]
            if len(best) == k:
                limit = 2.0 - 2.0 * score_kept[-1]
        out_q.append(np.full(len(rows_kept), n))
        out_r.append(rows_kept)
        out_s.append(score_kept)
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def _assigned(rows: DataFrame, centres: np.ndarray, take: int) -> DataFrame:
    """Rows with ``lists``: the ``take`` nearest centres of each, nearest first."""
    schema = "vec_id long, vec array<double>, lists array<int>"
    out = pa.schema(
        [("vec_id", pa.int64()), ("vec", pa.list_(pa.float64())), ("lists", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(matrix(batch.column(1)))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :take].astype(np.int32)
            lists = pa.array(list(near), pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), lists], schema=out)

    return rows.select("vec_id", "vec").mapInArrow(run, schema)


def nearest(
    table: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    sample_rows: int = SAMPLE,
    recall: float = RECALL,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each query, by cosine.

    Centres and the number of lists to read are fitted on a sample of at most ``sample_rows`` vectors
    (those of the lowest hash); every row is indexed. Lists are cut into blocks of about ``BLOCK`` rows
    and the queries of a list into blocks of ``QUERIES``, so neither a hot list nor a common query
    gathers in one task. A row of the query's own id is no candidate; ties go to the smaller id.

    Vectors that are null, zero or not finite take no part. A query's candidates are the rows of its
    own length; each length that queries have is fitted and searched on its own. Fewer candidates than
    ``k`` give fewer rows; an empty table none.
    """
    def valid(df: DataFrame) -> DataFrame:
        vec = F.col(vec_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(
            usable(F.col("vec")) & F.col("vec_id").isNotNull()
        )

    rows, asked = valid(table), valid(queries)
    found = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n, r in enumerate(asked.select(F.size("vec").alias("dim")).distinct().orderBy("dim").collect()):
        same = F.size("vec") == r["dim"]
        part = _nearest(rows.where(same), asked.where(same), r["dim"], k, sample_rows, recall)
        if part is not None:
            found = found.unionByName(part) if n else part
    return found


def _nearest(rows: DataFrame, queries: DataFrame, dim: int, k: int, sample_rows: int, recall: float) -> DataFrame | None:
    """``nearest`` among valid vectors of one length; None where there are no rows."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec").toPandas()["vec"]
    if not len(picked):
        return None
    sample = np.stack(picked.to_list())
    lists = max(1, min(LISTS, len(sample) // 16, int(round(len(sample) ** 0.5))))
    centres = fit_lists(sample, lists)
    probes = min(lists, tune_probes(sample, centres, k, recall))

    index = _assigned(rows, centres, 1).withColumn("list", F.col("lists")[0]).drop("lists")
    index = materialize(index)
    asked = _assigned(queries, centres, lists)
    counts = index.groupBy("list").agg(F.count("*").alias("n")).collect()  # one row per list
    size = np.zeros(lists, np.int64)
    for r in counts:
        size[r["list"]] = r["n"]
    blocks = F.array(*[F.lit(int(max(1, -(-n // BLOCK)))) for n in size])
    sizes = F.array(*[F.lit(int(n)) for n in size])
    # Read the tuned number of lists, and more where those hold fewer rows than are asked for.
    before = F.aggregate(
        "lists",
        F.struct(F.lit(0).alias("read"), F.lit(0).cast("long").alias("rows")),
        lambda s, x: F.when(
            (s["read"] < probes) | (s["rows"] <= k),
            F.struct((s["read"] + 1).alias("read"), (s["rows"] + F.element_at(sizes, x + 1)).alias("rows")),
        ).otherwise(s),
        lambda s: s["read"],
    )
    asked = asked.withColumn("lists", F.slice("lists", F.lit(1), before))
    asked = materialize(asked.select(F.col("vec_id").alias("query_id"), "vec", F.explode("lists").alias("list")))
    waves = asked.groupBy("list").agg(F.count("*").alias("n")).collect()  # one row per list
    wave = np.ones(lists, np.int64)
    for r in waves:
        wave[r["list"]] = max(1, -(-r["n"] // QUERIES))
    waves_of = F.array(*[F.lit(int(n)) for n in wave])

    def cell(arr, at):
        return F.element_at(arr, F.col(at) + 1)

    left = index.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), cell(blocks, "list")).cast("int"))
    left = left.withColumn("wave", F.explode(F.sequence(F.lit(0), cell(waves_of, "list") - 1)))
    right = asked.withColumn("wave", F.pmod(F.xxhash64("query_id"), cell(waves_of, "list")).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), cell(blocks, "list") - 1)))
    turn = rotation(dim)

    def search(index_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(index_rows) or not len(query_rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, query_ids = index_rows["vec_id"].to_numpy(), query_rows["query_id"].to_numpy()
        x, q = np.stack(index_rows["vec"].to_list()), np.stack(query_rows["vec"].to_list())
        at_q, at_r, score = scan_list(ids, x, query_ids, q, k, turn)
        return pd.DataFrame({"query_id": query_ids[at_q], "vec_id": ids[at_r], "score": score})

    found = (
        left.groupBy("list", "wave", "block")
        .cogroup(right.groupBy("list", "wave", "block"))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
