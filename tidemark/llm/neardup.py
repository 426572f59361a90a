"""Near-copies of texts: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A text is its lower-case words between white space. Its elements are runs of ``SHINGLE`` words (one
run of all words where there are fewer), the j-th occurrence of a run being an element of its own, so
that a sum over elements counts each run as often as it occurs (tf). An element weighs the sum over its
words of 1 and ``IDF_SHARE`` of the idf: edits tend to be rare words, and the full idf would rate pairs
whose plain similarity is well over the threshold under it. Word counts come from all documents, in ``DF_CELLS`` hashed cells: a bounded table,
whatever the vocabulary. Counting whole runs instead would rate a passage of a large family of copies
far below each copy's own edits, and copies that are alike would fall under the threshold.

The weighted Jaccard similarity of two texts is the weight of their common elements over the weight
of all their elements.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, components
from tidemark.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
DF_CELLS = 1 << 16
IDF_SHARE = 0.1
CROWD = 32
BLOCK_TEXTS = 256
WORDS_KEPT = 200_000
LONGEST_KEPT = 48
_UNIT = 400.0  # weights are kept as whole numbers in the low 16 bits of an element


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bounded number."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode())
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = h
        return h


_HASHES = WordHashes()


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finisher)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def document_counts(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents and, per hashed cell, of documents with a word in it; over all documents."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(DF_CELLS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total += 1
                cells = (word_hashes(words_of(text.as_py())) >> np.uint64(64 - 16)).astype(np.uint16)
                seen[np.unique(cells)] += 1
        at = np.flatnonzero(seen)
        cols = [np.append(at, -1), np.append(seen[at], total)]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    rows = docs.select(text_col).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts, total = np.zeros(DF_CELLS, np.int64), 0
    for cell, n in rows.toLocalIterator():  # at most one row per cell
        if cell < 0:
            total = n
        else:
            counts[cell] = n
    return total, counts


def word_weights(total: int, counts: np.ndarray) -> np.ndarray:
    """Weight per cell: 1 and a share of the idf, so that every word counts and rare ones count more."""
    return (1.0 + IDF_SHARE * np.log1p(max(total, 1) / np.maximum(counts, 1))).astype(np.float32)


_ODD = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def elements(words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sorted elements of a text from its word hashes: 48 bits of hash, 16 bits of weight."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    k = min(n, SHINGLE)
    weight = idf[(words >> np.uint64(64 - 16)).astype(np.uint16)]
    h, w = words[: n - k + 1] * _ODD[0], weight[: n - k + 1].astype(np.float64)
    for j in range(1, k):
        h = h + words[j : n - k + 1 + j] * _ODD[j]
        w += weight[j : n - k + 1 + j]
    units = np.clip(np.rint(w * (_UNIT / SHINGLE)), 1, 65_535).astype(np.uint64)
    out = np.sort((mix(h) << np.uint64(16)) | units)
    again = out[1:] == out[:-1]
    if again.any():  # the j-th occurrence of a run gets a hash of its own
        new = np.concatenate(([True], ~again))
        first = np.maximum.accumulate(np.where(new, np.arange(len(out)), 0))
        nth = (np.arange(len(out)) - first).astype(np.uint64)
        other = (mix((out >> np.uint64(16)) + (nth << np.uint64(48))) << np.uint64(16)) | (out & np.uint64(0xFFFF))
        out = np.sort(np.where(nth > 0, other, out))
    return out.view(np.int64)


def _draws(x: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per element two Gamma(2, 1) numbers and a uniform one, the same wherever the element occurs."""
    base = mix(x ^ seed)
    u = []
    for k in range(1, 6):
        v = mix(base + np.uint64(k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        u.append(((v >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
    return -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), u[4]


def _ranked(x: np.ndarray, log_weight: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the ICWS value a of each element, and its sample (element with step t)."""
    r, c, beta = _draws(x, seed)
    t = np.floor(log_weight / r + beta)
    log_a = np.log(c) - r * (t - beta) - r
    return log_a, mix(x ^ (t.astype(np.int64).view(np.uint64) << np.uint64(1)))


def _fill(out: np.ndarray, least: np.ndarray, spot: np.ndarray, log_a: np.ndarray, sample: np.ndarray) -> None:
    """Put the sample of least value into each spot named."""
    np.minimum.at(least, spot, log_a)
    won = log_a == least[spot]
    out[spot[won]] = sample[won]


def signatures(texts: list[np.ndarray], size: int = BANDS * ROWS, room: int = 1 << 19) -> np.ndarray:
    """Bin-wise consistent weighted sampling: ``size`` samples of each text, one draw per element.

    Elements fall into ``size`` bins, and each bin keeps its ICWS sample. A bin left empty takes an ICWS
    sample of all elements under a seed of its own, so short texts get independent samples. ``room``
    bounds the draws made at once.
    """
    seeds = mix(np.arange(size + 1, dtype=np.uint64))
    out = np.zeros(len(texts) * size, np.uint64)
    least = np.full(len(texts) * size, np.inf)
    lengths = np.array([len(t) for t in texts], np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(lengths) // room)) + 1, [len(texts)]))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi == lo:
            continue
        elems = np.concatenate(texts[lo:hi])
        x = elems.view(np.uint64)
        log_weight = np.log((elems & 0xFFFF).astype(np.float64))
        owner = np.repeat(np.arange(lo, hi), lengths[lo:hi])
        spot = owner * size + (mix(x) % np.uint64(size)).astype(np.int64)
        _fill(out, least, spot, *_ranked(x, log_weight, seeds[0]))
        begin = np.cumsum(lengths[lo:hi]) - lengths[lo:hi]
        empty = np.flatnonzero(np.isinf(least[lo * size : hi * size]))
        empty = empty[lengths[lo + empty // size] > 0]
        draws = lengths[lo + empty // size]
        parts = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(draws) // room)) + 1, [len(empty)]))
        for a, b in zip(parts, parts[1:], strict=False):
            if a == b:
                continue
            some, n = empty[a:b], draws[a:b]
            total = int(n.sum())
            at = np.repeat(begin[some // size] - (np.cumsum(n) - n), n) + np.arange(total)
            seed = np.repeat(seeds[1 + some % size], n)
            _fill(out, least, np.repeat(lo * size + some, n), *_ranked(x[at], log_weight[at], seed))
    return out.reshape(len(texts), size)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """Keys of the bands of each signature."""
    rows = sigs.reshape(len(sigs), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sigs), BANDS))
    for j in range(ROWS):
        h = mix(h ^ mix(rows[:, :, j] + np.uint64(j)))
    return h.view(np.int64)


def words_digest(words: list[str]) -> bytes | None:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest() if words else None


def text_digest(text: str) -> Column:
    """Names a text as it stands; a null has the empty name."""
    return F.coalesce(F.sha2(F.col(text), 256), F.lit(""))


def sketches(docs: DataFrame, idf: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest of the text itself, digest of its words, band keys.

    Texts without words have neither of the last two; the text digest of a null is empty.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("raw", pa.string()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, texts = [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                digests.append(words_digest(words))
                texts.append(elements(word_hashes(words), idf))
            keys = band_keys(signatures(texts))
            bands = [k if d else None for k, d in zip(keys, digests, strict=True)]
            cols = [*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch(cols, schema=schema)

    return docs.select(F.col(id_col).cast("long"), text_digest(text_col), text_col).mapInArrow(
        sketch, "doc_id long, raw string, digest binary, bands array<long>"
    )


def element_table(docs: DataFrame, idf: np.ndarray, text_col: str = "text") -> DataFrame:
    """Digest of the words, weight of all elements, elements."""
    schema = pa.schema([("digest", pa.binary()), ("weight", pa.int64()), ("elems", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(0)]
            got = [elements(word_hashes(w), idf) for w in words]
            cols = [pa.array(map(words_digest, words), pa.binary()), pa.array([int((e & 0xFFFF).sum()) for e in got], pa.int64())]
            yield pa.record_batch([*cols, pa.array(got, pa.list_(pa.int64()))], schema=schema)

    return docs.select(text_col).mapInArrow(run, "digest binary, weight long, elems array<long>")


def verified(pairs: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches ``similarity``."""
    left = table.select(F.col("id").alias("a"), F.col("weight").alias("wa"), F.col("elems").alias("ea"))
    right = table.select(F.col("id").alias("b"), F.col("weight").alias("wb"), F.col("elems").alias("eb"))
    common = F.aggregate(
        F.array_intersect("ea", "eb"), F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(F.lit(0xFFFF))
    )
    got = pairs.join(right, "b").join(left, "a")
    # Texts whose weights differ too much cannot reach the threshold: no sets are built for them.
    got = got.where(F.least("wa", "wb") >= F.lit(similarity) * F.greatest("wa", "wb"))
    got = got.withColumn("common", common)
    return got.where(
        F.col("common") >= F.lit(similarity) * (F.col("wa") + F.col("wb") - F.col("common")) - F.lit(1e-9)
    ).select("a", "b")


def block_links(rows: pd.DataFrame, similarity: float, columns: int = 4_096) -> list[tuple[int, int]]:
    """Links that join different components among some texts: a spanning forest of them.

    ``rows`` has id, weight, elems, component and side; texts of side 0 meet those of side 1, and each
    other where all are of side 0. Common weights of all pairs come from matrix products over slices of
    the elements that occur more than once.
    """
    rows = rows.drop_duplicates("id")
    n = len(rows)
    elems = np.concatenate([np.asarray(e, np.int64) for e in rows["elems"]]) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(e) for e in rows["elems"]])
    found, place, count = np.unique(elems, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    number = np.full(len(found), -1)
    number[shared] = np.arange(len(shared))
    at = number[place]
    owner, at = owner[at >= 0], at[at >= 0]
    common = np.zeros((n, n))
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for lo in range(0, len(shared), columns):
        a, b = np.searchsorted(at, (lo, lo + columns))
        has = np.zeros((n, min(columns, len(shared) - lo)), np.float32)
        has[owner[a:b], at[a:b] - lo] = 1.0
        weight = (found[shared[lo : lo + columns]] & 0xFFFF).astype(np.float32)
        common += (has * weight) @ has.T
    total = rows["weight"].to_numpy(float)
    either = total[:, None] + total[None, :] - common
    near = common >= similarity * either - 1e-3  # weights are whole numbers
    side = rows["side"].to_numpy()
    if (side == 1).any():
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(near, 1))
    ids, root = rows["id"].to_numpy(), {}

    def find(v: int) -> int:
        while root.get(v, v) != v:
            root[v] = root.get(root[v], root[v])
            v = root[v]
        return v

    component = rows["component"].to_numpy()
    out = []
    for p, q in zip(i, j, strict=True):
        u, v = find(int(component[p])), find(int(component[q]))
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((int(min(ids[p], ids[q])), int(max(ids[p], ids[q]))))
    return out


def crowded_links(placed: DataFrame, table: DataFrame, similarity: float, block: int = BLOCK_TEXTS) -> DataFrame:
    """Links between components in buckets of many texts: every pair of blocks of a bucket meets in a task
    of its own, and only links that join components come out.

    ``placed`` has band, id, component and n, the texts of the bucket.
    """
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = placed.withColumn("b", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))
    )
    own = own.select(
        "band",
        F.least("b", "other").alias("i"),
        F.greatest("b", "other").alias("j"),
        "id",
        "component",
        (F.col("b") > F.col("other")).cast("int").alias("side"),
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(rows, similarity), columns=["a", "b"]).astype("int64")

    joined = own.join(table, "id")
    return joined.groupBy("band", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, class_id, kept, raw, class_raw: one row per row of ``docs``.

    A document is a pair of id and text, ``raw`` being the text's digest: rows that repeat both are one document,
    rows that repeat an id over another text are documents of their own, with classes of their own. A class is
    what links between texts of at least ``similarity`` reach; ``class_id`` and ``class_raw`` name its smallest
    document, by id and then digest, which alone is ``kept``. Texts with equal words are one text. Every band bucket compares its
    texts with the one of most company, and wherever a bucket still holds several components, each text
    outside the largest is compared with every text of another component, pair by pair or, in buckets
    of more than ``CROWD`` texts, block by block: no link between components is lost, and a bucket of m
    copies of one text costs m pairs, not m squared.

    Null texts and texts without words link with nothing, nor does a null id: they are kept. An empty table gives
    no rows.
    """
    bounded_batches(docs.sparkSession)
    total, counts = document_counts(docs, text_col)
    idf = word_weights(total, counts)
    sketch = materialize(sketches(docs, idf, id_col, text_col))
    texts = (
        sketch.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "raw")).alias("first"), F.any_value("bands").alias("bands"))
    )
    texts = materialize(texts)
    salt = 0
    while not texts.groupBy(_node(salt)).count().where("count > 1").isEmpty():
        salt += 1
    texts = texts.withColumn("id", _node(salt))
    keyed = texts.select("id", F.col("first.doc_id").alias("doc_id"), F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keyed.join(buckets, "band"))
    # A bucket is led by its text of most company in all its buckets: the one most others are copies of.
    company = members.groupBy("id").agg(F.sum("n").alias("company"))
    rated = members.join(company, "id")
    leads = rated.groupBy("band").agg(F.max_by("id", F.struct("company", -F.col("id"))).alias("lead"))
    led = members.join(leads, "band").where("id <> lead")
    first = led.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    first = materialize(first)
    wanted = members.select(F.col("doc_id").alias(id_col)).distinct()
    # The set of candidates grows with the corpus, so it is never broadcast.
    table = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).join(
        wanted.hint("merge"), id_col, "left_semi"
    )
    table = element_table(table, idf, text_col).withColumn("id", _node(salt)).drop("digest")
    table = table.join(members.select("id").distinct().hint("merge"), "id", "left_semi")
    table = materialize(table.dropDuplicates(["id"]))
    links = materialize(verified(first, table, similarity))
    roots = components(links)

    placed = members.join(roots.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("band", "id", "n", F.coalesce("component", "id").alias("component"))
    groups = placed.groupBy("band", "component").agg(F.count("*").alias("size"))
    mixed = groups.groupBy("band").agg(
        F.max_by("component", F.struct("size", "component")).alias("largest"), F.count("*").alias("parts")
    )
    mixed = mixed.where("parts > 1").select("band", "largest")
    placed = materialize(placed.join(mixed, "band"))
    few = placed.where(F.col("n") <= CROWD)
    x = few.where("component <> largest").select("band", F.col("id").alias("x"), F.col("component").alias("cx"))
    y = few.select("band", F.col("id").alias("y"), F.col("component").alias("cy"), "largest")
    once = (F.col("cy") == F.col("largest")) | (F.col("x") < F.col("y"))
    cross = x.join(y, "band").where((F.col("cx") != F.col("cy")) & once)
    cross = cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    cross = cross.join(first, ["a", "b"], "left_anti")
    more = verified(cross, table, similarity).unionByName(
        crowded_links(placed.where(F.col("n") > CROWD), table, similarity)
    )
    more = materialize(more)
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    linked = texts.join(roots.withColumnRenamed("node", "id"), "id").select("digest", "first", "component")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    linked = linked.join(heads, "component").select("digest", "head")
    of_text = texts.select("digest", "first").join(linked, "digest", "left")
    of_text = of_text.select("digest", F.coalesce("head", "first").alias("head"))
    out = sketch.select("doc_id", "raw", "digest").join(of_text, "digest", "left")
    head = F.when(F.col("doc_id").isNotNull(), F.coalesce("head", F.struct("doc_id", "raw")))
    kept = (F.col("doc_id") == head["doc_id"]) & (F.col("raw") == head["raw"])
    return out.select(
        "doc_id", head["doc_id"].alias("class_id"), F.coalesce(kept, F.lit(True)).alias("kept"), "raw",
        head["raw"].alias("class_raw"),
    )


def _node(salt: int) -> Column:
    """A number for a text, from the digest of its words; the salt is one that gives no two texts the same."""
    return F.xxhash64("digest", F.lit(salt))
