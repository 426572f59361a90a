"""Text quality by ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, text_window

CELLS = 1 << 18
SAMPLE_ROWS = 2_500
SAMPLE_CHARS = 20_000
WORDS_KEPT = 200_000
LONGEST_KEPT = 48
REPEAT, EMPTY = 0, 1
MOST_GRADES = 64
_PLAIN = re.compile(r"[^\W\d_]+")


def _hash(name: str) -> int:
    return 2 + xxhash.xxh3_64_intdigest(name.encode()) % (CELLS - 2)


def word_features(word: str) -> tuple[int, int]:
    """Hashed cells of a word: its letters in lower case, and its form (cases, digits, marks)."""
    core = "".join(_PLAIN.findall(word))
    if core == word:  # letters only: the form is the case
        form = "aa" if word.islower() else "AA" if word.isupper() else "Aa"
    else:
        form = re.sub(r"[^\W\d_]+", lambda m: "aa" if m.group().islower() else "AA" if m.group().isupper() else "Aa", word)
        form = re.sub(r"(.)\1+", r"\1\1", re.sub(r"\d", "0", form))
    return _hash("w:" + core.lower()), _hash("f:" + form)


class WordFeatures(dict):
    def __missing__(self, word: str) -> tuple[int, int]:
        got = word_features(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = got
        return got


_FEATURES = WordFeatures()


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells and values of a text: shares of its words with a feature, and of words equal to the one before."""
    words = text.split()
    if not words:
        return np.array([EMPTY]), np.array([1.0])
    cells = np.array([_FEATURES[w] for w in words]).ravel()
    cell, n = np.unique(cells, return_counts=True)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return np.append(cell, REPEAT), np.append(n, repeats) / len(words)


@dataclass
class OrdinalModel:
    """P(grade > g) = logistic(f - cut[g]) with one weight per cell for all grades and rising cuts."""

    weights: np.ndarray
    cuts: np.ndarray
    grades: np.ndarray

    def tails(self, f: np.ndarray) -> np.ndarray:
        """P(grade is at least each grade but the lowest), a row per text."""
        return 1.0 / (1.0 + np.exp(-np.clip(f[:, None] - self.cuts, -30, 30)))

    def expected(self, f: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(f) @ np.diff(self.grades)


class WordScores(dict):
    """Summed weights of a word's cells."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        a, b = word_features(word)
        got = float(self.weights[a] + self.weights[b])
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = got
        return got

    def text(self, text: str) -> float:
        words = text.split()
        if not words:
            return float(self.weights[EMPTY])
        repeats = sum(map(str.__eq__, words, words[1:]))
        return (sum(map(self.__getitem__, words)) + repeats * float(self.weights[REPEAT])) / len(words)


def fit_ordinal(
    rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, rounds: int = 200, rate: float = 0.5, decay: float = 1e-3
) -> OrdinalModel:
    """Penalised maximum likelihood of the proportional-odds model by Adam.

    The cuts are a first cut and positive steps, so they stay in order. Grades are weighted alike,
    whatever their share, and then only by the square root of it.
    """
    grades, y = np.unique(grade, return_inverse=True)
    k = len(grades)
    if k < 2:
        return OrdinalModel(np.zeros(CELLS), np.zeros(0), grades.astype(float) if k else np.zeros(1))
    cells = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used, code = np.unique(cells, return_inverse=True)
    share = np.bincount(y) / len(y)
    weight = (1.0 / np.sqrt(share))[y]
    weight /= weight.sum()
    w = np.zeros(len(used))
    base = np.cumsum(share)[:-1]
    cuts0 = np.log(base / (1 - base))
    gaps = np.concatenate(([cuts0[0]], np.log(np.maximum(np.diff(cuts0), 0.1))))
    params, mean, var = [w, gaps], [np.zeros_like(w), np.zeros_like(gaps)], [np.zeros_like(w), np.zeros_like(gaps)]
    n = len(rows)
    for step in range(1, rounds + 1):
        w, gaps = params
        steps = np.exp(gaps[1:])
        cuts = gaps[0] + np.concatenate(([0.0], np.cumsum(steps)))
        f = np.bincount(doc, values * w[code], n)
        edge = np.concatenate(([-np.inf], cuts, [np.inf]))
        lo, hi = f - edge[y], f - edge[y + 1]  # P = s(lo) - s(hi)
        s_lo, s_hi = 1 / (1 + np.exp(-np.clip(lo, -30, 30))), 1 / (1 + np.exp(-np.clip(hi, -30, 30)))
        s_lo, s_hi = np.where(y == 0, 1.0, s_lo), np.where(y == k - 1, 0.0, s_hi)
        p = np.maximum(s_lo - s_hi, 1e-9)
        d_lo, d_hi = s_lo * (1 - s_lo), s_hi * (1 - s_hi)
        g_f = -weight * (d_lo - d_hi) / p
        g_cut = np.zeros(k - 1)
        np.add.at(g_cut, y[y > 0] - 1, (weight * d_lo / p)[y > 0])
        np.add.at(g_cut, y[y < k - 1], -(weight * d_hi / p)[y < k - 1])
        g_gaps = np.concatenate(([g_cut.sum()], np.cumsum(g_cut[::-1])[::-1][1:] * steps))
        grads = [np.bincount(code, values * g_f[doc], len(used)) + decay * w / n, g_gaps]
        for i in range(2):
            mean[i] = 0.9 * mean[i] + 0.1 * grads[i]
            var[i] = 0.99 * var[i] + 0.01 * grads[i] ** 2
            lr = rate if i == 0 else 0.05
            params[i] = params[i] - lr * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-10)
    weights = np.zeros(CELLS)
    weights[used] = params[0]
    cuts = params[1][0] + np.concatenate(([0.0], np.cumsum(np.exp(params[1][1:]))))
    return OrdinalModel(weights, cuts, grades.astype(float))


def ratings(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, grade from the label table: 0 poor, 1 fair text but toxic, 2 good. Null quality has none."""
    good, toxic = F.col("quality") >= 1, F.coalesce(F.col("toxic"), F.lit(0)) >= 1
    grade = F.when(~good, 0).when(toxic, 1).otherwise(2)
    return labels.where("quality IS NOT NULL").select(F.col(id_col).cast("long").alias(id_col), grade.alias("grade"))


def fit(
    docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
    sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS,
) -> OrdinalModel:
    """Fit on a bounded sample: per grade the ``sample_rows`` rated rows of lowest hash; of a text
    longer than ``sample_chars`` characters, that many from a place named by its id. A grade of which no text
    is found is warned of. Grades are numbers in any steps; more than
    ``MOST_GRADES`` of them are an error."""
    given = graded.select(F.col(id_col).cast("long").alias(id_col), F.col(grade_col).cast("double").alias("_y"))
    given = given.where("_y IS NOT NULL")
    found = [r["_y"] for r in given.select("_y").distinct().orderBy("_y").limit(MOST_GRADES + 1).collect()]
    if len(found) > MOST_GRADES:
        raise ValueError(f"more than {MOST_GRADES} grades: bin them first")
    if not found:
        return OrdinalModel(np.zeros(CELLS), np.zeros(0), np.zeros(1))
    parts = [given.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows) for y in found]
    sample = parts[0]
    for part in parts[1:]:
        sample = sample.unionByName(part)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))
    # The sample has at most sample_rows ids a grade: the texts need no shuffle to meet it.
    rows = rows.join(F.broadcast(sample), id_col).select(id_col, "_y", text_window("_text", id_col, sample_chars)).collect()
    rows = sorted((r[id_col], r["_y"], r["_text"]) for r in rows if r["_text"] is not None)
    missing = set(found) - {r[1] for r in rows}
    if missing:
        warnings.warn(f"no text to learn grades {sorted(missing)} from", stacklevel=2)
    return fit_ordinal([text_features(r[2]) for r in rows], np.array([r[1] for r in rows]))


def graded_texts(
    docs: DataFrame, graded: DataFrame, least_grade: float = 1.0, least_tail: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept: one row per document, over its whole text.

    ``tail_probability`` is that of a grade of ``least_grade`` or more; ``kept`` where it reaches
    ``least_tail``. Null and empty texts score as a text without words. With no rated text, or one
    grade only, nothing can be told apart: every document is kept. Repeated rows give repeated rows.
    """
    bounded_batches(docs.sparkSession)
    fitted = fit(docs, graded, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    above = np.flatnonzero(fitted.grades[1:] >= least_grade)
    at = int(above[0]) if len(above) else -1
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        words = WordScores(m.weights)
        for batch in batches:
            f = np.array([words.text(t.as_py() or "") for t in batch.column(1)])
            tail = m.tails(f)[:, at] if at >= 0 else np.ones(len(f))
            cols = [batch.column(0), pa.array(m.expected(f) if len(f) else f), pa.array(tail, pa.float64())]
            yield pa.record_batch(cols, schema=schema)

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        run, "doc_id long, expected_grade double, tail_probability double"
    )
    return scored.withColumn("kept", F.col("tail_probability") >= least_tail)


def keep_graded(
    docs: DataFrame, graded: DataFrame, least_grade: float = 1.0, least_tail: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The documents that ``graded_texts`` keeps, all columns as they are; texts are read once, not joined."""
    bounded_batches(docs.sparkSession)
    fitted = fit(docs, graded, id_col, text_col)
    above = np.flatnonzero(fitted.grades[1:] >= least_grade)
    if not len(above):
        return docs
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    at, place = int(above[0]), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        words = WordScores(m.weights)
        for batch in batches:
            f = np.array([words.text(t.as_py() or "") for t in batch.column(place)])
            if len(f):
                yield batch.filter(pa.array(m.tails(f)[:, at] >= least_tail))

    return docs.mapInArrow(run, docs.schema)
