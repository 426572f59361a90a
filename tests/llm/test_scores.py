"""Toxicity and quality: exact marginals, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    moves = np.log(rng.dirichlet([1, 1], 2))
    odds = [rng.normal(0, 3, n) for n in (1, 2, 7, 9, 0)]
    got = toxicity.chain_marginals(odds, moves, block=4)
    for e, p in zip(odds, got, strict=True):
        n = len(e)
        total, toxic = 0.0, np.zeros(n)
        for path in np.ndindex(*(2,) * n):
            w = np.exp(sum(e[t] for t in range(n) if path[t]) + sum(moves[a, b] for a, b in zip((0, *path), path, strict=False)))
            total += w
            toxic += w * np.array(path)
        assert np.allclose(p, toxic / total) if n else len(p) == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxic_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    y = got["toxic"].to_numpy() == 1
    s = got["score"].to_numpy()
    rank = got["score"].rank().to_numpy()
    auc = (rank[y].mean() - (y.sum() + 1) / 2) / (~y).sum()
    assert auc > 0.95  # some labelled texts hold no toxic word at all
    assert (s[y] >= 0.3).mean() > 0.9 and (s[~y] >= 0.3).mean() < 0.02
    ids = got["doc_id"].tolist()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in ids)


def test_offsets_and_odd_rows(spark):
    rng = random.Random(1)
    lines = []
    for i in range(400):
        ws = ["w%s" % "abcdefghij"[rng.randrange(10)] * rng.randrange(1, 4) for _ in range(30)]
        if i % 5 == 0:
            ws[rng.randrange(30)] = ws[rng.randrange(30)] = "vileword"
        lines.append((i, " ".join(ws), int(i % 5 == 0)))
    labels = spark.createDataFrame([(i, t) for i, _, t in lines], "doc_id long, toxic int")
    extra = [(1000, None), (1001, ""), (1002, "12 34"), (1003, "É ok vileword vileword ok"), (1003, "É ok vileword vileword ok"), (None, "x")]
    docs = spark.createDataFrame([(i, t, "a") for i, t, _ in lines] + [(*e, "a") for e in extra], "doc_id long, text string, score string")
    rows = toxicity.toxic_scores(docs, labels).collect()
    assert len(rows) == len(lines) + len(extra)
    got = {r["doc_id"]: r for r in rows}
    assert got[1003]["offsets"] == "5:13,14:22" and got[1003]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert got[1000]["score"] == got[1001]["score"] == got[1002]["score"] < 0.3
    one = labels.where("toxic = 0")
    assert toxicity.toxic_scores(docs, one).where("predicted = 1").count() == 0
    assert toxicity.toxic_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        z = rng.normal()
        rows.append((np.array([5, 6]), np.array([max(0.0, z), max(0.0, -z)])))
        y.append(float(np.digitize(z + 0.2 * rng.normal(), [-1, 0, 1])))
    m = quality.fit_ordinal(rows, np.array(y), rounds=300)
    assert (np.diff(m.cuts) > 0).all()
    f = np.array([m.weights[c] @ v for c, v in rows])
    tails = m.tails(f)
    assert (np.diff(tails, axis=1) <= 0).all()
    for g in range(3):
        assert abs(tails[:, g].mean() - (np.array(y) > g).mean()) < 0.06
    assert np.corrcoef(m.expected(f), y)[0, 1] > 0.9


def test_quality_on_rows_not_learned_from(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    even = F.col("doc_id") % 2 == 0
    got = quality.graded_texts(docs, quality.ratings(labels.where(even)))
    got = got.join(labels.where(~even), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r["quality"]: r["k"] for r in got}
    assert kept[1] > 0.98 and kept[0] < 0.15


def test_too_many_grades_are_an_error(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(101)], "doc_id long, text string")
    graded = spark.createDataFrame([(i, i) for i in range(101)], "doc_id long, grade int")
    with pytest.raises(ValueError, match="grades"):
        quality.fit(docs, graded)


def test_whole_words_are_hashed():
    assert quality.word_features("a" * 64 + "bc") != quality.word_features("a" * 64 + "de")


def test_quality_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "fine words here"), (3, "fine words here"), (None, "x"), (4, "w " * 40_000)]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in quality.graded_texts(docs, quality.ratings(none)).collect())
    some = spark.createDataFrame([(3, 1, None), (4, 0, 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.graded_texts(docs, quality.ratings(some)).collect()
    assert len(got) == 6 and all(0 <= r["tail_probability"] <= 1 for r in got)
    kept = quality.keep_graded(docs, quality.ratings(some))
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.graded_texts(docs.limit(0), quality.ratings(some)).count() == 0


@pytest.mark.parametrize("words", [200, 6_000])
def test_toxic_texts_of_any_length_are_learned(spark, words):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        ws = ["w%s" % "abcdefghij"[rng.randrange(10)] * rng.randrange(1, 4) for _ in range(words)]
        for at in range(i % 20, words, 20) if i % 2 else ():
            ws[at] = "vileword"
        rows.append((i, " ".join(ws), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.toxic_scores(docs, labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_labels_without_texts_are_warned_of(spark):
    docs = spark.createDataFrame([(i, "some text" if i % 2 else None) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(20)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="no text"):
        assert toxicity.toxic_scores(docs, labels).count() == 20
    graded = spark.createDataFrame([(i, float(i % 2)) for i in range(20)], "doc_id long, grade double")
    with pytest.warns(UserWarning, match="no text"):
        quality.fit(docs, graded)


def test_ordinal_fit_matches_a_plain_optimiser():
    """Cumulative-link loss at the fit against plain descent with numeric gradients on the same features."""
    rng = np.random.default_rng(5)
    names = [f"word{c}" for c in "abcdef"]
    pull = np.array([2.0, 1.0, 0.0, 0.0, -1.0, -2.0])
    texts, grades = [], []
    for _ in range(240):
        counts = rng.integers(0, 3, 6)
        grades.append(int(np.digitize(counts @ pull + rng.logistic(0, 1), [-1.0, 1.0])))
        texts.append(" ".join(n for n, c in zip(names, counts, strict=True) for _ in range(c)) or "none")
    y = np.array(grades, float)
    model = quality.fit_ordinal([quality.text_features(t) for t in texts], y)
    words = quality.WordScores(model.weights)
    f = np.array([words.text(t) for t in texts])
    tail = model.tails(f)
    full = np.column_stack([np.ones(len(f)), tail, np.zeros(len(f))])
    p = full[np.arange(len(f)), y.astype(int)] - full[np.arange(len(f)), y.astype(int) + 1]
    assert (p > 0).all() and np.allclose(model.expected(f), tail.sum(axis=1) + model.grades[0], atol=1e-6)
    share = np.bincount(y.astype(int)) / len(y)
    assert -np.log(p).mean() < -(share * np.log(share)).sum() - 0.2  # far better than the shares alone
    # No small step of the cuts alone, of the slope alone or of both lessens the weighted loss by more than a trace.
    weight = 1 / np.sqrt(share[y.astype(int)])
    weight = weight / weight.sum()
    cuts = model.cuts

    def loss(scale, shift, spread):
        c = shift + spread * (cuts - cuts.mean()) + cuts.mean()
        up = np.column_stack([np.ones(len(f)), 1 / (1 + np.exp(c[None, :] - scale * f[:, None])), np.zeros(len(f))])
        at = np.arange(len(f)), y.astype(int)
        return -(weight * np.log(up[at] - up[at[0], at[1] + 1])).sum()

    here = loss(1.0, 0.0, 1.0)
    grid = [(a, b, c) for a in (0.8, 0.9, 1.0, 1.1, 1.25) for b in (-0.2, 0.0, 0.2) for c in (0.8, 0.9, 1.0, 1.1, 1.25)]
    assert here <= min(loss(*g) for g in grid) + 0.02
