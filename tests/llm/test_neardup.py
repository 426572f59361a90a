"""Weighted MinHash against exact weighted Jaccard over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import neardup as nd


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, class_id int, band string, id int")


def words(rng, n):
    return ["w%d" % rng.randrange(5000) for _ in range(n)]


def jaccard(a, b, idf):
    """Straight from the definition: sums over runs of five words of tf times idf."""
    def weights(text):
        ws = text.lower().split()
        k = min(5, len(ws))
        runs = Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
        cell = {w: int(nd._HASHES[w] >> 48) for w in ws}
        return {r: n * sum(idf[cell[w]] for w in r) for r, n in runs.items()}
    x, y = weights(a), weights(b)
    both = sum(min(x[r], y[r]) for r in x.keys() & y.keys())
    return both / (sum(x.values()) + sum(y.values()) - both)


def brute(rows, idf):
    live = [(i, t) for i, t in rows if i is not None and t and t.split()]
    root = {i: i for i, _ in live}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(live):
        for j, b in live[n + 1 :]:
            if jaccard(a, b, idf) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in live}


def test_classes_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for family in range(8):
        base = words(rng, rng.randrange(20, 160))
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(10**6)
            rows.append((len(rows) * 7 % 101 + 1000 * family, " ".join(copy)))
    passage = words(rng, 12)  # a passage that many texts share does not make them copies
    rows += [(9000 + i, " ".join(words(rng, 80) + passage)) for i in range(30)]
    rows += [(20, "Upper  CASE text\nhere now"), (21, "upper case text here now"), (22, "short"), (23, "short"), (24, "other")]
    d = docs(spark, [(i, t, 0, "x", 1) for i, t in rows])
    total, counts = nd.document_counts(d)
    assert total == len(rows)
    want = brute(rows, nd.word_weights(total, counts))
    got = {r["doc_id"]: r for r in nd.near_duplicates(d).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["class_id"]) for i, r in got.items())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, ""), (None, "a b c"), (5, "a b c"), (6, "a b c"), (6, "a b c"), (7, "w " * 30_000), (8, "w " * 30_000)]
    got = nd.near_duplicates(docs(spark, [(i, t, 0, "x", 1) for i, t in rows])).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: (r["class_id"], r["kept"]) for r in got}
    assert kept == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), None: (None, True), 5: (5, True), 6: (5, False), 7: (7, True), 8: (7, False)}
    assert nd.near_duplicates(docs(spark, [])).count() == 0


def test_cross_component_pairs_are_found(spark):
    """In one bucket the leader may match neither of two texts that match each other."""
    rng = random.Random(5)
    base = words(rng, 100)
    a, b, c = list(base), list(base), list(base)
    for k in range(0, 8):
        a[k * 2] = f"a{k}"
    for k in range(0, 8):
        b[60 + k * 2] = f"b{k}"
    c[60:76] = b[60:76]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    d = docs(spark, [(i, t, 0, "x", 1) for i, t in rows])
    idf = nd.word_weights(*nd.document_counts(d))
    assert {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(d).collect()} == brute(rows, idf)


def test_crowded_buckets_give_the_same_classes(spark, monkeypatch):
    rng = random.Random(9)
    base = words(rng, 60)
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(60)] = "edit%d" % rng.randrange(10**6)
        rows.append((i, " ".join(copy)))
    d = docs(spark, [(i, t, 0, "x", 1) for i, t in rows])
    want = brute(rows, nd.word_weights(*nd.document_counts(d)))
    monkeypatch.setattr(nd, "CROWD", 4)
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 16)
    assert {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(d).collect()} == want


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(6)
    idf = rng.uniform(1, 9, nd.DF_CELLS).astype(np.float32)
    texts = [nd.elements(rng.integers(0, 2**63, n).astype(np.uint64), idf) for n in (1, 3, 0, 40, 700, 5)]
    whole = nd.signatures(texts)
    for i, t in enumerate(texts):
        assert (nd.signatures([t], room=50)[0] == whole[i]).all()


@pytest.mark.parametrize("share", [0.95, 0.8, 0.5])
def test_samples_agree_about_as_often_as_texts_are_alike(share):
    rng = np.random.default_rng(4)
    idf = np.full(nd.DF_CELLS, 3.0, np.float32)
    agree = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 300).astype(np.uint64)
        y = x.copy()
        y[int(300 * share) :] = rng.integers(0, 2**63, 300 - int(300 * share)).astype(np.uint64)
        ex, ey = nd.elements(x, idf), nd.elements(y, idf)
        both = len(np.intersect1d(ex, ey))
        true = both / (len(ex) + len(ey) - both)
        sx, sy = nd.signatures([ex, ey])
        agree.append((sx == sy).mean() - true)
    assert abs(np.mean(agree)) < 0.03
