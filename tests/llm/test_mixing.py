"""Targets by water filling, and samples that meet them."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string, copies int")


def brute_targets(size, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    names = sorted([s for s in size if s is not None]) + ([None] if None in size else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, out = share * sum(size.values()), set(names), {}
    while open_:
        part = {s: total * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > most * size[s]]
        if not over:
            return out | part
        for s in over:
            out[s] = most * size[s]
            total -= out[s]
            open_.discard(s)
    return out


def test_sizes(spark):
    texts = ["a  b\tc\n", "", None, " x y", " lead", "é\x0bf\x0cg\rh"]
    got = mixing.sizes(docs(spark, [(i, t, "s", "x", 9) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [r["size"] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


@pytest.mark.parametrize("shape", [(50, 40, 30, 20), (400, 5, 5, 5), (1, 1, 300, 1), (7, 0, 90, 12)])
def test_targets(spark, shape):
    names = ["b", "a", None, "é"]
    rows = []
    for s, n in zip(names, shape, strict=True):
        rows += [(len(rows) + i, "w " * (1 + i % 7), s, "x", 9) for i in range(n)]
    got = {r["source"]: r for r in mixing.source_targets(mixing.sizes(docs(spark, rows))).collect()}
    size = {s: r["source_size"] for s, r in got.items()}
    want = brute_targets(size)
    assert {s: pytest.approx(t) for s, t in want.items()} == {s: r["target"] for s, r in got.items()}


def test_mix_meets_targets_and_repeats_itself(spark):
    rows = [(i, "w " * (1 + (i * 37) % 90), f"s{i % 3}" if i % 5 else None, "x", 9) for i in range(900)]
    d = docs(spark, rows)
    got = mixing.pareto_mix(d).collect()
    again = mixing.pareto_mix(d.repartition(7)).collect()
    key = lambda r: r["doc_id"]
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert sorted(map(key, got)) == list(range(900))
    taken = {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    for have, target in taken.values():
        assert abs(have - target) <= max(0.01 * target, 1)


def test_odd_rows(spark):
    rows = [(1, None, None, "x", 9), (2, "", "a", "x", 9), (3, "one two", "a", "x", 9), (3, "one two", "a", "x", 9), (None, "z", "b", "x", 9)]
    got = mixing.pareto_mix(docs(spark, rows)).collect()
    assert len(got) == 5
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.pareto_mix(docs(spark, [])).count() == 0


def test_longer_texts_are_likelier(spark):
    rows = [(i, "w " * (2 if i % 2 else 400), "s", "x", 9) for i in range(2000)]
    got = mixing.pareto_mix(docs(spark, rows), weights=(1.0,), share=0.5).groupBy("size").agg(F.avg("copies").alias("p")).collect()
    p = {r["size"]: r["p"] for r in got}
    assert p[400] > 1.3 * p[2]
