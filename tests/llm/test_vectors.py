"""Vector operators against brute force."""

import numpy as np

from tidemark.llm import ann, vecdup


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, pass int, n_links string")


def rows_of(x, labels):
    return [(i, [float(v) for v in r], int(l), 7, "clash") for i, (r, l) in enumerate(zip(x.astype(np.float32), labels, strict=True))]


def brute(x, labels, least=0.98):
    x = x.astype(np.float32).astype(float)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    link = (unit @ unit.T >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(link, root[None, :], len(x)).min(1))
        if (low == root).all():
            return link.sum(1), root
        root = low


def test_links_and_components(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 24))
    x[100:220] = x[100] + 0.05 * rng.standard_normal((120, 24))  # more than a window
    x[300:330] = x[300] + 0.14 * rng.standard_normal((30, 24))
    x[400:420] = x[400]
    labels = rng.integers(0, 3, 600)
    labels[100:220] = 1
    n, root = brute(x, labels)
    got = vecdup.near_vectors(table(spark, rows_of(x, labels)), window=16).orderBy("vec_id").collect()
    assert [r["n_links"] for r in got] == n.tolist()
    assert [r["component_id"] for r in got] == root.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_odd_vectors(spark):
    a, b = [1.0, 0.0], [2.0, -0.0]
    rows = [
        (1, a, 1, 0, ""), (2, b, 1, 0, ""), (3, a, 2, 0, ""), (4, a, None, 0, ""), (5, None, 1, 0, ""), (6, [0.0, 0.0], 1, 0, ""),
        (7, [float("nan"), 1.0], 1, 0, ""), (8, [float("inf"), 1.0], 1, 0, ""), (9, [None, 1.0], 1, 0, ""), (10, [], 1, 0, ""),
        (11, [1.0, 0.0, 0.0], 1, 0, ""), (12, a, 1, 0, ""),
    ]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vecdup.near_vectors(table(spark, rows)).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[12] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert vecdup.near_vectors(table(spark, [])).count() == 0


def exact(x, asked, k=5):
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in asked:
        score = (x * x[q]).sum(1) / (norm * norm[q])
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:k]
        out[q] = [(i, score[i]) for i in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 32)).astype(np.float32).astype(float)
    x[700:760] = x[700]  # a common vector: ties go to the smaller id
    t = table(spark, rows_of(x, np.zeros(1500)))
    got = ann.nearest(t, t.where("vec_id % 50 = 0")).collect()
    asked = range(0, 1500, 50)
    want = exact(x, asked)
    found = {q: sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) for q in asked}
    assert all([r[0] for r in rows] == [1, 2, 3, 4, 5] for rows in found.values())
    hits = sum(len({r[1] for r in found[q]} & {i for i, _ in want[q]}) for q in asked)
    assert hits >= 0.9 * 5 * len(asked)
    assert [r[1] for r in found[700]] == [701, 702, 703, 704, 705]
    for q, rows in found.items():
        for _, i, s in rows:
            assert abs(s - float((x[q] * x[i]).sum() / np.sqrt((x[q] ** 2).sum() * (x[i] ** 2).sum()))) < 1e-12


def test_few_and_odd_candidates(spark):
    rows = [(0, [1.0, 0.0], 1, 0, ""), (50, [0.0, 1.0], 1, 0, ""), (3, None, 1, 0, ""), (100, [0.0, 0.0], 1, 0, ""), (4, [float("nan"), 0.0], 1, 0, "")]
    t = table(spark, rows)
    got = sorted(map(tuple, ann.nearest(t, t.where("vec_id % 50 = 0")).collect()))
    assert got == [(0, 1, 50, 0.0), (50, 1, 0, 0.0)]
    assert ann.nearest(table(spark, []), table(spark, [])).count() == 0


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 4))
    rows = [(i, [float(v) for v in (r[:3] if i % 3 == 0 else r)], 1, 0, "") for i, r in enumerate(x)]
    t = table(spark, rows, "double")
    got = ann.nearest(t, t.where("vec_id < 12"), recall=1.0).collect()
    for dim, ids in ((3, range(0, 60, 3)), (4, [i for i in range(60) if i % 3])):
        part = x[list(ids), :dim]
        norm = np.sqrt((part * part).sum(1))
        for at, q in enumerate(ids):
            if q < 12:
                order = [ids[j] for j in np.argsort(-(part @ part[at]) / norm) if j != at][:5]
                assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == order


def test_scan_abandons_no_neighbour_of_a_list():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1200, 48))
    q = rng.standard_normal((20, 48))
    at_q, at_r, score = ann.scan_list(np.arange(1200), x, np.full(20, -1), q, 5, ann.rotation(48))
    norm = np.sqrt((x * x).sum(1))
    hit = 0
    for n in range(20):
        true = np.argsort(-(x @ q[n]) / norm)[:5]
        hit += len(set(true) & set(at_r[at_q == n]))
    assert hit >= 97


def test_links_of_a_cone(spark):
    """Unrelated vectors share most sign bits and sort between the two of a link in every pass."""
    rng = np.random.default_rng(3)
    x = np.c_[np.full(1500, 40.0), rng.standard_normal((1500, 31))]
    x[1000:1040] = x[:40] + 0.6 * np.c_[np.zeros(40), rng.standard_normal((40, 31))]
    x *= 1 + rng.random((1500, 1))
    labels = np.zeros(1500, int)
    want = brute(x, labels, 0.995)
    assert 60 <= want[0].sum() <= 200
    got = vecdup.near_vectors(table(spark, rows_of(x, labels)), 0.995, window=4).orderBy("vec_id").collect()
    assert [r["n_links"] for r in got] == want[0].tolist()
    assert [r["component_id"] for r in got] == want[1].tolist()


def test_links_across_ranges(spark):
    """A group of near copies lies over many ranges of the order: members far apart by id still meet."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16))
    x[50:350] = x[50] + 0.001 * rng.standard_normal((300, 16))
    labels = np.zeros(400, int)
    want = brute(x, labels)
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = vecdup.near_vectors(table(spark, rows_of(x, labels)), window=16).orderBy("vec_id").collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert [r["n_links"] for r in got] == want[0].tolist()
    assert [r["component_id"] for r in got] == want[1].tolist()


def test_links_of_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8))
    labels = rng.integers(0, 2, 300)
    want = brute(x, labels, 0.8)
    monkeypatch.setattr(vecdup, "BLOCK_ROWS", 16)
    got = vecdup.near_vectors(table(spark, rows_of(x, labels)), 0.8, window=5).orderBy("vec_id").collect()
    assert want[0].sum() > 100
    assert [r["n_links"] for r in got] == want[0].tolist()
    assert [r["component_id"] for r in got] == want[1].tolist()
