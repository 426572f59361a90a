"""The pipeline's stages one by one on the small tables, and its odd rows."""

import re
from collections import Counter

import corpus_pipeline as cp
from tidemark.llm import mixing, neardup, packing, pii, quality
from tidemark.session import materialize

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    good = materialize(cp.quality_stage(spark, docs, SF))
    want = {r["doc_id"] for r in quality.graded_texts(docs, quality.ratings(labels)).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == want and good.columns == list(cp.COLUMNS)

    single = materialize(cp.near_dedup_stage(spark, good, SF))
    kept = {r["doc_id"] for r in neardup.near_duplicates(good).where("kept").collect()}
    assert {r["doc_id"] for r in single.collect()} == kept and single.columns == list(cp.COLUMNS)
    assert single.count() == len(kept) < good.count()

    clean = materialize(cp.pii_stage(spark, single, SF))
    crf = pii.train(pii.parse_labelled())
    rows = {r["doc_id"]: r for r in clean.collect()}
    assert set(rows) == kept and clean.columns == list(cp.COLUMNS)
    for i, r in rows.items():
        base, more = pii.find_spans([texts[i]], crf)[0]
        assert r["text"] == pii.redacted(texts[i], base + more)
        assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])
        assert base or more or r["text"] == texts[i]

    mixed = materialize(cp.mix_stage(spark, clean, SF))
    plan = {r["doc_id"]: r["copies"] for r in mixing.pareto_mix(clean).collect()}
    stands = Counter(r["doc_id"] for r in mixed.collect())
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in rows.items()}
    assert stands == Counter({i: n for i, n in plan.items() if n and words[i]})
    assert mixed.columns == list(cp.COLUMNS)

    packed = cp.pack_stage(spark, mixed, SF).collect()
    pieces = Counter((r["doc_id"], r["piece"], r["length"]) for r in packed)
    assert pieces == Counter((r["doc_id"], r["piece"], r["length"]) for r in packing.token_pieces(mixed).collect())
    load = Counter()
    for r in packed:
        load[r["sequence_id"]] += r["length"]
    assert max(load.values()) <= 2048


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some words of text here", "en", None, 23), (3, "some words of text here", "en", None, 23), (None, "no id", "en", "a", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int"
    spark.createDataFrame([(*r, 1) for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {3, None} and 3 in {r["doc_id"] for r in got}
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_texts_under_one_id_are_documents_of_their_own(spark):
    long = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(1, long[0]), (1, long[1]), (2, long[0]), (3, long[1]), (1, long[2]), (1, None), (1, ""), (1, None), (1, long[2]), (4, long[1] + " more"),
            (None, long[3]), (None, long[3]), (9, long[3]), (9, long[3])]
    docs = spark.createDataFrame([(i, t, "en", f"s{n % 3}", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [sorted(map(tuple, cp.near_dedup_stage(spark, d, SF).collect()), key=str) for d in (docs, docs.repartition(5))]
    assert kept[0] == kept[1]
    found = sorted(((r[0], r[1]) for r in kept[0]), key=str)
    want = [(1, long[0]), (1, long[1]), (1, long[2]), (1, None), (1, ""), (None, long[3]), (None, long[3]), (9, long[3])]
    assert found == sorted(want, key=str)
    classes = neardup.near_duplicates(docs).collect()
    of = {(r["doc_id"], r["raw"]): (r["class_id"], r["class_raw"]) for r in classes}
    assert len({of[k] for k in of if k[0] in (1, 2, 3, 4)}) == 5  # three texts, no text and the empty one


def test_entry_lists_pipeline_and_operators():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
