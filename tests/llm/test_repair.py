"""Exact round trips of the shard format."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import repair
from tidemark.llm.tokens import default_tokenizer


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=60), max_size=12))
def test_round_trip(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    lengths = np.array([len(d) for d in docs], np.int64)
    shard = repair.Shard(repair.write_shard(ids, lengths, 7))
    assert shard.decode().tolist() == ids.tolist()
    assert [shard.document(i).tolist() for i in range(len(docs))] == docs


def test_repeats_shrink_and_ranges_decode():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 49_000, 50)
    ids = np.concatenate([phrase] * 200 + [rng.integers(0, 49_000, 100)] + [np.zeros(1001, int)]).astype(np.uint32)
    data = repair.write_shard(ids, np.array([len(ids)]), 49_408)
    assert len(data) < ids.nbytes / 10
    shard = repair.Shard(data)
    assert int(shard.ends[-1]) == len(ids)
    for a, b in ((0, 0), (0, 1), (3, 4000), (9990, 10_150), (len(ids) - 5, len(ids))):
        assert shard.decode_range(a, b).tolist() == ids[a:b].tolist()


def test_grammar_is_well_formed():
    ids = np.tile(np.arange(8, dtype=np.uint32), 100)
    seq, left, right, lengths = repair.compress(ids, 8, min_count=2)
    whole: list[list[int]] = [[x] for x in range(8)]
    for k, (a, b) in enumerate(zip(left, right, strict=True)):
        assert max(a, b) < 8 + k
        whole.append(whole[a] + whole[b])
        assert lengths[k] == len(whole[-1])
    pool, begin = repair.rule_pool(left, right, lengths, 8)
    assert [pool[s : s + n].tolist() for s, n in zip(begin, lengths, strict=True)] == whole[8:]
    assert len(seq) < 20


def test_overlapping_pairs_go_left():
    assert repair._starts(np.array([True, True, True, False, True])).tolist() == [0, 2, 4]
    shard = repair.Shard(repair.write_shard(np.zeros(33, np.uint32), np.array([33]), 1))
    assert shard.decode().tolist() == [0] * 33


def test_no_frequent_pair_is_left():
    """One pair of many uses, and many rare ones that wait for it."""
    rng = np.random.default_rng(1)
    rare = np.repeat(np.arange(100, 1_100, dtype=np.uint32).reshape(-1, 2), 12, axis=0)
    parts = [np.tile(np.array([[1, 2]], np.uint32), (5_000, 1)), rare, rng.integers(2_000, 40_000, (260_000, 2)).astype(np.uint32)]
    ids = rng.permutation(np.concatenate(parts)).ravel()
    seq, left, right, _ = repair.compress(ids, 49_408)
    _, count = np.unique(repair._pairs(seq), return_counts=True)
    assert count.max() < repair.MIN_COUNT
    assert len(left) >= 501


def test_files(spark, tmp_path):
    texts = ["b a", None, "", "x " * 5000, "same", "same"]
    keys = [5, 3, None, 1, 9, 9]
    docs = spark.createDataFrame(list(zip(keys, texts, [1] * 6, strict=True)), "doc_id long, text string, shard int")
    path = str(tmp_path / "shards")
    repair.encode_shards(docs, path, shard_ids=1_000)
    rows = repair.read_shards(spark, path).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 3, 5, 9, 9]
    tok = Tokenizer.from_file(default_tokenizer())
    start = 0
    for r, text in zip(rows, ["", "x " * 5000, "", "b a", "same", "same"], strict=True):
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = str(tmp_path / "none")
    repair.encode_shards(docs, path)
    assert repair.read_shards(spark, path).count() == 0
