"""Packing against the tokenizer itself and against a plain best-fit loop."""

import random
import zlib
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.tokens import WordIds, default_tokenizer

DOCS = "doc_id long, text string, sequence_id string, length int"
TEXTS = [
    "", None, "Hello, world.", "a b  c\n\n d\t e", "naïve ÜBER Straße don't we'll 3.14 x²", "<|endoftext|> <|x A.B.C... wait!?",
    "word*** $$$ foo,bar;baz:", "ß ẞ İ ı Σας éâ  nbsp em", "x" * 500, "tion heast " * 3000, "日本語 テスト 한국어",
]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "clash", 1) for i, t in enumerate(texts)], DOCS)


def ids_of(tok, text):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_words_put_together_are_the_whole_text():
    tok, words = Tokenizer.from_file(default_tokenizer()), WordIds(default_tokenizer())
    assert words.direct
    for t in TEXTS:
        assert words.text(t or "") == np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_random_texts_too():
    tok, words, rng = Tokenizer.from_file(default_tokenizer()), WordIds(default_tokenizer()), random.Random(0)
    parts = ["a", "The", "'s", "don", "é", "É", "12", "3", "***", "_", "-", "<|endoftext|>", "<|", "|>", "<", "|", ".", "!?", "=", "\u0338", "\u0301",
             "~", "İ", "Σ", "日本", " ", "\u00a0", "\t", "\u200b", "@", "[at]"]
    for _ in range(5000):
        text = "".join(rng.choice([*parts, " ", "\n"]) for _ in range(rng.randrange(1, 9)))
        assert words.text(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_a_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr("tidemark.llm.tokens.WORDS_KEPT", 3)
    tok, words = Tokenizer.from_file(default_tokenizer()), WordIds(default_tokenizer())
    text = "one two three, four five! one two six seven (one) eight two nine one"
    for _ in range(3):
        assert words.text(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(words) <= 3 and len(words.older) <= 3


def test_pieces_and_places(spark):
    tok = Tokenizer.from_file(default_tokenizer())
    rows = packing.pack_documents(frame(spark, TEXTS), 64).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert sorted(by_doc) == list(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        ids = ids_of(tok, text)
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), 64))
        for r in pieces:
            part = ids[r["start"] : r["start"] + 64]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(places))
        assert sum(n for _, n in places) <= 64
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 64) + 3


def test_empty_table_and_repeated_rows(spark):
    assert packing.pack_documents(frame(spark, [])).count() == 0
    twice = frame(spark, ["same text"] * 3).union(frame(spark, ["same text"] * 3))
    rows = packing.pack_documents(twice).collect()
    assert len(rows) == 6 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 6


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(1)
    demand = rng.uniform(0.02, 0.6, (400, 3))
    bins = packing.best_fit(demand, np.array([1.0, 0.5, 0.5]), rule)
    load = np.zeros((bins.max() + 1, 3))
    np.add.at(load, bins, demand)
    assert load.max() <= 1 + 1e-6
    assert sorted(set(bins)) == list(range(bins.max() + 1))


def test_one_capacity_is_best_fit_decreasing():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 100, 300)
    room = []
    for s in sorted(size, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= s
        else:
            room.append(100 - s)
    bins = packing.best_fit(size[:, None] / 100.0, np.array([1.0]))
    assert bins.max() + 1 == len(room)


def test_capacities_other_than_tokens_bind(spark):
    docs = frame(spark, ["a b c"] * 20)
    rows = packing.pack_documents(docs, 64, max_documents=4).collect()
    count = {}
    for r in rows:
        count[r["sequence_id"]] = count.get(r["sequence_id"], 0) + 1
    assert max(count.values()) == 4 and len(count) == 5
    rows = packing.pack_documents(docs, 64, max_attention=32.0).collect()  # a piece costs 16
    assert len({r["sequence_id"] for r in rows}) == 10


def test_an_item_over_a_capacity_is_refused(spark):
    items = spark.createDataFrame([(1, 5.0)], "length long, cost double")
    with pytest.raises(Exception, match="exceeds a capacity"):
        packing.pack(items, {"cost": (4.0, 1.0)}).collect()
    with pytest.raises(ValueError):
        packing.pack(items, {"cost": (0.0, 1.0)})


def test_short_items_fill_few_more_sequences_than_needed(spark):
    items = spark.range(40_000).withColumn("length", F.lit(2))
    got = packing.pack(items, {"length": (2_048, 1.0)}, block_items=1_500).select("sequence_id").distinct().count()
    assert got == -(-80_000 // 2_048)
