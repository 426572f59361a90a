"""Compiled transducers against the tokenizer library."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import tokencount, transducer
from tidemark.llm.tokens import default_tokenizer
from tidemark.llm.transducer import TokenCounter, scan

DOCS = "doc_id long, text string, n_tokens string, n_bytes int"
TEXTS = [
    "", None, "Hello, world.", "a b  c\n\n d\t e", "naïve ÜBER Straße don't we'll 3.14 x²", "<|endoftext|> <|x A.B.C... wait!?",
    "<|endoftext|≯a<|startoftext|>'s", "ß ẞ İ ı Σας éâ  nbsp em", "x" * 3_000, "tion heast " * 500, "日本語 テスト 한국어",
    "'s't're've'm'll'd 'save 'r 've'l ''ll !'s a'!", "\x00\x1c\x85​", "áệ", "12345", "don'" * 50,
]
PARTS = [
    "a", "The", "'s", "'", "'r", "'re", "ll", "don", "é", "É", "12", "3", "***", "_", "-", "<|endoftext|>", "<|", "|>", "<", ".", "!?",
    "̸", "́", "~", "İ", "Σ", "日本", " ", " ", "\t", "​", "ing", "tion", "\n",
]
OPEN: list[Tokenizer] = []


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(default_tokenizer())
    return lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(default_tokenizer())


def texts_of(seed, n):
    rng = random.Random(seed)
    found = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 30))) for _ in range(n)]
    found += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    return found + ["".join(rng.choice("aehtinx.'") for _ in range(rng.randrange(1, 900))) for _ in range(n // 10)]


def test_random_texts(counter, library):
    texts = [t or "" for t in TEXTS] + texts_of(0, 2_000)
    assert counter.counts(texts) == [library(t) for t in texts]
    assert [counter.counts([t])[0] for t in texts[:300]] == [library(t) for t in texts[:300]]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_characters(text):
    if not OPEN:
        OPEN.append(Tokenizer.from_file(default_tokenizer()))
    assert transducer.token_counter(default_tokenizer()).counts([text]) == [len(OPEN[0].encode(text, add_special_tokens=False).ids)]


@pytest.mark.parametrize(("chunk", "warm", "block"), [(16, 3, 1_000), (7, 7, 50), (64, 1, 100_000)])
def test_small_chunks_and_blocks_change_nothing(monkeypatch, library, chunk, warm, block):
    monkeypatch.setattr(transducer, "CHUNK", chunk)
    monkeypatch.setattr(transducer, "WARM", warm)
    monkeypatch.setattr(transducer, "BLOCK", block)
    monkeypatch.setattr(transducer, "STATES", 5_000)
    rng = random.Random(5)
    texts = [t or "" for t in TEXTS] + texts_of(1, 40)
    texts += ["ab" * 4_000, "x" * 3_000, "'s're" * 300, "abcdefgh" * 300, " \\n'll" * 100]
    texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz' é日.") for _ in range(3_000)))
    assert TokenCounter(default_tokenizer()).counts(texts) == [library(t) for t in texts]


def test_maps_compose_by_scan():
    run = np.array([0, 0, 0, 1, 2, 2, 2, 2, 2])
    before = np.array([0, 4, 5, 0, 0, 1, 2, 3, 4])
    after = np.array([4, 5, 0, 0, 1, 2, 3, 4, 0])
    gained = np.arange(9)
    assert scan(run, before, after, gained).tolist() == [0, 1, 3, 3, 4, 9, 15, 22, 30]
    with pytest.raises(ValueError, match="do not meet"):
        scan(run, before, np.zeros(9, np.int64), gained)


def test_very_long_runs_without_ascii(counter, library):
    texts = ["日本語" * 40_000, "привет" * 20_000, "́" * 70_000, "한국" * 40_000]
    assert counter.counts(texts) == [library(t) for t in texts]


def test_rows(spark, library):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(3, "other", "", 0), (None, "no id", "", 0), (3, "other", "", 0)]
    got = tokencount.count_tokens(spark.createDataFrame(rows, DOCS), limit=12).collect()
    want = [(k, len((t or "").encode()), library(t), library(t) > 12) for k, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokencount.count_tokens(spark.createDataFrame([], DOCS)).collect() == []


def test_other_kinds_are_refused():
    with pytest.raises(ValueError, match="not a tokenizer of the kind"):
        TokenCounter(default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k"))
