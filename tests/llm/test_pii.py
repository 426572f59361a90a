"""Patterns against plain regular expressions, and the CRF against its table and unseen forms."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from tidemark.llm import pii


def plain(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_patterns_match_plain_search():
    rng = random.Random(0)
    parts = ["a.b@c.d", "@", "x@y", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "+", "12", ".", " ", "-", "é", "a", "007.0.0.1", "@b.c", "x@y.z@w.v", "\n", "٣", "4", "1.", "5555555555554444"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))
        assert pii.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a@" * 150_000, "a" * 300_000 + "@", "+1" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


def test_labelled_table_and_unseen_forms():
    rows = pii.parse_labelled()
    crf = pii.train(rows)
    tags = crf.decode([w for w, _ in rows])
    wrong = sum((t != np.array(g)).sum() for t, (_, g) in zip(tags, rows, strict=True))
    assert wrong <= 0.01 * sum(len(w) for w, _ in rows)
    new = {
        "please call 555-987-6543 soon": [("crf_phone", 12, 24)],
        "tel 020 7123 4567 now": [("crf_phone", 4, 17)],
        "card 3782 822463 10005 expires": [("crf_card", 5, 22)],
        "write kim [at] example.net today": [("crf_email", 6, 26)],
    }
    for text, spans in new.items():
        assert pii.find_spans([text], crf) == [([], spans)], text
    for text in ("in 2024 version 3.0. of 12 tables", "scores were 3-2 and 21-15", "password=a1b2c3d4e5", "0xdeadbeef 1234567", "Wh 9.9. er 3. on"):
        assert pii.find_spans([text], crf) == [([], [])], text


def test_spans_deep_in_a_long_chain():
    """No span is torn, wherever in a chain of digit-dense words it lies."""
    crf = pii.train(pii.parse_labelled())
    for k in range(16):
        before = "chapter 4 section 12 page 345 " * 85 + "room 101 " * k
        text = before + "text 555 010 4477 for help " + "chapter 4 section 12 page 345 " * 90
        assert pii.find_spans([text], crf) == [([], [("crf_phone", len(before) + 5, len(before) + 17)])], k


def test_long_chains_decode_like_short_ones(monkeypatch):
    rows = [w * 7 for w, _ in pii.parse_labelled()]
    crf = pii.train(pii.parse_labelled())
    want = crf.decode(rows)
    monkeypatch.setattr(pii, "LONG_CHAIN", 3)
    got = crf.decode(rows)
    assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    emit, moves, first = rng.standard_normal((6, 5, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    lengths = np.array([1, 2, 3, 4, 5, 5])
    for n, tags in enumerate(pii.viterbi(emit, lengths, moves, first)):
        best = max(
            np.ndindex(*(3,) * lengths[n]),
            key=lambda p: first[p[0]] + sum(emit[n, t, k] for t, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False)),
        )
        assert tuple(tags) == best


def test_rows(spark):
    texts = [None, "", "mail a@b.co and 10.1.2.3 é +1 (555) 123-4567", "clean text", "clean text"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.personal_data(docs, redact=True).collect()}
    r = got[2]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 0, 1)
    assert r["spans"].startswith("email:5:11,ip:16:24,phone:27:44")
    assert r["base_sha256"] == hashlib.sha256(b"email:5:11,ip:16:24,phone:27:44").hexdigest()
    assert r["redacted"] == "mail [EMAIL] and [IP] é [PHONE]"
    for i in (0, 1, 3, 4):
        assert got[i]["spans"] == "" and got[i]["base_sha256"] == hashlib.sha256(b"").hexdigest()
        assert got[i]["redacted"] == texts[i]
    assert pii.personal_data(docs.limit(0)).count() == 0


@pytest.mark.parametrize("spans,want", [([("ip", 0, 3), ("card", 2, 6)], "[IP]gh"), ([], "abcdefgh"), ([("ip", 6, 8)], "abcdef[IP]")])
def test_redacted(spans, want):
    assert pii.redacted("abcdefgh", spans) == want


def test_long_words_are_read_whole():
    crf = pii.train(pii.parse_labelled(pii.LABELLED))
    for n in (60, 90, 500, 5_000):
        text = "mail " + "x" * n + "[at]example.com today"
        assert pii.find_spans([text], crf)[0][1] == [("crf_email", 5, 5 + n + len("[at]example.com"))], n


def test_taken_places_match_a_scan():
    rng = random.Random(3)
    for _ in range(500):
        spans = [("x", a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(6)))]
        taken = pii.Taken(spans)
        for _ in range(20):
            start = rng.randrange(70)
            end = start + rng.randrange(1, 6)
            assert taken.meets(start, end) == any(not (end <= a or start >= b) for _, a, b in spans)


def test_many_spans_take_linear_time():
    crf = pii.train(pii.parse_labelled(pii.LABELLED))
    line = "mail a.b%d@example.com or call 555 010 %04d from 10.0.0.%d\n"
    took = []
    for n in (1_000, 4_000):
        text = "".join(line % (i, i % 10_000, i % 256) for i in range(n))
        start = time.process_time()
        pii.find_spans([text], crf)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0]
