"""Fill-in-the-middle by sorted pieces against whole texts in plain Python."""

import hashlib
import random
import re

import pytest

from tidemark.llm import middle

DOCS = "doc_id long, text string, form string, piece int, _row long"
TEXTS = [
    None, "", "a", "one two", "keeps <P> marks", "<S", "ab<" * 40, "x" * 700, "é漢字 mixed ünits 12", "<M>", "line\nline\r\n\x00 end",
    "😀 pairs 😀", "<P<S<M " * 30, "same", "same",
]


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(texts):
    found = [(i, t, "clash", 1, 2) for i, t in enumerate(texts)]
    return [*found, (3, "another text of an id", None, None, None), (None, "no id", "", 0, 0), (3, texts[3], "", 0, 0)]


@pytest.mark.parametrize("piece", [1, 3, 65_536])
def test_digests_are_those_of_whole_texts(spark, monkeypatch, piece):
    # (Functions run in workers that import the module anew: the limits travel as defaults of the local run below.)
    data = rows(TEXTS * 6)
    if piece == 65_536:
        got = middle.fill_in_middle(spark.createDataFrame(data, DOCS)).collect()
        got = sorted(map(tuple, got), key=str)
    else:
        monkeypatch.setattr(middle, "PIECE", piece)
        monkeypatch.setattr(middle, "PART", 5)
        got = sorted((local(key, text) for key, text, *_ in data), key=str)
    want = []
    for key, text, *_ in data:
        n, form, a, b, out = brute(key, text)
        want.append((key, n, form, a, b, sha(out), sha(text or "")))
    assert got == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def local(key, text):
    """One document through the pieces, the parser and the restoring sort, without Spark."""
    text, packer = text or "", middle.Packer(b"")
    cut = middle.cut_text(key, text)
    lengths = (None, None) if cut.form == "plain" else (cut.first, cut.second - cut.first)
    stream = [((7, n), packer.pack(p)) for n, p in enumerate(middle._pieces(text, cut))]
    stream[0] = (7, 0), (key, cut.n, cut.form, *lengths, stream[0][1])
    return next(middle._digests(sorted(middle._restoring(stream), key=lambda kv: kv[0])))


def test_marks_cut_between_pieces():
    rng = random.Random(1)
    for _ in range(500):
        parts = ["".join(rng.choice("<PSM>ab") for _ in range(rng.randrange(6))) for _ in range(3)]
        if any(m in p for p in parts for m in ("<P>", "<S>", "<M>")):
            continue
        p, m, s = parts
        text = f"<S>{s}<P>{p}<M>{m}"
        parser, got = middle.Parser("spm"), {0: "", 1: "", 2: ""}
        at = 0
        while at < len(text):
            step = rng.randrange(1, 4)
            for segment, part in parser.feed(text[at : at + step]):
                got[segment] += part
            at += step
        for segment, part in parser.close():
            got[segment] += part
        assert got == {0: p, 1: m, 2: s}


def test_output_texts_and_long_ones(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abc é\n.") for _ in range(300_000))
    data = [(i, t, "", 0, 0) for i, t in enumerate([*TEXTS, long, long + "x", long[5:], long * 4])]
    found = middle.outputs(spark.createDataFrame(data, DOCS)).collect()
    texts = {}
    for r in sorted(found, key=lambda r: (r["_row"], r["place"])):
        texts[r["doc_id"]] = texts.get(r["doc_id"], "") + r["piece"]
        assert len(r["piece"]) <= middle.PIECE + 3
    assert {k: texts.get(k, "") for k, *_ in data} == {k: brute(k, t)[4] for k, t, *_ in data}
    got = {r["doc_id"]: r for r in middle.fill_in_middle(spark.createDataFrame(data, DOCS)).collect()}
    assert all(got[k]["output_sha256"] == sha(brute(k, t)[4]) and got[k]["restored_sha256"] == sha(t or "") for k, t, *_ in data)


def test_empty_table(spark):
    assert middle.fill_in_middle(spark.createDataFrame([], DOCS)).collect() == []
    assert middle.outputs(spark.createDataFrame([], DOCS)).collect() == []
