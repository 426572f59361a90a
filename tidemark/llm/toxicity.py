"""Toxicity: a linear-chain CRF over words, its marginals gathered to document scores and offsets."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, text_window

WORD = re.compile(r"[^\W\d_]+")
CELLS = 1 << 20
PARTS = 5
BLOCK = 64
# The bounded sample the model is fitted on: rows of each label, of at most so many characters.
SAMPLE_ROWS = 2_500
SAMPLE_CHARS = 20_000
WINDOW = 24
WINDOWS = 12_000
WORDS_KEPT = 200_000
LEAST_G2 = 18.0
FLAG = 0.5
FAINT = 0.05
# Log-odds of a cell the sample has not shown: such words are likelier clean.
UNSEEN = -0.5
THRESHOLD = 0.3


def word_cells(word: str) -> tuple[int, ...]:
    """Hashed cells of a word: itself, its first 3, 4 and 5 letters and its last 4."""
    parts = (f"w{word}", f"3{word[:3]}", f"4{word[:4]}", f"5{word[:5]}", f"s{word[-4:]}")
    return tuple(xxhash.xxh3_64_intdigest(p.encode()) % CELLS for p in parts)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class ToxicCrf:
    """Two labels. ``weights``: log-odds by cell; ``moves``: log potentials from label to label, a text
    starting after a clean word; ``document``: weights of what a text's marginals say."""

    def __init__(self, weights: np.ndarray, bias: float, moves: np.ndarray, document: np.ndarray) -> None:
        self.weights, self.bias, self.moves, self.document = weights, bias, moves, document
        self.seen: dict[str, float] = {}

    def __getstate__(self) -> tuple:
        return self.weights, self.bias, self.moves, self.document

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def odds(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > WORDS_KEPT:
            seen.clear()
        for word in words:
            if word not in seen:
                total = self.bias + float(self.weights[list(word_cells(word))].sum())
                seen[word] = min(30.0, max(-30.0, total))
        return np.fromiter(map(seen.__getitem__, words), np.float64, len(words))

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """P(toxic) of every word of each text, exact for any length."""
        return chain_marginals([self.odds(w) for w in texts], self.moves)

    def score(self, p: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(gathered(p) @ self.document, -30, 30))))


def gathered(p: np.ndarray) -> np.ndarray:
    """What a document's marginals say: constant, largest, expected number, expected share.

    Marginals under ``FAINT`` are left out of the sums: in a long clean text they would add up.
    """
    words = len(p)
    p = p[p >= FAINT]
    if not len(p):
        return np.array([1.0, 0.0, 0.0, 0.0])
    total = float(p.sum())
    return np.array([1.0, float(p.max()), np.log1p(total), total / (words + 10.0)])


def chain_marginals(odds: list[np.ndarray], moves: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """Forward-backward over many chains in blocks of words.

    Each block's transfer matrix is a product of 2 x 2 steps, made for all blocks at once; a short scan
    over a chain's blocks gives the messages at their edges; then every block is filled in at once. The
    result is that of one pass over the whole chain.
    """
    lengths = np.array([len(o) for o in odds])
    blocks = -(-lengths // block)
    n = int(blocks.sum())
    if not n:
        return [np.zeros(0) for _ in odds]
    first = np.cumsum(blocks) - blocks
    e = np.zeros((n, block))
    live = np.zeros((n, block), bool)
    for i, o in enumerate(odds):
        if len(o):
            at = slice(first[i], first[i] + blocks[i])
            e[at].reshape(-1)[: len(o)] = o
            live[at].reshape(-1)[: len(o)] = True
    step = np.exp(moves - moves.max())
    phi = np.exp(e)

    def ahead(v0: np.ndarray, v1: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        a = v0 * step[0, 0] + v1 * step[1, 0]
        b = (v0 * step[0, 1] + v1 * step[1, 1]) * phi[:, t]
        s = a + b
        on = live[:, t]
        return np.where(on, a / s, v0), np.where(on, b / s, v1)

    # Transfer of each block: where a chain in label 0, and one in label 1, comes out, with its weight.
    cols = []
    for start in (0, 1):
        v = [np.full(n, 1.0 - start), np.full(n, float(start))]
        log_scale = np.zeros(n)
        for t in range(block):
            a = v[0] * step[0, 0] + v[1] * step[1, 0]
            b = (v[0] * step[0, 1] + v[1] * step[1, 1]) * phi[:, t]
            s = a + b
            on = live[:, t]
            v = [np.where(on, a / s, v[0]), np.where(on, b / s, v[1])]
            log_scale += np.where(on, np.log(s), 0.0)
        cols.append((v[0], v[1], log_scale))
    top = np.maximum(cols[0][2], cols[1][2])
    g0, g1 = np.exp(cols[0][2] - top), np.exp(cols[1][2] - top)
    m = np.array([[cols[0][0] * g0, cols[0][1] * g0], [cols[1][0] * g1, cols[1][1] * g1]])

    begin = np.zeros((2, n))
    finish = np.ones((2, n))
    order = np.argsort(-blocks, kind="stable")
    v = np.zeros((2, len(odds)))
    v[0] = 1.0
    for k in range(int(blocks.max())):
        docs = order[: int((blocks > k).sum())]
        at = first[docs] + k
        begin[:, at] = v[:, docs]
        a = v[0, docs] * m[0, 0, at] + v[1, docs] * m[1, 0, at]
        b = v[0, docs] * m[0, 1, at] + v[1, docs] * m[1, 1, at]
        v[0, docs], v[1, docs] = a / (a + b), b / (a + b)
    v = np.ones((2, len(odds)))
    for k in range(int(blocks.max()) - 1, -1, -1):
        docs = order[: int((blocks > k).sum())]
        at = first[docs] + k
        finish[:, at] = v[:, docs]
        a = m[0, 0, at] * v[0, docs] + m[0, 1, at] * v[1, docs]
        b = m[1, 0, at] * v[0, docs] + m[1, 1, at] * v[1, docs]
        v[0, docs], v[1, docs] = a / (a + b), b / (a + b)

    f0, f1 = np.empty((n, block)), np.empty((n, block))
    v0, v1 = begin[0], begin[1]
    for t in range(block):
        v0, v1 = ahead(v0, v1, t)
        f0[:, t], f1[:, t] = v0, v1
    b0, b1 = finish[0], finish[1]
    p = np.zeros((n, block))
    for t in range(block - 1, -1, -1):
        toxic = f1[:, t] * b1
        p[:, t] = toxic / (f0[:, t] * b0 + toxic)
        w1 = phi[:, t] * b1
        x0 = step[0, 0] * b0 + step[0, 1] * w1
        x1 = step[1, 0] * b0 + step[1, 1] * w1
        s, on = x0 + x1, live[:, t]
        b0, b1 = np.where(on, x0 / s, b0), np.where(on, x1 / s, b1)
    return [p[first[i] : first[i] + blocks[i]].reshape(-1)[: lengths[i]] for i in range(len(odds))]


class Vocabulary:
    """Numbers of the sample's words and their cells."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.cells: list[tuple[int, ...]] = []

    def codes(self, words: list[str]) -> np.ndarray:
        for w in words:
            if w not in self.number:
                self.number[w] = len(self.number)
                self.cells.append(word_cells(w))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def table(self) -> np.ndarray:
        return np.array(self.cells, np.int64).reshape(-1, PARTS)


def families(docs: list[np.ndarray]) -> np.ndarray:
    """A number per text that near-copies tend to share: the least hash of its runs of five words."""
    out = np.zeros(len(docs), np.uint64)
    for i, codes in enumerate(docs):
        h = np.zeros(max(1, len(codes) - 4), np.uint64)
        for j in range(min(5, len(codes))):
            part = codes[j : len(codes) - 4 + j] if len(codes) >= 5 else codes[j : j + 1]
            h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[i] = h.min()
    return out


def marking_cells(docs: list[np.ndarray], toxic: np.ndarray, family: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Cells that mark toxic texts: in at least 4 families of copies, rare or absent in clean ones, and
    more than chance allows (a likelihood ratio statistic from ``LEAST_G2`` up)."""
    cells, inverse = np.unique(table, return_inverse=True)
    inverse = inverse.reshape(table.shape)
    count = np.zeros((2, len(cells)))
    size = np.zeros(2)
    done: set[tuple[int, bool]] = set()
    for codes, label, fam in zip(docs, toxic, family, strict=True):
        key = (int(fam), bool(label))
        if key in done:
            continue
        done.add(key)
        size[int(label)] += 1
        count[int(label), np.unique(inverse[np.unique(codes)])] += 1
    good, bad = count
    share = size[1] / max(1.0, size.sum())
    seen = good + bad
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (bad * np.log(bad / (seen * share)) + np.where(good > 0, good * np.log(good / (seen * (1 - share))), 0.0))
        ratio = (bad / size[1]) / ((good + 0.5) / max(1.0, size[0]))
    mark = np.zeros(len(cells), bool)
    mark[(bad >= 4) & (g2 >= LEAST_G2) & (ratio > 12)] = True
    return mark[inverse].any(axis=1)


def labelled_windows(
    docs: list[np.ndarray], toxic: np.ndarray, marked: np.ndarray, window: int = WINDOW, windows: int = WINDOWS, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """Windows of word numbers with a label per word (-1 past the end): toxic where a marked word stands in
    a toxic text. All windows with such a word, and others by chance, up to ``windows``."""
    rng = np.random.default_rng(seed)
    hot, cold = [], []
    for codes, label in zip(docs, toxic, strict=True):
        tags = marked[codes] & bool(label)
        for at in range(0, len(codes), window):
            (hot if tags[at : at + window].any() else cold).append((codes[at : at + window], tags[at : at + window]))
    hot = [hot[i] for i in rng.permutation(len(hot))[: windows // 2]]
    cold = [cold[i] for i in rng.permutation(len(cold))[: windows - len(hot)]]
    rows = hot + cold
    x = np.zeros((len(rows), window), np.int64)
    y = np.full((len(rows), window), -1, np.int64)
    for i, (codes, tags) in enumerate(rows):
        x[i, : len(codes)], y[i, : len(codes)] = codes, tags
    return x, y


def fit_chain(
    x: np.ndarray, y: np.ndarray, table: np.ndarray, rounds: int = 30, rate: float = 0.2, decay: float = 0.2
) -> ToxicCrf:
    """CRF weights by Adam on exact gradients; ``y`` is -1 past a window's end."""
    n, steps = x.shape
    live = y >= 0
    words, code = np.unique(x, return_inverse=True)
    code = code.reshape(x.shape)
    cells, part = np.unique(table[words], return_inverse=True)
    part = part.reshape(-1, PARTS)
    theta = [np.zeros(len(cells)), np.array(-3.0), np.log(np.array([[0.95, 0.05], [0.7, 0.3]]))]
    mean, var = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    gold = (y == 1).astype(float)
    gold_pair = np.zeros((2, 2))
    last = np.zeros(n, np.int64)
    for t in range(steps):
        on = live[:, t]
        np.add.at(gold_pair, (last[on], y[on, t]), 1.0)
        last = np.where(on, np.maximum(y[:, t], 0), last)
    for step in range(1, rounds + 1):
        e = (theta[0][part].sum(axis=1) + theta[1])[code]
        p, pair = _window_marginals(e, live, theta[2])
        off = np.where(live, p - gold, 0.0)
        by_word = np.bincount(code.ravel(), off.ravel(), len(words))
        g = [
            np.bincount(part.ravel(), np.repeat(by_word, PARTS), len(cells)) + decay * theta[0],
            off.sum(),
            pair - gold_pair + decay * theta[2],
        ]
        for i in range(3):
            mean[i] = 0.9 * mean[i] + 0.1 * g[i]
            var[i] = 0.99 * var[i] + 0.01 * g[i] * g[i]
            theta[i] = theta[i] - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-8)
    weights = np.full(CELLS, UNSEEN, np.float32)
    weights[cells] = theta[0]
    return ToxicCrf(weights, float(theta[1]), theta[2], np.zeros(4))


def fit_texts(texts: list[list[str]], toxic: np.ndarray, weight: np.ndarray) -> ToxicCrf:
    """The chain of all texts, with document weights learned from texts their chain has not seen.

    Families of copies fall into two halves; the chain of each scores the other.
    """
    vocabulary = Vocabulary()
    docs = [vocabulary.codes(w) for w in texts]
    table = vocabulary.table()
    family = families(docs)

    def chain(at: np.ndarray) -> ToxicCrf:
        part = [docs[i] for i in at]
        marked = marking_cells(part, toxic[at], family[at], table)
        return fit_chain(*labelled_windows(part, toxic[at], marked), table)

    half = (family % np.uint64(2)).astype(bool)
    x = np.zeros((len(docs), 4))
    x[:, 0] = 1.0
    for side in (half, ~half):
        learn, told = np.flatnonzero(~side), np.flatnonzero(side)
        if len(told) and toxic[learn].any() and not toxic[learn].all():
            marks = chain(learn).marginals([texts[i] for i in told])
            x[told] = [gathered(p) for p in marks]
    crf = chain(np.arange(len(docs)))
    crf.document = fit_document(x, toxic.astype(float), weight / weight.mean())
    return crf


def _window_marginals(e: np.ndarray, live: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the words and expected label pairs, a window starting after a clean word."""
    n, steps = e.shape
    step = np.exp(moves - moves.max())
    phi = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], axis=2)
    f = np.zeros((n, steps + 1, 2))
    f[:, 0, 0] = 1.0
    for t in range(steps):
        v = (f[:, t] @ step) * phi[:, t]
        f[:, t + 1] = np.where(live[:, t, None], v / v.sum(axis=1, keepdims=True), f[:, t])
    b = np.ones((n, 2))
    p = np.zeros((n, steps))
    pair = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        on = live[:, t]
        node = f[:, t + 1] * b
        p[:, t] = node[:, 1] / node.sum(axis=1)
        joint = f[:, t, :, None] * step * (phi[:, t] * b)[:, None, :]
        pair += (joint[on] / joint[on].sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        v = (phi[:, t] * b) @ step.T
        b = np.where(on[:, None], v / v.sum(axis=1, keepdims=True), b)
    return p, pair


def fit_document(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, decay: float = 1e-2) -> np.ndarray:
    """Logistic weights from gathered marginals to the document label, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + decay * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + decay * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w = w - move * min(1.0, 4.0 / max(1e-12, float(np.abs(move).max())))
    return w


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id's text has remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS,
) -> ToxicCrf:
    """Fit on a bounded sample: per label the ``sample_rows`` rows of lowest hash among those that may be
    learned from; of a text longer than ``sample_chars`` characters, that many from a place named by its id.
    A label of which no text is found is warned of. Label shares come from all such rows."""
    given = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("int").alias("_y"))
    given = given.where(F.col("_y").isin(0, 1) & ~held_out(id_col))
    shares = {r["_y"]: r["n"] for r in given.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    parts = [given.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))
    # The sample has at most twice sample_rows ids: the texts need no shuffle to meet it.
    rows = rows.join(F.broadcast(sample), id_col).select(id_col, "_y", text_window("_text", id_col, sample_chars)).collect()
    rows = sorted((r["_y"], r[id_col], r["_text"]) for r in rows if r["_text"] is not None)
    missing = {y for y, n in shares.items() if n} - {r[0] for r in rows}
    if missing:
        warnings.warn(f"no text to learn toxic = {sorted(missing)} from", stacklevel=2)
    texts = [words_of(r[2]) for r in rows]
    toxic = np.array([r[0] for r in rows], bool)
    if not toxic.any() or toxic.all():  # nothing to tell apart: the share of the label is the score
        share = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1.0)
        flat = np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0])
        return ToxicCrf(np.zeros(CELLS, np.float32), -4.0, np.zeros((2, 2)), flat)
    weight = np.where(toxic, shares[1] / toxic.sum(), shares[0] / (~toxic).sum())
    return fit_texts(texts, toxic, weight)


def toxic_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, held_out, score, predicted, offsets: one row per document, over its whole text.

    ``offsets`` lists start:end (code points) of words whose marginal reaches ``FLAG``. Empty and null
    texts get the score of a text without words. Repeated rows give repeated rows; an empty table none.
    Only texts enter a score; rows that ``held_out`` names are never learned from.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("offsets", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            marks = crf.marginals([words_of(t) for t in texts])
            scores, offsets = [], []
            for text, p in zip(texts, marks, strict=True):
                scores.append(crf.score(p))
                flagged = np.flatnonzero(p >= FLAG)
                offsets.append(_offsets(text, flagged) if len(flagged) else "")
            cols = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(offsets, pa.string())]
            yield pa.record_batch(cols, schema=schema)

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = scored.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, offsets string"
    )
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offsets"
    )


def _offsets(text: str, flagged: np.ndarray) -> str:
    """Offsets in the text itself; where lower case changes a text's length, words still match by order."""
    wanted = set(flagged.tolist())
    lower = text.lower()
    found = WORD.finditer(text if len(lower) == len(text) else lower)
    return ",".join(f"{m.start()}:{m.end()}" for n, m in enumerate(found) if n in wanted)
