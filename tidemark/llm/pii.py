"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds what they miss.

Fixed patterns give the kinds email, ip, card and phone. The CRF tags words around digits and at-signs
and adds forms without a pattern (numbers without a country code, addresses with a bracketed "at",
shorter cards); its spans carry the prefix ``crf_``, never overlap a pattern's and must pass the same checks.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its start only: from inside it, the rest of the pattern is the same.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if n % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """Pattern matches in code points, by kind as listed and then by start."""
    out = list(_emails(text))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# -- the CRF -------------------------------------------------------------------------------
# A small labelled table: words of a kind stand in brackets after its name.
LABELLED = """
call me at [phone 555-123-4567] tomorrow
my number is [phone (555) 123-4567] , please ring
phone: [phone 020 7946 0958] or write
tel [phone 0171/5550123] from nine to five
reach us on [phone 1-800-555-0199] any time
mobile [phone 07700 900123] after six
fax [phone 555.867.5309] only
text [phone 555 010 4477] for help
the office line is [phone (020) 7946 0321] today
ring [phone +44 20 7946 0018] now
call [phone +1 (555) 234-9876] and ask
mail [email jane.doe [at] example.com] for details
write to [email bob [at] example.org] soon
contact [email ann (at) example.net] please
send it to [email sam [at] example.com] today
email [email carol.king@example.com] or reply
user [email lee@mail.example.org] wrote
write [email tom(at)example.com] about it
mail [email info[at]example.org] first
card [card 3782 822463 10005] expires soon
paid with [card 378282246310005] yesterday
the card number [card 4222222222222] was declined
visa [card 4111 1111 1111 1111] on file
charge [card 5555-5555-5555-4444] once
amex [card 3714-496353-98431] is valid
host [ip 10.0.0.1] is down
from [ip 192.168.1.77] at noon
server [ip 172.16.254.3] replied
ping [ip 203.0.113.9] again
the year 2024 was warm
in 1999 and 2003 prices rose by 12 percent
version 3.0. of the license applies
chapter 4 section 12 page 345
on 2024-01-05 at 10:30 the train left
on 05/01/2024 they met
it costs 1,299.00 dollars or 49.99 a month
about 1,000,000 people and 250 towns
order 48151623 shipped in 3 days
the id is 00012345 in table 7
scores were 3-2 and 10-9 last week
see figure 2.1.3 and table 5.4
released 1.2.3.4.5 and 2.0.1 last year
room 101 floor 12 building 7
it weighs 12.5 kg and is 180 cm tall
lines 10-20 and 30-45 were changed
between 1914-1918 and 1939-1945
at 5 o'clock or at 6 sharp
the ratio is 16:9 or 4:3
isbn 978-3-16-148410-0 is out of print
password=abc123def456 was leaked
key "0f1e2d3c4b5a69788796a5b4c3d2e1f0" rotates
part A12B-34 and B9X7
look at the end of the road
they met at noon dot the sign said
copyright 2019 2020 2021 all rights reserved
the sum of 12 and 30 is 42
phase 1 2 3 4 of the plan
version 10.4 replaced 10.3 in 2015
"""
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_WORD = re.compile(r"\S+")
_HOT = re.compile(r"[0-9@]|[\[(]at[\])]")
_KEYS = frozenset("at dot tel tel: phone phone: call mobile fax ring text number mail email card visa amex ip host server".split())
REACH = 4
# Longer chains are decoded alone, so many words at a time.
LONG_CHAIN = 512
# Longer words are scored whole each time they occur, but not remembered.
LONGEST_KEPT = 256
CELLS = 1 << 12


def shape(word: str) -> str:
    out = re.sub(r"[A-Z]", "X", re.sub(r"[0-9]", "d", word))
    return re.sub(r"[^\W\dXd_]", "x", out)


def _cell(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % CELLS


def features(word: str) -> list[str]:
    """What a word tells of itself, whatever its neighbours."""
    s = shape(word)
    digits = sum(c in "0123456789" for c in word)
    out = [
        "shape=" + re.sub(r"(.)\1+", r"\1+", s),
        "long=" + s[:16],
        f"digits={min(digits, 20)}",
        f"plus={word.startswith('+')}",
        f"paren={word.startswith('(')}{word.endswith(')')}",
        f"at={'@' in word}{bool(re.search(r'[\[(]at[\])]', word))}",
        f"marks={''.join(sorted(set(re.sub(r'[0-9A-Za-z]', '', word))))[:6]}",
        f"dots={min(word.count('.'), 4)}",
    ]
    key = word.lower()
    return out + ([f"word={key}"] if key in _KEYS else [])


class Crf:
    """Weights of a linear chain: a word scores each label by its own and its neighbours' features."""

    def __init__(self, own: np.ndarray, before: np.ndarray, after: np.ndarray, moves: np.ndarray, first: np.ndarray) -> None:
        self.own, self.before, self.after, self.moves, self.first = own, before, after, moves, first
        self.seen: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def word(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = self.seen.get(word)
        if got is None:
            at = [_cell(f) for f in features(word)]
            got = self.own[at].sum(axis=0), self.before[at].sum(axis=0), self.after[at].sum(axis=0)
            if len(word) <= LONGEST_KEPT:
                if len(self.seen) >= 50_000:
                    self.seen.clear()
                self.seen[word] = got
        return got

    def scores(self, words: list[str]) -> np.ndarray:
        rows = [self.word(w) for w in words]
        out = np.array([r[0] for r in rows])
        out[1:] += np.array([r[1] for r in rows[:-1]]).reshape(-1, out.shape[1])
        out[:-1] += np.array([r[2] for r in rows[1:]]).reshape(-1, out.shape[1])
        return out

    def decode(self, chains: list[list[str]]) -> list[np.ndarray]:
        """Viterbi labels of many chains at once, those of like length together and very long ones alone."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        while order and len(chains[order[-1]]) > LONG_CHAIN:
            i = order.pop()
            out[i] = self.decode_long(chains[i])
        at = 0
        while at < len(order):
            longest = len(chains[order[at]])
            upto = at
            while upto < len(order) and len(chains[order[upto]]) <= longest + 8 and upto - at < 4_096:
                upto += 1
            group = order[at:upto]
            lengths = np.array([len(chains[i]) for i in group])
            emit = np.zeros((len(group), int(lengths.max()), len(LABELS)))
            for row, i in enumerate(group):
                emit[row, : lengths[row]] = self.scores(chains[i])
            for i, tags in zip(group, viterbi(emit, lengths, self.moves, self.first), strict=True):
                out[i] = tags
            at = upto
        return out

    def decode_long(self, words: list[str]) -> np.ndarray:
        """Viterbi labels of one chain, scored ``LONG_CHAIN`` words at a time; the best scores carry over."""
        n = len(words)
        back = np.zeros((n, len(LABELS)), np.int8)
        best = np.zeros(0)
        for lo in range(0, n, LONG_CHAIN):
            skip = min(lo, 1)  # the neighbours on both sides score too
            emit = self.scores(words[lo - skip : lo + LONG_CHAIN + 1])[skip : skip + LONG_CHAIN]
            for t, own in enumerate(emit, lo):
                if t:
                    via = best[:, None] + self.moves
                    back[t] = via.argmax(axis=0)
                    best = via.max(axis=0) + own
                else:
                    best = self.first + own
        tags = np.zeros(n, np.int64)
        last = int(best.argmax())
        for t in range(n - 1, -1, -1):
            tags[t] = last
            last = back[t, last]
        return tags


def viterbi(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    n, steps, kinds = emit.shape
    best = first + emit[:, 0]
    back = np.zeros((n, steps, kinds), np.int16)
    for t in range(1, steps):
        via = best[:, :, None] + moves
        back[:, t] = via.argmax(axis=1)
        new = via.max(axis=1) + emit[:, t]
        best = np.where((t < lengths)[:, None], new, best)
    tags = np.zeros((n, steps), np.int64)
    last = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        live = t < lengths
        tags[live, t] = last[live]
        if t:
            last = np.where(live, back[np.arange(n), t, last], last)
    return [tags[i, : lengths[i]] for i in range(n)]


def parse_labelled(table: str = LABELLED) -> list[tuple[list[str], list[int]]]:
    """Word lists with label numbers."""
    out = []
    for line in table.strip().splitlines():
        words: list[str] = []
        tags: list[int] = []
        kind, depth = "", 0
        for token in line.split():
            if not kind and token[1:] in KINDS and token[0] == "[":
                kind, depth = token[1:], 0
                continue
            ends = bool(kind) and token.endswith("]") and not re.search(r"[\[(]at[\])]$", token)
            words.append(token[:-1] if ends else token)
            tags.append(LABELS.index(f"{'I' if depth else 'B'}-{kind}") if kind else 0)
            depth += 1
            if ends:
                kind = ""
        out.append((words, tags))
    return out


def train(rows: list[tuple[list[str], list[int]]], rounds: int = 150, rate: float = 0.1, decay: float = 0.01) -> Crf:
    """Maximum likelihood with a squared penalty, by Adam on exact gradients of the whole small table."""
    kinds = len(LABELS)
    steps = max(len(w) for w, _ in rows)
    n = len(rows)
    lengths = np.array([len(w) for w, _ in rows])
    gold = np.zeros((n, steps), np.int64)
    sources: list[list[np.ndarray]] = [[], [], []]  # per part: (row, step, cell)
    for i, (words, tags) in enumerate(rows):
        gold[i, : len(tags)] = tags
        for t, w in enumerate(words):
            cells = np.array([_cell(f) for f in features(w)])
            for part, step in ((0, t), (1, t + 1), (2, t - 1)):
                if 0 <= step < len(words):
                    sources[part].append(np.column_stack([np.full(len(cells), i), np.full(len(cells), step), cells]))
    spots = [np.concatenate(s) for s in sources]
    theta = [np.zeros((CELLS, kinds)) for _ in range(3)] + [np.zeros((kinds, kinds)), np.zeros(kinds)]
    mean = [np.zeros_like(p) for p in theta]
    var = [np.zeros_like(p) for p in theta]
    mask = np.arange(steps) < lengths[:, None]
    true = np.eye(kinds)[gold] * mask[:, :, None]
    pair_true = np.einsum("nta,ntb->ab", true[:, :-1], true[:, 1:])
    for step in range(1, rounds + 1):
        emit = np.zeros((n, steps, kinds))
        for part in range(3):
            np.add.at(emit, (spots[part][:, 0], spots[part][:, 1]), theta[part][spots[part][:, 2]])
        node, pair = _marginals(emit, lengths, theta[3], theta[4])
        off = (node - true) * mask[:, :, None]
        grads = [np.zeros((CELLS, kinds)) for _ in range(3)]
        for part in range(3):
            np.add.at(grads[part], spots[part][:, 2], off[spots[part][:, 0], spots[part][:, 1]])
        grads += [pair - pair_true, off[:, 0].sum(axis=0)]
        for k in range(5):
            g = grads[k] + decay * theta[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            var[k] = 0.999 * var[k] + 0.001 * g * g
            theta[k] = theta[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return Crf(*theta)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _marginals(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: np.ndarray):
    n, steps, kinds = emit.shape
    ahead = np.zeros_like(emit)
    ahead[:, 0] = first + emit[:, 0]
    for t in range(1, steps):
        new = _lse(ahead[:, t - 1, :, None] + moves, 1) + emit[:, t]
        ahead[:, t] = np.where((t < lengths)[:, None], new, ahead[:, t - 1])
    behind = np.zeros_like(emit)
    for t in range(steps - 2, -1, -1):
        new = _lse(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where((t + 1 < lengths)[:, None], new, 0.0)
    total = _lse(ahead[:, -1], 1)
    node = np.exp(ahead + behind - total[:, None, None])
    pair = np.zeros((kinds, kinds))
    for t in range(1, steps):
        live = t < lengths
        joint = ahead[live, t - 1, :, None] + moves + (emit[live, t] + behind[live, t])[:, None, :]
        pair += np.exp(joint - total[live, None, None]).sum(axis=0)
    return node, pair


def chains_of(text: str) -> list[list[tuple[str, int, int]]]:
    """Words with offsets around each word that has a digit, an at-sign or a bracketed "at".

    Words farther than ``REACH`` from one are label O by rule: no kind can begin there. A chain is never
    cut, however long.
    """
    if not _HOT.search(text):
        return []
    words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]
    hot = [i for i, w in enumerate(words) if _HOT.search(w[0])]
    out: list[list[tuple[str, int, int]]] = []
    lo = hi = -1
    for i in hot:
        if lo >= 0 and i - REACH <= hi:
            hi = min(len(words), i + REACH + 1)
            continue
        if lo >= 0:
            out.append(words[lo:hi])
        lo, hi = max(0, i - REACH), min(len(words), i + REACH + 1)
    if lo >= 0:
        out.append(words[lo:hi])
    return out


def _passes(kind: str, found: str) -> bool:
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and len(found) - len(digits) <= len(digits) and not re.search(r"[A-Za-z@=]", found)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[A-Za-z]", found)
    if kind == "ip":
        parts = found.split(".")
        return len(parts) == 4 and all(p.isdecimal() and p.isascii() and _small(p) for p in parts)
    name = r"[A-Za-z0-9._%+-]+"
    at = r"(?:@|\s?[\[(]at[\])]\s?)"
    dot = r"(?:\.|\s?[\[(]dot[\])]\s?)"
    return bool(re.fullmatch(rf"{name}{at}[A-Za-z0-9-]+(?:{dot}[A-Za-z0-9-]+)+", found))


class Taken:
    """Places that spans cover, asked in logarithmic time."""

    def __init__(self, spans: list[Span]) -> None:
        order = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in order]
        self.ends = list(accumulate((b for _, b in order), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


def crf_spans(text: str, chain: list[tuple[str, int, int]], tags: np.ndarray, taken: Taken) -> list[Span]:
    out = []
    i = 0
    while i < len(tags):
        if tags[i] == 0:
            i += 1
            continue
        kind = LABELS[tags[i]][2:]
        j = i + 1
        while j < len(tags) and LABELS[tags[j]] == f"I-{kind}":
            j += 1
        start, end = chain[i][1], chain[j - 1][2]
        while end > start and text[end - 1] in ".,;:!?\"'":
            end -= 1
        while start < end and text[start] in ",;:\"'":
            start += 1
        if not taken.meets(start, end) and _passes(kind, text[start:end]):
            out.append((f"crf_{kind}", start, end))
        i = j
    return out


def find_spans(texts: list[str], crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """Pattern spans and CRF spans of each text."""
    base = [base_spans(t) for t in texts]
    chains, owner = [], []
    for n, t in enumerate(texts):
        for chain in chains_of(t):
            chains.append(chain)
            owner.append(n)
    more: list[list[Span]] = [[] for _ in texts]
    taken = [Taken(b) for b in base]
    for n, chain, tags in zip(owner, chains, crf.decode([[w[0] for w in c] for c in chains]), strict=True):
        if tags.any():
            more[n] += crf_spans(texts[n], chain, tags, taken[n])
    order = {f"crf_{k}": i for i, k in enumerate(KINDS)}
    return [(b, sorted(set(m), key=lambda s: (order[s[0]], s[1]))) for b, m in zip(base, more, strict=True)]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans one mark stays."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.removeprefix('crf_').upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False, labelled: str = LABELLED
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans [, redacted]: one row per document.

    Counts and digest cover the pattern spans; ``spans`` lists them and then the CRF's. Offsets are
    code points, ends exclusive. A null text counts as empty (no spans; its redacted text stays null).
    Repeated rows give repeated rows; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    crf = train(parse_labelled(labelled))
    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())]
    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    if redact:
        fields.append(("redacted", pa.string()))
        ddl += ", redacted string"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            texts = [t or "" for t in raw]
            rows = []
            for key, text, was, (base, more) in zip(batch.column(0).to_pylist(), texts, raw, find_spans(texts, crf), strict=True):
                kinds = [s[0] for s in base]
                row = [key, *(kinds.count(k) for k in KINDS)]
                row += [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more)]
                if redact:
                    row.append(None if was is None else redacted(text, base + more))
                rows.append(row)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ddl)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", labelled: str = LABELLED) -> DataFrame:
    """``docs`` with personal data in the text replaced and the length column counted anew.

    One pass over the rows: nothing is joined back. A null text stays null, as does its length.
    """
    bounded_batches(docs.sparkSession)
    crf = train(parse_labelled(labelled))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(place).to_pylist()
            found = find_spans([t or "" for t in raw], crf)
            texts = [None if t is None else redacted(t, base + more) for t, (base, more) in zip(raw, found, strict=True)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.length(text_col).cast(kind)).select(*docs.columns)
    return out
