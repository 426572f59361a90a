"""A byte-pair tokenizer as deterministic transducers that count tokens.

Two machines in a row read a normalized text. The *cutter* marks the letters that end a piece (a word, a
digit, a run of marks, a contraction): it never looks further than ``CONTEXT`` characters, so shifted arrays
evaluate it. The *counter* reads the letters of the pieces. Its state says what may still change: for every
place where a later token could begin, the token that ends there and the number of tokens up to it. The
transition by a letter finds the one token that can end with it, and carries the number of tokens gained
(or lost, where a merge makes one of several). A letter that ends a piece leads back to the first state.

That one token exists because byte-pair encodings are checked pair by pair: a row of tokens is the encoding
of its letters if and only if each two neighbours are the encoding of theirs. Neighbours are checked with
the tokenizer library's own merging, on letters renamed so that an end of word is a letter as well.

States are compiled when a text first reaches them and kept as one table, so that many chunks of text are
read abreast, a letter of each at a step. A chunk yields its state map: the state before it, the state
after it, the tokens gained. Maps compose where the one ends as the next begins; ``totals`` composes those of
a text by a prefix scan. The state before a chunk is taken from the letters just in front of it; where the
scan shows that it was another one, the map is made anew from that.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from tidemark.llm.tokens import byte_letters

# Letters of a chunk; letters read in front of a chunk to find the state before it.
CHUNK, WARM = 256, 24
# Characters of text read abreast, and states kept from one such block to the next.
BLOCK = 1 << 20
STATES = 150_000
# Characters before and after a place that decide whether a piece ends there.
CONTEXT = 4
# Rounds in which every unfit chunk is read again; after them only the first one of each text.
ROUNDS = 3

_SPACE, _LETTER, _DIGIT, _MARK, _UNKNOWN = 0, 1, 2, 3, 255
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# An ASCII character never composes with what stands before it, so these parts are normalized on their own.
_FOREIGN = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
# Nor do these letters: very long runs without ASCII are parted before them.
_APART = re.compile("(?=[Α-ωА-яあ-ん一-鿿가-힣])")
_LONG = 65_536
_UNITS_KEPT = 200_000


class Counter:
    """The counting transducer of a byte-pair vocabulary with word ends; states and transitions come on demand."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        from tokenizers import models

        byte_of = {c: b for b, c in byte_letters().items()}

        def renamed(token: str) -> str:
            ends = bool(suffix) and token.endswith(suffix)
            bare = token.removesuffix(suffix) if ends else token
            letters = [byte_of[c] for c in bare]
            if ends:
                letters[-1] += 256
            return "".join(chr(0xE000 + x) for x in letters)

        own = {renamed(t): i for t, i in vocab.items()}
        self.model = models.BPE(own, [(renamed(a), renamed(b)) for a, b in merges])
        self.starts = {t[:n] for t in own for n in range(len(t))}
        self.tokens = {t for t in own if [x.value for x in self.model.tokenize(t)] == [t]}
        self.fits: dict[str, bool] = {}
        self.column = np.full(512, -1, np.int32)
        self.used: list[str] = []
        self.clear()

    def clear(self) -> None:
        """Forget all states but the first one."""
        first = ("", ((0, "", 0),))
        self.number = {first: 0}
        self.states = [first]
        self.width = 64
        while self.width < len(self.used):
            self.width *= 2
        self.table = np.full((1024, self.width), -1, np.int32)

    def columns(self, letters: np.ndarray) -> np.ndarray:
        """Table columns of letters (a byte, and 256 more where it ends a piece)."""
        seen = np.flatnonzero(np.bincount(letters, minlength=512))
        for x in seen[self.column[seen] < 0]:
            self.column[x] = len(self.used)
            self.used.append(chr(0xE000 + int(x)))
        if len(self.used) > self.width:
            while self.width < len(self.used):
                self.width *= 2
            wide = np.full((len(self.table), self.width), -1, np.int32)
            wide[:, : self.table.shape[1]] = self.table
            self.table = wide
        return self.column[letters]

    def _neighbours(self, a: str, b: str) -> bool:
        both = a + b
        if both in self.starts or both in self.tokens or len(both) <= 8:
            key = f"{a}|{b}"
            known = self.fits.get(key)
            if known is None:
                if len(self.fits) > 4 * STATES:
                    self.fits.clear()
                known = self.fits[key] = self._merged(a, b)
            return known
        return self._merged(a, b)

    def _merged(self, a: str, b: str) -> bool:
        found = self.model.tokenize(a + b)
        return len(found) == 2 and found[0].value == a

    def _follow(self, state: int, column: int) -> int:
        """The packed transition: number of the next state, and tokens gained plus 128 in the low byte."""
        known, spots = self.states[state]
        letter = self.used[column]
        known += letter
        end = len(known)
        for back, last, count in spots:
            token = known[end - back - 1 :]
            if token in self.tokens and (not last or self._neighbours(last, token)):
                break
        else:
            raise ValueError("the vocabulary has no unique encoding of a prefix")
        gain = count + 1
        if ord(letter) >= 0xE100:
            target = 0
        else:
            open_ = tuple(
                (back + 1, last, n - gain) for back, last, n in spots if known[end - back - 1 :] in self.starts
            )
            key = (known[end - open_[0][0] :] if open_ else "", (*open_, (0, token, 0)))
            target = self.number.get(key)
            if target is None:
                target = self.number[key] = len(self.states)
                self.states.append(key)
                if target >= len(self.table):
                    more = np.full((max(1024, len(self.table) // 4), self.width), -1, np.int32)
                    self.table = np.concatenate((self.table, more))
        packed = target << 8 | gain + 128
        self.table[state, column] = packed
        return packed

    def read(self, cols: np.ndarray, at: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State after each chunk and tokens gained in it; a chunk is ``length`` columns from ``at`` on."""
        order = np.argsort(-length, kind="stable")
        at, length, state = at[order], length[order], state[order].astype(np.int64)
        gained = np.zeros(len(at), np.int64)
        live = len(at)
        for step in range(int(length[0]) if live else 0):
            while length[live - 1] <= step:
                live -= 1
            if live < 12:
                for k in range(live):
                    state[k], more = self._walk(cols[at[k] + step : at[k] + length[k]], int(state[k]))
                    gained[k] += more
                break
            col = cols[at[:live] + step]
            found = self.table.ravel()[state[:live] * self.width + col]
            lost = np.flatnonzero(found < 0)
            if len(lost):
                pairs, back = np.unique(state[lost] * 512 + col[lost], return_inverse=True)
                found[lost] = np.array([self._follow(int(p) >> 9, int(p) & 511) for p in pairs], np.int32)[back]
            state[:live] = found >> 8
            gained[:live] += (found & 255) - 128
        out, total = np.empty_like(state), np.empty_like(gained)
        out[order], total[order] = state, gained
        return out, total

    def _walk(self, cols: np.ndarray, state: int) -> tuple[int, int]:
        gained, table = 0, self.table
        for c in cols.tolist():
            packed = int(table[state, c])
            if packed < 0:
                packed = self._follow(state, c)
                table = self.table
            state = packed >> 8
            gained += (packed & 255) - 128
        return state, gained

    def totals(self, letters: np.ndarray, bounds: np.ndarray, state: int = 0) -> tuple[np.ndarray, int]:
        """Tokens gained in each run ``bounds[i] : bounds[i + 1]`` of the letters, and the state after the last.

        The first run begins in ``state``, each other one in the first state.
        """
        if len(self.states) > STATES and not state:
            self.clear()
        cols = self.columns(letters)
        size = np.diff(bounds)
        parts = -(-size // CHUNK)
        run = np.repeat(np.arange(len(size)), parts)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = bounds[run] + nth * CHUNK
        length = np.minimum(CHUNK, bounds[run + 1] - at)
        before = np.zeros(len(run), np.int64)
        before[(run == 0) & (nth == 0)] = state
        later = np.flatnonzero(nth > 0)
        before[later] = self.read(cols, at[later] - WARM, np.full(len(later), WARM), np.zeros(len(later), np.int64))[0]
        after, gained = self.read(cols, at, length, before)
        rounds = 0
        while True:
            unfit = later[after[later - 1] != before[later]]
            if not len(unfit):
                break
            rounds += 1
            if rounds > ROUNDS:
                unfit = unfit[np.unique(run[unfit], return_index=True)[1]]
            before[unfit] = after[unfit - 1]
            after[unfit], gained[unfit] = self.read(cols, at[unfit], length[unfit], before[unfit])
        total = np.zeros(len(size), np.int64)
        sums = scan(run, before, after, gained)
        ends = np.flatnonzero(np.append(run[1:] != run[:-1], True)) if len(run) else np.zeros(0, np.int64)
        total[run[ends]] = sums[ends]
        final = int(after[-1]) if len(run) and run[-1] == len(size) - 1 else 0
        return total, final


def scan(run: np.ndarray, before: np.ndarray, after: np.ndarray, gained: np.ndarray) -> np.ndarray:
    """Tokens gained from the begin of a run to the end of each of its chunks: state maps composed in pairs.

    After the step of width w, entry i holds the map of the 2w chunks that end with i, or of all from the begin
    of its run. Two maps compose where the left one's last state is the right one's first.
    """
    before, gained = before.copy(), gained.copy()
    reach = np.arange(len(run)) - (np.searchsorted(run, run) if len(run) else 0)
    width = 1
    while width <= (reach.max() if len(reach) else 0):
        i = np.flatnonzero(reach >= width)
        left = i - width
        if (after[left] != before[i]).any():
            raise ValueError("state maps that do not meet")
        before[i], gained[i] = before[left], gained[left] + gained[i]
        width *= 2
    return gained


class TokenCounter:
    """Token counts of whole texts for a tokenizer file of the word-BPE kind."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if (
            model.get("type") != "BPE"
            or model.get("continuing_subword_prefix")
            or not model.get("end_of_word_suffix")
            or len(steps) != 2
            or steps[0].get("pattern", {}).get("Regex") != _PATTERN
            or [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ):
            raise ValueError(f"{path} is not a tokenizer of the kind that is compiled here")
        added = {t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in added}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.pieces = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.counter = Counter(vocab, merges, model["end_of_word_suffix"])
        self.units: dict[str, str] = {}
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)

    def normalized(self, text: str) -> str:
        """The text as the tokenizer's normalizer gives it, but for white space and ASCII capitals (``letters`` lowers them)."""
        return text if text.isascii() else _FOREIGN.sub(self._foreign, text)

    def _foreign(self, match: re.Match) -> str:
        unit = match.group()
        if len(unit) > _LONG:
            parts, held = [], ""
            for part in _APART.split(unit):
                held += part
                if len(held) > _LONG // 8:
                    parts.append(self.normalizer.normalize_str(held))
                    held = ""
            return "".join(parts) + self.normalizer.normalize_str(held)
        known = self.units.get(unit)
        if known is None:
            known = self.normalizer.normalize_str(unit)
            if len(unit) <= 48:
                if len(self.units) >= _UNITS_KEPT:
                    self.units.clear()
                self.units[unit] = known
        return known

    def _kind(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if (kinds == _UNKNOWN).any():
            for p in np.unique(points[kinds == _UNKNOWN]):
                c = chr(int(p))
                count = self.pieces.pre_tokenize_str
                if not count(c):
                    self.kinds[p] = _SPACE
                elif len(count("a" + c)) == 1:
                    self.kinds[p] = _LETTER
                else:
                    self.kinds[p] = _MARK if len(count("!" + c)) == 1 else _DIGIT
            kinds = self.kinds[points]
        return kinds

    def letters(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cutter: a letter for each byte, whether it belongs to a piece, and the bytes of each character."""
        raw = np.frombuffer(text.encode(), np.uint8)
        raw = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
        points = raw
        if len(raw) > len(text):
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            points = points + ((points >= 65) & (points <= 90)) * np.uint32(32)
        kind = self._kind(points)
        n = len(points)
        kind_ = np.concatenate(([_SPACE], kind, [_SPACE, _SPACE, _SPACE])).astype(np.uint8)
        point = np.concatenate((points, np.zeros(3, points.dtype)))
        after = kind_[2 : n + 2]
        ends = (kind != _SPACE) & ((kind == _DIGIT) | (kind != after))
        quote = np.flatnonzero((points == 39) & (kind_[:n] != _MARK))
        one, two = point[quote + 1], point[quote + 2]
        short = quote[np.isin(one, [115, 116, 109, 100])]
        long = quote[((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))]
        ends[short] = False
        ends[short + 1] = True
        ends[long] = ends[long + 1] = False
        ends[long + 2] = True
        if points is raw:
            return raw + ends * np.uint16(256), kind != _SPACE, np.ones(n, np.int64)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        last = np.cumsum(width) - 1
        letter = raw.astype(np.uint16)
        letter[last[ends]] += 256
        return letter, np.repeat(kind != _SPACE, width), width

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Texts are read in blocks; one longer than a block goes on in its last state."""
        out = [0] * len(texts)
        held, names, size = [], [], 0
        for n, text in enumerate(texts):
            if "<" in text:
                out[n] = len(self.special.findall(text))
                if out[n]:
                    text = "\n".join(map(self.normalized, self.special.split(text)))
                else:
                    text = self.normalized(text)
            else:
                text = self.normalized(text)
            if len(text) > BLOCK:
                out[n] += self._long(text)
                continue
            held.append(text)
            names.append(n)
            size += len(text) + 1
            if size > BLOCK:
                self._block(held, names, out)
                held, names, size = [], [], 0
        self._block(held, names, out)
        return out

    def _block(self, texts: list[str], names: list[int], out: list[int]) -> None:
        if not texts:
            return
        letter, keep, width = self.letters("\n".join(texts))
        chars = np.cumsum([0] + [len(t) + 1 for t in texts])
        chars[-1] -= 1
        edges = np.concatenate(([0], np.cumsum(width)))[chars]
        bounds = np.concatenate(([0], np.cumsum(keep)))[edges]
        for n, total in zip(names, self.counter.totals(letter[keep], bounds)[0].tolist(), strict=True):
            out[n] += total

    def _long(self, text: str) -> int:
        total = state = 0
        for lo in range(0, len(text), BLOCK):
            front = max(0, lo - CONTEXT)
            hi = min(len(text), lo + BLOCK)
            letter, keep, width = self.letters(text[front : hi + CONTEXT])
            edges = np.concatenate(([0], np.cumsum(width)))
            a, b = edges[lo - front], edges[hi - front]
            part = letter[a:b][keep[a:b]]
            more, state = self.counter.totals(part, np.array([0, len(part)]), state)
            total += int(more[0])
        return total


_OPEN: dict[str, TokenCounter] = {}


def token_counter(path: str) -> TokenCounter:
    """The worker's own copy for a tokenizer file."""
    if path not in _OPEN:
        _OPEN[path] = TokenCounter(path)
    return _OPEN[path]
