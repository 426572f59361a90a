"""Token ids of whole texts by a public tokenizer file, with a bounded memory of words already seen."""

from __future__ import annotations

import gc
import os
import re

import numpy as np

# Words of a generation; the one before is kept too, and words still in use move on from it.
WORDS_KEPT = 400_000
LONGEST_KEPT = 48
# Marks that end a word as one run apart from its letters; those of contractions and special tokens are not among them.
_LOOSE = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
# Letters that lower-casing and composing leave as they are, in one piece to any splitter by letters.
_PLAIN = re.compile("[a-zà-öø-ÿ]+")
_PROBES = ("the", "tionheast", "naïve", "über", "éçment", "señorzzq", "x", "straße", "abcdefghijklmnopqrstuvwxyz")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordIds(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes.

    For a tokenizer that drops white space and never joins across it, the ids of a text are those of
    its words put together. Words come from the tokenizer once and are kept up to a bounded number; a
    mark at the end of a word is a token run of its own and looked up apart. Words of plain lower-case
    letters go straight to the tokenizer's model, if that gives the whole tokenizer's ids on probes.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        # The memory holds no cycles, and the default threshold would walk it for every few hundred words.
        gc.set_threshold(100_000, 20, 20)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.older: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.older_cores: dict[str, bytes] = {}
        self.direct = all(self._by_model(w) == self._whole(w) for w in _PROBES)

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _by_model(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def _core(self, word: str) -> bytes:
        key = word.lower() if word.isascii() and "<|" not in word else word
        ids = self.cores.get(key)
        if ids is None:
            ids = self.older_cores.get(key)
            if ids is None:
                ids = self._by_model(key) if self.direct and _PLAIN.fullmatch(key) else self._whole(key)
            if len(key) <= LONGEST_KEPT:
                if len(self.cores) >= WORDS_KEPT:
                    self.older_cores, self.cores = self.cores, {}
                self.cores[key] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            stem = word.rstrip(_LOOSE)
            # (One capital grows a combining mark in lower case, which would join the marks behind it.)
            if len(stem) < len(word) and stem and stem[-1].isalnum() and len(stem[-1].lower()) == 1:
                ids = self._core(stem) + self._core(word[len(stem) :])
            else:
                ids = self._core(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own copy for a tokenizer file."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
