"""Token ids of whole batches of texts, each distinct word of a batch encoded once by the tokenizers library.

A tokenizer that drops white space encodes the words between white space independently, so ids of a text are those of
its words in a row. Words are told apart by hashes of their bytes; known ones are kept for later batches, up to a bound."""

from __future__ import annotations

import os

import numpy as np

from tapewright.llm.common import LOWER, WORD_BYTES, running_hash, span_hashes, word_spans

WORDS_KEPT = 1 << 20

_LIBRARIES: dict[str, object] = {}
#: Words of texts, every two of which must have the ids of both, and what may stand between words.
SAMPLE = ("It's", "12.5", "ÀB,c's", "The", "(end).", "http://a.b/c?d=1", "naïve", "straße", "日本語", "😀!", "e\u0301", "--", "_x_", "don't", "I'LL", "1,000", "Ａ")
GAPS = (" ", "\n", "\t", "\r\n", "  ", " \x0b", "\x0c ")


def library(path: str):
    """The tokenizer of the file, once a worker; it must drop white space and split texts there, and none of its added tokens may hold any."""
    if path not in _LIBRARIES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_padding()
        found.no_truncation()
        ids = lambda t: found.encode(t, add_special_tokens=False).ids
        tokens = added_tokens(found)
        if any(not t or any(c.isspace() for c in t) for t in tokens):
            raise ValueError(f"{path} has added tokens with white space: texts can't be encoded in pieces")
        words = [*SAMPLE, *tokens[:16], *(f"a{t}b" for t in tokens[:16])]
        own = {w: ids(w) for w in words}
        for k, left in enumerate(words):
            for n, right in enumerate(words):
                gap = GAPS[(k + n) % len(GAPS)]
                if ids(f"{left}{gap}{right}{gap}") != own[left] + own[right]:
                    raise ValueError(f"{path} keeps white space, or reads over it: texts can't be encoded in pieces")
        _LIBRARIES[path] = found
    return _LIBRARIES[path]


def added_tokens(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def unified(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with A-Z lowered and a space before a full stop or comma between a-z and white space.

    For a tokenizer that lowers letters and parts the two in any case: ids stay, and more words are then equal. Where a special token may
    stand, which is read as written, nothing is done: they all begin with <|, or this isn't used."""
    if np.any((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)):
        return raw, bounds
    raw = LOWER[raw]
    stop = (raw[1:-1] == 0x2E) | (raw[1:-1] == 0x2C)
    stop &= (raw[:-2] >= 97) & (raw[:-2] <= 122) & ((raw[2:] == 32) | (raw[2:] == 10))
    at = np.flatnonzero(stop) + 1
    return np.insert(raw, at, 32), bounds + np.searchsorted(at, bounds)


class WordTable:
    def __init__(self, path: str):
        self.library = library(path)
        ids = lambda t: self.library.encode(t, add_special_tokens=False).ids
        self.unifies = ids("AZ word, The end. x") == ids("az word , the end . x") and all(t.startswith("<|") for t in added_tokens(self.library))
        self.forget()

    def forget(self) -> None:
        self.hashes, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """hashes: sorted, none of them known."""
        found, sizes = [], []
        for at in range(0, len(words), 8192):
            some = words[at : at + 8192]
            got = self.library.encode(" ".join(some), add_special_tokens=False)
            places = np.cumsum(np.array([0] + [len(w) + 1 for w in some]))
            cuts = np.searchsorted(np.fromiter((a for a, _ in got.offsets), np.int64, len(got.ids)), places)
            found.append(np.array(got.ids, np.uint32))
            sizes.append(np.diff(cuts))
        size = np.concatenate(sizes)
        start = len(self.pool) + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.pool = np.concatenate([self.pool, *found])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.starts, self.sizes = (np.insert(a, at, b.astype(a.dtype)) for a, b in ((self.hashes, hashes), (self.starts, start), (self.sizes, size)))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows in a row, and the n + 1 places of the rows among them."""
        if self.unifies:
            raw, offsets = unified(raw, offsets)
        starts, stops, bounds = word_spans(raw, offsets, WORD_BYTES)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes, first, word = np.unique(span_hashes(running_hash(raw, np.arange(256, dtype=np.uint8)), starts, stops), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > WORDS_KEPT:
            self.forget()
        at = np.searchsorted(self.hashes, hashes)
        new = at == len(self.hashes)
        new[~new] = self.hashes[at[~new]] != hashes[~new]
        if new.any():
            data = raw.tobytes()
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist())]
            self.learn(hashes[new], texts)
            at = np.searchsorted(self.hashes, hashes)
        at = at[word]
        size = self.sizes[at].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.pool[np.arange(ends[-1]) + np.repeat(self.starts[at] - (ends - size), size)]
        return ids, np.concatenate([[0], ends])[bounds]


_TABLES: dict[str, WordTable] = {}


def table(path: str) -> WordTable:
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]
