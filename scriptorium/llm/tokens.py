"""Encoding whole texts with a tokenizers file, at array speed.

The byte-level pre-tokenizer never joins a character that is not white space to
white space after it.  A text may therefore be cut before each run of ASCII
white space that follows a character which is not (Unicode) white space, and
the ids of the pieces, joined, are the ids of the text.  A special token of the
file holds no white space, so it stays in one piece, and its string in a text is
its id, as the library's plain call has it.  A worker encodes each
distinct piece once with the library, keeps its ids under a 64-bit hash, and
looks up whole blocks of pieces at a time.
"""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

from .kernel import IS_SPACE, span_hashes

#: Entries a worker keeps before it starts afresh; a bound on memory only.
CACHE_ENTRIES = 3_000_000
_PROBES = np.uint64(0x9E3779B97F4A7C15)


def _after_wide_space(data: np.ndarray) -> np.ndarray:
    """Positions right after a white-space character that is not ASCII."""
    found = []
    two = np.flatnonzero(data[:-1] == 0xC2)
    found.append(two[(data[two + 1] == 0x85) | (data[two + 1] == 0xA0)] + 2)
    lead = np.flatnonzero((data[:-2] == 0xE1) | (data[:-2] == 0xE2) | (data[:-2] == 0xE3)) if len(data) > 2 else two[:0]
    a, b, c = data[lead], data[lead + 1], data[lead + 2]
    wide = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    wide |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    found.append(lead[wide] + 3)
    return np.concatenate(found)


def pieces_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of all rows, and for each row the index of its first piece (n+1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    if len(data) > 1:
        cut[_after_wide_space(data)] = False
    cut[-1] = False
    cut[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, off)


class Encoder:
    """Ids of texts by one tokenizer file, with the pieces met so far kept."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        alphabet = self._bytes_per_char()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token) if all(x in alphabet for x in token) else 0
        self.newline = self._library("\n")
        self._reset()

    @staticmethod
    def _bytes_per_char() -> set[str]:
        """The printable stand-ins of the 256 bytes: one character each."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return {chr(b) for b in plain} | {chr(256 + i) for i in range(256 - len(plain))}

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _reset(self) -> None:
        self.slots = 1 << 16
        self.hash = np.zeros(self.slots, np.uint64)
        self.entry = np.full(self.slots, -1, np.int32)
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        mask = np.uint64(self.slots - 1)
        slot = (h & mask).astype(np.int64)
        out = self.entry[slot]
        open_ = np.flatnonzero((out >= 0) & (self.hash[slot] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
            out[open_] = self.entry[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.hash[slot[open_]] != h[open_])]
        return out

    def _put(self, h: np.ndarray, first: int) -> None:
        todo, slot = np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            free = self.entry[slot[todo]] < 0
            tried = todo[free]
            _, one = np.unique(slot[tried], return_index=True)
            won = tried[one]
            self.entry[slot[won]], self.hash[slot[won]] = first + won, h[won]
            left = np.ones(len(h), bool)
            left[won] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)

    def _add(self, h: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        """Encode the spans and keep their ids; their hashes are distinct and new."""
        n = len(h)
        if len(self.keys) + n > CACHE_ENTRIES:
            self._reset()
        first = len(self.keys)
        self.keys = np.concatenate([self.keys, h])
        if 2 * len(self.keys) > self.slots:
            while 2 * len(self.keys) > self.slots:
                self.slots *= 2
            self.hash, self.entry = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)
            self._put(self.keys, 0)
        else:
            self._put(h, first)
        # spans that begin with white space and end without may be encoded as one string
        plain = IS_SPACE[data[s]] & ~IS_SPACE[data[e - 1]]
        lengths = np.zeros(n, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for some in np.array_split(np.flatnonzero(plain), max(1, n // 2000)):
            if len(some):
                text = b"".join(data[a:b].tobytes() for a, b in zip(s[some].tolist(), e[some].tolist(), strict=True))
                ids = self._library(text.decode())
                ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(e[some] - s[some])) + 1
                lengths[some] = np.diff(ends, prepend=0)
                parts.append((some, ids))
        for i in np.flatnonzero(~plain):
            ids = self._library(data[s[i] : e[i]].tobytes().decode())
            lengths[i] = len(ids)
            parts.append((np.array([i]), ids))
        at = np.concatenate([[0], np.cumsum(lengths)]) + self.at[-1]
        if at[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(int(at[-1]) - len(self.ids), len(self.ids)), np.uint32)])
        for some, ids in parts:
            self.ids[ragged(at[some], lengths[some])] = ids
        self.at = np.concatenate([self.at, at[1:]])

    def encode(self, data: np.ndarray, off: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, ``end`` (if any) after each row, and the n+1 offsets of the rows."""
        s, row_at = pieces_of(data, off)
        e = np.append(s[1:], len(data))[: len(s)]
        h = span_hashes(data, s, e)
        found = self._find(h)
        if (found < 0).any():
            new = np.flatnonzero(found < 0)
            _, one = np.unique(h[new], return_index=True)
            new = new[one]
            before = len(self.keys)
            self._add(h[new], data, s[new], e[new])
            if len(self.keys) != before + len(new):  # it started afresh: the rest of the block is needed too
                missing = np.flatnonzero(self._find(h) < 0)
                _, one = np.unique(h[missing], return_index=True)
                if len(one):
                    self._add(h[missing[one]], data, s[missing[one]], e[missing[one]])
            found = self._find(h)
        lengths = self.at[found + 1] - self.at[found]
        total = np.concatenate([[0], np.cumsum(lengths)])
        out_off = total[row_at]
        ids = self.ids[ragged(self.at[found], lengths)]
        if end is not None:
            ids = np.insert(ids, out_off[1:], end)
            out_off = out_off + np.arange(len(off))
        return ids, out_off


def ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (lengths[0] of them), then first[1], ..."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(first - before, lengths) + np.arange(int(lengths.sum()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
