"""Re-Pair: frequent pairs of ids become nonterminals, again and again, within one shard.

A round takes every pair with at least ``threshold`` occurrences; where
occurrences overlap, the more frequent pair has them.  The threshold falls to
LEAST, and rounds go on until no pair has LEAST uses left: a rule is stored as
two symbols and a length, so from LEAST uses on it is shorter than what it
replaces.  After the first rounds only positions whose pair changed, or still
is frequent, are looked at again.  Pairs never cross the end of a document, so
each document is a run of symbols.  Rules are stored with their expansion
lengths, and every MARK symbols the ids before them, so any range of ids is
decoded from the symbols and rules that it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .tokens import ragged

#: Uses from which a rule pays for its own storage.
LEAST = 4
#: Between rounds the threshold falls by so much at most.
FALL = 64
#: Symbols between two marks.
MARK = 512


@dataclass
class Grammar:
    """Symbols below ``base`` are ids; symbol base + r expands to the two symbols rules[r], lengths[r] ids in all.

    ``doc_symbols`` are the n+1 symbol offsets of the documents, ``marks`` the ids before symbols 0, MARK, 2 MARK, ...
    """

    base: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    doc_symbols: np.ndarray
    marks: np.ndarray

    def width(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out


def _by_pair(a: np.ndarray, b: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions ``at`` (below n) by the pair (a, b) that begins there, then by place, and how many each pair has."""
    if not len(at):
        return at, np.zeros(0, np.int64)
    width = int(max(a.max(), b.max())).bit_length()
    if 2 * width + n.bit_length() <= 64:  # the position fits beside the pair: one plain sort
        bits = np.uint64(64 - 2 * width)
        key = a.astype(np.uint64)
        key <<= np.uint64(width)
        key |= b
        key <<= bits
        key |= at.view(np.uint64)
        key.sort()
        at = (key & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
        key >>= bits
        other = key[1:] != key[:-1]
    else:
        order = np.lexsort((at, b, a))
        at, a, b = at[order], a[order], b[order]
        other = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.concatenate([[0], np.flatnonzero(other) + 1])
    return at, np.diff(first, append=len(at))


def _choose(at: np.ndarray, before: np.ndarray, after: np.ndarray, counts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which positions are replaced, the pair of each): none overlaps another, the more frequent pair has precedence, and a run of one pair gives every second.

    ``rank`` is a scratch array of zeros, one longer than the text.
    """
    order = np.empty(len(counts), np.int32)
    order[np.argsort(counts, kind="stable")] = np.arange(1, len(counts) + 1, dtype=np.int32)
    pair = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    mine = order[pair]
    rank[at] = mine
    out = (mine >= rank[before]) & (mine >= rank[after])
    rank[at] = 0
    joined = after[:-1] == at[1:]
    joined &= pair[1:] == pair[:-1]
    if joined.any():
        begins = np.flatnonzero(np.concatenate([[True], ~joined]))
        out &= ((np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))) & 1) == 0
    return out, pair


class _Rules:
    def __init__(self, base: int):
        self.base, self.n, self.made = base, 0, []

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        self.made.append(np.stack([a, b], 1).astype(np.uint32))
        self.n += len(a)
        return np.arange(self.base + self.n - len(a), self.base + self.n, dtype=np.uint32)

    def table(self) -> np.ndarray:
        return np.concatenate(self.made) if self.made else np.zeros((0, 2), np.uint32)


def _wide_rounds(symbols: np.ndarray, last: np.ndarray, rules: _Rules) -> tuple[np.ndarray, np.ndarray]:
    """Rounds over the whole text, closed up after each, while a round takes a twentieth of it."""
    threshold = None
    while len(symbols) > 1:
        at, counts = _by_pair(*(x[~last[:-1]] for x in (symbols[:-1], symbols[1:], np.arange(len(symbols) - 1))), len(symbols))
        if not len(counts):
            break
        threshold = max(LEAST, int(counts.max()) // FALL if threshold is None else threshold // FALL)
        chosen = counts >= threshold
        tried, sizes = at[np.repeat(chosen, counts)], counts[chosen]
        taken, pair = _choose(tried, tried - 1, tried + 1, sizes, np.zeros(len(symbols) + 1, np.int32))
        where, index = tried[taken], pair[taken]
        used = np.bincount(index, minlength=len(sizes)) >= LEAST
        whole = used[index]
        where, index = where[whole], index[whole]
        if len(where):
            one = tried[(np.cumsum(sizes) - sizes)[used]]
            name = np.zeros(len(sizes), np.uint32)
            name[used] = rules.add(symbols[one], symbols[one + 1])
            symbols[where] = name[index]
            last[where] = last[where + 1]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, last = symbols[keep], last[keep]
        if threshold == LEAST and 20 * len(where) < len(symbols):
            break
    return symbols, last


def _narrow_rounds(symbols: np.ndarray, last: np.ndarray, rules: _Rules) -> tuple[np.ndarray, np.ndarray]:
    """Rounds over a linked text (position n is 'none') that look again only where a pair is frequent or new, to the end."""
    n = len(symbols)
    after, before = np.append(np.arange(1, n + 1), n), np.append(np.arange(-1, n - 1), n)
    after[:n][last] = n
    before[np.flatnonzero(last) + 1] = n
    before[:1] = n
    before[n] = n
    alive, rank = np.ones(n, bool), np.zeros(n + 1, np.int32)
    todo = np.flatnonzero(~last)
    while len(todo):
        at, counts = _by_pair(symbols[todo], symbols[after[todo]], todo, n)
        often = counts >= LEAST
        at, counts = at[np.repeat(often, counts)], counts[often]
        if not len(at):
            break
        taken, pair = _choose(at, before[at], after[at], counts, rank)
        where, index = at[taken], pair[taken]
        used = np.bincount(index, minlength=len(counts)) >= LEAST
        if not used.any():
            break
        whole = used[index]
        where, index = where[whole], index[whole]
        one = at[(np.cumsum(counts) - counts)[used]]
        name = np.zeros(len(counts), np.uint32)
        name[used] = rules.add(symbols[one], symbols[after[one]])
        symbols[where] = name[index]
        gone = after[where]
        beyond = after[gone]
        after[where] = beyond
        before[beyond] = where
        before[n] = n
        alive[gone] = False
        todo = np.concatenate([at, where, before[where]])
        todo = todo[todo < n]
        todo = todo[alive[todo] & (after[todo] < n)]
        todo.sort()
        todo = todo[np.diff(todo, prepend=-1) > 0]
    return symbols[alive], after[:n][alive] == n


def compress(ids: np.ndarray, off: np.ndarray, base: int) -> Grammar:
    """Grammar of the documents ids[off[i]:off[i+1]]; all ids are below ``base``."""
    last = np.zeros(len(ids), bool)
    last[off[1:][off[1:] > off[:-1]] - 1] = True
    rules = _Rules(base)
    symbols, last = _narrow_rounds(*_wide_rounds(ids.astype(np.uint32), last, rules), rules)
    doc_symbols = np.zeros(len(off), np.int64)
    doc_symbols[1:][off[1:] > off[:-1]] = np.flatnonzero(last) + 1
    table = rules.table()
    g = Grammar(base, table, _lengths(table, base), symbols, np.maximum.accumulate(doc_symbols), np.zeros(0, np.uint32))
    g.marks = np.concatenate([[0], np.cumsum(g.width(symbols))])[:-1:MARK].astype(np.uint32)
    return g


def _levels(rules: np.ndarray, base: int) -> list[np.ndarray]:
    """The rules in groups, each of which refers to ids and earlier groups only."""
    known = np.zeros(len(rules), bool)
    left, out = np.arange(len(rules)), []
    while len(left):
        a, b = rules[left, 0].astype(np.int64) - base, rules[left, 1].astype(np.int64) - base
        ready = ((a < 0) | known[np.maximum(a, 0)]) & ((b < 0) | known[np.maximum(b, 0)])
        out.append(left[ready])
        known[left[ready]] = True
        left = left[~ready]
    return out


def _lengths(rules: np.ndarray, base: int) -> np.ndarray:
    lengths = np.ones(len(rules), np.uint32)
    for level in _levels(rules, base):
        for side in (0, 1):
            child = rules[level, side].astype(np.int64) - base
            n = np.where(child < 0, 1, lengths[np.maximum(child, 0)])
            lengths[level] = n if side == 0 else lengths[level] + n
    return lengths


def expand(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids that a long run of symbols stands for, by way of every rule's expansion."""
    first = np.concatenate([[0], np.cumsum(g.lengths, dtype=np.int64)])
    store = np.empty(int(first[-1]), np.uint32)
    for level in _levels(g.rules, g.base):
        at = first[level]
        for side in (0, 1):
            child = g.rules[level, side]
            plain = child < g.base
            store[at[plain]] = child[plain]
            r, to = child[~plain].astype(np.int64) - g.base, at[~plain]
            n = g.lengths[r].astype(np.int64)
            store[ragged(to, n)] = store[ragged(first[r], n)]
            at = at + g.width(child)
    # one store: the expansions of the rules, then the plain ids of this run
    rule = symbols >= g.base
    start = np.empty(len(symbols), np.int64)
    start[~rule] = len(store) + np.arange(int((~rule).sum()))
    start[rule] = first[symbols[rule] - g.base]
    return np.concatenate([store, symbols[~rule].astype(np.uint32)])[ragged(start, g.width(symbols))]


def unfold(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids that a short run of symbols stands for; only the rules that it needs are looked at."""
    symbols = symbols.astype(np.uint32)
    while True:
        rule = symbols >= g.base
        if not rule.any():
            return symbols
        at = np.cumsum(rule + 1) - (rule + 1)
        out = np.empty(len(symbols) + int(rule.sum()), np.uint32)
        out[at[~rule]] = symbols[~rule]
        pair = g.rules[symbols[rule] - g.base]
        out[at[rule]], out[at[rule] + 1] = pair[:, 0], pair[:, 1]
        symbols = out


def decode_range(g: Grammar, start: int, n: int) -> np.ndarray:
    """ids[start : start + n] of the shard: found by the marks, decoded from the symbols that cover them alone."""
    if n <= 0:
        return np.zeros(0, np.uint32)
    a = (int(np.searchsorted(g.marks, start, "right")) - 1) * MARK
    b = int(np.searchsorted(g.marks, start + n, "left")) * MARK
    ends = int(g.marks[a // MARK]) + np.cumsum(g.width(g.symbols[a:b]))
    i, j = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, start + n, "left")) + 1
    skipped = int(ends[i - 1]) if i else int(g.marks[a // MARK])
    return unfold(g, g.symbols[a:b][i:j])[start - skipped : start - skipped + n]
