"""Probabilistic automata inferred from strings by state merging.

Strings are prefix trees of character classes with counts.  States merge when
their symbol and end frequencies agree within Hoeffding's bound, all the way
down: first states of equal depth, so that a position's states gather the
evidence that tells where strings end, then any two, which makes loops only
where lengths vary.  In the first part a state is the strings that reach it, and
the tree is never built: memory follows the strings' characters, so that all
strings of a corpus are learnt from, of any length.  In the second, merged states
are classes of a union-find, and what follows from a merge (equal symbols lead to
equal states) is merged with it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np

#: Class of each character of a credential; characters of no class are one more class.
CLASSES = {"0123456789": "d", "abcdef": "x", "ghijklmnopqrstuvwxyz": "l", "ABCDEF": "X", "GHIJKLMNOPQRSTUVWXYZ": "U"}
_CLASS = {ord(c): name for chars, name in CLASSES.items() for c in chars}
_N_SYMBOLS = 12
#: Of a symbol, and of an end, that a state has not seen.
_UNSEEN = 0.05
#: How much lower than the lowest held-out score a symbol, and how much lower an end, may be (bits).
_SLACK, _END_SLACK = 0.15, 2.0


def classes(text: str) -> str:
    return text.translate(_CLASS)


def _width(alpha: float) -> float:
    return math.sqrt(0.5 * math.log(2 / alpha))


class Automaton:
    """Counts per state: ``next[state][symbol]`` is the state that follows, ``seen[state][symbol]`` how often."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[Counter] = [Counter()]
        self.ends: list[int] = [0]
        self._same: list[int] = [0]
        self.shortest, self.longest = 1, 0
        self.least, self.most, self.least_end = -math.inf, math.inf, -math.inf

    def find(self, state: int) -> int:
        while self._same[state] != state:
            self._same[state] = state = self._same[self._same[state]]
        return state

    def _total(self, state: int) -> int:
        return self.ends[state] + sum(self.seen[state].values())

    def states(self) -> list[int]:
        """The states that can be reached, in breadth-first order."""
        out = [self.find(0)]
        met = set(out)
        for s in out:
            for symbol in sorted(self.next[s]):
                t = self.find(self.next[s][symbol])
                if t not in met:
                    met.add(t)
                    out.append(t)
        return out

    def _new(self) -> int:
        self._same.append(len(self.next))
        self.next.append({})
        self.seen.append(Counter())
        self.ends.append(0)
        return len(self.next) - 1

    def _alike(self, a: int, b: int, alpha: float) -> bool:
        todo, met = [(a, b)], set()
        bound = _width(alpha)
        while todo:
            pair = todo.pop()
            if pair in met or pair[0] == pair[1]:
                continue
            met.add(pair)
            a, b = pair
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > most:
                return False
            for symbol in self.seen[a].keys() | self.seen[b].keys():
                if abs(self.seen[a][symbol] / n - self.seen[b][symbol] / m) > most:
                    return False
                if symbol in self.next[a] and symbol in self.next[b]:
                    todo.append((self.find(self.next[a][symbol]), self.find(self.next[b][symbol])))
        return True

    def _merge(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = map(self.find, todo.pop())
            if a == b:
                continue
            a, b = min(a, b), max(a, b)
            self._same[b] = a
            self.ends[a] += self.ends[b]
            self.seen[a].update(self.seen[b])
            for symbol, child in self.next[b].items():
                if symbol in self.next[a]:
                    todo.append((self.next[a][symbol], child))
                else:
                    self.next[a][symbol] = child

    def _merge_all(self, alpha: float) -> None:
        """Red-blue merging of any two compatible states."""
        red = [self.find(0)]
        while True:
            known = set(red)
            blue = sorted({self.find(c) for s in red for c in self.next[s].values()} - known, key=lambda s: (-self._total(s), s))
            if not blue:
                return
            like = next((r for r in red if self._alike(r, blue[0], alpha)), None)
            if like is None:
                red.append(blue[0])
            else:
                self._merge(like, blue[0])
                red = list(dict.fromkeys(map(self.find, red)))

    def _compact(self) -> None:
        """Drop the states that merges have left behind."""
        states = self.states()
        at = {s: i for i, s in enumerate(states)}
        self.next = [{symbol: at[self.find(t)] for symbol, t in self.next[s].items()} for s in states]
        self.seen, self.ends = [self.seen[s] for s in states], [self.ends[s] for s in states]
        self._same = list(range(len(states)))

    def _likely_next(self, state: int) -> int | None:
        """Where the most frequent symbol leads."""
        return self.next[state][max(sorted(self.seen[state]), key=self.seen[state].get)] if self.seen[state] else None

    def score(self, text: str) -> tuple[float, float]:
        """log2 of the probability of a string's symbols, and of its length (going on at every state but the last).

        A symbol that a state has not seen has a small fixed probability, and
        the state's most frequent successor follows.
        """
        state, symbols, ends = self.find(0), 0.0, 0.0
        for symbol in text:
            n, e = self._total(state), self.ends[state]
            ends += math.log2((n - e + _UNSEEN) / (n + 2 * _UNSEEN))
            symbols += math.log2((self.seen[state][symbol] + _UNSEEN) / (n - e + _N_SYMBOLS * _UNSEEN))
            after = self.next[state].get(symbol)
            if after is None:
                after = self._likely_next(state)
            state = self.find(after) if after is not None else state
        n = self._total(state)
        return symbols, ends + math.log2((self.ends[state] + _UNSEEN) / (n + 2 * _UNSEEN))

    def bits(self, text: str) -> float:
        return sum(self.score(text))

    def in_format(self, text: str) -> bool:
        """Whether a string's likelihood a symbol and that of its length are as those of the strings learnt from."""
        if not self.shortest <= len(text) <= self.longest:
            return False
        symbols, ends = self.score(text)
        return self.least <= symbols / len(text) <= self.most and ends >= self.least_end


class _Strings:
    """Strings as codes, one after the other, each closed by the code 0; they hold no NUL."""

    def __init__(self, texts: Sequence[str]):
        codes = np.frombuffer("".join(f"{t}\0" for t in texts).encode("utf-32-le"), "<u4")
        met = np.flatnonzero(np.bincount(codes, minlength=1)[1:]) + 1
        self.symbols = [chr(c) for c in met]
        code = np.zeros(int(met.max(initial=0)) + 1, np.min_scalar_type(len(met)))
        code[met] = np.arange(1, len(met) + 1)
        self.flat = code[codes]
        closed = np.flatnonzero(self.flat == 0)
        self.start = np.concatenate([[0], closed[:-1] + 1]) if len(closed) else closed
        self.length = closed - self.start

    def at(self, rows: np.ndarray, depth: int) -> np.ndarray:
        return self.flat[self.start[rows] + depth].astype(np.int64)


def _alike_below(strings: _Strings, weight: np.ndarray, both: Sequence[np.ndarray], depth: int, bound: float) -> bool:
    """Whether two sets of strings agree, all the way down, in what follows their first ``depth`` symbols."""
    n = len(strings.symbols) + 1
    rows, node, nodes = list(both), [np.zeros(len(r), np.int64) for r in both], 1
    while nodes:
        keys = [at * n + strings.at(r, depth) for at, r in zip(node, rows, strict=True)]
        seen = [np.bincount(k, weight[r], nodes * n) for k, r in zip(keys, rows, strict=True)]
        total = [x.reshape(nodes, n).sum(1) for x in seen]
        most = bound * (1 / np.sqrt(total[0]) + 1 / np.sqrt(total[1]))
        if (np.abs(np.subtract(*(x.reshape(nodes, n) / t[:, None] for x, t in zip(seen, total, strict=True)))) > most[:, None]).any():
            return False
        # frequencies differ by 1 at most, so states with a bound of 1 or more never disagree, nor do those below them
        with np.errstate(divide="ignore"):
            undecided = bound * (1 / np.sqrt(seen[0]) + 1 / np.sqrt(seen[1])) < 1
        undecided[::n] = False
        place = np.cumsum(undecided) - 1
        nodes = int(undecided.sum())
        for i in (0, 1):
            stay = undecided[keys[i]]
            rows[i], node[i] = rows[i][stay], place[keys[i][stay]]
        depth += 1
    return True


def _layers(strings: _Strings, weight: np.ndarray, alpha: float) -> Automaton:
    """The prefix tree with compatible states of equal depth merged, from the root on, the most frequent first."""
    found, bound, n = Automaton(), _width(alpha), len(strings.symbols) + 1
    layer, depth = [(0, np.flatnonzero(weight))], 0
    while layer:
        if len(layer) == 1 and len(layer[0][1]) == 1:
            _chain(found, strings, weight, layer[0], depth)
            break
        children = []
        for rank, (state, rows) in enumerate(layer):
            code = strings.at(rows, depth)
            seen = np.bincount(code, weight[rows], n).astype(np.int64).tolist()
            found.ends[state] = seen[0]
            found.seen[state].update({strings.symbols[c - 1]: seen[c] for c in range(1, n) if seen[c]})
            parts = np.split(rows[np.argsort(code, kind="stable")], np.cumsum(np.bincount(code, minlength=n))[:-1])
            children += [(-seen[c], rank, c, state, parts[c]) for c in range(1, n) if seen[c]]
        kept: list[list] = []
        depth += 1
        for less, _, c, state, rows in sorted(children, key=lambda x: x[:3]):
            like = None
            for k in kept:
                if bound * (1 / math.sqrt(k[1]) + 1 / math.sqrt(-less)) >= 1 or _alike_below(strings, weight, (k[2], rows), depth, bound):
                    like = k
                    break
            if like is None:
                kept.append(like := [found._new(), -less, rows])
            else:
                like[1:] = like[1] - less, np.concatenate([like[2], rows])
            found.next[state][strings.symbols[c - 1]] = like[0]
        layer = [(state, rows) for state, _, rows in kept]
    return found


def _chain(found: Automaton, strings: _Strings, weight: np.ndarray, last: tuple[int, np.ndarray], depth: int) -> None:
    """The states of one string from a depth on."""
    state, row = last[0], int(last[1][0])
    often, start = int(weight[row]), strings.start[row]
    for code in strings.flat[start + depth : start + strings.length[row]].tolist():
        symbol = strings.symbols[code - 1]
        found.seen[state][symbol] = often
        found.next[state][symbol] = state = found._new()
    found.ends[state] = often


def _grown(strings: _Strings, weight: np.ndarray, alpha: float) -> Automaton:
    found = _layers(strings, weight, alpha)
    found._merge_all(alpha)
    found._compact()
    return found


def _scores(found: Automaton, strings: _Strings) -> tuple[np.ndarray, np.ndarray]:
    """``found.score`` of all strings."""
    k, n = len(found.next), len(strings.symbols) + 1
    after, bits = np.zeros((k, n), np.int64), np.zeros((k, n))
    on, end = np.zeros(k), np.zeros(k)
    for s in range(k):
        total, ends, likely = found._total(s), found.ends[s], found._likely_next(s)
        on[s] = math.log2((total - ends + _UNSEEN) / (total + 2 * _UNSEEN))
        end[s] = math.log2((ends + _UNSEEN) / (total + 2 * _UNSEEN))
        for c, symbol in enumerate(strings.symbols, 1):
            bits[s, c] = math.log2((found.seen[s][symbol] + _UNSEEN) / (total - ends + _N_SYMBOLS * _UNSEEN))
            after[s, c] = found.next[s].get(symbol, s if likely is None else likely)
    rows, depth = np.arange(len(strings.start)), 0
    state, symbols, ends = np.zeros(len(rows), np.int64), np.zeros(len(rows)), np.zeros(len(rows))
    while len(rows):
        code = strings.at(rows, depth)
        over = rows[code == 0]
        ends[over] += end[state[over]]
        rows, code = rows[code > 0], code[code > 0]
        at = state[rows]
        symbols[rows] += bits[at, code]
        ends[rows] += on[at]
        state[rows] = after[at, code]
        depth += 1
    return symbols, ends


def infer(strings: Iterable[str], alpha: float = 0.1) -> Automaton:
    """The automaton of labelled strings (see :func:`infer_counted`)."""
    return infer_counted(Counter(classes(s) for s in strings if s), alpha)


def infer_counted(known: dict[str, int], alpha: float = 0.1) -> Automaton:
    """The automaton of strings of classes that occur so many times each.

    The range of scores that counts as the format is that of the strings each
    scored by an automaton of the other half, every second string (a single one:
    by its own).
    """
    strings, weight = _Strings(list(known)), np.fromiter(known.values(), np.int64, len(known))
    found = _grown(strings, weight, alpha)
    if known:
        upto = np.cumsum(weight)
        first = (upto + 1) // 2 - (upto - weight + 1) // 2
        halves = (first, weight - first)
        held = [(_scores(_grown(strings, a, alpha), strings), b) for a, b in (halves, halves[::-1]) if a.any() and b.any()] or [(_scores(found, strings), weight)]
        often, total = np.concatenate([b for _, b in held]), int(upto[-1])
        cut = total // 100

        def ranked(scores: np.ndarray, *ranks: int) -> list[float]:
            order = np.argsort(scores, kind="stable")
            return scores[order][np.searchsorted(np.cumsum(often[order]), ranks, side="right")].tolist()

        low, high = ranked(np.concatenate([x / strings.length for (x, _), _ in held]), cut, total - 1 - cut)
        found.least, found.most = low - _SLACK, high + _SLACK
        found.least_end = ranked(np.concatenate([y for (_, y), _ in held]), cut)[0] - _END_SLACK
        found.shortest, found.longest = int(strings.length.min()), int(strings.length.max())
    return found


class Background:
    """Class bigrams of ordinary words."""

    def __init__(self, words: Iterable[str]):
        self.pairs: Counter = Counter()
        self.firsts: Counter = Counter()
        for w in words:
            text = f"^{classes(w)}$"
            self.pairs.update(zip(text, text[1:], strict=False))
            self.firsts.update(text[:-1])

    @classmethod
    def counted(cls, pairs: Iterable[tuple[str, str, int]]) -> Background:
        """From the bigrams' counts (see :func:`pair_counts`), those of an equal pair added."""
        found = cls([])
        for a, b, n in pairs:
            found.pairs[a, b] += n
            found.firsts[a] += n
        return found

    def bits(self, text: str) -> float:
        text = f"^{text}$"
        return sum(math.log2((self.pairs[a, b] + 0.5) / (self.firsts[a] + 0.5 * _N_SYMBOLS)) for a, b in zip(text, text[1:], strict=False))


def pair_counts(words: Sequence[str]) -> Counter:
    """The class bigrams of words of ASCII characters but ``^`` and ``$``, which stand for their start and end."""
    if not words:
        return Counter()
    codes = np.frombuffer(("^" + "$^".join(words) + "$").translate(_CLASS).encode("ascii"), np.uint8).astype(np.int64)
    found = np.bincount(codes[:-1] * 128 + codes[1:])
    return Counter({(chr(k // 128), chr(k % 128)): int(found[k]) for k in np.flatnonzero(found).tolist() if chr(k // 128) != "$"})
