"""Quality rules as a short-circuit cascade.

Each rule is one array expression over a block of whole texts.  Features of a
block (words, their hashes, counts a row) are computed once, by the first rule
that needs them, and a block's survivors keep theirs.  A sample gives each
rule's selectivity and the cost of its features; the order is built rule by rule:
next comes the one that rejects most of the rows still alive for the seconds it
adds to what is already computed.  Each rule sees only the rows that all earlier
ones kept.  The order changes the cost only: a text is kept if and only if no
rule rejects it.

Defined results: null text has no words and fails the base rule; very long texts
are read whole; an empty table gives an empty table; repeated rows are judged
alike; rules of equal worth go by name.  Only ``id_col`` of the input is returned,
so no other column's name can clash.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import mix, pieces, span_hashes, utf8, words
from .tokens import ragged

#: Rows (about) from which costs and selectivities are estimated.
SAMPLE_ROWS = 1000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


class Block:
    """Whole texts of some rows, with their features computed on first use."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.rows = data, off, len(off) - 1

    def subset(self, rows: np.ndarray) -> Block:
        """The block of some rows, with what is already known of them."""
        lengths = self.off[rows + 1] - self.off[rows]
        out = Block(self.data[ragged(self.off[rows], lengths)], np.concatenate([[0], np.cumsum(lengths)]))
        known = self.__dict__
        place = np.full(self.rows, -1)
        place[rows] = np.arange(len(rows))
        for name in _PER_ROW:
            if name in known:
                out.__dict__[name] = known[name][rows]
        if "words" in known:
            s, e, row = known["words"]
            mine = place[row] >= 0
            to = place[row[mine]]
            shift = out.off[to] - self.off[row[mine]]
            out.__dict__["words"] = (s[mine] + shift, e[mine] + shift, to)
            if "word_hashes" in known:
                out.__dict__["word_hashes"] = known["word_hashes"][mine]
        if "lines" in known:
            row, again = known["lines"]
            mine = place[row] >= 0
            out.__dict__["lines"] = (place[row[mine]], again[mine])
        return out

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each row has."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def distinct(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For elements with a row and a hash: how often each stands in its row, and whether it is its row's first."""
        if not len(h):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        keys = mix(h ^ mix(row.astype(np.uint64), 3), 4)
        _, first, index, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        is_first = np.zeros(len(h), bool)
        is_first[first] = True
        return counts[index], is_first

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return words(self.data, self.off)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.words[0], self.words[1])

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.words[2], minlength=self.rows)

    @cached_property
    def word_chars(self) -> np.ndarray:
        s, e, row = self.words
        starts = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int64)])
        return np.bincount(row, starts[e] - starts[s], self.rows).astype(np.int64)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.per_row(_SYMBOL[self.data])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of each line that holds a word, and whether an equal line came earlier in its row."""
        breaks = np.flatnonzero(self.data == 10)
        s = np.sort(np.concatenate([breaks + 1, self.off[:-1]]))
        e = np.sort(np.concatenate([breaks, self.off[1:]]))
        row = np.sort(np.concatenate([np.searchsorted(self.off, breaks, "right") - 1, np.arange(self.rows)]))
        ws = self.words[0]
        filled = np.searchsorted(ws, e, "left") > np.searchsorted(ws, s, "left")
        s, e, row = s[filled], e[filled], row[filled]
        _, first = self.distinct(row, span_hashes(self.data, s, e))
        return row, ~first

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=self.rows)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0][self.lines[1]], minlength=self.rows)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        row, h = self.words[2], self.word_hashes
        if len(h) < 3:
            return np.zeros(self.rows, np.int64)
        whole = row[:-2] == row[2:]
        at = np.flatnonzero(whole)
        grams = mix(mix(h[at], 7) + h[at + 1] * np.uint64(0x9FB21C651E98DF25), 8) + h[at + 2]
        counts, _ = self.distinct(row[at], grams)
        again = at[counts > 1]
        covered = np.zeros(len(h), bool)
        for j in range(3):
            covered[again + j] = True
        return np.bincount(row[covered], minlength=self.rows)

    @cached_property
    def letter_words(self) -> np.ndarray:
        """Words with a letter (bytes of A-Z, a-z, or leading bytes from 0xC3 on)."""
        s, e, row = self.words
        total = np.concatenate([[0], np.cumsum(_LETTER[self.data], dtype=np.int64)])
        return np.bincount(row[total[e] > total[s]], minlength=self.rows)

    @cached_property
    def top_word(self) -> np.ndarray:
        """Occurrences of each row's most frequent word."""
        counts, _ = self.distinct(self.words[2], self.word_hashes)
        out = np.zeros(self.rows, np.int64)
        np.maximum.at(out, self.words[2], counts)
        return out


#: Features with one value a row.
_PER_ROW = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "letter_words", "top_word")


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives one boolean per row of a block."""

    name: str
    rejects: Callable[[Block], np.ndarray]


def base_failed(b: Block) -> np.ndarray:
    return (b.n_words < 50) | (100 * b.n_repeat_words > 50 * b.n_words)


#: Production rules; the shares are of words or of lines with a word.
RULES = (
    Rule("base", base_failed),
    Rule("word_length", lambda b: (b.word_chars < 2 * b.n_words) | (b.word_chars > 15 * b.n_words)),
    Rule("symbols", lambda b: 100 * b.n_symbols > 30 * b.n_words),
    Rule("duplicate_lines", lambda b: 100 * b.n_dup_lines > 50 * b.n_lines),
    Rule("letters", lambda b: 100 * b.letter_words < 60 * b.n_words),
    Rule("top_word", lambda b: 100 * b.top_word > 40 * b.n_words),
)


def order(block: Block, rules: Sequence[Rule], metrics: Sequence[str]) -> list[tuple[str, float, int]]:
    """(rule, seconds it adds, rows it rejects) in the order in which rules pay best over a block.

    ``metrics`` are computed anyway, so no rule is charged for them.  A rule's
    seconds are those beyond the features already known when its turn comes.
    """
    known = Block(block.data, block.off)
    for m in metrics:
        getattr(known, m)
    alive, left, out = np.ones(block.rows, bool), list(rules), []
    while left:
        tried = []
        for rule in left:
            fresh = Block(block.data, block.off)
            fresh.__dict__.update(known.__dict__)
            began = time.perf_counter()
            bad = rule.rejects(fresh)
            tried.append((int((bad & alive).sum()) / max(time.perf_counter() - began, 1e-6), rule, bad, time.perf_counter() - began, fresh))
        _, rule, bad, seconds, known = min(tried, key=lambda t: (-t[0], t[1].name))
        out.append((rule.name, seconds, int((bad & alive).sum())))
        alive &= ~bad
        left.remove(rule)
    return out


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, *, metrics: Sequence[str] = (), text_col: str = "text") -> list[Rule]:
    """The rules by what each rejects for the seconds it adds, over about SAMPLE_ROWS rows drawn where they lie.

    Every task orders the rules on its own part of the sample; worth is summed
    over the tasks, so no text moves.
    """
    n = docs.count()
    sample = docs.select(F.col(text_col).alias("text"), F.rand(17).alias("r")).where(F.col("r") < min(1.0, SAMPLE_ROWS / max(n, 1))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0):
                name, seconds, rejected = zip(*order(Block(*utf8(piece.column(0))), rules, metrics), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(seconds), pa.array(rejected, pa.int64())], names=["rule", "seconds", "rejected"])

    found = sample.mapInArrow(run, "rule string, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r")).collect()
    worth = {x.rule: x.r / max(x.s, 1e-9) for x in found}
    return sorted(rules, key=lambda rule: (-worth.get(rule.name, 0.0), rule.name))


def cascade(block: Block, rules: Sequence[Rule]) -> list[str | None]:
    """The first rule in this order that rejects each row, or None for the rows kept."""
    out = np.full(block.rows, None, object)
    alive = np.arange(block.rows)
    for rule in rules:
        if not len(alive):
            break
        bad = rule.rejects(block)
        if bad.any():
            out[alive[bad]] = rule.name
            alive = alive[~bad]
            block = block.subset(np.flatnonzero(~bad))
    return out.tolist()


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, *, metrics: Sequence[str] = METRICS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, the metrics, base_failed, kept, rejected_by) per row; ``rules`` None means RULES ordered on a sample.

    Metrics asked for are computed of every row, and rules use them for nothing;
    with ``metrics`` () a row costs no more than the rules up to its rejection
    (and base_failed, which then is null where another rule came first).
    """
    ordered = list(rules) if rules is not None else order_rules(docs, metrics=metrics, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                block = Block(*utf8(piece.column(1)))
                values = [pa.array(getattr(block, m).astype(np.int64)) for m in metrics]
                why = cascade(block, ordered)
                kept = np.array([x is None for x in why], bool)
                if {"n_words", "n_repeat_words"} <= set(metrics):
                    failed = base_failed(block)
                    kept &= ~failed
                    base = pa.array(failed)
                else:
                    base = pa.array([True if x == "base" else False if x is None else None for x in why], pa.bool_())
                yield pa.RecordBatch.from_arrays([piece.column(0), *values, base, pa.array(kept), pa.array(why, pa.string())], names=["id", *metrics, "base_failed", "kept", "rejected_by"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + "".join(f"{m} long, " for m in metrics) + "base_failed boolean, kept boolean, rejected_by string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
