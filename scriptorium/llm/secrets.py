"""Secret scans: fixed patterns, plus candidates whose format a learnt automaton finds likely.

The base patterns' matches in all documents label credentials.  From all distinct
ones of a kind, of any length, one probabilistic automaton is inferred (state
merging, see :mod:`automata`), however few they are, and from all distinct other
runs of credential characters the bigrams of ordinary words; nothing is sampled.
Executors find, count and classify both; the driver gets the credentials' distinct
strings of classes with their counts, and the counts of bigrams.  Then every
candidate of every whole text is scored: each run of credential characters outside
the base spans and, where the run as a whole has no format, each run of letters and
digits in it, from the length of the shortest credential learnt.  A candidate
becomes a ``format`` span if the likelihood of its symbols and of its length under
some kind are in the range of that kind's credentials (neither too low nor, like a
run of one digit, too high), and their sum is EVIDENCE_BITS more than under
ordinary words.

Defined results: null text is empty and has no span; very long texts are scanned
whole.  Offsets are code points, end exclusive; spans that start together are
ordered as the kinds are listed.  Without any labelled credential there are no
format spans.  Repeated rows are scanned alike; an empty table gives an empty
table; of other columns only ``id_col`` is returned, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.scratch import drop_stored, stored

from .automata import CLASSES, Automaton, Background, classes, infer_counted, pair_counts

KINDS = ("assign", "access", "hex", "format")
EVIDENCE_BITS = 12.0
#: No sample is drawn: words come from all documents. Nothing reads the name; it stays for callers that set it.
SAMPLE_DOCS = None


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


_ASSIGN = re.compile("(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_LONG = re.compile(r"[A-Za-z0-9+/_.=-]{24,}")
_PART = re.compile("[A-Za-z0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the base patterns, leftmost and not overlapping within each kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for c in _LONG.finditer(text):  # a run of 24 hex digits lies within one
        out += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text, c.start(), c.end()) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


#: Judgements that a worker keeps, words that it has handed over, and how long those are, and strings, and characters of texts, for which it hands over at once; bounds on memory only.
_KEPT, _MET, _MET_CHARS, _AT_ONCE, _TEXT_AT_ONCE = 500_000, 100_000, 64, 20_000, 1 << 24


@dataclass
class Model:
    automata: dict[str, Automaton]
    background: Background
    known: dict[str, bool] = field(default_factory=dict, repr=False)

    @property
    def shortest(self) -> int:
        return min((a.shortest for a in self.automata.values()), default=0)

    def likely(self, candidate: str) -> bool:
        text = classes(candidate)
        found = self.known.get(text)
        if found is None:
            if len(self.known) >= _KEPT:
                self.known.clear()
            found = self.known[text] = any(a.in_format(text) and a.bits(text) - self.background.bits(text) >= EVIDENCE_BITS for a in self.automata.values())
        return found

    def formats(self, run: str, least: int) -> list[tuple[int, int]]:
        """The run if it has a format, else those of its parts that have."""
        if len(run) >= least and self.likely(run):
            return [(0, len(run))]
        parts = [m.span() for m in _PART.finditer(run)]
        return [(a, b) for a, b in parts if least <= b - a < len(run) and self.likely(run[a:b])]


def spans(text: str, model: Model | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, as (start, end, kind) in order."""
    base = [x[:3] for x in base_spans(text)]
    if model is None or not model.automata:
        return base, base
    found, least = list(base), model.shortest
    taken = sorted((a, b) for a, b, _ in base)
    # most texts have no run of any format: each distinct one is judged, and places are looked up only if one has
    if not taken and not any(model.formats(run, least) for run in set(_CANDIDATE.findall(text))):
        return base, base
    for c in _CANDIDATE.finditer(text):
        free, at = [], c.start()
        for a, b in taken:
            if b > at and a < c.end():
                free.append((at, a))
                at = max(at, b)
        free.append((at, c.end()))
        for a, b in free:
            if b - a >= least:
                found += [(a + x, a + y, "format") for x, y in model.formats(text[a:b], least)]
    return base, sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def words(text: str, found: list[tuple[int, int, str, str]]) -> set[str]:
    """The distinct candidate runs of a text that overlap none of its base spans, which are in order."""
    if not found:
        return set(_CANDIDATE.findall(text))
    out, at, end = set(), 0, 0
    for m in _CANDIDATE.finditer(text):
        while at < len(found) and found[at][0] < m.end():
            end = max(end, found[at][1])
            at += 1
        if end <= m.start():
            out.add(m[0])
    return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value) of the credentials and, as kind ``word``, of the ordinary words of texts; some more than once."""
    met: set[str] = set()
    kinds: list[str] = []
    values: list[str] = []
    chars = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = base_spans(text or "")
            fresh = words(text or "", found) - met
            kinds += [kind for _, _, kind, _ in found] + ["word"] * len(fresh)
            values += [value for *_, value in found] + list(fresh)
            if len(met) >= _MET:
                met.clear()
            met.update(w for w in fresh if len(w) <= _MET_CHARS)
            chars += len(text or "")
            if len(values) >= _AT_ONCE or chars >= _TEXT_AT_ONCE and values:
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(values)], names=["kind", "value"])
                kinds, values, chars = [], [], 0
    if values:
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(values)], names=["kind", "value"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        counts.update(pair_counts(batch.column(0).to_pylist()))
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in counts]), pa.array([b for _, b in counts]), pa.array(list(counts.values()), pa.int64())], names=["a", "b", "n"])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn the formats of all distinct credentials in all documents, and the bigrams of all their distinct ordinary words; no id is read."""
    met = stored(docs.select(F.col(text_col).alias("text")).mapInArrow(_met, "kind string, value string").distinct(), "credentials")
    symbols = F.translate("value", "".join(CLASSES), "".join(name * len(chars) for chars, name in CLASSES.items()))
    labelled = met.where(F.col("kind") != "word").select("kind", symbols.alias("text")).groupBy("kind", "text").count()
    known = labelled.orderBy(F.xxhash64("text"), "text").toArrow()
    automata = {}
    for kind in KINDS[:3]:
        own = known.filter(pc.equal(known["kind"], kind))
        if own.num_rows:
            automata[kind] = infer_counted(dict(zip(own["text"].to_pylist(), own["count"].to_pylist(), strict=True)))
    pairs = met.where(F.col("kind") == "word").select("value").mapInArrow(_pairs, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    drop_stored(met)
    return Model(automata, Background.counted(pairs))


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array of struct(kind, start, end), n_assign, n_access, n_hex, base_sha256, joined) per row; the id keeps its type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                both = [spans(t.as_py() or "", model) for t in part.column(1)]
                counts = [pa.array([sum(x[2] == k for x in base) for base, _ in both], pa.int64()) for k in KINDS[:3]]
                all_ = pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in found] for _, found in both], kind)
                digest = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in both])
                yield pa.RecordBatch.from_arrays([part.column(0), all_, *counts, digest, pa.array([_joined(found) for _, found in both])], names=["id", "spans", "n_assign", "n_access", "n_hex", "base_sha256", "joined"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>, n_assign long, n_access long, n_hex long, base_sha256 string, joined string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
