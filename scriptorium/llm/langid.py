"""Language identification: nearest of several centroids per language, by cosine.

A text is the TF-IDF vector of its byte 1-, 2- and 3-grams (A-Z lower-cased,
each run of ASCII characters other than letters one space, hashed to DIMENSIONS
features, log term frequency, unit length).  The model is
fitted on a bounded sample of labelled rows: spherical k-means gives CLUSTERS
centroids for each language, and each centroid a least similarity below which a
text is rejected as too far from it.

Defined results: null text, or text without a letter, is ``und`` with score 0
and rejected.  Rows without a label or an id are never learnt from.  Without
any labelled row every text is ``und``.  Ties go to the first language in
alphabetical order.  Very long texts are read whole.  A text's score depends on
nothing but the text and the model, so repeated rows score alike; repeated ids
are learnt from alike.  An empty table gives an empty table.  All columns of the
input are kept in ``row``, so none clashes with the result's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import FOLD, pieces, utf8

DIMENSIONS = 4096
GRAMS = (1, 2, 3)
CLUSTERS = 3
#: Least share of a language's rows in a cluster.
LEAST_CLUSTER = 0.05
#: A text is rejected below RADIUS times the similarity that all but 1 % of its cluster's rows have.
RADIUS = 0.75
#: Rows whose vectors are held at once, and languages that are learnt at most (the most frequent ones).
BLOCK_ROWS, MOST_LANGUAGES = 256, 500
#: About so many labelled rows of each language are learnt from, those with the least hash of the id.
ROWS_PER_LANGUAGE = 400
UNKNOWN = "und"
_MULTIPLIER = np.uint32(2654435761)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PLAIN = FOLD.copy()
_PLAIN[:128][~_ASCII_LETTER[:128]] = 32


def vectors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, DIMENSIONS) log term frequencies."""
    folded = _PLAIN[data]
    keep = folded != 32
    after = np.zeros(len(keep), bool)
    after[1:] = keep[:-1]
    after[off[:-1][off[:-1] < len(keep)]] = False  # a row's first space follows nothing, whatever the row before ends with
    keep |= after
    off = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[off]
    folded = folded[keep].astype(np.uint32)
    rows, n = len(off) - 1, len(folded)
    row = np.repeat(np.arange(rows), np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    counts = np.zeros(rows * DIMENSIONS, np.float32)
    shift = np.uint32(32 - int(np.log2(DIMENSIONS)))
    code = np.zeros(n, np.uint32)
    for k in range(1, max(GRAMS) + 1):
        code = code[: n - k + 1] * np.uint32(256) + folded[k - 1 :]
        if n < k:
            break
        if k in GRAMS:
            whole = left[: n - k + 1] >= k
            feature = ((code + np.uint32(k << 24)) * _MULTIPLIER) >> shift
            counts += np.bincount(row[: n - k + 1][whole] * DIMENSIONS + feature[whole], minlength=rows * DIMENSIONS)
    return np.log1p(counts, out=counts).reshape(rows, DIMENSIONS)


def blocks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch bounded in bytes of text and in rows."""
    for piece in pieces(batch, text):
        for at in range(0, piece.num_rows, BLOCK_ROWS):
            yield piece.slice(at, BLOCK_ROWS)


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data], dtype=np.int64)])
    out = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~out & (off[1:] > off[:-1])):
        out[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode())
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray
    least: np.ndarray

    def similarities(self, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return x @ self.centroids.T

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0..1 and whether the text is rejected."""
        if not self.languages:
            rows = len(off) - 1
            return [UNKNOWN] * rows, np.zeros(rows), np.ones(rows, bool)
        s = self.similarities(vectors(data, off))
        best = s.argmax(1)
        score = np.clip(s[np.arange(len(s)), best].astype(np.float64), 0, 1)
        letters = has_letter(data, off)
        # a short text has few grams and is far from every centroid: it must only be as near as its length allows
        length = np.diff(off)
        rejected = ~letters | (score < self.least[best] * np.sqrt(length / (length + 150.0)))
        return [self.languages[self.language[b]] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0), rejected


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means++ (fixed seed); clusters of less than LEAST_CLUSTER of the rows are given up, so outliers get no centroid of their own."""
    rng = np.random.default_rng(17)
    c = x[rng.integers(len(x))][None]
    for _ in range(1, min(k, len(x))):
        far = np.maximum(1 - (x @ c.T).max(1), 0).astype(np.float64) ** 2
        if not far.sum():
            break
        c = np.vstack([c, x[rng.choice(len(x), p=far / far.sum())]])
    while True:
        for _ in range(rounds):
            own = (x @ c.T).argmax(1)
            c = np.array([x[own == j].mean(0) for j in range(len(c)) if (own == j).any()])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        size = np.bincount((x @ c.T).argmax(1), minlength=len(c))
        if len(c) == 1 or size.min() >= LEAST_CLUSTER * len(x):
            return c
        c = np.delete(c, size.argmin(), 0)


def train(tf: np.ndarray, labels: list[str]) -> Model:
    """The model of (rows, DIMENSIONS) term frequencies and their languages."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros(0, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    x = tf * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    own = np.array([languages.index(v) for v in labels])
    centroids, language, least = [], [], []
    for i in range(len(languages)):
        rows = x[own == i]
        found = _kmeans(rows, CLUSTERS)
        s = rows @ found.T
        for j in range(len(found)):
            near = s[s.argmax(1) == j, j]
            least.append(RADIUS * float(np.quantile(near, 0.01)) if len(near) else 0.0)
        centroids.append(found)
        language += [i] * len(found)
    return Model(languages, idf, np.concatenate(centroids).astype(np.float32), np.array(language), np.array(least))


_SPARSE = "lang string, feature array<int>, weight array<float>"


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in blocks(batch, 1):
            tf = vectors(*utf8(piece.column(1)))
            at = [np.flatnonzero(x).astype(np.int32) for x in tf]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(at, pa.list_(pa.int32())), pa.array([x[i] for x, i in zip(tf, at, strict=True)], pa.list_(pa.float32()))], names=["lang", "feature", "weight"])


def held_out(id_col: Column) -> Column:
    """Rows kept apart for measuring; a null id is not."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from text and language of labelled rows that are not held out, about ``rows_per_language`` each."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null").where(~held_out(F.col("id")))
    share = F.lit(None).cast("double")
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    for x in sorted(counts, key=lambda r: r["lang"]):
        share = F.when(F.col("lang") == x["lang"], F.lit(min(1.0, rows_per_language / x["count"]))).otherwise(share)
    chosen = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).orderBy(F.xxhash64("id"), "id").limit(2 * rows_per_language * max(1, len(counts)))
    rows = chosen.select("lang", "text").mapInArrow(_featurise, _SPARSE).collect() if counts else []
    tf = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, r in enumerate(rows):
        tf[i, r["feature"]] = r["weight"]
    return train(tf, [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` as ``row`` (all its columns) with lang_pred, score and rejected."""
    names = ["lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks(batch, 1):
                lang, score, rejected = model.predict(*utf8(piece.column(1)))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lang), pa.array(score), pa.array(rejected)], names=["row", *names])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    row_type = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {row_type}, lang_pred string, score double, rejected boolean")
