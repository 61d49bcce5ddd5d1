"""Model calls behind one interface: Arrow batches in, Arrow batches out, a deterministic stand-in by default.

A model is loaded once per worker by ``load`` and called on whole batches, so a
real text generator, embedder or cross-encoder replaces the stand-in without a
change to any plan.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from scriptorium.functions.text import fixed_chunks
from scriptorium.plans.scratch import stored

from .retrieval import vector_top_k


class EchoGenerator:
    """Answers a prompt with its first sentence."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [(p or "").strip().split(".")[0][:200] for p in prompts]


def generate(load: Callable[[], Callable[[list[str]], list[str]]] = EchoGenerator) -> Callable[[Column], Column]:
    """A column function prompt -> text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.tolist()))

    return run


class HashEmbedder:
    """Bags of words hashed to ``dim`` places, unit length; the stand-in for a sentence encoder."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", (text or "").lower()):
                row[zlib.crc32(word.encode()) % self.dim] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(load: Callable[[], Callable[[list[str]], np.ndarray]] = HashEmbedder, batch: int = 16) -> Callable[[Column], Column]:
    """A column function text -> normalised vector; a model of any kind, local or behind a service, is called on ``batch`` texts at a time."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            found = [np.asarray(model(texts.iloc[i : i + batch].tolist()), np.float64) for i in range(0, len(texts), batch)]
            x = np.concatenate(found) if found else np.zeros((0, 1))
            yield pd.Series(list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)))

    return run


#: Rows that leave a worker at once, with their vectors.
SLICE = 128


def vectors_of(load: Callable[[], Callable[[list[str]], np.ndarray]] = HashEmbedder, batch: int = 16) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """As :func:`embed`, from Arrow batches whose last column is the text to ones with the vector in its place, in slices of SLICE rows, so that a worker holds few vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for rows in batches:
            for at in range(0, rows.num_rows, SLICE):
                part = rows.slice(at, SLICE)
                texts = part.column(part.num_columns - 1).to_pylist()
                x = np.concatenate([np.asarray(model(texts[i : i + batch]), np.float64) for i in range(0, len(texts), batch)])
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1])), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*part.schema.names[:-1], "embedding"])

    return run


class CosineScorer:
    """Scores (query, text) pairs by the cosine of their embeddings; the stand-in for a cross-encoder."""

    def __init__(self) -> None:
        self.encoder = HashEmbedder()

    def __call__(self, queries: list[str], texts: list[str]) -> np.ndarray:
        return (self.encoder(queries) * self.encoder(texts)).sum(1)


def pair_score(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]] = CosineScorer) -> Callable[[Column, Column], Column]:
    """A column function (query, text) -> score, rounded to six places."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            yield pd.Series(np.round(np.asarray(model(queries.tolist(), texts.tolist()), np.float64), 6))

    return run


def search_chunks(docs: DataFrame, queries: DataFrame, *, k: int = 5, size: int = 3500, overlap: int = 400, load: Callable[[], Callable[[list[str]], np.ndarray]] = HashEmbedder) -> DataFrame:
    """(query_id, doc_id, chunk, score, rank): docs (doc_id, text) cut into chunks, embedded, stored, and searched for queries (query_id, text)."""
    def embedded(rows: DataFrame) -> DataFrame:
        kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes[:-1])
        return rows.mapInArrow(vectors_of(load), f"{kinds}, embedding array<double>")

    chunks = docs.select("doc_id", F.posexplode(fixed_chunks(F.col("text"), size, overlap)).alias("chunk", "text"))
    index = stored(embedded(chunks.select("doc_id", "chunk", F.monotonically_increasing_id().alias("vec_id"), "text")), "chunk_index")
    found = vector_top_k(index, stored(embedded(queries.select("query_id", "text")).select("query_id", F.col("embedding").alias("query")), "query_vectors"), k, cosine=True)
    return found.join(index.select("vec_id", "doc_id", "chunk"), "vec_id")


def map_reduce(parts: DataFrame, key: str, order: str, text: str, each: str, whole: str, load: Callable[[], Callable[[list[str]], list[str]]] = EchoGenerator) -> DataFrame:
    """(key, parts, summary): every part through the template ``each``, a key's answers in order through ``whole``."""
    answer = generate(load)
    highlights = parts.select(key, order, answer(prompt(each, text=F.col(text))).alias("h"))
    joined = highlights.groupBy(key).agg(F.count("*").alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda x: x["h"]), " / ").alias("all"))
    return joined.select(key, "parts", answer(prompt(whole, text=F.col("all"))).alias("summary"))


@dataclass(frozen=True)
class Settings:
    """How models are run; :meth:`validate` raises on what cannot work."""

    backend: str = "transformers"
    chunk_chars: int = 3500
    overlap_chars: int = 400
    top_k: int = 5
    concurrency: int = 1
    speculative: str = "none"
    speculative_tokens: int = 16

    def validate(self) -> None:
        checks = {
            "backend is transformers, vllm or ollama": self.backend in ("transformers", "vllm", "ollama"), "chunk_chars is positive": self.chunk_chars > 0, "overlap_chars is at least 0 and below chunk_chars": 0 <= self.overlap_chars < self.chunk_chars,
            "top_k is positive": self.top_k > 0, "concurrency is positive": self.concurrency > 0, "speculative is none or dflash": self.speculative in ("none", "dflash"), "speculative_tokens is positive": self.speculative_tokens > 0,
        }
        failed = [what for what, ok in checks.items() if not ok]
        if failed:
            raise ValueError("settings must hold: " + "; ".join(failed))


class Mlp:
    """A 7-64-32-1 network with ReLU and a logistic end; weights are given or follow from a seed."""

    def __init__(self, weights: list[tuple[np.ndarray, np.ndarray]] | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        sizes = [7, 64, 32, 1]
        self.weights = weights or [(rng.normal(0, 0.3, (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for w, b in self.weights[:-1]:
            x = np.maximum(x @ w + b, 0)
        w, b = self.weights[-1]
        return 1 / (1 + np.exp(-(x @ w + b)[:, 0]))


def train_mlp(x: np.ndarray, y: np.ndarray, *, epochs: int = 60, batch: int = 64, rate: float = 3e-3, decay: float = 1e-2, held: float = 0.2, seed: int = 7) -> tuple[Mlp, list[float]]:
    """(the network of the best validation loss, that loss per epoch): cross-entropy by decoupled-decay Adam over a bounded table of features and 0..1 labels."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = max(1, int(held * len(x)))
    val, train = order[:cut], order[cut:]
    net = Mlp(seed=seed)
    flat = [p for pair in net.weights for p in pair]
    m, v = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
    best, losses, step = None, [], 0
    for _ in range(epochs):
        for at in range(0, len(train), batch):
            some = train[at : at + batch]
            layers = [x[some]]
            for w, b in net.weights[:-1]:
                layers.append(np.maximum(layers[-1] @ w + b, 0))
            w, b = net.weights[-1]
            out = 1 / (1 + np.exp(-(layers[-1] @ w + b)[:, 0]))
            back, grads = ((out - y[some]) / len(some))[:, None], []
            for i in range(len(net.weights) - 1, -1, -1):
                grads = [layers[i].T @ back, back.sum(0), *grads]
                back = (back @ net.weights[i][0].T) * (layers[i] > 0)
            step += 1
            for i, (p, g) in enumerate(zip(flat, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p *= 1 - rate * decay * (p.ndim == 2)
                p -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        guess = np.clip(net(x[val]), 1e-7, 1 - 1e-7)
        losses.append(float(-(y[val] * np.log(guess) + (1 - y[val]) * np.log(1 - guess)).mean()))
        if losses[-1] == min(losses):
            best = [(w.copy(), b.copy()) for w, b in net.weights]
    return Mlp(best), losses


def mlp_score(features: Column, model: Mlp | None = None) -> Column:
    """Score of an array column of seven features."""
    scorer = model or Mlp()

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(scorer(np.array(x.tolist(), np.float64).reshape(-1, 7)))

    return run(features)


def prompt(template: str, **fields: Column) -> Column:
    """The template with each ``{name}`` replaced by its column."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
