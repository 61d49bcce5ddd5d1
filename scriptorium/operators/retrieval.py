"""Ranking: BM25, exact vector search, rank fusion and rerank features, for whole query sets at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import count_of, tokens
from scriptorium.plans.broadcasts import small
from scriptorium.plans.scratch import stored

#: Bytes of query weights (terms x queries, or dimensions x queries) that a task holds at once; larger query sets run in blocks.
BLOCK_BYTES = 32 << 20
#: Cells of a block of term counts (texts x terms).
_BLOCK_CELLS = 4_000_000


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Rank within each key, best k; ``order`` must be total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, cost: int) -> list[DataFrame]:
    """The (distinct) query set dealt by a hash into blocks whose weights, ``cost`` bytes a query, fit BLOCK_BYTES."""
    n = max(1, math.ceil(queries.count() * cost / BLOCK_BYTES))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def _best(ids: np.ndarray, scores: np.ndarray, k: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each query (column) its k best rows by rounded score, then id."""
    rounded = np.round(scores, 9)
    for j in range(scores.shape[1]):
        some = np.flatnonzero(scores[:, j] > least)
        if len(some) > k:
            edge = np.partition(rounded[some, j], len(some) - k)[len(some) - k]
            some = some[rounded[some, j] >= edge]
        yield j, some[np.lexsort((ids[some], -rounded[some, j]))[:k]]


_POSTINGS = "doc_id long, dl int, term array<int>, tf array<int>"


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, dl, term, tf): each text's length in tokens, and its counts of the terms of ``vocabulary`` by their index; stored."""
    known = pa.array(vocabulary, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            off = lists.offsets.to_numpy().astype(np.int64)
            found = pc.index_in(lists.values.cast(pa.string()), known).fill_null(-1).to_numpy(zero_copy_only=False)[off[0] : off[-1]]
            off = off - off[0]
            row = np.repeat(np.arange(batch.num_rows), np.diff(off))
            hit = found >= 0
            keys, counts = np.unique(row[hit] * len(vocabulary) + found[hit], return_counts=True)
            cut = pa.array(np.searchsorted(keys // max(len(vocabulary), 1), np.arange(batch.num_rows + 1)), pa.int32())
            terms = pa.ListArray.from_arrays(cut, pa.array(keys % max(len(vocabulary), 1), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off), pa.int32()), terms, pa.ListArray.from_arrays(cut, pa.array(counts, pa.int32()))], names=["doc_id", "dl", "term", "tf"])

    rows = docs.select("doc_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("toks"))
    return stored(rows.mapInArrow(run, _POSTINGS), "postings")


def vocabulary_of(queries: DataFrame) -> list[str]:
    """The distinct terms of a block of queries, in order."""
    return [r["term"] for r in queries.select(F.explode(tokens(F.col("text"))).alias("term")).distinct().orderBy("term").collect()]


def document_frequencies(found: DataFrame, terms: int) -> np.ndarray:
    df = np.zeros(terms)
    for r in found.select(F.explode("term").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    return df


def bm25(docs: DataFrame, queries: DataFrame, *, k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank) from docs (doc_id, text) and queries (query_id, text), whole texts both.

    Repeated query terms count; idf = ln(1 + (N - df + 0.5) / (df + 0.5)); hits
    score above zero.  Texts are tokenised once; their term counts (never the
    texts) meet the query weights as blocks of a matrix product, and a task
    passes on k rows a query.  The query set is bounded by blocks of its weights.
    """
    out = None
    sized = queries.select(F.sum(F.size(tokens(F.col("text")))).alias("t"), F.count("*").alias("q")).first()
    for block in _blocks(queries, 8 * max(1, int(sized["t"] or 1))):
        part = _bm25_block(docs, block, k, k1, b)
        out = part if out is None else out.unionByName(part)
    return top_k(out, ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], k)


def _bm25_block(docs: DataFrame, queries: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    vocabulary = vocabulary_of(queries)
    place = {t: i for i, t in enumerate(vocabulary)}
    terms = queries.select("query_id", tokens(F.col("text")).alias("toks")).orderBy("query_id").collect()
    found = postings(docs, vocabulary)
    totals = found.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    df = document_frequencies(found, len(vocabulary))
    idf = np.log(1 + (totals["n"] - df + 0.5) / (df + 0.5))
    weights = np.zeros((len(vocabulary), len(terms)))
    for j, r in enumerate(terms):
        np.add.at(weights[:, j], [place[t] for t in r["toks"] or []], 1.0)
    sent = docs.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in terms], np.int64), weights * idf[:, None]))
    average = totals["avgdl"] or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w = sent.value
        step = max(1, _BLOCK_CELLS // max(1, sum(w.shape)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                off = part.column(2).offsets.to_numpy().astype(np.int64)
                term, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.float64)
                dl = part.column(1).to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(off))
                x = np.zeros((part.num_rows, len(w)))
                x[row, term] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / average))
                scores = x @ w
                ids = part.column(0).to_numpy()
                rows = [(names[j], ids[some], scores[some, j]) for j, some in _best(ids, scores, k, 0.0) if len(some)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])), pa.array(np.concatenate([r[1] for r in rows])), pa.array(np.concatenate([r[2] for r in rows]))], names=["query_id", "doc_id", "score"])

    return found.mapInArrow(run, "query_id long, doc_id long, score double")


def phrase_hits(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, hits): how often each whole query stands in each text, in lower case, where it does at all.

    A text can hold a query only if it holds the query's inner tokens as tokens,
    so texts meet a query through its rarest inner token, by an equi-join, and
    the string search runs on those alone.  Queries of fewer than three tokens
    have no inner one: they are looked for in every text, as a broadcast list in
    blocks.
    """
    asked = queries.select("query_id", F.col("text").alias("asked"), tokens(F.col("text")).alias("toks")).where(F.length("asked") > 0)
    long = asked.where(F.size("toks") > 2).select("query_id", "asked", F.explode(F.array_distinct(F.slice("toks", 2, F.size("toks") - 2))).alias("term"))
    words = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    met = stored(words.join(small(long.select("term").distinct()), "term", "left_semi"), "phrase_terms")
    df = met.groupBy("term").agg(F.count("*").alias("df"))
    rarest = long.join(df, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")).where("r.df > 0").select("query_id", F.col("r.term").alias("term"))
    pairs = met.join(rarest, "term").select("doc_id", "query_id")
    texts = docs.select("doc_id", "text")
    hits = pairs.join(asked.select("query_id", "asked"), "query_id").join(texts, "doc_id")
    out = hits.select("query_id", "doc_id", count_of(F.col("text"), F.col("asked")).alias("hits"))
    short = asked.where(F.size("toks") <= 2).select("query_id", "asked")
    for block in _blocks(short, 1024) if not short.isEmpty() else []:
        packed = block.agg(F.collect_list(F.struct("query_id", "asked")).alias("qs"))
        found = texts.join(F.broadcast(packed)).select("doc_id", "text", F.explode("qs").alias("q"))
        out = out.unionByName(found.select("q.query_id", "doc_id", count_of(F.col("text"), F.col("q.asked")).alias("hits")))
    return out.where("hits > 0")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where the product of the norms is at most 1e-12."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms <= 1e-12, 0.0).otherwise(dot(a, b) / norms)


def scaled_cosine(c: Column) -> Column:
    return F.least(F.greatest((c + 1) / 2, F.lit(0.0)), F.lit(1.0))


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, *, cosine: bool = False) -> DataFrame:
    """Exact (query_id, vec_id, score, rank): top-k of queries (query_id, query) against vectors (vec_id, embedding) by inner product or cosine.

    Every vector meets the queries as one block of a matrix product in double
    precision, and a task passes on k rows a query.  A cosine is 0 where the
    product of the norms is at most 1e-12; vectors of another length than a
    query's have no score.  Query sets of any size run in blocks.
    """
    out = None
    first = queries.select(F.size("query").alias("n")).first()
    for block in _blocks(queries, 8 * max(1, first["n"] if first else 1)):
        rows = block.select("query_id", F.col("query").cast("array<double>").alias("query")).orderBy("query_id").collect()
        sent = vectors.sparkSession.sparkContext.broadcast([(r["query_id"], np.array(r["query"])) for r in rows if r["query"]])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for dim in {len(v) for _, v in sent.value}:
                own = [(i, v) for i, v in sent.value if len(v) == dim]
                by_length[dim] = np.array([i for i, _ in own], np.int64), np.stack([v for _, v in own], 1)
            for batch in batches:
                lengths = np.diff(batch.column(1).offsets.to_numpy())
                for dim, (names, q) in by_length.items():
                    at = np.flatnonzero((lengths == dim) & np.asarray(batch.column(1).is_valid()))
                    step = max(1, _BLOCK_CELLS // 4 // max(1, sum(q.shape)))
                    for i in range(0, len(at), step):
                        some = pa.array(at[i : i + step])
                        x = batch.column(1).take(some).flatten().to_numpy().astype(np.float64).reshape(len(some), dim)
                        ids = batch.column(0).take(some).to_numpy()
                        scores = x @ q
                        if cosine:
                            norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=0)[None, :]
                            scores = np.where(norms <= 1e-12, 0.0, scores / np.maximum(norms, 1e-12))
                        rows = [(names[j], ids[best], scores[best, j]) for j, best in _best(ids, scores, k, -np.inf) if len(best)]
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])), pa.array(np.concatenate([r[1] for r in rows])), pa.array(np.concatenate([r[2] for r in rows]))], names=["query_id", "vec_id", "score"])

        part = vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, ["query_id"], [F.desc(F.round("score", 9)), F.asc("vec_id")], k)


def rrf(lists: DataFrame, constant: int = 60) -> DataFrame:
    """(query_id, key, score, list_no, rank): reciprocal ranks summed; the payload's place is its best (list, rank)."""
    return lists.groupBy("query_id", "key").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 6).alias("score"), F.min(F.struct("list_no", "rank")).alias("first")).select("query_id", "key", "score", "first.list_no", "first.rank")


def rerank_features(query: Column, text: Column, base: Column) -> dict[str, Column]:
    """The seven features of a (query, text) pair."""
    q, t = F.filter(F.split(F.lower(query), r"\s+"), lambda x: x != ""), F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    qs, ts = F.array_distinct(q), F.array_distinct(t)
    both = F.size(F.array_intersect(qs, ts))
    pairs = F.when(F.size(q) > 1, F.transform(F.sequence(F.lit(1), F.size(q) - 1), lambda i: F.concat_ws(" ", F.element_at(q, i), F.element_at(q, i + 1)))).otherwise(F.array().cast("array<string>"))
    joined = F.concat_ws(" ", t)
    return {
        "base": base,
        "overlap": both / F.greatest(F.size(qs), F.lit(1)),
        "jaccard": both / F.greatest(F.size(F.array_union(qs, ts)), F.lit(1)),
        "query_norm": F.least(F.size(q) / 32, F.lit(1.0)),
        "text_norm": F.least(F.size(t) / 512, F.lit(1.0)),
        "length_ratio": F.least(F.size(q), F.size(t)) / F.greatest(F.size(q), F.size(t), F.lit(1)),
        "bigram": F.when(F.exists(pairs, lambda p: F.contains(joined, p)), 1.0).otherwise(0.0),
    }


def fit_min_max(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Least and greatest value of each column, to be kept with a model."""
    bounds = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
    return {c: (bounds[f"lo_{c}"] or 0.0, bounds[f"hi_{c}"] or 0.0) for c in columns}


def apply_min_max(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns scaled to 0..1 by stored bounds; a constant column is 0."""
    return df.withColumns({c: F.lit(0.0) if hi - lo <= 1e-12 else (F.col(c) - lo) / (hi - lo) for c, (lo, hi) in stats.items()})


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    return apply_min_max(df, fit_min_max(df, columns))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def weighted_score(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.coalesce(parts.get(name, F.lit(None).cast("double")), F.lit(0.0)) * w
    return out


def recency(year: Column, low: int, high: int) -> Column:
    if low == high:
        return F.when(year.isNull(), 0.0).otherwise(1.0)
    return F.when(year.isNull(), 0.0).otherwise(F.least(F.greatest((year - low) / (high - low), F.lit(0.0)), F.lit(1.0)))


def hash_embedding(docs: DataFrame, dim: int = 384) -> DataFrame:
    """(doc_id, bucket, weight): bag-of-words counts hashed to ``dim`` places, unit length; the sparse form of a vector."""
    counts = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("t")).groupBy("doc_id", F.pmod(F.xxhash64("t"), F.lit(dim)).alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))
    return counts.select("doc_id", "bucket", (F.col("n") / norm).alias("weight"))
