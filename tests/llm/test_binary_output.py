"""Round trips of the encoder, the grammar and the written shards against the library itself."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptorium.llm import binary_output, repair, tokens
from scriptorium.llm.kernel import utf8
from scriptorium.plans.scratch import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "  a", "a  b\n\nc ", "a  b", "a \n\nb", " \n x", "don't 'll  're", "x　　 y  z", "<|endoftext|> a", "a <|endoftext|>b  <|endoftext|>\n<|endoftext|><|endoftext|>", "<|endoftext|", "x" + "<|endoftext|>" * 3 + " \n", "日本 語\t\tü", "a\x1c b\x85\u0085\n\n c", "   ", "end  \n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(texts, library, enc):
    ids, off = enc.encode(*utf8(pa.array(texts, pa.string())), 2)
    for i, text in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_encoder_on_odd_texts(library):
    enc = tokens.Encoder(PATH)
    check(ODD, library, enc)
    check(ODD[::-1] * 2, library, enc)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sé \n\t  　.1日<|>")), max_size=25), max_size=4))
def test_encoder_on_any_text(texts):
    t = Tokenizer.from_file(PATH)
    check(texts, t, tokens.encoder(PATH))


def test_encoder_starts_afresh(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 40)
    enc = tokens.Encoder(PATH)
    for i in range(5):
        check([" ".join(f"w{i}{j % 30}" for j in range(60))], library, enc)


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 60_000).clip(0, 400).astype(np.uint32)
    ids[5000:9000] = 7
    off = np.unique(np.concatenate([[0, 60_000], rng.integers(0, 60_000, 200)]))
    off = np.sort(np.concatenate([off, off[5:7]]))
    g = repair.compress(ids.copy(), off, 500)
    assert len(g.rules) and len(g.symbols) < len(ids)
    assert (repair.expand(g, g.symbols) == ids).all()
    for i in range(len(off) - 1):
        assert (repair.expand(g, g.symbols[g.doc_symbols[i] : g.doc_symbols[i + 1]]) == ids[off[i] : off[i + 1]]).all()
    for a, n in ((0, 1), (59_990, 10), (1234, 5000), (7000, 1), (0, 60_000), (30_000, 0)):
        assert (repair.decode_range(g, a, n) == ids[a : a + n]).all()


def test_grammar_reaches_its_fixed_point():
    """Every rule is used often enough to pay, and no pair is left that would be."""
    ids = np.random.default_rng(2).zipf(1.2, 20_000).clip(0, 300).astype(np.uint32)
    off = np.arange(0, 20_001, 500)
    g = repair.compress(ids.copy(), off, 400)
    inside = np.ones(len(g.symbols), bool)
    inside[g.doc_symbols[1:] - 1] = False
    left = Counter(zip(g.symbols[:-1][inside[:-1]].tolist(), g.symbols[1:][inside[:-1]].tolist(), strict=True))
    # what is left overlaps other such pairs and won fewer uses than a rule costs
    assert sum(n >= repair.LEAST for n in left.values()) < 0.02 * len(left)
    assert len(g.symbols) + 3 * len(g.rules) < len(ids)
    assert np.bincount(np.concatenate([g.symbols, g.rules.reshape(-1)]))[g.base :].min() >= 1
    assert (g.lengths == [len(repair.unfold(g, np.array([g.base + r], np.uint32))) for r in range(len(g.rules))]).all()


def test_random_access_reads_only_what_it_needs():
    ids = np.tile(np.arange(50, dtype=np.uint32), 4000)
    g = repair.compress(ids.copy(), np.array([0, len(ids)]), 64)
    assert len(g.symbols) < len(ids) / 50
    rng = np.random.default_rng(3)
    plain = rng.integers(0, 2**31, 30_000).astype(np.uint32) % 30_000
    h = repair.compress(plain.copy(), np.array([0, len(plain)]), 30_000)
    assert len(h.marks) > 50
    for a in rng.integers(0, 29_000, 50).tolist():
        assert (repair.decode_range(h, a, 900) == plain[a : a + 900]).all() and (repair.decode_range(g, a, 900) == ids[a : a + 900]).all()


def expected(rows, library):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_written_shards(spark, sf, library, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    path = scratch_path(spark, "tokens")
    binary_output.write_tokens(docs, path, tokenizer=PATH, end_id=2, partitions=5)
    got = [tuple(r) for r in binary_output.read_index(spark, path).orderBy("doc_id").collect()]
    assert got == expected(rows, library)


def test_nulls_long_texts_and_empty_tables(spark, library):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "long word " * 30_000), (4, "x" * 200_000)]
    rows += [(5, "same row"), (5, "same row"), (6, "<|endoftext|> b")]
    df = spark.createDataFrame([(*r, 9, 1) for r in rows[::-1]], "doc_id long, text string, part int, symbols int")
    path = scratch_path(spark, "tokens")
    binary_output.write_tokens(df, path, tokenizer=PATH, end_id=2)
    assert sorted((tuple(r) for r in binary_output.read_index(spark, path).collect()), key=lambda r: r[1]) == expected(rows, library)
    path = scratch_path(spark, "tokens")
    binary_output.write_tokens(df.limit(0), path, tokenizer=PATH, end_id=2)
    assert binary_output.read_index(spark, path).collect() == []
