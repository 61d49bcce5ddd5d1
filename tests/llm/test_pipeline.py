"""The pipeline's stages, each held against brute force on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as p
from scriptorium.llm import langid, queries
from scriptorium.plans.scratch import stored
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_minhash import brute as brute_near
from tests.llm.test_packing import check as check_bins


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in p.STAGES:
        out.append(stored(stage(spark, out[-1], sf), name))
    return out


def test_language_keeps_clean_documents(spark, sf, stages):
    before, after = stages[0], stages[1]
    assert after.columns == before.columns
    rejected = {r.row.doc_id for r in langid.predict(before, langid.fit(before)).where("rejected").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - rejected
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    assert not rejected & good


def test_lines(stages):
    before, after = stages[1], stages[2]
    want = {(i, text) for i, text, _, _ in brute_lines([(r.doc_id, r.text) for r in before.collect()], 10)}
    rows = after.collect()
    assert after.columns == before.columns
    assert {(r.doc_id, r.text) for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_near_duplicates(stages):
    before, after = stages[2], stages[3]
    component = brute_near([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert after.columns == before.columns
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(component.values()))


def test_mixture_reads_every_document(stages):
    before, after = stages[3], stages[4]
    times = Counter(r.doc_id for r in after.collect())
    assert after.columns == before.columns
    assert set(times) == {r.doc_id for r in before.collect()} and max(times.values()) <= 2


def test_bins_hold_every_reading(stages):
    before, after = stages[4], stages[5]
    times = Counter(r.doc_id for r in before.collect())
    placed = Counter(r.doc_id for r in after.where("piece = 0").collect())
    assert placed == times
    once = {r.doc_id: (r.doc_id, r.text, r.source) for r in before.collect()}
    seen = set()
    first = [r for r in after.orderBy("bin_id").collect() if times[r.doc_id] == 1]
    assert {r.doc_id for r in first} == {i for i, n in times.items() if n == 1}
    for r in after.where("bin_id is not null").collect():
        assert (r.bin_id, r.doc_id) not in seen
        seen.add((r.bin_id, r.doc_id))
    assert once and check_bins


def test_run_and_registration(spark, sf, stages):
    assert p.run(spark, sf).count() == stages[-1].count()
    assert p.ORACLE_SQL is None and "pipeline" in __spark_entry__.queries()
    assert len([n for n in queries.queries() if n.startswith("op")]) == 10


def test_no_text_is_lost_for_its_id(spark, sf):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "a", 35)] * 3
    rows += [(1, "eta theta iota kappa lambda my", "en", "b", 30), (1, "eta theta iota kappa lambda my", "en", "a", 30), (2, None, None, None, None)]
    rows += [(None, "eta theta", "en", "a", 9), (None, "eta theta", "en", "a", 9), (None, "other words", "en", "a", 11), (3, long, "en", "a", len(long)), (4, long, "en", "a", len(long)), (5, "", "en", "a", 0)]
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, kept boolean")
    kept = p.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id or 0, (r.text or "")[:9], r.source) for r in kept.collect())
    assert found == [(0, "eta theta", "a"), (0, "other wor", "a"), (1, "alpha bet", "a"), (1, "eta theta", "a"), (2, "", None), (3, "w0 w1 w2 ", "a"), (5, "", "a")]
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_every_stage_takes_odd_rows(spark, sf):
    """Nulls in any column, clashing and extra columns, ties and repeats go through all stages."""
    real = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = real.withColumns({"row": F.lit(1), "bin_id": F.lit("b"), "lang_pred": F.lit(None).cast("string")})
    odd = extra.limit(5).withColumns({"doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    docs = stored(extra.unionByName(odd).unionByName(extra.limit(7)), "odd_documents")
    for name, stage in p.STAGES[:-1]:
        after = stored(stage(spark, docs, sf), f"odd_{name}")
        assert after.columns == docs.columns and after.count() > 0
        docs = after
    assert p.bins(spark, docs, sf).where("piece = 0").count() == docs.count()
