"""Expected rows of the queries that SQL does not express."""

import pytest

from scriptorium import registry

GOLDEN = {
    "author_parse": [(1, "Smith, J.; Doe, A. B.", 2), (2, "John Smith; Jane Doe", 2), (3, "", 0), (4, "Lee, K.", 1)],
    "author_parse_affiliation": [(1, "Jane Doe", "University of X, USA", "", "university", "US"), (2, "John Roe", "Institute of Y", "", "institute", ""), (3, "Ann Lee", "", "", "", ""), (4, "Bo Li", "", "bo.li@acme.com", "", ""), (5, "Kim Park", "Acme Corp, Korea", "", "company", "KR")],
    "author_clean": [(1, "JOHN SMITH; SMITH, J. A"), (2, "NGUYỄN VĂN AN; JANE DOE"), (3, ""), (4, "JOHN SMITH; LEE, K")],
    "table_headers_fix": [(1, "Method|84.2", 1), (2, "Model|F1", 1), (3, "Column 1|Column 2", 2), (4, "", 0), (5, "Column 1|Column 2", 2)],
    "entity_accumulate": [(1, "BERT", 0.7), (1, "Residual Net", 0.95), (1, "resnet 50", 0.9), (2, "BERT", 0.6)],
}


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden(spark, sf, name):
    assert sorted(map(tuple, registry.queries()[name](spark, sf).collect())) == GOLDEN[name]


def test_sections(spark, sf):
    rows = registry.queries()["section_split_headings"](spark, sf).orderBy("ord").collect()
    assert [(r.name, r.level, r.section_type, r.parent) for r in rows] == [("Abstract", 1, "abstract", None), ("1. Introduction", 1, "introduction", None), ("1.1 Background", 2, "background", "1. Introduction"), ("References", 1, "references", None)]


def test_splits_are_exact(spark, sf):
    rows = registry.queries()["train_val_test_split"](spark, sf).groupBy("split").count().collect()
    n = {r.split: r["count"] for r in rows}
    total = sum(n.values())
    assert n["train"] == int(0.7 * total) and abs(n["val"] - 0.15 * total) <= 1


def test_period_chunks_lose_nothing(spark, sf):
    rows = registry.queries()["period_chunks"](spark, sf).groupBy("doc_id").sum("n").collect()
    length = {r.doc_id: len(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r["sum(n)"] for r in rows} == {i: n for i, n in length.items() if n}


def test_hash_embedding_is_normalised(spark, sf):
    assert registry.queries()["hash_embedding_norms"](spark, sf).where("norm <> 1.0").count() == 0
