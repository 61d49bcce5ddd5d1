"""Line dedup against a plain loop."""

import hashlib
from collections import defaultdict

from scriptorium.llm.line_dedup import SPACE, dedup_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs):
    seen = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            seen[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < min_docs]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def run(df, **options):
    return [(r.row.doc_id, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(df, **options).collect()]


def test_matches_a_loop_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(run(docs)) == sorted(brute(rows, 10))
    assert sum(x[3] for x in brute(rows, 10)) > 0


def test_nulls_repeats_long_lines_and_clashing_columns(spark):
    long_line = "É" * 50_000
    rows = [(1, "Shared \nown é\n\n"), (2, "\tSHARED\nown É"), (2, "shared"), (None, "shared"), (None, "shared\r"), (3, None), (4, ""), (5, long_line + "\nx"), (6, long_line), (7, "own É\nx\nx"), (7, "own É\nx\nx")]
    df = spark.createDataFrame([(*r, 1, "l") for r in rows], "doc_id long, text string, row int, lines string")
    for n in (2, 3, 4, 5):
        key = lambda x: (str(x[0]), *x[1:])
        assert sorted(run(df, min_docs=n), key=key) == sorted(brute(rows, n), key=key)


def test_empty_table_and_digest(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_texts_with_very_many_shared_lines(spark):
    """Each of 20,000 distinct shared lines is dropped by its position, in time in proportion to the lines."""
    shared = [f"line {i}" for i in range(20_000)]
    rows = [(1, "\n".join([*shared, "own", *shared])), (2, "\n".join(shared)), (3, "own\n" + shared[7])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, at int")
    assert sorted(run(df, min_docs=2)) == sorted(brute(rows, 2))
    assert run(df.limit(0), min_docs=2) == []
