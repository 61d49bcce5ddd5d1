"""Language identification: accuracy on rows it never saw, and defined results."""

import base64
import random
import zlib

from scriptorium.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    assert set(model.languages) == {"de", "en", "es", "fr"} and len(model.centroids) > len(model.languages)
    found = langid.predict(docs.drop("lang", "source"), model)
    rows = {r.row.doc_id: r for r in found.collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(rows[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert sum(r.rejected for r in rows.values()) <= 0.01 * len(rows)
    marked = docs.select(langid.held_out(docs.doc_id).alias("h"), "doc_id").collect()
    assert {r.doc_id for r in marked if r.h} == set(held)


def test_defined_results(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "12 34 !?", "en"), (4, "é", "fr"), (5, "the of and " * 50_000, "en"), (None, "the of and", "en"), (6, "日本語", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.row.doc_id: r for r in langid.predict(df, langid.fit(docs)).collect()}
    assert len(got) == len(rows)
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in (1, 2, 3))
    assert got[5].lang_pred == "en" and not got[5].rejected
    none = langid.fit(df.limit(0))
    assert none.languages == [] and {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), none).collect() == []


def test_foreign_texts_and_noise_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rng = random.Random(1)
    odd = [base64.b64encode(rng.randbytes(600)).decode() for _ in range(20)]
    odd += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=900)) for _ in range(20)] + [rng.randbytes(400).hex() for _ in range(20)]
    odd.append("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. " * 6)
    odd += ["Все люди рождаются свободными и равными в своем достоинстве и правах. " * 8, "人人生而自由,在尊严和权利上一律平等。" * 20]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert all(r.rejected for r in langid.predict(rows, model).collect())
    held = langid.predict(docs.where(langid.held_out(docs.doc_id)), model).collect()
    assert sum(r.rejected for r in held) <= 0.01 * len(held)


def test_a_text_scores_alike_in_any_company(spark, sf):
    """Nothing of a neighbour row, the batch or the partition enters a score."""
    import numpy as np
    import pyarrow as pa

    from scriptorium.llm.kernel import utf8

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    texts = [" the cat sat", "abc", " the cat sat", "", "é", " x", "\n"] + [r.text for r in docs.limit(40).collect()]
    alone = np.concatenate([langid.vectors(*utf8(pa.array([t]))) for t in texts])
    assert (langid.vectors(*utf8(pa.array(texts))) == alone).all()
    assert (langid.vectors(*utf8(pa.array(texts[::-1]))) == alone[::-1]).all()
    model = langid.fit(docs)
    one, many = ({r.row.doc_id: (r.lang_pred, r.score, r.rejected) for r in langid.predict(d, model).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert {i: (x[0], round(x[1], 5), x[2]) for i, x in one.items()} == {i: (x[0], round(x[1], 5), x[2]) for i, x in many.items()}


def test_ties_repeats_and_clashing_names(spark):
    rows = [(i, text, lang, 0.5, "x") for i, (text, lang) in enumerate([("aaa bbb ccc", "b"), ("aaa bbb ccc", "a"), ("zzz yyy", "a"), ("zzz yyy", "b")] * 20)] + [(7, "aaa bbb ccc", "a", 0.5, "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, row string")
    found = langid.predict(df, langid.fit(df))
    assert found.columns == ["row", "lang_pred", "score", "rejected"] and found.count() == len(rows)
    assert {r.lang_pred for r in found.where("row.text = 'aaa bbb ccc'").collect()} == {"a"}
    assert len({round(r.score, 6) for r in found.where("row.text = 'zzz yyy'").collect()}) == 1
