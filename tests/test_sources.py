"""Readers, stores and model interfaces on files and tables made here."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.catalog.retrieval import ranked_or_counted
from scriptorium.operators import graph, models, retrieval
from scriptorium.operators import records as M
from scriptorium.sources import connectors, documents, files

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style=None):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


def docx(core=True):
    cell = lambda t: f"<w:tc>{paragraph(t)}</w:tc>"
    table = "<w:tbl>" + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("Name", "F1"), ("x", "0.5"))) + "</w:tbl>"
    body = paragraph("Before") + paragraph("Intro", "H1") + paragraph("One.") + paragraph("Two.") + paragraph("Detail", "H2") + paragraph("Three.") + table + paragraph("References", "H1") + paragraph("[1] A.") + paragraph("[2] B.")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {_W}>' + "".join(f'<w:style w:styleId="H{i}"><w:name w:val="heading {i}"/></w:style>' for i in (1, 2)) + "</w:styles>")
        if core:
            z.writestr("docProps/core.xml", '<c:coreProperties xmlns:c="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:d="http://purl.org/dc/elements/1.1/" xmlns:t="http://purl.org/dc/terms/"><d:title>My Paper</d:title><d:creator>Ann Lee and Bo Li; C D</d:creator><t:created>2020-01-02T00:00:00Z</t:created><c:keywords>a, b</c:keywords></c:coreProperties>')
    return out.getvalue()


def test_docx_files_and_broken_ones(spark):
    rows = [("/x/paper one.docx", docx()), ("/x/bare.docx", docx(core=False)), ("/x/bad.docx", b"no zip"), ("/x/none.docx", None)]
    got = {r.path: r for r in documents.read_docx_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    one = got["/x/paper one.docx"]
    assert (one.source, one.title, one.authors, one.year, one.keywords, one.error) == ("docx", "My Paper", ["Ann Lee", "Bo Li", "C D"], 2020, ["a", "b"], None)
    assert [(s["name"], s.content, s.ord, s.level, s.parent, s.section_type) for s in one.sections] == [
        ("Preamble", "Before", 0, 1, None, "other"), ("Intro", "One.\nTwo.", 1, 1, None, "other"), ("Detail", "Three.", 2, 2, "Intro", "other"), ("References", "[1] A.\n[2] B.", 3, 1, None, "references"),
    ]
    assert [(t.caption, t.headers, t.data) for t in one.tables] == [("Table 1", ["Name", "F1"], [["x", "0.5"]])]
    assert one.references == ["[1] A.", "[2] B."]
    assert got["/x/bare.docx"].title == "bare" and got["/x/bare.docx"].year is None
    assert got["/x/bad.docx"].error.startswith("BadZipFile") and got["/x/none.docx"].error and got["/x/bad.docx"].sections is None


def test_text_json_and_image_files(spark, tmp_path):
    for name, text in (("a/one.txt", "first\nline"), ("two.txt", "")):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    assert {r.path.rpartition("/")[2]: r.text for r in files.read_texts(spark, str(tmp_path / "t")).collect()} == {"one.txt": "first\nline"}
    docs = spark.createDataFrame([("u1", "s1", "T"), ("u2", "s1", "U")], "user string, stem string, title string")
    files.write_documents(docs, str(tmp_path / "j"), ["user", "stem"])
    assert (tmp_path / "j" / "user=u1" / "stem=s1").is_dir()
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "j")).select("user", "title").collect())) == [("u1", "T"), ("u2", "U")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "good.json").write_text('{"doc_id": "1", "title": "T", "other": 1}')
    (tmp_path / "d" / "bad.json").write_text('{"doc_id": ')
    found = sorted((r.doc_id or "", r.title or "", r.broken is not None) for r in files.read_documents_safely(spark, str(tmp_path / "d")).collect())
    assert found == [("", "", True), ("1", "T", False)]
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "big.png").write_bytes(b"x" * 2000)
    (tmp_path / "i" / "small.jpg").write_bytes(b"x")
    assert [r.length for r in connectors.read_images(spark, str(tmp_path / "i")).collect()] == [2000]


def test_graph_store_is_idempotent(spark, tmp_path):
    store = connectors.GraphStore(spark, str(tmp_path))
    first = spark.createDataFrame([("a", "b", 1), ("a", "c", 1)], "src string, dst string, w int")
    store.write("CITES", first, ["src", "dst"])
    again = spark.createDataFrame([("a", "c", 2), ("d", "a", 2)], "src string, dst string, w int")
    for _ in range(2):
        assert sorted(map(tuple, store.write("CITES", again, ["src", "dst"]).collect())) == [("a", "b", 1), ("a", "c", 2), ("d", "a", 2)]
    assert [r.dst for r in store.read("CITES", src="d").collect()] == ["a"]


def test_pdf_pages_by_a_given_reader(spark):
    def load():
        def read(content):
            text = bytes(content).decode()
            if text == "bad":
                raise ValueError("no pages")
            return [(text * 50, text * 50), ("", "seen")]

        return read

    got = connectors.read_pdf_pages(spark.createDataFrame([("a", b"abc"), ("b", b"bad")], "path string, content binary"), load).collect()
    assert sorted((r.path, r.page or 0, (r.text or "")[:6], r.error) for r in got) == [("a", 1, "abcabc", None), ("a", 2, "seen", None), ("b", 0, "", "ValueError: no pages")]


def test_events_are_published(spark, tmp_path):
    for i in (1, 2):
        connectors.publish(spark.createDataFrame([(i, "uploaded")], "document_id int, kind string"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2


def test_embeddings_pairs_and_chunks(spark):
    df = spark.createDataFrame([(1, "red cats run"), (2, "Cats RUN red"), (3, "blue sky"), (4, None)], "doc_id long, text string")
    x = {r.doc_id: np.array(r.v) for r in df.select("doc_id", models.embed(batch=2)(F.col("text")).alias("v")).collect()}
    assert x[1] @ x[2] == pytest.approx(1) and abs(x[1] @ x[3]) < 0.5 and not x[4].any() and len(x[1]) == 384
    s = df.select("doc_id", models.pair_score()(F.lit("red cats"), F.col("text")).alias("s")).collect()
    assert max(s, key=lambda r: r.s).doc_id in (1, 2)
    asked = spark.createDataFrame([(7, "blue sky"), (8, "cats")], "query_id long, text string")
    got = models.search_chunks(df, asked, k=2, size=10, overlap=2).collect()
    assert {(r.query_id, r.doc_id) for r in got if r["rank"] == 1} >= {(7, 3)} and len(got) == 4


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 7))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    net, losses = models.train_mlp(x, y, epochs=30)
    assert min(losses) < 0.5 * losses[0] or min(losses) < 0.2
    assert ((net(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_settings():
    models.Settings().validate()
    for bad in ({"backend": "x"}, {"overlap_chars": 3500}, {"top_k": 0}, {"speculative": "y"}, {"chunk_chars": 0}):
        with pytest.raises(ValueError):
            models.Settings(**bad).validate()


def test_search_in_blocks_and_fallbacks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha w{i} beta w{i % 3} gamma" if i % 2 else f"w{i} delta") for i in range(40)] + [(50, None), (51, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "alpha w1"), (1, "w2 delta delta"), (2, "nowhere"), (3, "a w"), (4, "alpha w7 beta w1 gamma"), (5, "elta")], "query_id long, text string")
    whole = sorted(map(tuple, retrieval.bm25(docs, queries).collect()))
    phrases = sorted(map(tuple, retrieval.phrase_hits(docs, queries).collect()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = [(q, d, t.lower().count(a.lower())) for q, a in queries.collect() for d, t in texts.items() if t and a.lower() in t.lower()]
    assert phrases == sorted(want) and (4, 7, 1) in phrases
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 300)
    assert [(a, b, round(c, 9), d) for a, b, c, d in sorted(map(tuple, retrieval.bm25(docs, queries).collect()))] == [(a, b, round(c, 9), d) for a, b, c, d in whole]
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, float(-i)]) for i in range(30)] + [(99, [1.0])], "vec_id long, embedding array<double>")
    q = v.where("vec_id < 9 or vec_id = 99").selectExpr("vec_id AS query_id", "embedding AS query")
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.vector_top_k(v, q, 3).collect()}
    x = {r.vec_id: np.array(r.embedding) for r in v.collect()}
    for a in range(9):
        best = sorted((i for i in x if len(x[i]) == 3), key=lambda i: (-round(float(x[a] @ x[i]), 9), i))[:3]
        assert [got[a, r] for r in (1, 2, 3)] == best
    assert got[99, 1] == 99
    ranked = spark.createDataFrame([(1, 5)], "query_id long, doc_id long")
    counted = spark.createDataFrame([(1, 6), (2, 7)], "query_id long, doc_id long")
    assert sorted(map(tuple, ranked_or_counted(ranked, counted).collect())) == [(1, 5, "ranked"), (2, 7, "count")]


def test_title_similarity_against_all_pairs(spark):
    import difflib

    base = ["Deep learning for large graphs", "A study of cats", "Neural networks in medicine", "Query plans and costs"]
    titles = [(i, t) for i, t in enumerate([*base, *[t.lower() for t in base], *[t + " again" for t in base], "A study of bats", "unrelated words here", "", None])]
    df = spark.createDataFrame(titles, "id long, title string")
    got = {(r.id, r.match): r.ratio for r in M.similar_titles(df, df).collect()}
    want = {(i, j): difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() for i, a in titles for j, b in titles if i != j and a and b}
    want = {k: v for k, v in want.items() if v >= 0.8}
    assert got == pytest.approx(want)


def test_parents_are_accepted_in_order(spark, monkeypatch):
    rows = [(g, "a", "b", 0.9) for g in (1, 2)] + [(g, "b", "c", 0.8) for g in (1, 2)] + [(1, "c", "a", 0.7), (2, "c", "a", 0.95), (1, "x", "a", 0.1), (1, "b", "y", 0.1)]
    df = spark.createDataFrame(rows, "group int, src string, dst string, confidence double")
    want = {(1, "a", "b"), (1, "b", "c"), (2, "c", "a"), (2, "a", "b"), (1, "x", "a"), (1, "b", "y")}
    for most in (10_000, 3):
        monkeypatch.setattr(graph, "FOLD_MOST", most)
        assert {(r.group, r.src, r.dst) for r in graph.accept_in_order(df).collect()} == want
