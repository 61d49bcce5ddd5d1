"""Secret scans against the plain patterns, and learnt formats on made-up credentials."""

import collections
import hashlib
import itertools
import math
import random
import re
import string

import numpy as np
import pytest

from scriptorium.llm import automata, secrets
from scriptorium.llm.automata import Background, classes, infer, infer_counted


def brute(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text or "") if m.end() - m.start() >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = secrets.scan(docs, secrets.fit(docs)).collect()
    assert {r.doc_id: r.base_sha256 for r in got} == {i: hashlib.sha256(s.encode()).hexdigest() for i, s in want.items()}
    for r in got:
        assert [x for x in r.joined.split(",") if not x.startswith("format")] == want[r.doc_id].split(",") or r.joined.startswith("format")
        assert r.n_assign == want[r.doc_id].count("assign:")


ODD = ["é token=abcdef0 'API_KEY' : \"x\"", "password: token=abcdef", "token='12345' secret = abcdef.", "AKIAAKIA" + "B" * 13, "AKIA" + "0" * 15, "0" * 24 + "é" + "f" * 23, "apikey=" + "a1" * 50_000, "ToKeN\"  =  'ABCDEF", None, "", "x" * 100_000]


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(ODD)] + [(None, "token=abcdef", 1)], "doc_id long, text string, spans int")
    for r in secrets.scan(df, None).collect():
        text = "token=abcdef" if r.doc_id is None else ODD[r.doc_id]
        assert r.joined == brute(text)
    assert secrets.scan(df.limit(0), None).collect() == []
    assert secrets.fit(df.limit(0)).automata == {}


UPPER, MIXED = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits


def made(rng, n):
    """Credentials of two formats that the base patterns find only with their keyword or prefix."""
    return ["sk" + "".join(rng.choices(MIXED, k=22)) for _ in range(n)], ["AKIA" + "".join(rng.choices(UPPER, k=16)) for _ in range(n)]


def test_planted_credentials_are_found(spark):
    """Formats learnt from labelled credentials find others of the same format; clean documents stay clean."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(6)
    tokens, keys = made(rng, 90)
    labelled = [f'some text api_key = "{t}" goes on' for t in tokens[:40]] + [f"found {k} here" for k in keys[:40]]
    hidden = [f"Bearer {t}, sent" for t in tokens[40:]] + [f"({'ASIA' + k[4:]})" for k in keys[40:]]
    rows = list(enumerate([*labelled, *hidden], 10**6))
    planted = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    model = secrets.fit(planted)
    assert set(model.automata) == {"assign", "access", "hex"}
    got = {r.doc_id: [(x.start, x.end) for x in r.spans if x.kind == "format"] for r in secrets.scan(planted, model).collect()}
    want = {i: [(t.index(c), t.index(c) + len(c))] for (i, t), c in zip(rows[80:], [*tokens[40:], *("ASIA" + k[4:] for k in keys[40:])], strict=True)}
    hits = sum(got[i] == w for i, w in want.items())
    assert hits >= 0.95 * len(want)
    assert sum(len(x) for x in got.values()) <= 1.02 * hits
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(100)]
    assert sum(map(model.likely, hexes)) >= 95
    assert not any(model.likely(h[:39]) or model.likely(h[:16]) for h in hexes)


def test_few_credentials_are_enough():
    rng = random.Random(3)
    tokens, _ = made(rng, 60)
    words = ["".join(rng.choices(["tion", "er", "keit", "ment"], k=6)) for _ in range(500)]
    for n, least in ((1, 1), (5, 40), (30, 48)):
        model = secrets.Model({"assign": infer(tokens[:n])}, Background(words))
        assert sum(map(model.likely, tokens[10:])) >= least
        assert not any(map(model.likely, words)) and not model.likely(tokens[50][:12])


def test_likelihoods_by_brute_force():
    """Where states of a depth all merge, a string's likelihood is the product of its positions' frequencies."""
    rng = random.Random(5)
    known = ["".join(rng.choices("07af", k=3)) + "Z" for _ in range(40)]
    found = infer(known)
    assert len(found.states()) == 5
    for text in ("0a0Z", "aaaZ", "00fZ"):
        want = 1.0
        for i, c in enumerate(text):
            n = sum(classes(k[i]) == classes(c) for k in known)
            want *= (n + 0.05) / (len(known) + 12 * 0.05)
        assert 2 ** found.score(classes(text))[0] == pytest.approx(want)
        assert 2 ** found.score(classes(text))[1] == pytest.approx((40.05 / 40.1) ** 5)
        assert found.in_format(classes(text))
    total = sum(2 ** found.bits("".join(s)) for n in range(7) for s in itertools.product("dxU", repeat=n))
    assert total <= 1


def test_runs_beside_base_spans_are_scored():
    rng = random.Random(8)
    tokens, _ = made(rng, 40)
    model = secrets.Model({"assign": infer(tokens)}, Background(["plainwords", "other.words"] * 50))
    text = f"token={tokens[0]} ({tokens[1]}.) AKIA{'B' * 16}.{tokens[2]} x={tokens[3]}"
    base, found = secrets.spans(text, model)
    assert [k for *_, k in base] == ["assign", "access"]
    assert [text[a:b] for a, b, k in found if k == "format"] == [tokens[1], tokens[2], tokens[3]]


def test_a_rare_kind_is_learnt_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SAMPLE_DOCS", 50)
    _, keys = made(random.Random(4), 40)
    df = spark.createDataFrame([(f"d{i}", f"text {keys[i // 100]} end" if i % 100 == 0 else "plain text") for i in range(400)], "doc_id string, text string")
    model = secrets.fit(df)
    assert "access" in model.automata and model.automata["access"].longest == 20
    assert secrets.scan(df, model).where("n_access = 1").count() == 4


def test_ties_repeats_and_clashing_columns(spark):
    text = "token=" + "ab01" * 8
    df = spark.createDataFrame([(1, text, "x", 3), (1, text, "x", 3)], "doc_id long, text string, kind string, id int")
    got = secrets.scan(df, secrets.fit(df)).collect()
    assert [r.joined for r in got] == ["assign:0:38,hex:6:38"] * 2


def _brute_layers(known):
    """States (symbol counts, ends) by depth, merged as the automaton's first part does it, from plain lists of suffixes."""
    width = math.sqrt(0.5 * math.log(2 / 0.1))

    def heads(part):
        return collections.Counter(s[:1] for s in part)

    def alike(a, b):
        if not a or not b:
            return True
        x, y, most = heads(a), heads(b), width * (1 / math.sqrt(len(a)) + 1 / math.sqrt(len(b)))
        return all(abs(x[c] / len(a) - y[c] / len(b)) <= most for c in x | y) and all(alike([s[1:] for s in a if s[:1] == c], [s[1:] for s in b if s[:1] == c]) for c in x.keys() & y.keys() if c)

    layer, out = [known], []
    while layer:
        out.append(sorted(sorted(heads(part).items()) for part in layer))
        children = sorted((-len(rest), rank, c, rest) for rank, part in enumerate(layer) for c in heads(part) if c for rest in [[s[1:] for s in part if s[:1] == c]])
        kept = []
        for *_, rest in children:
            like = next((k for k in kept if alike(k, rest)), None)
            kept.append(rest) if like is None else like.extend(rest)
        layer = kept
    return out


def test_states_of_equal_depth_by_brute_force():
    rng = random.Random(2)
    known = [classes("k" + "".join(rng.choices("0123456789", k=4)) + "Z" * rng.randint(1, 3) if rng.random() < 0.6 else "".join(rng.choices("abcxyz", k=6))) for _ in range(400)]
    often = collections.Counter(known)
    strings = automata._Strings(list(often))
    found = automata._layers(strings, np.array(list(often.values())), 0.1)
    layer, got = [0], []
    while layer:
        got.append(sorted(sorted([*found.seen[s].items(), *([("", found.ends[s])] if found.ends[s] else [])]) for s in layer))
        layer = sorted({t for s in layer for t in found.next[s].values()})
    assert got == _brute_layers(known)
    assert max(map(len, got)) > 1
    whole = infer_counted(often)
    assert np.allclose(np.transpose(automata._scores(whole, strings)), [whole.score(t) for t in often])


def test_every_credential_and_word_is_learnt_from(spark):
    """No sample: each distinct credential of any length counts once, and so do the bigrams of all distinct words."""
    rng = random.Random(9)
    tokens = ["".join(rng.choices(MIXED, k=12)) for _ in range(1000)] + ["".join(rng.choices(MIXED, k=400))]
    plain = ["".join(rng.choices("abcdefgh", k=9)) + f"{i:06d}" for i in range(8000)]
    rows = [(i, f"token={t} {' '.join(plain[8 * i : 8 * i + 8])} token={t} {plain[0]}") for i, t in enumerate(tokens)] + [(None, None)]
    model = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    found = model.automata["assign"]
    assert sum(found.ends) == len(set(tokens))
    assert (found.shortest, found.longest) == (12, 400)
    want = Background(plain)
    assert (model.background.pairs, model.background.firsts) == (want.pairs, want.firsts)


def test_words_overlap_no_base_span():
    text = "plainword token=abcdef0/tail other=x1y2z3 " + "0" * 30 + "-end AKIA" + "B" * 16 + " lastword"
    spans = secrets.base_spans(text)
    want = {m[0] for m in re.finditer(r"[A-Za-z0-9+/_.=-]{6,}", text) if all(m.end() <= a or m.start() >= b for a, b, *_ in spans)}
    assert secrets.words(text, spans) == want == {"plainword", "other=x1y2z3", "lastword"}
