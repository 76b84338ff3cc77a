"""Personal data."""

import hashlib
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratawork.llm import pii, pii_examples
from stratawork.llm.queries import op8_pii
from tests.conftest import DATA
from tests.llm.reference import base_spans


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="0123456789 -.+()@ab_%é\n", max_size=60))
def test_base_equals_patterns(text):
    assert pii.written(pii.base_spans(text)) == base_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 500_000, "1" * 500_000, "1 " * 300_000, "+1" + " " * 500_000, "a@" * 200_000):
        pii.base_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["0" * 5000, "9" * 5000, ".1", "1" * 40, " ", "@", "a.b", "+", "-", "4111 1111 1111 1111"]),
                max_size=12).map("".join))
def test_base_of_long_runs(text):
    """Numbers longer than int() reads are numbers all the same."""
    import sys
    limit = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    want = base_spans(text)
    sys.set_int_max_str_digits(limit)
    assert pii.written(pii.base_spans(text)) == want


def test_parts_of_thousands_of_zeros():
    text = "0" * 5000 + ".1.1.1"
    assert pii.base_spans(text)[0] == (0, 5006, "ip")
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []


def test_added_walks_once():
    n = 40_000
    text = "0123456789 " * n
    base = [(11 * i, 11 * i + 10, "phone") for i in range(0, n, 2)]
    start = time.time()
    found = pii.added(text, np.full(n, 1 + 2 * pii.KINDS.index("phone")), base)
    assert found == [(11 * i, 11 * i + 10, "phone") for i in range(1, n, 2)]
    assert time.time() - start < 5
    # A long base span that begins early still counts.
    assert pii.added("0123456789 0123456789 0123456789", np.array([7, 7, 7]), [(0, 15, "card"), (1, 2, "ip")]) == [
        (22, 32, "phone")]


def samples():
    out = []
    for i in range(60):
        t = f"call +1 ({100 + i}) 555-{1000 + i} or mail x.{10 + i}@mail.example.com, from 10.0.{i}.7 in 19{i % 90 + 10}"
        out += pii.windows(t, pii.base_spans(t))
        out += pii.windows(*pii.national(t, pii.base_spans(t)))
    return out


def test_field_adds_what_patterns_miss():
    field = pii.train(samples())
    field = pii.Field.from_bytes(field.to_bytes())
    text = "please call (743) 555-3824 or come by in 1999"
    tags = field.decode([text.translate(pii.SHAPE).split()])[0]
    assert [text[a:b] for a, b, _ in pii.added(text, tags, [])] == ["(743) 555-3824"]
    plain = "only words stand here"
    assert not field.decode([plain.translate(pii.SHAPE).split()])[0].any()
    assert pii.train([(["xxx"], [0])]) is None


def test_viterbi_equals_search_of_all_paths():
    from itertools import product
    rng = np.random.default_rng(1)
    field = pii.Field({"any": 0, "is x": 1, "is d": 2},
                      rng.normal(size=(3, 3, pii.STATES)).astype(np.float32) * 2,
                      rng.normal(size=(pii.STATES, pii.STATES)).astype(np.float32))
    documents = [["x", "d", "xx"], ["d"], [], ["dd", "x"], ["x", "x", "d"]]
    moves = field.pairs + pii.allowed()
    got = field.decode(documents)
    assert len(got[2]) == 0 and [len(g) for g in got] == [3, 1, 0, 2, 3]
    for shapes, tags in zip(documents, got):
        e = field.emissions(shapes) if shapes else []
        best = max(product(range(pii.STATES), repeat=len(shapes)), key=lambda p: sum(
            e[i][s] + moves[p[i - 1] if i else 0][s] for i, s in enumerate(p)))
        assert tuple(tags) == best


def test_gradient_reaches_the_labels():
    field, found = pii.train(samples()), 0
    for shapes, tags in samples()[:40]:
        found += list(field.decode([shapes])[0]) == list(tags)
    assert found >= 36


def frame(spark):
    texts = [None, "", "write a.b@c.de, ip 1.2.3.4 and 300.1.1.1", "4111 1111 1111 1111 or 4111111111111112",
             "a.b@c.de a.b@c.de", "é x@y.z.", "word " * 50_000 + "+1 (743) 555-3824"]
    return spark.createDataFrame([(i, t, "keep", 7) for i, t in enumerate(texts)] + [(None, "a@b.cd", None, None)],
                                 "doc_id bigint, text string, spans string, n_chars int")


def test_edge_cases(spark):
    field = pii.train(samples())
    rows = pii.find(frame(spark), field).collect()
    assert len(rows) == 8
    for r in rows:
        assert r["base"] == base_spans(r["text"])
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))
    hidden = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark), field).collect()}
    assert hidden[0] is None and hidden[1] == ""
    assert hidden[2] == "write <EMAIL>, ip <IP> and 300.1.1.1"
    assert hidden[3] == "<CARD> or 4111111111111112"
    assert hidden[6].endswith("word <PHONE>")
    assert pii.redact(frame(spark), None).columns == frame(spark).columns
    assert pii.counts(frame(spark).limit(0)).count() == 0
    assert pii.learn(frame(spark).where("doc_id < 0")) is not None  # the table labelled by hand
    assert pii.fit(frame(spark).where("doc_id < 2").withColumn("spans", F.lit(""))) is None


def scores(found, gold):
    hits = sum(len(f & g) for f, g in zip(found, gold))
    return 2 * hits / max(1, sum(map(len, found)) + sum(map(len, gold)))


def test_hand_labelled_spans(spark):
    """The marks of the table are whole and pass the checks. Each third is found by a
    field of the other two thirds: F1 of spans, against the patterns alone."""
    table = pii_examples.labelled()
    gold = [set(filter(None, s.split(","))) for _, s in table]
    for (text, _), spans in zip(table, gold):
        for kind, a, b in (s.split(":") for s in spans):
            assert pii.passes(kind, text[int(a):int(b)]), text
        assert set(filter(None, base_spans(text).split(","))) <= spans, text
    docs, found = spark.read.parquet(f"{DATA}/documents.parquet"), [set()] * len(table)
    known = pii.labelled_by_patterns(docs.where("doc_id % 2 = 0").select("text"))
    for third in range(3):
        rest = [r for i, r in enumerate(table) if i % 3 != third]
        field = pii.fit(known.union(spark.createDataFrame(rest * 3, "text string, spans string")), max_rows=2000)
        part = [(i, t) for i, (t, _) in enumerate(table) if i % 3 == third]
        for r in pii.find(spark.createDataFrame(part, "i int, text string"), field).collect():
            found[r["i"]] = set(filter(None, r["spans"].split(",")))
    patterns = [set(filter(None, base_spans(t).split(","))) for t, _ in table]
    wrong = [(t, f, g) for (t, _), f, g in zip(table, found, gold) if f != g]
    assert scores(patterns, gold) < 0.35 and scores(found, gold) > 0.8, (scores(patterns, gold), scores(found, gold), wrong)


def test_long_documents_are_decoded_in_pieces():
    field = pii.train(samples())
    rng = np.random.default_rng(3)
    words = ["call", "(743)", "555-3824", "x.y@mail.example.com", "10.0.1.7", "in", "1999", "+1", "a" * 70 + "7"]
    shapes = " ".join(rng.choice(words, 500)).translate(pii.SHAPE).split()
    want = field.decode([shapes])[0]
    for piece in (1, 7, 499, 500, 1000):
        assert (field.decode_long(lambda: iter(shapes), piece) == want).all()
    assert len(field.decode_long(lambda: iter([]))) == 0


def test_whole_shapes_count():
    assert pii.features("." * 70 + "x") != pii.features("." * 70 + "-") and len(pii.features("ab-" * 10 ** 5)[1]) < 30


def test_cache_of_shapes_is_bounded(monkeypatch):
    field, plain = pii.train(samples()), pii.train(samples())
    monkeypatch.setattr(pii, "CACHED_BYTES", 2000)
    for n in range(1, 60):
        shapes = ["d" * n, "x" * n, "(ddd)"]
        assert (field.emissions(shapes) == plain.emissions(shapes)).all() and len(field.known) < 20


def test_query_pii(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op8_pii(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = base_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == base.count(f"{kind}:")
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
