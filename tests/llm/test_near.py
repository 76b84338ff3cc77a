"""Near-duplicate texts and vectors, and the components both use."""

import math
import random

import numpy as np
import pytest

import stratawork.llm.components as stars
from stratawork.llm import minhash, near_vectors
from stratawork.llm.common import Workspace
from stratawork.llm.components import components
from stratawork.llm.queries import op5_near_vectors, op7_minhash
from tests.conftest import DATA
from tests.llm import reference


def test_components_equal_search(spark):
    random.seed(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(200, i) for i in range(201, 240)]
    links = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(35)]
    rows = links + chain + star + links[:5] + [(7, 7), (None, 3), (9, None)]
    known = [(a, b) for a, b in rows if a is not None and b is not None and a != b]
    want = reference.components({n for l in known for n in l}, known)
    got = components(Workspace(spark), spark.createDataFrame(rows, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    none = spark.createDataFrame([(1, 1)], "a bigint, b bigint")
    assert components(Workspace(spark), none).count() == 0


def test_shingles_are_distinct_word_runs():
    for text in ["", "One", "a b", "A b a B a b", "x\x1cy é É\tz", " lead  and trail \n"]:
        for words in (1, 2, 5):
            assert len(minhash.shingles(text.encode(), words)) == len(reference.shingle_set(text, words))
    assert len(minhash.shingles(None, 2)) == 0


def test_signatures_estimate_similarity(monkeypatch):
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 400, np.uint64))
    other = np.unique(np.concatenate([base[:320], rng.integers(0, 2**63, 80, np.uint64)]))
    sig = minhash.signatures([base, other, base[:1]], 1200)
    true = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05
    monkeypatch.setattr(minhash, "BLOCK", 37)
    assert (minhash.signatures([base, other, base[:1]], 1200) == sig).all()


def test_posterior_bound():
    """With fewer matches than asked, similarity t is improbable, by integration."""
    for n, least in minhash.least_matches(120, 20, 0.8, 1e-5):
        grid = np.linspace(0, 1, 200_001)[1:-1]
        if least:
            m = least - 1
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            assert density[grid >= 0.8].sum() / density.sum() < 1.1e-5


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("words", [2, 5])
def test_groups_equal_all_pairs(spark, words):
    rng = random.Random(4)
    texts = {}
    for g in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(120)]
        # Copies of one text with edits of their own: near it, further apart among each other.
        for i in range(25):
            texts[100 * g + i] = edited(base, rng, rng.randrange(0, 10))
        for i in range(3):
            texts[100 * g + 50 + i] = " ".join(base)
    texts |= {900: None, 901: "", 902: " \n", 903: "one", 904: "ONE", 905: "one two", 906: "one two",
              907: "the same " * 30_000, 908: "the same " * 30_000}
    shared = " ".join(f"p{i}" for i in range(60))
    texts |= {1000 + i: shared + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for i in range(40)}
    sizes, low = reference.near_groups(texts, words, 80)
    rows = [(k, t, "x", True) for k, t in texts.items()]
    df = spark.createDataFrame(rows + [(None, "one", "x", True)], "doc_id bigint, text string, n string, kept boolean")
    got = minhash.near_duplicates(df.repartition(3), words=words).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        k = r["doc_id"]
        if k is None:
            assert r["component_id"] is None and r["kept"] and r["n_shingles"] == 1
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[k], low[k], low[k] == k), k


def test_blocks_join_what_all_pairs_join():
    """The links of a block join just the components that comparing all pairs joins."""
    rng = np.random.default_rng(8)
    for _ in range(60):
        m = int(rng.integers(2, 40))
        pool = rng.integers(0, 2**62, 60)
        sets = [np.unique(np.concatenate([rng.choice(pool, rng.integers(40, 60)), rng.integers(0, 2**62, rng.integers(0, 5))]))
                for _ in range(m)]
        ids = rng.permutation(100)[:m]
        comp = rng.choice(ids, m)
        left, right = rng.random(m) < 0.6, rng.random(m) < 0.8
        n = np.array([len(x) for x in sets])
        sig = np.zeros((m, 4), np.uint32)  # signatures rule nothing out
        found = minhash.linking(ids.copy(), n, comp.copy(), left, right, sig,
                                lambda: minhash.Sets(sets), [(4, 0)], 60)
        links = [(int(ids[a]), int(ids[b])) for a in np.flatnonzero(left) for b in np.flatnonzero(right) if a != b
                 and 100 * (c := len(np.intersect1d(sets[a], sets[b]))) >= 60 * (n[a] + n[b] - c)]
        tied = [(int(i), int(c)) for i, c in zip(ids, comp)]
        nodes = {x for t in tied for x in t}
        assert reference.components(nodes, links + tied) == reference.components(nodes, found + tied)
        assert len(found) < m


@pytest.mark.parametrize("weight", [500, 5_000])
def test_large_buckets_are_compared_in_many_blocks(spark, monkeypatch, weight):
    """Texts just below and just above the threshold in one group."""
    monkeypatch.setattr(minhash, "WEIGHT", weight)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = {i: edited(base, rng, 5 + i % 6) for i in range(150)}
    sizes, low = reference.near_groups(texts, 2, 80)
    assert 3 < len(set(low.values())) < 150
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, words=2).collect()}
    assert got == low


def test_near_texts_empty_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "x y z v w"), (3, "x y z v w")],
                               "doc_id bigint, text string")
    assert minhash.near_duplicates(df.limit(0), words=2).count() == 0
    got = minhash.near_duplicates(df, words=2).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (2, 2), (3, 2)]


def test_query_minhash(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sizes, low = reference.near_groups(texts, 2, 80)
    got = {r["doc_id"]: tuple(r)[1:] for r in op7_minhash(spark, DATA).select(
        "doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == {k: (sizes[k], low[k], low[k] == k) for k in texts}


def all_pairs(vectors: dict, threshold=0.9):
    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = {k: np.array(v, float) / np.linalg.norm(np.array(v, float)) for k, v in vectors.items() if usable(v)}
    keys = sorted(unit)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i]
             if len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold]
    n = {k: 0 for k in vectors}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, reference.components(vectors, links)


@pytest.mark.parametrize("part", [7, 1024])
def test_vectors_equal_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(near_vectors, "PART", part)
    rng = np.random.default_rng(6)
    vectors = {i: rng.normal(size=16).tolist() for i in range(150)}
    centre = rng.normal(size=16)
    vectors |= {200 + i: (centre + rng.normal(size=16) * 0.2).tolist() for i in range(60)}
    vectors |= {300 + i: (centre * (i + 1)).tolist() for i in range(4)} | {400 + i: centre.tolist() for i in range(5)}
    vectors |= {500: None, 501: [], 502: [0.0] * 16, 503: [None] * 16, 504: [math.nan] * 16, 505: [math.inf] * 16,
                506: [1e-200] * 16, 507: [1e200] * 16, 508: [1.0] * 3, 509: [2.0] * 3}
    n, low = all_pairs({k: v for k, v in vectors.items() if k not in (506, 507)})
    n |= {506: 1, 507: 1}
    low |= {506: 506, 507: 506}
    rows = [(k, v, 1) for k, v in vectors.items()] + [(None, centre.tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n_links int")
    got = near_vectors.near_duplicates(df.repartition(3), miss=1e-9).collect()
    assert len(got) == len(rows)
    for r in got:
        k = r["vec_id"]
        if k is None:
            assert r["component_id"] is None and r["kept"] and r["n_links"] == 0
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (n[k], low[k], low[k] == k), k
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


def test_query_vectors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    n, low = all_pairs({r["vec_id"]: r["embedding"] for r in rows})
    got = op5_near_vectors(spark, DATA).collect()
    assert len(got) == len(rows)
    for r in got:  # no link below the threshold, nearly all above
        assert r["n_links"] <= n[r["vec_id"]] and r["component_id"] >= low[r["vec_id"]]
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(n.values())


def test_flat_trees_need_no_round(spark, monkeypatch):
    """Repeated links of stars, then a chain: rounds are run only while a tree is deep, none to see the end of it."""
    rounds, plain = [], stars._stars
    monkeypatch.setattr(stars, "_stars", lambda links: rounds.append(1) or plain(links))
    work = Workspace(spark)

    def found(pairs):
        rounds.clear()
        got = components(work, spark.createDataFrame(pairs, "a bigint, b bigint"))
        return sorted((r["node"], r["component"]) for r in got.collect())

    assert found([(1, 2), (3, 1), (2, 1), (1, 3), (7, 9), (4, 4), (None, 1)]) == [
        (1, 1), (2, 1), (3, 1), (7, 7), (9, 7)]
    assert not rounds
    assert found([(i, i + 1) for i in range(30)]) == [(i, 0) for i in range(31)]
    assert rounds
    assert found([(5, 5)]) == []


def test_small_tables_are_not_written_per_shuffle_partition(spark, monkeypatch):
    files, plain = [], Workspace.table
    monkeypatch.setattr(Workspace, "table", lambda *a, **k: files.append(plain(*a, **k)) or files[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "67")
    monkeypatch.setattr(Workspace, "drop", lambda self, df: None)
    try:
        words = [f"w{i}" for i in range(400)]
        docs = [(i, " ".join(words[7 * (i % 9):][:40]) + f" {i % 3}") for i in range(90)]
        got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), words=2).collect()
        assert len(got) == 90
        classes = next(f for f in files if "digest" in f.columns and "sig" not in f.columns)
        assert len(classes.inputFiles()) <= 33  # one is the empty first part
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
