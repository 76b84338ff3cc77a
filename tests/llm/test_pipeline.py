"""The pipeline's stages against the operators' brute-force versions."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from stratawork.llm import byte_bpe
from tests.conftest import DATA
from tests.llm import reference
from tests.llm.test_bpe_packing import check_packed


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """The rows after each stage, each written and read again."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return [spark.read.parquet(f"{DATA}/documents.parquet"), *out]


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(results):
    assert len(corpus_pipeline.STAGES) == 5
    for df in results[1:5]:
        assert df.columns == list(corpus_pipeline.COLUMNS) and df.dtypes == results[0].dtypes


def test_quality_and_language_keep_clean_documents(spark, results):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before, after, known = (texts(r) for r in results[:3])
    assert all(before[k] == t for k, t in after.items())
    good = [k for k, q in labels.items() if q == 1]
    bad = [k for k, q in labels.items() if q == 0]
    assert np.mean([k in after for k in good]) >= 0.98
    assert np.mean([k in after for k in bad]) <= 0.4
    assert set(known) == {k for k, t in after.items() if any(c.isalpha() for c in t)}


UNLEARNED = [
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és "
    "lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni "
    "rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."]


def test_texts_of_no_learned_language_go(spark, results):
    """Also when one of them has a wrong label; clean documents stay."""
    rows = [(10**9 + i, t, lang, "s", len(t)) for lang in (None, "de") for i, t in enumerate(UNLEARNED)]
    mixed = results[1].union(spark.createDataFrame(rows, results[1].schema))
    kept = corpus_pipeline.language_id(spark, mixed, DATA)
    assert texts(kept) == texts(results[1])
    # Too few labelled texts for a limit: only what shares nothing with a profile goes.
    few = results[1].where("lang = 'de'").limit(3)
    greek = spark.createDataFrame([(10**9, UNLEARNED[0], None, "s", 60)], few.schema)
    assert texts(corpus_pipeline.language_id(spark, few.union(greek), DATA)) == texts(few)


def test_near_dedup_keeps_one_of_each_group(results):
    before, after = texts(results[2]), texts(results[3])
    _, low = reference.near_groups(before, 5, 80)
    assert set(after) == {k for k in before if low[k] == k}
    assert all(before[k] == t for k, t in after.items())


def test_near_dedup_keeps_one_row_of_repeated_and_missing_ids(spark, results):
    a = " ".join(f"alpha{i}" for i in range(200))
    b, c = (" ".join(f"{w}{i}" for i in range(200)) for w in ("beta", "gamma"))
    rows = [(5, a), (5, a), (5, a + " end"), (None, a), (None, b), (None, b), (None, b + " end"),
            (7, c), (7, "other words stand here"), (8, c), (None, None), (None, ""), (9, ""), (9, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], results[0].schema)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs.repartition(3), DATA).collect()),
                 key=str)
    of_a, of_b = [r for r in got if r[1] in (a, a + " end")], [r for r in got if r[1] in (b, b + " end")]
    assert len(of_a) == 1 and of_a[0][0] == 5 and len(of_b) == 1
    rest = [(7, c), (7, "other words stand here"), (None, None), (None, ""), (9, ""), (9, "")]
    assert sorted((r for r in got if r not in of_a + of_b), key=str) == sorted(rest, key=str)


def test_personal_data_goes(results):
    before, after = texts(results[3]), texts(results[4])
    assert set(before) == set(after)
    for k, t in before.items():
        assert not reference.base_spans(after[k])
        if not reference.base_spans(t):
            assert after[k] == t
    assert all(r["n_chars"] == len(r["text"]) for r in results[4].collect())


def test_packing_holds_all_that_is_left(results):
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                               mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    ids = {k: [[*oracle.encode_ordinary(t), 0]] for k, t in texts(results[4]).items()}
    assert check_packed(results[5].collect(), ids, 1024) < 1024


def test_empty_and_null_documents(spark):
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (2, "", None, "s", 0)]
    nulls = spark.createDataFrame(rows, empty.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
        kept = stage(spark, nulls, DATA)
        assert kept.count() == {"language_id": 0}.get(name, 4), name
