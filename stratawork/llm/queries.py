"""The operators of this package as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, centroids, language, minhash, near_vectors, packing, pii, prefix_trie, quality, secrets, topk,
               url_rules, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, folder, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


@query
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text to ids and back."""
    return byte_bpe.digests(table(spark, folder, "documents"),
                            public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN)


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from two of three labelled folds."""
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from four of five folds."""
    return language.predict(table(spark, folder, "documents"))


@query
def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicates of two-word shingles at 0.8 among all documents."""
    return minhash.near_duplicates(table(spark, folder, "documents"), words=2)


@query
def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text."""
    return pii.counts(table(spark, folder, "documents"))


#: The host and path rules that the query applies.
URL_RULES = [url_rules.Rule("allow", "org/"), url_rules.Rule("block", "example.org/es/"),
             url_rules.Rule("block", "example.org/en/1"), url_rules.Rule("allow", "com/fr/"),
             url_rules.Rule("block", "com/de/")]


@query
def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url by rules, and by what FP-growth mines from the labels of
    the documents with the pages' ids: of low quality or toxic is to block."""
    pages = table(spark, folder, "pages")
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    labelled = pages.select("page_id", "url").join(labels, "page_id")
    return url_rules.judge(pages, url_rules.mine(labelled), URL_RULES)


@query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages to seekable bundles and back."""
    return warc.round_trip(table(spark, folder, "pages"))


@query
def op5_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return near_vectors.near_duplicates(table(spark, folder, "embeddings"))


@query
def op2_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best of all documents for every document whose id 50 divides."""
    docs = table(spark, folder, "documents")
    return topk.search(docs, docs.where("doc_id % 50 = 0"))


@query
def op11_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every text."""
    return secrets.counts(table(spark, folder, "documents"))


@query
def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors of 64 finite components round 16 centroids."""
    return centroids.cluster(table(spark, folder, "embeddings"))


ORACLES["op12_clusters"] = centroids.oracle()


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All prefixes of the rebuilt conversations."""
    return prefix_trie.trie(table(spark, folder, "conversations"))


ORACLES["op13_prefix_trie"] = prefix_trie.ORACLE


ORACLES["op3_warc"] = warc.ORACLE
ORACLES["op7_minhash"] = minhash.ORACLE
