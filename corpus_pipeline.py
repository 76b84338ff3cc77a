"""A corpus through five stages: quality, language, near-duplicates, personal data,
packing. Each stage works on all that the one before kept.

The stages before the last return the columns of ``documents``; the last returns
the packed pieces. Where a stage learns, it learns from the documents it is given
and the labels in ``sf_dir``: from all of them, but for the field of the personal data,
whose examples of the corpus are a bounded, stable sample (see ``pii.learn``).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawork.llm import language, minhash, packing, pii, quality
from stratawork.llm.common import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No row of this stage's result can be stated in SQL: models are trained.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5. A text without words carries no sign
    of low quality and has the score of the bias."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.fit(docs, labels)
    return quality.score(docs, weights, out="__score").where(F.col("__score") >= 0.5).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from ``lang``: those that are
    ``und``, without text or any letter or farther from every profile than the
    labelled texts of its language are, go."""
    known, least = language.profiles(docs), language.least_scores(docs)
    found = language.identify(docs, known, lang_out="__lang", score_out="__score", least=least)
    return found.where(F.col("__lang") != language.UNKNOWN).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id, missing
    ids last: five-word shingles, similarity 0.8. Rows are told apart by a number of
    their own, written once, so repeated and missing ids are rows like others."""
    rows = Workspace(spark).table(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")))
    # Rows of one id: by their content, whatever their place.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*COLUMNS), "__row")
    groups = minhash.near_duplicates(rows, key="__row").select("__row", "component_id")
    first = groups.join(rows.select("__row", order.alias("order")), "__row").groupBy("component_id").agg(
        F.min("order")["__row"].alias("__row"))
    gone = groups.join(first.select("__row"), "__row", "left_anti")
    return rows.join(gone.select("__row"), "__row", "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = pii.redact(docs, pii.learn(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: per piece its document, place and ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality_classifier), ("language_id", language_id),
          ("near_dedup", near_dedup), ("pii", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again."""
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir))
    return docs
