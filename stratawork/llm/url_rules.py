"""URL filtering: rules by host and path, and association rules mined from labels.

Spark's FP-growth finds token combinations of labelled URLs that go with a label;
rules below a support or confidence are pruned. Judging is an inverted index: each
rule is stored under its rarest tokens, a URL's distinct tokens look rules up, and a
rule fits if all it needs is there. The best fitting rule decides.

Only DataFrame functions: no Python runs on the rows. The number of mined rules is
bounded by the minimum support, not by the number of URLs: a URL of t frequent classes
of words lies in fewer than 2 ** t combinations for each part of its host, of which at
most 2 ** t / support are frequent.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Items of a transaction that say its label; tokens never hold a blank.
BLOCK, ALLOW = "label block", "label allow"
ANY_HOST = "any host"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host and the beginning of a path: example.org/es/."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host):]


def host_of(url: str | Column) -> Column:
    """What is after the first :// up to /, ? or #, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, PARTS, 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: str | Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fitting(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits (of equally long ones
    the first by name), else nulls."""
    pattern = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern), reverse=True)[::-1]:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pattern = F.when(fits, F.lit(r.pattern)).otherwise(pattern)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pattern, verdict


def tokens(url: str | Column) -> Column:
    """Distinct tokens of a whole URL: the host and what is left of it from each
    dot on, the words of path, query and fragment. Digits count as 0, whatever
    their number and value."""
    c = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host = F.split(host_of(c), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(host)),
                           lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(host, i, F.size(host)), ".")))
    rest = F.translate(F.regexp_replace(c, "(?s)^.*?://[^/?#]*", ""), UPPER, LOWER)
    words = F.transform(F.split(F.regexp_replace(rest, "[0-9]+", "0"), r"[^\p{L}\p{N}]+"),
                        lambda w: F.concat(F.lit("word:"), w))
    return F.filter(F.array_distinct(F.concat(suffixes, words)),
                    lambda t: ~t.isin("host:", "word:"))


def mine(labelled: DataFrame, url: str = "url", blocked: str = "blocked",
         min_support: float = 0.002, min_rows: int = 20, min_confidence: float = 0.6) -> DataFrame:
    """Association rules from URLs to a label: ``antecedent`` (classes of tokens, a rule
    needs one token of each), ``tokens`` (all that its URLs have by that, sorted),
    ``index_tokens`` (its rarest class), ``verdict``, ``confidence``, ``support``. Rows
    with null url or label are left out; all others count. A rule needs a share of
    ``min_support`` and ``min_rows`` rows; no labels give no rules.

    Tokens below the support are in no rule and leave the URLs. Tokens of the same rows
    are one class, mined as one item: any of them says what all say. A host's suffixes
    imply each other, so no rule needs two: FP-growth gets a URL once for each class of
    suffixes and once for any host."""
    work = Workspace(labelled.sparkSession)
    label = F.when(F.col(blocked), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    rows = work.table(labelled.where(F.col(url).isNotNull() & F.col(blocked).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), tokens(url).alias("items"), label.alias("label")))
    n = rows.count()
    least = max(1, math.ceil(min(1.0, max(min_support, min_rows / max(1, n))) * n))
    single = rows.select("row", "label", F.explode_outer("items").alias("token"))
    classes = work.table(classes_of(single, least))
    items = classes.select("item", "hosted", F.explode("members").alias("token"))
    # Tokens per URL / min_support at most, whatever the number of URLs.
    known = single.join(F.broadcast(items), "token", "left")
    baskets = known.groupBy("row").agg(
        F.first("label").alias("label"),
        F.collect_set(F.when(F.col("hosted"), F.col("item"))).alias("hosts"),
        F.collect_set(F.when(~F.col("hosted"), F.col("item"))).alias("words"))
    places = work.table(baskets.select("words", "label", F.explode(
        F.array_append("hosts", F.lit(ANY_HOST))).alias("host")).select(
        F.concat("words", F.array("host", "label")).alias("items")))
    m = places.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, m)),
                     minConfidence=min_confidence).fit(places)
    # A combination without any host item counts a URL several times over.
    rules = model.associationRules.where(F.col("consequent")[0].isin(BLOCK, ALLOW)).select(
        F.array_sort(F.array_remove("antecedent", ANY_HOST)).alias("rule"),
        F.array_contains("antecedent", ANY_HOST).alias("anywhere"),
        F.when(F.col("consequent")[0] == BLOCK, "block").otherwise("allow").alias("verdict"),
        "confidence", (F.round(F.col("support") * m) / n).alias("support"))
    parts = rules.select("*", F.explode("rule").alias("item")).join(F.broadcast(classes), "item")
    return parts.groupBy("rule", "anywhere", "verdict", "confidence", "support").agg(
        F.collect_list("members").alias("antecedent"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("implied")))).alias("tokens"),
        F.min_by("members", F.struct("freq", "item")).alias("index_tokens"),
        F.bool_or("hosted").alias("hosted")).where(F.col("anywhere") | F.col("hosted")).drop(
        "rule", "anywhere", "hosted")


def classes_of(single: DataFrame, least: int) -> DataFrame:
    """Tokens in at least ``least`` rows of ``single`` (row, token), those of the same
    rows together: ``item`` (the first), ``members``, ``freq``, ``hosted`` (one is a
    host or its suffix), ``implied`` (the members and what a host's suffixes bring).
    Rows are compared by number and two 64-bit sums of their hashes."""
    often = single.where(F.col("token").isNotNull()).groupBy("token").agg(
        F.count("*").alias("freq"), F.bit_xor(F.xxhash64("row")).alias("one"),
        F.bit_xor(F.xxhash64("row", F.lit(1))).alias("two")).where(F.col("freq") >= least)
    classes = often.groupBy("freq", "one", "two").agg(F.array_sort(F.collect_list("token")).alias("members")).select(
        F.col("members")[0].alias("item"), "members", "freq",
        F.exists("members", lambda t: t.startswith("host:")).alias("hosted"))
    # The longest host of a class; what follows each of its dots is a token of the same URLs.
    host = F.max_by("token", F.length("token"))
    longest = classes.select("item", F.explode("members").alias("token")).where(
        F.col("token").startswith("host:")).groupBy("item").agg(host.alias("host"))
    labels = F.split(F.substring("host", 6, 1 << 30), r"\.")
    suffixes = longest.select("item", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))).alias("token"))
    of = classes.select(F.explode("members").alias("token"), F.col("members").alias("others"))
    brought = suffixes.join(of, "token").groupBy("item").agg(
        F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    return classes.join(brought, "item", "left").select(
        "item", "members", "freq", "hosted", F.coalesce("others", "members").alias("implied"))


def match(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Per distinct ``url`` that a rule fits: the best rule's ``mined_verdict``,
    ``mined_confidence`` and ``mined_tokens``. Best is the most confident, then the
    best supported, then the longest, then by its tokens."""
    seen = urls.select(url).where(F.col(url).isNotNull()).distinct().withColumn("__tokens", tokens(url))
    looked = seen.select(url, "__tokens", F.explode("__tokens").alias("index_token"))
    index = rules.withColumn("index_token", F.explode("index_tokens"))
    # A rule of one class fits by being found.
    found = looked.join(index, "index_token").where((F.size("antecedent") == 1) | F.forall(
        "antecedent", lambda c: F.arrays_overlap(c, F.col("__tokens"))))
    held = F.array_intersect("tokens", "__tokens")
    best = F.max(F.struct("confidence", "support", F.size(held).alias("n"),
                          F.array_join(held, " ").alias("tokens"), "verdict"))
    return found.groupBy(url).agg(best.alias("b")).select(
        url, F.col("b.verdict").alias("mined_verdict"),
        F.col("b.confidence").alias("mined_confidence"), F.col("b.tokens").alias("mined_tokens"))


def judge(pages: DataFrame, mined: DataFrame, rules: list[Rule], url: str = "url",
          key: str = "page_id") -> DataFrame:
    """Per row: key, ``host``, ``path``, ``rule`` (the longest that fits, else
    null), ``verdict`` (that rule's, else the best mined rule's, else allow).

    Null urls and urls without :// have an empty host and path. Repeated rows and
    null keys are judged like others; other columns are not kept."""
    host, path = host_of(url), path_of(url)
    pattern, verdict = fitting(rules, host, path)
    rows = pages.select(key, url, host.alias("host"), path.alias("path"), pattern.alias("rule"),
                        verdict.alias("__verdict"))
    # Only urls that no rule judges are looked up.
    found = match(rows.where(F.col("rule").isNull()), mined, url)
    return rows.join(found, url, "left").select(
        key, "host", "path", "rule",
        F.coalesce("__verdict", "mined_verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("mined_tokens")).alias("mined_tokens"),
        F.when(F.col("rule").isNull(), F.col("mined_confidence")).alias("mined_confidence"))
