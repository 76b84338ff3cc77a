"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the list of the most frequent letter sequences (one to three letters,
words padded with a blank on both sides), most frequent first. A document goes to
the language whose profile its own is closest to: the sum, over the document's
sequences, of how far each is out of place, missing ones counting as farthest.

Sequences are exact: three code points fit into one 64-bit number. Profiles and
limits are learned from all labelled rows; every text is judged whole.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fold, with_arrow

UNKNOWN = "und"
POINT = np.uint64(21)  # bits of a code point
#: Code points counted at a time; a longer text is counted in pieces.
PIECE = 1_000_000


@functools.cache
def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    return np.array([p if chr(p).isalpha() else 0 for p in range(sys.maxunicode + 1)], np.uint32)


def _grams(points: np.ndarray) -> np.ndarray:
    """Sequences in a run of letters (0: no letter), which begins and ends with 0.
    Blanks are kept at word borders: a sequence may begin or end with one."""
    p = points.astype(np.uint64)
    a, b, c = p[:-2], p[1:-1], p[2:]
    one = b[b > 0]
    two = (a << POINT | b)[(a > 0) | (b > 0)]
    three = (a << (POINT * np.uint64(2)) | b << POINT | c)[b > 0]
    # The number of code points in the upper bits: else a blank at the start is lost.
    return np.concatenate([one, two | np.uint64(1 << 63), three])


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences of a text and their counts; none without letters."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table, found, counts = letters(), [], []
    low = text.lower()
    for at in range(0, len(low), PIECE):
        raw = low[max(0, at - 1):at + PIECE + 1].encode("utf-32-le", "surrogatepass")
        points = table[np.frombuffer(raw, "<u4")]
        if at == 0:
            points = np.concatenate([[0], points])
        if at + PIECE >= len(low):
            points = np.concatenate([points, [0, 0]])
        # Several blanks are one; the ends belong to the neighbouring pieces.
        keep = points > 0
        keep[1:] |= points[:-1] > 0
        keep[0] = keep[-1] = True
        points = points[keep]
        if len(points) < 3:
            continue
        g, n = np.unique(_grams(points), return_counts=True)
        found.append(g)
        counts.append(n)
    return summed(found, counts)


class Tally:
    """Counts of many texts, summed when many have gathered."""

    def __init__(self, at_once: int = 2_000_000):
        self.parts, self.held, self.at_once = [], 0, at_once

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((grams, counts))
        self.held += len(grams)
        if self.held > self.at_once:
            self.parts, self.held = [self.sums()], 0

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        return summed([p[0] for p in self.parts], [p[1] for p in self.parts])


def summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(grams) == 1:
        return grams[0], counts[0]
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, where = np.unique(np.concatenate(grams), return_inverse=True)
    return g, np.bincount(where, weights=np.concatenate(counts), minlength=len(g)).astype(np.int64)


def top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent, most frequent first; ties by their number."""
    if len(grams) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")[:size]]


def _labelled(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang)


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang",
             size: int = 300) -> dict[str, np.ndarray]:
    """Profile per language, from all rows of it; rows without language or text are
    left out, and a language without any letter has no profile."""
    rows = _labelled(docs, text, lang)

    def run(batches):
        for batch in batches:
            names = np.array(column(batch, lang).to_pylist())
            texts = column(batch, text)
            for name in np.unique(names):
                tally = Tally()
                for i in np.flatnonzero(names == name):
                    tally.add(*counted(texts[int(i)].as_py()))
                g, n = tally.sums()
                if len(g):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(name)] * len(g)), pa.array(g.view(np.int64)), pa.array(n)],
                        names=["l", "g", "n"])

    sums = rows.mapInArrow(run, "l string, g bigint, n bigint").groupBy("l", "g").agg(
        F.sum("n").alias("n"))
    # Numbers are unsigned; the order of ties is that of ``top``.
    tie = F.col("g").bitwiseXOR(F.lit(-(1 << 63)))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), tie))
    best = sums.withColumn("place", place).where(F.col("place") <= size).collect()
    out: dict[str, list] = {}
    for r in sorted(best, key=lambda r: (r["l"], r["place"])):
        out.setdefault(r["l"], []).append(r["g"])
    return {name: np.array(g, np.int64).view(np.uint64) for name, g in out.items()}


def least_scores(docs: DataFrame, text: str = "text", lang: str = "lang",
                 min_rows: int = 8) -> dict[str, float]:
    """Per language the score below which a text is not in it, from all rows that
    ``profiles`` learns from: each half is judged by profiles of the other. The limit
    lies three times as far below the median as the lowest tenth ends (3.8 standard
    deviations, were the scores normal), so one tenth of wrong labels does not reach
    it. A language of fewer than ``min_rows`` judged rows has no limit."""
    # By the text: copies are in one half.
    half = F.pmod(F.xxhash64(text), F.lit(2))
    rows = _labelled(docs, text, lang)
    judged = [identify(rows.where(half == h), profiles(rows.where(half != h), text, lang), text) for h in (0, 1)]
    own = judged[0].union(judged[1]).where((F.col("lang_pred") == F.col(lang)) & (F.col("score") > 0))
    # Exact percentiles of counted scores: a score is a fraction with at most 300 * 300
    # parts, so however many rows there are, a language has a bounded number of them.
    tallied = own.groupBy(lang, "score").agg(F.count("*").alias("n"))
    low, middle = (F.percentile("score", F.lit(p), F.col("n")) for p in (0.1, 0.5))
    limits = tallied.groupBy(lang).agg(F.sum("n").alias("n"), (middle - 3 * (middle - low)).alias("least"))
    return {r[lang]: r["least"] for r in limits.where(F.col("n") >= min_rows).collect()}


def identify(docs: DataFrame, known: dict[str, np.ndarray], text: str = "text",
             size: int = 300, lang_out: str = "lang_pred", score_out: str = "score",
             least: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with the closest language and a score: 1 less the distance's
    share of the largest possible one. Equal distances go to the first name. Null
    texts, texts without letters and texts judged without any profile are ``und``
    with score 0. With ``least``, so are, with their score, texts that share nothing
    with any profile or score less than their language's limit."""
    names = sorted(known)
    shared = docs.sparkSession.sparkContext.broadcast((names, [known[n] for n in names]))

    def maker():
        names, tables = shared.value
        grams = np.unique(np.concatenate([*tables, np.zeros(0, np.uint64)]))
        place = np.full((len(names), len(grams) + 1), size, np.int32)
        for i, t in enumerate(tables):
            place[i, np.searchsorted(grams, t)] = np.arange(len(t))

        def one(value: str | None) -> tuple[str, float]:
            own = top(*counted(value), size)
            if not len(own) or not names:
                return UNKNOWN, 0.0
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            at = np.where(grams[at] == own, at, len(grams))
            there = place[:, at]
            apart = np.where(there < size, np.abs(there - np.arange(len(own))), size).sum(axis=1)
            best = int(np.argmin(apart))
            score = 1.0 - float(apart[best]) / (size * len(own))
            far = least is not None and (score <= 0 or score < least.get(names[best], 0.0))
            return UNKNOWN if far else names[best], score

        def compute(batch):
            made = [one(t) for t in column(batch, text).to_pylist()]
            return [[m[0] for m in made], [m[1] for m in made]]
        return compute

    return with_arrow(docs, f"`{lang_out}` string, `{score_out}` double", maker)


def predict(docs: DataFrame, text: str = "text", lang: str = "lang",
            key: str = "doc_id") -> DataFrame:
    """Language per row; learns only from rows outside the held-out fold (CRC-32
    of the key modulo 5 is 0)."""
    held = fold(key, 5) == 0
    known = profiles(docs.where(~held), text, lang)
    return identify(docs.select(key, text), known, text).select(
        key, held.alias("held_out"), "lang_pred", "score")
