"""Quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader updates, scored as sparse dot products.

Words and runs of punctuation are tokens; one- and two-token sequences are hashed
into a fixed number of weights. A token that repeats the one before it, or the one
before that, also counts as such, whatever the word. A document's value for a weight is its share of
the n-grams times the root of their number, so long and short texts weigh alike.

The model is fitted on all labelled rows, in shards of bounded size whose weights
are averaged: labelled texts are shuffled twice, to their labels and to a shard; others
stay where they are. Scoring reads whole texts and moves nothing but one weight vector
of fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fold, likely, with_arrow

TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS = 18
CACHED_TOKENS = 400_000
#: Hashes of "same as the last token" and "same as the last but one".
REPEATS = (0x1000000000000001, 0x2000000000000003)
#: Tokens hashed at a time, so that a very long text stays small in memory.
PIECE = 200_000
#: Parts of one in which shards' weights are summed: whole numbers, so that the sum
#: does not depend on the order of the shards.
UNIT = 1 << 28


class Features:
    """Texts to hashed n-grams."""

    def __init__(self, bits: int = BITS):
        self.shift, self.known = np.uint64(64 - bits), {}

    def _hashes(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            found = [known[t] for t in tokens]
        except KeyError:
            if len(known) > CACHED_TOKENS:
                known.clear()
            for t in set(tokens).difference(known):
                raw = t.encode("utf-8", "surrogatepass")
                known[t] = zlib.crc32(raw) | (zlib.adler32(raw) << 32)
            found = [known[t] for t in tokens]
        return np.array(found, dtype=np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        """Indices of all one- and two-token sequences, with repeats."""
        tokens = TOKEN.findall(text or "")
        out, last = [], None
        for at in range(0, len(tokens), PIECE):
            h = self._hashes(tokens[at:at + PIECE])
            one = (h * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
            run = h if last is None else np.concatenate([last, h])
            pairs = run[max(0, len(run) - len(h) - 1):]
            mixed = (pairs[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (pairs[1:] * np.uint64(0x165667B19E3779F9))
            two = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
            again = [np.full(int((pairs[1:] == pairs[:-1]).sum()), REPEATS[0], np.uint64),
                     np.full(int((run[2:] == run[:-2]).sum()), REPEATS[1], np.uint64)]
            again = (np.concatenate(again) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
            out += [one, two, again]
            last = run[-2:]
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


class Ftrl:
    """Follow the regularised leader (proximal), one learning rate per weight.
    The last weight is the bias."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((2, (1 << bits) + 1))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (squash(np.dot(w, x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def squash(x: float | np.ndarray) -> float | np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def sparse(indices: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices with their values, and the bias."""
    at, count = np.unique(indices, return_counts=True)
    x = count / np.sqrt(max(1, count.sum()))
    return np.append(at, 1 << bits), np.append(x, 1.0)


def labelled(docs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``docs`` joined with ``known``, which grows as they do and so is never
    broadcast: at any size both are shuffled, of the documents few but the labelled."""
    return likely(docs, known, key).join(known.hint("merge"), key)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
        label: str = "quality", shards: int = 4, shard_rows: int = 6_000, epochs: int = 3,
        bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05,
        l2: float = 0.5) -> np.ndarray:
    """Weights learned from the rows of ``docs`` that ``labels`` names.

    All labels are used but nulls, in at least ``shards`` shards of about
    ``shard_rows`` rows; a shard's weight is its number of rows. Repeated labels count
    as often as they stand there. Without any label all weights are 0 and every score
    is 0.5."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        key, F.col(label).cast("int").alias("__label"))
    many = max(shards, -(-known.count() // shard_rows))
    rows = labelled(docs.select(key, text), known, key).select(
        F.xxhash64(key).alias("__at"), text, "__label").repartition(many).sortWithinPartitions("__at")

    def run(batches: Iterable[pa.RecordBatch]):
        features, model, seen = Features(bits), Ftrl(bits, alpha, beta, l1, l2), []
        for batch in batches:
            for t, y in zip(column(batch, text).to_pylist(), column(batch, "__label").to_pylist()):
                at, x = sparse(features.of(t), bits)
                seen.append((at.astype(np.int32), x.astype(np.float32), y))
        for _ in range(epochs):
            for at, x, y in seen:
                model.learn(at, x, y)
        if seen:
            w = model.weights().astype(np.float32).astype(np.float64)
            at = np.flatnonzero(w)
            # The number of rows stands behind the last weight.
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(at, len(w))), pa.array(np.append(
                    np.rint(w[at] * (len(seen) * UNIT)).astype(np.int64), len(seen)))], names=["at", "s"])

    # One row per weight, however many shards.
    made = rows.mapInArrow(run, "at bigint, s bigint").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    sums = np.zeros((1 << bits) + 2)
    sums[made["at"].to_numpy()] = made["s"].to_numpy()
    return (sums[:-1] / (max(1.0, sums[-1]) * UNIT)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text",
          out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text; a null or
    empty text has the score of the bias alone."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def maker():
        features, w = Features(bits), shared.value
        bias = float(w[-1])

        def one(t: str | None) -> float:
            at = features.of(t)
            return float(squash(bias + float(w[at].sum(dtype=np.float64)) / max(1, len(at)) ** 0.5))
        return lambda batch: [[one(t) for t in column(batch, text).to_pylist()]]

    return with_arrow(docs, f"`{out}` double", maker)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
             label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """Score and decision per row; learns only from rows outside the held-out
    fold (CRC-32 of the key modulo 3 is 1)."""
    held = fold(key, 3) == 1
    weights = fit(docs, labels.where(~held), text, key, label)
    return score(docs.select(key, text), weights, text).select(
        key, held.alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
