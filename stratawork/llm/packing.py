"""Packing token sequences into windows by minimum bin slack.

A document's ids are cut into whole windows and one shorter piece. Which short
pieces share a window depends on their lengths alone, and there are fewer lengths
than a window has tokens, so the plan is made from a histogram of lengths, of
bounded size for any corpus. The longest piece left opens a window; a subset-sum
over bitsets finds the multiset of remaining lengths that fills the rest closest
to capacity, and is traced back to a count per length. The same filling is taken
as often as the counts allow. If no multiset fills the window, one longer piece is
cut: its head closes the window, its tail goes back among the remaining pieces.

Pieces get a rank among those of their length without moving any tokens: a running
number within the task that made them, plus a prefix sum over the tasks. The plan
says which ranks of which length go to which window.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import encoder
from .common import Workspace, column

PIECES = ("start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, "
          "part int, slot bigint")
PLAN = ("of bigint, low bigint, high bigint, cut bigint, size bigint, first bigint, "
        "copies bigint, window bigint, place bigint")
#: Rows of per-task counts up to which they are broadcast; more are shuffled.
BROADCAST_ROWS = 2_000_000


def best_filling(counts: dict[int, int], capacity: int) -> Counter:
    """The multiset of lengths, each at most as often as counted, whose sum is
    closest to ``capacity`` from below."""
    fits = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & fits
            left -= take
            take *= 2
        if reach >> capacity:
            break
    total, used = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return used


@dataclass
class Stock:
    """Pieces of one length left: runs of ranks, each of an original length and
    the tokens already cut off its head."""

    runs: list[tuple[int, int, int, int]]

    def take(self, n: int) -> list[tuple[int, int, int, int]]:
        out = []
        while n:
            of, cut, low, high = self.runs.pop()
            if high - low > n:
                self.runs.append((of, cut, low + n, high))
                high = low + n
            out.append((of, cut, low, high))
            n -= high - low
        return out


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple]:
    """Rows of ``PLAN`` for pieces of these lengths, none above ``capacity``."""
    counts = Counter({n: c for n, c in histogram.items() if c})
    stock: dict[int, Stock] = defaultdict(lambda: Stock([]))
    for n, c in counts.items():
        stock[n].runs.append((n, 0, 0, c))
    rows, window = [], 0

    def place(length: int, copies: int, times: int, at: int, size: int) -> None:
        first = 0
        for of, cut, low, high in stock[length].take(copies * times):
            rows.append((of, low, high, cut, size, first, copies, window, at))
            if size < length:
                stock[length - size].runs.append((of, cut + size, low, high))
            first += high - low

    while counts:
        seed = max(counts)
        counts[seed] -= 1
        filling = best_filling(counts, capacity - seed)
        counts[seed] += 1
        filling[seed] += 1
        slack = capacity - sum(n * c for n, c in filling.items())
        times = min(counts[n] // c for n, c in filling.items())
        longer = None
        if slack:
            # Cut the length that closes most windows.
            closes = {n: min(times, c // (filling[n] + 1) if n in filling else c)
                      for n, c in counts.items() if n > slack}
            longer = max(closes, key=lambda n: (closes[n], n), default=None)
            if longer is not None and closes[longer]:
                times = closes[longer]
            else:
                longer = None
        at = 0
        for n, c in sorted(filling.items(), reverse=True):
            place(n, c, times, at, n)
            counts[n] -= c * times
            at += n * c
        if longer is not None:
            place(longer, 1, times, at, slack)
            counts[longer] -= times
            counts[longer - slack] += times
        window += times
        counts = +counts
    return rows


def pieces(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id",
           capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Each row's ids, ``end_id`` behind them, cut into windows and a rest, with
    a running number per task and length."""
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(PIECES).fields])

    def run(batches):
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        closing = np.array([end_id], "<u4").tobytes()
        slots: Counter = Counter()
        names = schema.fieldNames()
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(),
                 pa.int64()]

        def rows(texts):
            for i, t in enumerate(texts):
                raw = enc.ids(t) + closing
                tokens = len(raw) // 4
                for start in range(0, tokens, capacity):
                    ids = raw[4 * start:4 * (start + capacity)]
                    size = len(ids) // 4
                    yield i, start, size, ids, zlib.crc32(ids), tokens, part, slots[size]
                    slots[size] += 1

        for batch in batches:
            keys, texts = column(batch, key), column(batch, text)
            for at in range(0, batch.num_rows, 1000):
                columns = list(zip(*rows(texts.slice(at, 1000).to_pylist())))
                if columns:
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(at, 1000).take(pa.array(columns[0])),
                         *[pa.array(c, type=t) for c, t in zip(columns[1:], types)]],
                        names=names)

    return docs.select(key, text).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id",
         capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Sequences of at most ``capacity`` tokens with little padding. Per piece:
    the key, ``start`` (tokens of its document before it), ``length``, ``ids``
    (little-endian unsigned 32-bit), ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` and ``offset`` in the sequence, gapless from 0.

    A null or empty text is the end id alone. Repeated rows and keys are packed
    like others, null keys too; an empty table gives no rows. Other columns are
    not kept. Jobs: one writes the pieces, one the per-task counts."""
    work = Workspace(docs.sparkSession)
    cut = work.table(pieces(docs, vocabulary, text, key, capacity, end_id))
    per_part = work.table(cut.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in
                 per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan_windows(histogram, capacity)
    plan = docs.sparkSession.createDataFrame(rows, PLAN)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = per_part.select("length", "part",
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if per_part.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("slot"))
    # The plan has a few rows per length, however many documents there are.
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("of"))
                         & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("first") + F.col("rank") - F.col("low")
    ids, crc = F.col("ids"), F.col("ids_crc32")
    if any(r[3] or r[4] != r[0] for r in rows):  # some pieces are cut once more
        ids = F.substring("ids", (4 * F.col("cut") + 1).cast("int"), (4 * F.col("size")).cast("int"))
        crc = F.when(F.col("size") == F.col("length"), crc).otherwise(F.crc32(ids))
    return placed.select(
        key, (F.col("start") + F.col("cut")).alias("start"), F.col("size").alias("length"),
        ids.alias("ids"), crc.alias("ids_crc32"), "doc_tokens",
        (F.col("window") + F.floor(nth / F.col("copies"))).cast("bigint").alias("sequence_id"),
        (F.col("place") + (nth % F.col("copies")) * F.col("size")).alias("offset"))
