"""Exact top-k search by BM25 with block-max pruning.

Every task indexes the documents it scans, in shards of bounded size, cut into blocks of
like documents. Most of what a text shares with others are common words: the impacts of
the commonest terms stand in a matrix per block, with the largest of each term and block
beside it; all other terms have lists of the documents that hold them. Queries are
searched many at a time. Their lists are added up first, then the sum of the largest
impacts bounds what the matrix can add in a block. Only blocks that may reach a query's
limit are opened for it: a product of matrices adds the common terms for all queries that
ask for the block. This is not WAND: whole blocks are opened, no pivot moves along the
lists. These sums are in single precision and only choose documents; whatever comes near
the limit is scored in double precision from all its terms. Impacts leave out the inverse
document frequency: queries carry it from statistics of all documents, so scores of all
shards compare, and merging the k best of each shard is exact.

Documents are searched in rounds, each of some times as many as before it; none is
searched twice. After a round, a query's k-th best score so far is the least that
later rounds look for: it raises no result out, and all shards of a round together
find a few times k documents for a query, however many they are. Only the first
round, of as many documents as fit in a shard, has no such limit.

Queries are a table in the shared folder that every shard reads in batches: queries
are neither shuffled nor broadcast, and of the documents only those of the rounds
before the last are. The work is that of all queries against all documents: if queries
grow with the documents, with their product, less what the bounds save.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, column
from .warc import opened

WORD = re.compile(r"\w+")
BLOCK, SHARD_DOCS, SHARD_POSTINGS = 64, 20_000, 8_000_000
#: Times that the documents searched grow from one round to the next.
GROWTH = 4
#: Terms of more than this share of a shard's documents stand in a matrix, the commonest
#: if they are more than so many; all others have lists.
COMMON_SHARE, COMMON_TERMS = 1 / 32, 1024
#: Share by which bounds are raised, and limits lowered, against rounding: sums of
#: COMMON_TERMS products of single precision, none below 0, are off by 7e-5 at most.
SLACK = 1e-4
#: Pairs of a query and a document, postings and letters that are worked on at a time.
CELLS, STEP, LETTERS = 1 << 21, 1 << 16, 1 << 22


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point whether it stands in words, and its bytes in UTF-8."""
    points = np.arange(0x110000)
    inside = np.zeros(len(points), bool)
    inside[[ord(c) for c in map(chr, points) if WORD.match(c)]] = True
    return inside, (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int8)


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts the sorted hashes of each one's distinct words, their counts, and
    where each text's end."""
    parts, at, many = [], 0, 0
    for i, t in enumerate(texts, 1):
        many += len(t or "")
        if many >= LETTERS or i == len(texts):
            parts.append(_vectors(texts[at:i]))
            at, many = i, 0
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms, counts, lengths = map(np.concatenate, zip(*parts))
    return terms, counts, np.cumsum(lengths)


def _vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n" + b"\n".join(lower) + b"\n"
    points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter, size = letters()
    inside = is_letter[points]
    if len(points) < len(raw):
        inside = np.repeat(inside, size[points])
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    offsets = np.zeros(len(edges) // 2 + 1, np.int64)
    np.cumsum(edges[1::2] - edges[::2], out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer(offsets), pa.py_buffer(np.frombuffer(raw, np.uint8)[inside])]).dictionary_encode()
    distinct = words.dictionary.to_numpy(zero_copy_only=False)
    terms = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)).view(np.int64)
    order = np.argsort(terms)
    code = np.empty(len(terms), np.int64)
    code[order] = np.arange(len(terms))
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in lower]), edges[::2], "left")
    key = np.sort(owner * len(terms) + code[words.indices.to_numpy()])
    first = np.flatnonzero(np.diff(key, prepend=-1))
    owner, code = np.divmod(key[first], max(1, len(terms)))
    return terms[order[code]], np.diff(first, append=len(key)), np.bincount(owner, minlength=len(texts))


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct words of a text, and their counts."""
    return vectors([text])[:2]


class Shard:
    """Documents by term: the commonest terms' impacts in a matrix per block of like
    documents, all others' in lists; and by document, for its exact score."""

    def __init__(self, ids: list[int | None], docs: list[tuple[np.ndarray, np.ndarray]],
                 average: float, k1: float, b: float):
        self.n = len(docs)
        lengths = np.array([len(t) for t, _ in docs])
        # Like documents share a block: by their two commonest words, then size.
        terms, counts = (np.concatenate(c) for c in zip(*docs))
        rank, leading = (counts << 32) - np.arange(len(counts)), []
        for _ in range(2):
            top = np.maximum.reduceat(rank, np.cumsum(lengths) - lengths)
            at = np.where(top > 0, -top & 0xFFFFFFFF, 0)
            leading.append(np.where(top > 0, terms[at], -1))
            rank[at] = -1
        order = np.lexsort((lengths, leading[1], leading[0]))
        del rank
        self.ids = [ids[i] for i in order]
        # Place of an id among all, nulls last: equal scores go by it.
        self.place = np.empty(self.n, np.int64)
        self.place[sorted(range(self.n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))] = np.arange(self.n)
        lengths = lengths[order]
        terms = np.concatenate([docs[i][0] for i in order])
        counts = np.concatenate([docs[i][1] for i in order]).astype(float)
        self.words, self.ends = lengths, np.cumsum(lengths)
        owner = np.repeat(np.arange(self.n, dtype=np.int32), lengths)
        norm = k1 * (1 - b + b * np.add.reduceat(counts, self.ends - lengths) / average)
        self.impact = counts * (k1 + 1) / (counts + np.repeat(norm, lengths))
        by = np.argsort(terms)
        first = np.flatnonzero(np.diff(terms[by], prepend=terms[by[0]] - 1))
        self.vocabulary, df = terms[by[first]], np.diff(first, append=len(by))
        self.wanted = np.zeros(len(df))
        self.term = np.empty(len(terms), np.int32)
        self.term[by] = np.repeat(np.arange(len(df), dtype=np.int32), df)
        # Terms by matrix: their column, else -1.
        common = np.flatnonzero(df > self.n * COMMON_SHARE)
        common = common[np.argsort(-df[common], kind="stable")[:COMMON_TERMS]]
        self.column = np.full(len(df), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.blocks = -(-self.n // BLOCK)
        here = self.column[self.term] >= 0
        self.matrix = np.zeros((self.blocks, len(common), BLOCK), np.float32)
        self.matrix[owner[here] // BLOCK, self.column[self.term[here]], owner[here] % BLOCK] = self.impact[here]
        self.bound = self.matrix.max(axis=2).T.copy()
        by = by[~here[by]]
        self.doc, self.weight = owner[by], self.impact[by].astype(np.float32)
        self.length = np.where(self.column < 0, df, 0)
        self.start = np.cumsum(self.length) - self.length

    def _scores(self, blocks: np.ndarray) -> None:
        """Opens blocks: what the matrix adds to the scores of their documents, for
        the queries that ask for them."""
        for block in blocks:
            asking = np.flatnonzero(self.asked[:, block])
            whole = len(asking) == len(self.queries)
            more = (self.queries if whole else self.queries[asking]) @ self.matrix[block]
            self.sums[asking, block] += more
            self.opened[asking, block] = True

    def _open(self, asked: np.ndarray) -> None:
        self.asked = asked & ~self.opened
        self._scores(np.flatnonzero(self.asked.any(axis=0)))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int,
               least: float = 0.0) -> list[tuple[int | None, float]]:
        """The k best documents with a score above 0 and of at least ``least``; equal
        scores go by the smaller id, nulls last."""
        _, docs, scores = self.search_all(terms, weights, np.array([len(terms)]), k, np.array([least]))
        return list(zip(docs, scores))

    def search_all(self, terms: np.ndarray, weights: np.ndarray, ends: np.ndarray, k: int,
                   least: np.ndarray) -> tuple[list[int], list[int | None], list[float]]:
        """``search`` for many queries, whose terms end at ``ends``: numbers of queries,
        ids, scores."""
        asker = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        here = self.vocabulary[at] == terms
        at, weights, asker = at[here], weights[here], asker[here]
        out, size = ([], [], []), max(1, CELLS // (self.blocks * BLOCK))
        for i in range(0, len(ends), size):
            x, y = np.searchsorted(asker, [i, i + size])
            found = self._batch(at[x:y], weights[x:y], asker[x:y] - i, k, least[i:i + size])
            for q, docs, scores in found:
                out[0].extend([q + i] * len(docs))
                out[1].extend(self.ids[d] for d in docs)
                out[2].extend(scores.tolist())
        return out

    def _batch(self, at: np.ndarray, weights: np.ndarray, asker: np.ndarray, k: int,
               least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        many, width = len(least), self.blocks * BLOCK
        # Lists first: with what the matrix can add at most, they bound blocks.
        sums = np.zeros(many * width)
        listed = np.flatnonzero(self.length[at])
        steps = np.cumsum(self.length[at[listed]]) // STEP
        for part in np.split(listed, np.flatnonzero(np.diff(steps)) + 1):
            if not len(part):
                continue
            length, base = self.length[at[part]], asker[part[0]] * width
            where = spread(self.start[at[part]], length)
            to = self.doc[where] + np.repeat(asker[part] * width - base, length)
            new = np.bincount(to, self.weight[where] * np.repeat(weights[part], length))
            sums[base:base + len(new)] += new
        self.sums = sums.reshape(many, self.blocks, BLOCK)
        self.queries = np.zeros((many, self.matrix.shape[1]), np.float32)
        common = self.column[at] >= 0
        self.queries[asker[common], self.column[at[common]]] = weights[common]
        upper = (self.sums.max(axis=2) + self.queries @ self.bound) * (1 + SLACK)
        self.opened = np.zeros(upper.shape, bool)
        flat = self.sums.reshape(many, width)
        # Where no search elsewhere has set a limit, the likeliest blocks set one.
        least, free = np.array(least, float), np.flatnonzero(least <= 0)
        if len(free) and width > k:
            best = np.argpartition(-upper[free], min(2, self.blocks) - 1, axis=1)[:, :2]
            likely, limit = np.zeros(upper.shape, bool), least.copy()
            likely[free[:, None], best] = True
            self._open(likely)
            limit[free] = np.partition(flat[free], width - k, axis=1)[:, width - k] * (1 - SLACK)
        else:
            limit = least
        self._open((upper >= limit[:, None]) & (upper > 0))
        found = (flat >= limit[:, None] * (1 - SLACK)) & (flat > 0)
        for q in np.flatnonzero(found.any(axis=1)):
            docs = np.flatnonzero(found[q])
            if len(docs) > k:
                near = np.partition(flat[q, docs], len(docs) - k)[len(docs) - k] * (1 - 3 * SLACK)
                docs = docs[flat[q, docs] >= near]
            x, y = np.searchsorted(asker, [q, q + 1])
            scores = self._exact(docs, at[x:y], weights[x:y])
            keep = (scores >= least[q]) & (scores > 0)
            docs, scores = docs[keep], scores[keep]
            best = np.lexsort((self.place[docs], -scores))[:k]
            if len(best):
                yield q, docs[best], scores[best]

    def _exact(self, docs: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores in double precision. Impacts are added in the order of terms, whatever
        the shard."""
        self.wanted[at] = weights
        out = np.zeros(len(docs))
        for i, (start, end) in enumerate(zip(self.ends[docs] - self.words[docs], self.ends[docs])):
            out[i] = np.cumsum(self.wanted[self.term[start:end]] * self.impact[start:end])[-1]
        self.wanted[at] = 0
        return out


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


def shares(docs: int) -> list[float]:
    """Growing shares of the documents, of which the first fits in a shard."""
    out = [1.0]
    while docs * out[0] > SHARD_DOCS:
        out.insert(0, out[0] / GROWTH)
    return out


def statistics(docs: DataFrame, text: str) -> DataFrame:
    """Per term its number of documents; the row without term has the number of
    documents and of words."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts, _ = vectors(column(batch, text).to_pylist())
            words = int(counts.sum())
            terms, df = np.unique(terms, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([None, *terms.tolist()], pa.int64()), pa.array([batch.num_rows, *df.tolist()], pa.int64()),
                pa.array([words] + [0] * len(terms), pa.int64())], names=["term", "df", "words"])

    return docs.select(text).mapInArrow(run, "term bigint, df bigint, words bigint").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("words").alias("words"))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id",
           query_text: str = "text", query_key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best rows of ``docs`` for each row of ``queries``: ``query_id``,
    key, ``score``, ``rank``. A query is the bag of its words, each as often as it
    stands there; equal scores go by the smaller key, nulls last, and only scores
    above 0 count, so a null or empty text has no results and is in none. Queries
    of one key are one bag of words; without key they are left out. An empty table
    gives no rows."""
    work = Workspace(docs.sparkSession)
    stats = work.table(statistics(docs, text))
    whole = stats.where("term is null").first()
    n, words = (whole["df"], whole["words"]) if whole else (0, 0)

    def bag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts, ends = vectors(column(batch, "t").to_pylist())
            ids = np.repeat(column(batch, "q").to_numpy(), np.diff(ends, prepend=0))
            rows = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(terms), pa.array(counts)],
                                              names=["query_id", "term", "tf"])
            yield from (rows.slice(i, STEP) for i in range(0, rows.num_rows, STEP))

    asked = queries.where(F.col(query_key).isNotNull()).select(
        F.col(query_key).cast("bigint").alias("q"), F.col(query_text).alias("t")).mapInArrow(
        bag, "query_id bigint, term bigint, tf bigint")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.groupBy("query_id", "term").agg(F.sum("tf").alias("tf")).join(
        stats.where("term is not null"), "term").select("query_id", "term", (F.col("tf") * idf).alias("w"))
    bags = work.table(weighted.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("term", "w"))).alias("bag")).select(
        "query_id", F.col("bag.term").alias("terms"), F.col("bag.w").alias("weights"), F.lit(0.0).alias("least")))
    average, parts = max(1.0, words / max(1, n)), shares(n)
    rows, before, found = docs.select(F.col(key).cast("bigint").alias("d"), F.col(text).alias("t")), 0.0, None
    spot = F.pmod(F.xxhash64("d"), F.lit(1 << 30)) / float(1 << 30)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.col("doc").asc_nulls_last()))
    for share in parts:
        some = rows if len(parts) == 1 else rows.where((spot >= before) & (spot < share))
        if share < 1:  # in shards of a quarter of the largest, so that tasks share the round
            some = some.repartition(-(-int(4 * n * (share - before)) // SHARD_DOCS) or 1)
        hits = _hits(some, bags, k, average, k1, b)
        best = (hits if found is None else found.unionByName(hits)).withColumn("rank", place).where(F.col("rank") <= k)
        if share < 1:
            before, found = share, work.table(best.drop("rank"))
            limits = found.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("limit"))
            limits = limits.where(F.col("c") == k).select("query_id", "limit")
            limited = work.table(bags.drop("least").join(limits, "query_id", "left").select(
                "query_id", "terms", "weights", F.coalesce("limit", F.lit(0.0)).alias("least")))
            work.drop(bags)
            bags = limited
    return best.select("query_id", F.col("doc").alias(key), "score", F.col("rank").cast("bigint").alias("rank"))


def _hits(docs: DataFrame, bags: DataFrame, k: int, average: float, k1: float, b: float) -> DataFrame:
    """The k best documents (d, t) of each shard for every query, that reach its ``least``."""
    where = bags._workspace_path

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(ids: list, docs: list) -> Iterator[pa.RecordBatch]:
            shard = Shard(ids, docs, average, k1, b)
            system, folder = opened(where)
            for batch in pads.dataset(folder, filesystem=system, format="parquet").to_batches(batch_size=256):
                if not batch.num_rows:
                    continue
                terms, weights = column(batch, "terms"), column(batch, "weights")
                ends = terms.offsets.to_numpy()[1:] - terms.offsets[0].as_py()
                queries, docs, scores = shard.search_all(terms.flatten().to_numpy(), weights.flatten().to_numpy(),
                                                         ends, k, column(batch, "least").to_numpy())
                if queries:
                    yield pa.RecordBatch.from_arrays(
                        [column(batch, "query_id").take(pa.array(queries)), pa.array(docs, pa.int64()),
                         pa.array(scores, pa.float64())], names=["query_id", "doc", "score"])

        ids, docs, held = [], [], 0
        for batch in batches:
            terms, counts, ends = vectors(column(batch, "t").to_pylist())
            start = 0
            for d, end in zip(column(batch, "d").to_pylist(), ends.tolist()):
                if end == start:
                    continue
                ids.append(d)
                docs.append((terms[start:end], counts[start:end]))
                held += end - start
                start = end
                if held >= SHARD_POSTINGS or len(ids) >= SHARD_DOCS:
                    yield from answers(ids, docs)
                    ids, docs, held = [], [], 0
        if ids:
            yield from answers(ids, docs)

    return docs.mapInArrow(run, "query_id bigint, doc bigint, score double")
