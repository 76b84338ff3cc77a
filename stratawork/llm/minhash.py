"""Near-duplicate documents: MinHash signatures in bands, sequential Bayesian
verification, exact check of the survivors.

1. A text's set of word shingles is hashed to 64 bits per shingle; equal sets (by
   a 128-bit digest) become one class, so copies cost nothing later on.
2. Classes whose signatures agree in a whole band share a bucket.
3. Candidates are compared by signature batches. After each batch the posterior
   probability that the similarity reaches the threshold (uniform prior) decides
   whether the pair is dropped; ``miss`` bounds it.
4. Survivors are confirmed on the full sets, read again from the texts.

Within a bucket no pairs are listed at first. Each class meets the class that
shares most buckets with others around it (a hub); confirmed links form
components, and then only classes of different components are left to compare:
with their bucket's hub first, then each with each. So a group of many
copies costs as many comparisons as it has members, and no link is left out that
could change a component. The last step compares, in blocks of bounded weight, what
is not in the component of its bucket's hub with the whole bucket: signatures first,
whole sets then, both in the task. Only links that join two components leave a block,
fewer than it has members; pairs are never listed.

Buckets are counted before they are joined, so a hot one is one row there, and the
other side is split by adaptive execution. Nothing is collected but counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, blocks_of, column, gathered
from .components import components

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Shingles hashed at a time: a block that stays in the processor's cache.
BLOCK = 16_384
#: Weight of a block's side, in shingles (4 MB), that of a signature, and pairs compared
#: at a time.
WEIGHT, SIGNATURE, PAIRS = 1 << 19, 60, 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words, A-Z lower-cased. A
    shorter text is one run; a text without words gives none."""
    found = (text or b"").lower().split()
    n = min(words, len(found))
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    m = len(found) - n + 1
    out = mixed(h[:m] + mixed(np.array([n], np.uint64)))
    for j in range(1, n):
        out = mixed(out * MIX[0] + h[j:j + m])
    return np.unique(out)


def multipliers(size: int) -> np.ndarray:
    return mixed(np.arange(1, size + 1, dtype=np.uint64) * MIX[0]) | np.uint64(1)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """MinHash values, one row per set that is not empty."""
    a = multipliers(size)
    out = np.full((len(sets), size), np.iinfo(np.uint64).max, np.uint64)
    ends = np.cumsum([len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    buffer = np.empty(BLOCK, np.uint64)
    for at in range(0, len(values), BLOCK):
        x = values[at:at + BLOCK]
        own = owner[at:at + BLOCK]
        first = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
        rows = own[first]
        y = buffer[:len(x)]
        low = np.empty((size, len(first)), np.uint64)
        for i in range(size):
            np.multiply(x, a[i], out=y)
            np.minimum.reduceat(y, first, out=low[i])
        out[rows] = np.minimum(out[rows], low.T)
    assert not len(ends) or ends[-1] == len(values)
    return (out >> np.uint64(32)).astype(np.uint32)


def least_matches(size: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """After how many values how many must agree: with fewer, the probability
    that the similarity reaches ``threshold`` is below ``miss``. With a uniform
    prior it is that of at most m successes in n + 1 draws at ``threshold``."""
    out = []
    for n in [*range(batch, size, batch), size]:
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _signed(docs: DataFrame, text: str, key: str, words: int, size: int) -> DataFrame:
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType),
                           *T.StructType.fromDDL("n bigint, digest binary, sig binary").fields])

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            keys, texts = column(batch, key), column(batch, text)
            for at in range(0, batch.num_rows, 500):
                sets = [shingles(t, words) for t in texts.slice(at, 500).to_pylist()]
                sig = signatures(sets, size)
                yield pa.RecordBatch.from_arrays([
                    keys.slice(at, 500), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                             pa.binary()),
                    pa.array([s.tobytes() for s in sig], pa.binary())],
                    names=schema.fieldNames())

    return docs.select(key, F.col(text).cast("binary").alias(text)).mapInArrow(run, schema)


def _banded(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """One row per class and band: bucket, class, set size."""
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint32)
            sig = sig.reshape(batch.num_rows, bands, rows).astype(np.uint64)
            h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * MIX[0], sig.shape[:2])
            for j in range(rows):
                h = mixed(h * MIX[0] + sig[:, :, j])
            who = np.repeat(np.arange(batch.num_rows), bands)
            yield pa.RecordBatch.from_arrays([
                pa.array(h.reshape(-1).view(np.int64)), column(batch, "id").take(pa.array(who)),
                column(batch, "n").take(pa.array(who))], names=["bucket", "id", "n"])

    return classes.select("id", "n", "sig").mapInArrow(run, "bucket bigint, id bigint, n bigint")


def _pruned(pairs: DataFrame, sigs: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Pairs that no batch of signature values rules out."""
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint32)
                           .reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            alive, agree, seen = np.arange(batch.num_rows), 0, 0
            for n, least in steps:
                agree = agree + (left[alive, seen:n] == right[alive, seen:n]).sum(axis=1)
                keep = agree >= least
                alive, agree, seen = alive[keep], agree[keep], n
            at = pa.array(alive)
            yield pa.RecordBatch.from_arrays([column(batch, c).take(at) for c in ("a", "b")],
                                             names=["a", "b"])

    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(
        sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint").distinct()


class Sets:
    """Shingle sets of a block's members, with their members by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(x) for x in sets])
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.holders = owner[order]
        values = values[order]
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        ends = np.append(starts[1:], len(values))
        place = np.empty(len(values), np.int64)
        place[order] = np.repeat(np.arange(len(starts)), ends - starts)
        self.starts, self.counts = starts, ends - starts
        self.places = np.split(place, np.cumsum(self.sizes)[:-1])

    def common(self, a: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one set with others: few are merged, many
        counted along the lists of its shingles."""
        if len(others) < 4:
            return np.array([len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True)) for b in others])
        out = np.zeros(len(self.sets), np.int64)
        for at in range(0, len(self.places[a]), 4096):
            mine = self.places[a][at:at + 4096]
            n = self.counts[mine]
            first = self.starts[mine] - np.concatenate([[0], np.cumsum(n)[:-1]])
            out += np.bincount(self.holders[np.repeat(first, n) + np.arange(n.sum())], minlength=len(out))
        return out[others]


def linking(ids: np.ndarray, n: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray,
            sig: np.ndarray, sets: Callable[[], Sets], steps: list[tuple[int, int]],
            percent: int) -> list[tuple[int, int]]:
    """Links of a block that join its components: a left and a right member each, of
    different components, alike by all batches of their signatures and by their whole
    sets. What is joined already is not compared again, so there are fewer links than
    components."""
    out: list[tuple[int, int]] = []
    held = None
    lefts, rights = np.flatnonzero(left), np.flatnonzero(right)
    height = max(1, PAIRS // max(1, len(rights)))
    for at in range(0, len(lefts), height):
        a, b = (x.ravel() for x in np.meshgrid(lefts[at:at + height], rights, indexing="ij"))
        twice = left[b] & right[a] & (ids[a] > ids[b])  # the block has the pair the other way round
        keep = (comp[a] != comp[b]) & ~twice & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b, agree, seen = a[keep], b[keep], 0, 0
        for upto, least in steps:
            agree = agree + (sig[a, seen:upto] == sig[b, seen:upto]).sum(axis=1)
            keep = agree >= least
            a, b, agree, seen = a[keep], b[keep], agree[keep], upto
        cuts = np.flatnonzero(np.diff(a)) + 1
        for who, others in zip(a[np.concatenate([[0], cuts])] if len(a) else (), np.split(b, cuts)):
            others = others[comp[others] != comp[who]]
            if not len(others):
                continue
            held = held or sets()
            common = held.common(who, others)
            alike = others[100 * common >= percent * (held.sizes[who] + held.sizes[others] - common)]
            for other in alike:
                if comp[other] != comp[who]:
                    out.append((int(ids[who]), int(ids[other])))
                    comp[comp == comp[other]] = comp[who]
    return out


def _linked(blocks: DataFrame, steps: list[tuple[int, int]], percent: int) -> DataFrame:
    """The links (a, b) that join components in each block; rows of a block stand
    together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in blocks_of(batches, ("bucket", "i", "j")):
            ids, n, comp = (rows[c].to_numpy().copy() for c in ("id", "n", "comp"))
            left, right = (rows[c].to_numpy().astype(bool) for c in ("left", "right"))
            sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint32).reshape(len(ids), -1)
            found = linking(ids, n, comp, left, right, sig, lambda: Sets(
                [np.frombuffer(x.as_buffer(), np.int64) for x in rows["s"]]), steps, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return blocks.mapInArrow(run, "a bigint, b bigint")


def _alike(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets x and y are similar."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(column(batch, "x"), column(batch, "y"))):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    good.append(i)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, c).take(at) for c in ("a", "b")], names=["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, text: str, key: str, words: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([
                    column(part, key),
                    pa.array([shingles(t, words).tobytes() for t in column(part, text).to_pylist()], pa.binary())],
                    names=["id", "s"])

    return docs.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("binary").alias(text)).mapInArrow(
        run, "id bigint, s binary")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5,
                    percent: int = 80, bands: int = 24, rows: int = 5, miss: float = 1e-5,
                    batch: int = 20) -> DataFrame:
    """Per row of ``docs``: the key, ``n_shingles``, ``component_id`` (the smallest
    key reachable by links, the row's own included) and ``kept`` (it is its own
    component's smallest). Two texts are linked if their intersection is at least
    ``percent`` of their union; texts without words are linked with nothing.

    A pair of similarity s shares no bucket with probability
    (1 - s ** rows) ** bands, 7e-5 at 0.8 as set; a batch drops a pair that
    belongs together with probability of about ``miss``. No other pair is lost.
    Keys are whole numbers. Rows that repeat a key are each judged by their own
    text. A row without key is linked with nothing: its component is null and it is
    kept. An empty table gives no rows; other columns are not kept."""
    size = bands * rows
    work = Workspace(docs.sparkSession)
    steps = least_matches(size, batch, percent / 100, miss)
    signed = work.table(_signed(docs, text, key, words, size))
    total = signed.count()  # no table of classes has more rows

    known = signed.where(F.col(key).isNotNull() & F.col("digest").isNotNull())
    classes = work.table(gathered(known.groupBy("digest").agg(F.min(F.col(key).cast("bigint")).alias("id")), total))
    firsts = known.select(F.col(key).cast("bigint").alias("id"), "n", "digest", "sig")
    # A signature weighs as much as some ten narrow rows.
    reps = work.table(gathered(firsts.join(classes, ["digest", "id"]).dropDuplicates(["digest", "id"])
                               .select("id", "n", "sig"), 10 * total))

    banded = _banded(reps, bands, rows)
    shared = banded.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    members = work.table(gathered(banded.join(shared, "bucket"), bands * total))
    weight = members.groupBy("id").agg(F.sum("c").alias("w"))
    members_w = work.table(gathered(members.join(weight, "id").select("bucket", "id", "n", "w"), bands * total))
    work.drop(members)
    # The hub of a bucket: the class with most company over all its buckets.
    hubs = members_w.groupBy("bucket").agg(F.max(F.struct("w", (-F.col("id")).alias("h"), "n")).alias("hub"))
    near = (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")) & (F.col("id") != -F.col("hub.h"))
    with_hub = members_w.join(hubs, "bucket").where(near)

    # Written, so that its size is known: while it is small, the texts are not shuffled.
    ids = work.table(gathered(members_w.select("id").distinct(), total))
    wanted = docs.join(ids, docs[key].cast("bigint") == ids["id"], "left_semi")
    sets = work.table(_sets(wanted, text, key, words))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs of a member and a hub, at most one per member and bucket, on their
        signatures and then on their sets."""
        alive = work.table(gathered(_pruned(pairs, reps, steps), bands * total))
        full = alive.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
        return _alike(full.select("a", "b", "x", "y"), percent)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # First each class with its best hub only.
    best = with_hub.groupBy("id").agg(F.max("hub").alias("hub"))
    tried = work.table(gathered(ordered(best.select(F.col("id").alias("a"), (-F.col("hub.h")).alias("b"))), total))
    groups = work.table(gathered(components(work, work.table(confirmed(tried))), total))

    def placed() -> tuple[DataFrame, DataFrame]:
        """Members with components, and the hubs of buckets that hold several."""
        members = members_w.join(groups, members_w["id"] == groups["node"], "left").select(
            "bucket", "id", "n", "w", F.coalesce("component", "id").alias("comp"))
        hub = F.max(F.struct("w", (-F.col("id")).alias("h"), "n", "comp")).alias("hub")
        split = members.groupBy("bucket").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), hub)
        return members, split.where("lo != hi").select(
            "bucket", "c", (-F.col("hub.h")).alias("hub"), F.col("hub.n").alias("hub_n"),
            F.col("hub.comp").alias("hub_comp"))

    def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
        """Components after these links."""
        found = work.table(links)
        if found.isEmpty():
            return groups
        between = found.join(groups.toDF("a", "ca"), "a", "left").join(
            groups.toDF("b", "cb"), "b", "left").select(
            F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = components(work, between).toDF("component", "joined")
        alone = between.select("a").union(between.select("b")).distinct().select(
            F.col("a").alias("node"), F.col("a").alias("component")).join(
            groups.select("node"), "node", "left_anti")
        return work.table(gathered(groups.union(alone).join(merged, "component", "left").select(
            "node", F.coalesce("joined", "component").alias("component")), total))

    # Then, where a bucket still holds several components: its members with its hub.
    members, split = placed()
    apart = members.join(split, "bucket").where(F.col("comp") != F.col("hub_comp"))
    close = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    pairs = ordered(apart.where(close).select(F.col("id").alias("a"), F.col("hub").alias("b")))
    groups = joined(groups, confirmed(work.table(gathered(pairs.join(tried, ["a", "b"], "left_anti"), bands * total))))

    # At last all that is outside the hub's component with all of the bucket, in blocks
    # of a bounded weight: sets and signatures. Each cell of a row of parts meets each of
    # a column of parts; a member stands once in a block, on one side or both.
    members, split = placed()
    open_ = work.table(gathered(members.join(split, "bucket").select(
        "bucket", "id", "n", "comp", (F.col("comp") != F.col("hub_comp")).alias("apart")), bands * total))
    weight = F.col("n") + SIGNATURE
    parts = open_.groupBy("bucket").agg(
        F.ceil(F.sum(weight) / WEIGHT).alias("many"), F.ceil(F.sum(F.when(F.col("apart"), weight)) / WEIGHT).alias("few"))
    spot = F.xxhash64("id")
    sides = open_.join(parts.where("few > 0"), "bucket").withColumn(
        "row", F.pmod(spot, F.col("few"))).withColumn("col", F.pmod(spot, F.col("many")))

    def cell(i: Column, j: Column, left: Column, right: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))

    def steps_to(n: str) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)

    yes, no = F.lit(True), F.lit(False)
    across = F.transform(steps_to("many"), lambda j: cell(F.col("row"), j, yes, j == F.col("col")))
    down = F.transform(F.filter(steps_to("few"), lambda i: ~F.col("apart") | (i != F.col("row"))),
                       lambda i: cell(i, F.col("col"), no, yes))
    cells = F.when(F.col("apart"), F.concat(across, down)).otherwise(down)
    blocks = sides.select("bucket", "id", "n", "comp", F.inline(cells)).join(
        reps.select("id", "sig"), "id").join(sets, "id").repartition(
        "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    groups = joined(groups, _linked(blocks, steps, percent))
    for table in (members_w, sets, reps, tried, open_):
        work.drop(table)

    named = signed.withColumn("digest", F.when(F.col(key).isNotNull(), F.col("digest")))
    named = named.join(classes, "digest", "left").select(
        key, F.col("n").alias("n_shingles"), F.col("id").alias("node"))
    out = named.join(groups, "node", "left").select(
        key, "n_shingles",
        F.coalesce("component", "node", F.col(key).cast("bigint")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


#: Two-word shingles at 80 percent, all pairs, in DuckDB's SQL.
ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, low AS component_id, low = doc_id AS kept FROM s JOIN low ON doc_id = a"""
