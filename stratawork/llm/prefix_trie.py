"""The trie of conversation prefixes, by a splitter skeleton.

A conversation becomes one row: the 128-bit digests of its turns in order, its path, and
the turns' sizes. Sorted paths put every subtree in one run. A bounded sample of paths
gives splitters, which deal the sorted conversations into shards; copies of one path are
split by their ids. Only a node on a splitter's path may have members in several shards:
these nodes, the skeleton, are broadcast, and their number is bounded by the shards.

A shard reads its conversations in order with a stack of open nodes, finishes every node
off the skeleton, and adds up what it has of the skeleton's nodes. These partial sums are
reduced in Spark; the driver adds them up along the skeleton, which it made itself. So a
node that holds a third of all conversations is no group anywhere: each shard gives one
row for it, and the ids that end in it in pieces of bounded size, in order, of which one
task feeds the digest as a stream.

Memory: a shard holds about 150 bytes a node, and its share of the turns is bounded
(``SHARD_TURNS``, and the longest conversation); a conversation takes 20 bytes a turn,
never its texts.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, blocks_of, column, sampled

#: Bytes of a turn's digest.
WIDE = 16
#: Turns a shard aims at; sampled conversations per shard.
SHARD_TURNS, OVER = 1 << 19, 8
#: Bytes of ids in a piece that leaves a shard for a skeleton node.
PIECE = 1 << 16
#: Conversations of a batch.
ROWS = 512
LEAST = -(1 << 63)
NOTHING = hashlib.sha256(b"").hexdigest()
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
Splitter = tuple[bytes, int]


def paths(conversations: DataFrame, group: int, heads: int) -> DataFrame:
    """One row (conv_id, path, sizes) per conversation c, rebuilt: the first
    h = crc32(c) % (heads + 1) turns of conversation c - c % group, then its own turns
    after its first h. One shuffle of digests by c - c % group; no texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)  # no two turns alike
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - F.col("conv_id") % group).alias("first"), "conv_id", "turn",
        F.unhex(F.substring(F.sha2(turn.cast("binary"), 256), 1, 2 * WIDE)).alias("digest"),
        F.length(text).alias("size"))
    dealt = rows.repartition("first").sortWithinPartitions(
        "first", F.col("conv_id") != F.col("first"), "conv_id", F.col("turn").asc_nulls_first(), "digest")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, ids, sizes, of = b"", [], np.zeros(0, "<i4"), None
        held: list[tuple[int, bytes, bytes]] = []
        for (first, conv), own in blocks_of(batches, ("first", "conv_id")):
            path = b"".join(own.column("digest").to_pylist())
            size = own.column("size").to_numpy().astype("<i4")
            if first != of:
                there = conv == first
                head, sizes, of = (path[:heads * WIDE] if there else b""), (size[:heads] if there else size[:0]), first
            h = zlib.crc32(str(conv).encode()) % (heads + 1)
            held.append((conv, head[:h * WIDE] + path[h * WIDE:], np.concatenate([sizes[:h], size[h:]]).tobytes()))
            if len(held) == ROWS:
                yield _rows(held)
                held = []
        if held:
            yield _rows(held)

    return dealt.mapInArrow(run, "conv_id long, path binary, sizes binary")


def _rows(held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    conv, path, size = zip(*held)
    return pa.RecordBatch.from_pydict({"conv_id": pa.array(conv, pa.int64()), "path": pa.array(path, pa.binary()),
                                       "sizes": pa.array(size, pa.binary())})


def common(a: bytes, b: bytes) -> int:
    """Number of turns at the start that two paths share."""
    n = min(len(a), len(b)) // WIDE
    if a[:n * WIDE] == b[:n * WIDE]:
        return n
    low, high = 0, n - 1  # the first difference lies in turn low to high
    while low < high:
        middle = (low + high) // 2
        if a[low * WIDE:(middle + 1) * WIDE] == b[low * WIDE:(middle + 1) * WIDE]:
            low = middle + 1
        else:
            high = middle
    return low


def splitters(sample: list[Splitter], shards: int) -> list[Splitter]:
    """At most ``shards`` - 1 borders between sorted conversations, each the shortest
    path that still divides its neighbours in the sample; the id counts between copies."""
    sample, out = sorted(sample), []
    for i in sorted({len(sample) * s // shards for s in range(1, shards)} - {0}):
        (before, _), (path, conv) = sample[i - 1], sample[i]
        cut = path[:(common(before, path) + 1) * WIDE]
        border = (path, conv) if before == path else (cut, LEAST)
        if not out or border > out[-1]:
            out.append(border)
    return out


class Skeleton:
    """The trie of the splitters' paths: nodes by number, 0 is the root."""

    def __init__(self, borders: list[Splitter]):
        self.borders = borders
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path, _ in borders:
            at = 0
            for i in range(0, len(path), WIDE):
                key = (at, path[i:i + WIDE])
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                at = self.child[key]


class Shard:
    """Nodes of conversations that come sorted by path and id."""

    def __init__(self, skeleton: Skeleton, number: int):
        self.skeleton, self.number = skeleton, number
        # Finished and open nodes: parent's place, or less than 0 for a skeleton node.
        self.parent, self.conv, self.depth = array("q"), array("q"), array("q")
        self.convs, self.children, self.leaves, self.saved = array("q"), array("q"), array("q"), array("q")
        self.ends: list[str] = []
        self.partial: list[tuple] = []
        self.pieces: list[tuple[int, int, str]] = []
        self.path, self.open = b"", []
        self._push(0, 0)

    def _push(self, size: int, bone: int | None) -> None:
        """Open a node: bone is its number in the skeleton, or None."""
        place = None
        if bone is None:
            place = len(self.conv)
            above = self.open[-1]
            self.parent.append(-1 - above["bone"] if above["bone"] is not None else above["place"])
            for a in (self.conv, self.depth, self.convs, self.children, self.leaves, self.saved):
                a.append(0)
            self.ends.append(NOTHING)
        self.open.append({"bone": bone, "place": place, "size": size, "convs": 0, "conv": None, "children": 0,
                          "leaves": 0, "saved": 0, "ends": None, "bytes": 0})

    def _pop(self) -> None:
        node = self.open.pop()
        if node["bone"] is not None:
            self._piece(node)
            self.partial.append((node["bone"], node["convs"], node["conv"], node["children"], node["leaves"],
                                 node["saved"], node["size"]))
            return
        at, depth = node["place"], len(self.open)
        leaves = node["leaves"] or 1
        saved = node["saved"] + (node["convs"] - 1) * node["size"]
        self.conv[at], self.depth[at], self.convs[at] = node["conv"], depth, node["convs"]
        self.children[at], self.leaves[at], self.saved[at] = node["children"], leaves, saved
        if node["ends"]:
            self.ends[at] = node["ends"].hexdigest()
        above = self.open[-1]
        above["children"] += 1
        above["convs"] += node["convs"]
        above["leaves"] += leaves
        above["saved"] += saved
        if above["conv"] is None or node["conv"] < above["conv"]:
            above["conv"] = node["conv"]

    def _piece(self, node: dict) -> None:
        if node["ends"]:
            self.pieces.append((node["bone"], len(self.pieces), ",".join(node["ends"])))
            node["ends"], node["bytes"] = None, 0

    def add(self, conv: int, path: bytes, sizes: np.ndarray) -> None:
        same = common(self.path, path)
        while len(self.open) > same + 1:
            self._pop()
        for i in range(same, len(path) // WIDE):
            above = self.open[-1]["bone"]
            bone = None if above is None else self.skeleton.child.get((above, path[i * WIDE:(i + 1) * WIDE]))
            self._push(int(sizes[i]), bone)
        self.path, node = path, self.open[-1]
        node["convs"] += 1
        if node["conv"] is None or conv < node["conv"]:
            node["conv"] = conv
        text = str(conv)
        if node["bone"] is None:
            if node["ends"] is None:
                node["ends"] = hashlib.sha256(text.encode())
            else:
                node["ends"].update(b"," + text.encode())
        else:
            node["ends"] = node["ends"] or []
            node["ends"].append(text)
            node["bytes"] += len(text) + 1
            if node["bytes"] > PIECE:
                self._piece(node)

    def finish(self) -> Iterator[pa.RecordBatch]:
        while self.open:
            self._pop()
        parent, conv = np.frombuffer(self.parent, np.int64), np.frombuffer(self.conv, np.int64)
        n = len(conv)
        longs = [np.frombuffer(a, np.int64) if n else np.zeros(0, np.int64)
                 for a in (self.depth, self.convs, self.children, self.leaves, self.saved)]
        for at in range(0, n, 10_000):
            part = slice(at, at + 10_000)
            own = parent[part] >= 0
            yield _batch(kind=["node"] * len(own), bone=pa.array(-1 - parent[part], mask=own),
                         conv_id=conv[part], parent_conv_id=pa.array(conv[np.maximum(parent[part], 0)], mask=~own),
                         depth=longs[0][part], n_convs=longs[1][part], n_children=longs[2][part],
                         n_leaves=longs[3][part], saved_tokens=longs[4][part], text=self.ends[at:at + 10_000])
        if self.partial:
            bone, convs, conv, children, leaves, saved, size = zip(*self.partial)
            yield _batch(kind=["partial"] * len(bone), bone=bone, conv_id=conv, n_convs=convs, n_children=children,
                         n_leaves=leaves, saved_tokens=saved, size=size)
        for at in range(0, len(self.pieces), 64):
            bone, i, text = zip(*self.pieces[at:at + 64])
            yield _batch(kind=["ends"] * len(bone), bone=bone, shard=[self.number] * len(bone), piece=i, text=text)


FIELDS = ("bone", "conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "size",
          "shard", "piece")


def _batch(kind: list[str], text: Iterable[str] | None = None, **longs) -> pa.RecordBatch:
    n = len(kind)
    return pa.RecordBatch.from_pydict({
        "kind": pa.array(kind), "text": pa.array(text if text is not None else [None] * n, pa.string()),
        **{f: pa.array(longs[f] if f in longs else [None] * n, pa.int64()) for f in FIELDS}})


def _digests(pieces: DataFrame) -> DataFrame:
    """Digest of the ids that end in each skeleton node, read in order as a stream."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            for bone, text in zip(column(b, "bone").to_pylist(), column(b, "text")):
                if bone != last:
                    if state:
                        yield pa.RecordBatch.from_pydict({"bone": [last], "ends": [state.hexdigest()]})
                    last, state = bone, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_buffer())
        if state:
            yield pa.RecordBatch.from_pydict({"bone": [last], "ends": [state.hexdigest()]})

    dealt = pieces.select("bone", "shard", "piece", "text").repartition("bone").sortWithinPartitions("bone", "shard", "piece")
    return dealt.mapInArrow(run, "bone long, ends string")


def _joined(skeleton: Skeleton, partial: list, ends: dict[int, str]) -> list[tuple]:
    """Rows of the skeleton's nodes: partial sums added up from the leaves on."""
    found = {r["bone"]: r.asDict() for r in partial}
    conv = {b: r["conv_id"] for b, r in found.items()}
    out = {}
    # A child has a larger number than its parent.
    for b in sorted(found, reverse=True):
        r = found[b]
        r["n_leaves"] = r["n_leaves"] or 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["size"]
        up = skeleton.parent[b]
        if up >= 0:
            above = found[up]
            above["n_children"] += 1
            for c in ("n_convs", "n_leaves", "saved_tokens"):
                above[c] += r[c]
            if above["conv_id"] is None or r["conv_id"] < above["conv_id"]:
                above["conv_id"] = conv[up] = r["conv_id"]
        out[b] = r
    return [(b, r["conv_id"], skeleton.depth[b], conv[skeleton.parent[b]] if b else None, r["n_convs"], r["n_children"],
             r["n_leaves"], r["saved_tokens"], ends.get(b, NOTHING)) for b, r in out.items()]


def trie(conversations: DataFrame, group: int = 100, heads: int = 5, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations (see ``paths``):
    ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id`` (null at the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree, members
    less one times the code points of the last text) and ``ends_sha256`` (of the ids that
    end here, ascending, joined by commas).

    Turns stand by ``turn``, null first, those of equal ``turn`` by the digest of role and
    text; repeated rows are turns like others. Null role or text is empty. Rows without
    conv_id are left out; without any conversation there is no root. Columns other than
    conv_id, turn, role and text are not read."""
    spark = conversations.sparkSession
    work = Workspace(spark)
    convs = work.table(paths(conversations, group, heads))
    n, turns = convs.agg(F.count("*"), F.coalesce(F.sum(F.length("path")), F.lit(0)) / WIDE).first()
    least = min(spark.sparkContext.defaultParallelism, n // 1000)
    shards = max(1, least, -(-int(turns) // shard_turns))
    share = min(1.0, OVER * shards / max(1, n))
    sample = convs.where(sampled("conv_id", share)).select("path", "conv_id").collect() if shards > 1 else []
    skeleton = Skeleton(splitters([(bytes(r["path"]), r["conv_id"]) for r in sample], shards))
    shared = spark.sparkContext.broadcast(skeleton)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = shared.value.borders
        for b in batches:
            at = [bisect_right(borders, key) for key in zip(column(b, "path").to_pylist(), column(b, "conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "shard"])

    def grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            for number, conv, path, sizes in zip(*(column(b, c).to_pylist() for c in ("shard", "conv_id", "path", "sizes"))):
                if shard is None or number != shard.number:
                    if shard:
                        yield from shard.finish()
                    shard = Shard(shared.value, number)
                shard.add(conv, path, np.frombuffer(sizes, "<i4"))
        if shard:
            yield from shard.finish()

    dealt = convs.mapInArrow(deal, "conv_id long, path binary, sizes binary, shard long")
    sorted_ = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    made = work.table(sorted_.mapInArrow(grow, "kind string, text string, " + ", ".join(f"{f} long" for f in FIELDS)))
    sums = made.where("kind = 'partial'").groupBy("bone").agg(
        F.min("conv_id").alias("conv_id"), F.max("size").alias("size"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    ends = {r["bone"]: r["ends"] for r in _digests(made.where("kind = 'ends'")).collect()}  # one row a skeleton node
    bones = spark.createDataFrame(
        _joined(skeleton, sums.collect(), ends),
        "bone long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
    # As large as the skeleton, which has been broadcast already.
    above = F.broadcast(bones.select("bone", F.col("conv_id").alias("above")))
    nodes = made.where("kind = 'node'").withColumnRenamed("text", "ends_sha256").join(above, "bone", "left")
    return nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*RESULT).union(bones.select(*RESULT))


#: The query in DuckDB's SQL; CRC-32 is written out bit by bit.
ORACLE = """WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS p FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda x, _: xor(x >> 1, 3988292384 * (x & 1))), 4294967295), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM o)),
b AS (SELECT h.c, g, length(t) AS size, 0 AS own, p FROM h JOIN o ON o.c = h.c - h.c % 100 AND p <= h
    UNION ALL SELECT h.c, g, length(t), 1, p FROM h JOIN o ON o.c = h.c AND p > h),
x AS (SELECT c, size, row_number() OVER w AS d, sha256(string_agg(g, '') OVER w) AS k FROM b
    WINDOW w AS (PARTITION BY c ORDER BY own, p ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), '') AS up FROM x
    UNION ALL SELECT c, 0, 0, '', NULL FROM h),
e AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS last FROM n),
g AS (SELECT k, any_value(up) AS up, min(c) AS c, d, count(*) AS n, (count(*) - 1) * any_value(size) AS saved,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends FROM e GROUP BY k, d),
s AS (SELECT a.k, count(*) FILTER (NOT EXISTS (SELECT 1 FROM g y WHERE y.up = g.k)) AS leaves, sum(saved) AS saved
    FROM (SELECT DISTINCT a.k, b.k AS below FROM n a JOIN n b ON a.c = b.c AND a.d <= b.d) a JOIN g ON g.k = a.below GROUP BY a.k)
SELECT g.c AS conv_id, g.d AS depth, p.c AS parent_conv_id, g.n AS n_convs,
    (SELECT count(*) FROM g y WHERE y.up = g.k) AS n_children, s.leaves AS n_leaves,
    CAST(s.saved AS BIGINT) AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN s USING (k) LEFT JOIN g p ON p.k = g.up"""
