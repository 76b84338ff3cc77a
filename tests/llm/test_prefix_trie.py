"""The trie of conversation prefixes."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from stratawork.llm import prefix_trie
from stratawork.llm.queries import op13_prefix_trie
from tests.conftest import DATA

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, group=100, heads=5):
    """All prefixes as tuples."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, key), role, text))
    own = {c: tuple((r, t) for _, r, t in sorted(v)) for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (heads + 1)
        first = c - (c % group if c >= 0 else -(-c % group))
        built[c] = own.get(first, ())[:h] + turns[h:]
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    below = {p: [] for p in members}
    for p in members:
        if p:
            below[p[:-1]].append(p)

    def subtree(p):
        todo = [p]
        while todo:
            q = todo.pop()
            yield q
            todo += below[q]

    out = []
    for p, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == p)))
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(below[p]),
                    sum(not below[q] for q in subtree(p)),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in subtree(p) if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    got = prefix_trie.trie(df, **how)
    assert tuple(got.columns) == prefix_trie.RESULT
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def some(n, seed=1, words=3, longest=7):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "é\U0001f511", "abc"][:words + 1]))
            for c in range(n) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("turns", [1 << 19, 200, 17])
def test_equals_all_prefixes(spark, turns):
    check(spark, some(330), shard_turns=turns)


def test_copies_and_hot_prefixes_over_many_shards(spark):
    """Most conversations are one path, ids of one node come from many shards."""
    rows = [(c, t, "user", f"t{t}") for c in range(0, 900) for t in range(8)]
    rows += [(c, t, "user", "x" if t == 7 else f"t{t}") for c in range(1000, 1100) for t in range(8)]
    check(spark, rows, shard_turns=100)
    # Conversations without any rebuilt turn end at the root.
    check(spark, [(c, 0, "u", "t") for c in range(101, 199)], shard_turns=10)


def test_a_very_long_conversation(spark):
    rows = some(50) + [(100, t, "user", f"turn {t % 7}") for t in range(250)] + [(103, 0, "u", "a" * 300_000)]
    check(spark, rows, shard_turns=100)


def test_rows_of_any_kind(spark):
    rows = [(None, 0, "u", "lost"), (-5, 0, "u", "a"), (-5, None, "u", "b"), (-105, 1, None, None), (-100, 0, "u", "a"),
            (-200, 0, "u", "q"), (7, 1, "u", "same"), (7, 1, "u", "same"), (7, 1, "v", "same"), (0, 0, "u", "a"),
            (0, 1, "u", "b"), (0, 2, "a:", "b"), (1, 2, "a", ":b"), (200, 5, "", "")]
    check(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS size", "'x' AS path", "2 AS shard", "3 AS bone", "4 AS first", "conv_id AS depth", "'k' AS kind")
    assert sorted(map(tuple, prefix_trie.trie(df).collect()), key=str) == plain(rows)


def test_no_conversations(spark):
    for rows in ([], [(None, 0, "u", "t")]):
        out = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))
        assert out.count() == 0 and tuple(out.columns) == prefix_trie.RESULT


@given(st.lists(st.binary(min_size=2, max_size=2), max_size=9), st.lists(st.binary(min_size=2, max_size=2), max_size=9))
def test_common_turns(a, b):
    a, b = ([x * 8 for x in v] for v in (a, b))
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    assert prefix_trie.common(b"".join(a), b"".join(b)) == n


def test_splitters_are_short_and_divide():
    w = prefix_trie.WIDE
    paths = [(bytes([i // 10]) * w + bytes([i]) * w * 50, i) for i in range(100)] + [(b"\xff" * w, i) for i in range(100)]
    borders = prefix_trie.splitters(paths, 20)
    assert borders == sorted(set(borders)) and 15 <= len(borders) <= 19
    assert all(len(p) <= 2 * w for p, _ in borders)
    assert prefix_trie.splitters([], 5) == []


def test_query_equals_all_prefixes(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op13_prefix_trie(spark, DATA).collect()), key=str) == plain(rows)
