import pytest

from stratawork.sources.versions import Store
from stratawork.streaming import deliveries


@pytest.fixture
def deliver(spark, tmp_path):
    """Files of one delivery as a stream of one file per micro-batch."""
    count = iter(range(100))

    def make(schema, *batches):
        path = tmp_path / f"delivery{next(count)}"
        path.mkdir()
        for data in batches:
            spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(path))
        parsed = spark.createDataFrame([], schema).schema
        return deliveries.chunks(spark, str(path), parsed, files_per_batch=1)
    return make


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture
def at(tmp_path):
    return lambda name: (str(tmp_path / f"{name}-staging"), str(tmp_path / f"{name}-state"))


def test_append(deliver, store, at, rows):
    stream = deliver("k bigint, v string", [(1, "a")], [(2, "b"), (3, None)])
    done = deliveries.stream_append(store, "d", stream, *at("one"), {"day": 1})
    assert done.n_rows == 3
    assert rows(store.read("d")) == [(1, "a"), (2, "b"), (3, None)]
    # the same delivery again adds nothing
    assert deliveries.stream_append(store, "d", stream, *at("one"), {"day": 1}).skipped


def test_a_repeated_batch_leaves_no_duplicates(deliver, at, tmp_path, rows):
    stream = deliver("k bigint", [(1,)], [(2,)])
    staging, _ = at("x")
    assert deliveries.land(stream, staging, str(tmp_path / "state1")).count() == 2
    # a lost checkpoint replays all batches into the same staging folder
    assert rows(deliveries.land(stream, staging, str(tmp_path / "state2"))) == [(1,), (2,)]


def test_empty_delivery(spark, store, at, tmp_path):
    (tmp_path / "empty").mkdir()
    stream = deliveries.chunks(spark, str(tmp_path / "empty"), "k bigint")
    assert deliveries.stream_append(store, "d", stream, *at("e")).n_rows == 0


def test_upsert_equals_batch(deliver, store, at, rows):
    schema = "id bigint, name string, n bigint"
    one = deliver(schema, [(1, "A", 1)], [(1, "A2", 2), (2, "B", 1)])
    deliveries.stream_upsert(store, "d", one, "id", *at("one"), "day 1", "n")
    assert rows(store.read("d"), "id", "name") == [(1, "A2"), (2, "B")]
    two = deliver(schema, [(2, "B2", 1)], [(3, "C", 1)])
    first = deliveries.stream_upsert(store, "d", two, "id", *at("two"), "day 2", "n")
    again = deliveries.stream_upsert(store, "d", two, "id", *at("two"), "day 2", "n")
    assert again.skipped and again.version == first.version
    assert rows(store.read("d"), "id", "name") == [(1, "A2"), (2, "B2"), (3, "C")]
    assert store.upstream("d", first.version).count() == 1


def test_accumulate(deliver, store, at, rows):
    for day, ids in (("06-18", [1]), ("06-19", [2, 3])):
        stream = deliver("order bigint", *[[(i,)] for i in ids])
        deliveries.stream_accumulate(store, "d", stream, "date", day, *at(day), day)
    again = deliver("order bigint", [(9,)], [(8,)])
    deliveries.stream_accumulate(store, "d", again, "date", "06-18", *at("again"), "06-18 again")
    assert rows(store.read("d"), "date", "order") == [
        ("06-18", 8), ("06-18", 9), ("06-19", 2), ("06-19", 3)]


def test_accumulate_in_place(deliver, at, tmp_path, rows):
    table = str(tmp_path / "table")

    def run(name, day, *batches, schema="order bigint"):
        return deliveries.stream_accumulate_in_place(
            deliver(schema, *batches), table, "date", day, *at(name))
    run("a", "2026-06-18", [(1,)], [(2,)])
    run("b", "2026-06-19", [(3,)])
    untouched = sorted((tmp_path / "table" / "date=2026-06-19").iterdir())
    out = run("c", "2026-06-18", [(1,)], [(9,)])
    assert rows(out, "date", "order") == [("2026-06-18", 1), ("2026-06-18", 9), ("2026-06-19", 3)]
    assert sorted((tmp_path / "table" / "date=2026-06-19").iterdir()) == untouched
    with pytest.raises(ValueError):
        run("d", "2026-06-20", [(1, "2026-06-20"), (2, None)], schema="order bigint, date string")
    assert run("e", "2026-06-18").count() == 1  # an empty delivery clears its day
    with pytest.raises(ValueError):
        run("f", None, [(1,)])
