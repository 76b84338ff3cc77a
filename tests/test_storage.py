from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from stratawork.operators import quality
from stratawork.operators.quality import Expectation
from stratawork.sources import files, jdbc, landed, lineage, schemas, slices
from stratawork.sources.versions import Store

# -- files ------------------------------------------------------------------


@pytest.mark.parametrize("fmt", files.FORMATS)
def test_round_trip(spark, rows, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a,\"b", 1.5), (2, None, None), (3, "x y", -2.0)],
                               "k bigint, s string, d double")
    path = str(tmp_path / "out")
    files.sink(df, path, fmt)
    assert rows(files.scan(spark, path, fmt, schema=df.schema)) == rows(df)
    inferred = files.scan(spark, path, fmt)
    assert set(inferred.columns) == set(df.columns) and inferred.count() == 3
    with pytest.raises(Exception):
        files.sink(df, path, fmt)


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        files.scan(spark, "x", "xlsx")


def test_partitioned_sink_writes_few_files(spark, tmp_path):
    df = spark.range(0, 400, 1, 8).withColumn("d", F.col("id") % 3)
    files.sink(df, str(tmp_path / "t"), partition_by=["d"])
    assert all(len(list(p.glob("*.parquet"))) <= 2 for p in (tmp_path / "t").glob("d=*"))


def test_jdbc_options():
    got = jdbc.table_options("jdbc:x", "t", "s", "id", 0, 100, 8, fetchsize=1000)
    assert got == {"url": "jdbc:x", "dbtable": "s.t", "partitionColumn": "id", "lowerBound": "0",
                   "upperBound": "100", "numPartitions": "8", "fetchsize": "1000"}
    with pytest.raises(ValueError):
        jdbc.table_options("jdbc:x", "t", partition_column="id")


def test_preview(spark):
    df = spark.createDataFrame([(2, float("inf")), (1, float("nan")), (3, 0.5)], "k int, x double")
    assert [tuple(r) for r in slices.preview(df, "k", 2, 1).collect()] == [(2, None), (3, 0.5)]


def test_checksum(spark):
    def of(df):
        return slices.content_checksum(df).first().checksum
    df = spark.range(50).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    assert of(df) == of(df.repartition(5).select("b", "a"))
    others = [df.union(df.limit(1)), df.union(df), df.where("a > 0"),
              df.withColumn("b", F.lit(None).cast("bigint")), df.toDF("b", "a")]
    assert len({of(d) for d in [df, *others]}) == 6


# -- landed data ------------------------------------------------------------


@pytest.mark.parametrize("body, key, n", [
    ('[{"a": 1}, {"a": 2}]', None, 2), ('{"data": [{"a": 1}]}', None, 1),
    ('{"results": [1, 2], "items": [3]}', None, 2), ('{"data": {"a": 1}, "rows": [1]}', None, 1),
    ('{"mine": [1, 2, 3], "data": [4]}', "mine", 3), ('{"mine": null, "data": [4]}', "mine", 0),
    ('{"data": [4]}', "mine", 1), ('{"n": 1, "things": [1, 2]}', None, 2),
    ('{"a": [1], "b": [2]}', None, 0), ('{"text": "[1, 2]"}', None, 0), ('5', None, 0),
    ('{"it\'s": [1, 2]}', "it's", 2), ('{"a.b": [1], "c": [2]}', "a.b", 1), ('not json', None, 0), (None, None, 0), ('{"data": []}', None, 0)])
def test_records_of_a_body(spark, body, key, n):
    df = spark.createDataFrame([(7, body)], "page int, body string")
    out = landed.pages_to_rows(df, "body", key)
    assert out.count() == n and out.columns == ["page", "record"]


def test_records_as_structs(spark, rows):
    df = spark.createDataFrame([('{"items": [{"a": 1, "b": {"c": "x"}}, {"a": null}]}',)], ["body"])
    out = landed.pages_to_rows(df, "body", schema="a int, b struct<c: string>")
    assert rows(out, "record.a", "record.b.c") == [(1, "x"), (None, None)]


def test_flatten(spark):
    text = '{"id": 1, "u": {"n": "x", "g": {"lat": 1.5}}, "t": ["a", null, "b"], "e": [], ' \
           '"ok": [true, false], "parts": [{"k": 1}], "none": null}'
    df = spark.createDataFrame([(text,), ('{"id": 2, "parts": []}',)], ["body"])
    schema = "id int, u struct<n: string, g: struct<lat: double>>, t array<string>, " \
             "e array<string>, ok array<boolean>, parts array<struct<k: int>>, none string"
    out = landed.flatten_json(df, "body", schema)
    assert out.columns == ["id", "u_n", "u_g_lat", "t", "e", "ok", "parts", "none"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [
        (1, "x", 1.5, "a, None, b", "", "True, False", '[{"k":1}]', None),
        (2, None, None, None, None, None, "", None)]


def test_clean_sheet(spark, rows):
    one = spark.createDataFrame([("a", "1", "x"), (None, "2", "y"), ("b", "?", "NaN")],
                                "name string, n string, note string")
    two = spark.createDataFrame([("c", "3.5")], "name string, n string")
    out = landed.clean_sheet({"one": one, "two": two}, key_column="name")
    assert rows(out, "sheet", "name", "n", "note") == [
        ("one", "a", 1.0, "x"), ("one", "b", None, "NaN"), ("two", "c", 3.5, None)]
    single = landed.clean_sheet({"one": one}, key_column=0, coerce_exclude=["n"])
    assert single.columns == ["name", "n", "note"] and single.schema["n"].dataType.typeName() \
        == "string"
    with pytest.raises(ValueError):
        landed.clean_sheet({})


# -- versions ---------------------------------------------------------------

PEOPLE = "id bigint, name string, score double"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(5)], PEOPLE)


def test_versions(store, people, rows):
    name = "crm/raw/people"
    with pytest.raises(LookupError):
        store.read(name)
    assert store.read_or_none(name) is None
    a = store.write(name, people, {"day": 1}, system={"produced_by_task": "t"})
    assert (a.n_rows, a.skipped) == (5, False)
    b = store.write(name, people.limit(2), {"day": 2})
    assert [r.version for r in store.list_versions(name).collect()] == [b.version, a.version]
    assert store.read(name).count() == 2 and store.read(name, a.version).count() == 5
    again = store.write(name, people, {"day": 2})
    assert again.skipped and again.version == b.version
    # only the latest version counts, and empty metadata never matches
    assert not store.write(name, people, {"day": 1}).skipped
    assert not store.write(name, people).skipped and not store.write(name, people).skipped
    assert not store.write(name, people, {"day": 2}, force=True).skipped


def test_skip_runs_nothing(store, spark, people):
    store.write("d", people, {"k": "v"})
    broken = people.withColumn("x", F.raise_error(F.lit("must not run")))
    assert store.write("d", broken, {"k": "v"}).skipped


def test_deprecate_and_delete(store, people, tmp_path):
    a, b = store.write("d", people, {"n": 1}), store.write("d", people, {"n": 2})
    store.deprecate("d", b.version)
    assert store.latest("d")["version"] == a.version
    assert store.read("d", b.version).count() == 5
    store.delete_version("d", a.version)
    assert store.latest("d") is None and store.versions("d").count() == 1
    assert not (tmp_path / "store" / "d" / "data" / f"version={a.version}").exists()
    with pytest.raises(LookupError):
        store.read("d", a.version)


def test_failed_write_leaves_the_old_version(store, people):
    a = store.write("d", people, {"n": 1})
    broken = people.withColumn("x", F.raise_error(F.lit("boom")))
    with pytest.raises(Exception):
        store.write("d", broken, {"n": 2})
    assert store.latest("d")["version"] == a.version and store.read("d").count() == 5
    assert [r.status for r in store.versions("d").orderBy("seq").collect()] == [
        "committed", "failed"]


def test_crash_before_the_commit_row(store, people, monkeypatch):
    store.write("d", people, {"n": 1})
    put = files.put_if_absent

    def crash(spark, path, text):
        if '"committed"' in text:
            raise SystemExit
        return put(spark, path, text)
    monkeypatch.setattr(files, "put_if_absent", crash)
    with pytest.raises(SystemExit):
        store.write("d", people.limit(1).withColumn("extra", F.lit(1)), {"n": 2}, inputs=[("raw", "1")],
                    expectations=[Expectation("not_null", {"x": "this.id"})])
    assert store.read("d").count() == 5
    assert store.edges().count() == store.downstream("raw").count() == 0
    assert store.columns("d").count() == 3 and store.quality("d").count() == 0


@pytest.mark.parametrize("fmt, partition_by", [("csv", None), ("tsv", None), ("jsonl", None), ("parquet", ["day"]),
                                               ("parquet", ["t"])])
def test_versions_keep_their_types(store, spark, rows, fmt, partition_by):
    df = spark.createDataFrame([("007", 1, "2024-01-01", 1.0), ("1e5", 2, "2024-01-02", None)],
                               "t string, id bigint, day string, v float")
    done = store.write("d", df, fmt=fmt, partition_by=partition_by)
    back = store.read("d")
    assert done.n_rows == 2 and back.dtypes == df.dtypes and rows(back) == rows(df)


def test_only_committed_versions_are_read(store, people):
    store.write("d", people, {"n": 1})
    with pytest.raises(Exception):
        store.write("d", people.withColumn("x", F.raise_error(F.lit("boom"))), {"n": 2}, inputs=[("raw", "1")])
    failed = store.versions("d").where("status = 'failed'").first()["version"]
    for act in (store.read, store.deprecate, store.delete_version):
        with pytest.raises(LookupError):
            act("d", failed)
    assert store.edges().count() == 0


def test_deleting_takes_edges_and_quality(store, people):
    kept = store.write("out", people, {"n": 1}, inputs=[("raw", "1")])
    gone = store.write("out", people, {"n": 2}, inputs=[("raw", "2")],
                       expectations=[Expectation("not_null", {"x": "this.id"})])
    assert store.upstream("out").count() == 2 and store.quality("out").count() == 1
    store.delete_version("out", gone.version)
    assert store.upstream("out").count() == 1 and store.quality("out").count() == 0
    assert [tuple(r) for r in store.downstream("raw").collect()] == [("out", kept.version)]


def test_stored_expectations_run_on_every_commit(store, people):
    store.expect("d", [Expectation("between", {"x": "this.score"}, {"min_val": 0, "max_val": 1})])
    assert store.write("d", people, {"n": 1}).dq_success is False
    assert store.write("d", people.where("score <= 1"), {"n": 2}).dq_success is True
    store.expect("d", [])
    assert store.write("d", people, {"n": 3}).dq_success is None
    assert store.quality("d").count() == 2


def test_reserved_metadata(store, people):
    with pytest.raises(ValueError):
        store.write("d", people, {"sys.x": 1})


def test_a_broken_log_is_no_fresh_start(store, people, tmp_path):
    log = tmp_path / "store" / "_log" / "d" / "entry"
    log.mkdir(parents=True)
    (log / f"{1:012d}.json").write_bytes(b"{broken")
    with pytest.raises(Exception):
        store.read_or_none("d")


# -- commits ----------------------------------------------------------------


def test_put_if_absent(spark, tmp_path):
    path = str(tmp_path / "a" / "b" / "1.json")
    assert files.put_if_absent(spark, path, "first") and not files.put_if_absent(spark, path, "second")
    assert open(path).read() == "first" and files.names(spark, str(tmp_path / "a" / "b")) == ["1.json"]
    assert files.exists(spark, path) and files.names(spark, str(tmp_path / "nowhere")) == []
    # The way of file systems that rename.
    _, source = files._at(spark, path)
    _, target = files._at(spark, str(tmp_path / "a" / "b" / "2.json"))
    files._rename(spark, source, target)
    open(path, "w").write("third")
    with pytest.raises(FileExistsError):
        files._rename(spark, source, target)
    assert open(str(tmp_path / "a" / "b" / "2.json")).read() == "first"


def test_of_many_writers_one_puts(spark, tmp_path):
    path = str(tmp_path / "1.json")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.put_if_absent(spark, path, f"writer {i}" * 1000), range(24)))
    assert won.count(True) == 1 and open(path).read() == f"writer {won.index(True)}" * 1000


def test_concurrent_commits(spark, people, tmp_path):
    """Each on a store of its own, as two drivers would."""
    def commit(n):
        return Store(spark, str(tmp_path / "s")).write("d", people.limit(n), {"n": n})
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(commit, [1, 2, 3, 4]))
    store = Store(spark, str(tmp_path / "s"))
    listed = store.versions("d").orderBy("seq").collect()
    assert [r.seq for r in listed] == [1, 2, 3, 4]
    assert {r.version: r.n_rows for r in listed} == {c.version: c.n_rows for c in done}
    assert store.columns("d").count() == 3


def test_the_same_delivery_twice_at_once(spark, people, tmp_path, monkeypatch):
    """The second writer finds the first's commit when it puts its own."""
    store, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    put, raced = files.put_if_absent, []

    def late(spark_, path, text):
        if not raced:
            raced.append(None)
            raced.append(other.write("d", people.withColumn("more", F.lit(1)), {"day": 1}))
        return put(spark_, path, text)
    monkeypatch.setattr(files, "put_if_absent", late)
    done = store.write("d", people, {"day": 1})
    assert done.skipped and done.version == raced[1].version and store.versions("d").count() == 1
    assert len(list((tmp_path / "s" / "d" / "data").iterdir())) == 1  # the loser's files are gone


def test_a_loser_commits_on_the_new_state(spark, people, tmp_path, monkeypatch):
    store, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    put, raced = files.put_if_absent, []

    def late(spark_, path, text):
        if not raced:
            raced.append(None)
            other.expect("d", [Expectation("between", {"x": "this.score"}, {"min_val": 0, "max_val": 1})])
            raced.append(other.write("d", people.withColumn("more", F.lit(1)), {"day": 1}))
        return put(spark_, path, text)
    monkeypatch.setattr(files, "put_if_absent", late)
    done = store.write("d", people, {"day": 2})
    assert [r.version for r in store.list_versions("d").collect()] == [done.version, raced[1].version]
    assert done.dq_success is False  # by the expectations stored meanwhile
    assert {r.name for r in store.columns("d").collect()} == {"id", "name", "score", "more"}


def test_commits_read_few_files_however_long_the_log(store, people, rows):
    from stratawork.sources import log
    for i in range(3):
        store.write("d", people.limit(i), {"n": i}, expectations=[Expectation("not_null", {"x": "this.id"})])
    first, second, third = [r.version for r in store.versions("d").orderBy("seq").collect()]
    store.deprecate("d", first)
    store.delete_version("d", second)
    store.expect("d", [Expectation("not_null", {"x": "this.name"})])
    before = [rows(f("d")) for f in (store.versions, store.columns, store.quality)]
    read = []
    for i in range(3 * log.FOLD):
        store.define_columns("d", {"id": {"description": f"{i}"}})
        read.append(len(store._log("d").paths()[0]))
    assert max(read) <= log.FOLD + 1
    assert len(files.names(store.spark, f"{store.base}/_log/d/state")) <= log.KEPT
    after = [rows(f("d")) for f in (store.versions, store.columns, store.quality)]
    assert after[0] == before[0] and after[2] == before[2]
    assert {r.name: r.description for r in store.columns("d").collect()} == {
        "id": f"{3 * log.FOLD - 1}", "name": "", "score": ""}
    assert store.latest("d")["version"] == third
    assert store.write("d", people, {"n": 9}).dq_success is True  # stored expectations are still there
    with pytest.raises(LookupError):
        store.read("d", second)


def test_rules_are_scored_while_writing(store, people, monkeypatch):
    """Row and aggregate rules do not read the version again; a rule that fails on the
    data does not stop the commit."""
    from stratawork.sources import versions
    uses = [Expectation("between", {"x": "this.score"}, {"min_val": 0, "max_val": 2}, 0.5),
            Expectation("mean", {"x": "this.score"}, {"min_avg": 0, "max_avg": 1}),
            Expectation("not_null", {"x": "this.nowhere"})]
    calls = []
    monkeypatch.setattr(versions, "score_suite", lambda *a: calls.append(a))
    assert store.write("d", people, {"n": 1}, expectations=uses).dq_success is False
    assert not calls
    row = store.quality("d").first()
    assert (row["passed"], row["total"], row["score"]) == (1, 3, 0.3333)
    monkeypatch.undo()
    assert store.write("e", people, expectations=[Expectation("unique", {"x": "this.id"}), uses[0]]).dq_success is True
    assert store.write("e", people.limit(0), expectations=uses[:1]).dq_success is False
    for fmt in ("csv", "jsonl", "tsv"):
        assert store.write("f", people, fmt=fmt, expectations=uses[:1]).dq_success is True


def test_digests_tell_which_bucket_changed(store, people, rows, spark):
    a = store.write("d", people, digest_by="id")
    b = store.write("d", people.select("score", "name", "id").repartition(3), {"n": 1}, digest_by="id")
    assert store.changed_buckets("d", a.version, b.version).count() == 0
    c = store.write("d", people.where("id != 2").withColumn("name", F.expr("nullif(name, 'n4')")), {"n": 2}, digest_by="id",
                    expectations=[Expectation("not_null", {"x": "this.id"})])
    assert rows(store.changed_buckets("d", a.version, c.version)) == [(2, 1, 0), (4, 1, 1)] and c.dq_success
    twice = store.write("d", people.union(people.where("id = 1")).union(people.where("id = 1")), {"n": 3}, digest_by="id")
    assert rows(store.changed_buckets("d", a.version, twice.version)) == [(1, 1, 3)]
    none = store.write("d", people.limit(0), {"n": 4}, digest_by="id")
    assert store.changed_buckets("d", none.version, a.version).count() == 5
    nulls = store.write("d", spark.createDataFrame([(None, "x", 1.0)], PEOPLE), {"n": 5}, digest_by="id")
    assert rows(store.changed_buckets("d", none.version, nulls.version)) == [(0, 0, 1)]
    plain = store.write("d", people, {"n": 6})
    with pytest.raises(ValueError):
        store.changed_buckets("d", a.version, plain.version)


def test_a_rule_that_breaks_while_writing(spark, people, tmp_path):
    bad = quality.custom_rule("row", ["x"], "cast({x} AS int) > 0")
    quality.RULES["whole"] = bad
    try:
        store = Store(spark, str(tmp_path / "s"))
        done = store.write("d", people, expectations=[
            Expectation("whole", {"x": "this.name"}), Expectation("not_null", {"x": "this.id"})])
        assert done.dq_success is False and done.n_rows == 5 and store.read("d").count() == 5
        assert store.quality("d").first()["passed"] == 1
    finally:
        del quality.RULES["whole"]


def test_virtual(store, people):
    people.createOrReplaceTempView("people_view")
    store.register_query("v", "SELECT id FROM people_view WHERE score > 2")
    assert store.read("v").count() == 2
    with pytest.raises(Exception):
        store.register_query("w", "SELECT * FROM no_such_table")


def test_lineage(store, people, rows):
    raw = store.write("raw", people, {"n": 1})
    silver = store.write("silver", people, inputs=[("raw", raw.version), ("raw", raw.version)])
    gold = store.write("gold", people, inputs=[("silver", silver.version),
                                               (lineage.external("http://x"), "1")])
    assert rows(store.upstream("silver")) == [("raw", raw.version)]
    assert rows(store.downstream("silver", silver.version)) == [("gold", gold.version)]
    assert store.upstream("gold").count() == 2 and store.upstream("raw").count() == 0
    assert store.edges().count() == 3


def test_schema_drift(store, spark):
    contacts = spark.createDataFrame([(1, "a@b", 30)], "id bigint, email string, age bigint")
    store.write("c", contacts, {"n": 1})
    assert {r.status for r in store.columns("c").collect()} == {"inferred"}
    store.define_columns("c", {"email": {"pii": True, "pii_type": "direct"}})
    assert schemas.schema_summary(store.columns("c")).first().asDict() == {
        "total": 3, "pii": 1, "inferred": 2, "draft": 1, "published": 0}
    assert store.write("c", contacts.drop("age"), {"n": 2}).warnings == []
    store.publish_columns("c")
    changed = contacts.drop("age").withColumn("id", F.lit("x")).withColumn("new", F.lit(1))
    done = store.write("c", changed, {"n": 3})
    assert len(done.warnings) == 2 and store.latest("c")["version"] == done.version
    diff = schemas.schema_diff(store.columns("c").where("status = 'published'"), changed)
    assert {(r.name, r.change) for r in diff.collect()} == {("age", "missing"),
                                                            ("id", "type_change")}
    with pytest.raises(ValueError):
        store.define_columns("c", {"id": {"colour": "red"}})


def test_types_and_annotations(spark, tmp_path):
    df = spark.sql("SELECT 1 AS i, 1L AS l, 1.5D AS d, true AS b, 'x' AS s, "
                   "TIMESTAMP_NTZ '2024-01-01' AS t, DATE '2024-01-01' AS day, 1.5 AS dec")
    got = {r.name: r.logical_type for r in schemas.infer_schema(df).collect()}
    assert got == {"i": "integer", "l": "integer", "d": "decimal", "b": "boolean", "s": "string",
                   "t": "datetime", "day": "string", "dec": "string"}
    noted = schemas.annotate_columns(df, {"s": {"pii": True, "description": "name"}})
    path = str(tmp_path / "t")
    noted.write.parquet(path)
    assert schemas.column_notes(spark.read.parquet(path)) == {
        "s": {"pii": True, "description": "name"}}
    with pytest.raises(ValueError):
        schemas.annotate_columns(df, {"s": {"nope": 1}})


def test_types_from_values(spark):
    data = [("1", "1.5", "true", "2024-01-01", "007", None, "1", "x", 1.0), (" 2 ", "-3", "FALSE", "2024-01-01 10:00:00", "1", "", "a", "", None),
            ("+3", "1e5", None, "2024-01-01T10:00:00.5", "2", " ", "2", None, float("nan"))]
    df = spark.createDataFrame(data, "i string, d string, b string, t string, code string, none string, mix string, s string, v double")
    got = {r.name: (r.logical_type, r.n_missing) for r in schemas.infer_types(df).collect()}
    assert got == {"i": ("integer", 0), "d": ("decimal", 0), "b": ("boolean", 1), "t": ("datetime", 0), "code": ("string", 0),
                   "none": ("string", 3), "mix": ("string", 0), "s": ("string", 2), "v": ("decimal", 2)}
    assert {r.logical_type for r in schemas.infer_types(df.limit(0).drop("v")).collect()} == {"string"}
    wide = spark.createDataFrame([("99999999999999999999", "2024-13-01")], "big string, `a.b` string")
    assert {r.name: r.logical_type for r in schemas.infer_types(wide).collect()} == {"big": "decimal", "a.b": "string"}
    diff = schemas.drift(schemas.infer_types(df), schemas.infer_types(df.drop("b").withColumn("i", F.lit("x"))), "logical_type")
    assert sorted(map(tuple, diff.collect())) == [("b", "boolean", None, "missing"), ("i", "integer", "string", "type_change")]


def test_quality_on_commit(store, spark):
    df = spark.createDataFrame([(i, "v") for i in range(5)], "id bigint, val string")
    good = [Expectation("not_null", {"x": "this.id"})]
    assert store.write("d", df, {"n": 1}, expectations=good).dq_success is True
    bad = [Expectation("not_null", {"x": "this.nope"})]
    done = store.write("d", df, {"n": 2}, expectations=bad)
    assert done.dq_success is False and store.latest("d")["version"] == done.version
    rows = store.quality("d").collect()
    assert [(r.success, r.passed, r.total) for r in rows] == [(False, 0, 1), (True, 1, 1)]
    assert "nope" in rows[0].details


@pytest.mark.parametrize("fmt", ["csv", "tsv", "jsonl"])
def test_text_cells_come_back_as_written(spark, tmp_path, fmt):
    cells = [None, "", '"', '""', "a\nb", "a\r\nb", "\r", "x\ry", "#c", " pad ", "\t", "a\tb", ",", "\\",
             '\\"', "a\\", "é", "''", "null", '"q" "', "\n", 'x"\ny', " "]
    df = spark.createDataFrame([(i, c, c) for i, c in enumerate(cells)], "id int, a string, b string")
    files.sink(df, f"{tmp_path}/t", fmt)
    back = files.scan(spark, f"{tmp_path}/t", fmt, schema=df.schema)
    assert {r.id: (r.a, r.b) for r in back.collect()} == {i: (c, c) for i, c in enumerate(cells)}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            files.scratch(Session(spark_master=master))
        shared = files.scratch(Session(spark_master=master, spark_checkpoint_dir="hdfs:///tmp/x/"))
        assert shared.startswith("hdfs:///tmp/x/")
    assert files.scratch(Session(spark_master="local[4]"))
