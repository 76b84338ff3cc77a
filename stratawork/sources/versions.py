"""Versioned datasets on a plain file system.

``base/<dataset>/data/version=<id>/`` holds the data, ``base/_log/<dataset>/`` its
log (see ``log``). A version exists for readers once its ``committed`` row is in the
log. That one row holds all there is to know about it (types, row count, column
records, quality, and for tables kept in parts the folders these lie in, which versions
may share), so a commit happens as a whole or not at all; a crash leaves an invisible
directory, never half a table. Any number of writers may commit: versions
stand in the order of their rows, and a writer that finds itself overtaken by the same
metadata takes its own files back. Edges of lineage lie in one table of all datasets
and count only if a log has their version.

Only bookkeeping rows (a few per version) pass through the driver.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import ge
from ..operators.quality import Expectation, Watch, score_suite, summarize
from . import files, lineage, schemas, slices
from .log import Log

logger = logging.getLogger(__name__)

# The fields of column records and quality results.
COLUMN = "name string, physical_type string, logical_type string, nullable boolean, " \
         "pii boolean, pii_type string, pii_notes string, description string, status string"
DQ = "seq bigint, score double, passed bigint, total bigint, success boolean, " \
     "details string, error string"


def _nested(fields: str) -> str:
    return "struct<" + ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", ")) + ">"


STATE = "dataset string, version string, status string, seq bigint, format string, location string, " \
        "n_rows bigint, metadata map<string,string>, schema string, " \
        f"columns array<{_nested(COLUMN)}>, quality {_nested(DQ)}, expectations string, " \
        "parts map<string,string>, digest_by string, digests map<string,string>"
#: States whose data can be read by version. The other rows of a log are
#: ``failed`` and ``deleted`` versions, and ``notes`` and ``expectations`` of the dataset.
READABLE = ("committed", "deprecated")
SYSTEM = "sys."
#: Buckets that have a digest each.
BUCKETS = 16
QUERY = "query"


@dataclass(frozen=True)
class Commit:
    dataset: str
    version: str
    location: str
    skipped: bool = False
    n_rows: int | None = None
    warnings: list[str] = field(default_factory=list)
    dq_success: bool | None = None


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    # -- bookkeeping tables -------------------------------------------------

    def _path(self, dataset: str, part: str) -> str:
        return f"{self.base}/{dataset}/{part}"

    def _log(self, dataset: str) -> Log:
        return Log(self.spark, f"{self.base}/_log/{dataset}", STATE)

    def _add(self, dataset: str, build: Callable[[list[Row]], dict | None]) -> dict | None:
        """Append to the log what ``build`` makes of it; cells that are not given are null."""
        return self._log(dataset).add(
            lambda rows: None if (made := build(rows)) is None else {"dataset": dataset, **made}, self._folded)

    def _folded(self, rows: list[Row]) -> list[dict]:
        """What a log comes to: the newest row of each version, the column records, the
        stored expectations."""
        out = [{**r.asDict(recursive=True), "columns": None} for r in self._current(rows).values()]
        if columns := list(self._records(rows).values()):
            out.append({"status": "notes", "seq": rows[-1]["seq"], "columns": columns})
        out += [r.asDict(recursive=True) for r in rows if r["status"] == "expectations"][-1:]
        return out

    @staticmethod
    def _newest(log: DataFrame, *keys: str) -> DataFrame:
        rest = [c for c in ("status", "seq", "format", "location", "n_rows", "metadata", "quality") if c not in keys]
        return log.where("version IS NOT NULL").groupBy(*keys, "version").agg(
            F.max_by(F.struct(*rest), "seq").alias("s")).select(*keys, "version", "s.*").where("status != 'deleted'")

    def versions(self, dataset: str) -> DataFrame:
        """The current state of every version."""
        return self._newest(self._log(dataset).frame()).drop("quality")

    def list_versions(self, dataset: str) -> DataFrame:
        """Committed versions, newest first."""
        return self.versions(dataset).where("status = 'committed'") \
            .orderBy(F.col("seq").desc()).drop("seq", "status")

    def _rows(self, dataset: str) -> list[Row]:
        """The log, oldest row first: one job, whatever is asked of it."""
        return sorted(self._log(dataset).frame().collect(), key=lambda r: r["seq"])

    @staticmethod
    def _current(rows: list[Row]) -> dict[str, Row]:
        """Newest row per version, oldest first."""
        out: dict[str, Row] = {}
        for r in rows:
            if r["version"] is not None:
                out.pop(r["version"], None)
                out[r["version"]] = r
        return {v: r for v, r in out.items() if r["status"] != "deleted"}

    def _last(self, rows: list[Row]) -> Row | None:
        done = [r for r in self._current(rows).values() if r["status"] == "committed"]
        return done[-1] if done else None

    def latest(self, dataset: str) -> Row | None:
        return self._last(self._rows(dataset))

    def _get(self, dataset: str, version: str) -> Row:
        return self._readable(self._rows(dataset), dataset, version)

    def _readable(self, rows: list[Row], dataset: str, version: str) -> Row:
        row = self._current(rows).get(version)
        if row is None or row["status"] not in READABLE:
            raise LookupError(f"'{dataset}' has no readable version '{version}'")
        return row

    # -- reading ------------------------------------------------------------

    def _open(self, row: Row) -> DataFrame:
        """The data of a version, with the types and column order it was written with."""
        if row["format"] == QUERY:
            return self.spark.sql(row["location"])
        schema = T.StructType.fromJson(json.loads(row["schema"]))
        if row["parts"] is not None:
            return self.open_parts(row["parts"], schema)
        return files.scan(self.spark, row["location"], row["format"], schema).select(
            *[f"`{n}`" for n in schema.fieldNames()])

    def open_parts(self, parts: Mapping[str, str], schema: T.StructType) -> DataFrame:
        """The rows of some parts of a table; those whose name begins with a dot are
        not rows. Columns that a part lacks are null there."""
        paths = [path for name, path in sorted(parts.items()) if not name.startswith(".")]
        return files.scan(self.spark, paths, schema=schema) if paths else self.spark.createDataFrame([], schema)

    def read(self, dataset: str, version: str | None = None) -> DataFrame:
        """The latest committed version, or a given one that is committed or
        deprecated."""
        row = self._get(dataset, version) if version else self.latest(dataset)
        if row is None:
            raise LookupError(f"dataset '{dataset}' has no committed version")
        return self._open(row)

    def read_or_none(self, dataset: str) -> DataFrame | None:
        """None only when there is no committed version."""
        row = self.latest(dataset)
        return None if row is None else self._open(row)

    def preview(self, dataset: str, order_by: str | list[str], version: str | None = None,
                limit: int = 10, offset: int = 0) -> DataFrame:
        return slices.preview(self.read(dataset, version), order_by, limit, offset)

    # -- writing ------------------------------------------------------------

    @staticmethod
    def _same(last: Row | None, metadata: Mapping[str, Any] | None) -> Row | None:
        if last is None or not metadata:
            return None
        user = {k: v for k, v in last["metadata"].items() if not k.startswith(SYSTEM)}
        return last if user == {k: str(v) for k, v in metadata.items()} else None

    def unchanged(self, dataset: str, metadata: Mapping[str, Any] | None) -> Row | None:
        """The latest committed version if its user metadata equals ``metadata``
        (which must not be empty)."""
        return self._same(self.latest(dataset) if metadata else None, metadata)

    def write(self, dataset: str, df: DataFrame, metadata: Mapping[str, Any] | None = None,
              inputs: list[tuple[str, str]] = (), fmt: str = "parquet", force: bool = False,
              partition_by: list[str] | None = None,
              expectations: list[Expectation] = (), system: Mapping[str, Any] | None = None,
              digest_by: str | None = None) -> Commit:
        """Commit ``df`` as a new version. If the latest version has the same
        metadata nothing is computed (unless ``force``). Expectations (those stored
        with the dataset and those given) and schema drift are reported but do not
        stop the commit; expectations refer to the dataset as ``this``. With ``digest_by``,
        a whole-number expression that a row keeps through a change, the version has a
        digest per bucket of it, for ``changed_buckets``."""
        metadata = {k: str(v) for k, v in (metadata or {}).items()}
        if any(k.startswith(SYSTEM) for k in metadata):
            raise ValueError(f"{SYSTEM}* metadata keys are reserved")
        version = self._new_version()
        location = self._path(dataset, f"data/version={version}")
        full = metadata | {SYSTEM + k: str(v) for k, v in (system or {}).items()}
        cells: dict[str, Any] = {}
        scored: list[Expectation] | None = None
        same, warnings = None, []

        def build(rows: list[Row]) -> dict | None:
            nonlocal same, scored, warnings
            same = None if force else self._same(self._last(rows), metadata)
            if same is not None:
                return None
            uses = [*self._stored_expectations(rows), *expectations]
            if scored is None:
                cells.update(self._written(df, location, fmt, partition_by, uses, digest_by))
                if inputs:
                    schemas.records_frame(self.spark, [(dataset, version, d, v) for d, v in inputs], lineage.EDGE) \
                        .write.mode("append").parquet(f"{self.base}/lineage")
            elif scored != uses:  # stored by another writer in the meantime
                cells["quality"] = self._scored(files.scan(self.spark, location, fmt, schema=df.schema), uses)
            scored = uses
            columns, warnings = self._noted(rows, df)
            return {"version": version, "status": "committed", "format": fmt, "location": location,
                    "metadata": full, "schema": df.schema.json(), "columns": columns, **cells}

        try:
            self._add(dataset, build)
        except Exception:
            self._add(dataset, lambda rows: {"version": version, "status": "failed", "format": fmt,
                                             "location": location, "metadata": {}})
            files.remove(self.spark, location)
            raise
        if same is not None:
            if scored is not None:
                files.remove(self.spark, location)
            return Commit(dataset, same["version"], same["location"], skipped=True, n_rows=same["n_rows"])
        dq = cells["quality"]
        return Commit(dataset, version, location, n_rows=cells["n_rows"], warnings=warnings,
                      dq_success=dq["success"] if dq else None)

    def commit_parts(self, dataset: str,
                     produce: Callable[[Row | None, str], tuple[T.StructType, dict[str, str], dict[str, Any]]],
                     metadata: Mapping[str, Any] | None = None, inputs: list[tuple[str, str]] = ()) -> Commit:
        """Commit a version made of parts. ``produce`` gets the latest version and a new
        folder, writes what is new into it, and gives the schema, the folders of all
        parts and metadata of its own; it is called again, with the folder emptied, when another writer has
        committed in between. Stored expectations are scored on the whole version."""
        metadata = {k: str(v) for k, v in (metadata or {}).items()}
        version = self._new_version()
        location = self._path(dataset, f"data/version={version}")
        made: dict[str, Any] = {}
        same, warnings = None, []

        def build(rows: list[Row]) -> dict | None:
            nonlocal same, warnings
            last = self._last(rows)
            same = self._same(last, metadata)
            if same is not None:
                return None
            base = last["version"] if last is not None else None
            if not made or made["base"] != base:
                files.remove(self.spark, location)
                schema, parts, system = produce(last, location)
                data = self.open_parts(parts, schema)
                made.update(base=base, metadata=metadata | {SYSTEM + k: str(v) for k, v in system.items()}, data=data, schema=schema.json(), parts=parts, n_rows=data.count())
                edges = [(dataset, version, d, v) for d, v in [*inputs, *([(dataset, base)] if base else [])]]
                if edges:
                    schemas.records_frame(self.spark, edges, lineage.EDGE).write.mode("append").parquet(
                        f"{self.base}/lineage")
            columns, warnings = self._noted(rows, made["data"])
            return {"version": version, "status": "committed", "format": "parquet", "location": location,
                    "columns": columns, "quality": self._scored(made["data"], self._stored_expectations(rows)),
                    **{c: made[c] for c in ("metadata", "schema", "parts", "n_rows")}}

        try:
            row = self._add(dataset, build)
        except Exception:
            self._add(dataset, lambda rows: {"version": version, "status": "failed", "format": "parquet",
                                             "location": location, "metadata": {}})
            files.remove(self.spark, location)
            raise
        if same is not None:
            files.remove(self.spark, location)
            return Commit(dataset, same["version"], same["location"], skipped=True, n_rows=same["n_rows"])
        dq = row["quality"]
        return Commit(dataset, version, location, n_rows=row["n_rows"], warnings=warnings,
                      dq_success=dq["success"] if dq else None)

    @staticmethod
    def _new_version() -> str:
        """By time, for people; two of the same moment differ by chance."""
        return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f") + uuid.uuid4().hex[:6]

    def _written(self, df: DataFrame, location: str, fmt: str, partition_by: list[str] | None,
                 uses: list[Expectation], digest_by: str | None) -> dict[str, Any]:
        """Write the data, counted, scored and digested on the way."""
        more = slices.bucket_measures(df, F.expr(digest_by), BUCKETS) if digest_by else []
        watch = Watch(uses, df, more=more)
        try:
            files.sink(watch.watched(), location, fmt, partition_by=partition_by)
        except Exception:
            if not watch.measures_rules:
                raise
            # A rule may fail on the data, which must not stop the commit.
            watch = Watch([], df, more=more)
            files.remove(self.spark, location)
            files.sink(watch.watched(), location, fmt, partition_by=partition_by)
        data = files.scan(self.spark, location, fmt, schema=df.schema)
        # The footers know the count; what a repeated task measured twice does not agree with it.
        n_rows = data.count() if fmt == "parquet" else watch.rows()
        out = {"n_rows": n_rows, "quality": self._scored(data, uses, watch, n_rows)}
        if digest_by:
            seen = watch.seen.get if watch.complete(n_rows) else data.agg(*more).first().asDict()
            out |= {"digest_by": digest_by, "digests": slices.bucket_digests(seen, BUCKETS)}
        return out

    def changed_buckets(self, dataset: str, before: str, after: str) -> DataFrame:
        """The buckets in which two versions differ, with their row counts; no data is
        read. Both must have digests by the same expression."""
        rows = self._rows(dataset)
        a, b = (self._readable(rows, dataset, v) for v in (before, after))
        if not a["digest_by"] or a["digest_by"] != b["digest_by"]:
            raise ValueError(f"versions have digests by {a['digest_by']} and {b['digest_by']}")

        def count(digest: str | None) -> int:
            return int(digest.split(":")[0]) if digest else 0
        old, new = a["digests"] or {}, b["digests"] or {}
        return schemas.records_frame(
            self.spark, [(int(i), count(old.get(i)), count(new.get(i))) for i in sorted({*old, *new}, key=int)
                         if old.get(i) != new.get(i)], "bucket int, n_before bigint, n_after bigint")

    def register_query(self, dataset: str, query: str,
                       metadata: Mapping[str, Any] | None = None) -> Commit:
        """A virtual dataset: its version is a SELECT on tables of the session."""
        self.spark.sql(query)  # analysed, not run: an unknown source fails here
        version = self._new_version()
        self._add(dataset, lambda rows: {
            "version": version, "status": "committed", "format": QUERY, "location": query,
            "metadata": {k: str(v) for k, v in (metadata or {}).items()}})
        return Commit(dataset, version, query)

    def _follow(self, dataset: str, version: str, status: str) -> dict:
        """The next state of a version, all else as it was."""
        return self._add(dataset, lambda rows: {
            **self._readable(rows, dataset, version).asDict(recursive=True), "status": status, "columns": None})

    def deprecate(self, dataset: str, version: str) -> None:
        """Hide a version from listings and from ``read`` without a version."""
        self._follow(dataset, version, "deprecated")

    def delete_version(self, dataset: str, version: str) -> None:
        """Hide the version first, with its edges and quality, then remove its files,
        but for parts that other versions share."""
        row = self._follow(dataset, version, "deleted")
        if row["format"] == QUERY:
            return
        shared = {p for r in self._current(self._rows(dataset)).values() for p in (r["parts"] or {}).values()}
        for path in set((row["parts"] or {}).values()) - shared:
            files.remove(self.spark, path)
        if not any(p.startswith(row["location"] + "/") for p in shared):
            files.remove(self.spark, row["location"])

    # -- lineage ------------------------------------------------------------

    def _edges(self, at: Any) -> DataFrame:
        """Edges of versions that can be read: those that the logs, all read at once,
        have."""
        try:
            found = self.spark.read.schema(lineage.EDGE).parquet(f"{self.base}/lineage").where(at).dropDuplicates()
            logs = self.spark.read.schema(STATE).option("mode", "FAILFAST").option("recursiveFileLookup", "true") \
                .option("pathGlobFilter", "*.json").json(f"{self.base}/_log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return schemas.records_frame(self.spark, [], lineage.EDGE)
        there = self._newest(logs, "dataset").where(F.col("status").isin(*READABLE)).select(
            F.col("dataset").alias("output_dataset"), F.col("version").alias("output_version"))
        return found.join(there, ["output_dataset", "output_version"], "left_semi")

    def edges(self) -> DataFrame:
        return self._edges(F.lit(True))

    def upstream(self, dataset: str, version: str | None = None) -> DataFrame:
        return lineage.upstream(self._edges(F.col("output_dataset") == dataset), dataset, version)

    def downstream(self, dataset: str, version: str | None = None) -> DataFrame:
        return lineage.downstream(self._edges(F.col("input_dataset") == dataset), dataset, version)

    # -- schema -------------------------------------------------------------

    def columns(self, dataset: str) -> DataFrame:
        """Current column records, as the last commit or note has them."""
        log = self._log(dataset).frame().where("columns IS NOT NULL")
        each = log.select("seq", F.inline("columns"))
        rest = [c for c in each.columns if c not in ("seq", "name")]
        newest = F.max_by(F.struct(*rest), "seq").alias("s")
        return each.groupBy("name").agg(newest).select("name", "s.*")

    @staticmethod
    def _records(rows: list[Row]) -> dict[str, dict]:
        return {c["name"]: c.asDict() for r in rows for c in r["columns"] or ()}

    def _noted(self, rows: list[Row], df: DataFrame) -> tuple[list[dict], list[str]]:
        """Column records that ``df`` adds or changes, and how it departs from the
        published ones."""
        known = self._records(rows)
        published = [(n, r["physical_type"]) for n, r in sorted(known.items())
                     if r["status"] == "published"]
        fresh = [{"name": n, "physical_type": p, "logical_type": l, "nullable": True,
                  "pii": False, "pii_type": "none", "pii_notes": "", "description": "",
                  "status": "inferred"}
                 for n, p, l in schemas.column_records(df) if n not in known]
        changed = [{**known[n], "physical_type": p} for n, p, _ in schemas.column_records(df)
                   if n in known and known[n]["physical_type"] != p
                   and known[n]["status"] != "published"]
        return fresh + changed, schemas.drift_messages(published, df)

    def define_columns(self, dataset: str, notes: Mapping[str, Mapping[str, Any]]) -> None:
        """Notes on columns; an inferred column becomes a draft."""
        for name, entry in notes.items():
            unknown = set(entry) - set(schemas.NOTES)
            if unknown:
                raise ValueError(f"unknown notes for '{name}': {sorted(unknown)}")

        def build(rows: list[Row]) -> dict:
            known, out = self._records(rows), []
            for name, entry in notes.items():
                base = known.get(name, {
                    "name": name, "physical_type": None, "logical_type": None, "nullable": True,
                    "pii": False, "pii_type": "none", "pii_notes": "", "description": "",
                    "status": "draft"})
                status = "published" if base["status"] == "published" else "draft"
                out.append({**base, **entry, "status": status})
            return {"status": "notes", "columns": out}
        self._add(dataset, build)

    def publish_columns(self, dataset: str) -> None:
        """From now on commits are compared with these columns."""
        self._add(dataset, lambda rows: {"status": "notes", "columns": [
            {**r, "status": "published"} for r in self._records(rows).values()]})

    # -- quality ------------------------------------------------------------

    def expect(self, dataset: str, expectations: list[Expectation]) -> None:
        """Store expectations with a dataset, in place of those stored before: every
        commit is scored by them."""
        stored = json.dumps([asdict(e) for e in expectations])
        self._add(dataset, lambda rows: {"status": "expectations", "expectations": stored})

    @staticmethod
    def _stored_expectations(rows: list[Row]) -> list[Expectation]:
        stored = [r["expectations"] for r in rows if r["status"] == "expectations"]
        return [Expectation(**e) for e in json.loads(stored[-1])] if stored else []

    def _scored(self, df: DataFrame, expectations: list[Expectation], watch: Watch | None = None,
                n_rows: int | None = None) -> dict | None:
        """Score the new version, by what was measured while it was written if that
        covers all its rows. Trouble here is recorded, never raised."""
        if not expectations:
            return None
        at = {"seq": time.time_ns()}
        try:
            seen = watch is not None and watch.covers(expectations, n_rows)
            results = watch.results(df) if seen else score_suite(expectations, {"this": df})
            row = summarize(results, details=True).first()
            return at | {c: row[c] for c in ("score", "passed", "total", "success", "details")} | {"error": None}
        except Exception as e:
            if watch is not None:  # a rule that is not measured on the way may fail alone
                return self._scored(df, expectations)
            logger.warning("quality check failed: %s", e)
            return at | {"score": 0.0, "passed": 0, "total": len(expectations), "success": False,
                         "details": "[]", "error": str(e)}

    def quality(self, dataset: str, since: int = 0) -> DataFrame:
        """Quality results of the versions there are, newest first."""
        there = self._newest(self._log(dataset).frame()).where(F.col("status").isin(*READABLE))
        return there.where("quality IS NOT NULL").select("version", "quality.*") \
            .where(ge("seq", since)).orderBy(F.col("seq").desc())
