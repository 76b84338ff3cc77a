"""Files on any path Spark can reach (local, HDFS, ``s3a://``; credentials are
Hadoop configuration)."""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import Any

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "tsv", "jsonl")
#: Cells as they are: quotes doubled, line ends and blanks kept, null apart from
#: the empty text. Both sides must agree on it.
CELLS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
         "ignoreTrailingWhiteSpace": "false", "emptyValue": '""', "nullValue": ""}
#: Rows per delimited file: a cell may hold line ends, so one task reads one file.
FILE_ROWS = 500_000


def _check(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got '{fmt}'")


def scan(spark: SparkSession, path: str | list[str], fmt: str = "parquet",
         schema: T.StructType | str | None = None, **options: Any) -> DataFrame:
    """Read files. CSV and TSV have a header and come back as ``sink`` wrote them,
    cells with line ends and quotes included; without ``schema`` their types are
    inferred, which reads the data once more: give a schema for large inputs."""
    _check(fmt)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "parquet":
        return reader.parquet(path) if isinstance(path, str) else reader.parquet(*path)
    if fmt == "jsonl":
        return reader.json(path)
    # What stands for a missing cell inside the parser must not be the empty text.
    cells = {**CELLS, "emptyValue": "", "nullValue": "\0missing", "multiLine": "true"} | {k: str(v) for k, v in options.items()}
    return reader.options(**cells).csv(path, header=True, sep="\t" if fmt == "tsv" else ",",
                                       inferSchema=schema is None)


def sink(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
         partition_by: list[str] | None = None, **options: Any) -> None:
    """Write files: CSV and TSV with header and in files of bounded size, JSON one
    record per line. With
    ``partition_by`` the rows of a directory are brought together first, or each
    task would write a file into each directory; adaptive execution splits
    directories that are large."""
    _check(fmt)
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "jsonl":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        cells = CELLS | {"maxRecordsPerFile": str(FILE_ROWS)} | {k: str(v) for k, v in options.items()}
        writer.options(**cells).csv(path, header=True, sep="\t" if fmt == "tsv" else ",")


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """Hadoop's file system and path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(target)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a directory through Hadoop's file system; False if absent."""
    system, target = _at(spark, path)
    return system.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _at(spark, path)
    return system.exists(target)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is absent."""
    system, target = _at(spark, folder)
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file as a whole, or leave the one that is there and return
    False. Of several writers one succeeds: a local file system links a finished
    file to its name, others rename it without overwriting, which must be atomic
    there, as it is in HDFS."""
    system, target = _at(spark, path)
    system.mkdirs(target.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = system.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if system.getScheme() == "file":
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        else:
            _rename(spark, draft, target)
        return True
    except FileExistsError:
        return False
    finally:
        system.delete(draft, False)


def _rename(spark: SparkSession, source: JavaObject, target: JavaObject) -> None:
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").NONE
    try:
        context.rename(source, target, how)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise FileExistsError(target.toString()) from None
        raise


def scratch(spark: SparkSession) -> str:
    """A new folder name all executors can reach: under ``spark.checkpoint.dir``
    where the cluster names one. Without it only a local master may go on, in a
    temporary folder of this machine; on a cluster that is an error, because each
    executor would write to its own disk."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="stratawork-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
