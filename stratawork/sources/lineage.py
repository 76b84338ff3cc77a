"""Lineage edges: (output dataset, version) made from (input dataset, version)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = "output_dataset string, output_version string, input_dataset string, input_version string"
EXTERNAL = "__external__/"


def external(url: str) -> str:
    """Dataset id of an input that is not in the store."""
    return EXTERNAL + url


def record(edges: DataFrame | None, new: DataFrame) -> DataFrame:
    """Add edges; those already present are ignored."""
    return (new if edges is None else edges.unionByName(new)).dropDuplicates()


def upstream(edges: DataFrame, dataset: str, version: str | None = None) -> DataFrame:
    """Direct inputs of a dataset (version)."""
    at = F.col("output_dataset") == dataset
    at = at & (F.col("output_version") == version) if version else at
    return edges.where(at).select("input_dataset", "input_version").distinct()


def downstream(edges: DataFrame, dataset: str, version: str | None = None) -> DataFrame:
    """Datasets (versions) made directly from this one."""
    at = F.col("input_dataset") == dataset
    at = at & (F.col("input_version") == version) if version else at
    return edges.where(at).select("output_dataset", "output_version").distinct()
