"""Stacking tables by column name."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .project import add_constant

logger = logging.getLogger(__name__)


def coerce_mixed(frames: list[DataFrame]) -> list[DataFrame]:
    """Cast columns that hold different kinds of data in different inputs to
    text. Numbers of different width are left to Spark's own widening."""
    kinds: dict[str, set[T.DataType]] = {}
    for df in frames:
        for f in df.schema:
            if not isinstance(f.dataType, T.NullType):
                kinds.setdefault(f.name, set()).add(f.dataType)

    def mixed(types: set[T.DataType]) -> bool:
        dates = all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))
                    for t in types)
        return len(types) > 1 and not dates and \
            not all(isinstance(t, T.NumericType) for t in types)

    to_text = {name for name, types in kinds.items() if mixed(types)}
    if not to_text:
        return frames
    logger.warning("columns of mixed type become text: %s", sorted(to_text))
    return [df.select(*[F.col(c).cast("string").alias(c) if c in to_text else F.col(c)
                        for c in df.columns]) for df in frames]


def stack(frames: list[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("at least one input is needed")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), coerce_mixed(frames))


def merge_union_all(inputs: list[tuple[DataFrame, str | None]],
                    label_column: str = "source_label") -> DataFrame:
    """Stack inputs, missing columns null. An input with a label gets it in
    ``label_column``."""
    return stack([df if label is None else add_constant(df, label_column, label, replace=True)
                  for df, label in inputs])


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    return stack(frames).distinct()
