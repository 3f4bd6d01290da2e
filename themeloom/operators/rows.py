"""Row ids, projection and simple filters."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from themeloom import params
from themeloom.functions import text
from themeloom.session import store

_ROW_BITS = 33  # monotonically_increasing_id keeps the row within a partition in these low bits


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Dense 0-based numbers in the order of unique ``order`` columns.

    A range shuffle sorts the rows; partition-local numbers are stored once, so
    a recomputed task cannot change them, and the per-partition starts (one row
    per partition) are added.  No task holds more than its range.
    """
    marked = df.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id())
    stored = store(marked, "numbered")
    part = F.shiftright("_mark", _ROW_BITS)
    sizes = stored.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect()
    starts, total = {}, 0
    for row in sorted(sizes, key=lambda r: r["part"]):
        starts[row["part"]] = total
        total += row["rows"]
    local = F.col("_mark").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    offsets = df.sparkSession.createDataFrame(
        [(int(p), int(s)) for p, s in starts.items()], "_part long, _start long"
    )
    numbered = stored.withColumn("_part", part.cast(LongType())).join(F.broadcast(offsets), "_part")
    return numbered.select(*df.columns, (F.col("_start") + local).alias(name))


def add_row_id(df: DataFrame, order: Sequence[str] | None = None, name: str = "original_index") -> DataFrame:
    """Keep the id the table already has; otherwise number the rows by ``order``."""
    if name in df.columns:
        return df
    if not order:
        raise ValueError("name the columns that fix the row order")
    return number_rows(df, list(order), name)


def renumber(df: DataFrame, by: str = "original_index", name: str = "document_index") -> DataFrame:
    """Dense row numbers after a filter, in source order."""
    return number_rows(df, [by], name)


def with_columns(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Replace the named columns; other columns and the order stay."""
    missing = [c for c in changes if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumns(changes).select(*df.columns)


def with_value(df: DataFrame, column: str, value: Column) -> DataFrame:
    """``column`` replaced by a costly ``value``.

    A filter on a plain projection is pushed below it and works the value out
    again; a filter on a generated column stays above.
    """
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.explode(F.array(value)).alias(column)).select(*df.columns)


def at_least_length(df: DataFrame, column: str, length: int = params.MIN_TEXT_LENGTH) -> DataFrame:
    """Rows whose stripped text has ``length`` or more characters; text is stripped."""
    return with_value(df, column, text.strip(F.col(column))).filter(F.length(column) >= length)


def longer_than(df: DataFrame, column: str, length: int = params.MIN_SENTENCE_LENGTH) -> DataFrame:
    """Rows longer than ``length`` before stripping; kept text is then stripped."""
    return df.filter(F.length(column) > length).withColumn(column, text.strip(F.col(column)))


def drop_null(df: DataFrame, column: str) -> DataFrame:
    return df.dropna(subset=[column])


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) != "")


def as_label_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def keep_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def in_topics(df: DataFrame, topics: Iterable[int] | DataFrame, column: str = "topic") -> DataFrame:
    """Rows of the given topics: a short list, or a table with a ``topic`` column."""
    if isinstance(topics, DataFrame):
        keys = topics.select(F.col("topic").alias(column)).distinct()
        return df.join(keys, column, "left_semi")
    return df.filter(F.col(column).isin(list(topics)))


def without_outliers(df: DataFrame, column: str = "topic") -> DataFrame:
    return df.filter(F.col(column) != params.OUTLIER)


def with_coordinates(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["x", "y"])


def columns_like(df: DataFrame, pattern: str = r"topic|^level") -> DataFrame:
    return df.select(*[c for c in df.columns if re.search(pattern, c)])
