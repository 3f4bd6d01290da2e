"""Exact de-duplication.

Rows are grouped on a SHA-256 of the text, and the aggregate combines on the
map side, so a text copied into a third of all rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from themeloom.operators import rows


def text_key(column: str) -> Column:
    return F.sha2(F.col(column), 256)


def keep_first(df: DataFrame, column: str, order: str) -> DataFrame:
    """One row per distinct text: the one with the smallest ``order`` (unique).

    Null texts count as one value, as any other.
    """
    firsts = df.groupBy(text_key(column).alias("_key")).agg(F.min(order).alias(order))
    return df.join(firsts.select(order), order, "left_semi").select(*df.columns)


def prepare(df: DataFrame, column: str, order: str, length: int | None = None) -> DataFrame:
    """Strip, drop short texts, keep the first copy of each, drop nulls."""
    long_enough = rows.at_least_length(df, column) if length is None else rows.at_least_length(df, column, length)
    return rows.drop_null(keep_first(long_enough, column, order), column)


def later_copies(df: DataFrame, column: str, order: str) -> DataFrame:
    """Ids of the second and later copies; joined on the unique id, so no hot key."""
    firsts = df.groupBy(text_key(column).alias("_key")).agg(F.min(order).alias(order))
    return df.select(order).join(firsts.select(order), order, "left_anti")


def keep_unrepeated(df: DataFrame, column: str, order: str) -> DataFrame:
    """Rows whose text occurs once and is not empty."""
    single = (
        df.groupBy(text_key(column).alias("_key"))
        .agg(F.count("*").alias("_copies"), F.min(order).alias(order))
        .filter("_copies = 1")
    )
    return rows.drop_blank(df.join(single.select(order), order, "left_semi").select(*df.columns), column)


def repeated_ids(df: DataFrame, column: str, order: str) -> DataFrame:
    """Ids of all rows whose text occurs more than once."""
    single = (
        df.groupBy(text_key(column).alias("_key"))
        .agg(F.count("*").alias("_copies"), F.min(order).alias(order))
        .filter("_copies = 1")
    )
    return df.select(order).join(single.select(order), order, "left_anti")


def one_per_topic(df: DataFrame, column: str = "topic") -> DataFrame:
    """One row per topic of a table whose rows agree within a topic."""
    return df.dropDuplicates([column])
