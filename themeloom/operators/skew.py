"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HOT_KEYS = 10_000
EASY_ROWS = 1_000_000  # rows of one key that are no burden for a task
ROW_BYTES = 192  # of a sent row beside its texts


def join_counted(left: DataFrame, right: DataFrame, on: Sequence[str], rows: str) -> DataFrame:
    """Inner join of ``left`` with a stored table of unique keys, in which the
    column ``rows`` is at least the number of left rows of each key.

    Keys with more than a 10,000th of the total are fewer than 10,000, so they
    are sent to the tasks and their rows never meet in one; the other keys are
    shuffled, none of them large.  With no key of over a million rows this is a
    plain join.
    """
    parts = joined_parts(left, right, on, rows)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def joined_parts(left: DataFrame, right: DataFrame, on: Sequence[str], rows: str, ship: int = 0) -> list[DataFrame]:
    """The parts of ``join_counted``, which have no key in common; one that is shuffled stays dealt by the keys.

    With ``ship`` the keys with the most rows are sent in any case, as many as fit so many bytes, and all if they fit.
    """
    on = list(on)
    total, largest = right.agg(F.sum(rows), F.max(rows)).first()
    least = max((total or 0) / HOT_KEYS, EASY_ROWS)
    if ship:
        most = _shipped(right, rows, ship)
        if most is None:
            return [left.join(F.broadcast(right), on)]
        least = min(least, most)
    if (largest or 0) <= least:
        return [left.join(right, on)]
    hot = F.col(rows) > least
    few = right.filter(hot)
    rest = left.join(F.broadcast(few.select(*on)), on, "left_anti").join(right.filter(~hot), on)
    return [left.join(F.broadcast(few), on), rest]


def _shipped(right: DataFrame, rows: str, ship: int) -> int | None:
    """The number of rows above which keys fit ``ship`` bytes; none if all keys fit.

    Distinct numbers of rows are few: no more than the root of twice their sum.
    """
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in right.schema.fields if f.dataType.simpleString() == "string"]
    size = sum(texts, F.lit(ROW_BYTES))
    for count, bytes_ in right.groupBy(rows).agg(F.sum(size).alias("_size")).orderBy(F.desc(rows)).collect():
        ship -= bytes_
        if ship < 0:
            return count
    return None
