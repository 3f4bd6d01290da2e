"""The cleaning chain: one lazy plan from a raw table to clean text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from themeloom import params
from themeloom.functions import text
from themeloom.operators import dedup, pii, rows, sentences


def clean_table(
    df: DataFrame,
    column: str,
    order: Sequence[str],
    clean: bool = True,
    patterns: Sequence[str] = (),
    deduplicate: bool = True,
    anonymise: bool = False,
    names: DataFrame | None = None,
    split: bool = False,
    min_sentence_length: int = params.MIN_SENTENCE_LENGTH,
    plain_marks: bool = False,
) -> DataFrame:
    """Row id, cleaning, caller patterns, de-duplication, redaction and sentence
    split, each as asked for.  ``order`` fixes the row numbers; ``names`` (name, entity) are redacted with the patterns."""
    df = rows.add_row_id(df, order)
    value = F.col(column)
    if plain_marks:
        value = text.plain_marks(value)
    if clean:
        value = text.clean(value)
    if patterns:
        value = text.remove_patterns(value, patterns)
    df = rows.with_columns(df, {column: value})
    if deduplicate:
        df = dedup.prepare(df, column, "original_index")
    if anonymise:
        df = pii.anonymise(df, [column], "redact", names=names, doc="original_index")
    if deduplicate or split:
        df = rows.renumber(df)
    if split:
        df = sentences.sentence_table(df, column, longer_than=min_sentence_length)
    return df
