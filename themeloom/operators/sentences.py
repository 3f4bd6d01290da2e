"""Sentence split by rule.

A sentence ends at ``.``, ``!`` or ``?`` (with closing marks) before white
space and a capital letter, unless the dot belongs to a known abbreviation.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from themeloom import params
from themeloom.operators import rows

# Abbreviations whose dot does not end a sentence.
ABBREVIATIONS = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Rev", "Sr", "Jr", "St", "vs", "etc", "Inc", "Ltd", "Co", "No", "Fig",
)


def boundary(delimiters: Sequence[str] = ()) -> str:
    """Regex of the white space between two sentences.

    Each text of ``delimiters`` also ends a sentence, whatever follows.
    """
    short = "|".join(ABBREVIATIONS)
    rule = (
        r"(?=\s)(?<=[.!?][\"')\]]{0,4})(?<!\b(?:" + short + r")\.)"
        r"\s+(?=[\"'(\[]{0,4}\p{Lu})"
    )
    extra = [r"(?=\s)(?<=" + _quoted(d) + r")\s+" for d in delimiters]
    return "|".join([rule, *extra])


def _quoted(delimiter: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", delimiter)


def split_sentences(
    df: DataFrame,
    column: str,
    document_index: str = "document_index",
    delimiters: Sequence[str] = (),
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per sentence with its parent ids and position; other columns go
    unless named in ``carry``."""
    ids = [c for c in ("original_index", document_index) if c in df.columns]
    ids = list(dict.fromkeys([*ids, *carry]))
    parts = F.split(F.col(column), boundary(delimiters), -1)
    return (
        df.select(*ids, F.posexplode(parts).alias("sentence_pos", column))
        .filter(F.col(column) != "")
    )


def sentence_table(
    df: DataFrame,
    column: str,
    document_index: str = "document_index",
    longer_than: int = params.MIN_SENTENCE_LENGTH,
    delimiters: Sequence[str] = (),
) -> DataFrame:
    """Split, drop short sentences, strip, and number what is left densely."""
    split = split_sentences(df, column, document_index, delimiters)
    kept = rows.longer_than(split, column, longer_than)
    return rows.number_rows(kept, [document_index, "sentence_pos"], "sentence_index")
