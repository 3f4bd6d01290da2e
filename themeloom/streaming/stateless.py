"""The row-wise steps on a stream.

They keep no state, so the batch expressions are used as they are; dropping
copies needs a watermark to bound its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from themeloom.functions import text
from themeloom.operators import pii, rows


def clean_stream(stream: DataFrame, column: str, anonymise: bool = False) -> DataFrame:
    """Clean text and drop short rows; redact pattern entities if asked."""
    cleaned = rows.at_least_length(stream.withColumn(column, text.clean(F.col(column))), column)
    return pii.anonymise(cleaned, [column]) if anonymise else cleaned


def drop_copies(stream: DataFrame, column: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first copy of each text within the watermark delay."""
    keyed = stream.withWatermark(time, delay).withColumn("_key", F.sha2(column, 256))
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")
