"""Texts of a table as Arrow batches, and word hashes shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from themeloom.session import spread

#: Most entries of a worker's cache of words.  Frequent words come early, so a full cache stays as it is.
CACHE_WORDS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of ``documents``, on all cores if it comes in few small files."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, function: Callable, schema: str, rows: int | None = None) -> DataFrame:
    """``mapInArrow`` with a ``function`` of one batch that returns the columns by name.

    A value may be an Arrow array or anything ``pyarrow.array`` takes for the type in ``schema``.  With ``rows`` a batch
    is handled in slices of so many rows, which bounds what a task holds of its output.
    """
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), rows or max(batch.num_rows, 1)):
                found = function(batch.slice(start, rows))
                yield pa.RecordBatch.from_arrays(
                    [x.cast(f.type) if isinstance(x := found[f.name], pa.Array) else pa.array(x, f.type) for f in shape], schema=shape
                )
                found = None
                pa.default_memory_pool().release_unused()
            batch = None

    return df.mapInArrow(run, schema)


def map_texts(docs: DataFrame, function: Callable[[list[bytes]], object], added: str, doc_id: str = "doc_id", text: str = "text",
              keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep`` and the column ``added`` (name and type) that ``function`` gives for a batch of texts.

    The text goes to the workers once, also if it is kept.
    """
    names = [n for n in keep if n != text]
    sent = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("doc_id"), *names)
    again = [text] if text in keep else []
    types = dict(sent.dtypes)
    kinds = ", ".join(f"`{n}` {types[n]}" for n in ["doc_id", *names]) + "".join(f", `{n}` {types['_text']}" for n in again)

    def run(batch: pa.RecordBatch) -> dict:
        columns = {n: batch.column(i) for i, n in enumerate(["doc_id", *names], 1)} | {n: batch.column(0) for n in again}
        return columns | {added.split()[0]: function(raw_texts(batch.column(0)))}

    return map_batches(sent, run, f"{kinds}, {added}")


def array_of_lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy arrays, without a Python object for each value."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


class WordHashes(dict):
    """64-bit hashes of words (bytes), each worked out once while the cache holds it."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()
#: Caches a worker may hold from tasks of several operators.
CACHES: list[dict] = [WORDS]


def leave_only(*kept: dict) -> None:
    """Empty the caches of other operators, which an earlier stage in this worker filled."""
    for cache in CACHES:
        if not any(cache is k for k in kept):
            cache.clear()


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def chained(hashes: np.ndarray, n: int, gap: int = 1) -> np.ndarray:
    """Hashes of all sequences of ``n`` words that stand ``gap`` apart."""
    count = len(hashes) - (n - 1) * gap
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count]
    for k in range(1, n):
        out = mixed(out * _ODD + hashes[k * gap: k * gap + count])
    return mixed(out + np.uint64(n * 1_000 + gap))


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted hashes of the distinct ``n``-word shingles of a text.

    A-Z are lower-cased and words end at ASCII white space.  Fewer than ``n`` words make one shingle, no word none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(chained(WORDS.of(words), min(n, len(words))))
