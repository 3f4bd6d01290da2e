"""Nearest vectors by exact search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from themeloom import params

_GROUP_ROWS = 20_000  # rows of one side in one blocked group
_PAIRS = 500_000_000  # pairs compared in one task
_FEW = 100  # items that make no more work of a query than reading it
_SCORES = 4_000_000    # scores held at once inside a task, if there are fewer items than that


def _prepared(items: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray | None]:
    """What a similarity needs of the items, worked out once: unit rows, or the rows and their squares."""
    if metric == "cosine":
        return items / np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-300), None
    if metric == "euclidean":
        return items, (items**2).sum(1)
    raise ValueError("metric is 'cosine' or 'euclidean'")


def _similarity(queries: np.ndarray, items: np.ndarray, metric: str) -> np.ndarray:
    """Larger is closer: the cosine, or the negated Euclidean distance."""
    return _with_prepared(queries, *_prepared(items, metric))


def _with_prepared(queries: np.ndarray, items: np.ndarray, squares: np.ndarray | None) -> np.ndarray:
    if squares is None:
        q = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)
        return q @ items.T
    square = (queries**2).sum(1)[:, None] + squares[None, :] - 2.0 * (queries @ items.T)
    return -np.sqrt(np.maximum(square, 0.0))


def best_items(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best items per row; ties go to the lower position."""
    k = min(k, scores.shape[1])
    if k == 1:
        return scores.argmax(axis=1)[:, None]
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    row, position = np.nonzero(scores >= kth)  # k or, with ties at the limit, more of each row
    order = np.lexsort((position, -scores[row, position], row))
    starts = np.searchsorted(row[order], np.arange(len(scores)))
    return position[order][starts[:, None] + np.arange(k)]


def _search(query_ids, queries, item_ids, items, k, metric, skip_self, soft=None) -> pd.DataFrame:
    out = []
    items, squares = _prepared(items, metric)
    together = max(1, min(1_000, _SCORES // max(1, len(items))))
    for start in range(0, len(query_ids), together):
        ids = query_ids[start : start + together]
        scores = _with_prepared(queries[start : start + together], items, squares)
        if skip_self:
            scores[ids[:, None] == item_ids[None, :]] = -np.inf
        best = best_items(scores, k)
        if soft is not None:
            scores = np.exp(scores * soft)
            scores /= scores.sum(axis=1, keepdims=True)
        out.append(
            pd.DataFrame(
                {
                    "query": np.repeat(ids, best.shape[1]),
                    "item": item_ids[best].ravel(),
                    "score": np.take_along_axis(scores, best, axis=1).ravel(),
                    "rank": np.tile(np.arange(1, best.shape[1] + 1), len(ids)),
                }
            )
        )
    found = pd.concat(out, ignore_index=True)
    return found[np.isfinite(found["score"])]


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int = 1,
    metric: str = "cosine",
    skip_self: bool = False,
    ship_bytes: int = params.SHIP_BYTES,
    soft: float | None = None,
) -> DataFrame:
    """(query, item, score, rank): the ``k`` closest items of every query.

    Both inputs have ``id`` and ``vector``.  Items whose checked size fits
    ``ship_bytes`` are sent to the tasks; otherwise both sides are hashed into
    blocks of bounded size, each pair of blocks keeps its best ``k`` per query,
    and the partial lists are merged.  Both ways are exact and give the same
    result.  With ``soft`` the scores become each query's soft maximum of
    ``score * soft`` over all items; that needs ``k`` to be the item count.
    """
    schema = "query long, item long, score double, rank int"
    width = len((items.select("vector").first() or [[0.0]])[0])
    row_bytes = 8 * (width + 1)
    count = items.limit(ship_bytes // row_bytes + 1).count()
    if count * row_bytes <= ship_bytes:
        return _shipped(_dealt(queries, count), items, k, metric, skip_self, schema, soft)
    found = _blocked(queries, items, k, metric, skip_self, schema)
    if soft is None:
        return found
    share = F.exp(F.col("score") * soft)
    return found.withColumn("score", share / F.sum(share).over(Window.partitionBy("query")))


def _dealt(queries: DataFrame, items: int) -> DataFrame:
    """The queries in so many tasks that none compares more than about ``_PAIRS`` pairs; with few items they stay."""
    if items <= _FEW:
        return queries
    tasks = -(-queries.count() * items // _PAIRS)
    return queries.repartition(tasks, "id") if tasks > len(queries.inputFiles()) else queries


def _shipped(queries, items, k, metric, skip_self, schema, soft) -> DataFrame:
    rows = items.select(F.col("id").cast("long"), "vector").orderBy("id").toArrow().to_pandas()
    spark = queries.sparkSession
    if rows.empty:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((rows["id"].to_numpy(), np.stack(rows["vector"]).astype(np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item_ids, matrix = sent.value
        for pdf in batches:
            if len(pdf):
                vectors = np.stack(pdf["vector"]).astype(np.float64)
                yield _search(pdf["id"].to_numpy(), vectors, item_ids, matrix, k, metric, skip_self, soft)

    return queries.select(F.col("id").cast("long"), "vector").mapInPandas(run, schema)


def _blocked(queries, items, k, metric, skip_self, schema, group_rows: int = _GROUP_ROWS) -> DataFrame:
    query_blocks = max(1, -(-queries.count() // group_rows))
    item_blocks = max(1, -(-items.count() // group_rows))

    def block(df: DataFrame, side: str, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        return df.select(
            F.col("id").cast("long").alias(f"{side}_id"),
            F.col("vector").alias(f"{side}_vector"),
            F.pmod(F.xxhash64("id"), F.lit(own_blocks)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_blocks - 1).cast("long"))).alias(other),
        )

    left = block(queries, "q", "qb", query_blocks, "ib", item_blocks)
    right = block(items, "i", "ib", item_blocks, "qb", query_blocks)

    def run(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if q.empty or i.empty:
            return pd.DataFrame({"query": [], "item": [], "score": [], "rank": []})
        i = i.sort_values("i_id")
        return _search(
            q["q_id"].to_numpy(), np.stack(q["q_vector"]).astype(np.float64),
            i["i_id"].to_numpy(), np.stack(i["i_vector"]).astype(np.float64), k, metric, skip_self,
        )

    partial = (
        left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInPandas(run, schema)
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return (
        partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query", "item", "score", "rank")
    )
