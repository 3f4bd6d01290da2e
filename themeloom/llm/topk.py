"""Exact top-k inner products over vectors sorted by length, with rotated partial sums.

Components become the integers ``floor(scale * x)``.  Vectors are rotated by the singular vectors of all rows (from their
Gram matrix), which moves most of their length into the first coordinates.  A task holds a chunk of candidates by
descending length and a chunk of queries.  For a query it goes down the candidates block by block, sums up the first
``HEAD`` rotated coordinates, and adds |rest of query| |rest of candidate| as the Cauchy-Schwarz bound of what is
missing; candidates whose bound is below the query's k-th best score are dropped, and the scan ends where the product of
lengths is below it.  Survivors are scored with the integers.  The k-th best starts from the ``LEAD`` longest vectors of
the whole table, which every task gets (a fixed number of rows).

Chunks of candidates and of queries have a bounded size, and each task takes one pair of chunks: no side is gathered or
broadcast whole.

Vectors that are null, empty or hold a null or non-finite component, and rows without id, take no part.  Shorter vectors
count as padded with zeros.  Rows that share an id are candidates each, a query is one row of its id (the smallest).
Ties go to the smaller id.  Integers are 64 bits wide: components beyond 2**62 / scale are cut there and scores beyond 64
bits wrap.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from themeloom.session import store

HEAD = 24
BLOCK = 2_048
LEAD = 512
CANDIDATES_PER_TASK = 32_768
QUERIES_PER_TASK = 4_096


def _integers(lists, width: int) -> np.ndarray:
    """int64 rows padded with zeros to ``width``."""
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; in doubles where every partial sum stays below 2**53."""
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if exact else a @ b.T


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


class Searcher:
    def __init__(self, rotation: np.ndarray, lead: np.ndarray, lead_ids: np.ndarray, k: int):
        self.rotation, self.lead, self.lead_ids, self.k = rotation, lead, lead_ids, k

    def search(self, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> list[tuple]:
        """(query, candidate, score) of the best ``k`` candidates of this chunk that can be among the best of all."""
        k, width = self.k, rows.shape[1]
        norms = _lengths(rows.astype(float))
        order = np.lexsort((ids, -norms))
        ids, rows, norms = ids[order], rows[order], norms[order]
        qnorms = _lengths(queries.astype(float))
        turned, asked = rows.astype(float) @ self.rotation, queries.astype(float) @ self.rotation
        head = min(HEAD, width)
        rest, qrest = _lengths(turned[:, head:]), _lengths(asked[:, head:])
        largest = max(norms.max(initial=0), _lengths(self.lead.astype(float)).max(initial=0)) * qnorms.max(initial=0)
        exact = largest < 2.0 ** 52
        slack = 1e-9 * qnorms  # rounding of the rotated sums, by length of the candidate
        floor = np.full(len(queries), -np.inf)
        first = _products(queries, self.lead, exact)
        first = np.where(query_ids[:, None] == self.lead_ids[None, :], np.iinfo(np.int64).min, first)
        others = (query_ids[:, None] != self.lead_ids[None, :]).sum(axis=1)
        if first.shape[1] >= k:
            kth = np.partition(first, first.shape[1] - k, axis=1)[:, first.shape[1] - k].astype(float)
            floor = np.where(others >= k, kth, -np.inf)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        active = np.arange(len(queries))
        for start in range(0, len(rows), BLOCK):
            block = slice(start, start + BLOCK)
            active = active[qnorms[active] * norms[start] * (1 + 1e-9) >= floor[active]]
            if not len(active):
                break
            for some in np.array_split(active, max(1, len(active) // 512)):
                bound = asked[some, :head] @ turned[block, :head].T
                bound += np.outer(qrest[some], rest[block]) + np.outer(slack[some], norms[block])
                alive = bound >= floor[some][:, None]
                for q, row in zip(some.tolist(), alive):
                    at = start + np.flatnonzero(row)
                    at = at[ids[at] != query_ids[q]]
                    if not len(at):
                        continue
                    score = np.concatenate([best[q][1], _products(queries[q: q + 1], rows[at], exact)[0]])
                    found = np.concatenate([best[q][0], ids[at]])
                    top = np.lexsort((found, -score))[:k]
                    best[q] = (found[top], score[top])
                    if len(top) == k:
                        floor[q] = max(floor[q], float(score[top[-1]]))
        return [(int(q), int(c), int(s)) for q, (found, score) in zip(query_ids, best) for c, s in zip(found, score)]


def top_inner_products(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, vec_id: str = "vec_id",
                       vector: str = "embedding", per_task: int = CANDIDATES_PER_TASK, queries_per_task: int = QUERIES_PER_TASK) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each id divisible by ``every`` the ``k`` other rows with the largest inner product."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.filter("id IS NOT NULL AND size(x) > 0 AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('inf'))")
    edge = float(2 ** 62)
    rows = rows.select("id", F.transform("x", lambda c: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), c * scale))).cast("bigint")).alias("x"))
    rows = store(rows.withColumn("norm", F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))), "integers")
    facts = rows.agg(F.max(F.size("x")).alias("width"), F.count("*").alias("n"), F.sum(F.when(F.col("id") % every == 0, 1)).alias("asked")).first()
    shape = "query_id bigint, vec_id bigint, score bigint"
    if not facts["n"] or not facts["asked"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = facts["width"]

    def gram(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _integers(batch.column(0).to_pylist(), width).astype(float)
            total += x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    sums = rows.select("x").mapInArrow(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    square = np.zeros((width, width))
    square[sums["i"], sums["j"]] = sums["s"]
    values, basis = np.linalg.eigh((square + square.T) / 2)
    longest = rows.orderBy(F.desc("norm"), "id", "x").limit(LEAD).select("id", "x").collect()
    searcher = Searcher(basis[:, np.argsort(-values)], _integers([r["x"] for r in longest], width), np.array([r["id"] for r in longest]), k)
    sent = spark.sparkContext.broadcast(searcher)

    parts = max(1, -(-facts["n"] // per_task), min(facts["n"] // 1_024, spark.sparkContext.defaultParallelism))
    groups = max(1, -(-facts["asked"] // queries_per_task))
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x"))
    candidates = rows.select(F.pmod(F.xxhash64("id", "x"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("side"), "id", "x")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("side"), "id", "x")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        right = right.sort_values("id")
        got = sent.value.search(left["id"].to_numpy(), _integers(left["x"], width), right["id"].to_numpy(), _integers(right["x"], width))
        return pd.DataFrame(np.array(got, np.int64).reshape(-1, 3), columns=["query_id", "vec_id", "score"])

    found = candidates.groupBy("part", "side").cogroup(asked.groupBy("part", "side")).applyInPandas(meet, shape)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
