"""Neighbours of all points of a table by a forest of random-direction trees.

A tree cuts the points into cells of about ``leaf`` rows: at each level every cell is cut at the quantiles of its points'
projections on one random direction, so cells stay equally full however dense the points lie.  The cuts of a level are a
table with a row for each cell and are joined by cell.  Inside a cell all pairs are compared; the best ``k`` of all trees
are merged.  A table that fits one cell is searched exactly.  The work is n * leaf * trees comparisons and one shuffle of
the points for each level and tree; nothing of the points is sent to the driver or to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from themeloom import params
from themeloom.operators.neighbors import best_items
from themeloom.session import store

_SCHEMA = "query long, item long, distance double"


def _directions(width: int, tree: int, levels: int, seed: int) -> np.ndarray:
    """Orthonormal directions of a tree; more levels than dimensions start a new turn of the space."""
    rng = np.random.default_rng((seed, tree))
    turns = [np.linalg.qr(rng.normal(size=(width, width)))[0].T for _ in range(-(-levels // width))]
    return np.concatenate(turns)[:levels]


def _projected(points: DataFrame, width: int, trees: int, levels: int, seed: int) -> DataFrame:
    """(tree, id, vector, p): a row for each tree with the projections of its levels."""
    every = [_directions(width, t, levels, seed) for t in range(trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            for tree, directions in enumerate(every):
                flat = pa.array((matrix @ directions.T).ravel())
                steps = pa.array(np.arange(0, batch.num_rows * levels + 1, levels, dtype=np.int32))
                columns = [pa.array(np.full(batch.num_rows, tree, np.int32)), batch.column(0), batch.column(1), pa.ListArray.from_arrays(steps, flat)]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "id", "vector", "p"])

    return points.mapInArrow(run, "tree int, id long, vector array<double>, p array<double>")


def cells(points: DataFrame, leaf: int, trees: int, seed: int = params.SEED) -> DataFrame:
    """(tree, cell, id, vector): every point once in each tree, in cells of about ``leaf`` rows."""
    n = points.count()
    if n <= leaf:
        return points.select(F.lit(0).alias("tree"), F.lit(0).cast("long").alias("cell"), "id", "vector")
    parts = -(-n // leaf)
    ways = max(2, math.ceil(parts ** (1 / 6)))
    levels = math.ceil(math.log(parts) / math.log(ways) - 1e-9)
    width = len(points.select("vector").first()[0])
    found = store(_projected(points, width, trees, levels, seed).withColumn("cell", F.lit(0).cast("long")), "forest")
    shares = [i / ways for i in range(1, ways)]
    for level in range(levels):
        at = F.col("p")[level]
        cuts = found.groupBy("tree", "cell").agg(F.percentile_approx(at, shares, 1_000).alias("cuts"))
        place = F.size(F.filter("cuts", lambda c: c < F.col("p")[level]))
        found = found.join(cuts, ["tree", "cell"]).select("tree", (F.col("cell") * ways + place).alias("cell"), "id", "vector", "p")
        found = store(found, "forest")
    return found.select("tree", "cell", "id", "vector")


def _closest(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    ids = frame["id"].to_numpy()
    order = np.argsort(ids)
    ids, matrix = ids[order], np.stack(frame["vector"].to_numpy()[order]).astype(np.float64)
    square = (matrix**2).sum(1)
    out, step = [], max(1, 2_000_000 // len(ids))
    for start in range(0, len(ids), step):
        part = slice(start, start + step)
        distance = square[part, None] + square[None, :] - 2.0 * (matrix[part] @ matrix.T)
        distance[np.arange(len(distance)), np.arange(start, start + len(distance))] = np.inf
        best = best_items(-distance, min(k, len(ids) - 1)) if len(ids) > 1 else np.zeros((len(distance), 0), int)
        rows = np.repeat(np.arange(len(distance)) + start, best.shape[1])
        exact = np.sqrt(((matrix[rows] - matrix[best.ravel()]) ** 2).sum(1))  # no cancellation
        out.append(pd.DataFrame({"query": ids[rows], "item": ids[best.ravel()], "distance": exact}))
    return pd.concat(out, ignore_index=True)


def forest_neighbours(points: DataFrame, k: int, leaf: int = params.FOREST_LEAF, trees: int = params.FOREST_TREES,
                      seed: int = params.SEED) -> DataFrame:
    """(query, item, distance, rank): about the ``k`` closest other points of every point by Euclidean distance.

    ``points`` have a unique ``id`` and a ``vector``.  Ties go to the smaller id.
    """
    dealt = cells(points.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")), max(leaf, 2 * k), trees, seed)
    found = dealt.groupBy("tree", "cell").applyInPandas(lambda frame: _closest(frame, k), _SCHEMA)
    once = found.groupBy("query", "item").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query").orderBy("distance", "item")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
