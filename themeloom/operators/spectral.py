"""Reduction by the neighbour graph: its leading eigenvectors, by filtered subspace iteration on a table of edges.

Each vector weighs its neighbours by exp(-(distance - nearest distance) / scale), with the scale at which its weights sum
to the logarithm (base 2) of their number; the two weights a, b of a pair become a + b - ab.  With W these weights and D the
row sums, the coordinates are the leading eigenvectors of D^-1/2 W D^-1/2, without the constant one, divided by D^1/2: they change
slowly along the data, however the data bend in their space, which no linear map can follow.

A multiplication is a join of edges and rows by id and a sum by id, with partial sums before the shuffle.  A round is a Chebyshev
polynomial of the matrix, which lifts what lies above the block's smallest Ritz value; a (p x p) eigenproblem on the driver, with p = ``k``
plus ``EXTRA``, then turns the block.  Rounds end when all residuals of the first ``k`` are below ``tolerance``
times the distance of the ``k``-th Ritz value from 1 (slow coordinates differ by that little), or after ``ROUNDS``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from themeloom import params
from themeloom.functions import arrays
from themeloom.operators import linalg
from themeloom.operators.forest import forest_neighbours
from themeloom.session import store

EXTRA = 5
DEGREE = 10
ROUNDS = 12
TOLERANCE = 0.1
_STEPS = 40
_ROUNDING = 1e-7


def _scale(gaps: Column, mean: Column, target: Column) -> Column:
    """The scale at which exp(-gap / scale) sums to ``target``, by halving between a 1,000th and 1,000 times ``mean``."""
    total = lambda at: F.aggregate(gaps, F.lit(0.0), lambda s, g: s + F.exp(-g / (mean * F.exp(at))))
    span = F.lit(float(np.log(1_000.0)))

    def step(acc, _):
        middle = (acc["low"] + acc["high"]) / 2
        return F.when(total(middle) > target, F.struct(acc["low"].alias("low"), middle.alias("high"))).otherwise(
            F.struct(middle.alias("low"), acc["high"].alias("high")))

    start = F.struct((-span).alias("low"), span.alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, step, lambda acc: mean * F.exp((acc["low"] + acc["high"]) / 2))


def fuzzy_graph(points: DataFrame, neighbours: int = params.NEIGHBOURS, leaf: int = params.FOREST_LEAF,
                trees: int = params.FOREST_TREES) -> DataFrame:
    """(a, b, weight) with both directions of each edge; ``points`` are distinct vectors with a unique ``id``."""
    found = forest_neighbours(points, neighbours, leaf, trees)
    near = found.groupBy("query").agg(F.collect_list(F.struct("item", "distance")).alias("near"), F.min("distance").alias("least"),
                                      F.avg("distance").alias("mean"))  # ``neighbours`` entries at most
    gaps = F.transform("near", lambda n: n["distance"] - F.col("least"))
    scaled = near.withColumn("scale", _scale(gaps, F.col("mean"), F.log2(F.size("near").cast("double"))))
    one = scaled.select("query", F.explode("near").alias("n"), "least", "scale").select(
        F.least("query", "n.item").alias("a"), F.greatest("query", "n.item").alias("b"),
        F.exp(-(F.col("n.distance") - F.col("least")) / F.col("scale")).alias("w"))
    both = one.groupBy("a", "b").agg((F.sum("w") - F.when(F.count("*") > 1, F.max("w") * F.min("w")).otherwise(0.0)).alias("weight"))
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.select(F.explode(ends).alias("e"), "weight").select("e.a", "e.b", "weight")


def normalised(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, s, own) of the normalised matrix, with a row ``own`` = 1 for each point, and (id, root): its constant eigenvector."""
    degrees = store(graph.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("degree")), "degrees")
    total = degrees.agg(F.sum("degree")).first()[0] or 1.0
    side = lambda c: degrees.select(F.col("id").alias(c), F.col("degree").alias(f"degree_{c}"))
    edges = graph.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", (F.col("weight") / F.sqrt(F.col("degree_a") * F.col("degree_b"))).alias("s"), F.lit(0.0).alias("own"))
    loops = degrees.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("s"), F.lit(1.0).alias("own"))
    return store(edges.unionByName(loops), "edges"), degrees.select("id", F.sqrt(F.col("degree") / total).alias("root"))


def _times(edges: DataFrame, state: DataFrame, width: int, factor: float, shift: float, back: float) -> DataFrame:
    """(id, x, y) with ``factor`` (S - ``shift``) x - ``back`` y for x, and x for y."""
    c, own = F.lit(factor) * (F.col("s") - F.lit(shift) * F.col("own")), F.col("own")
    sums = [F.sum(c * F.col(f"x{j}") - F.lit(back) * own * F.col(f"y{j}")).alias(f"x{j}") for j in range(width)]
    kept = [F.sum(own * F.col(f"x{j}")).alias(f"y{j}") for j in range(width)]
    return edges.join(state.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(*sums, *kept)


def _ritz(moments: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values in descending order, their residuals, the turn of the block, and the block's share of the constant vector.

    ``moments`` are the products of (root, y, S y).  Directions that the block holds to rounding only are left out.
    """
    share = moments[0, 1: width + 1]
    constant = np.outer(share, share)
    y, sy = slice(1, width + 1), slice(width + 1, 2 * width + 1)
    gram, form, square = moments[y, y] - constant, moments[y, sy] - constant, moments[sy, sy] - constant
    size = np.sqrt(np.maximum(np.diag(moments[y, y]), 1e-300))
    value, vector = np.linalg.eigh(gram / np.outer(size, size))
    held = value > 1e-10
    basis = vector[:, held] / np.sqrt(value[held]) / size[:, None]
    inner = basis.T @ form @ basis
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    turn = basis @ vector[:, ::-1]
    value = value[::-1]
    turn = turn * np.where(turn[np.abs(turn).argmax(0), np.arange(turn.shape[1])] < 0, -1.0, 1.0) if turn.size else turn
    residual = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, square, turn) - value**2, 0.0))
    return value, residual, turn, share


def _turned(weights: np.ndarray, share: np.ndarray) -> Column:
    parts = [F.lit(float(w)) * (F.col(f"y{j}") - F.lit(float(u)) * F.col("root")) for j, (w, u) in enumerate(zip(weights, share))]
    return sum(parts[1:], parts[0])


def eigenvectors(edges: DataFrame, roots: DataFrame, k: int, seed: int = params.SEED, tolerance: float = TOLERANCE,
                 rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(id, root, vector) with up to ``k`` orthonormal components, their eigenvalues and residuals."""
    width = k + EXTRA
    start = [(F.xxhash64("id", F.lit(seed), F.lit(j)) / F.lit(2.0**63) * F.col("root")).alias(f"x{j}") for j in range(width)]
    state = roots.select("id", *start, *[F.lit(0.0).alias(f"y{j}") for j in range(width)])
    for turn_no in range(rounds + 1):
        image = store(_times(edges, state, width, 1.0, 0.0, 0.0).join(roots, "id"), "block")
        columns = [F.col("root"), *[F.col(f"y{j}") for j in range(width)], *[F.col(f"x{j}") for j in range(width)]]
        moments = np.zeros((2 * width + 1, 2 * width + 1))
        for row in linalg.gram(image.select(F.array(*columns).alias("v")), "v", 2 * width + 1).collect():
            moments[row["i"], row["j"]] = moments[row["j"], row["i"]] = row["value"]
        values, residuals, turn, share = _ritz(moments, width)
        if turn_no == rounds or not len(values) or len(values) <= k or residuals[:k].max() <= tolerance * (1.0 - values[k - 1]) + _ROUNDING:
            count = min(k, len(values))
            found = image.select("id", "root", F.array(*[_turned(turn[:, i], share) for i in range(count)]).cast("array<double>").alias("vector"))
            return found, values[:count], residuals[:count]
        width = len(values)
        middle, half = (values[-1] - 1.0) / 2, (values[-1] + 1.0) / 2 + 1e-12
        state = image.select("id", *[_turned(turn[:, i], share).alias(f"x{i}") for i in range(width)], *[F.lit(0.0).alias(f"y{i}") for i in range(width)])
        for step in range(DEGREE):
            state = _times(edges, state, width, (1.0 if step == 0 else 2.0) / half, middle, 0.0 if step == 0 else 1.0)
            if step % 5 == 4:
                state = store(state, "block")
    raise AssertionError


def graph_coordinates(vectors: DataFrame, k: int = params.CLUSTER_DIMENSIONS, neighbours: int = params.NEIGHBOURS,
                      leaf: int = params.FOREST_LEAF, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, vector): ``k`` coordinates of each document with a vector; lengths of vectors do not matter.

    Copies get equal coordinates.  Coordinates that the graph does not have, as with fewer vectors than ``k`` + 1, are 0.
    Rows with a null vector are left out, an empty table gives no rows.  Parts without an edge between them differ
    in the first coordinates, which are constant on each part.
    """
    normal = vectors.filter("vector IS NOT NULL").select("doc_id", arrays.unit(F.col("vector").cast("array<double>")).alias("vector"))
    normal = store(normal, "unit")
    points = store(normal.groupBy("vector").agg(F.min("doc_id").cast("long").alias("id")), "points")
    if len(points.take(2)) < 2:
        return normal.select("doc_id", F.array_repeat(F.lit(0.0), k).alias("vector"))
    edges, roots = normalised(store(fuzzy_graph(points, neighbours, leaf), "graph"))
    found, values, _ = eigenvectors(edges, roots, k, tolerance=tolerance)
    rest = F.array_repeat(F.lit(0.0), k - len(values))
    placed = found.select("id", F.concat(F.transform("vector", lambda x: x / F.col("root")), rest).alias("placed"))
    by_vector = points.join(placed, "id").select("vector", "placed")
    return normal.join(by_vector, "vector").select("doc_id", F.col("placed").alias("vector"))
