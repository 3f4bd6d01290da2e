"""Neighbour-graph reduction against dense numpy and the linear map."""

import numpy as np
import pandas as pd

from themeloom.operators import spectral, topics


def table(spark, matrix):
    frame = pd.DataFrame({"doc_id": np.arange(len(matrix)), "vector": [list(map(float, v)) for v in matrix]})
    return spark.createDataFrame(frame, "doc_id long, vector array<double>").repartition(4)


def matrix_of(df):
    return np.array([r["vector"] for r in sorted(df.collect(), key=lambda r: r["doc_id"])])


def bent(n, width=12, seed=0):
    """Unit vectors along a curve that turns through many dimensions."""
    t = np.sort(np.random.default_rng(seed).uniform(0, 1, n))
    turns = np.arange(1, width // 2 + 1)
    m = np.concatenate([np.cos(np.outer(t, turns) * 3.0), np.sin(np.outer(t, turns) * 3.0)], axis=1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def ranks(m):
    d = ((m[:, None] - m[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return d.argsort(1, kind="stable")


def trustworthiness(high, low, k=10):
    n = len(high)
    place = np.empty((n, n), int)
    order = ranks(high)
    place[np.arange(n)[:, None], order] = np.arange(1, n + 1)
    near = ranks(low)[:, :k]
    excess = np.maximum(place[np.arange(n)[:, None], near] - k, 0).sum()
    return 1 - 2 * excess / (n * k * (2 * n - 3 * k - 1))


def plain_graph(m, k):
    n = len(m)
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    w = np.zeros((n, n))
    for i, near in enumerate(ranks(m)[:, :k]):
        gap, mean = d[i, near] - d[i, near].min(), d[i, near].mean()
        low, high = mean / 1000, mean * 1000
        for _ in range(100):
            middle = np.sqrt(low * high)
            low, high = (low, middle) if np.exp(-gap / middle).sum() > np.log2(k) else (middle, high)
        w[i, near] = np.exp(-gap / middle)
    return w + w.T - w * w.T


def test_graph_and_eigenvalues_equal_numpy(spark):
    m = np.random.default_rng(3).normal(size=(150, 4))
    points = table(spark, m).withColumnRenamed("doc_id", "id")
    graph = spectral.fuzzy_graph(points, 8)
    got = np.zeros((150, 150))
    for r in graph.collect():
        got[r["a"], r["b"]] = r["weight"]
    want = plain_graph(m, 8)
    assert np.allclose(got, want, atol=1e-6)
    edges, roots = spectral.normalised(graph)
    found, values, residuals = spectral.eigenvectors(edges, roots, 3, tolerance=1e-2)
    degree = want.sum(1)
    s = want / np.sqrt(np.outer(degree, degree))
    assert np.allclose(values, np.linalg.eigvalsh(s)[::-1][1:4], atol=1e-4) and residuals.max() <= 1e-2 * (1 - values[-1])
    rows = sorted(found.collect(), key=lambda r: r["id"])
    v, root = np.array([r["vector"] for r in rows]), np.array([r["root"] for r in rows])
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-6) and np.allclose(root @ v, 0, atol=1e-6)
    assert np.linalg.norm(s @ v - v * values, axis=0).max() <= 1e-2


def test_keeps_neighbours_of_a_bent_line_better_than_the_linear_map(spark):
    m = bent(300)
    df = table(spark, m)
    by_graph = trustworthiness(m, matrix_of(spectral.graph_coordinates(df, 2)))
    linear = trustworthiness(m, matrix_of(topics.reduce_for_clusters(df, 2)))
    assert by_graph > 0.98 and by_graph > linear + 0.02, (by_graph, linear)


def test_copies_nulls_few_rows_and_empty_table(spark):
    m = np.random.default_rng(5).normal(size=(40, 3))
    rows = [(i, m[i % 40].tolist()) for i in range(60)] + [(60, None)]
    got = {r["doc_id"]: r["vector"] for r in spectral.graph_coordinates(
        spark.createDataFrame(rows, "doc_id long, vector array<double>"), 3).collect()}
    assert set(got) == set(range(60)) and all(got[i] == got[i + 40] for i in range(20))
    assert all(len(v) == 3 and np.isfinite(v).all() for v in got.values())
    for n in (0, 1, 2, 3):
        few = spectral.graph_coordinates(spark.createDataFrame(rows[:n], "doc_id long, vector array<double>"), 3).collect()
        assert len(few) == n and all(len(r["vector"]) == 3 and np.isfinite(r["vector"]).all() for r in few)
