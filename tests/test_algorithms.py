"""SVD, neighbours, components, linkage and clustering against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.operators import components, display, linalg, linkage, neighbors, topics


def vector_table(spark, matrix, name="doc_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{name} long, vector array<double>")


def sparse_table(spark, matrix):
    rows = []
    for i, v in enumerate(matrix):
        idx = np.flatnonzero(v)
        rows.append((i, [int(j) for j in idx], [float(v[j]) for j in idx]))
    return spark.createDataFrame(rows, "key long, idx array<int>, val array<double>").repartition(3)


def low_rank(n=60, d=40, rank=6, seed=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, d)) * (rng.random((n, d)) < 0.6)
    return m


@pytest.mark.parametrize("columns", [16_384, 7])
def test_truncated_svd_matches_numpy(spark, columns):
    m = low_rank()
    k = 5
    found = linalg.truncated_svd(sparse_table(spark, m), m.shape[1], k, passes=6, columns=columns)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(found.singular, s[:k], rtol=1e-4)
    got = np.zeros((len(m), k))
    for r in found.vectors.collect():
        got[r["key"]] = r["vector"]
    assert np.allclose(np.abs(got), np.abs(u[:, :k] * s[:k]), atol=1e-2 * s[0])
    basis = np.zeros((m.shape[1], k))
    for r in found.basis.collect():
        basis[r["col"]] = r["vector"]
    assert np.allclose(basis.T @ basis, np.eye(k), atol=1e-5)
    assert np.allclose(m @ basis, got, atol=1e-5)


@pytest.mark.parametrize("scale", [1.0, 1e6])
@pytest.mark.parametrize("columns", [16_384, 7])
def test_truncated_svd_of_few_independent_columns(spark, columns, scale):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 40)) * scale
    found = linalg.truncated_svd(sparse_table(spark, m), 40, 30, columns=columns)
    assert np.allclose(found.singular, np.linalg.svd(m, compute_uv=False)[:4], rtol=1e-6)
    assert {len(r["vector"]) for r in found.vectors.collect()} == {4}


def test_signs_are_balanced_and_fixed():
    a = linalg.signs(np.arange(2000), 110, 42)
    assert a.shape == (2000, 110) and set(np.unique(a)) == {-1.0, 1.0}
    assert abs(a.mean()) < 0.01
    assert np.array_equal(a[7:8], linalg.signs(np.array([7]), 110, 42))
    assert not np.array_equal(a, linalg.signs(np.arange(2000), 110, 43))


def test_dense_svd_matches_numpy(spark):
    m = low_rank(50, 8, 8, 1)
    out = {r["doc_id"]: r["vector"] for r in linalg.dense_svd(vector_table(spark, m), 3).collect()}
    got = np.array([out[i] for i in range(len(m))])
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-8)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_both_ways_match_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(90, 6))
    items = vector_table(spark, m, "id")
    shipped = neighbors.nearest(items, items, 4, metric, skip_self=True)
    blocked = neighbors._blocked(items, items, 4, metric, True, "query long, item long, score double, rank int", group_rows=25)
    scores = neighbors._similarity(m, m, metric)
    np.fill_diagonal(scores, -np.inf)
    want = {(q, r + 1): int(i) for q in range(90) for r, i in enumerate(np.argsort(-scores[q], kind="stable")[:4])}
    for table in (shipped, blocked):
        assert {(r["query"], r["rank"]): r["item"] for r in table.collect()} == want


def test_nearest_ties_take_the_smaller_id(spark):
    items = spark.createDataFrame([(5, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 1.0])], "id long, vector array<double>")
    query = spark.createDataFrame([(0, [2.0, 0.0])], "id long, vector array<double>")
    assert [r["item"] for r in neighbors.nearest(query, items, 2).orderBy("rank").collect()] == [3, 5]


def test_connected_components_with_hub_and_chain(spark):
    edges = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(50, 80)] + [(101, 100)]
    vertices = spark.createDataFrame([(i,) for i in range(110)], "id long")
    found = components.connected_components(vertices, spark.createDataFrame(edges, "a long, b long"))
    label = {r["id"]: r["component"] for r in found.collect()}
    assert {label[i] for i in range(30)} == {0}
    assert {label[i] for i in range(50, 81)} == {50}
    assert label[101] == label[100] == 100 and label[105] == 105


def brute_linkage(d, method):
    n = len(d)
    size, active = {i: 1 for i in range(n)}, list(range(n))
    dist = {(i, j): d[i][j] for i in range(n) for j in range(n) if i < j}
    get = lambda a, b: dist[(min(a, b), max(a, b))]
    out, members = [], {i: [i] for i in range(n)}
    while len(active) > 1:
        a, b = min(((x, y) for i, x in enumerate(active) for y in active[i + 1:]), key=lambda p: get(*p))
        new = n + len(out)
        for c in active:
            if c in (a, b):
                continue
            if method == "ward":
                t = size[a] + size[b] + size[c]
                v = (((size[a] + size[c]) * get(a, c) ** 2 + (size[b] + size[c]) * get(b, c) ** 2 - size[c] * get(a, b) ** 2) / t) ** 0.5
            else:
                v = (size[a] * get(a, c) + size[b] * get(b, c)) / (size[a] + size[b])
            dist[(c, new)] = v
        size[new], members[new] = size[a] + size[b], sorted(members[a] + members[b])
        out.append((min(a, b), max(a, b), get(a, b), members[new]))
        active = [c for c in active if c not in (a, b)] + [new]
    return out


@pytest.mark.parametrize("method", ["ward", "average"])
def test_merge_rounds_match_one_at_a_time(spark, method):
    rng = np.random.default_rng(11)
    points = rng.normal(size=(9, 3))
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(9) for j in range(i + 1, 9)], "a int, b int, distance double")
    got = linkage.merge_rounds(pairs, method)
    want = brute_linkage(d, method)
    assert [(m["left"], m["right"], m["topics"]) for m in got] == [(a, b, t) for a, b, _, t in want]
    assert np.allclose([m["distance"] for m in got], [w[2] for w in want])


@pytest.mark.parametrize("method", ["ward", "average"])
def test_merge_rounds_finish_with_ties(spark, method):
    pairs = spark.createDataFrame([(i, j, 0.7 if (i + j) % 2 else 0.7 + 1e-16) for i in range(12) for j in range(i + 1, 12)], "a int, b int, distance double")
    got = linkage.merge_rounds(pairs, method)
    assert len(got) == 11 and got[-1]["topics"] == list(range(12))


def test_merge_rounds_stop_and_refuse_missing_pairs(spark):
    pairs = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.5), (1, 2, 0.6), (0, 3, 0.9), (1, 3, 0.9), (2, 3, 0.8)], "a int, b int, distance double")
    assert [m["topics"] for m in linkage.merge_rounds(pairs, "average", stop_count=3)] == [[0, 1]]
    assert [m["topics"] for m in linkage.merge_rounds(pairs, "average", stop_at=0.56)] == [[0, 1], [0, 1, 2]]
    with pytest.raises(ValueError):
        linkage.merge_rounds(pairs.filter("a <> 2 and b <> 2").union(spark.createDataFrame([(4, 5, 1.0)], pairs.schema)), "average")


def planted(seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, 5)) * 10
    parts = [c + rng.normal(size=(n, 5)) * 0.2 for c, n in zip(centres, (60, 40, 25))]
    return np.vstack([*parts, rng.uniform(-60, 60, size=(6, 5))])


def check_planted(found):
    topic = {r["doc_id"]: r["topic"] for r in found.collect()}
    assert len(topic) == 131
    for t, (lo, hi) in enumerate([(0, 60), (60, 100), (100, 125)]):
        inside = [topic[i] for i in range(lo, hi)]
        assert inside.count(t) >= 0.8 * (hi - lo)
        assert set(inside) <= {t, -1}
    assert {topic[i] for i in range(125, 131)} == {-1}


def test_density_clusters_find_planted_groups(spark):
    check_planted(topics.density_clusters(vector_table(spark, planted()), 5, cut_quantile=0.9))


def test_density_clusters_keep_every_row_in_small_blocks(spark):
    m = np.vstack([planted()])
    found = topics.density_clusters(vector_table(spark, m), 5, cut=2.0, leaf=40, block=60)
    check_planted(found)


def test_copies_of_one_vector_are_one_topic(spark):
    m = np.vstack([np.ones((50, 3)), -np.ones((20, 3)), [[5.0, 0, 0]]])
    topic = {r["doc_id"]: r["topic"] for r in topics.density_clusters(vector_table(spark, m), 5).collect()}
    assert {topic[i] for i in range(50)} == {0} and {topic[i] for i in range(50, 70)} == {1} and topic[70] == -1


def test_topic_similarity_covers_all_pairs(spark):
    weights = spark.createDataFrame([(0, "a", 1.0), (1, "a", 2.0), (1, "b", 1.0), (5, "c", 3.0)], "topic int, term string, weight double")
    got = {(r[0], r[1]): r[2] for r in display.term_similarity(weights).collect()}
    assert len(got) == 9
    assert np.isclose(got[(0, 1)], 2 / 5**0.5) and got[(0, 5)] == 0.0 and np.isclose(got[(5, 5)], 1.0)


def test_join_counted_is_a_plain_inner_join(spark, monkeypatch):
    from themeloom.operators import skew

    monkeypatch.setattr(skew, "HOT_KEYS", 5)
    monkeypatch.setattr(skew, "EASY_ROWS", 200)
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("term"))
    right = left.groupBy("term").agg(F.count("*").alias("df"))
    key = lambda r: (r["id"], r["term"], r["df"])
    got = sorted(map(key, skew.join_counted(left, right, ["term"], "df").collect()))
    assert got == sorted(map(key, left.join(right, "term").collect())) and len(got) == 3000
