"""Neighbour forest, spanning forest and density hierarchy against brute force."""

import numpy as np
import pandas as pd
import pytest

from themeloom.operators import components, density, forest, topics


def table(spark, matrix, name="doc_id"):
    frame = pd.DataFrame({name: np.arange(len(matrix)), "vector": [list(map(float, v)) for v in matrix]})
    return spark.createDataFrame(frame, f"{name} long, vector array<double>").repartition(4)


def test_forest_neighbours_recall(spark):
    m = np.random.default_rng(0).normal(size=(4000, 5))
    rows = forest.forest_neighbours(table(spark, m, "id"), 10, leaf=500, trees=4).collect()
    got = {}
    for r in rows:
        got.setdefault(r["query"], {})[r["rank"]] = (r["item"], r["distance"])
    assert len(got) == 4000 and all(sorted(v) == list(range(1, 11)) for v in got.values())
    hits = 0
    for q in range(0, 4000, 40):
        d = np.sqrt(((m - m[q]) ** 2).sum(1))
        d[q] = np.inf
        want = set(np.argsort(d, kind="stable")[:10].tolist())
        hits += len(want & {i for i, _ in got[q].values()})
        assert all(np.isclose(d[i], x) for i, x in got[q].values())
    assert hits >= 0.9 * 10 * 100


def test_forest_of_one_cell_is_exact(spark):
    m = np.random.default_rng(1).normal(size=(60, 3)).round(1)
    got = {(r["query"], r["rank"]): r["item"] for r in forest.forest_neighbours(table(spark, m, "id"), 4).collect()}
    for q in range(60):
        d = ((m - m[q]) ** 2).sum(1).round(9)
        want = sorted((i for i in range(60) if i != q), key=lambda i: (d[i], i))[:4]
        assert [round(float(d[got[q, r]]), 9) for r in range(1, 5)] == [round(float(d[i]), 9) for i in want]


def plain_forest(edges):
    parent, out = {}, []

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        x, y = find(a), find(b)
        if x != y:
            parent[x] = y
            out.append((a, b, w))
    return sorted(out)


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_spanning_forest(spark, block):
    rng = np.random.default_rng(2)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, size=(200, 2)) if a != b and (a < 40) == (b < 40)})
    edges = [(a, b, float(rng.integers(1, 9))) for a, b in edges]
    df = spark.createDataFrame(edges, "a long, b long, reach double")
    assert sorted(tuple(r) for r in density.spanning_forest(df, block).select("a", "b", "reach").collect()) == plain_forest(edges)


def plain_clusters(m, min_docs, weights=None):
    """Cuts every group at falling distances; the whole mutual-reachability matrix is held."""
    n, w = len(m), np.ones(len(m), int) if weights is None else np.array(weights)
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    core = np.sort(d + np.diag([np.inf] * n), axis=1)[:, min(max(min_docs - 1, 1), n - 1) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))

    def parts(ids, limit):
        left, out = set(ids), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                x = todo.pop()
                seen.add(x)
                near = {y for y in left if reach[x, y] < limit}
                left -= near
                todo += near
            out.append(sorted(seen))
        return out

    def grow(ids, birth, root):
        """(stability, chosen groups) of the best choice in the cluster that starts as ``ids``."""
        own, members, now = 0.0, ids, ids
        for limit in sorted({reach[i, j] for i in ids for j in ids if i != j}, reverse=True):
            found = [p for p in parts(now, limit) if w[p].sum() >= min_docs]
            if len(found) == 1:
                own += (w[now].sum() - w[found[0]].sum()) * (1 / limit - birth)
                now = found[0]
                continue
            own += w[now].sum() * (1 / limit - birth)
            below = [grow(p, 1 / limit, False) for p in found]
            if below and (root or sum(b for b, _ in below) > own + 1e-9):
                return sum(b for b, _ in below), [g for _, c in below for g in c]
            return own, [members]
        if len(now) == 1:
            own += w[now].sum() * (1 / core[now[0]] - birth)
        return own, [members]

    return sorted(grow(list(range(n)), 0.0, True)[1])


@pytest.mark.parametrize("seed, block", [(0, 10**6), (1, 10**6), (2, 10**6), (3, 25)])
def test_clusters_against_every_cut(spark, seed, block):
    rng = np.random.default_rng(seed)
    m = np.vstack([rng.normal(size=(k, 2)) * s + rng.normal(size=2) * 6 for k, s in ((14, 0.3), (9, 1.0), (12, 0.1), (6, 2.0))])
    copies = np.repeat(np.arange(len(m)), np.where(np.arange(len(m)) % 7 == 0, 3, 1))
    found = topics.density_clusters(table(spark, m[copies]), 4, neighbours=len(m) - 1, fence=None, block=block).collect()
    topic = {r["doc_id"]: r["topic"] for r in found}
    assert len(topic) == len(copies)
    groups = {}
    for doc, t in topic.items():
        groups.setdefault(t, set()).add(int(copies[doc]))
    groups.pop(-1, None)
    assert sorted(sorted(g) for g in groups.values()) == plain_clusters(m, 4, np.bincount(copies))


@pytest.mark.parametrize("size", [500, 5_000])
def test_groups_of_unequal_density(spark, size):
    rng = np.random.default_rng(6)
    sizes = [size * 6 // 10, size * 3 // 10, size // 10]
    centres = np.random.default_rng(7).normal(size=(3, 5)) * 10
    m = np.vstack([c + rng.normal(size=(n, 5)) * s for c, n, s in zip(centres, sizes, (0.2, 0.8, 2.0))])
    topic = {r["doc_id"]: r["topic"] for r in topics.density_clusters(table(spark, m)).collect()}
    at = 0
    for t, n in enumerate(sizes):
        inside = [topic[i] for i in range(at, at + n)]
        assert inside.count(t) >= (0.95 if t < 2 else 0.6 if size > 500 else 0.3) * n
        at += n
    assert set(topic.values()) <= {-1, 0, 1, 2}


def test_few_and_empty(spark):
    assert topics.density_clusters(table(spark, np.zeros((0, 2))).limit(0)).count() == 0
    assert {r["topic"] for r in topics.density_clusters(table(spark, np.ones((3, 2)))).collect()} == {-1}
    assert {r["topic"] for r in topics.density_clusters(table(spark, np.ones((7, 2)))).collect()} == {0}


def test_rounds_send_no_table_through_the_driver(spark, monkeypatch):
    plans, store = [], components.store

    def noting(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(components, "store", noting)
    monkeypatch.setattr(density, "store", noting)
    rng = np.random.default_rng(8)
    edges = [(i, i + 1, float(rng.integers(1, 9))) for i in range(60) if i != 30]
    df = spark.createDataFrame(edges, "a long, b long, reach double")
    tree = density.spanning_forest(df, 20)
    found = components.connected_components(spark.range(61), tree).collect()
    assert sorted((r["id"], r["component"]) for r in found) == [(i, 0 if i <= 30 else 31) for i in range(61)]
    points = spark.createDataFrame([(i, 1, 1.0) for i in range(61)], "id long, weight long, core double")
    _, clusters = density.condensed_tree(points, tree, 4, 20)
    assert density.chosen_clusters(clusters).count() == clusters.count()
    assert sum("SortMergeJoin" in p for p in plans) > 10 and not any("Broadcast" in p for p in plans)
