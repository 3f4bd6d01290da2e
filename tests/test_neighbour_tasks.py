"""How the comparisons of a neighbour search are dealt to tasks."""

import numpy as np
from pyspark.sql import functions as F

from themeloom.operators import neighbors
from themeloom.session import store


def _items(spark, rows=600):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(rows, 5)))]
    return store(spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1))


def test_queries_of_one_file_are_dealt_by_their_work(spark, monkeypatch):
    items = _items(spark)
    listed = lambda df: sorted(map(tuple, df.select("query", "item", F.round("score", 9), "rank").collect()))
    for metric in ("cosine", "euclidean"):
        whole = neighbors.nearest(items, items, 3, metric, skip_self=True)
        monkeypatch.setattr(neighbors, "_PAIRS", 60_000, raising=False)
        parts = neighbors.nearest(items, items, 3, metric, skip_self=True)
        used = parts.select(F.spark_partition_id().alias("p")).distinct().count()
        monkeypatch.undo()
        assert used >= 3 and listed(parts) == listed(whole) and len(listed(whole)) == 1_800


def test_items_are_prepared_once(spark, monkeypatch):
    calls = []
    norm = np.linalg.norm
    monkeypatch.setattr(np.linalg, "norm", lambda m, **k: calls.append(len(m)) or norm(m, **k))
    monkeypatch.setattr(neighbors, "_SCORES", 2_000)
    items = np.random.default_rng(0).normal(size=(100, 4))
    ids = np.arange(100)
    neighbors._search(ids, items, ids, items, 2, "cosine", True)
    assert calls.count(100) == 1
