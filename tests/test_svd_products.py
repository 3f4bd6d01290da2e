"""The SVD's products and what they send."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.operators import linalg
from themeloom.session import store


@pytest.mark.parametrize("block_bytes, group", [(1, 4_000_000), (8 * 4 * 3 * 2, 40)])
def test_products_send_rows_with_entries_only(spark, monkeypatch, block_bytes, group):
    monkeypatch.setattr(linalg, "_BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(linalg, "_GROUP", group)
    monkeypatch.setattr(linalg, "_SLICE", 3)
    rng = np.random.default_rng(1)
    m = rng.random((60, 41)) * (rng.random((60, 41)) < 0.1)
    rows = [(i, [int(c) for c in np.nonzero(r)[0]], [float(x) for x in r[np.nonzero(r)]]) for i, r in enumerate(m)]
    table = spark.createDataFrame(rows, "key long, idx array<int>, val array<double>")
    columns, p = 4, 7
    wide = linalg._wide(columns, p)
    tiles, docs = linalg._tiles(table, columns, wide)
    held = tiles.agg(F.sum(F.octet_length("held")) / 4).first()[0]
    assert held <= np.count_nonzero(m)
    blocks = linalg._Blocks(tiles, 41, columns, wide, p)
    z = np.zeros((44, p))
    z[:41] = rng.random((41, p))
    packed = spark.createDataFrame([(c, bytearray(z[c * columns : (c + 1) * columns].tobytes())) for c in range(11)], "c int, packed binary")
    y = store(blocks.forward(packed, p))
    got = {r["key"]: r["vector"] for r in linalg._listed(docs, y, np.eye(p), "bigint").collect()}
    np.testing.assert_allclose([got[i] for i in range(60)], m @ z[:41], atol=1e-12)
    again = np.zeros((44, p))
    for r in blocks.back(y, p).collect():
        again[r["c"] * columns : (r["c"] + 1) * columns] = np.frombuffer(bytes(r["packed"])).reshape(columns, p)
    np.testing.assert_allclose(again[:41], m.T @ (m @ z[:41]), atol=1e-12)
