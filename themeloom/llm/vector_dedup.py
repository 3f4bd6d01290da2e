"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on Gaussian directions and quantised with a fixed width; ``PROJECTIONS`` quantised
values make the key of one of ``TABLES`` tables.  Vectors in one bucket are compared by their cosine in double
precision.  A pair that meets in several tables counts in the first of them only, which each member's keys tell.

Only vectors of one group (label) are compared.  Equal vectors of a group form a class that is compared once and counts
as often as it has members.  Buckets of one class are dropped before any vector moves.  A larger bucket than ``BLOCK``
is cut into blocks, and each pair of blocks is a group of its own, so no group grows with the data and no pair is lost.
A block pair sends back one count for each vector and the edges of a spanning forest, never all pairs.

Vectors that are null, empty, zero or hold a null or a non-finite component, a null label or a null id link with
nothing: no links, and their component is their own id.  Rows that share an id count as one vector (the smallest, if they
differ) and are each returned.  Vectors of unequal length never link.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeloom.operators.components import connected_components
from themeloom.session import store

TABLES = 14
PROJECTIONS = 8
WIDTH = 0.8
BLOCK = 1_024
SEED = 7


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of large and small values finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_keys(units: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """One 64-bit key for each row and table; a length has its own directions."""
    rng = np.random.default_rng([seed, units.shape[1]])
    directions = rng.standard_normal((units.shape[1], tables * projections))
    shifts = rng.uniform(0, width, tables * projections)
    cells = np.floor((units @ directions + shifts) / width).astype(np.int64).view(np.uint64)
    factors = rng.integers(1, 1 << 63, projections, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return (cells.reshape(len(units), tables, projections) * factors).sum(axis=2).view(np.int64)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``linked`` (a symmetric boolean matrix) connects."""
    edges, waiting = [], np.ones(len(linked), bool)
    waiting[~linked.any(axis=1)] = False
    while waiting.any():
        stack = [int(np.argmax(waiting))]
        waiting[stack[0]] = False
        while stack:
            at = stack.pop()
            fresh = np.flatnonzero(linked[at] & waiting)
            waiting[fresh] = False
            edges += [(at, int(x)) for x in fresh]
            stack += fresh.tolist()
    return edges


def near_duplicates(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", group: str = "label",
                    tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: links are pairs found in one group with cosine ``least`` or more."""
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(group).alias("g")
    )
    good = F.expr("vec_id IS NOT NULL AND g IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(v, x -> x <> 0)")
    exact = F.transform("v", lambda x: x + 0.0)  # -0.0 equals 0.0
    single = rows.filter(F.coalesce(good, F.lit(False))).groupBy("vec_id").agg(F.min(F.struct("g", exact.alias("v"))).alias("r")).select("vec_id", "r.*")
    single = store(single, "vectors")
    classes = store(single.groupBy("g", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                keys = bucket_keys(_unit(_matrix(part.column(2))), tables, projections, width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(list(keys), pa.list_(pa.int64()))], ["id", "g", "keys"]
                )

    kind = rows.schema["g"].dataType.simpleString()
    hashed = store(classes.select("id", "g", "v").mapInArrow(hash_rows, f"id bigint, g {kind}, keys array<bigint>"), "keys")
    placed = hashed.select("id", "g", F.posexplode("keys").alias("t", "key"))
    sizes = placed.groupBy("g", "t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    # A bucket of n classes has ceil(n / block) blocks; a class goes to the groups of its block with each block.
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("id", "t"), F.col("blocks")).cast("int")
    met = (
        placed.join(sizes, ["g", "t", "key"]).withColumn("blocks", blocks).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("id", "t", "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine")
    )
    kept = classes.select("id", "g", "v", "copies").join(hashed.select("id", "keys"), "id")

    def compare(group):
        size = np.array([len(x) for x in group["v"]])
        ids, counts, one, two = [], [], [], []
        for width_ in np.unique(size):
            part = group.filter(pa.array(size == width_)).combine_chunks().sort_by("id")
            if len(part) < 2:
                continue
            units = _unit(_matrix(part["v"].chunk(0)))
            keys = _matrix_of_keys(part["keys"].chunk(0))
            linked = units @ units.T >= least
            mine, table = part["mine"].to_numpy(), int(part["t"][0].as_py())
            if (a := part["a"][0].as_py()) != part["b"][0].as_py():
                linked &= mine[:, None] != mine[None, :]
            for earlier in range(table):
                linked &= keys[:, earlier][:, None] != keys[:, earlier][None, :]
            np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            here = part["id"].to_numpy()
            total = linked @ part["copies"].to_numpy()
            edges = _forest(linked)
            ids += here[total > 0].tolist() + [None] * len(edges)
            counts += total[total > 0].tolist() + [None] * len(edges)
            none = int((total > 0).sum())
            one += [None] * none + [int(here[i]) for i, _ in edges]
            two += [None] * none + [int(here[j]) for _, j in edges]
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(counts, pa.int64()), "one": pa.array(one, pa.int64()), "two": pa.array(two, pa.int64())})

    found = met.join(kept, "id").groupBy("g", "t", "key", "a", "b").applyInArrow(compare, "id bigint, links bigint, one bigint, two bigint")
    found = store(found, "found")
    counts = found.filter("id IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.filter("one IS NOT NULL").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct()
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    together = connected_components(ends, edges)
    result = (
        classes.join(counts, "id", "left").join(together, "id", "left")
        .select("g", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    of_ids = single.join(result, ["g", "v"]).select("vec_id", "n_links", "component_id")
    return rows.select("vec_id").join(of_ids, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _matrix_of_keys(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)
