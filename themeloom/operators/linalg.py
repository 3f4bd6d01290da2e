"""Truncated SVD of document tables.

Randomised subspace iteration (Halko, Martinsson and Tropp, 2011).  The documents
are tiles of row and column blocks, the tall matrices of both sides are tables of
row blocks, and their bases come from trees of QR decompositions (Demmel,
Grigori, Hoemmen and Langou, 2012).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from themeloom import params
from themeloom.operators.rows import number_rows
from themeloom.operators.skew import join_counted
from themeloom.session import store

_CHUNK = 200_000  # matrix entries handled at once inside a task
_TILE = 1_000_000  # entries of a row block
_GROUP = 4_000_000  # entries of a column group that a task multiplies
_BLOCK_BYTES = 64 * 1024 * 1024  # of a matrix that a task holds beside its entries
_SLICE = 32  # columns of a matrix that a task multiplies
_FAN = 32  # blocks added or decomposed together
_ARROW = {"int": pa.int32(), "long": pa.int64()}


@dataclass
class Reduction:
    """``vectors`` (key, vector), ``basis`` (col, vector) and singular values."""

    vectors: DataFrame
    basis: DataFrame
    singular: np.ndarray


def signs(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Row-wise random +1/-1 entries that depend on (id, column, seed) only."""
    words = (width + 63) // 64
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)[None, :]
        x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1)[:, :width]
    return bits.astype(np.float64) * 2.0 - 1.0


def tfidf_rows(counts: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(key, idx, val): length-one TF-IDF rows with dense term numbers, and the
    (term, df, col, place) vocabulary: ``col`` counts by frequency, so that the
    entries of rare terms are apart, ``place`` by term.

    The numbered vocabulary carries the document frequency, so one join gives
    number and weight, and a row is scaled after its terms are together.
    """
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    placed = number_rows(frequency, ["term"], "place")
    vocabulary = number_rows(placed, [F.desc("df"), F.asc("place")], "col")
    n = counts.agg(F.count_distinct(doc).alias("n")).first()["n"]
    weight = F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    weights = join_counted(counts, vocabulary, ["term"], "df").select(doc, "col", weight.alias("weight"))
    return unit_rows(weights, doc), vocabulary


def unit_rows(weights: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(key, idx, val): the (doc, col, weight) of each document as one sparse row of length one; stored."""
    rows = (
        weights.select(F.col(doc).alias("key"), F.col("col").cast("int").alias("col"), F.col("weight").alias("w"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("col", "w"))).alias("e"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
        .select("key", F.col("e.col").alias("idx"), F.transform("e", lambda t: t["w"] / F.col("len")).alias("val"))
    )
    return store(rows, "sparse", large=True)


def _chunks(batch: pa.RecordBatch, size: int = _CHUNK):
    """Split a batch of sparse rows into pieces of about ``size`` entries."""
    idx_list = batch.column("idx")
    offsets = idx_list.offsets.to_numpy()
    idx = idx_list.values.to_numpy()
    val = batch.column("val").values.to_numpy()
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        lo, hi = offsets[start], offsets[stop]
        yield start, stop, idx[lo:hi], val[lo:hi], offsets[start : stop + 1] - lo
        start = stop


def _sum_by(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    keys, first = np.unique(ids[order], return_index=True)
    return keys, np.add.reduceat(values[order], first, axis=0)


def _list_batch(names: list[str], keys: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel())
    steps = pa.array(np.arange(0, matrix.size + 1, matrix.shape[1] or 1, dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(steps, flat)], names=names)


def _slices(count: int, size: int = 20_000) -> Iterator[slice]:
    for start in range(0, count, size):
        yield slice(start, min(start + size, count))


def gram(df: DataFrame, column: str, width: int) -> DataFrame:
    """(i, j, value): the ``width`` x ``width`` matrix of sums of v_i * v_j."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                v = v.reshape(batch.num_rows, width)
                acc += v.T @ v
        yield from _matrix_entries(acc)

    parts = df.select(column).mapInArrow(partial, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def sparse_gram(rows: DataFrame, width: int) -> DataFrame:
    """(i, j, value) of ``A^T A`` for sparse rows (idx, val) over ``width`` columns."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((width, width))
        for batch in batches:
            for start, stop, idx, val, offsets in _chunks(batch):
                step = max(1, 4_000_000 // width)
                for lo in range(0, stop - start, step):
                    hi = min(lo + step, stop - start)
                    a, b = offsets[lo], offsets[hi]
                    dense = np.zeros((hi - lo, width))
                    dense[np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1])), idx[a:b]] = val[a:b]
                    acc += dense.T @ dense
        yield from _matrix_entries(acc)

    parts = rows.select("idx", "val").mapInArrow(partial, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def _matrix_entries(acc: np.ndarray) -> Iterator[pa.RecordBatch]:
    i, j = np.nonzero(acc)
    for part in _slices(len(i), 100_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(i[part].astype(np.int32)), pa.array(j[part].astype(np.int32)), pa.array(acc[i[part], j[part]])],
            names=["i", "j", "value"],
        )


def _to_matrix(entries: DataFrame, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    arrow = entries.select("i", "j", "value").toArrow()
    out[arrow.column(0).to_numpy(), arrow.column(1).to_numpy()] = arrow.column(2).to_numpy()
    return out


def _ritz(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading ``k`` eigenvectors with a fixed sign, and singular values."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(values)[::-1][:k]
    vectors = vectors[:, order]
    flip = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return vectors * np.where(flip == 0, 1, flip), np.sqrt(np.clip(values[order], 0, None))


def project(df: DataFrame, key: str, column: str, matrix: np.ndarray, name: str = "vector") -> DataFrame:
    """(key, vector @ matrix) for dense vectors; ``matrix`` is small."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            out = v.reshape(batch.num_rows, -1) @ matrix
            flat = pa.array(out.ravel())
            steps = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(steps, flat)], names=[key, name])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, {name} array<double>")


def dense_svd(df: DataFrame, k: int, key: str = "doc_id", column: str = "vector") -> DataFrame:
    """Dense vectors reduced to ``k`` dimensions; not centred.

    Only the Gram matrix of the dimensions reaches the driver.
    """
    some = df.select(column).first()
    if some is None:
        return df.select(key, F.col(column).cast("array<double>").alias("vector"))
    width = len(some[0])
    vectors, _ = _ritz(_to_matrix(gram(df, column, width), width), min(k, width))
    return project(df, key, column, vectors)


def _pack_matrix(matrix: np.ndarray) -> bytes:
    return np.ascontiguousarray(matrix, dtype=np.float64).tobytes()


def _matrix(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, width)


def _slice_bounds(p: int) -> list[tuple[int, int]]:
    """The columns of a matrix of ``p`` columns that are multiplied together."""
    return [(lo, min(lo + _SLICE, p)) for lo in range(0, p, _SLICE)] or [(0, 0)]


def _wide(columns: int, p: int) -> int:
    """Row blocks of the term-side matrix that one task holds."""
    return max(1, _BLOCK_BYTES // (8 * columns * max(1, min(p, _SLICE))))


def _group_of(block, wide: int):
    """The column group of a row block of the term side: the first block, of the most frequent terms, is one by itself."""
    return (block + wide - 1) // wide


def _tiles(rows: DataFrame, columns: int, wide: int) -> tuple[DataFrame, DataFrame]:
    """(r, c, n, held, pos, idx, val): the entries of row block ``r`` in column group ``c`` with their places in both,
    ``held`` its rows with an entry, and (r, keys) of the row blocks, which have about ``_TILE`` entries.  Both are stored."""
    kind = dict(rows.dtypes)["key"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = TaskContext.get().partitionId() << 24
        for batch in batches:
            for start, stop, idx, val, offsets in _chunks(batch, _TILE):
                pos = np.repeat(np.arange(stop - start, dtype=np.int32), np.diff(offsets))
                group = _group_of(idx // columns, wide)
                order = np.argsort(group, kind="stable")
                pos, idx, val = pos[order], idx[order], val[order]
                groups, first = np.unique(group[order], return_index=True)
                parts = [slice(a, b) for a, b in zip(first, [*first[1:], len(idx)])]
                base = [_first_block(int(g), wide) * columns for g in groups]
                keys, none = batch.column("key").slice(start, stop - start), len(parts)
                listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r] * (none + 1), pa.int64()), pa.array([-1, *groups.tolist()], pa.int32()), pa.array([stop - start] * (none + 1), pa.int32()),
                    pa.array([None, *(np.unique(pos[p]).astype(np.int32).tobytes() for p in parts)], pa.binary()),
                    pa.array([None, *(pos[p].astype(np.int32).tobytes() for p in parts)], pa.binary()),
                    pa.array([None, *((idx[p] - b).astype(np.int32).tobytes() for p, b in zip(parts, base))], pa.binary()),
                    pa.array([None, *(val[p].astype(np.float64).tobytes() for p in parts)], pa.binary()),
                    pa.concat_arrays([listed, pa.nulls(none, listed.type)]),
                ], names=["r", "c", "n", "held", "pos", "idx", "val", "keys"])
                r += 1

    schema = f"r long, c int, n int, held binary, pos binary, idx binary, val binary, keys array<{kind}>"
    stored = store(rows.select("key", "idx", "val").mapInArrow(cut, schema), "tiles", large=True)
    return stored.filter("c >= 0").drop("keys"), stored.filter("c < 0").select("r", "keys")


def _first_block(group: int, wide: int) -> int:
    """The first row block of a column group."""
    return max(0, (group - 1) * wide + 1)


class _Blocks:
    """Products of the tiles with matrices kept as tables of row blocks: (r, packed) and (c, packed).

    Tiles of a column group, of ``wide`` blocks of the term side, and a share of the row blocks meet the matrix blocks
    they need in one task, for ``_SLICE`` of the matrix' columns.  The number of a group's shares follows its entries
    and rows, so a task's work is bounded and a frequent term is spread over all shares.  Of the document side only
    rows with an entry in the group are sent, no more than there are entries, so with the terms numbered by frequency
    what is sent grows with the entries and not with documents times column groups.
    """

    def __init__(self, tiles: DataFrame, width: int, columns: int, wide: int, p: int):
        self.columns, self.wide, self.count = columns, wide, -(-width // columns)
        least = max(1, _BLOCK_BYTES // (8 * max(1, min(p, _SLICE))))
        sizes = tiles.groupBy("c").agg((F.sum(F.octet_length("val")) / 8).alias("n"), (F.sum(F.octet_length("held")) / 4).alias("rows"))
        self.parts = {row["c"]: int(max(-(-row["n"] // _GROUP), -(-row["rows"] // least), 1)) for row in sizes.collect()}
        share = F.pmod(F.xxhash64("r"), F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in self.parts.items() for x in pair]), F.col("c").cast("long"))) if self.parts else F.lit(0)
        self.tiles = tiles.withColumn("s", share.cast("long"))

    def _sliced(self, names: list[str], p: int) -> DataFrame:
        return self.tiles.select("c", "s", *names, F.explode(F.sequence(F.lit(0), F.lit(len(_slice_bounds(p)) - 1))).alias("q"))

    def forward(self, z: DataFrame, p: int) -> DataFrame:
        """(r, packed) of A Z for Z as (c, packed)."""
        columns, wide, parts, bounds = self.columns, self.wide, self.parts, _slice_bounds(p)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    c, matrix = _group_of(b, wide), _matrix(raw, p)
                    if c in parts:
                        packed = [_pack_matrix(matrix[:, lo:hi]) for lo, hi in bounds]
                        yield pa.RecordBatch.from_arrays([pa.array([c] * len(bounds), pa.int32()), pa.array(range(len(bounds)), pa.int32()), pa.array([b] * len(bounds), pa.int32()),
                                                          pa.array([parts[c]] * len(bounds), pa.int64()), pa.array(packed, pa.binary())], ["c", "q", "b", "shares", "packed"])

        def product(tiles: pa.Table, blocks: pa.Table) -> pa.Table:
            out = []
            if tiles.num_rows and blocks.num_rows:
                lo, hi = bounds[tiles.column("q")[0].as_py()]
                first = _first_block(tiles.column("c")[0].as_py(), wide)
                block = np.zeros(((max(blocks.column("b").to_pylist()) - first + 1) * columns, hi - lo))
                for b, raw in zip(blocks.column("b").to_pylist(), blocks.column("packed")):
                    block[(b - first) * columns : (b - first + 1) * columns] = np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, hi - lo)
                for i in range(tiles.num_rows):
                    held, pos, idx, val = _tile(tiles, i)
                    starts = np.searchsorted(pos, held)  # pos is in order within a tile
                    y = np.empty((len(held), hi - lo))
                    for some in _slices(len(held), 2_000):
                        a, b = starts[some][0], (starts[some.stop] if some.stop < len(starts) else len(pos))
                        y[some] = np.add.reduceat(block[idx[a:b]] * val[a:b, None], starts[some] - a, axis=0)
                    out.append((tiles.column("r")[i].as_py(), tiles.column("n")[i].as_py(), lo, hi, held.tobytes(), _pack_matrix(y)))
            return pa.table({name: pa.array([row[j] for row in out], kind) for j, (name, kind) in enumerate(
                (("r", pa.int64()), ("n", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("held", pa.binary()), ("packed", pa.binary())))})

        def add(table: pa.Table) -> pa.Table:
            acc = np.zeros((table.column("n")[0].as_py(), p))
            for i in range(table.num_rows):
                lo, hi = table.column("lo")[i].as_py(), table.column("hi")[i].as_py()
                acc[np.frombuffer(table.column("held")[i].as_buffer(), np.int32), lo:hi] += np.frombuffer(table.column("packed")[i].as_buffer(), np.float64).reshape(-1, hi - lo)
            return pa.table({"r": table.column("r").slice(0, 1), "packed": pa.array([_pack_matrix(acc)], pa.binary())})

        spread = z.select("c", "packed").mapInArrow(cut, "c int, q int, b int, shares long, packed binary")
        spread = spread.select("c", "q", "b", "packed", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("s"))
        tiles = self._sliced(["r", "n", "held", "pos", "idx", "val"], p)
        found = tiles.groupBy("c", "s", "q").cogroup(spread.groupBy("c", "s", "q")).applyInArrow(product, "r long, n int, lo int, hi int, held binary, packed binary")
        return found.groupBy("r").applyInArrow(add, "r long, packed binary")

    def back(self, y: DataFrame, p: int) -> DataFrame:
        """(c, packed) of A^T Y for Y as (r, packed)."""
        columns, wide, count, bounds = self.columns, self.wide, self.count, _slice_bounds(p)

        def cut(tiles: pa.Table, blocks: pa.Table) -> Iterator[pa.RecordBatch]:
            if tiles.num_rows and blocks.num_rows:
                matrix = _matrix(blocks.column("packed")[0].as_py(), p)
                for i in range(tiles.num_rows):
                    rows = matrix[np.frombuffer(tiles.column("held")[i].as_buffer(), np.int32)]
                    packed = [_pack_matrix(rows[:, lo:hi]) for lo, hi in bounds]
                    same = lambda name, kind: pa.array([tiles.column(name)[i].as_py()] * len(bounds), kind)
                    yield pa.table({"c": same("c", pa.int32()), "s": same("s", pa.int64()), "q": pa.array(range(len(bounds)), pa.int32()), "r": same("r", pa.int64()), "packed": pa.array(packed, pa.binary())})

        def sent(tiles: pa.Table, blocks: pa.Table) -> pa.Table:
            parts = list(cut(tiles, blocks))
            return pa.concat_tables(parts) if parts else pa.table({"c": pa.array([], pa.int32()), "s": pa.array([], pa.int64()), "q": pa.array([], pa.int32()), "r": pa.array([], pa.int64()), "packed": pa.array([], pa.binary())})

        def product(tiles: pa.Table, blocks: pa.Table) -> pa.Table:
            if not tiles.num_rows or not blocks.num_rows:
                return pa.table({"c": pa.array([], pa.int32()), "q": pa.array([], pa.int32()), "s": pa.array([], pa.int64()), "packed": pa.array([], pa.binary())})
            c, q, s = (tiles.column(name)[0].as_py() for name in ("c", "q", "s"))
            lo, hi = bounds[q]
            first = _first_block(c, wide)
            last = min(first + (wide if c else 1), count)
            at = {r: i for i, r in enumerate(blocks.column("r").to_pylist())}
            acc = np.zeros(((last - first) * columns, hi - lo))
            for i in range(tiles.num_rows):
                held, pos, idx, val = _tile(tiles, i)
                matrix = np.frombuffer(blocks.column("packed")[at[tiles.column("r")[i].as_py()]].as_buffer(), np.float64).reshape(-1, hi - lo)
                slot = np.searchsorted(held, pos)
                for some in _slices(len(pos), 100_000):
                    keys, sums = _sum_by(idx[some], matrix[slot[some]] * val[some, None])
                    acc[keys] += sums
            n = last - first
            packed = [_pack_matrix(acc[i * columns : (i + 1) * columns]) for i in range(n)]
            return pa.table({"c": pa.array(range(first, last), pa.int32()), "q": pa.array([q] * n, pa.int32()), "s": pa.array([s] * n, pa.int64()), "packed": pa.array(packed, pa.binary())})

        spread = self.tiles.select("r", "c", "s", "held").groupBy("r").cogroup(y.select("r", "packed").groupBy("r")).applyInArrow(sent, "c int, s long, q int, r long, packed binary")
        tiles = self._sliced(["r", "held", "pos", "idx", "val"], p)
        found = tiles.groupBy("c", "s", "q").cogroup(spread.groupBy("c", "s", "q")).applyInArrow(product, "c int, q int, s long, packed binary")
        left = max(self.parts.values(), default=1)
        while left > _FAN:  # a tree, so that no task adds more than _FAN blocks
            left = -(-left // _FAN)
            found = _sum_blocks(found.withColumn("s", F.pmod("s", F.lit(left))))

        def add(table: pa.Table) -> pa.Table:
            acc = np.zeros((columns, p))
            for q, raw in zip(table.column("q").to_pylist(), table.column("packed")):
                lo, hi = bounds[q]
                acc[:, lo:hi] += np.frombuffer(raw.as_buffer(), np.float64).reshape(columns, hi - lo)
            return pa.table({"c": table.column("c").slice(0, 1), "packed": pa.array([_pack_matrix(acc)], pa.binary())})

        return found.groupBy("c").applyInArrow(add, "c int, packed binary")


def _tile(tiles: pa.Table, i: int) -> tuple[np.ndarray, ...]:
    """(held, pos, idx, val) of a tile."""
    kinds = (("held", np.int32), ("pos", np.int32), ("idx", np.int32), ("val", np.float64))
    return tuple(np.frombuffer(tiles.column(name)[i].as_buffer(), kind) for name, kind in kinds)


def _sum_blocks(df: DataFrame) -> DataFrame:
    """Sums of the packed matrices of equal (c, q, s)."""

    def add(table: pa.Table) -> pa.Table:
        packed = table.column("packed")
        acc = np.frombuffer(packed[0].as_buffer(), np.float64).copy()
        for i in range(1, len(packed)):
            acc += np.frombuffer(packed[i].as_buffer(), np.float64)
        return pa.table({n: table.column(n).slice(0, 1) for n in ("c", "q", "s")} | {"packed": pa.array([acc.tobytes()], pa.binary())})

    return df.groupBy("c", "q", "s").applyInArrow(add, "c int, q int, s long, packed binary")


def _triangle(blocks: DataFrame, key: str, p: int) -> np.ndarray:
    """R of the QR decomposition of the matrix whose row blocks are (key, packed): a tree of QRs, ``_FAN`` at a time."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, p))
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held = np.linalg.qr(np.concatenate([held, _matrix(raw, p)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_pack_matrix(held)], pa.binary())], ["g", "packed"])

    def join(table: pa.Table) -> pa.Table:
        r = np.linalg.qr(np.concatenate([_matrix(x.as_py(), p) for x in table.column("packed")]), mode="r")
        return pa.table({"g": table.column("g").slice(0, 1), "packed": pa.array([_pack_matrix(r)], pa.binary())})

    level = blocks.select("packed").mapInArrow(local, "g long, packed binary")
    left = blocks.rdd.getNumPartitions()
    while left > _FAN:
        left = -(-left // _FAN)
        level = level.withColumn("g", F.pmod("g", F.lit(left))).groupBy("g").applyInArrow(join, "g long, packed binary")
    parts = [_matrix(bytes(row["packed"]), p) for row in level.collect()]  # _FAN at most
    return np.linalg.qr(np.concatenate(parts), mode="r") if parts else np.zeros((0, p))


def _times_small(blocks: DataFrame, key: str, kind: str, p: int, matrix: np.ndarray) -> DataFrame:
    """Row blocks times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([name], _ARROW[kind]), pa.array([_pack_matrix(_matrix(raw, p) @ matrix)], pa.binary())], [key, "packed"])

    return blocks.select(key, "packed").mapInArrow(run, f"{key} {kind}, packed binary")


def _right_factor(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors with a fixed sign, and singular values; directions of no weight are left out."""
    _, values, turned = np.linalg.svd(triangle)
    vectors = turned[: len(values)].T
    kept = values > (values.max() if len(values) else 0.0) * 1e-10
    vectors, values = vectors[:, kept], values[kept]
    if not len(values):
        return vectors, values
    flip = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return vectors * np.where(flip == 0, 1, flip), values


def _listed(docs: DataFrame, y: DataFrame, turn: np.ndarray, kind: str) -> DataFrame:
    """(key, vector) of the row blocks times ``turn``; zeros for blocks that met no matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column(0).slice(i, 1).flatten()
                raw = batch.column(1)[i].as_py()
                found = _matrix(raw, len(turn)) @ turn if raw is not None else np.zeros((len(keys), turn.shape[1]))
                for part in _slices(len(keys)):
                    yield _list_batch(["key", "vector"], keys.slice(part.start, part.stop - part.start), found[part])

    return docs.join(y, "r", "left").select("keys", "packed").mapInArrow(run, f"key {kind}, vector array<double>")


def fold_rows(rows: DataFrame, basis: DataFrame, columns: int = params.SVD_COLUMNS) -> DataFrame:
    """(key, vector) of the sparse rows (key, idx, val) in the space of a stored basis (col, vector).

    The product of ``truncated_svd`` itself: tiles meet blocks of ``columns`` basis rows, so neither the basis nor a
    frequent term's rows are ever in one task, at any size of both sides.
    """
    numbers, width = basis.agg(F.max("col"), F.max(F.size("vector"))).first()
    width = width or 0
    kind = dict(rows.dtypes)["key"]
    if not width:
        return rows.select("key", F.array().cast("array<double>").alias("vector"))

    def pack(table: pa.Table) -> pa.Table:
        block = np.zeros((columns, width))
        at = table.column("col").to_numpy() % columns
        block[at] = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, width)
        return pa.table({"c": pa.array([table.column("c")[0].as_py()], pa.int32()), "packed": pa.array([_pack_matrix(block)], pa.binary())})

    keyed = basis.select(F.floor(F.col("col") / columns).cast("int").alias("c"), F.col("col").cast("int").alias("col"), "vector")
    z = keyed.groupBy("c").applyInArrow(pack, "c int, packed binary")
    wide = _wide(columns, width)
    tiles, docs = _tiles(rows, columns, wide)
    y = _Blocks(tiles, numbers + 1, columns, wide, width).forward(z, width)
    return _listed(docs, y, np.eye(width), kind)


def truncated_svd(
    rows: DataFrame,
    width: int,
    k: int = params.SVD_DIMENSIONS,
    passes: int = params.SVD_POWER_PASSES,
    oversample: int = params.SVD_OVERSAMPLE,
    seed: int = params.SEED,
    columns: int = params.SVD_COLUMNS,
    places: DataFrame | None = None,
) -> Reduction:
    """Leading ``k`` dimensions of the sparse rows (key, idx, val), not centred.

    The term-side matrix is a table of blocks of ``columns`` rows; only p x p matrices reach the driver.  ``places``
    (col, place) are the numbers that the random start depends on, so it is the same in any order of the columns.
    """
    p = min(k + oversample, width)
    wide = _wide(columns, p)
    tiles, docs = _tiles(rows, columns, wide)
    blocks = _Blocks(tiles, width, columns, wide, p)

    def start(table: pa.Table) -> pa.Table:
        c = table.column("c")[0].as_py()
        block = np.zeros((columns, p))
        block[table.column("col").to_numpy() - c * columns] = signs(table.column("place").to_numpy(), p, seed)
        return pa.table({"c": pa.array([c], pa.int32()), "packed": pa.array([_pack_matrix(block)], pa.binary())})

    if places is None:
        places = rows.sparkSession.range(width).select(F.col("id").alias("col"), F.col("id").alias("place"))
    keyed = places.select(F.floor(F.col("col") / columns).cast("int").alias("c"), F.col("col").cast("long").alias("col"), F.col("place").cast("long").alias("place"))
    z, width_z = keyed.groupBy("c").applyInArrow(start, "c int, packed binary"), p
    for _ in range(passes):
        y = store(blocks.forward(z, width_z), "scores", large=True)
        z = store(blocks.back(y, width_z), "basis", large=True)
        vectors, values = _right_factor(_triangle(z, "c", width_z))
        z, width_z = _times_small(z, "c", "int", width_z, vectors / values), len(values)
    y = store(blocks.forward(z, width_z), "scores", large=True) if width_z else blocks.tiles.limit(0).select("r", F.col("val").alias("packed"))
    turn, singular = _right_factor(_triangle(y, "r", width_z)) if width_z else (np.zeros((0, 0)), np.zeros(0))
    turn, singular = turn[:, :k], singular[:k]
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.arange(c * columns, min((c + 1) * columns, width), dtype=np.int32)
                yield _list_batch(["col", "vector"], ids, _matrix(raw, width_z)[: len(ids)] @ turn)

    vectors = _listed(docs, y, turn, dict(rows.dtypes)["key"])
    basis = z.select("c", "packed").mapInArrow(terms, "col int, vector array<double>")
    return Reduction(vectors, basis, singular)
