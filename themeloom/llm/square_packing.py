"""Sum-of-squares bin packing of tokenised documents into fixed windows, without cutting what fits.

A document longer than a window is cut into whole windows and a last, shorter piece; nothing else is cut.  Each piece goes
into the open bin, or a new one, that makes the sum over residual gaps of the squared number of open bins with that gap
smallest; between equal sums the smallest gap is taken.

A task holds pieces of at most ``BLOCK_BYTES`` and places them from the longest to the shortest, so short pieces fill the
gaps of long ones.  Bins that fill up leave; at the end of the block the others leave too, marked open.  The first round's
pieces are written to the shared folder.  The pieces of open bins, some dozens of bins for each block where short documents
are at hand, are packed once more by the same rule in as few blocks as hold them, so only those last blocks leave gaps.

A task's bins depend on its rows and their order only; read from files, a task that runs again writes the same rows.
Null and empty texts are documents of one end token.  A null id stays null.  Rows that repeat are packed each.  An empty
table gives no rows.  Other columns than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from themeloom.llm.batches import raw_texts
from themeloom.llm.packing import tokenizer
from themeloom.session import store

WINDOW = 4096
END_ID = 1
#: Bytes of ids (4 a token) a task packs together; its memory is a small multiple of it.
BLOCK_BYTES = 48_000_000
_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
_PLACE = "sequence_id bigint, offset bigint"
_SHAPE = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()),
])


class SquarePacker:
    """Bins of ``size``, known by number; ``gaps`` has the number of open bins with each residual gap."""

    def __init__(self, size: int):
        self.size = size
        self.gaps = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.bins = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of ``length``, 1 to ``size``."""
        size, gaps = self.size, self.gaps
        if length < size:
            left = np.flatnonzero(gaps[length:])  # gaps that would be left, in the order of the gaps held
            if len(left):
                change = 2 * (gaps[left] - gaps[left + length]) + 2
                if not left[0]:  # a full bin is not open and counts nowhere
                    change[0] = 1 - 2 * gaps[length]
                best = int(np.argmin(change))
                if change[best] <= 2 * gaps[size - length] + 1:  # no worse than a new bin
                    gap = int(left[best]) + length
                    number = self.open[gap].pop()
                    gaps[gap] -= 1
                    self._put(number, gap - length)
                    return number, size - gap
        number = self.bins
        self.bins += 1
        self._put(number, size - length)
        return number, 0

    def _put(self, number: int, gap: int) -> None:
        if gap:
            self.open[gap].append(number)
            self.gaps[gap] += 1

    def unfilled(self) -> set[int]:
        return {n for bins in self.open for n in bins}


def place_all(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and whether the bin keeps a gap for each piece; placed from the longest to the shortest."""
    packer = SquarePacker(size)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], offsets[i] = packer.place(int(lengths[i]))
    return bins, offsets, np.isin(bins, np.fromiter(packer.unfilled(), np.int64))


def _packed(pieces: list[tuple], size: int, first: int) -> pa.RecordBatch:
    """Rows of one block; bins are numbered from ``first``."""
    columns = list(map(list, zip(*pieces)))
    bins, offsets, unfilled = place_all(np.array(columns[3], np.int64), size)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _SHAPE)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(bins + first), pa.array(offsets), pa.array(unfilled)], schema=_SHAPE)


def _blocks(pieces: Iterator[tuple], size: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 33
    block, held = [], 0

    def shown() -> Iterator[pa.RecordBatch]:
        nonlocal block, held, first
        rows = _packed(block, size, first)
        first += len(block)  # a block has no more bins than pieces
        block, held = [], 0
        step = max(1, 8_000_000 // (4 * size))
        yield from (rows.slice(at, step) for at in range(0, rows.num_rows, step))

    for piece in pieces:
        block.append(piece)
        held += 4 * piece[3] + 100
        if held >= block_bytes:
            yield from shown()
    if block:
        yield from shown()


def cut(docs: DataFrame, path: str, window: int, end_id: int, block_bytes: int) -> DataFrame:
    """Pieces of the documents with the bins of a first round."""
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode = tokenizer(path).encode
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                ids = encode(raw) + end
                total = len(ids) // 4
                for number, start in enumerate(range(0, total, window)):
                    part = ids[4 * start: 4 * (start + window)]
                    yield doc, number, start, len(part) // 4, part

    return docs.mapInArrow(lambda batches: _blocks(pieces(batches), window, block_bytes), f"{_PIECE}, {_PLACE}, open boolean")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pieces of all documents: ``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit), ``sequence_id,
    offset``.  Each document is its ids by the tokenizer file ``path`` and then ``end_id``."""
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    first = store(cut(read, path, window, end_id, block_bytes), "square_packing")
    rest = first.filter("open")
    held = rest.agg(F.coalesce(F.sum(4 * F.col("length") + 100), F.lit(0))).first()[0]
    names = ["doc_id", "piece", "start", "length", "ids"]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[batch.column(i).to_pylist() for i in range(len(names))]))
        return _blocks(rows, window, block_bytes)

    groups = -(-held // (block_bytes // 2)) or 1  # half full on average, so that uneven ones fit a block
    dealt = rest.select(*names).repartition(groups, F.xxhash64("doc_id", "piece")).sortWithinPartitions("doc_id", "piece", "ids")
    last = dealt.mapInArrow(again, f"{_PIECE}, {_PLACE}, open boolean")
    kept = first.filter("NOT open").withColumn("sequence_id", F.col("sequence_id") * 2)
    return kept.unionByName(last.withColumn("sequence_id", F.col("sequence_id") * 2 + 1)).drop("open")
