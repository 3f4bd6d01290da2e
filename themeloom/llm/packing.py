"""Sum-of-squares online packing of tokenised documents into fixed windows.

A task reads its documents one after the other.  Whole windows of a document become sequences of their own; what is
left is put into the open window at the fill level which makes the sum of squared level counts smallest (the level
array holds, for each fill level, the open windows at it).  When too many windows are open, and at the end, they are
closed: one that holds a power of two tokens needs no padding and stays, the others are laid end to end and cut into
full windows, and the last part into powers of two.  Nothing is padded then, and no token is lost.

There is no shuffle.  A task's result depends on its rows and their order only; read from files, a task that runs again
writes the same rows.

Null and empty texts are documents of one end token.  A null id stays null.  Rows that repeat are packed each.  An empty
table gives no rows.  Other columns than the two named are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from themeloom.llm.batches import CACHES, leave_only, raw_texts

WINDOW = 4096
END_ID = 2
#: Open windows of a task; their tokens are held in memory (4 bytes each).
OPEN_WINDOWS = 2_000
FLUSH_BYTES = 8_000_000
#: Chunks in one generation of a worker's cache, about 200 bytes each.
CACHE_CHUNKS = 250_000
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class CachedTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins text across it, so ASCII white space cuts a text into chunks that
    are looked up one by one.  A chunk of letters below U+0250, where lower-casing and composition are settled
    character by character, is cut by the tokenizer's own pattern and each piece goes to its model; any other chunk goes
    to the whole tokenizer.  Known chunks and pieces are held in two generations of at most ``entries`` each: when the
    younger one is full it becomes the older one, so words that are still in use stay.
    """

    # Fixed value: the pre-tokenizer pattern of the tokenizer file.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, entries: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.numbers = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.entries = entries
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def keep(self, raw: bytes, ids: bytes) -> bytes:
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        self.young[raw] = ids
        return ids

    def piece(self, raw: bytes) -> bytes:
        """Ids of one piece of the pattern, lower-cased."""
        found = self.young.get(raw)
        if found is None:
            found = self.old.get(raw)
            if found is None:
                shown = raw.decode() if raw.isascii() else raw.decode("latin-1").translate(self.letters)
                numbers = self.numbers
                found = b"".join([numbers[t.id] for t in self.model.tokenize(shown)])
            self.keep(raw, found)
        return found

    def chunk(self, raw: bytes) -> bytes:
        """Ids of a chunk without white space, in which A-Z are lower-cased unless it has ``<|``."""
        if raw.isalpha():
            return self.piece(raw)
        found = self.young.get(raw) or self.old.get(raw)
        if found is not None:
            return self.keep(raw, found)
        if raw[:-1].isalpha() and 32 < raw[-1] < 127:
            return self.keep(raw, self.piece(raw[:-1].lower()) + self.piece(raw[-1:]))
        text = raw.decode()
        if "<|" in text or max(text) >= "ɐ" or not text.isprintable():
            return self.keep(raw, self.whole(text))
        lower = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
        return self.keep(raw, b"".join([self.piece(p.encode()) for p in self.PIECES.findall(lower)]))

    def encode(self, text: bytes) -> bytes:
        marked = b"<|" in text
        chunks = (text if marked else text.lower()).split()
        if marked:
            return b"".join([self.chunk(c if b"<|" in c else c.lower()) for c in chunks])
        out = list(map(self.young.get, chunks))
        if None in out:
            chunk = self.chunk
            out = [chunk(c) if x is None else x for c, x in zip(chunks, out)]
        return b"".join(out)


_TOKENIZERS: dict[str, CachedTokenizer] = {}
CACHES.append(_TOKENIZERS)


def tokenizer(path: str) -> CachedTokenizer:
    leave_only(_TOKENIZERS)
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


class Packer:
    """Windows of ``size`` tokens; ``closed`` collects (doc, start, ids, doc tokens, sequence, offset)."""

    def __init__(self, size: int, first_sequence: int = 0, open_windows: int = OPEN_WINDOWS):
        self.size, self.next, self.limit = size, first_sequence, open_windows
        self.open: dict[int, list[list]] = {}  # level -> windows; a window is a list of (doc, start, ids, doc tokens)
        self.counts = np.zeros(size + 1, np.int64)  # counts[0] stays 0: a new window costs no count
        self.opened = self.held = 0
        self.closed: list[tuple] = []

    def close(self, window: list) -> None:
        offset = 0
        for doc, start, ids, total in window:
            self.closed.append((doc, start, ids, total, self.next, offset))
            offset += len(ids) // 4
            self.held += len(ids)
        self.next += 1

    def level_for(self, length: int) -> int:
        """Fill level to put ``length`` tokens on: least sum of squares, then the fullest."""
        size, counts = self.size, self.counts
        before = counts[: size - length + 1]
        after = counts[length:].copy()
        after[-1] = 0  # full windows leave the array
        change = 2 * (after - before) + 2
        change[-1] -= 1
        change[0] = 2 * after[0] + 1 if length < size else 0
        change[1:][before[1:] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.size
        for start in range(0, whole, self.size):
            self.close([(doc, start, ids[4 * start: 4 * (start + self.size)], total)])
        length = total - whole
        if not length:
            return
        piece = (doc, whole, ids[4 * whole:], total)
        level = self.level_for(length)
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
            self.opened -= 1
        else:
            window = []
        window.append(piece)
        if level + length == self.size:
            self.close(window)
            return
        self.open.setdefault(level + length, []).append(window)
        self.counts[level + length] += 1
        self.opened += 1
        if self.opened > self.limit:
            self.finish()

    def finish(self) -> None:
        """Close the open windows without padding."""
        loose = []
        for level, windows in sorted(self.open.items()):
            for window in windows:
                if level & (level - 1) == 0:
                    self.close(window)
                else:
                    loose += window
        self.open.clear()
        self.counts[:] = 0
        self.opened = 0
        left = sum(len(p[2]) for p in loose) // 4
        room = self._room(left)
        window, pending = [], loose[::-1]
        while pending:
            doc, start, ids, total = pending.pop()
            length = len(ids) // 4
            if length > room:
                pending.append((doc, start + room, ids[4 * room:], total))
                ids, length = ids[: 4 * room], room
            window.append((doc, start, ids, total))
            room, left = room - length, left - length
            if not room:
                self.close(window)
                window, room = [], self._room(left)

    def _room(self, left: int) -> int:
        return self.size if left >= self.size else 1 << max(0, left.bit_length() - 1)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
         open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens,
    sequence_id, offset``.  Each document is its ids by the tokenizer file ``path`` and then ``end_id``."""
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def rows(packer: Packer) -> pa.RecordBatch:
        got, packer.closed, packer.held = packer.closed, [], 0
        doc, start, ids, total, sequence, offset = map(list, zip(*got)) if got else ([] for _ in range(6))
        values = [doc, start, [len(x) // 4 for x in ids], ids, total, sequence, offset]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        packer = Packer(window, TaskContext.get().partitionId() << 33, open_windows)
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                packer.add(doc, encode(raw) + end)
                if packer.held > FLUSH_BYTES:
                    yield rows(packer)
        packer.finish()
        yield rows(packer)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
