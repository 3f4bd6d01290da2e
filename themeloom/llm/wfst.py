"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The transducer is compiled from a model file: the normaliser writes a word mark for each space (and one in front of a
text), the piece lexicon is a trie with an arc for each piece, and byte fallback gives every other character an arc of
byte pieces.  Composing it with an input yields a lattice whose states are (position, last piece).  An arc costs nothing
after a piece beside which the merge rules leave it in place, and infinity (the tropical zero) after any other.  The tropical shortest path through the lattice then is the model's own segmentation.  Transitions between
states are worked out when first needed and kept, as in delayed composition.

The models covered are of the merge (BPE) kind with byte fallback and an identity character map; others raise an error.

No piece holds a word mark behind another character, and characters without a piece never merge, so a text is composed
chunk by chunk; chunks are kept in a bounded cache.

Null and empty texts have no ids and decode to an empty text.  A null id stays null, repeated rows are encoded each, an
empty table gives no rows.  Columns that are not asked for are not read.
"""

from __future__ import annotations

import math
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeloom.llm.batches import array_of_lists, map_batches, raw_texts

MARK = "▁"
TRANSITIONS = 1_000_000
#: Chunks a worker keeps in each of two generations: the older one is dropped when the newer one is full.
CHUNKS = 200_000
LONGEST = 64  # characters of a chunk that is kept
_TRAINER, _TYPE, _UNIGRAM, _MERGE = 2, 3, 1, 2
_NORMALIZER, _NAME, _CHARS, _PREFIX, _SQUEEZE, _ESCAPE = 3, 1, 2, 3, 4, 5


def _fields(raw: bytes):
    """(number, value) of the fields of a serialised message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at: at + size]
            at += size


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        parts = dict(_fields(model.serialized_model_proto()))
        if dict(_fields(parts.get(_TRAINER, b""))).get(_TYPE, _UNIGRAM) != _MERGE:
            raise ValueError("only models of the merge (BPE) kind are covered")
        rules = dict(_fields(parts.get(_NORMALIZER, b"")))
        if rules.get(_CHARS) or rules.get(_SQUEEZE, 1) or not rules.get(_ESCAPE, 1):
            raise ValueError("only models with an identity normaliser are covered")
        self.prefix = bool(rules.get(_PREFIX, 1))
        size = model.get_piece_size()
        self.bytes_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in self.bytes_id):
            raise ValueError("only models with byte fallback are covered")
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece spans two words")
        self.rank = {i: -model.get_score(i) for i in plain}
        self.text = [b""] * size
        for piece, i in self.id_of.items():
            self.text[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes_id):
            self.text[i] = bytes([b])
        unknown = model.unk_id()
        self.text[unknown] = " ⁇ ".encode()
        self.left, self.right = {}, {}
        self.trie: list[dict] = [{}]
        self.ends: dict[int, int] = {}
        for piece, i in self.id_of.items():
            if self._derive(piece, i):
                node = 0
                for c in piece:
                    if c not in self.trie[node]:
                        self.trie[node][c] = len(self.trie)
                        self.trie.append({})
                    node = self.trie[node][c]
                self.ends[node] = i
        self.names = {i: p for p, i in self.id_of.items()}
        self.merged = {p: self.rank[i] for p, i in self.id_of.items()}
        self.pairs = {p[k: k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.ending, self.starting = {}, {}
        self.joins: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _derive(self, piece: str, i: int) -> bool:
        """Find the merge that makes a piece; False if the merge rules never make it from its characters."""
        if len(piece) == 1:
            return True
        parts = list(piece)
        while len(parts) > 2:
            ranks = [self.rank.get(self.id_of.get(a + b), math.inf) for a, b in zip(parts, parts[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == math.inf:
                return False
            parts[k: k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) < 2 or any(p not in self.id_of for p in parts):
            return False
        self.left[i], self.right[i] = self.id_of[parts[0]], self.id_of[parts[1]]
        return True

    def _edge(self, i: int, side: dict) -> list[tuple[str, float, float]]:
        """(piece, made at, merged away at) of what stands at one edge of a piece while it is built."""
        out, until = [], math.inf
        while True:
            made = self.rank[i] if i in side else -math.inf
            out.append((self.names[i], made, until))
            if i not in side:
                return out
            i, until = side[i], self.rank[i]

    def stays(self, a: int, b: int) -> bool:
        """Whether the boundary between pieces ``a`` and ``b`` outlasts all merges."""
        if a < 0 or b < 0:
            return True
        if a not in self.ending:
            self.ending[a] = self._edge(a, self.right)
        if b not in self.starting:
            self.starting[b] = self._edge(b, self.left)
        merged = self.merged
        for x, x_made, x_until in self.ending[a]:
            for y, y_made, y_until in self.starting[b]:
                rank = merged.get(x + y)
                if rank is None:
                    continue
                made = x_made if x_made > y_made else y_made
                at = rank if rank > made else made
                if made < x_until and made < y_until and at < x_until and at <= y_until:
                    return False
        return True

    def segment(self, chunk: str) -> list[int]:
        """Ids of the shortest path.

        Whatever its merges, a prefix has one segmentation, so one state of each position has a finite cost and the
        first arc of finite cost into a position is its shortest path.  A character of byte pieces is a state below 0.
        """
        size, trie, ends, joins = len(chunk), self.trie, self.ends, self.joins
        last, before = [None] * (size + 1), [0] * (size + 1)
        last[0] = -1
        for i in range(size):
            here = last[i]
            if chunk[i] not in self.id_of:
                last[i + 1], before[i + 1] = -2 - ord(chunk[i]), i
                continue
            node, j, base = 0, i, here << 20
            while j < size:
                node = trie[node].get(chunk[j])
                if node is None:
                    break
                j += 1
                piece = ends.get(node)
                if piece is None or last[j] is not None:
                    continue
                if here >= 0:
                    free = joins.get(base | piece)
                    if free is None:
                        free = self.stays(here, piece)
                        if len(joins) < TRANSITIONS:
                            joins[base | piece] = free
                    if not free:
                        continue
                last[j], before[j] = piece, i
        out, at = [], size
        while at:
            out.append(last[at])
            at = before[at]
        ids = []
        for piece in reversed(out):
            ids += [piece] if piece >= 0 else [self.bytes_id[b] for b in chr(-2 - piece).encode()]
        return ids

    def parts(self, chunk: str) -> list[str]:
        """Cut a chunk where no piece holds the two characters side by side: nothing merges there."""
        out, start, pairs = [], 0, self.pairs
        for k in range(1, len(chunk)):
            if chunk[k - 1: k + 1] not in pairs:
                out.append(chunk[start:k])
                start = k
        out.append(chunk[start:])
        return out

    _CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")

    def composed(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            parts = self.parts(chunk)
            if len(parts) > 1:
                ids = b"".join(self.chunks.get(c) or self.composed(c) for c in parts)
            else:
                ids = struct.pack(f"<{len(found := self.segment(chunk))}i", *found)
        if len(chunk) <= LONGEST:
            if len(self.chunks) >= CHUNKS:
                self.chunks, self.older = {}, self.chunks
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " " or not self.prefix:
            chunks = self._CHUNK.findall(MARK * self.prefix + text.replace(" ", MARK))
        else:
            chunks = (MARK + text.replace(" ", " " + MARK)).split(" ")
        get = self.chunks.get
        out = [get(c) for c in chunks]
        if None in out:
            out = [self.composed(c) if x is None else x for c, x in zip(chunks, out)]
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


_TRANSDUCERS: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _TRANSDUCERS:
        _TRANSDUCERS[path] = Transducer(path)
    return _TRANSDUCERS[path]


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``ids array<int>`` of every row."""
    kept = docs.select(*keep, F.col(text).alias("_text"))

    def run(batch: pa.RecordBatch) -> dict:
        of = transducer(path).encode
        ids = [of(raw.decode()) for raw in raw_texts(batch.column(len(keep)))]
        return {**{c: batch.column(i) for i, c in enumerate(keep)}, "ids": array_of_lists(ids, pa.int32())}

    return map_batches(kept, run, f"{_kinds(kept.drop('_text'))}, ids array<int>")


def decode(rows: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and the ``decoded`` text of every row; null ids are an empty text."""
    kept = rows.select(*keep, F.coalesce(ids, F.array().cast("array<int>")).alias("_ids"))

    def run(batch: pa.RecordBatch) -> dict:
        of, lists = transducer(path).decode, batch.column(len(keep))
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        texts = [of(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
        return {**{c: batch.column(i) for i, c in enumerate(keep)}, "decoded": texts}

    return map_batches(kept, run, f"{_kinds(kept.drop('_ids'))}, decoded string")
