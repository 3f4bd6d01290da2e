"""Runs of repeated word sequences, found through a Re-Pair grammar of each document.

A run is a stretch of consecutive words with smallest period q, at least ``least_length`` and ``least_exponent`` * q words
long, that no neighbouring word extends.  In a task, for each document:

1. Every word of a run stands in it ``least_exponent`` times or more.  The document is cut at words that occur less
   often, the pieces are cut again by their own counts until nothing changes, and pieces under ``least_length`` hold no run.
2. Re-Pair replaces the most frequent pair of neighbouring symbols (the earliest pair between equal counts) by a new
   nonterminal until no pair occurs twice; what is left is put together by a balanced tree.  Each nonterminal X -> A B
   keeps the places where it was put, which are all its places in the derivation.
3. For each X, once: the stretches of its expansion that cross the boundary of A and B and have a period.  A period's two
   sides agree at the boundary's word, so the distances to the same word in X are the only candidates; how far each
   reaches is looked up in names of power-of-two substrings, for all nonterminals of a block of documents at a time.
4. The stretches are moved to all places of X, and those of one period that overlap by a period are merged.  A run lies
   whole in the lowest nonterminal that covers it and crosses its boundary, so every run is found; between equal stretches
   the smallest period stays.

There is no shuffle; a document is handled by one task, whose memory grows with its longest document (a few hundred bytes a
word that may lie in a run).  Null and empty texts have no words, no runs and an empty collapsed text.  Rows that repeat and
null ids give a row each.  An empty table gives no rows.  Other columns than the two named are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeloom.llm.batches import raw_texts

LEAST_LENGTH = 24
LEAST_EXPONENT = 3
#: Words that may lie in runs, searched together.
BLOCK_WORDS = 200_000
#: Bytes of text whose rows are given back together.
BLOCK_BYTES = 8_000_000
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_SHAPE = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ("collapsed", pa.string()),
])


def stretches(words: list, least_length: int, least_count: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces in which every word occurs ``least_count`` times; shorter pieces are left out."""
    out, todo = [], [(0, len(words))] if len(words) >= least_length else []
    while todo:
        start, end = todo.pop()
        part = words[start:end]
        counts = Counter(part)
        if min(counts.values()) >= least_count:
            out.append((start, end))
            continue
        at = 0
        cuts = [i for i, w in enumerate(part) if counts[w] < least_count]
        for cut in [*cuts, len(part)]:
            if cut - at >= least_length:
                todo.append((start + at, start + cut))
            at = cut + 1
    return sorted(out)


def repair(symbols: list[int], at: int = 0) -> list[tuple[int, int, list[int]]]:
    """Nonterminals of a Re-Pair grammar as (length of the first part, length, places); places count from ``at``."""
    n = len(symbols)
    seq, size = list(symbols), [1] * n  # by place; only a symbol's first place counts
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i, pair in enumerate(zip(seq, seq[1:])):
        places.setdefault(pair, []).append(i)
    heap = [(-len(p), k, pair) for k, (pair, p) in enumerate(places.items()) if len(p) > 1]
    heapq.heapify(heap)
    made, stamp, fresh, lengths = [], len(places), max(seq) + 1, {}
    while heap:
        count, _, pair = heapq.heappop(heap)
        if pair not in places:
            continue
        a, b = pair
        found, end = [], -1
        for i in places[pair]:  # places in order; an overlapping one is left out
            if i >= end and seq[i] == a and (j := after[i]) < n and seq[j] == b:
                found.append(i)
                end = j + 1
        if len(found) < -count:
            if len(found) > 1:
                places[pair] = found
                stamp += 1
                heapq.heappush(heap, (-len(found), stamp, pair))
            else:
                del places[pair]
            continue
        del places[pair]
        first, total = lengths.get(a, 1), lengths.get(a, 1) + lengths.get(b, 1)
        x, fresh = fresh, fresh + 1
        lengths[x] = total
        new: dict[tuple[int, int], list[int]] = {}
        for i in found:
            j = after[i]
            seq[i], seq[j], size[i] = x, -1, total
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new.setdefault((x, seq[k]), []).append(i)
            if (h := before[i]) >= 0:
                new.setdefault((seq[h], x), []).append(h)
        for key, where in new.items():
            if len(where) > 1:
                places[key] = where
                stamp += 1
                heapq.heappush(heap, (-len(where), stamp, key))
        made.append((first, total, [i + at for i in found]))
    row, i = [], 0
    while i < n:
        row.append((i, size[i]))
        i = after[i]
    while len(row) > 1:  # a balanced tree over what is left
        level = []
        for (i, first), (_, second) in zip(row[::2], row[1::2]):
            made.append((first, first + second, [i + at]))
            level.append((i, first + second))
        row = level + row[len(row) // 2 * 2:]
    return made


class Reach:
    """How far two places of ``symbols`` agree; ``names[k]`` numbers the substrings of 2 ** k symbols."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.names = [symbols]
        while 2 << (len(self.names) - 1) <= longest:
            low, step = self.names[-1], 1 << (len(self.names) - 1)
            pairs = low[:-step].astype(np.int64) << 32 | low[step:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def forward(self, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Symbols that agree from ``a`` and from ``b`` > ``a`` on, before ``end``."""
        found = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            ok = np.flatnonzero(b + found + (1 << k) <= end)
            ok = ok[self.names[k][a[ok] + found[ok]] == self.names[k][b[ok] + found[ok]]]
            found[ok] += 1 << k
        return found

    def backward(self, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Symbols that agree before ``a`` and before ``b`` > ``a``, from ``start`` on."""
        found = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            ok = np.flatnonzero(a - found - (1 << k) >= start)
            ok = ok[self.names[k][a[ok] - found[ok] - (1 << k)] == self.names[k][b[ok] - found[ok] - (1 << k)]]
            found[ok] += 1 << k
        return found


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the ranges ``start`` .. ``start + count``."""
    owner = np.repeat(np.arange(len(start)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def runs_of(pieces: list[list], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (place, length, period) of all runs; places count over the pieces laid end to end, and no run spans two."""
    symbols, nodes, at = [], [], 0
    for piece in pieces:
        number: dict = {}
        ids = [number.setdefault(w, len(number)) for w in piece]
        nodes += [node for node in repair(ids, at) if node[1] >= least_length]
        shift = symbols[-1].max() + 1 if symbols else 0  # no symbol of two pieces is the same
        symbols.append(np.array(ids, np.int32) + shift)
        at += len(piece)
    if not nodes:
        return np.zeros((0, 3), np.int64)
    text = np.concatenate(symbols)
    low = np.array([places[0] for _, _, places in nodes])
    middle = low + np.array([first for first, _, _ in nodes])
    width = np.array([total for _, total, _ in nodes])
    high = low + width
    # Same words within a third (for three periods) of the nonterminal, on either side of the boundary.
    code = text.astype(np.int64) * (len(text) + 1) + np.arange(len(text))
    order = np.sort(code)
    farthest = width // least_exponent
    base = text[middle].astype(np.int64) * (len(text) + 1)
    left = np.searchsorted(order, base + np.maximum(low, middle - farthest))
    right = np.searchsorted(order, base + np.minimum(high - 1, middle + farthest), "right")
    node, index = _ranges(left, right - left)
    other = order[index] % (len(text) + 1)
    node, other = node[other != middle[node]], other[other != middle[node]]
    a, b = np.minimum(other, middle[node]), np.maximum(other, middle[node])
    period = b - a
    reach = Reach(text, int(width.max()))
    start = a - reach.backward(a, b, low[node])
    end = b + reach.forward(a, b, high[node])
    good = (start < middle[node]) & (end - start >= np.maximum(least_length, least_exponent * period))
    node, start, end, period = node[good], start[good], end[good], period[good]
    # To all places of the nonterminal.
    count = np.array([len(places) for _, _, places in nodes])
    where = np.concatenate([np.array(places) for _, _, places in nodes])
    first = np.cumsum(count) - count
    owner, index = _ranges(first[node], count[node])
    move = where[index] - low[node[owner]]
    return merged(start[owner] + move, end[owner] + move, period[owner])


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows (place, length, period): stretches of a period that share a period's length are one; of equal ones the
    smallest period stays."""
    if not len(start):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    span = int(end.max()) + 1
    upto = np.maximum.accumulate(end + period * span) - period * span  # farthest end so far in the period
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] > upto[:-1] - period[1:])
    heads = np.flatnonzero(new)
    rows = np.stack([start[heads], np.maximum.reduceat(end, heads) - start[heads], period[heads]], axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
    return rows[np.concatenate([[True], ~same])]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that any run contains after its first period."""
    if not runs:
        return words
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period: start + length] = bytes(length - period)
    return list(compress(words, keep))


def find_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, doc_id: str = "doc_id",
              text: str = "text", change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, n_words, runs`` (by start, then period; starts are word numbers) and the ``collapsed`` text.

    Words end at ASCII white space.  ``change`` may give other words for a document before the search.
    """
    if least_exponent < 2:
        raise ValueError("least_exponent is 2 or more")

    def rows(block: list[tuple], found: dict[int, list]) -> pa.RecordBatch:
        ids, words = [d for d, _ in block], [w for _, w in block]
        runs = [found.get(i, []) for i in range(len(block))]
        texts = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs)]
        shown = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip([ids, list(map(len, words)), shown, texts], _SHAPE)], schema=_SHAPE)

    def search(owners: list[tuple[int, int]], pieces: list[list], found: dict[int, list]) -> None:
        ends = np.cumsum([len(p) for p in pieces])
        for place, length, period in runs_of(pieces, least_length, least_exponent).tolist():
            piece = int(np.searchsorted(ends, place, "right"))
            row, offset = owners[piece]
            found.setdefault(row, []).append((place - int(ends[piece]) + len(pieces[piece]) + offset, length, period))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), raw_texts(batch.column(1))
            block, found, owners, pieces, held, size = [], {}, [], [], 0, 0
            for doc, raw in zip(ids, texts):
                words = raw.split()
                if change:
                    words = change(doc, words)
                for start, end in stretches(words, least_length, least_exponent):
                    owners.append((len(block), start))
                    pieces.append(words[start:end])
                    held += end - start
                block.append((doc, words))
                size += len(raw)
                if held >= BLOCK_WORDS:
                    search(owners, pieces, found)
                    owners, pieces, held = [], [], 0
                if size >= BLOCK_BYTES:
                    if pieces:
                        search(owners, pieces, found)
                    yield rows(block, found)
                    block, found, owners, pieces, held, size = [], {}, [], [], 0, 0
            if pieces:
                search(owners, pieces, found)
            yield rows(block, found)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
