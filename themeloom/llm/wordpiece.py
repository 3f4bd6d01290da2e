"""Token counts by longest match, in time linear in the text.

The vocabulary is a trie of pieces, in which a leading mark says that a piece begins a word.  Every node has a failure
link (the node at which matching goes on when no edge fits) and the number of pieces that are popped on the way; the
walk adds these up and never builds a piece.  A character that no piece covers counts as its UTF-8 bytes.

Words end at ASCII white space.  Null and empty texts have no words and no tokens.  A null id stays null, repeated rows
are counted each, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeloom.llm.batches import CACHE_WORDS, map_batches, raw_texts

WORD_MARK = "▁"


class LongestMatch:
    """Automaton of ``pieces``; ``count(word)`` is the number of pieces of the word's greedy longest matches."""

    def __init__(self, pieces):
        self.next: list[dict[str, int]] = [{}]
        ends, parents = {0: False}, [(0, "")]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    parents.append((node, c))
                    self.next.append({})
                node = self.next[node][c]
            ends[node] = True
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        layer = [0]
        while layer:
            layer = [child for node in layer for child in self.next[node].values()]
            for node in layer:
                if ends.get(node):
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                parent, c = parents[node]
                at, popped = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.next[at]:
                    popped += self.popped[at]
                    at = self.fail[at]
                # A prefix that no pieces cover ends in a character that stands alone: it counts as its bytes.
                if at >= 0:
                    self.fail[node], self.popped[node] = self.next[at][c], popped
                else:
                    self.fail[node], self.popped[node] = 0, popped + len(c.encode())

    def count(self, word: str) -> int:
        follow, fail, popped = self.next, self.fail, self.popped
        total = at = 0
        for c in word:
            while True:
                step = follow[at].get(c)
                if step is not None:
                    at = step
                    break
                if at == 0:
                    total += len(c.encode())
                    break
                total += popped[at]
                at = fail[at]
        while at:
            total += popped[at]
            at = fail[at]
        return total


class WordCounts(dict):
    """Tokens of words (bytes), each counted once while the cache holds it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        self.automaton = LongestMatch(model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i))

    def __missing__(self, word: bytes) -> int:
        value = self.automaton.count(WORD_MARK + word.decode())
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


_COUNTS: dict[str, WordCounts] = {}


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row, by the pieces of the SentencePiece model file ``path``."""

    def run(batch: pa.RecordBatch) -> dict:
        if path not in _COUNTS:
            _COUNTS[path] = WordCounts(path)
        known = _COUNTS[path].__getitem__
        words = [raw.split() for raw in raw_texts(batch.column(1))]
        return {"doc_id": batch.column(0), "n_words": [len(w) for w in words], "n_tokens": [sum(map(known, w)) for w in words]}

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_tokens bigint")
