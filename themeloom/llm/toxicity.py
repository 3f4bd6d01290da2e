"""Toxicity scores by logistic regression with FTRL-proximal steps on hashed word n-grams and skip-grams.

Features of a text are the distinct words, word pairs and pairs with one word between, hashed to ``2**BITS`` places.
The learner gives every coordinate its own rate and holds it at zero until the summed gradients exceed the L1 bound, so
few weights remain; they are sent to the tasks as one array of fixed size (4 bytes a place).

It learns from a bounded sample of labelled rows (``MAX_TRAIN`` of them, chosen by a hash of the id, ``EPOCHS`` passes in
hash order), streamed through one task.  Scores cover whole texts of all rows.

A null label is no label; an id with several labels is toxic if one of them is.  Null and empty texts get the score of
the intercept.  With no labelled row every score is the sigmoid of ``PRIOR``.  A null id is scored and never learned
from, repeated rows are scored each, an empty table gives no rows, columns that are not asked for are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeloom.llm.batches import WORDS, array_of_lists, chained, leave_only, map_batches, map_texts, raw_texts

BITS = 20
MAX_TRAIN = 16_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
PRIOR = -3.0
_MARKS = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\"'()[]{}<>*_-~/\\|", bytes(range(97, 123)) + b" " * 23)


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Sorted places of the distinct features of a text; place 0 is the intercept's."""
    words = WORDS.of(text.translate(_MARKS).split())
    hashed = np.concatenate([chained(words, 1), chained(words, 2), chained(words, 2, 2)])
    return np.unique((hashed >> np.uint64(64 - bits)).astype(np.int32) | 1)


class FtrlProximal:
    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return PRIOR - self.bias_z / ((self.beta + self.bias_n ** 0.5) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, bias = self.weights(at), self.bias()
        error = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
        square, n = error * error, self.n[at]
        self.z[at] += error - (np.sqrt(n + square) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + square
        self.bias_z += error - ((self.bias_n + square) ** 0.5 - self.bias_n ** 0.5) / self.alpha * (bias - PRIOR)
        self.bias_n += square


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by place (float32); the intercept is at place 0.  ``labels``: (doc_id, toxic)."""
    known = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_label"))
        .withColumn("_order", F.md5(F.col("doc_id").cast("string")))
        .orderBy("_order").limit(max_train)
    )
    texts = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(known), "doc_id")  # max_train short rows

    def extract(batch: pa.RecordBatch) -> dict:
        places = [features(raw) for raw in raw_texts(batch.column(2))]
        return {"_order": batch.column(0), "_label": batch.column(1), "places": array_of_lists(places, pa.int32())}

    rows = map_batches(texts.select("_order", "_label", "_text"), extract, "_order string, _label int, places array<int>")
    passes = rows.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    ordered = passes.repartition(1).sortWithinPartitions("_pass", "_order", F.xxhash64("places"))  # max_train rows a pass

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = FtrlProximal()
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for label, a, b in zip(batch.column(0).to_pylist(), ends, ends[1:]):
                model.learn(flat[a:b], int(label > 0))
        weights = model.weights(np.arange(len(model.z)))
        weights[0] = model.bias()
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(weights[at], pa.float32())], ["place", "weight"])

    found = ordered.select("_label", "places").mapInArrow(learn, "place int, weight float").toArrow()
    out = np.zeros(1 << BITS, np.float32)
    out[0] = PRIOR
    out[found["place"].to_numpy()] = found["weight"].to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep`` and the ``score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 4 MB: 2**BITS places

    def run(texts: list[bytes]) -> np.ndarray:
        leave_only(WORDS)
        w = sent.value
        sums = np.array([float(w[features(raw)].sum(dtype=np.float64)) for raw in texts]) + float(w[0])
        return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))

    return map_texts(docs, run, "score double", keep=keep)


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text leaves no remainder by 5 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
