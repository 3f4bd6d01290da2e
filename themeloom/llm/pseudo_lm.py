"""Masked pseudo-likelihood of documents by a bidirectional window network.

Every token is predicted from ``REACH`` tokens on either side, never from itself.  Each place of the window has its own
table of token vectors; their sum goes through tanh, and two softmax layers give the token: first its class, then the
token within the class.  A document's score is the sum of the log-probabilities of all its tokens.

Tokens: words of all documents are counted; every word with ``LEAST`` occurrences (and the ``FREQUENT`` most frequent in
any case) has a token of its own, every other word falls in a bucket by its hash, one bucket for three words with a token.
So words, buckets and classes follow the corpus.  The probability of a word in a bucket is the bucket's times the word's
share of the bucket's occurrences; the shares come from the stored counts, by a join.  A token's class holds tokens of
similar frequency, few if they are frequent: the roots of their shares sum to about one, so that the two layers of a place
have the fewest outputs on average.  The output biases start from the counts.

Training runs in ``ROUNDS``.  In a round, each task trains its own copy by Adagrad on its part of the documents (a
round's share is chosen by a hash of the id), on the windows at all places of these, and sends back its parameters; their
mean, weighted by windows, starts the next round.  The windows of 256 documents come in random order, but in bunches whose
targets are of one class: a step then works on a few classes with many windows each, not on all with a few.  So every place of every document is a target once.  The mean is taken block by block in Spark
(first over few tasks, then over these), so the driver only sees one model, 120 numbers for each token.  There is one task
for each core, as each sends a whole model; the model is not split, every task holds it.  What is gathered grows with the
tokens and with the words in buckets, hence with the input.

Words end at ASCII white space, A-Z are lower-cased.  Null and empty texts have no tokens and score 0.  A null id is
scored; repeated rows are scored each.  An empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from themeloom.llm.batches import WORDS, array_of_lists, map_batches, raw_texts
from themeloom.session import store

LEAST = 100
FREQUENT = 768
WORDS_A_BUCKET = 3
REACH = 2
WIDTH = 24
ROUNDS = 2
RATE = 0.1
START_SQUARES = 1e-6
WINDOWS_AT_ONCE = 1_024
TOKENS_AT_ONCE = 32_768
#: Rows that fit a core's cache in a pass over the classes.
ROWS_AT_ONCE = 2_048
BUNCH = 64
BLOCK = 8_192
BLOCKS_AT_ONCE = 64
TREE = 16
SEED = 11
#: What the words that were not counted have of each bucket's occurrences.
UNSEEN = 0.5


def token_hashes(text: bytes) -> np.ndarray:
    return WORDS.of(text.lower().split())


class Vocabulary:
    """Token numbers of word hashes: frequent words first, in the order of their counts, then the buckets."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, totals: np.ndarray):
        """``frequent``: hashes of the words that have a token, the most frequent first, and their ``counts``; ``totals``:
        occurrences of the other words in each bucket."""
        self.frequent, self.hashed = len(frequent), len(totals)
        self.shares = np.concatenate([counts, totals]) + 0.5
        self.shares /= self.shares.sum()
        self.sizes = class_sizes(self.shares)
        self.classes, self.per_class = len(self.sizes), int(self.sizes.max())
        self.log_totals = np.log(totals + UNSEEN)
        self.order = np.argsort(frequent)
        self.sorted = frequent[self.order]

    def network(self, flat: np.ndarray | None = None) -> WindowNetwork:
        return WindowNetwork(flat, sizes=self.sizes)

    def start(self) -> WindowNetwork:
        """The network before training, the same wherever it is made."""
        net = self.network()
        net.start_from(self.shares)
        return net

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        other = self.frequent + bucket_of(hashes, self.hashed)
        if not self.frequent:
            return other
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.frequent - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], other)


def class_sizes(shares: np.ndarray) -> np.ndarray:
    """Tokens in each class, for tokens in their order.

    A place costs the number of classes and the size of its token's class.  The sum is least on average if a class is as
    large as the inverse root of its tokens' shares.
    """
    roots = np.sqrt(shares)
    return np.unique((np.cumsum(roots) - roots).astype(np.int64), return_counts=True)[1]


def bucket_of(hashes: np.ndarray, hashed: int) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % hashed


def learn_vocabulary(docs: DataFrame, least: int = LEAST, at_least: int = FREQUENT) -> tuple[Vocabulary, DataFrame]:
    """Counts the words of all texts; also returns the stored counts (hash, n)."""

    def count(batch: pa.RecordBatch) -> dict:
        found = [token_hashes(raw) for raw in raw_texts(batch.column(0))]
        hashes, counts = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
        return {"hash": pa.array(hashes.view(np.int64)), "n": pa.array(counts, pa.int64())}

    counts = map_batches(docs.select("text"), count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = store(counts, "words")
    top = counts.filter(F.col("n") >= least).toArrow()
    if top.num_rows < at_least:
        top = counts.orderBy(F.desc("n"), "hash").limit(at_least).toArrow()
    frequent, n = top["hash"].to_numpy(), top["n"].to_numpy()
    order = np.lexsort((frequent, -n))
    frequent, n = frequent[order].view(np.uint64), n[order]
    hashed = -(-max(len(frequent), at_least) // WORDS_A_BUCKET)
    sums = counts.groupBy((F.shiftrightunsigned("hash", 40) % hashed).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(hashed)
    totals[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    totals -= np.bincount(bucket_of(frequent, hashed), n, hashed)
    return Vocabulary(frequent, n, totals), counts


def _log_chances(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each row of ``x`` at one column; ``x`` is overwritten."""
    rows = np.arange(len(x))
    x -= x.max(axis=1, keepdims=True)
    chosen = x[rows, at]
    return chosen - np.log(np.exp(x, out=x).sum(axis=1))


class WindowNetwork:
    """Parameters in one flat float32 array, so that they can be sent and averaged in blocks.

    ``sizes``: tokens in each class, by default ``classes`` of ``per_class``.  A row of ``class_w`` or ``token_w`` ends with
    its bias, and ``hidden`` with a one.
    """

    def __init__(self, flat: np.ndarray | None = None, classes: int = 32, per_class: int = 32, width: int = WIDTH, reach: int = REACH,
                 sizes: np.ndarray | None = None):
        self.sizes = np.full(classes, per_class) if sizes is None else sizes
        self.classes, self.tokens, self.width, self.reach = len(self.sizes), int(self.sizes.sum()), width, reach
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        # Small whole numbers are sorted in linear time.
        self.kind = np.repeat(np.arange(self.classes, dtype=np.min_scalar_type(self.classes)), self.sizes)
        shapes = {
            "near": (2 * reach, self.tokens + 1, width), "bias": (width,), "class_w": (self.classes, width + 1),
            "token_w": (self.tokens, width + 1),
        }
        size = sum(int(np.prod(s)) for s in shapes.values())
        if flat is None:
            rng, flat = np.random.default_rng(SEED), np.empty(size, np.float32)
            for part in np.split(flat, range(BLOCK, size, BLOCK)):
                part[:] = rng.normal(0, 0.1, len(part))
        self.flat, at = flat, 0
        for name, shape in shapes.items():
            setattr(self, name, flat[at: at + int(np.prod(shape))].reshape(shape))
            at += int(np.prod(shape))
        self.near_rows = self.near.reshape(-1, width)

    def start_from(self, shares: np.ndarray) -> None:
        """Output biases that give each token its share."""
        self.class_w[:, -1] = np.log(np.add.reduceat(shares, self.first[:-1]))
        self.token_w[:, -1] = np.log(shares)

    def contexts(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens around each place of concatenated documents; beyond a document's ends an empty token."""
        gaps = self.reach * np.arange(1, len(starts))
        at = np.arange(len(tokens)) + np.repeat(gaps, np.diff(starts))
        padded = np.full(len(tokens) + self.reach * len(starts), self.tokens)
        padded[at] = tokens
        return np.stack([padded[at + k] for k in (*range(-self.reach, 0), *range(1, self.reach + 1))], axis=1)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.near[0].take(context[:, 0], axis=0)
        for place in range(1, context.shape[1]):
            total += self.near[place].take(context[:, place], axis=0)
        total += self.bias
        h = np.ones((len(context), self.width + 1), total.dtype)
        np.tanh(total, out=h[:, :-1])
        return h

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """An order of the targets by class; their classes and places in these, so ordered; where each class starts, and the end."""
        kind = self.kind[target]
        order = np.argsort(kind, kind="stable")
        kind = kind[order]
        return order, kind, target[order] - self.first[kind], np.searchsorted(kind, np.arange(self.classes + 1)).tolist()

    def in_bunches(self, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """All places in random order, but up to ``BUNCH`` of a class together, so that a step needs few classes.

        Bunches are smaller if there are few classes: a step has many windows of each anyway.
        """
        at = rng.permutation(len(tokens))
        kind = self.kind[tokens[at]]
        order = np.argsort(kind, kind="stable")
        at, kind = at[order], kind[order]
        within = np.arange(len(at)) - np.searchsorted(kind, np.arange(self.classes))[kind]
        bunch = np.cumsum(within % max(min(BUNCH, self.classes // 2), 1) == 0) - 1
        turn = rng.permutation(bunch[-1] + 1 if len(bunch) else 0)
        return at[np.argsort(turn[bunch], kind="stable")]

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target in its context."""
        order, kind, inner, ends = self.by_class(target)
        h = self.hidden(context[order])
        parts = [slice(k, k + ROWS_AT_ONCE) for k in range(0, len(h), ROWS_AT_ONCE)]
        logs = np.concatenate([_log_chances(h[p] @ self.class_w.T, kind[p]) for p in parts] or [h[:, 0]])
        for c, (a, b) in enumerate(zip(ends, ends[1:])):
            if a < b:
                logs[a:b] += _log_chances(h[a:b] @ self.token_w[self.first[c]: self.first[c + 1]].T, inner[a:b])
        out = np.empty_like(logs)
        out[order] = logs
        return out


class Trainer:
    def __init__(self, net: WindowNetwork, rate: float = RATE):
        self.net, self.rate = net, rate
        self.squares = WindowNetwork(np.full_like(net.flat, START_SQUARES), width=net.width, reach=net.reach, sizes=net.sizes)
        self.rows = [slice(a, b) for a, b in zip(net.first.tolist(), net.first[1:].tolist())]

    def _step(self, name: str, where, gradient: np.ndarray) -> None:
        squares, values = getattr(self.squares, name), getattr(self.net, name)
        step = gradient * gradient
        now = squares[where] if isinstance(where, slice) else squares.take(where, axis=0)
        now += step
        if not isinstance(where, slice):
            squares[where] = now
        np.sqrt(now, out=step)
        np.divide(gradient, step, out=step)
        step *= self.rate
        values[where] -= step

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        net, n = self.net, len(target)
        order, kind, inner, ends = net.by_class(target)
        context = context[order]
        h = net.hidden(context)
        # The error of a row is its exponentials, less their sum at the target, times ``scale``.
        error = h @ net.class_w.T
        error -= error.max(axis=1, keepdims=True)
        total = np.exp(error, out=error).sum(axis=1)
        error[np.arange(n), kind] -= total
        scale = (1 / (total * n))[:, None]
        back = error @ net.class_w
        back *= scale
        class_gradient = error.T @ (h * scale)
        back += self._learn_tokens(h, kind, inner, ends)
        self._step("class_w", slice(None), class_gradient)
        h = h[:, :-1]
        back = back[:, :-1] * (1 - h * h)
        self._step("bias", slice(None), back.sum(axis=0))
        self._step("near_rows", *_summed((context + np.arange(context.shape[1]) * (net.tokens + 1)).T.ravel(), back))

    def _learn_tokens(self, h: np.ndarray, kind: np.ndarray, inner: np.ndarray, ends: list[int]) -> np.ndarray:
        """Trains the second layer; returns what it sends back to ``h``.  Rows of all classes are laid end to end in one array."""
        net, n = self.net, len(h)
        sizes = net.sizes[kind]
        start = np.concatenate([[0], np.cumsum(sizes)])
        at, start, error = start.tolist(), start[:-1], np.empty(start[-1], h.dtype)
        found = [c for c in range(net.classes) if ends[c] < ends[c + 1]]
        parts = {c: error[at[ends[c]]: at[ends[c + 1]]].reshape(ends[c + 1] - ends[c], -1) for c in found}
        for c, part in parts.items():
            np.matmul(h[ends[c]: ends[c + 1]], net.token_w[self.rows[c]].T, out=part)
        error -= np.repeat(np.maximum.reduceat(error, start), sizes)
        np.exp(error, out=error)
        total = np.add.reduceat(error, start)
        error[start + inner] -= total
        scale = (1 / (total * n))[:, None]
        scaled, back = h * scale, np.empty_like(h)
        for c, part in parts.items():
            np.matmul(part, net.token_w[self.rows[c]], out=back[ends[c]: ends[c + 1]])
            self._step("token_w", self.rows[c], part.T @ scaled[ends[c]: ends[c + 1]])
        back *= scale
        return back


def _summed(rows: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows`` and the sum of ``back`` for each; ``back`` goes to ``rows`` in turn, again and again."""
    order = np.argsort(rows)
    rows, order = rows[order], order % len(back)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    times = np.diff(np.append(first, len(rows)))
    sums = back.take(order[first], axis=0)
    many = np.flatnonzero(times > 1)  # most stand once and need no sum
    if len(many):
        times = times[many]
        ends = np.cumsum(times)
        at = np.repeat(first[many] - ends + times, times) + np.arange(ends[-1])
        sums[many] = np.add.reduceat(back.take(order[at], axis=0), ends - times, axis=0)
    return rows[first], sums


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and where each starts (and the last ends)."""
    hashes = [token_hashes(raw) for raw in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(h) for h in hashes], out=starts[1:])
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), starts


def train_network(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> WindowNetwork:
    flat = None
    for turn in range(rounds):
        flat = _train_round(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == turn), vocabulary, flat)
    return vocabulary.start() if flat is None else vocabulary.network(flat)


def _train_round(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray | None) -> np.ndarray | None:
    """Parameters after a round from ``flat``, or from the start; without documents these again."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((vocabulary, flat))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = sent.value
        net = words.start() if start is None else words.network(start.copy())
        trainer, windows = Trainer(net), 0
        for batch in batches:
            for some in range(0, batch.num_rows, 256):
                hashes, starts = _joined(raw_texts(batch.column(0).slice(some, 256)))
                tokens = words.tokens(hashes)
                at = net.in_bunches(tokens, np.random.default_rng(SEED + len(tokens)))
                near = net.contexts(tokens, starts)
                for k in range(0, len(at), WINDOWS_AT_ONCE):
                    places = at[k: k + WINDOWS_AT_ONCE]
                    trainer.learn(near[places], tokens[places])
                windows += len(at)
            batch = None  # not held while the next one is read
            pa.default_memory_pool().release_unused()
        trainer, task = None, TaskContext.get().partitionId()
        if windows:
            parts = np.split(net.flat, range(BLOCK, len(net.flat), BLOCK))
            for k in range(0, len(parts), BLOCKS_AT_ONCE):
                some = parts[k: k + BLOCKS_AT_ONCE]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(k, k + len(some)), pa.int32()), pa.array([task] * len(some), pa.int32()),
                    pa.array([float(windows)] * len(some)), pa.array(some, pa.list_(pa.float32())),
                ], ["block", "task", "weight", "values"])

    shape = "block int, task int, weight double, values array<float>"

    def mean(group):
        group = group.sort_by("task")
        weight = group["weight"].to_numpy()
        values = np.stack([np.asarray(v.values.to_numpy(), np.float64) for v in group["values"]])
        average = (weight @ values / weight.sum()).astype(np.float32)
        return pa.table({
            "block": group["block"][:1], "task": group["task"][:1], "weight": pa.array([weight.sum()]),
            "values": pa.array([average], pa.list_(pa.float32())),
        })

    # Dealt anew, as a round lasts as long as the task with the most text.
    local = docs.select("text").repartition(spark.sparkContext.defaultParallelism).mapInArrow(train, shape)
    few = local.groupBy("block", F.floor(F.col("task") / TREE)).applyInArrow(lambda key, group: mean(group), shape)
    final = few.groupBy("block").applyInArrow(lambda key, group: mean(group), shape).select("block", "values").toArrow()
    if not final.num_rows:
        return flat
    flat = np.empty(sum(len(v.values) for v in final["values"]), np.float32)
    for block, values in zip(final["block"].to_pylist(), final["values"]):
        flat[block * BLOCK: (block + 1) * BLOCK] = values.values.to_numpy()
    return flat


def score(docs: DataFrame, vocabulary: Vocabulary, counts: DataFrame, net: WindowNetwork) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, net.flat))

    def run(batch: pa.RecordBatch) -> dict:
        words, flat = sent.value
        model = words.network(flat)
        sizes, sums, rare = [], [], []
        for some in range(0, batch.num_rows, 128):
            hashes, starts = _joined(raw_texts(batch.column(2).slice(some, 128)))
            tokens = words.tokens(hashes)
            near, logs = model.contexts(tokens, starts), np.zeros(len(tokens))
            for k in range(0, len(tokens), TOKENS_AT_ONCE):
                at = slice(k, k + TOKENS_AT_ONCE)
                logs[at] = model.log_probabilities(near[at], tokens[at])
            other = tokens >= words.frequent
            logs[other] -= words.log_totals[tokens[other] - words.frequent]
            total = np.concatenate([[0.0], np.cumsum(logs)])
            sizes += np.diff(starts).tolist()
            sums += (total[starts[1:]] - total[starts[:-1]]).tolist()
            rare += [hashes[a:b][other[a:b]].view(np.int64) for a, b in zip(starts[:-1], starts[1:])]
        return {
            "doc_id": batch.column(0), "row": batch.column(1), "n_tokens": sizes, "log_likelihood": sums,
            "rare": array_of_lists(rare, pa.int64()),
        }

    kept = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    rows = store(map_batches(kept, run, f"doc_id {kind}, row bigint, n_tokens bigint, log_likelihood double, rare array<bigint>"), "scored")
    # A word's share of its bucket: the total is taken off above, the count is joined here.
    own = F.log(F.coalesce("n", F.lit(UNSEEN)))
    more = rows.select("row", F.explode("rare").alias("hash")).join(counts, "hash", "left").groupBy("row").agg(F.sum(own).alias("more"))
    both = F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))
    return rows.join(more, "row", "left").select("doc_id", "n_tokens", both.alias("log_likelihood"))


def pseudo_likelihood(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Trains on ``docs`` and scores them."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    vocabulary, counts = learn_vocabulary(docs)
    return score(docs, vocabulary, counts, train_network(docs, vocabulary))
