"""Exact Jaccard self-join of documents on sets of word n-grams, with set-relation skipping.

1. Documents with equal sets form a class; one of them (the smallest id) stands for it from here on.
2. Every set is ordered with frequent shingles last.  A batch of sets reports the shingles that several of them share; the
   most frequent ones (``FREQUENT`` at most, by a count threshold) are sent to the tasks.  The order changes the work,
   never the result.
3. The inverted index holds the prefix of each set that any partner must share, with set size and position.  Lists are
   cut into blocks by size; a block that a set's size or position rules out is skipped.
4. Links from a similar set's links: in each block of a list all sets are compared with one leader only, and the links
   found there join sets to components.  Two sets of one component need no comparison.
5. What is left are pairs of a list in different components, which size and position allow; these are compared.

Each comparison counts the common shingles of the two whole sets; filters of a fixed size keep shingles of one set, and
documents without a comparison, from being shuffled.  No pair of a list is made twice or within a
component, copies are never paired, and no list is gathered in a task: blocks are grouped and joined by Spark.

Null and empty texts, and texts without a word, have an empty set and link with nothing.  A null id takes no part and
gets a null component.  Rows that share an id count as one document: it has the links of each of its texts, and every row is returned.  An empty table
gives no rows; columns that are not asked for are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from themeloom.llm.batches import WORDS, array_of_lists, leave_only, map_batches, raw_texts, shingles
from themeloom.operators.components import connected_components
from themeloom.session import store

#: Most shingles whose frequency is sent to the tasks (12 bytes each).
FREQUENT = 200_000
LEAST_SEEN = 4
TOGETHER = 4_000  # sets whose shingles a task counts at a time
AT_ONCE = 1_000  # sets a task writes at a time
#: Words of 64 bits of a filter that is sent to the tasks (8 MB, whatever it holds; a fuller one lets more rows pass).
FILTER_WORDS = 1 << 20
_SIZE_BITS = 31  # size and position share a long


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest) of each row, and (hash, seen) of shingles that several sets of a batch hold."""

    def run(batch: pa.RecordBatch) -> dict:
        leave_only(WORDS)
        sizes, digests, often = [], [], []
        texts = raw_texts(batch.column(1))
        for some in range(0, len(texts), TOGETHER):
            distinct = {}
            for raw in texts[some: some + TOGETHER]:
                found = shingles(raw, words)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                if len(found):
                    distinct.setdefault(digests[-1], found)
            if len(distinct) > 1:
                every = np.concatenate(list(distinct.values()))
                every.sort()
                first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                count = np.diff(np.append(first, len(every)))
                often.append((every[first[count > 1]], count[count > 1]))
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in often)])
        seen = np.concatenate([np.zeros(0, np.int64), *(c for _, c in often)])
        none, rows = len(hashes), len(sizes)
        return {
            "doc_id": pa.concat_arrays([batch.column(0), pa.nulls(none, pa.int64())]),
            "n_shingles": pa.concat_arrays([pa.array(sizes, pa.int64()), pa.nulls(none, pa.int64())]),
            "digest": pa.concat_arrays([pa.array(digests, pa.binary()), pa.nulls(none, pa.binary())]),
            "hash": pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(hashes.view(np.int64))]),
            "seen": pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(seen, pa.int64())]),
        }

    return map_batches(docs, run, "doc_id bigint, n_shingles bigint, digest binary, hash bigint, seen bigint")


def frequent(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent shingles, no more than ``most``."""
    sums = counts.groupBy("hash").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= LEAST_SEEN)
    sums = store(sums, "frequent")
    steps = sums.groupBy(F.floor(F.log2("seen") * 4).alias("step")).agg(F.count("*").alias("rows"), F.min("seen").alias("least")).collect()
    least, total = None, 0
    for row in sorted(steps, key=lambda r: -r["step"]):  # one row for each quarter of a power of two
        total += row["rows"]
        if total > most:
            break
        least = row["least"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = sums.filter(F.col("seen") >= least).toArrow()
    hashes = found["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["seen"].to_numpy()[order]


def prefixes(docs: DataFrame, words: int, least: Fraction, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, n, prefix): the shingles of each set of which every partner holds one, rare ones first."""
    sent = docs.sparkSession.sparkContext.broadcast(common)  # FREQUENT entries at most
    up, down = least.numerator, least.denominator

    def run(batch: pa.RecordBatch) -> dict:
        hashes, seen = sent.value
        sizes, parts = [], []
        for raw in raw_texts(batch.column(1)):
            found = shingles(raw, words)
            size = len(found)
            keep = size + (-up * size) // down + 1 if size else 0
            if size and len(hashes):
                at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                often = np.where(hashes[at] == found, seen[at], 0)
                found = found[np.argsort(often, kind="stable")]
            sizes.append(size)
            parts.append(found[:keep].view(np.int64))
        return {"doc_id": batch.column(0), "n": sizes, "prefix": array_of_lists(parts, pa.int64())}

    return map_batches(docs, run, "doc_id bigint, n bigint, prefix array<bigint>", AT_ONCE)


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of the 64-bit hashes in ``column``: a hash that is not there is ruled out, unless its bit is shared."""
    h = F.col(column)
    word, bit = h.bitwiseAND(FILTER_WORDS - 1), F.shiftrightunsigned(h, 58).cast("int")
    places = keys.select(word.cast("int").alias("word"), bit.alias("bit"))
    found = places.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()  # FILTER_WORDS rows at most
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _may_be_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (bits[hashes & np.uint64(FILTER_WORDS - 1)] >> (hashes >> np.uint64(58))) & np.uint64(1) == 1


def shared_postings(prefix: DataFrame) -> DataFrame:
    """(hash, id, spot) of the lists with more than one entry; a filter keeps most others from being shuffled."""
    hashes = prefix.select(F.explode("prefix").alias("hash")).groupBy("hash").agg(F.count("*").alias("length"))
    shared = store(hashes.filter("length > 1").select("hash"), "shared")
    sent = prefix.sparkSession.sparkContext.broadcast(key_filter(shared, "hash"))

    def run(batch: pa.RecordBatch) -> dict:
        lists = batch.column(2)
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        at = np.flatnonzero(_may_be_in(sent.value, flat.view(np.uint64)))
        row = row[at]
        spot = (batch.column(1).to_numpy()[row] << _SIZE_BITS) | (at - ends[row])
        return {"hash": pa.array(flat[at]), "id": pa.array(batch.column(0).to_numpy()[row]), "spot": pa.array(spot)}

    return map_batches(prefix, run, "hash bigint, id bigint, spot bigint").join(shared, "hash")


def whole_sets(docs: DataFrame, words: int, ids: DataFrame) -> DataFrame:
    """(doc_id, members) of the documents in ``ids``, and of a few that its filter lets pass."""
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(ids.select(F.xxhash64("doc_id").alias("key")), "key"))

    def run(batch: pa.RecordBatch) -> dict:
        wanted = pa.array(_may_be_in(sent.value, batch.column(2).to_numpy().view(np.uint64)))
        batch = batch.filter(wanted)
        parts = [shingles(raw, words).view(np.int64) for raw in raw_texts(batch.column(1))]
        return {"doc_id": batch.column(0), "members": array_of_lists(parts, pa.int64())}

    keyed = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
    return map_batches(keyed, run, "doc_id bigint, members array<bigint>", AT_ONCE)


def _possible(least: Fraction, a: str, b: str):
    """Whether size and position of a shared shingle allow a link between ``a`` and ``b``."""
    up, down = least.numerator, least.denominator
    n = lambda x: F.shiftright(f"{x}.spot", _SIZE_BITS)
    left = lambda x: n(x) - F.col(f"{x}.spot").bitwiseAND((1 << _SIZE_BITS) - 1)
    return (
        (down * F.least(n(a), n(b)) >= up * F.greatest(n(a), n(b)))
        & ((up + down) * F.least(left(a), left(b)) >= up * (n(a) + n(b)))
    )


def links(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The (a, b) whose whole sets are similar enough."""
    up, down = least.numerator, least.denominator
    # Sort-merge joins at every size: adaptive execution splits a leader with many partners there, and the sets are
    # shuffled once for both joins.
    both = pairs.join(sets.toDF("a", "sa").hint("merge"), "a").join(sets.toDF("b", "sb").hint("merge"), "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    joined = F.size("sa").cast("bigint") + F.size("sb") - shared
    return both.filter(down * shared >= up * joined).select("a", "b")


def _components(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    return connected_components(ends, edges)


def jaccard_components(docs: DataFrame, words: int, least: Fraction, doc_id: str = "doc_id", text: str = "text",
                       most_frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: documents link if the Jaccard similarity of their sets of
    ``words``-word shingles is ``least`` or more; the component's id is the smallest id reachable by links."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    scanned = store(sets_of(docs, words), "sets")
    rows = scanned.filter("hash IS NULL").select("doc_id", "n_shingles", "digest")
    common = frequent(scanned.filter("hash IS NOT NULL").select("hash", "seen"), most_frequent)

    # Rows that share an id are one document: its classes are joined by edges between their smallest ids.
    full = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = store(full.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    own = full.join(classes, "digest").filter("doc_id <> id").select("doc_id", "id", "digest")
    again = own.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("a", "b")

    band = F.floor(F.log("n") / float(np.log(least.denominator / least.numerator)))
    prefix = prefixes(docs, words, least, common).join(
        classes.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"
    )
    lists = store(shared_postings(store(prefix, "prefixes")), "lists")
    blocks = lists.withColumn("n", F.shiftright("spot", _SIZE_BITS)).withColumn("band", band).select("hash", "band", "id", "spot")

    leaders = blocks.groupBy("hash", "band").agg(F.min(F.struct("id", "spot")).alias("first"), F.count("*").alias("length"))
    leaders = leaders.filter("length > 1").select("hash", "band", "first.*")
    near = blocks.alias("x").join(leaders.alias("l"), ["hash", "band"]).filter("x.id <> l.id").filter(_possible(least, "x", "l"))
    stars = store(near.select(F.col("l.id").alias("a"), F.col("x.id").alias("b")).distinct(), "stars")

    sets = lambda pairs: whole_sets(docs, words, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    if not full.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        plain, sets = sets, lambda pairs: plain(pairs).distinct()  # rows that repeat: one set of each is enough
    found = store(links(stars, sets(stars), least).union(again), "links")
    first = _components(found)

    placed = store(
        lists.join(first, "id", "left").select("hash", "id", "spot", F.coalesce("component", "id").alias("component")), "placed"
    )
    mixed = placed.groupBy("hash").agg(F.min("component").alias("main"), F.max("component").alias("other"))
    mixed = placed.join(mixed.filter("main < other").select("hash", "main"), "hash")
    mixed = store(mixed, "mixed")
    one, two = mixed.filter("component <> main").alias("x"), mixed.alias("y")
    rest = one.join(two, "hash").filter(
        "x.component <> y.component AND (y.component = y.main OR x.id < y.id)"
    ).filter(_possible(least, "x", "y"))
    rest = rest.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    rest = store(rest.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "rest")
    later = store(links(rest, sets(rest), least), "links")
    last = _components(found.union(later))

    placed = classes.join(last, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    return rows.join(placed, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
