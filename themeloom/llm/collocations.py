"""Phrases whose words belong together, counted with weighted acyclic automata.

1. A task reads its texts in shards of ``SHARD_BYTES``.  The sorted distinct n-grams of a shard are built into count
   transducers: an arc carries a word and the occurrences of the n-gram that ends with it, and states with equal arcs are
   one.  Every n-gram belongs to a prefix range, a range of the hashes of its first words, so an n-gram has one range in
   every shard and a frequent first word is spread over many; there is one transducer for a shard, language and range.
2. Transducers of one range are united and their weights summed; n-grams below ``least`` are left out.
3. This is done for single words, then word pairs, then longer n-grams.  A phrase is no more frequent than its parts, so
   each pass skips n-grams with an infrequent part.  What a task knows of the passes before is a filter of fixed size
   (8 MB) that lets every frequent part through; a fuller one lets more through and changes no count.
4. The counts of a candidate's parts are looked up by composing the acceptor of the asked parts with the transducer of
   all frequent phrases, by ranges of the asked part.  Single words are asked for by many candidates, so these few
   phrases stand in ``SALT`` ranges each.

The score of a candidate and its smallest cut, and the longer phrases that hold it, are worked out on frequent phrases only,
with decimals where products may pass 64 bits.

Null languages count as ``und``.  Null and empty texts have no words.  Rows that repeat count each.  A language without a
candidate gives no rows, nor does an empty table.  Other columns than the two named are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from themeloom.llm.batches import mixed, raw_texts
from themeloom.session import store

LEAST = 30
LONGEST = 4
TOP = 2_000
#: A phrase goes if a longer one that holds it has this share (in hundredths) of its occurrences.
HELD = 80
#: Bytes of text a task counts together.
SHARD_BYTES = 9_000_000
#: Words of the corpus for each prefix range.
RANGE_WORDS = 4_000_000
#: Asked parts for each range of the lookup.
RANGE_PARTS = 500_000
SALT = 16
FILTER_BITS = 26
_BREAK = b"."
#: A-Z to a-z, the marks that end a piece to one of them, tab to space.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"......... ")


class Transducer:
    """Word sequences with counts.  Level d has the arcs of the states at depth d, state by state in order:
    ``first[d]`` (a state's first arc), ``label[d]``, ``weight[d]`` (0: only a prefix) and ``target[d]``."""

    def __init__(self, first: list, label: list, weight: list, target: list):
        self.first, self.label, self.weight, self.target = first, label, weight, target

    @classmethod
    def build(cls, rows: np.ndarray, weights: np.ndarray) -> Transducer:
        """From distinct sorted ``rows`` of labels, padded with -1 at the end."""
        depth = rows.shape[1]
        labels, counts, parents = [], [], []
        differs = np.zeros(len(rows), bool)
        differs[:1] = True
        owner = np.zeros(len(rows), np.int64)  # the state each row stands in
        for d in range(depth):
            differs[1:] |= rows[1:, d] != rows[:-1, d]
            changed = differs & (rows[:, d] >= 0)
            at = np.flatnonzero(changed)
            ends_here = np.ones(len(at), bool) if d + 1 == depth else rows[at, d + 1] < 0
            labels.append(rows[at, d].astype(np.int64))
            counts.append(np.where(ends_here, weights[at], 0))
            parents.append(owner[at])
            owner = np.cumsum(changed) - 1
        first, label, weight, target = [None] * depth, labels, counts, [None] * depth
        below = np.zeros(len(labels[-1]), np.int64)  # states after the last level: one without arcs
        for d in range(depth - 1, -1, -1):
            states = len(labels[d - 1]) if d else 1
            target[d] = below
            sizes = np.bincount(parents[d], minlength=states)
            begin = np.cumsum(sizes) - sizes
            below, kept = _equal_states(begin, sizes, label[d], weight[d], target[d])
            arcs = _ranges(begin[kept], sizes[kept])[1]
            label[d], weight[d], target[d] = label[d][arcs], weight[d][arcs], target[d][arcs]
            first[d] = np.append(0, np.cumsum(sizes[kept]))
        return cls(first, label, weight, target)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """All sequences with their weights, padded with -1."""
        out, weights = [], []
        state, path = np.zeros(1, np.int64), np.zeros((1, 0), np.int64)
        for d, first in enumerate(self.first):
            owner, arc = _ranges(first[state], first[state + 1] - first[state])
            path = np.column_stack([path[owner], self.label[d][arc]])
            ends = self.weight[d][arc] > 0
            out.append(np.pad(path[ends], ((0, 0), (0, len(self.first) - d - 1)), constant_values=-1))
            weights.append(self.weight[d][arc][ends])
            state = self.target[d][arc]
        return np.concatenate(out), np.concatenate(weights)

    def compose(self, rows: np.ndarray) -> np.ndarray:
        """Weights of the sequences ``rows`` accepts; 0 for others."""
        state, found = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        for d, first in enumerate(self.first):
            live = live[rows[live, d] >= 0]
            source = np.repeat(np.arange(len(first) - 1), np.diff(first))
            known = source << 32 | self.label[d]
            asked = state[live] << 32 | rows[live, d]
            arc = np.searchsorted(known, asked)
            hit = arc < len(known)
            hit[hit] = known[arc[hit]] == asked[hit]
            found[live] = 0
            live, arc = live[hit], arc[hit]
            found[live] = self.weight[d][arc]
            state[live] = self.target[d][arc]
        return found

    def to_bytes(self) -> bytes:
        out = [len(self.first).to_bytes(1, "little")]
        for level in zip(self.first, self.label, self.weight, self.target):
            for values in level:
                top = int(values.max()) if len(values) else 0
                width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
                out.append(bytes([width]) + len(values).to_bytes(4, "little") + values.astype(f"<u{width}").tobytes())
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Transducer:
        at, levels = 1, []
        for _ in range(raw[0] * 4):
            width, count = raw[at], int.from_bytes(raw[at + 1: at + 5], "little")
            levels.append(np.frombuffer(raw, f"<u{width}", count, at + 5).astype(np.int64))
            at += 5 + width * count
        return cls(levels[0::4], levels[1::4], levels[2::4], levels[3::4])


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the ranges ``start`` .. ``start + count``."""
    owner = np.repeat(np.arange(len(start)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def _equal_states(begin, sizes, label, weight, target) -> tuple[np.ndarray, np.ndarray]:
    """New number of each state, and the states kept: those with equal arcs are one.

    States are brought together by a hash of their arcs; one whose arcs differ from the first of its hash stays apart.
    """
    states = len(begin)
    mixture = mixed(label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mixed(weight.astype(np.uint64) << np.uint64(32) ^ target.astype(np.uint64)))
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(mixture, dtype=np.uint64))
    code = mixed(sums[begin + sizes] - sums[begin] + sizes.astype(np.uint64))
    _, head, group = np.unique(code, return_index=True, return_inverse=True)
    leader = head[group]
    same = sizes == sizes[leader]
    owner, arc = _ranges(begin[same], sizes[same])
    other = arc - begin[same][owner] + begin[leader[same]][owner]
    off = (label[arc] != label[other]) | (weight[arc] != weight[other]) | (target[arc] != target[other])
    same[np.flatnonzero(same)[owner[off]]] = False
    leader = np.where(same, leader, np.arange(states))
    kept = np.flatnonzero(leader == np.arange(states))
    number = np.zeros(states, np.int64)
    number[kept] = np.arange(len(kept))
    return number[leader], kept


def row_order(rows: np.ndarray) -> np.ndarray:
    """What sorts rows of labels from -1 on; where a row fits 62 bits it is sorted as one number."""
    base = int(rows.max()) + 2
    if base ** rows.shape[1] >= 1 << 62:
        return np.lexsort(rows.T[::-1])
    key = np.zeros(len(rows), np.int64)
    for d in range(rows.shape[1]):
        key = key * base + (rows[:, d] + 1)
    return np.argsort(key)


def total(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows with summed weights."""
    if not len(rows):
        return rows, weights
    order = row_order(rows)
    rows, weights = rows[order], weights[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    heads = np.flatnonzero(new)
    return rows[heads], np.add.reduceat(weights, heads)


def pack(words: list[bytes], rows: np.ndarray, weights: np.ndarray) -> bytes:
    """A transducer and the words of its labels; ``rows`` are numbers of sorted ``words``."""
    used = np.unique(rows[rows >= 0])
    labels = np.where(rows >= 0, np.searchsorted(used, rows), -1)
    shown = b" ".join([words[i] for i in used.tolist()])
    return len(shown).to_bytes(4, "little") + shown + Transducer.build(labels, weights).to_bytes()


def unpack(raw: bytes) -> tuple[list[bytes], Transducer]:
    size = 4 + int.from_bytes(raw[:4], "little")
    return raw[4:size].split(b" ") if size > 4 else [], Transducer.from_bytes(raw[size:])


def united(packed: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, rows and summed weights of transducers in the form of ``pack``."""
    parts = [unpack(raw) for raw in packed]
    words = sorted(set().union(*[w for w, _ in parts]))
    number = {w: i for i, w in enumerate(words)}
    rows, weights = [], []
    for own, transducer in parts:
        found, counts = transducer.rows()
        label = np.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)), -1)
        rows.append(label[found])
        weights.append(counts)
    return words, *total(np.concatenate(rows), np.concatenate(weights))


class Shard:
    """Word numbers of the texts of one language; number 0 is the end of a piece."""

    def __init__(self):
        self.number = defaultdict(int)
        self.number[_BREAK] = 0
        self.number.default_factory = self.number.__len__
        self.ids: list[np.ndarray] = []

    def add(self, texts: list[bytes]) -> None:
        folded = b" . ".join(texts).translate(_FOLD).replace(b".", b" . ")
        tokens = folded.split()
        tokens.append(_BREAK)
        self.ids.append(np.fromiter(map(self.number.__getitem__, tokens), np.int32, len(tokens)))


def word_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 42)


def _turned(h: np.ndarray) -> np.ndarray:
    return h << np.uint64(1) | h >> np.uint64(63)


def _passes(bits: np.ndarray | None, code: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(code), bool)
    place = code & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def shard_grams(shard: Shard, lang: str, low: int, high: int, words_seen, pairs_seen) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(words, rows, counts, prefix hashes) of the n-grams of ``low`` to ``high`` words whose parts may be frequent."""
    seed, known = word_seed(lang), list(shard.number)[1:]
    codes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in known), np.uint64, len(known))
    good = np.flatnonzero(_passes(words_seen, codes)).tolist()
    good.sort(key=known.__getitem__)
    words, codes = [known[i] for i in good], codes[good]
    place = np.full(len(known) + 1, -1, np.int32)
    place[np.array(good, np.int64) + 1] = np.arange(len(good))
    at = place[np.concatenate(shard.ids)]  # number in byte order, or -1, of each word
    paths, found, counts = np.arange(len(words))[:, None], [], []
    if low == 1:
        found.append(paths)
        counts.append(np.bincount(at[at >= 0], minlength=len(words)))
    for size in range(2, high + 1):
        both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
        keys = at[both].astype(np.int64) << 32 | at[both + 1]
        if size < high:
            keys, number, seen = np.unique(keys, return_inverse=True, return_counts=True)
        else:  # a plain sort is much faster
            keys, seen = np.unique(keys, return_counts=True)
        front, back = keys >> 32, keys & 0xFFFFFFFF
        paths = np.column_stack([paths[front], paths[back][:, -1]])
        if low <= size:
            found.append(paths)
            counts.append(seen)
        if size < high:
            at = np.full(max(len(at) - 1, 0), -1, np.int32)
            at[both] = number
            if size == 2:
                ok = _passes(pairs_seen, codes[paths[:, 0]] ^ _turned(codes[paths[:, 1]]))
                at[both[~ok[number]]] = -1
    rows = np.concatenate([np.pad(f, ((0, 0), (0, high - f.shape[1])), constant_values=-1) for f in found])
    weights = np.concatenate(counts).astype(np.int64)
    if len(found) > 1 and len(rows):
        order = row_order(rows)
        rows, weights = rows[order], weights[order]
    prefix = np.zeros(len(rows), np.uint64)
    for d in range(min(low, high)):
        prefix = mixed(_turned(prefix) ^ codes[rows[:, d]])
    return words, rows, weights, prefix


def count_grams(docs: DataFrame, low: int, high: int, ranges: int, least: int, words_seen=None, pairs_seen=None) -> DataFrame:
    """(lang, words, phrase, f): n-grams of ``low`` to ``high`` words with ``least`` occurrences; a row without a phrase
    has the sum over all counted n-grams of a language and range."""
    sent = docs.sparkSession.sparkContext.broadcast((words_seen, pairs_seen))

    def transducers(shards: dict[str, Shard]) -> Iterator[pa.RecordBatch]:
        while shards:
            lang, shard = shards.popitem()
            words, rows, weights, prefix = shard_grams(shard, lang, low, high, *sent.value)
            part = (prefix % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            numbers, starts = np.unique(part[order], return_index=True)
            out = [pack(words, rows[some], weights[some]) for some in np.split(order, starts[1:])] if len(order) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(out), pa.string()), pa.array(numbers, pa.int64()), pa.array(out, pa.binary())], ["lang", "part", "packed"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, held = defaultdict(Shard), 0
        for batch in batches:
            texts, size = defaultdict(list), 0
            for lang, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                texts[lang].append(raw)
                size += len(raw)
                if size >= 1_000_000:
                    for key, some in texts.items():
                        shards[key].add(some)
                    held, texts, size = held + size, defaultdict(list), 0
                if held >= SHARD_BYTES:
                    yield from transducers(shards)
                    shards, held = defaultdict(Shard), 0
                    pa.default_memory_pool().release_unused()
            for key, some in texts.items():
                shards[key].add(some)
            held += size
        yield from transducers(shards)

    def unite(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        words, rows, weights = united([raw.as_py() for raw in table.column("packed")])
        often = weights >= least
        shown = [b" ".join([words[i] for i in row if i >= 0]).decode() for row in rows[often].tolist()]
        sizes = (rows[often] >= 0).sum(axis=1)
        return pa.table({
            "lang": pa.array([lang] * (len(shown) + 1), pa.string()), "words": pa.array([*sizes.tolist(), 0], pa.int32()),
            "phrase": pa.array([*shown, None], pa.string()), "f": pa.array([*weights[often].tolist(), int(weights.sum())], pa.int64()),
        })

    read_docs = docs.select("lang", "text").mapInArrow(read, "lang string, part bigint, packed binary")
    return read_docs.groupBy("lang", "part").applyInArrow(unite, "lang string, words int, phrase string, f bigint")


def filter_of(codes: DataFrame) -> np.ndarray:
    """Bits of the low ``FILTER_BITS`` of the column ``code``; one row for 64 bits comes to the driver, at most 16 MB."""
    place = F.col("code").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = codes.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _word_code(word):
    return F.xxhash64("lang", word)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases with ``least`` occurrences, and (lang, n), the words of each language."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = 8 + size // (6 * RANGE_WORDS)
    single = store(count_grams(docs, 1, 1, ranges, least), "words")
    n = single.filter("phrase IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    found = [single]
    if longest > 1:
        words_seen = filter_of(single.filter("phrase IS NOT NULL").select(_word_code(F.col("phrase")).alias("code")))
        pairs = store(count_grams(docs, 2, 2, ranges, least, words_seen), "pairs")
        found.append(pairs)
    if longest > 2:
        first, second = (_word_code(F.split("phrase", " ")[i]) for i in (0, 1))
        turned = F.shiftleft(second, 1).bitwiseOR(F.shiftrightunsigned(second, 63))
        pairs_seen = filter_of(pairs.filter("phrase IS NOT NULL").select(first.bitwiseXOR(turned).alias("code")))
        found.append(store(count_grams(docs, 3, longest, ranges, least, words_seen, pairs_seen), "phrases"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.filter("phrase IS NOT NULL"), n


def part_counts(phrases: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (lang, part, phrase and more) with the count ``f`` of each part."""
    parts = -(-asked.count() // RANGE_PARTS) or 1
    single = lambda c: F.instr(c, " ") == 0
    salt = F.when(single(F.col("part")), F.pmod(F.xxhash64("phrase"), F.lit(SALT))).otherwise(0)
    copies = F.when(single(F.col("phrase")), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    range_of = lambda c: F.pmod(F.xxhash64("lang", c, F.col("salt").cast("int")), F.lit(parts)).alias("range")
    left = phrases.select("lang", "phrase", "f", F.explode(copies).alias("salt"))
    left = left.select(range_of("phrase"), "lang", "phrase", "f")
    names = asked.columns
    right = asked.withColumn("salt", salt).select(range_of("part"), *names)
    types = dict(asked.dtypes)

    def numbers(langs: pd.Series, texts: pd.Series, number: dict, width: int) -> np.ndarray:
        get = number.get
        paths = [[get(("", a)), *map(get, b.split(" "))] for a, b in zip(langs, texts)]
        rows = np.full((len(paths), width), -1, np.int64)
        for i, path in enumerate(paths):
            rows[i, :len(path)] = [-2 if p is None else p for p in path]
        rows[(rows == -2).any(axis=1)] = -1
        return rows

    def look_up(known: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if known.empty or wanted.empty:  # such a side has no columns
            return wanted.reindex(columns=names).assign(f=0)
        known = known.drop_duplicates(["lang", "phrase"])  # several salts may share a range
        number, width = {}, 1
        for a, b in zip(known["lang"], known["phrase"]):
            number.setdefault(("", a), len(number))
            path = b.split(" ")
            width = max(width, len(path) + 1)
            for w in path:
                number.setdefault(w, len(number))
        width = max(width, int(wanted["part"].str.count(" ").max()) + 2)
        rows, weights = total(numbers(known["lang"], known["phrase"], number, width), known["f"].to_numpy(np.int64))
        counts = Transducer.build(rows, weights).compose(numbers(wanted["lang"], wanted["part"], number, width))
        return wanted[names].assign(f=counts)

    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + ", f bigint"
    return left.groupBy("range").cogroup(right.groupBy("range")).applyInPandas(look_up, schema)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, held: int = HELD,
                 lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of 2 to ``longest`` words of each language.

    ``score`` is floor(2000000 a / (l + r)) of the cut of the phrase where it is smallest.
    """
    read = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    phrases, n = frequent_phrases(read, least, longest)
    candidates = phrases.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = F.array(
        F.struct(F.lit(True).alias("front"), joined(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("front"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")),
    )
    asked = cut.select("lang", "phrase", "a", "k", F.inline(sides))
    counted = part_counts(phrases, store(asked, "parts"))
    both = counted.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("front"), F.col("f"))).alias("l"), F.max(F.when(~F.col("front"), F.col("f"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = both.withColumns({"x": wide("a") * F.lit(2_000_000).cast("decimal(7,0)"), "y": wide("l") + wide("r")})
    scored = scored.withColumn("score", F.expr("x div y"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inner = candidates.filter("words > 2")
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    longer = inner.groupBy("lang", joined(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("whole"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(
        F.col("whole").isNull() | (F.col("whole") * 100 < F.col("a") * held))

    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
