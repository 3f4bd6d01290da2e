"""Sum-of-squares packing against a plain version of its rule, and the pieces of whole documents."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from themeloom.llm import queries, square_packing

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "   \n ", "one", "two words", "Straße für İstanbul 中文 😀", "it's  a <|endoftext|> test", "word " * 700, "x" * 3000]


def plain_bins(lengths, size):
    """Gap counts as a plain list; every choice tried by its whole sum of squares."""
    bins, places = [], []
    for length in lengths:
        def total(target):
            gaps = [size - b for b in bins]
            if target is None:
                gaps.append(size - length)
            else:
                gaps[target] -= length
            counts = {g: gaps.count(g) for g in set(gaps) if g}
            return sum(c * c for c in counts.values())

        fits = [i for i, b in enumerate(bins) if size - b >= length and b < size]
        options = [(total(i), size - bins[i]) for i in fits] + [(total(None), size + 1)]
        least = min(options)
        places.append(least[1])
        if least[1] == size + 1:
            bins.append(length)
        else:
            bins[next(i for i in fits if size - bins[i] == least[1])] += length
    return places, len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_every_choice_has_the_least_sum_of_squares(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 16, 50])
    lengths = [rng.randint(1, size) for _ in range(60)]
    packer, got, fill = square_packing.SquarePacker(size), [], {}
    for length in lengths:
        number, offset = packer.place(length)
        got.append(size + 1 if not offset else size - offset)
        assert fill.get(number, 0) == offset
        fill[number] = offset + length
        assert fill[number] <= size
    want, bins = plain_bins(lengths, size)
    assert got == want and packer.bins == bins
    assert packer.unfilled() == {n for n, f in fill.items() if f < size}


def test_lengths_that_fit_exactly_leave_no_gap():
    bins, offsets, unfilled = square_packing.place_all(np.array([3, 5, 4, 4, 8, 1, 7]), 8)
    assert bins.max() + 1 == 4 and not unfilled.any()
    assert square_packing.place_all(np.array([], np.int64), 8)[0].size == 0


def check_pieces(pieces, docs, size, end):
    """Ids, cuts, places and the number of sequences; ``docs`` are (id, text) with unique ids."""
    model = Tokenizer.from_file(WORD_BPE)
    want = {i: [*model.encode(t or "", add_special_tokens=False).ids, end] for i, t in docs}
    of_doc, of_bin = {}, {}
    for p in pieces:
        of_doc.setdefault(p.doc_id, []).append(p)
        of_bin.setdefault(p.sequence_id, []).append(p)
    assert set(of_doc) == set(want)
    for i, parts in of_doc.items():
        parts.sort(key=lambda p: p.piece)
        assert [p.piece for p in parts] == list(range(-(-len(want[i]) // size)))
        assert [p.start for p in parts] == [size * p.piece for p in parts]
        assert b"".join(bytes(p.ids) for p in parts) == np.array(want[i], "<u4").tobytes()
        assert all(p.length == len(p.ids) // 4 <= size for p in parts)
    for parts in of_bin.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    return len(of_bin), -(-sum(map(len, want.values())) // size)


@pytest.mark.parametrize("size, block", [(64, 48_000_000), (64, 2_000), (4096, 48_000_000)])
def test_pieces_of_documents(spark, size, block):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice(["a", "of", "stone", "river", "Ürümqi"]) for _ in range(rng.randint(1, 150))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, open int").repartition(3)
    pieces = square_packing.pack(df, WORD_BPE, window=size, block_bytes=block).collect()
    used, least = check_pieces(pieces, list(enumerate(texts)), size, 1)
    assert used <= least * (1.02 if block > 10_000 else 1.3) + 2


def test_null_ids_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a row"), (7, "same"), (7, "same"), (None, None)], "doc_id long, text string")
    pieces = square_packing.pack(df, WORD_BPE).collect()
    assert sorted((p.doc_id or -1, p.length) for p in pieces) == [(-1, 1), (-1, 3), (7, 2), (7, 2)]
    assert sorted(p.offset + p.length for p in pieces)[-1] == 8 and len({p.sequence_id for p in pieces}) == 1
    assert square_packing.pack(df.limit(0), WORD_BPE).count() == 0


def test_query(spark, sf):
    pieces = queries.QUERIES["op13_square_packing"](spark, sf)
    assert pieces.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = pieces.collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    model = Tokenizer.from_file(WORD_BPE)
    want = {}
    for d in docs:
        ids = [*model.encode(d.text or "", add_special_tokens=False).ids, 1]
        for n, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start: start + 4096]
            want[d.doc_id, n] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    fills = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 4096 and len(fills) <= -(-sum(fills.values()) // 4096) + 2
