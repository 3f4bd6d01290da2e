"""Runs from the grammar against a search of every period, and the digests of the registered query."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from themeloom.llm import periodic_runs, queries


def plain_runs(words, least_length=24, least_exponent=3):
    """All periods tried at every place."""
    best, n = {}, len(words)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_length, least_exponent * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in best.items())


def texts(rng):
    yield []
    yield ["a"] * 23
    yield ["a"] * 24
    yield ["a"] * 200
    yield list("ab" * 30) + ["c"] + list("ab" * 30)
    for _ in range(60):
        letters = [f"w{k}" for k in range(rng.choice([2, 3, 5, 40]))]
        out = []
        for _ in range(rng.randint(1, 8)):
            block = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            out += block * rng.randint(1, 9) + block[: rng.randint(0, len(block))]
            out += [rng.choice(letters) for _ in range(rng.randint(0, 20))]
        yield out
    for _ in range(20):
        yield [rng.choice("ab") for _ in range(rng.randint(30, 300))]
    fib = ["a"], ["b"]
    for _ in range(9):
        fib = fib[0] + fib[1], fib[0]
    yield list(fib[0])
    yield [w for k in range(6) for w in (["x", "y", "z"] * 8 + [f"u{k % 2}"])] * 4


@pytest.mark.parametrize("least_length, least_exponent", [(24, 3), (6, 3), (4, 2), (9, 4)])
def test_runs_against_every_period(least_length, least_exponent):
    rng = random.Random(least_length)
    for words in texts(rng):
        got = []
        for start, end in periodic_runs.stretches(words, least_length, least_exponent):
            got += [(s + start, n, q) for s, n, q in periodic_runs.runs_of([words[start:end]], least_length, least_exponent).tolist()]
        assert sorted(got) == plain_runs(words, least_length, least_exponent), words


def test_pieces_side_by_side_do_not_meet():
    pieces = [["a"] * 20, ["a"] * 30, ["b", "a"] * 15]
    assert periodic_runs.runs_of(pieces).tolist() == [[20, 30, 1], [50, 30, 2]]


@pytest.mark.parametrize("seed", range(20))
def test_grammar_gives_back_the_symbols(seed):
    rng = random.Random(seed)
    symbols = [rng.randrange(rng.choice([2, 3, 10])) for _ in range(rng.randint(2, 200))]
    nodes = periodic_runs.repair(symbols)
    assert nodes[-1][1:] == (len(symbols), [0])
    inside = 0
    for first, total, places in nodes:
        assert 0 < first < total
        assert len({tuple(symbols[p: p + total]) for p in places}) == 1
        assert all(b - a >= total for a, b in zip(places, places[1:]))
        inside += len(places)
    assert inside == len(symbols) - 1  # a binary tree over all symbols
    left = [n for n in nodes if len(n[2]) == 1]
    assert nodes[len(nodes) - len(left):] == left  # no nonterminal of the pairs is used once


def test_operator_on_odd_rows(spark):
    line = "wash rinse repeat " * 9
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, line + "end"), (4, line + "end"), (None, line), (5, "x " * 40_000), (6, "Ürümqi a " * 30)]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, n_words int, collapsed string")
    got = {}
    for r in periodic_runs.find_runs(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert got[4] == [(28, [(0, 27, 3)], "wash rinse repeat end")] * 2
    assert got[None] == [(27, [(0, 27, 3)], "wash rinse repeat")]
    assert got[5] == [(40_000, [(0, 40_000, 1)], "x")]
    assert got[6] == [(30, [(0, 30, 1)], "Ürümqi a")]
    assert periodic_runs.find_runs(df.limit(0)).count() == 0


def contract(doc, text):
    """The digest columns by their definition."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if best else None
    return len(runs), *(best or (None,) * 3), milli, digest, hashlib.sha256(b" ".join(kept)).hexdigest()


def test_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, "one"), (12, "abc " * 100)]
    for i in range(100, 500):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.choice([5, 40, 300]))]
        if rng.random() < 0.4:
            words += words[-rng.randint(1, 5):] * rng.randint(2, 20)
        rows.append((i, " \n".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for n, t in found.dtypes if not n.endswith("sha256")} == {"bigint"}
    got = {r.doc_id: tuple(r)[1:] for r in found.collect()}
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) and sum(r[0] for r in got.values()) > 50
    assert got == {i: contract(i, t) for i, t in rows}
