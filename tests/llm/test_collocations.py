"""Phrase counts, scores and ranks against a plain count, and the transducers against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from themeloom.llm import collocations as col, queries


def plain(rows, least, longest, top, held):
    """The contract over (lang, text) rows."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i: i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        gone = set()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * a >= held * counts[p[i: i + size]]:
                        gone.add(p[i: i + size])
        ranked = []
        for p, a in candidates.items():
            if p not in gone:
                cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def random_rows(seed, size=300):
    rng = random.Random(seed)
    words = ["The", "of", "new", "york", "city", "É", "é", "x1", "...", "a\x00b", "ÅB", "naïve", "İ", "　", "\x1f", " y"]
    phrases = ["New York city hall", "out of the blue", "straße nach Süden", "in\tthe end"]
    rows = []
    for _ in range(size):
        text = " ".join(rng.choice(phrases) if rng.random() < 0.2 else rng.choice(words) + rng.choice(["", "", "", ",", "!\n", ".", ":"])
                        for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "en", "und", None]), text))
    return rows + [("en", None), (None, ""), ("fr", " \n"), ("de", "eins zwei")]


@pytest.mark.parametrize("seed, least, longest, top, held, shard", [(1, 4, 4, 50, 80, 2_000), (2, 2, 5, 2_000, 50, 10**7), (3, 3, 2, 10, 80, 500), (4, 30, 3, 5, 100, 10**7)])
def test_collocations_against_a_plain_count(spark, monkeypatch, seed, least, longest, top, held, shard):
    monkeypatch.setattr(col, "RANGE_PARTS", 40)
    monkeypatch.setattr(col, "SHARD_BYTES", shard)
    rows = random_rows(seed)
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, text string, a int, phrase string").repartition(3)
    found = col.collocations(df, least, longest, top, held)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for n, t in found.dtypes if n not in ("lang", "phrase")} == {"bigint"}
    got = sorted(tuple(r) for r in found.collect())
    want = plain(rows, least, longest, top, held)
    assert got == want and (len(got) > 10 or least == 30)


def test_empty_and_rare(spark):
    df = spark.createDataFrame([("en", "one two")] * 29, "lang string, text string")
    assert col.collocations(df).count() == 0
    assert col.collocations(df.limit(0)).count() == 0
    more = col.collocations(df.unionByName(df)).collect()
    assert [tuple(r) for r in more] == [("en", 1, "one two", 58, 58, 58, 116, 1_000_000)]


@pytest.mark.parametrize("seed", range(30))
def test_transducers(seed):
    rng = random.Random(seed)
    shards = []
    for _ in range(rng.randint(1, 4)):
        shards.append(Counter(tuple(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 200))))
    packed = []
    for counts in shards:
        words = sorted({w.encode() for p in counts for w in p})
        rows = np.array(sorted([words.index(w.encode()) for w in p] + [-1] * (4 - len(p)) for p in counts))
        shown = lambda row: tuple(words[i].decode() for i in row if i >= 0)
        packed.append(col.pack(words, rows, np.array([counts[shown(r)] for r in rows])))
    words, rows, weights = col.united(packed)
    union = sum(shards, Counter())
    assert {tuple(words[i].decode() for i in r if i >= 0): int(w) for r, w in zip(rows, weights)} == union
    whole = col.Transducer.build(rows, weights)
    again = col.Transducer.from_bytes(whole.to_bytes())
    assert all((a == b).all() for a, b in zip(whole.rows(), again.rows()))
    asked = np.array([[rng.randrange(len(words)) if d < size else -1 for d in range(4)] for size in (1, 2, 3, 4) for _ in range(60)])
    want = [union.get(tuple(words[i].decode() for i in r if i >= 0), 0) for r in asked]
    assert again.compose(asked).tolist() == want


def test_equal_states_are_one():
    rows = np.array([[0, 5, 7], [0, 6, 7], [1, 5, 7], [1, 6, 7], [2, 5, 8]])
    t = col.Transducer.build(rows, np.ones(5, np.int64))
    assert [len(f) - 1 for f in t.first] == [1, 2, 2] and [len(x) for x in t.label] == [3, 3, 2]


def test_query(spark, sf, tmp_path):
    from tests.compare import compare, connect

    rows, problem = compare(spark, connect(sf), sf, queries.QUERIES["op11_collocations"], queries.ORACLES["op11_collocations"])
    assert problem is None and rows >= 50
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op11_collocations"](spark, sf).collect())
    assert got == plain(docs, 30, 4, 2_000, 80)
