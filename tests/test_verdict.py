"""Faults found in review: order of list files, cuts of the topic tree, best items with ties."""

import numpy as np
import pytest

from themeloom.operators import describe, display, pii, topics
from themeloom.operators.neighbors import best_items
from themeloom.plans import clean, extract
from themeloom.sources import readers


@pytest.mark.parametrize("scale,cuts", [
    ("linear", [1, 2, 3, 5, 7, 9, 11, 13, 15, 17]), ("log", [1, 6, 9, 11, 13, 14, 15, 16, 17, 17]),
])
def test_level_cuts(spark, scale, cuts):
    merges = spark.createDataFrame([(str(20 + k), float(k)) for k in range(1, 19)], "Parent_ID string, Distance double")
    got = display.level_cuts(merges, 10, scale).collect()
    assert [r["cut"] for r in sorted(got, key=lambda r: r["level"])] == cuts


def test_list_in_several_files_keeps_its_order(spark, tmp_path):
    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "part-0.csv").write_text("label\nfirst\n")
    (folder / "part-1.csv").write_text("label\nsecond, a longer one\nthird\nfourth\n")
    (folder / "part-2.csv").write_text("label\nfifth\n")
    got = {r["topic"]: r["label"] for r in readers.read_labels(spark, str(folder)).collect()}
    assert [got[k][:5] for k in range(5)] == ["first", "secon", "third", "fourt", "fifth"]


def test_best_items_with_ties():
    scores = np.random.default_rng(0).integers(0, 4, (50, 12)).astype(float)
    for k in (1, 3, 12, 20):
        want = [sorted(range(12), key=lambda i: (-row[i], i))[: min(k, 12)] for row in scores]
        assert best_items(scores, k).tolist() == want


def test_documents_without_tokens_stay(spark):
    texts = [f"apple pear plum fruit {k % 3}" if k % 2 else f"engine wheel brake motor {k % 3}" for k in range(18)] + [". ! ?", "a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = extract.extract_topics(df, "text", min_docs=3, min_share=0.0, max_share=1.0)
    got = {r["doc_id"]: r for r in model.assignments.collect()}
    assert sorted(got) == list(range(20))
    assert got[18]["topic"] == -1 and got[18]["probability"] == 0.0
    assert extract.result_tables(model, df, "text")["document_info"].count() == 20


def test_word_pairs_and_outliers_have_words(spark):
    words = spark.createDataFrame(
        [(t, r, w) for t in (-1, 0) for r, w in enumerate(["red", "red apple", "blue", "unknown pair"], 1)], "topic int, rank int, word string"
    )
    terms = spark.createDataFrame([("red", [1.0, 0.0]), ("apple", [0.0, 1.0]), ("blue", [-1.0, 0.0])], "term string, vector array<double>")
    points = spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 0.0])], "doc_id long, vector array<double>")
    own = spark.createDataFrame([(1, -1), (2, 0)], "doc_id long, topic int")
    picked = describe.diverse_words(words, terms, topics.topic_vectors(points, own, outliers=True), n=4, diversity=0.0).collect()
    assert {t: [r["word"] for r in sorted(picked, key=lambda r: r["rank"]) if r["topic"] == t] for t in (-1, 0)} == {
        -1: ["red apple", "red", "unknown pair", "blue"], 0: ["red", "red apple", "unknown pair", "blue"]
    }
    near = describe.keyword_similarity(words, terms, points, own).collect()
    scores = {(r["topic"], r["word"]): round(r["score"], 6) for r in near}
    assert len(scores) == 8 and scores[-1, "red apple"] == 1.0 and scores[-1, "red"] == round(0.5**0.5, 6) and scores[0, "unknown pair"] == 0.0
    bare = describe.diverse_words(words, terms.limit(0), topics.topic_vectors(points.limit(0), own), n=2).collect()
    assert len(bare) == 4


def test_names_are_rewritten_with_the_patterns(spark):
    rows = [(1, "Anna wrote to anna@x.org about Berlin"), (2, "No one here"), (3, None), (4, "Anna Anna")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = spark.createDataFrame([("Anna", "PERSON"), ("Berlin", "LOCATION")], "name string, entity string")
    out = lambda strategy, **k: [r["text"] for r in pii.anonymise(df, ["text"], strategy, names=names, **k).orderBy("doc_id").collect()]
    assert out("replace") == ["<PERSON> wrote to <EMAIL_ADDRESS> about <LOCATION>", "No one here", None, "<PERSON> <PERSON>"]
    fake = out("fake_first_name")
    assert fake[0].split()[0] in pii.FAKE_NAMES and fake[3].split() == [fake[0].split()[0]] * 2
    assert "Anna" not in out("encrypt", key=b"k" * 16)[3]
    cleaned = clean.clean_table(df, "text", ["doc_id"], clean=False, deduplicate=False, anonymise=True, names=names)
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()}[4] == " "


def test_same_topics_in_one_cell_and_in_many(spark):
    rng = np.random.default_rng(1)
    m = np.vstack([c + rng.normal(size=(600, 5)) * 0.5 for c in rng.normal(size=(3, 5)) * 10] + [rng.uniform(-60, 60, size=(20, 5))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    for limit in (2_048, 300):
        topic = {r["doc_id"]: r["topic"] for r in topics.density_clusters(df, leaf=limit).collect()}
        groups = [[topic[i] for i in range(k * 600, (k + 1) * 600)] for k in range(3)]
        assert all(len(set(g) - {-1}) == 1 and g.count(-1) < 60 for g in groups), limit
        assert {max(g) for g in groups} == {0, 1, 2} and {topic[i] for i in range(1800, 1820)} == {-1}


def test_search_in_small_steps_is_the_same(monkeypatch):
    from themeloom.operators import neighbors

    v = np.random.default_rng(0).normal(size=(50, 4))
    ids = np.arange(50)
    whole = neighbors._search(ids, v, ids, v, 5, "cosine", True)
    monkeypatch.setattr(neighbors, "_SCORES", 120)
    assert np.allclose(neighbors._search(ids, v, ids, v, 5, "cosine", True), whole)
