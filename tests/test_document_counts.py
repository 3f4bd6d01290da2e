"""Counts per document beside brute force."""

import re

from pyspark.sql import functions as F

from themeloom.operators import describe, skew, vectors
from themeloom.session import store

DOCS = [(1, 0, "red fox red fox"), (1, 0, "red hen"), (2, 0, "blue fox"), (2, 1, "blue hen"), (None, 1, "red fox"), (None, 1, "red cow"), (3, None, "grey cow"), (4, 1, None)]


def test_document_scope_deals_no_term_by_document(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, topic int, text string")
    found = vectors.document_spread(docs, "text", ["topic", "doc_id"])
    grams = {}
    for doc, topic, t in DOCS:
        words = (t or "").split()
        grams.setdefault((topic, doc), set()).update(words + [" ".join(p) for p in zip(words, words[1:])])
    expected = {}
    for terms in grams.values():
        for term in terms:
            expected[term] = expected.get(term, 0) + 1
    assert {r["term"]: r["_spread"] for r in found.collect()} == expected
    unique = docs.filter("doc_id > 2")
    limited = vectors.limited_term_counts(unique, "text", df_scope="document", min_share=0.0, max_share=1.0)
    assert not re.search(r"hashpartitioning\(topic#\d+, doc_id#\d+L, term#\d+", limited._jdf.queryExecution().executedPlan().toString())


def test_similarity_of_places_is_that_of_counts(spark):
    docs = spark.createDataFrame([d for d in DOCS if d[1] is not None], "doc_id long, topic int, text string")
    weights = store(describe.class_tfidf(vectors.term_counts(docs, "text", ["topic"])))
    places = vectors.term_rows(docs, "text", ["topic", "doc_id"]).withColumn("n", F.lit(1).cast("long"))
    counts = vectors.term_counts(docs, "text", ["topic", "doc_id"])
    listed = lambda df: {(r["topic"], r["doc_id"]): round(r["similarity"], 12) for r in describe.document_terms_similarity(df, weights).collect()}
    assert listed(places) == listed(counts) and len(listed(places)) == 4


def test_terms_of_documents_are_counted_where_the_text_is(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, topic int, text string")
    listed = lambda df: sorted((str(r["topic"]), str(r["doc_id"]), r["term"], r["n"]) for r in df.collect())
    assert listed(vectors.document_terms(docs, "text", ["topic", "doc_id"])) == listed(vectors.term_counts(docs, "text", ["topic", "doc_id"]))
    unique = vectors.document_terms(docs.filter("doc_id > 1 AND text IS NOT NULL"), "text", ["topic", "doc_id"])
    assert "Exchange" not in unique._jdf.queryExecution().executedPlan().toString()


def test_similarity_is_the_same_however_many_terms_are_sent(spark, monkeypatch):
    docs = spark.createDataFrame([d for d in DOCS if d[1] is not None], "doc_id long, topic int, text string")
    weights = store(describe.class_tfidf(vectors.term_counts(docs, "text", ["topic"])))
    counts, terms = vectors.term_counts(docs, "text", ["topic", "doc_id"]), vectors.document_terms(docs, "text", ["topic", "doc_id"])
    listed = lambda df: {(r["topic"], r["doc_id"]): round(r["similarity"], 12) for r in df.collect()}
    expected = listed(describe.document_terms_similarity(counts, weights))
    for sent in (0, 600, 1_000, 1 << 20):
        monkeypatch.setattr(describe.params, "SHIP_BYTES", sent)
        assert listed(describe.document_terms_similarity(terms, weights, distinct=True)) == expected
    joined = skew.joined_parts(terms, weights.withColumnRenamed("n", "uses"), ["topic", "term"], "uses", 1_000)
    assert len(joined) == 2 and sum(part.count() for part in joined) == terms.count()
    assert listed(describe.document_terms_similarity(terms, weights, distinct=True)) == expected


def test_weights_are_not_dealt_by_topic(spark):
    counts = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "a", 1)], "topic int, term string, n long")
    plan = describe.class_tfidf(store(counts))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
