"""Readers and writers, run on files Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from themeloom.catalog.registry import (
    CENTRES, CLASS_COUNTS, FACTORS, LABELLED, WEIGHTS, WORDS, class_documents, documents, labelled_vectors, query, table,
)
from themeloom.operators import describe, display, space, topics, vectors
from themeloom.plans import extract, scoring
from themeloom.session import scratch_path, store
from themeloom.sources import models, readers, writers

_ALL = "SELECT doc_id, text, lang, source, n_chars FROM documents"


@query("S1_read_csv", _ALL)
def _(spark, folder):
    docs = documents(spark, folder)
    path = writers.write_table(docs, scratch_path(spark, "csv"), "csv")
    found = readers.read_csv(spark, path)
    return found.withColumns({"doc_id": F.col("doc_id").cast("long"), "n_chars": F.col("n_chars").cast("long")})


@query("S1_read_gzip_csv", _ALL)
def _(spark, folder):
    docs = documents(spark, folder)
    path = writers.write_table(docs, scratch_path(spark, "csv"), "csv", compression="gzip")
    return readers.read_csv(spark, path, docs.schema)


@query("S2_read_parquet", "SELECT page_id, url, html FROM pages")
def _(spark, folder):
    return readers.read_parquet(spark, f"{folder}/pages.parquet")


@query("S5_read_patterns", "SELECT CAST(row_number() OVER (ORDER BY url) - 1 AS INT) AS pos, url AS pattern FROM (SELECT DISTINCT url FROM pages)")
def _(spark, folder):
    urls = table(spark, folder, "pages").select("url").distinct().orderBy("url").coalesce(1)
    path = scratch_path(spark, "patterns")
    urls.write.option("header", False).csv(path)
    return readers.read_patterns(spark, path)


@query("S6_read_labels", """SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INT) AS topic,
  replace(text, chr(10), '') AS label FROM benchmark""")
def _(spark, folder):
    items = table(spark, folder, "benchmark").orderBy("item_id").select(F.col("text").alias("Label")).coalesce(1)
    return readers.read_labels(spark, writers.write_table(items, scratch_path(spark, "labels"), "csv"))


@query("S7_read_candidates", """SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INT) AS topic, lower(text) AS candidate FROM benchmark""")
def _(spark, folder):
    items = table(spark, folder, "benchmark").orderBy("item_id").select("text").coalesce(1)
    return readers.read_candidates(spark, writers.write_table(items, scratch_path(spark, "candidates"), "csv"))


@query("S8_read_vectors", f"""WITH {LABELLED}, e AS (SELECT doc_id, generate_subscripts(vector, 1) - 1 AS pos, unnest(vector) AS x FROM emb)
  SELECT doc_id, CAST(pos AS INT) AS pos, round(round(x, 3) * 100 / 100, 6) AS x FROM e""")
def _(spark, folder):
    path = writers.write_vectors(labelled_vectors(spark, folder).select("doc_id", "vector"), scratch_path(spark, "vectors"), "large", compress=True)
    found = readers.read_vectors(spark, path)
    return found.select("doc_id", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("S9_union_csv_files", "SELECT doc_id, text, lang, source, n_chars FROM documents UNION ALL SELECT doc_id, NULL, NULL, NULL, quality FROM labels")
def _(spark, folder):
    docs = documents(spark, folder)
    extra = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars"))
    paths = [writers.write_table(part, scratch_path(spark, "csv"), "csv") for part in (docs, extra)]
    found = readers.read_union(spark, paths)
    return found.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long"))


@query("S10_write_cleaned", "SELECT doc_id AS original_index, lower(text) AS text FROM documents")
def _(spark, folder):
    cleaned = documents(spark, folder).select(F.col("doc_id").alias("original_index"), F.lower("text").alias("text"))
    return readers.read_csv(spark, writers.write_table(cleaned, scratch_path(spark, "cleaned"), "csv"), cleaned.schema)


@query("S11_write_topic_outputs", lambda: f"""WITH {CLASS_COUNTS()}, {FACTORS}, {WEIGHTS}, {WORDS}
  SELECT topic AS "Topic", count(*) AS "Words", (SELECT count(*) FROM docs d WHERE d.topic = w.topic) AS "Count" FROM words w GROUP BY topic""")
def _(spark, folder):
    docs = class_documents(spark, folder)
    counts = store(vectors.term_counts(docs, "text", ["topic"]), "counts", large=True)
    weights = store(describe.class_tfidf(counts), "weights", large=True)
    words = store(describe.top_words(weights, places=6), "words")
    terms = vectors.document_terms(docs, "text", ["topic", "doc_id"])
    near = store(describe.document_terms_similarity(terms, weights, distinct=True), "near", large=True)
    info = describe.topic_info(describe.topic_frequency(docs), describe.default_labels(words), words,
                               describe.representative_documents(near), docs, "text")
    made = docs.withColumn("probability", F.lit(1.0))
    detail = describe.document_info(docs, "text", made, describe.default_labels(words), describe.representative_documents(near))
    written = writers.write_topic_outputs(scratch_path(spark, "outputs"), info, detail)
    found = readers.read_parquet(spark, written["topic_details"])
    return found.select("Topic", F.size("Representation").cast("long").alias("Words"), "Count")


@query("S12_write_probabilities", f"""WITH {LABELLED}, {CENTRES}, s AS (SELECT doc_id, centres.topic,
    exp(list_cosine_similarity(vector, centre)) AS e FROM emb, centres),
  p AS (SELECT doc_id, topic, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM s)
  SELECT doc_id, {', '.join(f'round(max(CASE WHEN topic = {t} THEN p END), 6) AS "{t}"' for t in range(9))} FROM p GROUP BY doc_id""")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    full = topics.full_probabilities(v, store(topics.topic_vectors(v, v), "centres"))
    path = writers.write_probabilities(full, scratch_path(spark, "probabilities"), wide=True)
    schema = "doc_id long, " + ", ".join(f"`{t}` double" for t in range(9))
    found = readers.read_csv(spark, path, schema)
    return found.select("doc_id", *[F.round(F.col(f"`{t}`"), 6).alias(str(t)) for t in range(9)])


@query("S13_write_vectors", f"WITH {LABELLED} SELECT doc_id, round(vector[1], 6) AS first, len(vector) AS width, 'tfidf' AS kind, CAST(1.0 AS DOUBLE) AS scale FROM emb")
def _(spark, folder):
    path = writers.write_vectors(labelled_vectors(spark, folder).select("doc_id", "vector"), scratch_path(spark, "vectors"), "tfidf")
    found = readers.read_vectors(spark, path)
    return found.select("doc_id", F.round(F.col("vector")[0], 6).alias("first"), F.size("vector").cast("long").alias("width"), "kind", "scale")


@query("S14_write_labels", "SELECT CAST(dense_rank() OVER (ORDER BY source) - 1 AS INT) AS topic, source AS label FROM (SELECT DISTINCT source FROM documents)")
def _(spark, folder):
    names = documents(spark, folder).select("source").distinct()
    numbered = names.select((F.row_number().over(Window.orderBy("source")) - 1).alias("topic"), F.col("source").alias("label"))
    return readers.read_labels(spark, writers.write_labels(numbered, scratch_path(spark, "labels")))


@query("S15_write_hierarchy")
def _(spark, folder):
    counts = store(vectors.term_counts(class_documents(spark, folder).filter("topic <> -1"), "text", ["topic"]), "counts", large=True)
    weights = store(describe.class_tfidf(counts), "weights", large=True)
    words = store(describe.top_words(weights), "words")
    merges = store(display.hierarchy(weights), "merges")
    parent_words = store(display.merge_words(merges, weights), "merge_words")
    levels = display.topic_levels(counts, merges, display.level_cuts(merges))
    names = display.level_names(words, parent_words)
    tree = display.tree_text(display.tree_lines(merges), names.select(F.col("topic").alias("node"), F.col("trace_name").alias("name")))
    written = writers.write_hierarchy(scratch_path(spark, "hierarchy"), merges, display.wide_levels(levels), names, tree)
    return spark.read.text(written["tree"])


@query("R20_save_and_load_model", f"WITH {LABELLED} SELECT doc_id, topic FROM emb")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    saved = models.save_model(scratch_path(spark, "model"), {"assignments": v.select("doc_id", "topic"), "centres": topics.topic_vectors(v, v)})
    return models.load_model(spark, saved, ("assignments", "centres"))["assignments"]


def _loaded_model(spark, folder):
    """Topics by ``source``, described, saved and loaded again; the scorer goes through its own writer and reader."""
    docs = class_documents(spark, folder)
    fitted, points = space.fit_space(docs, "text", 20)
    topic = docs.select("doc_id", "topic", F.lit(1.0).alias("probability"))
    model = extract.describe_topics(docs.select("doc_id", "text"), "text", topic, points, min_share=0.0, max_share=1.0)
    path = scratch_path(spark, "scorer")
    scoring.TopicScorer(extract.with_space(model, fitted), textCol="text").save(path)
    return scoring.TopicScorer.load(path)


@query("R20_loaded_topic_words", lambda: f"WITH {CLASS_COUNTS()}, {FACTORS}, {WEIGHTS}, {WORDS} SELECT topic, rank, word, score FROM words")
def _(spark, folder):
    words = describe.top_words(_loaded_model(spark, folder).model.weights, places=6)
    return words.select("topic", "rank", "word", "score")


@query("T10_score_new_texts")
def _(spark, folder):
    scorer = _loaded_model(spark, folder).setParams(idCol="item_id")
    return scorer.transform(table(spark, folder, "benchmark")).drop("text")
