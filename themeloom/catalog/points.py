"""Vectors, clustering and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.catalog.registry import (
    CENTRES, CLASS_COUNTS, CLASS_DOCUMENTS, FACTORS, LABELLED, WEIGHTS, WORDS, class_documents, documents,
    labelled_vectors, query, table, topic_tokens_sql,
)
from themeloom.functions import arrays
from themeloom.operators import components, describe, linalg, neighbors, space, spectral, topics, vectors
from themeloom.plans import extract
from themeloom.session import store

_TOKEN = r"[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}"
_TF = f"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term)"""
_TFIDF = f"""{_TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  n AS (SELECT count(DISTINCT doc_id) AS n FROM tf),
  w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS weight FROM tf JOIN df USING (term), n)"""


@query("F1_tokens", f"WITH {_TF} SELECT doc_id, term, tf FROM tf")
def _(spark, folder):
    return vectors.token_rows(documents(spark, folder), "text")


@query("F2_tfidf", f"WITH {_TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM w")
def _(spark, folder):
    counts = store(vectors.token_rows(documents(spark, folder), "text"), "tokens")
    return vectors.tfidf(counts).withColumn("weight", F.round("weight", 6))


@query("F3_l2_rows", f"""WITH {_TFIDF}, len AS (SELECT doc_id, sqrt(sum(weight * weight)) AS l FROM w GROUP BY doc_id)
  SELECT doc_id, term, round(weight / l, 6) AS weight FROM w JOIN len USING (doc_id)""")
def _(spark, folder):
    counts = store(vectors.token_rows(documents(spark, folder), "text"), "tokens")
    return vectors.l2_rows(vectors.tfidf(counts)).withColumn("weight", F.round("weight", 6))


@query("F4_text_vectors")
def _(spark, folder):
    found, _ = extract.text_vectors(documents(spark, folder), "text")
    return found


@query("F4_known_terms_of_new_texts", f"""WITH {_TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  n AS (SELECT count(DISTINCT doc_id) AS n FROM tf),
  new_tok AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM benchmark),
  new_tf AS (SELECT item_id, term, count(*) AS tf FROM new_tok GROUP BY item_id, term)
  SELECT item_id, term, round(tf * (ln((1 + n) / (1 + df)) + 1), 6) AS weight FROM new_tf JOIN df USING (term), n""")
def _(spark, folder):
    fitted, _ = space.fit_space(documents(spark, folder), "text", 10)
    found = space.known_terms(fitted, table(spark, folder, "benchmark"), "text", "item_id")
    return found.select("item_id", "term", F.round("weight", 6).alias("weight"))


@query("F4_fold_in", f"WITH {_TF} SELECT doc_id, 0.0::DOUBLE AS distance FROM (SELECT DISTINCT doc_id FROM tf)")
def _(spark, folder):
    docs = documents(spark, folder)
    fitted, own = space.fit_space(docs, "text", 20)
    again = space.embed_texts(fitted, docs, "text").withColumnRenamed("vector", "again")
    gaps = F.aggregate(F.zip_with("vector", "again", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return own.join(again, "doc_id").select("doc_id", F.round(F.sqrt(gaps), 9).alias("distance"))


@query("F5_gram_matrix", f"""WITH {LABELLED}, e AS (SELECT doc_id, CAST(generate_subscripts(vector, 1) - 1 AS INT) AS p, unnest(vector) AS x FROM emb)
  SELECT a.p AS i, b.p AS j, round(sum(a.x * b.x), 6) AS value FROM e a JOIN e b USING (doc_id) GROUP BY a.p, b.p""")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    return linalg.gram(v, "vector", len(v.first()["vector"])).withColumn("value", F.round("value", 6))


@query("F5_display_points")
def _(spark, folder):
    points = linalg.dense_svd(labelled_vectors(spark, folder), 2)
    return points.select("doc_id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


@query("F6_term_counts_by_topic", lambda: f"""WITH {CLASS_COUNTS()}, spread AS (SELECT term, count(*) AS s FROM counts GROUP BY term),
  k AS (SELECT count(DISTINCT topic) AS k FROM docs)
  SELECT topic, term, n FROM counts JOIN spread USING (term), k WHERE s >= 0.01 * k AND s <= 0.95 * k""")
def _(spark, folder):
    return vectors.limited_term_counts(class_documents(spark, folder), "text")


@query("F6_term_counts_by_document", lambda: f"""WITH {CLASS_DOCUMENTS}, {topic_tokens_sql()},
  counts AS (SELECT topic, doc_id, term, count(*) AS n FROM grams GROUP BY topic, doc_id, term),
  spread AS (SELECT term, count(*) AS s FROM counts GROUP BY term), k AS (SELECT count(*) AS k FROM docs)
  SELECT topic, term, CAST(sum(n) AS BIGINT) AS n FROM counts JOIN spread USING (term), k
  WHERE s >= 0.01 * k AND s <= 0.95 * k GROUP BY topic, term""")
def _(spark, folder):
    return vectors.limited_term_counts(class_documents(spark, folder), "text", df_scope="document")


@query("F7_model_vectors", """SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars,
  CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS es FROM documents""")
def _(spark, folder):
    encode = lambda batch: [[len(t), t.count("e")] for t in batch]
    found = vectors.model_vectors(documents(spark, folder), "text", encode)
    return found.select("doc_id", F.col("vector")[0].cast("double").alias("chars"), F.col("vector")[1].cast("double").alias("es"))


@query("F8_reuse_vectors", """SELECT d.doc_id, 'tfidf' AS kind, round(CASE WHEN e.label < 5 THEN CAST(e.embedding[1] AS DOUBLE)
  ELSE d.n_chars END, 6) AS first FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""")
def _(spark, folder):
    stored = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"),
        F.when(F.col("label") < 5, "tfidf").otherwise("large").alias("kind"),
    )
    embed = lambda missing: missing.select("doc_id", F.array(F.col("n_chars").cast("double")).alias("vector"))
    found = vectors.reuse_vectors(documents(spark, folder), stored, "tfidf", embed)
    return found.select("doc_id", "kind", F.round(F.col("vector")[0], 6).alias("first"))


@query("F9_compress", f"""WITH {LABELLED} SELECT doc_id, CAST(generate_subscripts(vector, 1) - 1 AS INT) AS pos,
  round(round(unnest(vector), 3) * 100, 6) AS x, CAST(100 AS DOUBLE) AS scale FROM emb""")
def _(spark, folder):
    small = vectors.compressed(labelled_vectors(spark, folder).select("doc_id", "vector"))
    return small.select("doc_id", F.posexplode("vector").alias("pos", "x"), "scale").withColumn("x", F.round("x", 6))


@query("T1_reduce_for_clusters")
def _(spark, folder):
    return topics.reduce_for_clusters(labelled_vectors(spark, folder))


@query("T1_graph_reduction")
def _(spark, folder):
    return topics.reduce_for_clusters(labelled_vectors(spark, folder), method="graph")


@query("T1_graph_products", "SELECT i::INT AS i, i::INT AS j, 1.0::DOUBLE AS value FROM (SELECT unnest(generate_series(0, 5)) AS i)")
def _(spark, folder):
    points, _ = topics.density_points(labelled_vectors(spark, folder))
    found, _, _ = spectral.eigenvectors(*spectral.normalised(store(spectral.fuzzy_graph(points), "graph")), 5)
    products = linalg.gram(found.select(F.concat(F.array("root"), "vector").alias("vector")), "vector", 6)
    return products.withColumn("value", F.round("value", 6)).filter("value <> 0")


@query("T2_density_clusters")
def _(spark, folder):
    reduced = store(topics.reduce_for_clusters(labelled_vectors(spark, folder)), "reduced")
    return topics.density_clusters(reduced)


_KNN = f"""{LABELLED}, pairs AS (SELECT a.doc_id AS query, b.doc_id AS item, list_cosine_similarity(a.vector, b.vector) AS score
    FROM emb a, emb b WHERE a.doc_id <> b.doc_id),
  near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS INT) AS rank FROM pairs)"""


@query("T2_nearest_neighbours", f"WITH {_KNN} SELECT query, item, round(score, 6) AS score, rank FROM near WHERE rank <= 5")
def _(spark, folder):
    items = labelled_vectors(spark, folder).select(F.col("doc_id").alias("id"), "vector")
    return neighbors.nearest(items, items, 5, skip_self=True).withColumn("score", F.round("score", 6))


@query("T2_connected_components", f"""WITH RECURSIVE {_KNN}, one AS (SELECT query AS a, item AS b FROM near WHERE rank = 1),
  linked AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
  walk(id, seen) AS (SELECT doc_id, doc_id FROM emb UNION SELECT walk.id, linked.b FROM walk JOIN linked ON walk.seen = linked.a)
  SELECT id, min(seen) AS component FROM walk GROUP BY id""")
def _(spark, folder):
    items = labelled_vectors(spark, folder).select(F.col("doc_id").alias("id"), "vector")
    near = neighbors.nearest(items, items, 1, skip_self=True)
    return components.connected_components(items.select("id"), near.select(F.col("query").alias("a"), F.col("item").alias("b")))


_BY_SIZE = """sizes AS (SELECT topic, count(*) AS n, min(doc_id) AS first FROM {0} WHERE topic <> -1 GROUP BY topic),
  numbers AS (SELECT topic, row_number() OVER (ORDER BY n DESC, first) - 1 AS number FROM sizes)"""


@query("T3_number_by_size", f"WITH {LABELLED}, {_BY_SIZE.format('emb')} SELECT doc_id, CAST(coalesce(number, -1) AS INT) AS topic FROM emb LEFT JOIN numbers USING (topic)")
def _(spark, folder):
    return topics.number_by_size(labelled_vectors(spark, folder).select("doc_id", "topic"))


@query("T4_limit_topics")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    return topics.limit_topics(v.select("doc_id", "topic"), v, count=4)


@query("T4_automatic_limit", f"WITH {LABELLED}, {_BY_SIZE.format('emb')} SELECT doc_id, CAST(coalesce(number, -1) AS INT) AS topic FROM emb LEFT JOIN numbers USING (topic)")
def _(spark, folder):
    """No two classes of the table are similar enough to be merged."""
    v = labelled_vectors(spark, folder)
    return topics.limit_topics(v.select("doc_id", "topic"), v, min_similarity=0.999)


_SIMILAR = f"""{LABELLED}, {CENTRES}, sim AS (SELECT doc_id, emb.topic AS own, centres.topic AS topic,
  list_cosine_similarity(vector, centre) AS s FROM emb, centres)"""
_BEST = f"""{_SIMILAR}, best AS (SELECT doc_id, own, topic, s FROM (SELECT *,
  row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, topic) AS rn FROM sim) WHERE rn = 1)"""


def _centres(v):
    return store(topics.topic_vectors(v, v), "centres")


@query("T5_assignment_probability", f"""WITH {_SIMILAR} SELECT emb.doc_id, emb.topic, round(coalesce((s + 1) / 2, 0), 6) AS probability
  FROM emb LEFT JOIN sim ON emb.doc_id = sim.doc_id AND emb.topic = sim.topic""")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    return topics.assignment_probability(v, v, _centres(v)).withColumn("probability", F.round("probability", 6))


@query("T6_full_probabilities", f"""WITH {_SIMILAR} SELECT doc_id, topic, round(exp(s) / sum(exp(s)) OVER (PARTITION BY doc_id), 6) AS probability FROM sim""")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    return topics.full_probabilities(v, _centres(v)).withColumn("probability", F.round("probability", 6))


@query("T7_zero_shot", f"WITH {_BEST} SELECT doc_id, topic, round(s, 6) AS similarity FROM best WHERE s >= 0.2")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    return topics.zero_shot(v, _centres(v), 0.2).withColumn("similarity", F.round("similarity", 6))


@query("T8_zero_shot_then_cluster")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    return topics.zero_shot_then_cluster(v, _centres(v), threshold=0.2)


@query("T10_score_documents", f"WITH {_BEST} SELECT doc_id, topic, round((s + 1) / 2, 6) AS probability FROM best")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    return topics.score_documents(v, _centres(v)).withColumn("probability", F.round("probability", 6))


_REDUCED = f"{_BEST}, moved AS (SELECT doc_id, CASE WHEN own = -1 THEN topic ELSE own END AS topic FROM best)"


@query("T11_reduce_outliers", f"WITH {_REDUCED} SELECT doc_id, topic FROM moved")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    return topics.reduce_outliers(v, v)


@query("T12_words_after_reassignment", lambda: f"""WITH {_REDUCED}, docs AS (SELECT doc_id, moved.topic, text FROM moved JOIN documents USING (doc_id)),
  {topic_tokens_sql()}, counts AS (SELECT topic, term, count(*) AS n FROM grams GROUP BY topic, term),
  {FACTORS}, {WEIGHTS}, {WORDS} SELECT topic, rank, word, score FROM words""")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    moved = topics.reduce_outliers(v, v)
    docs = documents(spark, folder).select("doc_id", "text").join(moved, "doc_id")
    counts = store(vectors.term_counts(docs, "text", ["topic"]), "counts")
    return describe.top_words(describe.class_tfidf(counts), places=6).select("topic", "rank", "word", "score")


@query("F_unit_vectors", f"WITH {LABELLED} SELECT doc_id, round(sqrt(list_sum(list_transform(vector, lambda x: x * x))), 6) AS length FROM emb")
def _(spark, folder):
    return labelled_vectors(spark, folder).select("doc_id", F.round(arrays.norm(F.col("vector")), 6).alias("length"))
