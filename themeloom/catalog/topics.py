"""Topic description and the tables behind the topic views."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.catalog.text import cleaned, trimmed
from themeloom.catalog.registry import (
    CENTRES, CLASS_COUNTS, CLASS_DOCUMENTS, FACTORS, LABELLED, WEIGHTS, WORDS, class_documents, documents,
    labelled_vectors, query, quoted, table, topic_tokens_sql,
)
from themeloom.functions import text
from themeloom.operators import dedup, describe, display, topics, vectors
from themeloom.operators.rows import number_rows
from themeloom.plans import extract
from themeloom.session import store


def _counts(spark, folder):
    return store(vectors.term_counts(class_documents(spark, folder), "text", ["topic"]), "counts", large=True)


def _words(spark, folder):
    return store(describe.top_words(describe.class_tfidf(_counts(spark, folder)), places=6), "words")


_TOP = lambda: f"{CLASS_COUNTS()}, {FACTORS}, {WEIGHTS}, {WORDS}"
_LISTED = """labels AS (SELECT topic, topic || ', ' || string_agg(word, ', ' ORDER BY rank) AS label FROM words WHERE rank <= 3 GROUP BY topic)"""


@query("R1_joined_text_sizes", f"""WITH {CLASS_DOCUMENTS}, j AS (SELECT topic, count(*) AS documents, string_agg(text, ' ' ORDER BY doc_id) AS t FROM docs GROUP BY topic)
  SELECT topic, documents, CAST(length(t) AS BIGINT) AS characters,
  CAST(len(list_filter(string_split_regex(t, '[\\s\\x0b\\x85\\p{{Z}}]+'), lambda w: w <> '')) AS BIGINT) AS words FROM j""")
def _(spark, folder):
    return describe.joined_text_sizes(class_documents(spark, folder), "text")


@query("R2_class_tfidf", lambda: f"WITH {CLASS_COUNTS()}, {FACTORS}, {WEIGHTS} SELECT topic, term, round(weight, 9) AS weight FROM weights")
def _(spark, folder):
    return describe.class_tfidf(_counts(spark, folder)).select("topic", "term", F.round("weight", 9).alias("weight"))


@query("R3_top_words", lambda: f"WITH {_TOP()} SELECT topic, 'Default' AS aspect, rank, word, score FROM words")
def _(spark, folder):
    return describe.top_words(describe.class_tfidf(_counts(spark, folder)), places=6)


@query("R3_words_of_clean_texts_by_language", lambda: _flagship_sql())
def flagship(spark, folder):
    """Top words and a label for each language, on clean, distinct text."""
    docs = documents(spark, folder).select("doc_id", text.clean(F.col("text")).alias("text"), F.col("lang").alias("topic"))
    counts = store(vectors.term_counts(dedup.prepare(docs, "text", "doc_id"), "text", ["topic"]), "counts", large=True)
    words = store(describe.top_words(describe.class_tfidf(counts), places=6), "words")
    return words.join(describe.default_labels(words), "topic").select("topic", "label", "rank", "word", "score")


def _flagship_sql():
    return f"""WITH s AS (SELECT doc_id, lang AS topic, {trimmed(cleaned('text'))} AS text FROM documents),
      docs AS (SELECT doc_id, topic, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
        FROM s WHERE length(text) >= 50) WHERE rn = 1),
      {topic_tokens_sql()}, counts AS (SELECT topic, term, count(*) AS n FROM grams GROUP BY topic, term),
      {FACTORS}, {WEIGHTS}, {WORDS}, {_LISTED}
      SELECT topic, label, rank, word, score FROM words JOIN labels USING (topic)"""


@query("R4_topic_frequency", f"WITH {CLASS_DOCUMENTS} SELECT topic, count(*) AS count FROM docs GROUP BY topic")
def _(spark, folder):
    return describe.topic_frequency(class_documents(spark, folder))


_NEAR = lambda: f"""{_TOP()}, {_LISTED},
  per AS (SELECT topic, doc_id, term, count(*) AS n FROM grams GROUP BY topic, doc_id, term),
  own AS (SELECT topic, doc_id, term, n * factor AS w FROM per JOIN factors USING (term)),
  tl AS (SELECT topic, sqrt(sum(weight * weight)) AS tl FROM weights GROUP BY topic),
  sim AS (SELECT topic, doc_id, sum(w * weight) / (sqrt(sum(w * w)) * max(tl)) AS s FROM own JOIN weights USING (topic, term)
    JOIN tl USING (topic) GROUP BY topic, doc_id),
  reps AS (SELECT topic, doc_id, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(s, 9) DESC, doc_id) AS rn
    FROM sim) WHERE rn <= 3)"""


def _described(spark, folder):
    docs = class_documents(spark, folder)
    weights = store(describe.class_tfidf(_counts(spark, folder)), "weights", large=True)
    terms = vectors.document_terms(docs, "text", ["topic", "doc_id"])
    near = store(describe.document_terms_similarity(terms, weights, distinct=True), "near", large=True)
    return docs, weights, near


@query("R5_topic_info", lambda: f"""WITH {_NEAR()}, freq AS (SELECT topic, count(*) AS c FROM docs GROUP BY topic),
  reptext AS (SELECT topic, string_agg(md5(d.text), ',' ORDER BY rank) AS t FROM reps JOIN documents d USING (doc_id) GROUP BY topic),
  allwords AS (SELECT topic, string_agg(word, '|' ORDER BY rank) AS ws FROM words GROUP BY topic)
  SELECT topic AS "Topic", c AS "Count", label AS "Name", 'topic ' || topic AS "CustomName", ws AS "Representation", t AS "Representative_Docs"
  FROM freq LEFT JOIN labels USING (topic) LEFT JOIN allwords USING (topic) LEFT JOIN reptext USING (topic)""")
def _(spark, folder):
    docs, weights, near = _described(spark, folder)
    words = store(describe.top_words(weights, places=6), "words")
    frequency = describe.topic_frequency(docs)
    custom = frequency.select("topic", F.concat(F.lit("topic "), F.col("topic").cast("string")).alias("label"))
    info = describe.topic_info(frequency, describe.default_labels(words), words, describe.representative_documents(near), docs, "text", custom)
    return info.withColumns({
        "Representation": F.array_join("Representation", "|"),
        "Representative_Docs": F.array_join(F.transform("Representative_Docs", F.md5), ","),
    })


@query("R6_default_labels", lambda: f"WITH {_TOP()}, {_LISTED} SELECT topic, label FROM labels")
def _(spark, folder):
    return describe.default_labels(_words(spark, folder))


@query("R7_given_labels", lambda: f"WITH {_TOP()}, {_LISTED}, given AS (SELECT topic, 'group ' || (topic + 1) AS g FROM labels) SELECT topic, g AS label FROM given")
def _(spark, folder):
    labels = store(describe.default_labels(_words(spark, folder)), "labels")
    given = labels.select("topic", F.concat(F.lit("group "), (F.col("topic") + 1).cast("string")).alias("label"))
    return describe.given_labels(labels, given)


@query("R8_zero_shot_labels", lambda: f"""WITH {_TOP()}, {_LISTED}, cand AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS topic, lower(text) AS c FROM benchmark)
  SELECT topic, coalesce(c, label) AS label FROM labels LEFT JOIN cand USING (topic)""")
def _(spark, folder):
    items = number_rows(table(spark, folder, "benchmark"), ["item_id"], "topic")
    return describe.zero_shot_labels(describe.default_labels(_words(spark, folder)), items.select("topic", F.lower("text").alias("candidate")))


@query("R9_representative_documents", lambda: f"WITH {_NEAR()} SELECT topic, doc_id, rank FROM reps")
def _(spark, folder):
    return describe.representative_documents(_described(spark, folder)[2])


@query("R10_document_info", lambda: f"""WITH {_NEAR()} SELECT docs.doc_id, docs.text AS "Document", docs.topic AS "Topic", label AS "Name",
  round(coalesce(s, 0), 6) AS "Probability", (docs.doc_id IN (SELECT doc_id FROM reps)) AS "Representative_document"
  FROM docs LEFT JOIN labels USING (topic) LEFT JOIN sim ON docs.doc_id = sim.doc_id""")
def _(spark, folder):
    docs, weights, near = _described(spark, folder)
    labels = describe.default_labels(describe.top_words(weights, places=6))
    scored = docs.select("doc_id", "topic").join(near.select("doc_id", "similarity"), "doc_id", "left").withColumn("probability", F.round(F.coalesce("similarity", F.lit(0.0)), 6))
    return describe.document_info(docs, "text", scored, labels, describe.representative_documents(near))


@query("R11_with_probabilities", f"""WITH {LABELLED}, {CENTRES}, s AS (SELECT doc_id, emb.topic AS own, centres.topic AS t, exp(list_cosine_similarity(vector, centre)) AS e FROM emb, centres)
  SELECT d.doc_id, own AS "Topic", t AS other_topic, round(e / sum(e) OVER (PARTITION BY s.doc_id), 6) AS topic_probability
  FROM documents d LEFT JOIN s USING (doc_id)""")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    full = topics.full_probabilities(v, store(topics.topic_vectors(v, v), "centres"))
    info = documents(spark, folder).select("doc_id").join(v.select("doc_id", F.col("topic").alias("Topic")), "doc_id", "left")
    found = describe.with_probabilities(info, full)
    return found.select("doc_id", "Topic", "other_topic", F.round("topic_probability", 6).alias("topic_probability"))


_TURNS = """turns AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS doc_id, conv_id, CAST(turn AS INT) AS pos, role, text,
  CASE WHEN length(text) < 50 THEN -1 WHEN role = 'user' THEN 0 WHEN role = 'assistant' THEN 1 ELSE 2 END AS topic FROM conversations)"""


def _turns(spark, folder):
    """Conversation turns as the sentences of a conversation."""
    turns = number_rows(table(spark, folder, "conversations"), ["conv_id", "turn"], "sentence_index")
    topic = F.when(F.length("text") < 50, -1).when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    info = turns.select(F.col("sentence_index").alias("doc_id"), F.col("text").alias("Document"), topic.cast("int").alias("Topic"),
                        F.col("role").alias("Name"), F.round(1 / (1 + F.length("text")), 6).alias("Probability"))
    parents = turns.select("sentence_index", F.col("conv_id").alias("document_index"), F.col("turn").cast("int").alias("sentence_pos"))
    return describe.with_parent(info, parents)


@query("R12_with_parent", f"""WITH {_TURNS} SELECT doc_id, text AS "Document", CAST(topic AS INT) AS "Topic", role AS "Name", round(1 / (1 + length(text)), 6) AS "Probability",
  conv_id AS parent_document_index, pos AS sentence_pos FROM turns""")
def _(spark, folder):
    return _turns(spark, folder)


@query("R13_parent_info", f"""WITH {_TURNS} SELECT conv_id AS parent_document_index, string_agg(text, ' ' ORDER BY pos) AS "Document",
  coalesce(string_agg(CASE WHEN topic <> -1 THEN CAST(topic AS VARCHAR) END, ',' ORDER BY pos), '') AS numbers,
  coalesce(string_agg(CASE WHEN topic <> -1 THEN role END, ',' ORDER BY pos), '') AS names,
  CAST(count(CASE WHEN topic <> -1 THEN 1 END) AS INT) AS probabilities FROM turns GROUP BY conv_id""")
def _(spark, folder):
    found = describe.parent_info(_turns(spark, folder))
    return found.select(
        "parent_document_index", "Document", F.array_join(F.col("Topic numbers").cast("array<string>"), ",").alias("numbers"),
        F.array_join("Topic names", ",").alias("names"), F.size("Probabilities").alias("probabilities"),
    )


def _with_terms(spark, folder):
    """Class words with term vectors and document vectors of the same space."""
    docs, weights, near = _described(spark, folder)
    points, terms = extract.text_vectors(docs, "text", dimensions=20)
    return docs, weights, near, points, terms


@query("R14_diverse_words")
def _(spark, folder):
    docs, weights, _, points, terms = _with_terms(spark, folder)
    return describe.diverse_words(describe.top_words(weights, 30), terms, topics.topic_vectors(points, docs, outliers=True))


@query("R15_keyword_similarity")
def _(spark, folder):
    _, weights, near, points, terms = _with_terms(spark, folder)
    return describe.keyword_similarity(describe.top_words(weights, 30), terms, points, describe.representative_documents(near))


@query("R17_label_prompts", lambda: f"""WITH {_NEAR()}, lines AS (SELECT topic, string_agg('- ' || d.text || chr(10), '' ORDER BY rank) AS l FROM reps JOIN documents d USING (doc_id) GROUP BY topic),
  ws AS (SELECT topic, string_agg(word, ', ' ORDER BY rank) AS w FROM words GROUP BY topic)
  SELECT topic, md5(replace(replace({quoted(describe.prompt_template())}, '[KEYWORDS]', w), '[DOCUMENTS]', l)) AS prompt FROM lines JOIN ws USING (topic)""")
def _(spark, folder):
    docs, weights, near = _described(spark, folder)
    words = describe.top_words(weights, places=6)
    return describe.label_prompts(words, describe.representative_documents(near), docs, "text").withColumn("prompt", F.md5("prompt"))


@query("R18_generated_labels", lambda: f"""WITH {_TOP()}, ws AS (SELECT topic, string_agg(word, ', ' ORDER BY rank) AS w FROM words GROUP BY topic)
  SELECT topic, trim(regexp_replace(w, '[^a-zA-Z0-9 ''-]', '', 'g')) AS label FROM ws""")
def _(spark, folder):
    prompts = describe.word_list(_words(spark, folder), 10).withColumnRenamed("words", "prompt")
    return describe.generated_labels(prompts, lambda batch: [f"\"{p}\"!\nsecond line" for p in batch])


@query("R19_aspect_labels", lambda: f"""WITH {_TOP()}, l AS (SELECT topic, topic || '_' || string_agg(word, '_' ORDER BY rank) AS label FROM words WHERE rank <= 3 GROUP BY topic)
  SELECT topic, CASE WHEN length(label) < 30 THEN label ELSE substring(label, 1, 27) || '...' END AS label FROM l""")
def _(spark, folder):
    return describe.aspect_labels(_words(spark, folder), "Default")


def _points(spark, folder):
    """Labelled vectors with their first two components as a position."""
    v = labelled_vectors(spark, folder)
    return v.select("doc_id", "topic", F.col("vector")[0].cast("double").alias("x"), F.col("vector")[1].cast("double").alias("y"))


_POINTS = f"{LABELLED}, points AS (SELECT doc_id, topic, vector[1] AS x, vector[2] AS y FROM emb)"
_WRAPPED = """array_to_string(list_transform(range(0, CAST(ceil(len(ws) / 20.0) AS BIGINT)), lambda i: array_to_string(ws[i * 20 + 1 : i * 20 + 20], ' ') || '<br>'), '')"""


@query("V1_document_map", f"""WITH {_POINTS}, hover AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\s\\x0b\\x85\\p{{Z}}]+'), lambda w: w <> '')[1:300] AS ws FROM documents)
  SELECT topic, doc_id, {_WRAPPED} AS hover_label, round(x, 6) AS x, round(y, 6) AS y FROM points JOIN hover USING (doc_id)""")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    found = display.document_map(v, v.select("doc_id", "vector"), documents(spark, folder), "text")
    return found.withColumns({"x": F.round(F.col("x").cast("double"), 6), "y": F.round(F.col("y").cast("double"), 6)})


@query("V2_sample_per_topic", """WITH d AS (SELECT doc_id, lang AS topic, md5('42:' || doc_id) AS o FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY o, doc_id) AS rn, count(*) OVER (PARTITION BY topic) AS n FROM d)
  SELECT doc_id, topic FROM r WHERE rn <= CASE WHEN n < 100 THEN n ELSE floor(n * 0.1) END""")
def _(spark, folder):
    return display.sample_per_topic(documents(spark, folder).select("doc_id", F.col("lang").alias("topic")))


@query("V3_label_anchors", f"WITH {_POINTS} SELECT topic, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM points GROUP BY topic")
def _(spark, folder):
    return display.label_anchors(_points(spark, folder)).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("V4_extents", f"""WITH {_POINTS} SELECT round(min(x) - abs(min(x) * 0.15), 6) AS x_min, round(max(x) + abs(max(x) * 0.15), 6) AS x_max,
  round(min(y) - abs(min(y) * 0.15), 6) AS y_min, round(max(y) + abs(max(y) * 0.15), 6) AS y_max FROM points""")
def _(spark, folder):
    return display.extents(_points(spark, folder)).select(*[F.round(c, 6).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])


@query("V5_term_similarity", lambda: f"""WITH {CLASS_COUNTS()}, {FACTORS}, {WEIGHTS}, tl AS (SELECT topic, sqrt(sum(weight * weight)) AS l FROM weights GROUP BY topic),
  dots AS (SELECT a.topic AS ta, b.topic AS tb, sum(a.weight * b.weight) AS d FROM weights a JOIN weights b USING (term) GROUP BY a.topic, b.topic)
  SELECT a.topic AS topic_a, b.topic AS topic_b, round(coalesce(d, 0) / (a.l * b.l), 6) AS similarity FROM tl a CROSS JOIN tl b LEFT JOIN dots ON ta = a.topic AND tb = b.topic""")
def _(spark, folder):
    return display.term_similarity(describe.class_tfidf(_counts(spark, folder))).withColumn("similarity", F.round("similarity", 6))


@query("V5_centre_similarity", f"""WITH {LABELLED}, {CENTRES} SELECT a.topic AS topic_a, b.topic AS topic_b,
  round(list_cosine_similarity(a.centre, b.centre), 6) AS similarity FROM centres a CROSS JOIN centres b""")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    return display.centre_similarity(topics.topic_vectors(v, v)).withColumn("similarity", F.round("similarity", 6))


def _tree(spark, folder):
    """Hierarchy of the classes, outliers apart, with its inputs."""
    counts = store(vectors.term_counts(class_documents(spark, folder).filter("topic <> -1"), "text", ["topic"]), "counts", large=True)
    weights = store(describe.class_tfidf(counts), "weights", large=True)
    return weights, store(display.hierarchy(weights), "merges")


@query("V6_hierarchy")
def _(spark, folder):
    weights, merges = _tree(spark, folder)
    words = describe.top_words(weights)
    named = display.named_hierarchy(merges, display.merge_words(merges, weights), words)
    return named.withColumn("Topics", F.array_join(F.col("Topics").cast("array<string>"), ","))


def _given_merges(spark, folder):
    """A chain of merges in topic order: 0+1, then +2, and so on."""
    topics_in = class_documents(spark, folder).filter("topic <> -1").select("topic").distinct()
    size = topics_in.count()
    steps = topics_in.filter("topic > 0").select(
        (F.lit(size - 1) + F.col("topic")).cast("string").alias("Parent_ID"),
        F.sequence(F.lit(0), "topic").alias("Topics"),
        F.when(F.col("topic") == 1, F.lit(0)).otherwise(F.lit(size - 2) + F.col("topic")).cast("string").alias("Child_Left_ID"),
        F.col("topic").cast("string").alias("Child_Right_ID"),
        F.round(F.col("topic") / 20.0, 6).cast("double").alias("Distance"),
    )
    return store(steps, "merges")


_CHAIN = """tp AS (SELECT DISTINCT topic FROM docs WHERE topic <> -1), k AS (SELECT count(*) AS k FROM tp),
  merges AS (SELECT topic AS t, topic + k - 1 AS parent, topic / 20.0 AS distance FROM tp, k WHERE topic > 0),
  held AS (SELECT parent, distance, tp.topic FROM merges JOIN tp ON tp.topic <= merges.t)"""
_MERGE_WORDS = lambda: f"""{CLASS_DOCUMENTS}, {topic_tokens_sql()},
  counts AS (SELECT topic, term, count(*) AS n FROM grams WHERE topic <> -1 GROUP BY topic, term), {FACTORS}, {_CHAIN},
  summed AS (SELECT parent, term, sum(n) AS n FROM held JOIN counts USING (topic) GROUP BY parent, term),
  ptotal AS (SELECT parent, sum(n) AS total FROM summed GROUP BY parent),
  pranked AS (SELECT parent, term, round(n / total * factor, 9) AS score, row_number() OVER (PARTITION BY parent ORDER BY round(n / total * factor, 9) DESC, term) AS rank
    FROM summed JOIN ptotal USING (parent) JOIN factors USING (term))"""


@query("V7_merge_words", lambda: f"WITH {_MERGE_WORDS()} SELECT CAST(parent AS VARCHAR) AS \"Parent_ID\", CAST(rank AS INT) AS rank, term AS word, score FROM pranked WHERE rank <= 5")
def _(spark, folder):
    counts = store(_counts(spark, folder).filter("topic <> -1"), "counts", large=True)
    return display.merge_words(_given_merges(spark, folder), counts, describe.term_factors(counts), places=9)


@query("V8_topic_levels", f"""WITH {CLASS_DOCUMENTS}, {_CHAIN}, n AS (SELECT count(*) AS n FROM merges), l AS (SELECT unnest(range(1, least(10, (SELECT n FROM n)) + 1)) AS level),
  back AS (SELECT level, n, least(10, n) AS k, least(10, n) - level + 1 AS i FROM l, n),
  pos AS (SELECT level, n + 1 - i * (n // k) - least(i, n % k) AS p FROM back),
  cuts AS (SELECT level, distance AS cut FROM pos JOIN (SELECT distance, row_number() OVER (ORDER BY distance) AS p FROM merges) USING (p)),
  w AS (SELECT topic, level, max(parent) AS parent FROM held JOIN cuts ON distance <= cut GROUP BY topic, level),
  tops AS (SELECT DISTINCT topic FROM docs)
  SELECT tops.topic, CAST(l.level AS INT) AS level, CAST(coalesce(w.parent, tops.topic) AS INT) AS parent FROM tops CROSS JOIN l LEFT JOIN w ON w.topic = tops.topic AND w.level = l.level""")
def _(spark, folder):
    merges = _given_merges(spark, folder)
    return display.topic_levels(class_documents(spark, folder), merges, display.level_cuts(merges))


@query("V9_level_names", lambda: f"""WITH {_TOP()}, l AS (SELECT topic, topic || ' ' || string_agg(substring(word, 1, 20), ', ' ORDER BY rank) AS f FROM words WHERE rank <= 5 AND topic <> -1 GROUP BY topic)
  SELECT topic, substring(f, 1, 60) AS trace_name, substring(f, 1, 60) AS plot_text FROM l
  UNION ALL SELECT topic + 19, substring((topic + 19) || ' ' || ws, 1, 60), substring(array_to_string(list_transform(string_split((topic + 19) || ' ' || ws, ' ')[1:5], lambda w: substring(w, 1, 20)), ', '), 1, 60)
  FROM (SELECT topic, string_agg(word, ', ' ORDER BY rank) AS ws FROM words WHERE rank <= 5 AND topic <> -1 GROUP BY topic)""")
def _(spark, folder):
    words = _words(spark, folder)
    size = words.filter("topic <> -1").select("topic").distinct().count()
    parents = words.filter("topic <> -1").select((F.col("topic") + size).cast("string").alias("Parent_ID"), "rank", "word", "score")
    return display.level_names(words, parents)


@query("V10_tree_lines", f"""WITH {CLASS_DOCUMENTS}, {_CHAIN}, leaves AS (SELECT tp.topic AS node, CASE WHEN tp.topic = 0 THEN k - 1 ELSE k - tp.topic END AS depth FROM tp, k),
  inner_nodes AS (SELECT m.parent AS node, 2 * k - 2 - m.parent AS depth FROM merges m, k)
  SELECT CAST(node AS INT) AS node, CAST(depth AS INT) AS depth FROM leaves UNION ALL SELECT CAST(node AS INT), CAST(depth AS INT) FROM inner_nodes""")
def _(spark, folder):
    return display.tree_lines(_given_merges(spark, folder)).select("node", "depth")


@query("V11_bar_data", lambda: f"""WITH {_TOP()}, freq AS (SELECT topic, count(*) AS c FROM docs WHERE topic <> -1 GROUP BY topic ORDER BY c DESC, topic LIMIT 8)
  SELECT topic, rank, word, score FROM words WHERE rank <= 5 AND topic IN (SELECT topic FROM freq)""")
def _(spark, folder):
    return display.bar_data(describe.topic_frequency(class_documents(spark, folder)), _words(spark, folder))


@query("V12_top_topics", f"WITH {LABELLED} SELECT topic, count(*) AS count FROM emb WHERE topic <> -1 GROUP BY topic ORDER BY count DESC, topic LIMIT 5")
def _(spark, folder):
    return display.top_topics(describe.topic_frequency(labelled_vectors(spark, folder)), 5)


@query("V13_shown_group", f"""WITH {LABELLED} SELECT doc_id, CASE WHEN topic IN (0, 2, 4) THEN CAST(topic AS VARCHAR) ELSE 'other' END AS chosen,
  CASE WHEN topic = -1 THEN 'other' ELSE CAST(topic AS VARCHAR) END AS everything FROM emb""")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    return v.select("doc_id", display.shown_group(F.col("topic"), [0, 2, 4]).alias("chosen"), display.shown_group(F.col("topic"), None).alias("everything"))


@query("V14_trace_names", lambda: f"""WITH {_TOP()} SELECT topic, topic || ' ' || substring(string_agg(word, ', ' ORDER BY rank), 1, 60) AS name
  FROM words WHERE rank <= 3 GROUP BY topic""")
def _(spark, folder):
    return display.trace_names(_words(spark, folder))
