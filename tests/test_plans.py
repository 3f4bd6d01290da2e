"""The chains end to end, on small tables."""

import glob

import pytest
from pyspark.sql import functions as F

from themeloom.functions import text
from themeloom.operators import pii, topics, vectors
from themeloom.plans import clean, extract, refine, views
from themeloom.session import scratch_path, store
from themeloom.sources import models, readers, writers
from themeloom.streaming import stateless


@pytest.fixture(scope="module")
def docs(spark):
    themes = {
        "river": ["river water flows under the old bridge", "the boat follows the river past quiet water", "deep water fills the river valley"],
        "engine": ["engine oil keeps the motor turning", "the motor needs engine parts and oil", "mechanics repair the engine motor"],
        "garden": ["roses bloom in the garden soil", "garden soil feeds green roses and herbs", "plant herbs in garden soil"],
    }
    rows, i = [], 0
    for n in range(12):
        for lines in themes.values():
            rows.append((i, f"{lines[n % 3]} {lines[(n + 1) % 3]} {lines[n % 2]} number {'one two three four'.split()[n % 4]}"))
            i += 1
    return store(spark.createDataFrame(rows, "doc_id long, text string"), "docs")


@pytest.fixture(scope="module")
def model(docs):
    return extract.extract_topics(docs, "text", min_docs=4)


def test_extract_finds_the_themes(model, docs):
    assigned = {r["doc_id"]: r["topic"] for r in model.assignments.collect()}
    assert len(assigned) == 36
    for theme in range(3):
        inside = {t for d, t in assigned.items() if d % 3 == theme} - {-1}
        others = {t for d, t in assigned.items() if d % 3 != theme} - {-1}
        assert inside and not inside & others
    tables = extract.result_tables(model, docs, "text")
    assert tables["document_info"].count() == 36
    assert sum(r["Count"] for r in tables["topic_info"].collect()) == 36
    words = {r["topic"]: r["Representation"] for r in tables["topic_info"].withColumnRenamed("Topic", "topic").collect()}
    assert any("river" in w for w in words.values())


def test_outliers_relabel_and_views(spark, model, docs):
    moved = refine.outliers_into_topics(model, docs, "text")
    assert moved.assignments.filter("topic = -1").count() == 0 and moved.assignments.count() == 36
    generated = refine.relabel(model, docs, "text", "LLM", generate=lambda batch: ["Name: one!\nrest"] * len(batch))
    assert {r["label"] for r in generated.labels.collect()} == {"Name one"}
    view = views.document_view(model, docs, "text", share=0.5)
    assert view["map"].count() == 36 and view["extents"].count() == 1
    tree = views.hierarchy_view(model)
    topics_in = model.assignments.filter("topic <> -1").select("topic").distinct().count()
    assert tree["hierarchy"].count() == topics_in - 1
    assert tree["tree"].count() == 2 * topics_in - 1
    written = writers.write_hierarchy(scratch_path(spark, "h"), tree["hierarchy"], tree["levels"], tree["level_names"], tree["tree"])
    assert spark.read.text(written["tree"]).count() == 2 * topics_in - 1
    saved = models.save_model(scratch_path(spark, "model"), {"assignments": model.assignments, "centres": model.centres})
    loaded = models.load_model(spark, saved, ("centres",))["centres"]
    again = topics.score_documents(model.vectors, loaded)
    assert again.count() == 36


def test_other_representations(model, docs):
    _, terms = extract.text_vectors(docs.withColumn("text", text.topic_text(F.col("text"))), "text", 10)
    points, terms = extract.text_vectors(docs, "text", 10)
    small = extract.describe_topics(docs, "text", model.assignments, points)
    mmr = refine.relabel(small, docs, "text", "MMR", terms)
    assert {r["aspect"] for r in mmr.words.collect()} == {"MMR"}
    near = refine.relabel(small, docs, "text", "KeyBERT", terms)
    assert near.words.filter("rank = 1").count() == near.words.select("topic").distinct().count()


def test_candidates_keep_their_ids(docs):
    points, _ = extract.text_vectors(docs, "text", 10)
    themes = points.select("doc_id", "vector", (F.col("doc_id") % 3).cast("int").alias("topic"))
    candidates = store(topics.topic_vectors(themes, themes), "candidates")
    found = extract.extract_topics(docs, "text", point_vectors=points, candidates=candidates, threshold=0.5)
    assert {(r["doc_id"] % 3) == r["topic"] for r in found.assignments.collect() if r["topic"] in (0, 1, 2)} == {True}


def test_clean_table_runs_all_steps(spark, sf):
    raw = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    kept = clean.clean_table(raw, "text", ["doc_id"], patterns=["[0-9]+"], anonymise=True)
    rows = kept.orderBy("document_index").collect()
    assert [r["document_index"] for r in rows] == list(range(len(rows)))
    assert len({r["text"] for r in rows}) <= len(rows) <= raw.count()
    split = clean.clean_table(raw, "text", ["doc_id"], clean=False, split=True)
    assert split.count() > len(rows)
    assert {"original_index", "document_index", "sentence_pos", "sentence_index", "text"} == set(split.columns)


def test_stream_gives_the_batch_result(spark, sf):
    path = scratch_path(spark, "in")
    raw = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    raw.write.parquet(path)
    stream = spark.readStream.schema(raw.schema).parquet(path)
    out = scratch_path(spark, "out")
    run = (stateless.clean_stream(stream, "text", anonymise=True).writeStream.format("parquet").trigger(availableNow=True)
           .option("checkpointLocation", scratch_path(spark, "state")).start(out))
    run.awaitTermination(120)
    batch = stateless.clean_stream(raw, "text", anonymise=True)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))


def test_stream_drops_copies(spark):
    path = scratch_path(spark, "in")
    rows = [("same text", 0), ("same text", 5), ("other", 7)]
    raw = spark.createDataFrame(rows, "text string, s int").select("text", F.timestamp_seconds("s").alias("at"))
    raw.write.parquet(path)
    stream = spark.readStream.schema(raw.schema).parquet(path)
    out = scratch_path(spark, "out")
    run = (stateless.drop_copies(stream, "text", "at").writeStream.format("parquet").trigger(availableNow=True)
           .option("checkpointLocation", scratch_path(spark, "state")).start(out))
    run.awaitTermination(120)
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["other", "same text"]


def test_stored_vectors_and_hooks(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    stored = spark.createDataFrame([(1, [1.0], "tfidf"), (2, [2.0], "large")], "doc_id long, vector array<double>, kind string")
    made = vectors.reuse_vectors(docs, stored, "tfidf", lambda d: d.select("doc_id", F.array(F.lit(9.0)).alias("vector")))
    assert {r["doc_id"]: r["vector"][0] for r in made.collect()} == {1: 1.0, 2: 9.0, 3: 9.0}


def test_readers_and_writers(spark):
    df = spark.createDataFrame([(1, 'a "q", b\nline two '), (2, None)], "id int, text string")
    plain = writers.write_table(df, scratch_path(spark, "csv"), "csv")
    zipped = writers.write_table(df, scratch_path(spark, "csv"), "csv", compression="gzip")
    for path in (plain, zipped):
        assert sorted(map(tuple, readers.read_csv(spark, path).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert glob.glob(zipped.replace("file:", "") + "/*.gz")
    patterns = scratch_path(spark, "patterns")
    spark.createDataFrame([("b+",), ("a,c",), ("[0-9]",)], "p string").coalesce(1).write.csv(patterns)
    assert readers.pattern_list(readers.read_patterns(spark, patterns)) == ["b+", "a,c", "[0-9]"]
    with pytest.raises(ValueError):
        writers.write_table(df, scratch_path(spark, "x"), "xml")


def test_same_pseudonym_everywhere(spark):
    df = spark.createDataFrame([(1, "Anna met Bert."), (2, "Bert and Anna; Annabel stays.")], "doc_id long, text string")
    names = spark.createDataFrame([("Anna", "PERSON"), ("Bert", "PERSON")], "name string, entity string")
    mapping = pii.pseudonyms(pii.name_spans(df, "text", names), df, "text")
    fake = {r["name"]: r["fake"] for r in mapping.collect()}
    got = {r["doc_id"]: r["text"] for r in pii.replace_names(df, "text", mapping).collect()}
    assert got == {1: f"{fake['Anna']} met {fake['Bert']}.", 2: f"{fake['Bert']} and {fake['Anna']}; Annabel stays."}
