"""The corpus pipeline: what each stage keeps and changes."""

import corpus_pipeline
import numpy as np

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark, sf):
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(1, None), (2, ""), (3, long), (4, long + " more"), (None, long), (5, "token=abcdefgh12 here"), (5, "token=abcdefgh12 here"), (6, "clean")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], SHAPE)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, sf)
    assert kept.count() == len(rows) and kept.columns == docs.columns
    one = stages["ngram_jaccard_join"](spark, kept, sf)
    assert one.columns == docs.columns
    assert sorted((r.doc_id for r in one.collect()), key=repr) == sorted([1, 2, 3, None, 5, 6], key=repr)
    clean = {r.doc_id: r for r in stages["secret_scans"](spark, one, sf).collect()}
    assert clean[5].text == "[secret] here" and clean[5].n_chars == 13 and clean[1].text is None and clean[6].text == "clean"
    assert stages["packing"](spark, one, sf).count() >= 6
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    pieces = corpus_pipeline.run(spark, sf).collect()
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    kept = {p.doc_id for p in pieces}
    assert kept <= {d.doc_id for d in docs} and len(kept) > 0.8 * len({d.text for d in docs}) - len(toxic)
    texts = {d.doc_id: d.text for d in docs}
    assert len({texts[i] for i in kept}) == len(kept)
    tokens = {}
    for p in pieces:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + len(np.frombuffer(p.ids, "<u4"))
    assert all(tokens[p.doc_id] == p.doc_tokens for p in pieces)


def test_no_text_is_lost_where_ids_repeat(spark, sf):
    """Plain version: texts joined by links of 5-word sets; of each group one text stays, in one row."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [list(rng.choice(vocabulary, 60)) for _ in range(6)]
    texts = [" ".join(t) for t in base] + [" ".join(base[0] + ["more"]), " ".join(["start"] + base[1]), "", None, "few words"]
    ids = [0, 1, 2, 1, 2, 5, 1, 7, 8, 9, 1]
    rows = [(i, t, "_row", 1, "a") for i, t in zip(ids, texts)] + [(2, texts[2], "_row", 2, "b"), (None, texts[0], "x", 3, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, again int, _rest string")
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, sf)
    assert kept.columns == docs.columns
    out = [(r.doc_id, r.text) for r in kept.collect()]

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    assert sum(i is None for i, _ in out) == 1
    stay = [(i, t) for i, t in out if i is not None]
    assert set(stay) <= set(zip(ids, texts)) and len(set(stay)) == len(stay)
    groups = []
    for text in {t for t in texts if t}:
        near = [g for g in groups if any(len(shingles(text) & shingles(o)) >= 0.8 * len(shingles(text) | shingles(o)) for o in g)]
        groups = [g for g in groups if g not in near] + [set().union({text}, *near)]
    assert [sum(t in g for _, t in stay) for g in groups] == [1] * len(groups)
    assert (8, "") in stay and (9, None) in stay
