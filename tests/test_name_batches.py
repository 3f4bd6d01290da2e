"""Capitalised words come in batches bounded by the text they are from."""

import pyarrow as pa

from themeloom.operators import pii


def test_words_of_a_large_batch_are_not_held_together(spark):
    texts = ["Anna met bob. Élan é", None, "", "none here", "Anna Anna"] * 200
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(texts)], names=["doc_id", "text"])
    found = list(pii.capital_batches(iter([batch]), ["doc_id", "word", "start", "end"], 100))
    assert max(b.num_rows for b in found) <= 20 and len(found) > 50
    rows = [tuple(r.values()) for b in found for r in b.to_pylist()]
    expected = []
    for i, t in enumerate(texts):
        expected += {0: [(i, "Anna", 0, 4), (i, "Élan", 14, 18)], 4: [(i, "Anna", 0, 4), (i, "Anna", 5, 9)]}.get(i % 5, [])
    assert rows == expected
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = spark.createDataFrame([("Anna", "PERSON")], "name string, entity string")
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in pii.name_spans(docs, "text", names).collect()}
    assert len(spans) == 400 and spans[0] == [(0, 4)] and spans[4] == [(0, 4), (5, 9)]
