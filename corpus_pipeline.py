"""Documents to training sequences: toxic texts out, one of each near-duplicate group, secrets masked, packed.

Each stage takes (spark, docs, folder) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``; columns beyond these go through unchanged.
A null or empty text is no reason to leave a document out.  An empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.llm import ngram_join, packing, secret_scan, toxicity
from themeloom.llm.batches import table
from themeloom.session import store

TOXIC = 0.5
SHINGLE_WORDS = 5
SIMILARITY = Fraction(8, 10)


def _with_rest(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and a struct of all columns but the text, so that no further column clashes with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest"), "doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose score is below ``TOXIC``; held-out rows are not learned from."""
    labels = table(spark, folder, "labels").select("doc_id", "toxic").filter(~toxicity.held_out())
    weights = toxicity.train(docs, labels)
    kept = toxicity.score(_with_rest(docs), weights, keep=("_rest", "text")).filter(F.col("score") < TOXIC)
    return kept.select(*[F.col("text") if c == "text" else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of documents linked by near-equal word sets, one: that with the smallest id.

    Documents without a word are kept, and so are rows without an id.  Of rows with equal id and text one is kept.  An id
    with several texts is several documents: one goes by the id, the others by a negative number made of id and text, so
    no text is lost unless a near copy of it stays.
    """
    digest = F.xxhash64("text")
    texts = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(digest).alias("_first"), F.max(digest).alias("_last"), F.count("*").alias("_rows"))
    again = store(texts.filter("_rows > 1"), "again")
    if again.isEmpty():
        copies = _copies(docs.select("doc_id", "text"))
        return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).withColumn("doc_id", F.col("_row.doc_id"))
    other = F.xxhash64("doc_id", "_row.text").bitwiseOR(F.lit(-1 << 63))
    keyed = row.join(again, "doc_id", "left").select(
        "_row", F.when(F.xxhash64("_row.text") != F.col("_first"), other).otherwise(F.col("doc_id")).alias("doc_id"))
    keyed = store(keyed, "keyed")
    kept = keyed.join(_copies(keyed.select("doc_id", F.col("_row.text").alias("text"))), "doc_id", "left_anti")
    repeated = kept.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1 AND doc_id IS NOT NULL").select("doc_id")
    repeated = store(repeated, "repeated")
    first = kept.join(repeated, "doc_id").groupBy("doc_id").agg(F.min("_row").alias("_row"))
    one = kept.join(repeated, "doc_id", "left_anti").select("_row").unionByName(first.select("_row"))
    return one.select("_row.*").select(*docs.columns)


def _copies(texts: DataFrame) -> DataFrame:
    found = ngram_join.jaccard_components(texts, SHINGLE_WORDS, SIMILARITY)
    return found.filter("doc_id <> component_id").select("doc_id").distinct()


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every secret replaced by a mark; ``n_chars`` follows the text."""
    found = secret_scan.scan(_with_rest(docs), keep=("_rest", "text"))
    clean = found.select("_rest", secret_scan.masked(F.col("text"), F.col("spans")).alias("text"), (F.size("spans") > 0).alias("changed"))
    columns = {c: F.col("_rest").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("changed"), F.length("text").cast("bigint")).otherwise(columns["n_chars"])
    return clean.select(*[columns[c].alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of token sequences, as ``packing.pack`` returns them."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("secret_scans", mask_secrets),
    ("packing", pack_sequences),
]

#: No SQL: the first stage learns a classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
