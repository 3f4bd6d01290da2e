"""Term counts, TF-IDF and stored vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, functions as F

from themeloom import params
from themeloom.functions import arrays, text
from themeloom.operators.skew import join_counted
from themeloom.session import store


def english_stop_words() -> list[str]:
    """Spark's own English list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def token_rows(df: DataFrame, column: str, doc: str = "doc_id") -> DataFrame:
    """(doc, term, tf).  The map side combines each document's repeats first."""
    return (
        df.select(doc, F.explode(text.tokens(F.col(column))).alias("term"))
        .groupBy(doc, "term")
        .agg(F.count("*").alias("tf"))
    )


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(counts: DataFrame, doc: str = "doc_id", documents: int | None = None) -> DataFrame:
    """(doc, term, weight) with the smooth idf ``ln((1+n)/(1+df)) + 1``.

    ``documents`` is the number of documents when some have no term at all.
    """
    n = F.lit(documents) if documents is not None else None
    if n is None:
        total = counts.agg(F.count_distinct(doc).alias("n")).first()["n"]
        n = F.lit(total)
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1
    frequency = store(document_frequency(counts), "frequency")
    return join_counted(counts, frequency, ["term"], "df").select(doc, "term", (F.col("tf") * idf).alias("weight"))


def l2_rows(weights: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each document's weights scaled to length one."""
    lengths = weights.groupBy(doc).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_length"))
    return weights.join(lengths, doc).select(doc, "term", (F.col("weight") / F.col("_length")).alias("weight"))


def topic_tokens(column: str, stop_words: Sequence[str] | None = None) -> Column:
    """Tokens topic words are counted on, stop words taken out."""
    stop = english_stop_words() if stop_words is None else list(stop_words)
    words = text.tokens(text.topic_text(F.col(column)))
    return F.filter(words, lambda w: ~w.isin(stop))


def term_counts(
    df: DataFrame,
    column: str,
    group: Sequence[str],
    stop_words: Sequence[str] | None = None,
    ngrams: tuple[int, int] = params.NGRAMS,
) -> DataFrame:
    """(group..., term, n) over words and word pairs; no pair spans two rows."""
    return term_rows(df, column, group, stop_words, ngrams).groupBy(*group, "term").agg(F.count("*").alias("n"))


def term_rows(
    df: DataFrame,
    column: str,
    group: Sequence[str],
    stop_words: Sequence[str] | None = None,
    ngrams: tuple[int, int] = params.NGRAMS,
) -> DataFrame:
    """(group..., term): a row for each place of a word or word pair."""
    terms = text.ngrams(topic_tokens(column, stop_words), ngrams)
    return df.select(*group, F.explode(terms).alias("term"))


def _by_rows(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows that are a group by themselves, and the others if there are any."""
    again = store(df.groupBy(*group).agg(F.count("*").alias("_rows")).filter("_rows > 1").select(*[F.col(g).alias(f"_{g}") for g in group]), "again")
    if again.isEmpty():
        return df, None
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def document_terms(
    df: DataFrame,
    column: str,
    group: Sequence[str],
    stop_words: Sequence[str] | None = None,
    ngrams: tuple[int, int] = params.NGRAMS,
) -> DataFrame:
    """(group..., term, n): the rows of ``term_counts`` for groups most of which are one row.

    Such a group is counted where its row is, so nothing is dealt by group but the rows of the other groups.
    """
    single, shared = _by_rows(df, group)
    found = single.select(*group, F.inline(text.counted(text.ngrams(topic_tokens(column, stop_words), ngrams))))
    return found if shared is None else found.unionAll(term_counts(shared, column, group, stop_words, ngrams))


def document_spread(
    df: DataFrame,
    column: str,
    group: Sequence[str],
    stop_words: Sequence[str] | None = None,
    ngrams: tuple[int, int] = params.NGRAMS,
) -> DataFrame:
    """(term, _spread): the number of groups, most of which are one row, with the term.

    A group of one row has its distinct terms in that row, so only the terms of other groups are dealt by group.
    """
    single, shared = _by_rows(df, group)
    terms = text.ngrams(topic_tokens(column, stop_words), ngrams)
    found = single.select(F.explode(F.array_distinct(terms)).alias("term"))
    if shared is not None:
        found = found.unionAll(term_rows(shared, column, group, stop_words, ngrams).distinct().select("term"))
    return found.groupBy("term").agg(F.count("*").alias("_spread"))


def share_limits(
    counts: DataFrame,
    unit: str,
    min_share: float = params.MIN_TERM_SHARE,
    max_share: float = params.MAX_TERM_SHARE,
    units: int | None = None,
) -> DataFrame:
    """Terms found in at least ``min_share`` and at most ``max_share`` of the units
    (topics or documents, by the column ``unit``); ``counts`` has one row per
    unit and term."""
    if units is None:
        units = counts.agg(F.count_distinct(unit).alias("n")).first()["n"]
    return within_share(counts.groupBy("term").agg(F.count("*").alias("_spread")), units, min_share, max_share)


def within_share(spread: DataFrame, units: int, min_share: float, max_share: float) -> DataFrame:
    """(term) of the (term, _spread) rows within the limits."""
    return spread.filter(
        (F.col("_spread") >= min_share * units) & (F.col("_spread") <= max_share * units)
    ).select("term")


def limited_term_counts(
    df: DataFrame,
    column: str,
    topic: str = "topic",
    doc: str = "doc_id",
    df_scope: str = "topic",
    min_share: float = params.MIN_TERM_SHARE,
    max_share: float = params.MAX_TERM_SHARE,
    stop_words: Sequence[str] | None = None,
    ngrams: tuple[int, int] = params.NGRAMS,
) -> DataFrame:
    """(topic, term, n), keeping terms within the document-share limits.

    ``df_scope='topic'`` counts shares over topics, ``'document'`` over rows.
    """
    if df_scope == "topic":
        counts = term_counts(df, column, [topic], stop_words, ngrams)
        kept = share_limits(counts, topic, min_share, max_share, df.select(topic).distinct().count())
        return counts.join(kept, "term", "left_semi").select(topic, "term", "n")
    if df_scope != "document":
        raise ValueError("df_scope is 'topic' or 'document'")
    spread = document_spread(df, column, [topic, doc], stop_words, ngrams)
    kept = store(within_share(spread, df.select(doc).distinct().count(), min_share, max_share), "kept")
    rows = term_rows(df, column, [topic], stop_words, ngrams).join(kept, "term", "left_semi")
    return rows.groupBy(topic, "term").agg(F.count("*").alias("n"))


def model_vectors(
    df: DataFrame,
    column: str,
    encode: Callable[[list[str]], Sequence[Sequence[float]]],
    doc: str = "doc_id",
    batch: int = 32,
) -> DataFrame:
    """Vectors from a caller's encoder, called on batches inside the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                vectors = [list(map(float, v)) for v in encode(part[column].tolist())]
                yield pd.DataFrame({doc: part[doc].to_numpy(), "vector": vectors})

    kind = dict(df.dtypes)[doc]
    return df.select(doc, column).mapInPandas(run, f"{doc} {kind}, vector array<float>")


def reuse_vectors(
    docs: DataFrame, stored: DataFrame, kind: str, embed: Callable[[DataFrame], DataFrame], doc: str = "doc_id"
) -> DataFrame:
    """Stored vectors of the same kind, plus new ones for documents without any."""
    usable = stored.filter(F.col("kind") == kind).select(doc, "vector")
    known = usable.join(docs.select(doc), doc, "left_semi")
    missing = docs.join(usable.select(doc), doc, "left_anti")
    return known.unionByName(embed(missing).select(doc, "vector")).withColumn("kind", F.lit(kind))


def compressed(df: DataFrame, vector: str = "vector", scale: float = 100.0) -> DataFrame:
    """Rounded vectors with their scale kept as a column."""
    return df.withColumn(vector, arrays.compress(F.col(vector), 3, scale)).withColumn("scale", F.lit(scale))
