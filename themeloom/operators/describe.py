"""Describing topics: weighted words, labels, representative documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from themeloom import params
from themeloom.functions import arrays, text
from themeloom.operators.rows import as_label_text
from themeloom.operators.skew import ROW_BYTES, joined_parts


def joined_text_sizes(docs: DataFrame, column: str, topic: str = "topic") -> DataFrame:
    """(topic, documents, characters, words) of each topic's texts joined by a
    space, without building the joined text."""
    return docs.groupBy(topic).agg(
        F.count("*").alias("documents"),
        (F.sum(F.length(column)) + F.count("*") - 1).alias("characters"),
        F.sum(F.size(text.white_space_tokens(F.col(column)))).alias("words"),
    )


def mean_words(counts: DataFrame, topic: str = "topic") -> int:
    """Whole part of the mean number of words per topic."""
    return counts.groupBy(topic).agg(F.sum("n").alias("w")).agg(F.floor(F.avg("w")).alias("a")).first()["a"]


def _factor(mean: int, count: Column) -> Column:
    """``ln(1 + A / f)``: A words per topic on average, f uses over all topics."""
    return F.log(1 + F.lit(mean) / count)


def term_factors(counts: DataFrame, topic: str = "topic") -> DataFrame:
    """(term, factor) over all topics."""
    return counts.groupBy("term").agg(_factor(mean_words(counts, topic), F.sum("n")).alias("factor"))


def class_tfidf(counts: DataFrame, topic: str = "topic", factors: DataFrame | None = None) -> DataFrame:
    """(topic, term, n, weight, factor): term share within the topic times its factor.

    Without given ``factors`` they come from a sum over each term's topics, which
    needs one shuffle and no join.
    """
    totals = counts.groupBy(topic).agg(F.sum("n").alias("_total"))
    if factors is None:
        uses = F.sum("n").over(Window.partitionBy("term"))
        known = counts.withColumn("factor", _factor(mean_words(counts, topic), uses))
    else:
        known = counts.join(factors, "term")
    if totals.count() * ROW_BYTES <= params.SHIP_BYTES:  # else all counts would be dealt by topic
        totals = F.broadcast(totals)
    return known.join(totals, topic).select(
        topic, "term", "n", (F.col("n") / F.col("_total") * F.col("factor")).alias("weight"), "factor"
    )


def top_words(weights: DataFrame, n: int = params.WORDS_PER_TOPIC, topic: str = "topic", aspect: str = "Default",
              places: int | None = None) -> DataFrame:
    """(topic, aspect, rank, word, score): the ``n`` best terms of each topic."""
    score = F.col("weight") if places is None else F.round("weight", places)
    ranked = weights.select(topic, F.col("term").alias("word"), score.alias("score"))
    order = Window.partitionBy(topic).orderBy(F.desc("score"), "word")
    return (
        ranked.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select(topic, F.lit(aspect).alias("aspect"), "rank", "word", "score")
    )


def topic_frequency(assignments: DataFrame, topic: str = "topic") -> DataFrame:
    return assignments.groupBy(topic).agg(F.count("*").alias("count"))


def word_list(words: DataFrame, n: int, separator: str = params.LABEL_SEPARATOR, topic: str = "topic",
              word: Column | None = None) -> DataFrame:
    """(topic, words): the first ``n`` words in rank order, joined."""
    word = F.col("word") if word is None else word
    ordered = F.sort_array(F.collect_list(F.struct("rank", word.alias("word"))))
    return words.filter(F.col("rank") <= n).groupBy(topic).agg(
        F.array_join(F.transform(ordered, lambda s: s["word"]), separator).alias("words")
    )


def default_labels(words: DataFrame, n: int = params.LABEL_WORDS, separator: str = params.LABEL_SEPARATOR,
                   topic: str = "topic") -> DataFrame:
    """(topic, label): the topic id and its first words."""
    listed = word_list(words, n, separator, topic)
    return listed.select(topic, F.concat_ws(separator, F.col(topic).cast("string"), "words").alias("label"))


def given_labels(labels: DataFrame, given: DataFrame) -> DataFrame:
    """Caller labels (topic, label) in place of the current ones.

    There must be one for each topic, as labels are matched by topic.
    """
    if given.count() != labels.count():
        raise ValueError("give one label per topic")
    return labels.join(given.select("topic", F.col("label").alias("_given")), "topic", "left").select(
        "topic", F.coalesce("_given", "label").alias("label")
    )


def zero_shot_labels(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate text (topic, candidate) where the topic came from one."""
    return labels.join(candidates.select("topic", "candidate"), "topic", "left").select(
        "topic", F.coalesce("candidate", "label").alias("label")
    )


def aspect_labels(words: DataFrame, aspect: str, parts: int = 4, separator: str = "_", topic: str = "topic") -> DataFrame:
    """(topic, label) from another representation: id and words, ``parts`` in all,
    cut when 30 characters or longer."""
    listed = word_list(words.filter(F.col("aspect") == aspect), parts - 1, separator, topic)
    label = F.concat_ws(separator, F.col(topic).cast("string"), "words")
    return listed.select(topic, text.short_label(label).alias("label"))


def document_terms_similarity(doc_counts: DataFrame, weights: DataFrame, distinct: bool = False) -> DataFrame:
    """(topic, doc_id, similarity) of each document with its own topic, both as
    weighted terms.  ``weights`` is a stored result of ``class_tfidf``; its ``n``
    tells which terms of a topic are in many documents.

    Rows of ``doc_counts`` with equal topic, document and term add up.  They are
    added after the join, where they are together already, so the counts of
    documents need no shuffle and no table of their own.  With ``distinct`` there
    are no such rows (``vectors.document_terms``).  Then the most frequent terms
    are sent to the tasks, which add up a document's part of these on the spot.
    """
    lengths = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_topic_length"))
    known = weights.select("topic", "term", "weight", "factor", F.col("n").alias("_uses"))
    own = F.col("n") * F.col("factor")
    parts = []
    for part in joined_parts(doc_counts, known, ["topic", "term"], "_uses", params.SHIP_BYTES if distinct else 0):
        if not distinct:
            part = part.groupBy("topic", "term", "doc_id").agg(F.sum("n").alias("n"), F.first("weight").alias("weight"), F.first("factor").alias("factor"))
        parts.append(part.groupBy("topic", "doc_id").agg(F.sum(own * F.col("weight")).alias("_dot"), F.sum(own * own).alias("_square")))
    sums = reduce(DataFrame.unionByName, parts).groupBy("topic", "doc_id").agg(
        F.sum("_dot").alias("_dot"), F.sqrt(F.sum("_square")).alias("_length"))
    return sums.join(lengths, "topic").select(
        "topic", "doc_id",
        F.coalesce(F.try_divide("_dot", F.col("_length") * F.col("_topic_length")), F.lit(0.0)).alias("similarity"),
    )


def representative_documents(similarity: DataFrame, n: int = params.REPRESENTATIVE_DOCS, places: int = 9) -> DataFrame:
    """(topic, doc_id, rank): the ``n`` documents closest to their topic."""
    order = Window.partitionBy("topic").orderBy(F.desc("_near"), "doc_id")
    return (
        similarity.withColumn("_near", F.round("similarity", places))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("topic", "doc_id", "rank")
    )


def topic_info(frequency: DataFrame, labels: DataFrame, words: DataFrame, representatives: DataFrame,
               docs: DataFrame, column: str, custom: DataFrame | None = None) -> DataFrame:
    """Topic, Count, Name, CustomName, Representation, Representative_Docs."""
    listed = words.groupBy("topic").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("Representation")
    )
    texts = (
        representatives.join(docs.select("doc_id", column), "doc_id")
        .groupBy("topic")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(column).alias("t")))), lambda s: s["t"])
             .alias("Representative_Docs"))
    )
    custom = labels if custom is None else custom
    return (
        frequency.join(labels.select("topic", F.col("label").alias("Name")), "topic", "left")
        .join(custom.select("topic", F.col("label").alias("CustomName")), "topic", "left")
        .join(listed, "topic", "left")
        .join(texts, "topic", "left")
        .select(F.col("topic").alias("Topic"), F.col("count").alias("Count"), "Name", "CustomName",
                "Representation", "Representative_Docs")
    )


def document_info(docs: DataFrame, column: str, assignments: DataFrame, labels: DataFrame,
                  representatives: DataFrame) -> DataFrame:
    """doc_id, Document, Topic, Name, Probability, Representative_document."""
    flagged = representatives.select("doc_id", F.lit(True).alias("_flag"))
    found = (  # without the texts, which then go through one shuffle only
        assignments.select("doc_id", "topic", "probability")
        .join(labels.select("topic", F.col("label").alias("Name")), "topic", "left")
        .join(flagged, "doc_id", "left")
    )
    return docs.select("doc_id", F.col(column).alias("Document")).join(found, "doc_id").select(
        "doc_id", "Document", F.col("topic").alias("Topic"), "Name", F.col("probability").alias("Probability"),
        F.coalesce("_flag", F.lit(False)).alias("Representative_document"))


def with_probabilities(info: DataFrame, probabilities: DataFrame) -> DataFrame:
    """Document info with each topic's probability, one row per document and topic."""
    full = probabilities.select("doc_id", F.col("topic").alias("other_topic"), F.col("probability").alias("topic_probability"))
    return info.join(full, "doc_id", "left")


def with_parent(info: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentence results with the document they came from and their position."""
    parents = sentences.select(
        F.col("sentence_index").alias(key), F.col("document_index").alias("parent_document_index"), "sentence_pos"
    )
    return info.join(parents, key, "left")


def parent_info(info: DataFrame, position: str = "sentence_pos") -> DataFrame:
    """One row per parent: texts joined in order, and lists of topic numbers,
    names and probabilities without outliers.

    A parent row is as long as the document its sentences were split from.
    """
    part = F.struct(position, "Document", "Topic", "Name", "Probability")
    parents = info.groupBy("parent_document_index").agg(F.sort_array(F.collect_list(part)).alias("p"))
    inside = F.filter("p", lambda s: s["Topic"] != params.OUTLIER)
    return parents.select(
        "parent_document_index",
        F.array_join(F.col("p.Document"), " ").alias("Document"),
        F.transform(inside, lambda s: s["Topic"]).alias("Topic numbers"),
        F.transform(inside, lambda s: s["Name"]).alias("Topic names"),
        F.transform(inside, lambda s: s["Probability"]).alias("Probabilities"),
    )


def phrase_vectors(words: DataFrame, term_vectors: DataFrame) -> DataFrame:
    """(word, vector) of the distinct ``words``: the mean of the vectors of a phrase's words; none without a known word."""
    parts = words.select("word").distinct().select("word", F.explode(F.split("word", " ")).alias("term"))
    means = (
        parts.join(term_vectors.select("term", "vector"), "term")
        .select("word", F.posexplode("vector").alias("pos", "x"))
        .groupBy("word", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    )
    return means.groupBy("word").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("vector")
    )


def diverse_words(words: DataFrame, term_vectors: DataFrame, centres: DataFrame, n: int = params.WORDS_PER_TOPIC,
                  diversity: float = params.MMR_DIVERSITY, considered: int = params.MMR_CANDIDATES) -> DataFrame:
    """Topic words picked for closeness to the topic and distance to each other.

    The ``considered`` best words of each topic are candidates, so
    each group is small; the pick is a small numpy loop per topic.  A word or
    topic without a vector counts as a zero vector.
    """
    best = words.filter(F.col("rank") <= considered)
    candidates = (
        best.join(phrase_vectors(best, term_vectors), "word", "left")
        .join(centres.select("topic", F.col("vector").alias("centre")), "topic", "left")
    )

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        known = [x for x in [*pdf["vector"], pdf["centre"].iloc[0]] if x is not None]
        zero = np.zeros(len(known[0]) if known else 1)
        v = np.stack([zero if x is None else x for x in pdf["vector"]]).astype(float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        c = np.asarray(zero if pdf["centre"].iloc[0] is None else pdf["centre"].iloc[0], dtype=float)
        to_topic = v @ (c / max(np.linalg.norm(c), 1e-12))
        to_each = v @ v.T
        taken = [int(np.argmax(to_topic))]
        while len(taken) < min(n, len(pdf)):
            value = (1 - diversity) * to_topic - diversity * to_each[:, taken].max(axis=1)
            value[taken] = -np.inf
            taken.append(int(np.argmax(value)))
        out = pdf.iloc[taken]
        return pd.DataFrame({"topic": out["topic"], "aspect": "MMR", "rank": range(1, len(out) + 1),
                             "word": out["word"], "score": to_topic[taken]})

    return candidates.groupBy("topic").applyInPandas(
        pick, "topic int, aspect string, rank int, word string, score double"
    )


def keyword_similarity(words: DataFrame, term_vectors: DataFrame, vectors: DataFrame, representatives: DataFrame,
                       n: int = params.WORDS_PER_TOPIC) -> DataFrame:
    """Topic words ranked by the cosine of their vector with the mean vector of
    the topic's representative documents; 0 without a vector."""
    from themeloom.operators.topics import topic_vectors

    centres = topic_vectors(vectors, representatives.select("doc_id", "topic"), outliers=True)
    near = arrays.cosine(F.col("vector"), F.col("centre"))
    scored = (
        words.join(phrase_vectors(words, term_vectors), "word", "left")
        .join(centres.select("topic", F.col("vector").alias("centre")), "topic", "left")
        .select("topic", F.col("word").alias("term"), F.coalesce(near, F.lit(0.0)).alias("weight"))
    )
    return top_words(scored, n, aspect="KeyBERT")


# The wording of the label prompts, and the tags of each chat format.
EXAMPLE_DOCUMENTS = (
    "Traditional diets in most cultures were primarily plant-based with a little meat on top, but with the rise of "
    "industrial style meat production and factory farming, meat has become a staple food.",
    "Meat, but especially beef, is the word food in terms of emissions.",
    "Eating meat doesn't make you a bad person, not eating meat doesn't make you a good one.",
)
EXAMPLE_KEYWORDS = "meat, beef, eat, eating, emissions, steak, food, health, processed, chicken"
EXAMPLE_LABEL = "Environmental impacts of eating meat"
PROMPT_INTRO = "I have a topic that contains the following documents:"
PROMPT_KEYWORDS = "The topic is described by the following keywords: '{}'."
PROMPT_NEXT = "Now, create a new topic label given the following information."
PROMPT_TASK = "Based on the information about the topic above, please create a short label of this topic."
ONLY_LABEL = " Return only the label and no other text or explanation."
ONLY_LABEL_STRICT = " Make sure you to only return the label and nothing more."
CHAT_FORMATS = {
    "phi3": ("<|user|>\n", ONLY_LABEL, "<|end|>\n<|assistant|>\nTopic label:"),
    "stablelm": ("<|user|>\n", ONLY_LABEL_STRICT, "<|endoftext|>\n<|assistant|>\nTopic label:"),
    "hermes": (
        "<|im_start|>system\nYou are a helpful, respectful and honest assistant for labeling topics.<|im_end|>\n"
        "<|im_start|>user\n",
        ONLY_LABEL_STRICT,
        "<|im_end|>\n<|im_start|>assistant\nTopic label:\n",
    ),
    "plain": ("USER:", ONLY_LABEL_STRICT, "\nASSISTANT:Topic label:"),
}


def prompt_template(chat: str = "phi3") -> str:
    """A worked example followed by the tags ``[DOCUMENTS]`` and ``[KEYWORDS]``."""
    start, ask, end = CHAT_FORMATS[chat]
    documents = "\n".join(f"- {d}" for d in EXAMPLE_DOCUMENTS)
    example = (
        f"{start}{PROMPT_INTRO}\n{documents}\n\n{PROMPT_KEYWORDS.format(EXAMPLE_KEYWORDS)}\n\n"
        f"{PROMPT_TASK}{ONLY_LABEL}\n\nTopic label: {EXAMPLE_LABEL}\n"
    )
    question = (
        f"\n{PROMPT_NEXT}\n\n{PROMPT_INTRO}\n[DOCUMENTS]\n\n{PROMPT_KEYWORDS.format('[KEYWORDS]')}\n\n"
        f"{PROMPT_TASK}{ask}{end}"
    )
    return example + question


def label_prompts(words: DataFrame, representatives: DataFrame, docs: DataFrame, column: str, chat: str = "phi3",
                  n: int = params.WORDS_PER_TOPIC) -> DataFrame:
    """(topic, prompt) from each topic's words and representative documents."""
    lines = (
        representatives.join(docs.select("doc_id", column), "doc_id")
        .groupBy("topic")
        .agg(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("- "), column, F.lit("\n")).alias("t")))).alias("d"))
        .select("topic", F.array_join(F.col("d.t"), "").alias("documents"))
    )
    listed = word_list(words, n)
    filled = F.replace(F.lit(prompt_template(chat)), F.lit("[KEYWORDS]"), F.col("words"))
    return lines.join(listed, "topic").select(
        "topic", F.replace(filled, F.lit("[DOCUMENTS]"), F.col("documents")).alias("prompt")
    )


def generated_labels(prompts: DataFrame, generate: Callable[[list[str]], Sequence[str]]) -> DataFrame:
    """(topic, label): the caller's text generator run on the prompts inside the
    tasks; its first line, cleaned, is the label."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"topic": pdf["topic"], "raw": list(generate(pdf["prompt"].tolist()))})

    raw = prompts.select("topic", "prompt").mapInPandas(run, "topic int, raw string")
    return raw.select("topic", text.clean_generated_label(text.first_line(F.col("raw"))).alias("label"))


def label_column(c: Column) -> Column:
    """Values shown beside documents: null as empty text."""
    return as_label_text(c)
