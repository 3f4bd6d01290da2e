"""Changing a fitted model: outliers into topics, other labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from themeloom.operators import describe, topics
from themeloom.plans.extract import TopicModel, describe_topics
from themeloom.session import store


def outliers_into_topics(model: TopicModel, df: DataFrame, column: str, **describing) -> TopicModel:
    """Reassign outliers by vector, then recompute words, labels and documents."""
    moved = store(topics.reduce_outliers(model.vectors, model.assignments), "groups")
    assignments = store(topics.assignment_probability(model.vectors, moved, model.centres), "assignments")
    return replace(describe_topics(df, column, assignments, model.vectors, **describing), space=model.space)


def relabel(model: TopicModel, df: DataFrame, column: str, aspect: str, term_vectors: DataFrame | None = None,
            generate: Callable[[list[str]], Sequence[str]] | None = None) -> TopicModel:
    """Labels from another representation: MMR, KeyBERT, or generated text."""
    if aspect == "LLM":
        if generate is None:
            raise ValueError("give the text generator")
        prompts = describe.label_prompts(model.words, model.representatives, df, column)
        return replace(model, labels=store(describe.generated_labels(prompts, generate), "labels"))
    if aspect == "MMR":
        wide = describe.top_words(model.weights, 30)
        centres = topics.topic_vectors(model.vectors, model.assignments, outliers=True)
        words = describe.diverse_words(wide, term_vectors, centres)
    elif aspect == "KeyBERT":
        wide = describe.top_words(model.weights, 30)
        words = describe.keyword_similarity(wide, term_vectors, model.vectors, model.representatives)
    elif aspect == "Default":
        words = model.words
    else:
        raise ValueError(f"unknown representation: {aspect}")
    words = store(words, "words")
    return replace(model, words=words, labels=store(describe.default_labels(words), "labels"))
