"""Tables behind the topic views of a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from themeloom import params
from themeloom.operators import describe, display, linalg
from themeloom.plans.extract import TopicModel
from themeloom.session import store


def document_view(model: TopicModel, df: DataFrame, hover: str, share: float = params.DISPLAY_SAMPLE) -> dict[str, DataFrame]:
    """Sampled document map, label anchors, extents and topic similarity.

    The sample is drawn before the projection, so only shown rows are joined.
    """
    shown = store(display.sample_per_topic(model.assignments.select("doc_id", "topic"), share), "shown")
    points = linalg.dense_svd(model.vectors, 2).join(shown.select("doc_id"), "doc_id", "left_semi")
    placed = store(display.document_map(shown, points, df, hover), "map")
    return {
        "map": placed,
        "anchors": display.label_anchors(placed),
        "extents": display.extents(placed),
        "similarity": display.centre_similarity(model.centres),
    }


def hierarchy_view(model: TopicModel, levels: int = params.HIERARCHY_LEVELS, scale: str = "linear") -> dict[str, DataFrame]:
    """Merges with names, level map, level names and the printable tree."""
    inside = model.weights.filter(F.col("topic") != params.OUTLIER)
    merges = store(display.hierarchy(inside), "merges")
    parent_words = store(display.merge_words(merges, model.counts, model.factors), "merge_words")
    named = store(display.named_hierarchy(merges, parent_words, model.words), "hierarchy")
    cuts = display.level_cuts(merges, levels, scale)
    mapped = display.topic_levels(model.assignments.select("topic"), merges, cuts)
    node_names = (
        describe.word_list(model.words, params.HIERARCHY_NAME_WORDS).select(F.col("topic").alias("node"), F.col("words").alias("name"))
        .unionByName(describe.word_list(parent_words, params.HIERARCHY_NAME_WORDS, topic="Parent_ID")
                     .select(F.col("Parent_ID").cast("int").alias("node"), F.col("words").alias("name")))
    )
    return {
        "hierarchy": named,
        "levels": display.wide_levels(mapped),
        "level_names": display.level_names(model.words, parent_words),
        "tree": display.tree_text(display.tree_lines(merges), node_names),
    }
