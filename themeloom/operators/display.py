"""Tables behind the topic views: maps, similarity, hierarchy, levels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from themeloom import params
from themeloom.functions import text
from themeloom.operators import describe, linalg
from themeloom.operators.linkage import merge_rounds
from themeloom.operators.rows import in_topics, number_rows
from themeloom.session import store

HIERARCHY_SCHEMA = (
    "Parent_ID string, Topics array<int>, Child_Left_ID string, Child_Right_ID string, Distance double"
)


def document_map(assignments: DataFrame, points: DataFrame, docs: DataFrame, hover: str) -> DataFrame:
    """topic, doc_id, hover_label, x, y; sample first, so only shown rows are joined."""
    placed = points.select("doc_id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))
    return (
        assignments.select("doc_id", "topic")
        .join(docs.select("doc_id", text.wrap_words(describe.label_column(F.col(hover))).alias("hover_label")), "doc_id")
        .join(placed, "doc_id")
        .select("topic", "doc_id", "hover_label", "x", "y")
    )


def sample_per_topic(assignments: DataFrame, share: float = params.DISPLAY_SAMPLE, key: str = "doc_id",
                     seed: int = params.SEED) -> DataFrame:
    """All rows of topics under 100 documents, else exactly ``int(n * share)``.

    Rows are ordered by a hash of (seed, key).  Rows are first counted by the
    leading hash digits, which settles all but one slice per topic, and only
    that slice is ranked: no task sees a whole topic.
    """
    share = min(share, 1.0)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    marked = assignments.withColumn("_order", order).withColumn("_slice", F.substring("_order", 1, 3))
    slices = marked.groupBy("topic", "_slice").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("topic")
    upto = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_n").over(whole)
    wanted = F.when(total < params.SAMPLE_ALL_BELOW, total).otherwise(F.floor(total * F.lit(share)))
    plan = slices.select("topic", "_slice", (wanted - (F.sum("_n").over(upto) - F.col("_n"))).alias("_room"), "_n")
    plan = plan.filter(F.col("_room") > 0)
    joined = marked.join(plan, ["topic", "_slice"])
    inside = joined.filter(F.col("_n") <= F.col("_room")).select(*assignments.columns)
    edge = joined.filter(F.col("_n") > F.col("_room"))
    ranked = edge.withColumn("_rank", F.row_number().over(Window.partitionBy("topic", "_slice").orderBy("_order", key)))
    return inside.unionByName(ranked.filter(F.col("_rank") <= F.col("_room")).select(*assignments.columns))


def label_anchors(points: DataFrame, by: str = "topic") -> DataFrame:
    """Mean position of each topic, where its label is written."""
    return points.groupBy(by).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def extents(points: DataFrame, margin: float = 0.15) -> DataFrame:
    """One row: the range of x and y, widened by a share of their size."""
    low = lambda c: F.min(c) - F.abs(F.min(c) * margin)
    high = lambda c: F.max(c) + F.abs(F.max(c) * margin)
    return points.agg(low("x").alias("x_min"), high("x").alias("x_max"), low("y").alias("y_min"), high("y").alias("y_max"))


def _pairwise(entries: DataFrame) -> DataFrame:
    """(topic_a, topic_b, similarity): cosines of topics given as a stored table of (topic, term, weight).

    Up to a checked number of topics the products are summed per task in one
    topics x topics matrix; beyond it, by a join on the term.
    """
    entries = entries.select(F.col("topic").cast("int").alias("topic"), "term", "weight")
    lengths = entries.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("len"))
    numbered = store(number_rows(lengths, ["topic"], "col"), "topics")
    count = numbered.count()
    if count <= params.PAIR_TOPICS_LIMIT:
        packed = entries.join(numbered.select("topic", "col"), "topic").groupBy("term").agg(
            F.sort_array(F.collect_list(F.struct(F.col("col").cast("int").alias("c"), F.col("weight").alias("w")))).alias("e")
        )
        dots = linalg.sparse_gram(packed.select(F.col("e.c").alias("idx"), F.col("e.w").alias("val")), max(count, 1))
    else:
        left = entries.join(numbered, "topic").select(F.col("col").alias("i"), "term", F.col("weight").alias("wa"))
        right = left.select(F.col("i").alias("j"), "term", F.col("wa").alias("wb"))
        dots = left.join(right, "term").groupBy("i", "j").agg(F.sum(F.col("wa") * F.col("wb")).alias("value"))
    every = entries.sparkSession.range(count * count).select(
        F.expr(f"id div {max(count, 1)}").alias("i"), (F.col("id") % max(count, 1)).alias("j")
    )
    names = numbered.select(F.col("col").alias("i"), F.col("topic").alias("topic_a"), F.col("len").alias("la"))
    others = numbered.select(F.col("col").alias("j"), F.col("topic").alias("topic_b"), F.col("len").alias("lb"))
    return (
        every.join(dots.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "value"), ["i", "j"], "left")
        .join(names, "i")
        .join(others, "j")
        .select("topic_a", "topic_b", F.coalesce(F.try_divide("value", F.col("la") * F.col("lb")), F.lit(0.0)).alias("similarity"))
    )


def term_similarity(weights: DataFrame) -> DataFrame:
    """Cosines of all pairs of topics as weighted terms."""
    return _pairwise(store(weights.select("topic", "term", "weight"), "entries"))


def centre_similarity(centres: DataFrame) -> DataFrame:
    """Cosines of the topics' mean vectors."""
    return _pairwise(store(centres.select("topic", F.posexplode("vector").alias("term", "weight")), "entries"))


def hierarchy(weights: DataFrame) -> DataFrame:
    """Ward merges of the topics on cosine distance, without names; ``weights`` is a stored table.

    Parents are numbered K, K+1, ... by distance; the result is one row per
    merge with the topics it holds, sorted by parent descending.
    """
    spark = weights.sparkSession
    distances = _pairwise(weights).filter(F.col("topic_a") < F.col("topic_b")).select(
        F.col("topic_a").alias("a"), F.col("topic_b").alias("b"),
        F.greatest(1.0 - F.col("similarity"), F.lit(0.0)).alias("distance"),
    )
    return hierarchy_table(spark, merge_rounds(distances, "ward"))


def hierarchy_table(spark, merges: list[dict]) -> DataFrame:
    rows = [
        (str(m["parent"]), m["topics"], str(m["left"]), str(m["right"]), float(m["distance"]))
        for m in sorted(merges, key=lambda m: -m["parent"])
    ]
    return spark.createDataFrame(rows, HIERARCHY_SCHEMA)


def merge_words(merges: DataFrame, counts: DataFrame, factors: DataFrame | None = None, n: int = params.HIERARCHY_NAME_WORDS,
                places: int | None = None) -> DataFrame:
    """(Parent_ID, rank, word, score): best words of each merge from the summed
    counts of its topics and the factors fitted before, which ``counts`` may hold
    as a column ``factor``, as a result of ``class_tfidf`` does."""
    if merges.limit(params.PAIR_TOPICS_LIMIT + 1).count() <= params.PAIR_TOPICS_LIMIT:
        weights = _merge_candidates(merges, counts, factors, n, places)
    else:
        members = merges.select("Parent_ID", F.explode("Topics").alias("topic"))
        if factors is None:
            factors = counts.groupBy("term").agg(F.first("factor").alias("factor"))
        summed = members.join(counts.select("topic", "term", "n"), "topic").groupBy("Parent_ID", "term").agg(F.sum("n").alias("n"))
        weights = describe.class_tfidf(summed, "Parent_ID", factors)
    return describe.top_words(weights, n, topic="Parent_ID", places=places).select("Parent_ID", "rank", "word", "score")


def _merge_candidates(merges: DataFrame, counts: DataFrame, factors: DataFrame | None, n: int, places: int | None) -> DataFrame:
    """(Parent_ID, term, weight) of every term that can be among the best ``n``.

    The merges (a checked number) go to the tasks as a topics x merges matrix;
    each batch of terms is summed by one product and keeps its best terms, with
    all terms that tie with the last of them.
    """
    table = [(r["Parent_ID"], r["Topics"]) for r in merges.select("Parent_ID", "Topics").collect()]
    spark = merges.sparkSession
    if not table:
        return spark.createDataFrame([], "Parent_ID string, term string, weight double")
    position = {t: i for i, t in enumerate(sorted({t for _, held in table for t in held}))}
    member = np.zeros((len(position), len(table)))
    for column, (_, held) in enumerate(table):
        member[[position[t] for t in held], column] = 1.0
    sizes = {r["topic"]: r["n"] for r in counts.groupBy("topic").agg(F.sum("n").alias("n")).collect() if r["topic"] in position}
    total = np.array([sizes.get(t, 0) for t in position], dtype=float) @ member
    unit = 10.0 ** (12 if places is None else places)
    names = np.array([name for name, _ in table], dtype=object)
    known = counts if factors is None else counts.select("topic", "term", "n").join(factors, "term")
    packed = known.groupBy("term").agg(
        F.first("factor").alias("factor"), F.collect_list(F.struct("topic", "n")).alias("e")
    ).select("term", "factor", F.col("e.topic").alias("topics"), F.col("e.n").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dense = np.zeros((len(pdf), len(position)))
            for row, (topics, uses) in enumerate(zip(pdf["topics"], pdf["n"])):
                for topic, use in zip(topics, uses):
                    if topic in position:
                        dense[row, position[topic]] = use
            score = dense @ member / np.maximum(total, 1.0) * pdf["factor"].to_numpy()[:, None]
            level = np.floor(score * unit)
            k = min(n, len(pdf))
            last = -np.partition(-level, k - 1, axis=0)[k - 1]
            rows, columns = np.nonzero((level >= last - 1) & (score > 0))
            yield pd.DataFrame({"Parent_ID": names[columns], "term": pdf["term"].to_numpy()[rows], "weight": score[rows, columns]})

    return packed.mapInPandas(run, "Parent_ID string, term string, weight double")


def named_hierarchy(merges: DataFrame, parent_words: DataFrame, words: DataFrame, n: int = params.HIERARCHY_NAME_WORDS) -> DataFrame:
    """Merges with parent and child names; a child is a topic or an earlier merge."""
    parents = describe.word_list(parent_words, n, topic="Parent_ID").select(F.col("Parent_ID").alias("id"), F.col("words").alias("name"))
    leaves = describe.word_list(words, n).select(F.col("topic").cast("string").alias("id"), F.col("words").alias("name"))
    names = leaves.unionByName(parents)

    def named(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.join(names.select(F.col("id").alias(key), F.col("name").alias(name)), key, "left")

    out = named(named(named(merges, "Parent_ID", "Parent_Name"), "Child_Left_ID", "Child_Left_Name"),
                "Child_Right_ID", "Child_Right_Name")
    return out.select("Parent_ID", "Parent_Name", "Topics", "Child_Left_ID", "Child_Left_Name",
                      "Child_Right_ID", "Child_Right_Name", "Distance").orderBy(F.col("Parent_ID").cast("int").desc())


def level_cuts(merges: DataFrame, levels: int = params.HIERARCHY_LEVELS, scale: str = "linear") -> DataFrame:
    """(level, cut): distance cuts, level 1 the finest.

    Linear: merges from the largest distance down are split into equal runs
    and each run's smallest distance is a cut.  Log: cuts at logarithmically
    spaced positions from the largest distance down.  With fewer merges than
    levels there is one per merge.
    """
    total = merges.count()
    levels = min(levels, total)
    if levels == 0:
        return merges.sparkSession.createDataFrame([], "level int, cut double")
    ranked = number_rows(merges.select("Distance", "Parent_ID"), ["Distance", F.col("Parent_ID").cast("int")], "pos")
    if scale in ("linear", "lin"):
        size, extra = divmod(total, levels)
        ends, end = [], 0
        for i in range(levels):
            end += size + (1 if i < extra else 0)
            ends.append(end - 1)
    elif scale in ("log", "logarithmic"):
        top = max(total - 1, 1)
        ends = [round(top ** (i / max(levels - 1, 1))) if levels > 1 else top for i in range(levels)]
        ends = [min(e, total - 1) for e in ends]
    else:
        raise ValueError("scale is 'linear' or 'log'")
    places = [total - 1 - e for e in reversed(ends)]
    wanted = merges.sparkSession.createDataFrame([(i + 1, p) for i, p in enumerate(places)], "level int, pos long")
    return wanted.join(ranked, "pos").select("level", F.col("Distance").alias("cut"))


def topic_levels(topics: DataFrame, merges: DataFrame, cuts: DataFrame) -> DataFrame:
    """(topic, level, parent): at each cut the largest merge within it that holds
    the topic, or the topic itself."""
    limits = sorted((int(r["level"]), float(r["cut"])) for r in cuts.collect())  # one row per level
    if not limits:
        return topics.sparkSession.createDataFrame([], "topic int, level int, parent int")
    table = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(c).alias("cut")) for n, c in limits])
    reached = F.explode(F.filter(table, lambda s: s["cut"] >= F.col("Distance"))).alias("at")
    within = (
        merges.select(F.col("Parent_ID").cast("int").alias("parent"), "Topics", reached)
        .select("parent", F.explode("Topics").alias("topic"), F.col("at.level").alias("level"))
        .groupBy("topic", "level")
        .agg(F.max("parent").alias("parent"))
    )
    every = topics.select("topic").distinct().withColumn("level", F.explode(F.array(*[F.lit(n) for n, _ in limits])))
    return every.join(within, ["topic", "level"], "left").select(
        "topic", "level", F.coalesce("parent", "topic").alias("parent")
    )


def wide_levels(levels: DataFrame) -> DataFrame:
    """One row per topic with columns level_1, level_2, ..."""
    numbers = sorted(r["level"] for r in levels.select("level").distinct().collect())
    wide = levels.groupBy("topic").pivot("level", numbers).agg(F.first("parent"))
    return wide.select("topic", *[F.col(str(n)).alias(f"level_{n}") for n in numbers])


def level_names(words: DataFrame, parent_words: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(topic, trace_name, plot_text) of topics and merges, 60 characters at most."""
    n = params.HIERARCHY_NAME_WORDS
    cut = F.substring("word", 1, 20)
    if labels is None:
        listed = describe.word_list(words.filter(F.col("topic") != params.OUTLIER), n, word=cut)
        leaf = listed.select("topic", F.concat(F.col("topic").cast("string"), F.lit(" "), "words").alias("full"))
    else:
        leaf = labels.filter(F.col("topic") != params.OUTLIER).select("topic", F.col("label").alias("full"))
    leaves = leaf.select(F.col("topic").cast("int"), text.cut_label(F.col("full")).alias("trace_name"),
                         text.cut_label(F.col("full")).alias("plot_text"))
    named = describe.word_list(parent_words, n, topic="Parent_ID")
    full = F.concat("Parent_ID", F.lit(" "), "words")
    parts = F.array_join(text.cut_words(F.slice(F.split(full, " "), 1, n)), params.LABEL_SEPARATOR)
    merged = named.select(F.col("Parent_ID").cast("int").alias("topic"), text.cut_label(full).alias("trace_name"),
                          text.cut_label(parts).alias("plot_text"))
    return leaves.unionByName(merged)


def tree_lines(merges: DataFrame) -> DataFrame:
    """(node, depth, path): every merge and topic with its depth below the root,
    in the order of the path.

    A node's ancestors are the merges that hold all of its topics, so one join
    per topic gives depth and path without walking the tree.
    """
    nodes = merges.select(F.col("Parent_ID").cast("int").alias("node"), "Topics").unionByName(
        merges.select(F.explode("Topics").alias("node")).distinct().withColumn("Topics", F.array("node"))
    )
    first = nodes.select("node", F.array_min("Topics").alias("topic"), F.size("Topics").alias("size"))
    holders = merges.select(F.col("Parent_ID").cast("int").alias("above"), F.explode("Topics").alias("topic"),
                            F.size("Topics").alias("above_size"))
    above = first.join(holders, "topic").filter(F.col("above_size") > F.col("size"))
    grouped = above.groupBy("node").agg(F.count("*").cast("int").alias("depth"),
                                        F.sort_array(F.collect_list("above"), asc=False).alias("chain"))
    step = lambda c: F.lpad(c.cast("string"), 10, "0")  # digits of the largest int
    return first.join(grouped, "node", "left").select(
        "node",
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.array_join(F.transform(F.concat(F.coalesce("chain", F.array().cast("array<int>")), F.array("node")), step), "/").alias("path"),
    )


def tree_text(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(path, line): the printable tree; ``names`` has node and name."""
    label = F.coalesce("name", F.col("node").cast("string"))
    return lines.join(names, "node", "left").select(
        "path", F.concat(F.expr("repeat('  ', depth)"), F.lit("- "), label).alias("line")
    ).orderBy("path")


def top_topics(frequency: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest topics, outliers apart."""
    return (
        frequency.filter(F.col("topic") != params.OUTLIER).orderBy(F.desc("count"), "topic").limit(n)
    )


def bar_data(frequency: DataFrame, words: DataFrame, topics: Sequence[int] | None = None,
             top_n: int | None = params.BAR_TOPICS, n: int = params.BAR_WORDS) -> DataFrame:
    """(topic, rank, word, score) of named topics, or the largest (6 if no number)."""
    if topics is not None:
        chosen = in_topics(frequency, topics)
    else:
        chosen = top_topics(frequency, 6 if top_n is None else top_n)
    return words.filter(F.col("rank") <= n).join(chosen.select("topic"), "topic", "left_semi").select(
        "topic", "rank", "word", "score"
    )


def shown_group(topic: Column, chosen: Sequence[int] | None) -> Column:
    """The topic if chosen, else 'other'; with no choice only -1 is 'other'."""
    if chosen is None:
        return F.when(topic == params.OUTLIER, F.lit("other")).otherwise(topic.cast("string"))
    return F.when(topic.isin(list(chosen)), topic.cast("string")).otherwise(F.lit("other"))


def trace_names(words: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(topic, name): the custom label, or the id with three words, cut to size."""
    if labels is not None:
        return labels.select("topic", text.cut_label(F.col("label")).alias("name"))
    listed = describe.word_list(words, params.LABEL_WORDS)
    return listed.select("topic", F.concat(F.col("topic").cast("string"), F.lit(" "), text.cut_label(F.col("words"))).alias("name"))
