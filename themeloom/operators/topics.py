"""Finding topics and assigning documents to them.

``vectors`` tables have ``doc_id, vector``; ``assignments`` have ``doc_id,
topic, probability`` with -1 for outliers; ``topic vectors`` have ``topic,
vector``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from themeloom import params
from themeloom.functions import arrays
from themeloom.operators import density, linalg, spectral
from themeloom.operators.components import connected_components
from themeloom.operators.forest import forest_neighbours
from themeloom.operators.linkage import merge_rounds
from themeloom.operators.neighbors import nearest
from themeloom.operators.rows import number_rows
from themeloom.session import store


def topic_vectors(vectors: DataFrame, assignments: DataFrame, outliers: bool = False) -> DataFrame:
    """Mean vector of each topic, of the outliers only if asked for; summed on the map side."""
    members = assignments.select("doc_id", "topic") if outliers else assignments.filter(F.col("topic") != params.OUTLIER).select("doc_id", "topic")
    means = (
        vectors.select("doc_id", "vector")
        .join(members, "doc_id")
        .select("topic", F.posexplode("vector").alias("pos", "x"))
        .groupBy("topic", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"))
    )
    return means.groupBy("topic").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("vector")
    )


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("doc_id").alias("id"), "vector")


def _items(topics: DataFrame) -> DataFrame:
    return topics.select(F.col("topic").cast("long").alias("id"), "vector")


def closest_topic(vectors: DataFrame, topics: DataFrame, **options) -> DataFrame:
    """(doc_id, topic, similarity): the topic with the highest cosine; ties go
    to the smaller topic id."""
    found = nearest(_queries(vectors), _items(topics), 1, "cosine", **options)
    return found.select(
        F.col("query").alias("doc_id"), F.col("item").cast("int").alias("topic"), F.col("score").alias("similarity")
    )


def zero_shot(vectors: DataFrame, candidates: DataFrame, threshold: float = params.ZERO_SHOT_THRESHOLD) -> DataFrame:
    """(doc_id, topic, similarity) of documents close enough to a candidate."""
    return closest_topic(vectors, candidates).filter(F.col("similarity") >= threshold)


def score_documents(vectors: DataFrame, topics: DataFrame) -> DataFrame:
    """Assignments of new documents to the topics of a fitted model."""
    best = closest_topic(vectors, topics)
    return best.select("doc_id", "topic", probability(F.col("similarity")).alias("probability"))


def probability(similarity):
    """Cosine mapped from [-1, 1] to [0, 1]."""
    return (similarity + 1.0) / 2.0


def assignment_probability(vectors: DataFrame, assignments: DataFrame, topics: DataFrame) -> DataFrame:
    """(doc_id, topic, probability): closeness to the own topic; 0 for outliers."""
    own = (
        assignments.select("doc_id", "topic")
        .join(vectors.select("doc_id", "vector"), "doc_id")
        .join(topics.select("topic", F.col("vector").alias("_centre")), "topic", "left")
    )
    near = probability(arrays.cosine(F.col("vector"), F.col("_centre")))
    return own.select(
        "doc_id", "topic", F.when(F.col("_centre").isNull(), F.lit(0.0)).otherwise(near).alias("probability")
    )


def full_probabilities(vectors: DataFrame, topics: DataFrame, scale: float = 1.0) -> DataFrame:
    """(doc_id, topic, probability) of every document and topic: the soft maximum
    of the cosines.  The result itself has documents x topics rows."""
    k = topics.count()
    found = nearest(_queries(vectors), _items(topics), max(k, 1), "cosine", soft=scale)
    return found.select(
        F.col("query").alias("doc_id"), F.col("item").cast("int").alias("topic"), F.col("score").alias("probability")
    )


def number_by_size(groups: DataFrame) -> DataFrame:
    """(doc_id, topic) with topics renumbered so that 0 is the largest.

    Ties go to the topic with the smallest document id; -1 stays.
    """
    sizes = (
        groups.filter(F.col("topic") != params.OUTLIER)
        .groupBy("topic")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    )
    numbered = number_rows(sizes, [F.desc("n"), F.asc("first_doc")], "number")
    joined = groups.join(numbered.select("topic", "number"), "topic", "left")
    return joined.select("doc_id", F.coalesce("number", F.lit(params.OUTLIER)).cast("int").alias("topic"))


def reduce_for_clusters(vectors: DataFrame, k: int = params.CLUSTER_DIMENSIONS, method: str = "linear") -> DataFrame:
    """Length-normalised vectors reduced to ``k`` dimensions: by a linear map, or, with "graph", by the leading
    eigenvectors of the neighbour graph (``operators.spectral``), which follow bent data."""
    if method not in ("linear", "graph"):
        raise ValueError("method is 'linear' or 'graph'")
    if method == "graph":
        return spectral.graph_coordinates(vectors, k)
    normal = vectors.select("doc_id", arrays.unit(F.col("vector")).alias("vector"))
    return linalg.dense_svd(normal, k)


def density_points(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, vector, weight) of the distinct vectors, known by their smallest document, and (doc_id, id)."""
    marked = vectors.select("doc_id", F.col("vector").cast("array<double>").alias("vector"))
    points = store(marked.groupBy("vector").agg(F.min("doc_id").alias("id"), F.count("*").alias("weight")), "points")
    return points, marked.join(points.select("vector", "id"), "vector").select("doc_id", "id")


def reach_edges(points: DataFrame, min_docs: int, neighbours: int = params.NEIGHBOURS, leaf: int = params.FOREST_LEAF,
                trees: int = params.FOREST_TREES) -> tuple[DataFrame, DataFrame]:
    """(id, weight, core) and mutual-reachability edges (a, b, reach) between neighbours.

    The core distance is that to the ``min_docs``-th vector, the own one included, or to the farthest if there are fewer.
    """
    found = store(forest_neighbours(points, max(neighbours, min_docs), leaf, trees), "neighbours")
    far = found.filter(F.col("rank") <= max(min_docs - 1, 1)).groupBy("query").agg(F.max("distance").alias("core"))
    core = store(points.select("id", "weight").join(far.withColumnRenamed("query", "id"), "id", "left"), "core")
    edges = (
        found.join(core.select(F.col("id").alias("query"), F.col("core").alias("core_a")), "query")
        .join(core.select(F.col("id").alias("item"), F.col("core").alias("core_b")), "item")
        .groupBy(F.least("query", "item").alias("a"), F.greatest("query", "item").alias("b"))
        .agg(F.min(F.greatest("core_a", "core_b", "distance")).alias("reach"))
    )
    return core, edges


def linked_forest(points: DataFrame, core: DataFrame, forest: DataFrame, leaf: int, block: int, members: int = 32) -> DataFrame:
    """The forest with its parts linked to one tree, so that every group has a reach at which it parts from the others.

    The neighbour graph may fall into parts.  ``members`` points of each part, chosen by a hash, look for their nearest
    ones, of which some are in other parts as there are more of them; the spanning forest of these links and the old ones has half as
    many parts or fewer.  Distances between parts are thus those between chosen points.
    """
    n = core.count()
    while n - forest.count() > 1:
        parts = connected_components(core.select("id"), forest)
        order = Window.partitionBy("component").orderBy(F.xxhash64("id"), "id")
        chosen = parts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= members)
        chosen = store(chosen.join(points.select("id", "vector"), "id").join(core.select("id", "core"), "id"), "parts")
        near = forest_neighbours(chosen, members + 4, max(leaf, 4 * members))
        side = lambda name, mark: chosen.select(
            F.col("id").alias(name), F.col("component").alias(f"part_{mark}"), F.col("core").alias(f"core_{mark}"))
        across = near.join(side("query", "a"), "query").join(side("item", "b"), "item").filter("part_a <> part_b")
        links = across.groupBy(F.least("query", "item").alias("a"), F.greatest("query", "item").alias("b")).agg(
            F.min(F.greatest("core_a", "core_b", "distance")).alias("reach"))
        forest = density.spanning_forest(forest.unionByName(links), block)
    return forest


def density_clusters(
    vectors: DataFrame,
    min_docs: int = params.MIN_DOCS_PER_TOPIC,
    neighbours: int = params.NEIGHBOURS,
    cut: float | None = None,
    cut_quantile: float | None = None,
    fence: float | None = params.FENCE,
    leaf: int = params.FOREST_LEAF,
    block: int = params.BLOCK_EDGES,
) -> DataFrame:
    """(doc_id, topic): dense groups numbered by size; the rest is -1.

    The most stable clusters of the density hierarchy (``operators.density``), so groups of unequal density are found
    side by side; documents that only hang on one from afar leave it (``density.without_far_points``; all stay if ``fence``
    is None).  With ``cut``, or the quantile ``cut_quantile`` of the core distances, the groups are instead the parts
    with ``min_docs`` documents whose vectors reach each other within that distance.  ``leaf`` and ``block`` bound the work
    of a task; the second does not change the result, nor does the first if the vectors fit one cell.
    """
    points, members = density_points(vectors)
    core, edges = reach_edges(points, min_docs, neighbours, leaf)
    forest = density.spanning_forest(edges, block)
    if cut is None and cut_quantile is None:
        forest = linked_forest(points, core, forest, leaf, block)
    if cut is None and cut_quantile is None:
        fallen, tree = density.condensed_tree(core, forest, min_docs, block)
        found = density.point_topics(fallen, tree)
        if fence is not None:
            found = density.without_far_points(found, core, min_docs, fence)
    else:
        if cut is None:
            cut = core.agg(F.percentile("core", F.lit(cut_quantile))).first()[0] or 0.0
        groups = connected_components(core.select("id"), forest.filter(F.col("reach") <= cut).select("a", "b"))
        sizes = groups.join(core, "id").groupBy("component").agg(F.sum("weight").alias("docs")).filter(F.col("docs") >= min_docs)
        found = groups.join(sizes, "component", "left_semi").select("id", F.col("component").alias("topic"))
    topics = members.join(found, "id", "left").select("doc_id", F.coalesce("topic", F.lit(params.OUTLIER)).alias("topic"))
    return number_by_size(store(topics, "groups"))


def topic_merges(centres: DataFrame, sizes: DataFrame, count: int | None = None, min_similarity: float = 0.9) -> DataFrame:
    """(topic, merged): average-linkage merging of similar topics.

    With ``count`` the closest topics are merged until that many are left;
    otherwise all merges of at least ``min_similarity`` are made.
    """
    from themeloom.operators.display import centre_similarity

    spark = centres.sparkSession
    pairs = centre_similarity(centres).filter(F.col("topic_a") < F.col("topic_b")).select(
        F.col("topic_a").alias("a"), F.col("topic_b").alias("b"), (1.0 - F.col("similarity")).alias("distance")
    )
    merges = merge_rounds(pairs, "average", None if count else 1.0 - min_similarity, count, sizes)
    target = {}
    for merge in merges:
        for topic in merge["topics"]:
            target[topic] = min(merge["topics"])
    rows = [(int(t), int(m)) for t, m in target.items()]
    changed = spark.createDataFrame(rows, "topic int, merged int")
    return centres.select(F.col("topic").cast("int").alias("topic")).join(changed, "topic", "left").select(
        "topic", F.coalesce("merged", "topic").alias("merged")
    )


def limit_topics(groups: DataFrame, vectors: DataFrame, count: int = 0, min_similarity: float = 0.9) -> DataFrame:
    """(doc_id, topic) after merging topics, renumbered by size; 0 = automatic."""
    centres = topic_vectors(vectors, groups)
    sizes = groups.filter(F.col("topic") != params.OUTLIER).groupBy("topic").agg(F.count("*").alias("n"))
    mapping = topic_merges(store(centres, "centres"), sizes, count or None, min_similarity)
    merged = groups.join(mapping, "topic", "left").select("doc_id", F.coalesce("merged", "topic").alias("topic"))
    return number_by_size(merged)


def zero_shot_then_cluster(
    vectors: DataFrame, candidates: DataFrame, threshold: float = params.ZERO_SHOT_THRESHOLD, reduction: str = "linear", **options
) -> DataFrame:
    """(doc_id, topic, zero_shot): candidate topics keep their ids, clusters of
    the rest get the ids after them."""
    given = store(zero_shot(vectors, candidates, threshold).select("doc_id", "topic"), "given")
    rest = vectors.join(given.select("doc_id"), "doc_id", "left_anti")
    offset = (candidates.agg(F.max("topic")).first()[0] or 0) + 1
    found = density_clusters(store(reduce_for_clusters(rest, method=reduction), "reduced"), **options)
    later = found.select(
        "doc_id",
        F.when(F.col("topic") == params.OUTLIER, F.col("topic")).otherwise(F.col("topic") + F.lit(offset)).alias("topic"),
    )
    return given.withColumn("zero_shot", F.lit(True)).unionByName(later.withColumn("zero_shot", F.lit(False)))


def reduce_outliers(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """(doc_id, topic): each outlier goes to the topic with the closest mean
    vector; other documents keep theirs."""
    centres = topic_vectors(vectors, assignments)
    lost = assignments.filter(F.col("topic") == params.OUTLIER).select("doc_id")
    moved = closest_topic(vectors.join(lost, "doc_id", "left_semi"), centres).select("doc_id", "topic")
    kept = assignments.filter(F.col("topic") != params.OUTLIER).select("doc_id", F.col("topic").cast("int").alias("topic"))
    return kept.unionByName(moved)
