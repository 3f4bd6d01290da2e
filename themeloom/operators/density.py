"""Density hierarchy of points: spanning forest of mutual reachability, condensed tree, most stable clusters.

Points are distinct vectors with the number of their documents.  Two neighbours reach each other at the larger of their
distance and their two core distances.  The spanning forest comes from Boruvka rounds on the edge table, the tree from
merging its edges in order of reach.  Both work in Spark on blocks of at most ``block`` edges: what is left after a round,
or lies within a component of light edges, is settled inside one task, and the result does not depend on ``block``.

The condensed tree has a cluster for each part of the forest that holds ``min_docs`` documents and is not just its parent
less a few documents.  A document leaves its cluster at the reach where it, or a group of less than ``min_docs`` documents
with it, joins the cluster, and a cluster ends where it parts in two or falls below ``min_docs``.  With density as
1 / reach, a cluster's stability is the sum over its documents of the density they leave at less the one it starts at
(Campello, Moulavi and Sander, 2013).  A cluster is chosen if it is at least as stable as the best choice below it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from themeloom import params
from themeloom.operators.components import connected_components
from themeloom.session import shuffled, store


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        root = i
        while parent[root] != root:
            root = parent[root]
        while parent[i] != root:
            parent[i], i = root, parent[i]
        return root


def _positions(*columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct values, and the columns as positions in them."""
    names, where = np.unique(np.concatenate(columns), return_inverse=True)
    return names, np.split(where, np.cumsum([len(c) for c in columns])[:-1])


def _order(frame: pd.DataFrame) -> pd.DataFrame:
    """Edges in the one order all steps use: reach, then the ends of the original edge."""
    return frame.sort_values(["reach", "a", "b"], kind="stable", ignore_index=True)


def _local_forest(frame: pd.DataFrame) -> pd.DataFrame:
    """The spanning forest of a block of edges between components ``ca`` and ``cb``."""
    frame = _order(frame)
    _, (left, right) = _positions(frame["ca"].to_numpy(), frame["cb"].to_numpy())
    sets, kept = _Sets(len(left) * 2), []
    for i, (x, y) in enumerate(zip(left.tolist(), right.tolist())):
        x, y = sets.find(x), sets.find(y)
        if x != y:
            sets.parent[max(x, y)] = min(x, y)
            kept.append(i)
    return frame.loc[kept, ["a", "b", "reach"]]


def spanning_forest(edges: DataFrame, block: int = params.BLOCK_EDGES) -> DataFrame:
    """(a, b, reach): the minimum spanning forest of ``edges``; equal reaches are ordered by a and b.

    A Boruvka round gives every component its first outgoing edge.  The edges between the components of a round
    are kept once for each pair, so they get fewer each time; when they fit a block the rest is done in one task.
    """
    live = store(edges.select("a", "b", "reach", F.col("a").alias("ca"), F.col("b").alias("cb")), "reach")
    found = []
    while True:
        count = live.limit(block + 1).count()
        if count <= block:
            if count:
                found.append(live.withColumn("one", F.pmod("a", F.lit(1))).groupBy("one").applyInPandas(_local_forest, "a long, b long, reach double"))
            break
        first = F.min(F.struct("reach", "a", "b", "ca", "cb")).alias("e")
        ends = live.select(F.explode(F.array("ca", "cb")).alias("c"), "reach", "a", "b", "ca", "cb")
        chosen = store(ends.groupBy("c").agg(first).select("e.*").distinct(), "boruvka")
        found.append(chosen.select("a", "b", "reach"))
        vertices = live.select(F.explode(F.array("ca", "cb")).alias("id")).distinct()
        labels = connected_components(vertices, chosen.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        one = labels.select(F.col("id").alias("ca"), F.col("component").alias("na"))
        two = labels.select(F.col("id").alias("cb"), F.col("component").alias("nb"))
        moved = live.join(shuffled(one), "ca").join(shuffled(two), "cb").filter("na <> nb")
        best = F.min(F.struct("reach", "a", "b")).alias("e")
        live = store(moved.groupBy(F.least("na", "nb").alias("ca"), F.greatest("na", "nb").alias("cb")).agg(best).select("e.*", "ca", "cb"), "reach")
    if not found:
        return live.select("a", "b", "reach")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return store(out, "forest")


_STATE = ("size", "cluster", "density", "below")
#: What merging gives back: kind 0, node ``id`` fell into cluster ``x`` at ``reach``; kind 1, cluster ``id`` ended below
#: parent ``x`` at ``reach`` with ``size`` documents, ``own`` if it is chosen over what is below; kind 2, node ``id`` is
#: part of node ``x`` now; kind 3, the state of node ``id``.
_MERGED = "kind int, id long, x long, reach double, size long, cluster long, density double, below double, own boolean"


def cluster_id(a: int, b: int) -> int:
    """A number for the cluster that the forest's edge (a, b) makes."""
    return hash((a, b)) & 0x7FFFFFFFFFFFFFFF  # the same in every process for a pair of integers


def _merge_component(frame: pd.DataFrame, min_docs: int) -> pd.DataFrame:
    """Merge the nodes of one component along its edges, lightest first.

    Rows with ``node`` are nodes: ``a`` with ``size``, ``cluster`` (-1 if small), ``density`` (of the documents that have left
    the cluster) and ``below`` (stability of the best choice below it).  The others are edges.
    """
    nodes, edges = frame[frame["node"]], _order(frame[~frame["node"]])
    names, (of_node, left, right) = _positions(nodes["a"].to_numpy(), edges["ca"].to_numpy(), edges["cb"].to_numpy())
    n = len(names)
    size, cluster, density, below = ([None] * n for _ in range(4))
    for i, s, c, d, b in zip(of_node.tolist(), *(nodes[c].tolist() for c in _STATE)):
        size[i], cluster[i], density[i], below[i] = s, c, d, b
    small = {i: [i] for i in range(n) if cluster[i] < 0}
    sets, rows = _Sets(n), []
    for x, y, reach, a, b in zip(left.tolist(), right.tolist(), edges["reach"].tolist(), edges["a"].tolist(), edges["b"].tolist()):
        x, y = sets.find(x), sets.find(y)
        total = size[x] + size[y]
        both = cluster[x] >= 0 and cluster[y] >= 0
        brief = next((z for z in (y, x) if both and not below[z] and density[z] <= size[z] / reach * (1 + 1e-12)), None)
        if brief is not None:  # it became a cluster at this very reach: its documents only join the other one
            other = x + y - brief
            rows.append((1, cluster[brief], cluster[other], reach, size[brief], -1, 0.0, 0.0, False))
            state = cluster[other], density[other] + size[brief] / reach, below[other]
        elif both:  # seen from above, a cluster parts in two here
            parent, stable = cluster_id(a, b), 0.0
            for z in (x, y):
                own = density[z] - size[z] / reach
                rows.append((1, cluster[z], parent, reach, size[z], -1, own, below[z], own >= below[z]))
                stable += max(own, below[z])
            state = parent, total / reach, stable
        else:
            big = x if cluster[x] >= 0 else y if cluster[y] >= 0 else None
            fallen = small.pop(x, []) + small.pop(y, [])
            if big is None and total < min_docs:
                small[x], state = fallen, (-1, 0.0, 0.0)
            else:
                joined = cluster_id(a, b) if big is None else cluster[big]
                lost = total if big is None else total - size[big]
                rows += [(0, int(names[i]), joined, reach, 0, -1, 0.0, 0.0, False) for i in fallen]
                state = joined, (density[big] if big is not None else 0.0) + lost / reach, below[big] if big is not None else 0.0
        size[x], (cluster[x], density[x], below[x]) = total, state
        sets.parent[y] = x
    for i in range(n):
        root = sets.find(i)
        rows.append((2, int(names[i]), int(names[root]), 0.0, 0, -1, 0.0, 0.0, False))
        if root == i:
            rows.append((3, int(names[i]), 0, 0.0, size[i], cluster[i], density[i], below[i], False))
    return pd.DataFrame(rows, columns=["kind", "id", "x", "reach", "size", "cluster", "density", "below", "own"])


def condensed_tree(points: DataFrame, forest: DataFrame, min_docs: int, block: int = params.BLOCK_EDGES) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, reach) of every point that is ever in a cluster (reach null for a cluster of one point), and (cluster, parent, reach, size, stability,
    below, own) of all clusters; a root has a null parent.

    ``points`` have ``id, weight, core``.  While the edges do not fit a block, the lightest ones are merged first: they fall
    into components, which are handled side by side, and each becomes one node of the next round.  A point with
    ``min_docs`` documents is a cluster that they leave just inside its core distance, so it never counts as brief.
    """
    alone, own = F.col("weight") >= min_docs, F.xxhash64("id").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    nodes = points.select(
        "id", F.col("weight").cast("long").alias("size"), F.when(alone, own).otherwise(-1).alias("cluster"),
        F.when(alone & (F.col("core") > 0), F.col("weight") / F.col("core") * (1 + 1e-6)).otherwise(0.0).alias("density"), F.lit(0.0).alias("below"))
    edges = store(forest.select("a", "b", "reach", F.col("a").alias("ca"), F.col("b").alias("cb")), "edges")
    place = points.filter(~alone).select("id", F.col("id").alias("node"))
    fallen = [points.filter(alone).select("id", own.alias("cluster"), F.lit(None).cast("double").alias("reach"))]
    ended, last, share = [], False, 0.5
    while not last and not edges.isEmpty():
        light, group, share, last = _light_edges(edges, block, share)
        none = {c: F.lit(0).cast(t).alias(c) for c, t in zip(_STATE, ("long", "long", "double", "double"))}
        rows = light.join(shuffled(group.withColumnRenamed("id", "ca")), "ca").select(
            "component", F.lit(False).alias("node"), "a", "b", "reach", "ca", "cb", *none.values())
        zero = F.lit(0).cast("long")
        members = nodes.join(shuffled(group), "id").select(
            "component", F.lit(True).alias("node"), F.col("id").alias("a"), zero.alias("b"), F.lit(0.0).alias("reach"), zero.alias("ca"), zero.alias("cb"), *_STATE)
        merge = lambda frame: _merge_component(frame, min_docs)
        merged = store(rows.unionByName(members).groupBy("component").applyInPandas(merge, _MERGED), "merged")
        fell = merged.filter("kind = 0").select(F.col("id").alias("node"), F.col("x").alias("cluster"), "reach")
        fallen.append(place.join(shuffled(fell), "node").select("id", "cluster", "reach"))
        ended.append(merged.filter("kind = 1").select(
            F.col("id").alias("cluster"), F.col("x").alias("parent"), "reach", "size", F.col("density").alias("stability"), "below", "own"))
        states = merged.filter("kind = 3").select("id", *_STATE)
        nodes = nodes.join(shuffled(group), "id", "left_anti").unionByName(states)
        if last:
            break
        nodes = store(nodes, "nodes")
        to = store(merged.filter("kind = 2").select(F.col("id").alias("node"), F.col("x").alias("to")), "to")
        place = place.join(shuffled(fell.select("node")), "node", "left_anti").join(shuffled(to), "node", "left")
        place = store(place.select("id", F.coalesce("to", "node").alias("node")), "place")
        edges = edges.join(shuffled(light.select("a", "b")), ["a", "b"], "left_anti")
        for end in ("ca", "cb"):
            edges = edges.join(shuffled(to.withColumnRenamed("node", end)), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = store(edges, "edges")
    tree = nodes.filter("cluster >= 0").select(
        "cluster", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("double").alias("reach"), "size",
        F.col("density").alias("stability"), "below", (F.col("density") >= F.col("below")).alias("own"))
    for more in ended:
        tree = tree.unionByName(more)
    out = fallen[0]
    for more in fallen[1:]:
        out = out.unionByName(more)
    return store(out, "fallen"), store(tree, "tree")


def _light_edges(edges: DataFrame, block: int, share: float) -> tuple[DataFrame, DataFrame, float, bool]:
    """The edges to merge now, the (id, component) of their nodes, their share, and whether these are all edges.

    All edges if they fit a block, as one component; else the first of them, by reach and a, whose components do:
    twice the last share, or the largest of its halves.
    """
    total = edges.count()
    ids = lambda df: df.select(F.explode(F.array("ca", "cb")).alias("id")).distinct()
    if total <= block:
        return edges, ids(edges).withColumn("component", F.pmod("id", F.lit(1))), 1.0, True
    share, least = min(2 * share, 0.5), edges.agg(F.min("reach")).first()[0]
    while True:
        limit = edges.agg(F.percentile_approx("reach", share, 10_000)).first()[0]
        light = edges.filter(F.col("reach") <= limit)
        if limit == least:  # a share of the equal ones
            equal = light.count()
            upto = light.agg(F.percentile_approx("a", min(1.0, share * total / equal), 10_000)).first()[0]
            light = light.filter(F.col("a") <= upto)
        light = store(light, "light")
        group = connected_components(ids(light), light.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        if group.groupBy("component").count().agg(F.max("count")).first()[0] <= block or light.count() <= block:
            return light, group, share, False
        share /= 2


def point_topics(fallen: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, topic, reach) of the points of ``condensed_tree``.  One that left at the very reach where its cluster began was
    never in it and belongs to the parent."""
    ends = tree.select("cluster", "parent", F.col("reach").alias("end"))
    held = fallen.join(ends, "cluster").select(
        "id", F.when(F.col("reach") >= F.col("end"), F.col("parent")).otherwise(F.col("cluster")).alias("cluster"), "reach")
    return held.join(chosen_clusters(tree), "cluster").select("id", "topic", "reach")


def without_far_points(found: DataFrame, points: DataFrame, min_docs: int, fence: float) -> DataFrame:
    """(id, topic) less the points that hang on their topic from afar: those whose reach is over Q3 + ``fence`` (Q3 - Q1)
    of the reaches of the topic's points.  A topic that would be left with less than ``min_docs`` documents stays whole."""
    held = store(found.filter(F.col("topic") != params.OUTLIER).join(points.select("id", "weight"), "id"), "held")
    quartiles = held.groupBy("topic").agg(F.percentile_approx("reach", [0.25, 0.75], 10_000).alias("q"))
    limit = F.col("q")[1] + fence * (F.col("q")[1] - F.col("q")[0])
    near = held.join(quartiles, "topic").withColumn("far", F.coalesce(F.col("reach") > limit, F.lit(False)))
    whole = near.groupBy("topic").agg(F.sum(F.when(F.col("far"), 0).otherwise(F.col("weight"))).alias("docs")).filter(
        F.col("docs") < min_docs).select("topic", F.lit(True).alias("whole"))
    return near.join(whole, "topic", "left").filter(~F.col("far") | F.coalesce("whole", F.lit(False))).select("id", "topic")


def chosen_clusters(tree: DataFrame) -> DataFrame:
    """(cluster, topic): for each cluster the chosen cluster it belongs to, -1 if it lies above the chosen ones.

    The only root of a connected forest is not a choice if anything parts below it.  The highest cluster on a path that is at least
    as stable as what is below is chosen; paths are followed by doubling.
    """
    inner = tree.filter("parent IS NOT NULL").select(F.col("parent").alias("cluster")).distinct().withColumn("parts", F.lit(True))
    single = tree.filter("parent IS NULL").limit(2).count() == 1
    marked = tree.join(inner, "cluster", "left")
    chosen = F.col("own") & ~(F.lit(single) & F.col("parent").isNull() & F.coalesce("parts", F.lit(False)))
    path = store(marked.select("cluster", "parent", F.when(chosen, F.col("cluster")).alias("topic")), "path")
    while not path.filter("parent IS NOT NULL").isEmpty():
        above = path.select(F.col("cluster").alias("parent"), F.col("parent").alias("next"), F.col("topic").alias("higher"))
        for _ in range(2):
            path = path.join(shuffled(above), "parent", "left").select(
                "cluster", F.col("next").alias("parent"), F.coalesce("higher", "topic").alias("topic"))
        path = store(path, "path")
    return path.select("cluster", F.coalesce("topic", F.lit(params.OUTLIER)).alias("topic"))
