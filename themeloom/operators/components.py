"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from themeloom.session import shuffled, store


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): each vertex with the smallest id it is connected to.

    Every round takes the smallest label among the neighbours (summed up on
    the map side, so hubs are cheap), then follows labels to their own label.
    Each round is written to the shared folder, which also cuts the lineage.
    Rounds get more with longer paths, so labels are shuffled by id in each and
    never sent to all tasks, which would pass them through the driver.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = store(both.union(both.select("dst", "src")).distinct(), "edges")
    labels = store(vertices.select("id", F.col("id").alias("component")), "labels")
    while True:
        heard = (
            both.join(shuffled(labels), both["src"] == labels["id"])
            .groupBy("dst")
            .agg(F.min("component").alias("heard"))
        )
        lowered = labels.join(shuffled(heard), labels["id"] == heard["dst"], "left").select(
            "id", F.col("component").alias("before"), F.least("component", "heard").alias("component")
        )
        lowered = store(lowered, "lowered")
        target = lowered.select(F.col("id").alias("_label"), F.col("component").alias("_next"))
        jumped = lowered.join(shuffled(target), lowered["component"] == target["_label"]).select(
            "id", "before", F.least("component", "_next").alias("component")
        )
        jumped = store(jumped, "labels")
        moved = jumped.filter("component <> before").limit(1).count()
        labels = jumped.select("id", "component")
        if not moved:
            return labels
