"""Connected components over a bipartite graph, without pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.common import cut_lineage


def bipartite_components(edges: DataFrame, nodes: DataFrame, keys: list[str], node: str = "i", link: str = "token", max_rounds: int = 100) -> DataFrame:
    """(keys, node, component): nodes joined through shared links; component is the least node number in it.

    Each round takes the least label over every link and node and then the label of the label, so that chains shrink
    by halves; a round aggregates with map-side combination, so a link shared by most nodes is no single task. Lineage
    is cut in the shared folder every round. Nodes without links are their own component. Ends when nothing changes.
    """
    edges = cut_lineage(edges.select(*keys, node, link).distinct())
    labels = cut_lineage(nodes.select(*keys, node).distinct().withColumn("component", F.col(node)))
    for _ in range(max_rounds):
        per_link = edges.join(labels, [*keys, node]).groupBy(*keys, link).agg(F.min("component").alias("m"))
        per_node = edges.join(per_link, [*keys, link]).groupBy(*keys, node).agg(F.min("m").alias("m"))
        new = labels.join(per_node, [*keys, node], "left").select(*keys, node, F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("c"))
        target = new.select(*keys, F.col(node).alias("c"), F.col("c").alias("cc"))
        new = cut_lineage(new.join(target, [*keys, "c"]).select(*keys, node, "old", F.col("cc").alias("component")))
        labels = new.drop("old")
        if new.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
