"""Connected components of a link table, by distributed label contraction.

Every round each node takes the smallest label among itself and its neighbours (large-star), then labels are followed to
their own labels (pointer jumping), so the number of rounds grows with the logarithm of a component's diameter. A node with
very many links is pre-aggregated by map-side ``min`` and never gathered. The driver holds one count per round only: no side of a
join is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that links reach. ``links`` may hold repeats, loops, either order.

    Null ends are ignored. An empty table gives an empty result. Nodes without a link are not returned.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = cut(edges, "edges")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large-star: a node's larger neighbours move to the smallest of the node and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        large = both.join(least.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small-star: a node's smaller neighbours, and itself, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(low.select("u", F.col("m").alias("v")).union(small).distinct(), "edges")
        changed = new.join(edges.hint("merge"), ["u", "v"], "left_anti").limit(1).count() + edges.join(new.hint("merge"), ["u", "v"], "left_anti").limit(1).count()
        edges = new
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots.hint("merge"), nodes.node == roots.u, "left").select("node", F.coalesce("root", "node").alias("component"))
