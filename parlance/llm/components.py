"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import checkpointed

#: Star contraction halves the depth of the deepest tree; 64 rounds outlast any input that fits a cluster.
MAX_ROUNDS = 64


def _star(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Hang every neighbour ``v`` of ``u`` on the least neighbour of ``u``."""
    return pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of comparable ids -> ``(node, root)`` for every node that has a link.

    ``root`` is the least id that the node can reach. Alternating large-star and small-star rounds
    (Kiveris et al., 2014): in each, the least neighbour is a map-side combined ``min``, and the join
    that hands it out has one row per node on its other side, so a hub with very many neighbours is
    split by adaptive skew handling. No round holds more rows than there are links. Self links and
    repeated links are ignored; without links the result is empty.
    """
    edges = checkpointed(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    for _ in range(MAX_ROUNDS):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _star(both.where("v > u"), least).where("a <> b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(down, least).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = checkpointed(small.where("a <> b").distinct())
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))
        ).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
