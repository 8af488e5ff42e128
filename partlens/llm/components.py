"""Connected components of an edge list, as joins and group-bys on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.llm.common import stored

#: Up to so many edges, each node's smallest neighbour (one short row a node) is broadcast, joined by a shuffle beyond.
BROADCAST_EDGES = 50_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("root", "node"))
    ).first()
    return tuple(row)


def _to_smallest(edges: DataFrame, few: bool) -> DataFrame:
    """Point each neighbour of a node at the smallest of the neighbours and the node itself.

    ``edges`` holds (node, near) with node on either side as wanted; a hub is reduced before the
    shuffle, and the join that follows is a broadcast of ``few`` nodes or can be split by the engine.
    """
    least = edges.groupBy("node").agg(F.min("near").alias("least")).selectExpr("node", "least(node, least) AS root")
    return edges.join(F.broadcast(least) if few else least, "node")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node that can reach a smaller one: root is the smallest node it can reach.

    Alternates the large-star and small-star steps; each round writes the edges to the shared folder.
    NULL ends and loops are ignored. No links give an empty result.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    edges = stored(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(high.alias("node"), low.alias("root")).distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        few = state[0] <= BROADCAST_EDGES
        both = edges.selectExpr("node", "root AS near").unionByName(edges.selectExpr("root AS node", "node AS near"))
        large = _to_smallest(both, few).where("near > node").selectExpr("near AS node", "root")
        # Few edges may repeat until the end of the round: each makes two at most.
        small = _to_smallest((large if few else large.distinct()).selectExpr("node", "root AS near"), few)
        small = small.selectExpr("near AS node", "root").unionByName(small.select("node", "root"))
        edges = stored(small.where("node != root").distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges
