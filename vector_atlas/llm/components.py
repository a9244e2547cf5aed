"""Components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vector_atlas.operators.graph import connected_components


def settle(links: DataFrame) -> DataFrame:
    """``item_id, component`` of all ends of ``links`` (``src, dst``): the smallest id of each component.

    Links are contracted by alternating stars, so a chain is about halved each round and the rounds grow
    with the logarithm of its length, in whatever order its ids stand.
    """
    nodes = links.select(F.explode(F.array("src", "dst")).alias("item_id")).distinct()
    return connected_components(nodes, links.select("src", "dst"))
