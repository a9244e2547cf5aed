"""Affinity graphs: construction, components, modularity and degrees.

Undirected edges are stored once, with ``src < dst``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vector_atlas.config import SYMMETRIZE_MODES, KnnConfig
from vector_atlas.operators.neighbours import knn_join
from vector_atlas.operators.vectors import validate_vectors
from vector_atlas.session import materialise


def directed_affinity(neighbours: DataFrame) -> DataFrame:
    """``src, dst, weight``: cosine clipped to 0..1; loops and zero weights vanish, repeats add up."""
    weight = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return (
        neighbours.select("src", "dst", weight.alias("weight"))
        .where((F.col("src") != F.col("dst")) & (F.col("weight") > 0))
        .groupBy("src", "dst")
        .agg(F.sum("weight").alias("weight"))
    )


def symmetrize_graph(directed: DataFrame, mode: str = "max") -> DataFrame:
    """One undirected edge per pair; a missing direction counts as weight zero."""
    if mode not in SYMMETRIZE_MODES:
        raise ValueError(f"mode must be one of {SYMMETRIZE_MODES}, got {mode!r}")
    pairs = (
        directed.where(F.col("src") != F.col("dst"))
        .groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(
            F.sum(F.when(F.col("src") < F.col("dst"), F.col("weight"))).alias("there"),
            F.sum(F.when(F.col("src") > F.col("dst"), F.col("weight"))).alias("back"),
        )
    )
    there, back = F.coalesce("there", F.lit(0.0)), F.coalesce("back", F.lit(0.0))
    weight = {
        "max": F.greatest(there, back),
        "min": F.least(there, back),
        "mean": (there + back) / 2,
    }[mode]
    return pairs.select("src", "dst", weight.alias("weight")).where(F.col("weight") > 0)


def build_knn_graph(vectors: DataFrame, config: KnnConfig = KnnConfig(), **limits) -> DataFrame:
    """Checked vectors -> neighbours -> affinities -> undirected edges (directed when asked)."""
    validate_vectors(vectors, config.k)
    directed = directed_affinity(knn_join(vectors, config.k, **limits))
    return symmetrize_graph(directed, config.mode) if config.symmetrize else directed


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each undirected edge in both directions, from one scan."""
    ends = F.array(
        F.struct(F.col(src).alias("a"), F.col(dst).alias("b")),
        F.struct(F.col(dst).alias("a"), F.col(src).alias("b")),
    )
    others = [c for c in edges.columns if c not in (src, dst)]
    return edges.select(F.explode(ends).alias("e"), *others).select(
        F.col("e.a").alias(src), F.col("e.b").alias(dst), *others
    )


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``item_id, component``: the smallest id of each component; isolated nodes are their own.

    Alternating star contraction: every node links its larger neighbours to its smallest
    one, then its smaller neighbours likewise, until only stars are left. Only minima are
    aggregated, so a hub is pre-aggregated on the map side and no neighbour list is built.
    """
    links = materialise(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "links",
    )
    state = _fingerprint(links)
    for _ in range(max_rounds):
        # large stars: look at both directions, move the larger ends to the minimum
        around = both_ways(links, "u", "v")
        # minima are written, so both join sides are plain shuffles and a hub's rows can be split
        low = materialise(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = (
            around.where(F.col("v") > F.col("u"))
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        large = materialise(large, "links")
        # small stars: only smaller neighbours, moved to the smallest of them
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = large.join(low, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        links = materialise(small, "links")
        now = _fingerprint(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(roots, nodes["item_id"] == roots["u"], "left").select(
        "item_id", F.coalesce("m", "item_id").alias("component")
    )


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``item_id, degree``: number of distinct neighbours; isolated nodes have 0."""
    counted = both_ways(edges.select("src", "dst")).groupBy("src").agg(F.count("*").alias("degree"))
    return nodes.join(counted, nodes["item_id"] == counted["src"], "left").select(
        "item_id", F.coalesce("degree", F.lit(0)).alias("degree")
    )


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node count, edge count and mean degree in one pass over degrees."""
    return degrees(nodes, edges).agg(
        F.count("*").alias("n_nodes"),
        (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("n_edges"),
        F.coalesce(F.avg("degree"), F.lit(0.0)).alias("mean_degree"),
    )


def modularity(
    edges: DataFrame,
    membership: DataFrame,
    resolution: float = 1.0,
    use_weights: bool = True,
) -> DataFrame:
    """One row ``modularity``: sum over communities of inner share minus squared degree share.

    Two joins label the edge ends; all sums are per community. Fewer than two communities give 0.
    """
    weight = F.col("weight") if use_weights else F.lit(1.0)
    a = membership.select(F.col("item_id").alias("src"), F.col("community").alias("ca"))
    b = membership.select(F.col("item_id").alias("dst"), F.col("community").alias("cb"))
    labelled = edges.join(a, "src").join(b, "dst").select("ca", "cb", weight.alias("w"))
    shares = F.array(
        F.struct(F.col("ca").alias("community"), F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("inner"), F.col("w").alias("degree")),
        F.struct(F.col("cb").alias("community"), F.lit(0.0).alias("inner"), F.col("w").alias("degree")),
    )
    per_community = (
        labelled.select(F.explode(shares).alias("s"))
        .groupBy("s.community")
        .agg(F.sum("s.inner").alias("inner"), F.sum("s.degree").alias("degree"))
    )
    sums = per_community.agg(
        F.sum("inner").alias("inner"),
        F.sum("degree").alias("twice"),
        F.sum(F.col("degree") * F.col("degree")).alias("squares"),
    )
    n_communities = membership.agg(F.count_distinct("community").alias("n"))
    value = F.col("inner") / (F.col("twice") / 2) - F.lit(resolution) * F.col("squares") / (
        F.col("twice") * F.col("twice")
    )
    return sums.withColumn("n", n_communities.scalar()).select(
        F.when((F.col("n") < 2) | F.col("twice").isNull(), 0.0).otherwise(value).alias("modularity")
    )
