"""Vectors to graph, communities, layout, labels and the clusters table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from vector_atlas.config import ClusterConfig
from vector_atlas.operators.communities import detect_communities, partition_quality
from vector_atlas.operators.graph import directed_affinity, symmetrize_graph
from vector_atlas.operators.layout import layout_2d
from vector_atlas.operators.neighbours import knn_join
from vector_atlas.operators.profile import cluster_run_summary, top_tags
from vector_atlas.operators.vectors import validate_vectors
from vector_atlas.session import materialise
from vector_atlas.sources.stores import clusters_table, write_clusters, write_graph


@dataclass(frozen=True)
class ClusteredSpace:
    clusters: DataFrame
    edges: DataFrame
    membership: DataFrame
    coords: DataFrame
    summary: DataFrame


def cluster_space(
    vectors: DataFrame,
    tracks: DataFrame,
    config: ClusterConfig = ClusterConfig(),
    model: str = "default",
    **limits,
) -> ClusteredSpace:
    """One neighbour search serves graph and layout; the longer list holds the shorter one."""
    n = validate_vectors(vectors, max(config.knn.k, config.layout.n_neighbors))
    widest = min(n - 1, max(config.knn.k, config.layout.n_neighbors))
    neighbours = materialise(knn_join(vectors, widest, **limits), "neighbours")
    directed = directed_affinity(neighbours.where(neighbours["rank"] <= config.knn.k))
    edges = materialise(symmetrize_graph(directed, config.knn.mode), "edges")
    membership = materialise(
        detect_communities(vectors.select("item_id"), edges, config.communities), "membership"
    )
    near = neighbours.where(neighbours["rank"] <= config.layout.n_neighbors)
    coords = layout_2d(vectors, config.layout, near)
    labels = top_tags(tracks, membership, config.labels.columns, config.labels.top_n)
    clusters = clusters_table(membership, labels, coords)
    quality = partition_quality(edges, membership, config.communities)
    return ClusteredSpace(clusters, edges, membership, coords, cluster_run_summary(membership, edges, quality, model))


def run_cluster_space(vectors: DataFrame, tracks: DataFrame, out: str, config=ClusterConfig(), model="default") -> DataFrame:
    """The job with its two outputs under ``out``; returns the one-row summary."""
    space = cluster_space(vectors, tracks, config, model)
    write_clusters(space.clusters, f"{out}/{model}_clusters")
    write_graph(space.edges, space.membership, f"{out}/{model}_graph")
    return space.summary
