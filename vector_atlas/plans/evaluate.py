"""All quality sections of a model as one long metrics table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vector_atlas.config import ClusterConfig
from vector_atlas.operators import quality
from vector_atlas.operators.joins import align_coords, attach_tracks
from vector_atlas.operators.profile import union_all
from vector_atlas.sources.stores import upsert_metrics, write_metrics

PROJECTION_K = 15


def as_metrics(row: DataFrame, model: str, section: str) -> DataFrame:
    """A one-row report as ``(model, section, metric, value)`` rows; flags count as 0 and 1."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]
    )
    return row.select(F.explode(cells).alias("e")).select(
        F.lit(model).alias("model"), F.lit(section).alias("section"), "e.metric", "e.value"
    )


def coherence_metrics(coherence: DataFrame, model: str) -> DataFrame:
    """Means of the section plus one entry per community and value."""
    per_label = F.array(
        *[
            F.struct(
                F.concat(F.lit("labels."), F.col("community").cast("string"), F.lit(f".{c}")).alias("metric"),
                F.col(c).cast("double").alias("value"),
            )
            for c in ("size", *quality.COHERENCE_METRICS)
        ]
    )
    labels = coherence.select(F.explode(per_label).alias("e")).select(
        F.lit(model).alias("model"), F.lit("coherence").alias("section"), "e.metric", "e.value"
    )
    return as_metrics(quality.semantic_quality(coherence), model, "coherence").unionByName(labels)


def size_metrics(membership: DataFrame, model: str, section: str) -> DataFrame:
    """One entry per cluster size."""
    return quality.cluster_sizes(membership).select(
        F.lit(model).alias("model"),
        F.lit(section).alias("section"),
        F.concat(F.lit("sizes."), F.col("community").cast("string")).alias("metric"),
        F.col("size").cast("double").alias("value"),
    )


def sections(
    vectors: DataFrame,
    edges: DataFrame,
    clusters: DataFrame,
    tracks: DataFrame,
    model: str,
    config: ClusterConfig = ClusterConfig(),
) -> dict[str, DataFrame]:
    """Metrics per section, in the order they are stored. ``edges`` is undirected."""
    membership = clusters.select(F.col("song_id").alias("item_id"), "community")
    coords = clusters.select(F.col("song_id").alias("item_id"), "x", "y")
    placed = align_coords(vectors, coords)
    merged = attach_tracks(clusters.select("song_id", "community"), tracks)
    coherence = quality.label_coherence(merged.drop("community"), membership)
    return {
        "embed": as_metrics(quality.embedding_sanity(vectors), model, "embed"),
        "topology": as_metrics(
            quality.graph_quality(edges, membership, config.communities.resolution, directed=False), model, "topology"
        ).unionByName(size_metrics(membership, model, "topology")),
        "cluster": as_metrics(quality.cluster_quality(vectors, membership), model, "cluster").unionByName(
            size_metrics(membership, model, "cluster")
        ),
        "coherence": coherence_metrics(coherence, model),
        "manifold": as_metrics(
            quality.projection_quality(vectors, placed.select("item_id", "x", "y"), PROJECTION_K), model, "manifold"
        ),
    }


def evaluate_all(vectors, edges, clusters, tracks, model: str, config=ClusterConfig(), existing=None) -> DataFrame:
    """Metrics table with every section of ``model`` replaced."""
    fresh = union_all(sections(vectors, edges, clusters, tracks, model, config).values())
    return upsert_metrics(existing, fresh)


def run_evaluation(spark: SparkSession, path: str, *args, **options) -> str:
    """Store the sections one after the other under ``path``."""
    for section in sections(*args, **options).values():
        write_metrics(spark, section, path)
    return path
