"""Parquet stores for vectors, graphs, clusters, metrics and matches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vector_atlas import schemas
from vector_atlas.sources.versions import merge_into, read_table, replace_table


@dataclass(frozen=True)
class VectorIndex:
    """Unit vectors plus the one-row description needed to prepare queries."""

    vectors: DataFrame
    meta: DataFrame


def _conform(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_vectors(vectors: DataFrame, meta: DataFrame, path: str) -> str:
    _conform(vectors, schemas.VECTORS_SCHEMA).write.mode("overwrite").parquet(f"{path}/vectors")
    _conform(meta, schemas.VECTOR_META_SCHEMA).write.mode("overwrite").parquet(f"{path}/meta")
    return path


def read_vectors(spark: SparkSession, path: str) -> VectorIndex:
    """Vectors are normalised again on read; absent flags count as set, name falls back to the folder."""
    from vector_atlas.operators.vectors import l2_normalize

    stored = spark.read.schema(schemas.VECTORS_SCHEMA).parquet(f"{path}/vectors")
    meta = spark.read.schema(schemas.VECTOR_META_SCHEMA).parquet(f"{path}/meta")
    stem = path.rstrip("/").rsplit("/", 1)[-1]
    meta = meta.select(
        "mean",
        F.coalesce("center", F.lit(True)).alias("center"),
        F.coalesce("normalize", F.lit(True)).alias("normalize"),
        F.coalesce("name", F.lit(stem)).alias("name"),
        "model_id",
        "sample_rate",
    )
    return VectorIndex(l2_normalize(stored, floor=1e-12), meta)


def write_graph(edges: DataFrame, membership: DataFrame, path: str) -> str:
    _conform(edges, schemas.EDGES_SCHEMA).write.mode("overwrite").parquet(f"{path}/edges")
    _conform(membership, schemas.MEMBERSHIP_SCHEMA).write.mode("overwrite").parquet(f"{path}/membership")
    return path


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.schema(schemas.EDGES_SCHEMA).parquet(f"{path}/edges"),
        spark.read.schema(schemas.MEMBERSHIP_SCHEMA).parquet(f"{path}/membership"),
    )


def clusters_table(membership: DataFrame, labels: DataFrame, coords: DataFrame) -> DataFrame:
    """``song_id, community, label, x, y``; a community without label gets an empty one."""
    return (
        membership.join(labels, "community", "left")
        .join(coords.hint("merge"), "item_id", "left")
        .select(
            F.col("item_id").alias("song_id"),
            F.col("community").cast("long").alias("community"),
            F.coalesce("label", F.lit("")).alias("label"),
            F.col("x").cast("double").alias("x"),
            F.col("y").cast("double").alias("y"),
        )
    )


def write_clusters(clusters: DataFrame, path: str) -> str:
    _conform(clusters, schemas.CLUSTERS_SCHEMA).write.mode("overwrite").parquet(path)
    return path


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CLUSTERS_SCHEMA).parquet(path)


def upsert_metrics(existing: DataFrame | None, section: DataFrame) -> DataFrame:
    """Replace whole (model, section) groups by new rows; NaN and infinities become null."""
    value = F.col("value")
    fresh = section.select(
        "model",
        "section",
        "metric",
        F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value).alias("value"),
    )
    if existing is None:
        return fresh
    replaced = fresh.select("model", "section").distinct()
    return existing.join(replaced, ["model", "section"], "left_anti").unionByName(fresh)


def write_metrics(spark: SparkSession, section: DataFrame, path: str) -> str:
    """Merge the sections of ``section`` into the store; buckets of other sections keep their files."""
    def merged(existing, fresh):
        return _conform(upsert_metrics(existing, fresh), schemas.METRICS_SCHEMA)

    merge_into(_conform(section, schemas.METRICS_SCHEMA), path, ["model", "section"], merged)
    return path


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    return read_table(spark, path)


def metrics_document(metrics: DataFrame) -> DataFrame:
    """One JSON text per model: section -> metric -> value (bounded by the number of metrics)."""
    per_section = metrics.groupBy("model", "section").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("values")
    )
    def by_section(a, b):  # maps have no order of their own
        return F.when(a["section"] < b["section"], -1).when(a["section"] > b["section"], 1).otherwise(0)

    entries = F.array_sort(F.collect_list(F.struct("section", "values")), by_section)
    return per_section.groupBy("model").agg(
        F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("document")
    )


def write_matches(matches: DataFrame, path: str) -> str:
    """The store with exactly these rows, as a new version."""
    replace_table(_conform(matches, schemas.MATCHES_SCHEMA), path, ["song_id"])
    return path


def merge_matches(matches: DataFrame, path: str) -> str:
    """Add rows to the store, in place of earlier rows of the same songs."""
    from vector_atlas.operators.joins import upsert_keep_last

    def merged(existing, fresh):
        return _conform(upsert_keep_last(existing, fresh, "song_id"), schemas.MATCHES_SCHEMA)

    merge_into(_conform(matches, schemas.MATCHES_SCHEMA), path, ["song_id"], merged)
    return path


def read_matches(spark: SparkSession, path: str) -> DataFrame | None:
    """Earlier match rows with a typed flag (null counts as not matched), or None."""
    rows = read_table(spark, path)
    return None if rows is None else rows.withColumn("matched", F.coalesce("matched", F.lit(False)))
