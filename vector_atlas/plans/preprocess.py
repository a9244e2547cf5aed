"""From raw metadata and arousal/valence to the cleaned tracks table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vector_atlas.config import FilterConfig
from vector_atlas.operators.cleaning import clean_tracks, filter_tracks
from vector_atlas.operators.joins import join_one_to_one
from vector_atlas.schemas import TABLE_COLUMNS
from vector_atlas.sources.files import audio_listing
from vector_atlas.sources.tables import scan_av, scan_metadata, write_tracks


def prepare_tracks(
    metadata: DataFrame,
    av: DataFrame,
    audio_files: DataFrame | None = None,
    config: FilterConfig = FilterConfig(),
    taxonomy=None,
    excluded=None,
) -> tuple[DataFrame, DataFrame]:
    """``(tracks, one-row stats)`` as one plan behind one validation job."""
    joined = join_one_to_one(metadata, av, "song_id")
    kept, stats = filter_tracks(clean_tracks(joined, taxonomy, excluded), config, audio_files)
    return kept.select(*TABLE_COLUMNS), stats


def preprocess(
    spark: SparkSession,
    metadata_path: str,
    av_path: str,
    audio_dir: str,
    output_path: str,
    config: FilterConfig = FilterConfig(),
    fmt: str = "parquet",
) -> DataFrame:
    """Read, clean, filter and write; returns the one-row stats."""
    tracks, stats = prepare_tracks(
        scan_metadata(spark, metadata_path),
        scan_av(spark, av_path),
        audio_listing(spark, audio_dir),
        config,
    )
    write_tracks(tracks, output_path, fmt)
    return stats
