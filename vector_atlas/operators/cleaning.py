"""Cleaning and filtering of the tracks table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vector_atlas import schemas
from vector_atlas.config import TAG_GROUP_COLUMNS, FilterConfig
from vector_atlas.functions import tags
from vector_atlas.functions.cells import audio_path

MISSING_AUDIO = "missing audio"


def clean_tracks(tracks: DataFrame, taxonomy=None, excluded=None) -> DataFrame:
    """Lower-case the free tags and derive the main genre, in one projection."""
    taxonomy = tags.GENRE_TAXONOMY if taxonomy is None else taxonomy
    excluded = tags.EXCLUDED_GENRES if excluded is None else excluded
    changes = {c: tags.lower_tags(c) for c in tags.LOWERED_COLUMNS}
    changes["genre_main"] = tags.main_genres("genre", taxonomy, excluded)
    return tracks.withColumns(changes)


def select_columns(tracks: DataFrame, groups, include_weights: bool = True) -> DataFrame:
    """Base columns plus those of each requested tag group, in request order."""
    unknown = [g for g in groups if g not in schemas.GROUP_COLUMNS]
    if unknown:
        raise ValueError(f"unknown tag groups {unknown}; known: {sorted(schemas.GROUP_COLUMNS)}")
    wanted = list(schemas.BASE_COLUMNS)
    for group in dict.fromkeys(groups):
        wanted += schemas.GROUP_COLUMNS[group]
        if include_weights:
            wanted += schemas.GROUP_WEIGHTS[group]
    schemas.require_columns(tracks, wanted, "tracks table")
    return tracks.select(*wanted)


def tag_drop_reason(groups):
    """First required group whose column is blank, as a reason text; null when none is."""
    reason = F.lit(None).cast("string")
    for group in reversed(tuple(groups)):
        reason = F.when(tags.is_blank(TAG_GROUP_COLUMNS[group]), f"missing {group}").otherwise(reason)
    return reason


def mark_drops(tracks: DataFrame, config: FilterConfig, audio_files: DataFrame | None = None) -> DataFrame:
    """Add ``drop_reason``. One pass marks blank tags in order; one join marks missing files.

    ``audio_files(quadrant, song_id)`` is a listing; its keys are made unique first, so the
    join cannot multiply rows.
    """
    needed = ["song_id", "quadrant"] + [TAG_GROUP_COLUMNS[g] for g in config.required_groups]
    schemas.require_columns(tracks, needed, "tracks table")
    marked = tracks.withColumn("drop_reason", tag_drop_reason(config.required_groups))
    if audio_files is None:
        return marked
    present = audio_files.select("quadrant", "song_id").distinct().withColumn("__present", F.lit(True))
    return (
        marked.join(present, ["quadrant", "song_id"], "left")
        .withColumn(
            "drop_reason",
            F.when(F.col("drop_reason").isNull() & F.col("__present").isNull(), MISSING_AUDIO).otherwise(
                F.col("drop_reason")
            ),
        )
        .select(*tracks.columns, "drop_reason")
    )


def filter_required_tags(tracks: DataFrame, groups) -> DataFrame:
    config = FilterConfig(required_groups=tuple(groups))
    return mark_drops(tracks, config).where("drop_reason is null").drop("drop_reason")


def filter_has_audio(tracks: DataFrame, audio_files: DataFrame) -> DataFrame:
    return tracks.join(audio_files.select("quadrant", "song_id"), ["quadrant", "song_id"], "left_semi").select(
        *tracks.columns
    )


def sample_key(seed: int, key: str = "song_id"):
    """Repeatable draw: a digest of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_n(tracks: DataFrame, size: int, seed: int = 7, key: str = "song_id") -> DataFrame:
    """Exactly ``size`` rows (all when fewer), the same ones under any partitioning.

    The n smallest digests are kept by a distributed top-n; the id restores a stable order.
    """
    if size <= 0:
        raise ValueError(f"sample size must be positive, got {size}")
    return tracks.orderBy(sample_key(seed, key), key).limit(size).orderBy(key)


def filter_stats(marked: DataFrame, sample_size: int | None = None) -> DataFrame:
    """One row: total, kept before and after sampling, and dropped counts per reason."""
    by_reason = marked.groupBy("drop_reason").agg(F.count("*").alias("n"))
    dropped = F.col("drop_reason").isNotNull()
    entries = F.array_sort(F.collect_list(F.when(dropped, F.struct("drop_reason", "n"))))
    stats = by_reason.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(~dropped, F.col("n"))), F.lit(0)).alias("kept_before_sample"),
        F.map_from_entries(entries).alias("dropped"),
    )
    kept = F.col("kept_before_sample")
    if sample_size is not None:
        kept = F.least(kept, F.lit(sample_size))
    return stats.withColumn("kept", kept)


def filter_summary(stats: DataFrame, config: FilterConfig) -> DataFrame:
    """Add the one-line ``summary``; reasons appear in the order they are tested."""
    lost = F.col("total") - F.col("kept_before_sample")
    order = [f"missing {g}" for g in dict.fromkeys(config.required_groups)] + [MISSING_AUDIO]
    parts = F.array_compact(
        F.array(
            *[
                F.when(
                    F.try_element_at("dropped", F.lit(r)).isNotNull(),
                    F.concat(F.try_element_at("dropped", F.lit(r)).cast("string"), F.lit(f" {r}")),
                )
                for r in order
            ]
        )
    )
    text = F.concat(F.lit("kept "), F.col("kept_before_sample"), F.lit("/"), F.col("total"))
    text = F.when(
        lost > 0, F.concat(text, F.lit("; dropped "), lost, F.lit(" ("), F.array_join(parts, ", "), F.lit(")"))
    ).otherwise(text)
    text = F.when(
        F.col("kept") != F.col("kept_before_sample"), F.concat(text, F.lit("; sampled to "), F.col("kept"))
    ).otherwise(text)
    return stats.withColumn("summary", text)


def filter_tracks(tracks: DataFrame, config: FilterConfig, audio_files: DataFrame | None = None):
    """``(kept tracks, one-row stats)``; both read the same marked rows."""
    marked = mark_drops(tracks, config, audio_files)
    kept = marked.where("drop_reason is null").drop("drop_reason")
    if config.sample_size is not None:
        kept = sample_n(kept, config.sample_size, config.seed)
    return kept, filter_summary(filter_stats(marked, config.sample_size), config)


def resolve_audio_path(tracks: DataFrame, audio_dir: str) -> DataFrame:
    schemas.require_columns(tracks, ["song_id"], "tracks table")
    return tracks.withColumn("path", audio_path(audio_dir, tracks.columns))
