"""Validated joins, id filters and keep-last merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vector_atlas.functions.cells import clean_text
from vector_atlas.functions.tags import strip


def one_to_one_checks(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: repeated keys on either side, and left rows that find no partner."""
    l = left.groupBy(key).agg(F.count("*").alias("nl"))
    r = right.groupBy(key).agg(F.count("*").alias("nr"))
    return l.join(r, key, "full").agg(
        F.count(F.when(F.col("nl") > 1, 1)).alias("repeated_left"),
        F.count(F.when(F.col("nr") > 1, 1)).alias("repeated_right"),
        F.coalesce(F.sum(F.when(F.col("nr").isNull(), F.col("nl"))), F.lit(0)).alias("lost"),
    )


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails on repeated keys or lost left rows (one validation job)."""
    found = one_to_one_checks(left, right, key).first()
    if found["repeated_left"] or found["repeated_right"]:
        raise ValueError(f"{key} is not unique: {found.asDict()}")
    if found["lost"]:
        raise ValueError(f"join on {key} loses {found['lost']} rows")
    return left.join(right, key)


def pending_ids(inputs: DataFrame, done: DataFrame | None, key: str = "song_id", force: bool = False) -> DataFrame:
    """Inputs that the output table does not hold yet."""
    if done is None or force:
        return inputs
    return inputs.join(done.select(key), key, "left_anti")


def upsert_keep_last(existing: DataFrame | None, new: DataFrame, key: str = "song_id", order: str | None = None) -> DataFrame:
    """Old rows without a newer version, plus the last new row per key; columns may differ."""
    if order is not None:
        last = Window.partitionBy(key).orderBy(F.desc(order))
        new = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    if existing is None:
        return new
    kept = existing.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def select_ids(table: DataFrame, ids: DataFrame, key: str = "song_id") -> DataFrame:
    """Rows whose id is listed; Spark broadcasts the list only when its size allows it."""
    return table.join(ids.select(key), key, "left_semi")


def attach_tracks(clusters: DataFrame, tracks: DataFrame) -> DataFrame:
    return clusters.join(tracks, "song_id", "left")


def coords_checks(vectors: DataFrame, coords: DataFrame) -> DataFrame:
    """One row: how many vectors have no finite coordinates."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    return (
        vectors.select("item_id")
        .join(coords, "item_id", "left")
        .agg(
            F.count("*").alias("n_items"),
            F.count(F.when(~(finite(F.col("x")) & finite(F.col("y"))), 1)).alias("n_missing"),
        )
    )


def align_coords(vectors: DataFrame, coords: DataFrame) -> DataFrame:
    """Coordinates in step with vectors; fails when any is missing or not finite."""
    missing = coords_checks(vectors, coords).first()["n_missing"]
    if missing:
        raise ValueError(f"{missing} vectors have no finite coordinates")
    return vectors.join(coords.select("item_id", "x", "y"), "item_id", "left")


def corpus_match_exact(seeds: DataFrame, tracks: DataFrame) -> DataFrame:
    """Add ``corpus_id``: first track with the same title and artist, case and outer space aside.

    The track side is reduced to one row per name before the join, so popular names do not
    multiply. "First" is the smallest id; blank seed names match nothing.
    """
    def comparable(c):
        return F.lower(strip(clean_text(c)))

    names = (
        tracks.groupBy(comparable("artist").alias("__artist"), comparable("title").alias("__title"))
        .agg(F.min("song_id").alias("corpus_id"))
    )
    usable = (clean_text("artist") != "") & (clean_text("title") != "")
    keyed = seeds.withColumn("__artist", F.when(usable, comparable("artist"))).withColumn(
        "__title", F.when(usable, comparable("title"))
    )
    return keyed.join(names.hint("merge"), ["__artist", "__title"], "left").drop("__artist", "__title")
