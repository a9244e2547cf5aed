"""File listings: which audio files exist, and whether file contents match checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _list(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )


def audio_listing(spark: SparkSession, root: str, pattern: str = "*.mp3") -> DataFrame:
    """``quadrant, song_id, length`` of existing ``<quadrant>/<id>.mp3`` files; contents are not read."""
    files = _list(spark, root, pattern).select("path", "length")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.select(
        F.element_at(parts, -2).alias("quadrant"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("song_id"),
        "length",
    )


def checksum_audit(spark: SparkSession, root: str, expected: DataFrame, pattern: str = "*") -> DataFrame:
    """Compare md5 sums of files with ``expected(name, checksum)``.

    A checksum may carry an ``md5:`` prefix and any case or surrounding space. Status is
    ``ok``, ``mismatch`` or ``missing``.
    """
    actual = _list(spark, root, pattern).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("actual")
    )
    wanted = expected.select(
        "name",
        F.regexp_replace(F.lower(F.trim("checksum")), r"^md5:\s*", "").alias("expected"),
    )
    return wanted.join(actual, "name", "left").select(
        "name",
        "expected",
        "actual",
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") == F.col("expected"), "ok")
        .otherwise("mismatch")
        .alias("status"),
    )
