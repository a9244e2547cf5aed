"""Scalar helpers over single cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vector_atlas.functions.tags import _col, strip

# fixed values: public share links and URIs
TRACK_REF = r"(?:open\.spotify\.com/track/|spotify:track:)([A-Za-z0-9]+)"
PLAYLIST_REF = r"(?:open\.spotify\.com/playlist/|spotify:playlist:)([A-Za-z0-9]+)"


def clean_text(c) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def clean_number(c) -> Column:
    """Null when absent, NaN or not a number, else rounded to four digits."""
    number = _col(c).try_cast("double")
    return F.when(~F.isnan(number), F.round(number, 4))


def parse_ref_id(c, kind: str = "track") -> Column:
    """Id inside a share link or URI; any other input is only trimmed."""
    pattern = {"track": TRACK_REF, "playlist": PLAYLIST_REF}[kind]
    found = F.regexp_extract(_col(c), pattern, 1)
    return F.when(found != "", found).otherwise(strip(c))


def audio_path(audio_dir: str, columns) -> Column:
    """Location of an item's file: explicit path, else by quadrant, else by id."""
    root = F.lit(audio_dir.rstrip("/"))
    name = F.concat(F.col("song_id"), F.lit(".mp3"))
    if "quadrant" in columns:
        derived = F.concat_ws("/", root, F.coalesce(F.col("quadrant"), F.lit("nan")), name)
    else:
        derived = F.concat_ws("/", root, name)
    if "audio_path" not in columns:
        return derived
    given = F.col("audio_path")
    return (
        F.when(given.isNull(), derived)
        .when(given.startswith("/"), given)
        .otherwise(F.concat_ws("/", root, given))
    )


def seed_label(artist, title) -> Column:
    return F.concat(F.coalesce(F.nullif(_col(artist), F.lit("")), F.lit("?")), F.lit(" - "), clean_text(title))
