"""Explicit table schemas and column layouts; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: source column -> column of the tracks table
METADATA_COLUMNS = {
    "Song": "song_id",
    "Quadrant": "quadrant",
    "Artist": "artist",
    "Title": "title",
    "Duration": "duration",
    "Moods": "mood",
    "MoodsAll": "mood_all",
    "MoodsAllWeights": "mood_all_weights",
    "Genres": "genre",
    "GenreWeights": "genre_weights",
    "Themes": "theme",
    "ThemeWeights": "theme_weights",
    "Styles": "style",
    "StyleWeights": "style_weights",
}
AV_COLUMNS = {"Song": "song_id", "Arousal": "arousal", "Valence": "valence"}

# fixed values: output layout of the tracks table
TABLE_COLUMNS = [
    "song_id", "quadrant", "arousal", "valence", "artist", "title", "duration",
    "mood", "mood_all", "mood_all_weights",
    "genre", "genre_weights", "genre_main",
    "theme", "theme_weights", "style", "style_weights",
]
BASE_COLUMNS = TABLE_COLUMNS[:7]

# fixed values: columns of each tag group, and their weights
GROUP_COLUMNS = {
    "mood": ["mood", "mood_all"],
    "genre": ["genre", "genre_main"],
    "theme": ["theme"],
    "style": ["style"],
}
GROUP_WEIGHTS = {
    "mood": ["mood_all_weights"],
    "genre": ["genre_weights"],
    "theme": ["theme_weights"],
    "style": ["style_weights"],
}

# fixed values: vocabulary name -> raw metadata column
VOCABULARY_COLUMNS = {
    "mood": "Moods",
    "mood_all": "MoodsAll",
    "genre": "Genres",
    "theme": "Themes",
    "style": "Styles",
}

METADATA_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in METADATA_COLUMNS])
AV_SCHEMA = T.StructType(
    [
        T.StructField("Song", T.StringType()),
        T.StructField("Arousal", T.DoubleType()),
        T.StructField("Valence", T.DoubleType()),
    ]
)
_NUMERIC_TRACK_COLUMNS = {"arousal", "valence", "duration"}
TRACKS_SCHEMA = T.StructType(
    [
        T.StructField(c, T.DoubleType() if c in _NUMERIC_TRACK_COLUMNS else T.StringType())
        for c in TABLE_COLUMNS
    ]
)

VECTORS_SCHEMA = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
VECTOR_META_SCHEMA = T.StructType(
    [
        T.StructField("mean", T.ArrayType(T.FloatType())),
        T.StructField("center", T.BooleanType()),
        T.StructField("normalize", T.BooleanType()),
        T.StructField("name", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("sample_rate", T.IntegerType()),
    ]
)
EDGES_SCHEMA = T.StructType(
    [
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)
MEMBERSHIP_SCHEMA = T.StructType(
    [T.StructField("item_id", T.StringType()), T.StructField("community", T.LongType())]
)
CLUSTERS_SCHEMA = T.StructType(
    [
        T.StructField("song_id", T.StringType()),
        T.StructField("community", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)
METRICS_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# fixed values: layout of a catalogue-match row
MATCHES_SCHEMA = T.StructType(
    [
        T.StructField("song_id", T.StringType()),
        T.StructField("matched", T.BooleanType()),
        T.StructField("deezer_id", T.LongType()),
        T.StructField("deezer_artist", T.StringType()),
        T.StructField("deezer_title", T.StringType()),
        T.StructField("isrc", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("rank", T.LongType()),
        T.StructField("duration", T.LongType()),
        T.StructField("cover_small", T.StringType()),
        T.StructField("cover_medium", T.StringType()),
        T.StructField("cover_big", T.StringType()),
        T.StructField("cover_xl", T.StringType()),
        T.StructField("artist_picture_small", T.StringType()),
        T.StructField("artist_picture_medium", T.StringType()),
        T.StructField("artist_picture_big", T.StringType()),
        T.StructField("artist_picture_xl", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("artist_score", T.DoubleType()),
        T.StructField("title_score", T.DoubleType()),
    ]
)

_PICTURES = ("small", "medium", "big", "xl")


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# fixed values: catalogue candidate as returned by the search service
CANDIDATE_STRUCT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("duration", T.LongType()),
        T.StructField("isrc", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("preview", T.StringType()),
        T.StructField("rank", T.LongType()),
        T.StructField(
            "artist",
            T.StructType(
                [T.StructField("id", T.LongType())]
                + _strings("name", "link", *[f"picture_{p}" for p in _PICTURES])
            ),
        ),
        T.StructField(
            "album",
            T.StructType(
                [T.StructField("id", T.LongType())]
                + _strings("title", "link", *[f"cover_{p}" for p in _PICTURES])
            ),
        ),
    ]
)

# fixed values: nested track JSON of the listening service; values of any kind are
# read as their JSON text where the two accepted shapes differ
USER_TRACK_STRUCT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("artists", T.ArrayType(T.StringType())),
        T.StructField("isrc", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("cover_url", T.StringType()),
        T.StructField("preview_url", T.StringType()),
        T.StructField("popularity", T.IntegerType()),
        T.StructField("duration_ms", T.IntegerType()),
        T.StructField("external_ids", T.StructType(_strings("isrc"))),
        T.StructField("external_urls", T.StructType(_strings("spotify"))),
        T.StructField(
            "album",
            T.StructType(
                [T.StructField("images", T.ArrayType(T.StructType(_strings("url"))))]
            ),
        ),
    ]
)


def require_columns(df, columns, what: str = "table") -> None:
    """Fail at analysis time when columns are absent; no job is started."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns {missing}")
