"""Linking items to an outside catalogue by fuzzy names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vector_atlas.functions.cells import clean_text
from vector_atlas.functions.names import normalize_name, token_set_ratio
from vector_atlas.functions.tags import strip
from vector_atlas.operators.joins import pending_ids, upsert_keep_last
from vector_atlas.schemas import MATCHES_SCHEMA
from vector_atlas.session import materialise

ARTIST_THRESHOLD = 80.0
TITLE_THRESHOLD = 80.0
ARTIST_WEIGHT = 0.5
TITLE_WEIGHT = 0.5


def catalogue_search_key(queries: DataFrame) -> DataFrame:
    """Add ``search_key``, or the ``reason`` why a row has to be skipped."""
    def term(c):
        return strip(F.replace(clean_text(c), F.lit('"'), F.lit("")))

    artist, title = F.col("__artist"), F.col("__title")
    reason = F.when(artist == "", "artist must not be empty").when(title == "", "title must not be empty")
    key = F.concat(F.lit('artist:"'), artist, F.lit('" track:"'), title, F.lit('"'))
    return (
        queries.withColumns({"__artist": term("artist"), "__title": term("title")})
        .withColumn("reason", reason)
        .withColumn("search_key", F.when(F.col("reason").isNull(), key))
        .drop("__artist", "__title")
    )


def name_similarity(pairs: DataFrame) -> DataFrame:
    """``left_name, right_name, ratio`` for every distinct pair of raw names in ``pairs``."""
    pairs = pairs.select("left_name", "right_name").distinct()
    pairs = normalize_name(pairs, "left_name", "__left")
    pairs = normalize_name(pairs, "right_name", "__right")
    return token_set_ratio(pairs, "__left", "__right", "ratio").select("left_name", "right_name", "ratio")


def score_candidate(
    rows: DataFrame, artist_weight: float = ARTIST_WEIGHT, title_weight: float = TITLE_WEIGHT
) -> DataFrame:
    """Add ``score``: the weighted mean of the two ratios."""
    blended = (F.col("artist_score") * artist_weight + F.col("title_score") * title_weight) / (
        artist_weight + title_weight
    )
    return rows.withColumn("score", blended)


def compare_names(candidates: DataFrame, weights=(ARTIST_WEIGHT, TITLE_WEIGHT)) -> DataFrame:
    """Add ``artist_score, title_score, score`` to ``(query_artist, query_title, cand_artist, cand_title)``.

    Names repeat far more often than candidates do, so the Python step sees each distinct
    pair of names once; artist and title pairs share one comparison, which is written out
    because both joins (and the threshold filters pushed below them) read it.
    """
    filled = candidates.withColumns(
        {c: clean_text(c) for c in ("query_artist", "query_title", "cand_artist", "cand_title")}
    )
    both = F.array(
        F.struct(F.col("query_artist").alias("left_name"), F.col("cand_artist").alias("right_name")),
        F.struct(F.col("query_title").alias("left_name"), F.col("cand_title").alias("right_name")),
    )
    ratios = materialise(name_similarity(filled.select(F.explode(both).alias("p")).select("p.*")), "name-ratios")

    def attach(df, left, right, target):
        return df.join(
            ratios.select(F.col("left_name").alias(left), F.col("right_name").alias(right), F.col("ratio").alias(target)),
            [left, right],
        )

    scored = attach(filled, "query_artist", "cand_artist", "artist_score")
    scored = attach(scored, "query_title", "cand_title", "title_score")
    return score_candidate(scored, *weights)


def pick_best(
    scored: DataFrame,
    key: str,
    artist_threshold: float = ARTIST_THRESHOLD,
    title_threshold: float = TITLE_THRESHOLD,
) -> DataFrame:
    """Best qualifying candidate per key: score, then rank (null counts as -1), then position."""
    order = Window.partitionBy(key).orderBy(
        F.desc("score"), F.desc(F.coalesce("cand_rank", F.lit(-1))), "position"
    )
    return (
        scored.where((F.col("artist_score") >= artist_threshold) & (F.col("title_score") >= title_threshold))
        .withColumn("__n", F.row_number().over(order))
        .where("__n = 1")
        .drop("__n")
    )


def best_match(queries: DataFrame, candidates: DataFrame, key: str = "song_id", **options) -> DataFrame:
    """``queries(key, artist, title)`` with ``candidates(key, position, candidate struct)``.

    Returns the winning row per query; queries without a qualifying candidate are absent.
    """
    weights = options.pop("weights", (ARTIST_WEIGHT, TITLE_WEIGHT))
    pairs = queries.select(
        key, F.col("artist").alias("query_artist"), F.col("title").alias("query_title")
    ).join(candidates.hint("merge"), key)
    pairs = pairs.withColumns(
        {
            "cand_artist": F.col("candidate.artist.name"),
            "cand_title": F.col("candidate.title"),
            "cand_rank": F.col("candidate.rank"),
        }
    )
    return pick_best(compare_names(pairs, weights), key, **options)


def match_names(asked: DataFrame, candidates: DataFrame, **options) -> DataFrame:
    """Best candidate per distinct ``(artist, title)`` of ``asked(search_key, artist, title)``.

    ``candidates(search_key, position, candidate)`` holds the search results of each key. Equal
    names are compared once, whatever the number of rows that carry them.
    """
    names = asked.select("search_key", "artist", "title").distinct().withColumn("name_key", name_key())
    found = names.select("name_key", "search_key").join(candidates.hint("merge"), "search_key").drop("search_key")
    return best_match(names.select("name_key", "artist", "title"), found, key="name_key", **options)


def name_key():
    return F.concat_ws("\u0001", "artist", "title")


def match_rows(queries: DataFrame, best: DataFrame) -> DataFrame:
    """Rows in the stored layout; a miss carries only its id and ``matched = false``."""
    c = "candidate"
    hit = best.select(
        "name_key",
        F.lit(True).alias("matched"),
        F.col(f"{c}.id").alias("deezer_id"),
        F.col(f"{c}.artist.name").alias("deezer_artist"),
        F.col(f"{c}.title").alias("deezer_title"),
        *[F.col(f"{c}.{n}").alias(n) for n in ("isrc", "link", "rank", "duration")],
        *[F.col(f"{c}.album.cover_{s}").alias(f"cover_{s}") for s in ("small", "medium", "big", "xl")],
        *[F.col(f"{c}.artist.picture_{s}").alias(f"artist_picture_{s}") for s in ("small", "medium", "big", "xl")],
        *[F.round(n, 2).alias(n) for n in ("score", "artist_score", "title_score")],
    )
    rows = queries.select("song_id", name_key().alias("name_key")).join(hit, "name_key", "left")
    return rows.withColumn("matched", F.coalesce("matched", F.lit(False))).select(*MATCHES_SCHEMA.fieldNames())


def match_catalogue(
    tracks: DataFrame,
    candidates: DataFrame,
    existing: DataFrame | None = None,
    force: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Link pending tracks to ``candidates(search_key, position, candidate)``.

    Returns ``(all match rows, skipped)``; skipped rows carry a reason and are not stored,
    so a later run tries them again.
    """
    existing = None if force else existing
    queries = tracks.select(
        "song_id", strip(clean_text("artist")).alias("artist"), strip(clean_text("title")).alias("title")
    )
    keyed = catalogue_search_key(pending_ids(queries, existing))
    skipped = keyed.where(F.col("reason").isNotNull()).select("song_id", "reason")
    asked = keyed.where(F.col("reason").isNull())
    fresh = match_rows(asked, match_names(asked, candidates))
    return upsert_keep_last(existing, fresh), skipped
