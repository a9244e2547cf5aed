"""Seed selection, result shaping and ranking checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vector_atlas.config import TIME_RANGES, PlaylistConfig
from vector_atlas.operators.neighbours import retrieve_top_k
from vector_atlas.operators.profile import pool_max

MAX_LIMIT = 50

# Look-back of each window in days. The lengths are ours: the reference delegates both the
# window and the ranking to a remote service.
WINDOW_DAYS = {"short_term": 7, "medium_term": 14, "long_term": 365}


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be within 1..{MAX_LIMIT}, got {limit}")
    return limit


def _first_rows(df: DataFrame, order: list, limit: int, target: str = "position") -> DataFrame:
    """First rows per user; Spark limits each group before the shuffle, so hot users stay small."""
    by_user = Window.partitionBy("user_id").orderBy(*order)
    return df.withColumn(target, F.row_number().over(by_user)).where(F.col(target) <= limit)


def recent_seeds(history: DataFrame, limit: int = 20) -> DataFrame:
    """``user_id, item_id, ts, position``: the latest plays of every user, repeats kept."""
    rows = history.select("user_id", "item_id", "ts")
    return _first_rows(rows, [F.desc("ts"), "item_id"], check_limit(limit))


def top_seeds(history: DataFrame, time_range: str = "medium_term", limit: int = 20) -> DataFrame:
    """``user_id, item_id, plays, position``: most played items inside a window.

    The window ends at the newest event of the table, found by a scalar subquery.
    """
    if time_range not in TIME_RANGES:
        raise ValueError(f"time_range must be one of {sorted(TIME_RANGES)}, got {time_range!r}")
    newest = history.agg(F.max("ts").alias("ts"))
    start = newest.select(F.col("ts") - F.expr(f"INTERVAL {WINDOW_DAYS[time_range]} DAYS")).scalar()
    plays = history.where(F.col("ts") >= start).groupBy("user_id", "item_id").agg(F.count("*").alias("plays"))
    return _first_rows(plays, [F.desc("plays"), "item_id"], check_limit(limit))


def playlist_seeds(items: DataFrame, limit: int = 20) -> DataFrame:
    """First usable entries of each list: ``items`` carries ``user_id`` and ``position``."""
    ordered = items.withColumnRenamed("position", "entry")
    return _first_rows(ordered, ["entry"], check_limit(limit))


def similarity_results(hits: DataFrame, n: int) -> DataFrame:
    """First n hits per query with a rounded fit and no reason."""
    return hits.where(F.col("rank") <= n).select(
        "query_id", "item_id", "rank", F.round("score", 4).alias("fit"), F.lit("").alias("reason")
    )


def retrieve_pool(seeds: DataFrame, index: DataFrame, config: PlaylistConfig = PlaylistConfig(), **limits) -> DataFrame:
    """``request_id, item_id, score, support`` from ``seeds(request_id, seed_id, embedding, corpus_id)``.

    The neighbours of a seed depend on the seed alone. They are searched once per distinct
    seed, whatever the number of requests that share it, and joined back.
    """
    distinct = seeds.select("seed_id", "embedding", "corpus_id").dropDuplicates(["seed_id"])
    queries = distinct.select(F.col("seed_id").alias("query_id"), "embedding")
    exclude = distinct.where(F.col("corpus_id").isNotNull()).select(
        F.col("seed_id").alias("query_id"), F.col("corpus_id").alias("item_id")
    )
    hits = retrieve_top_k(queries, index, config.per_seed, exclude, **limits)
    scored = seeds.select("request_id", "seed_id").join(
        hits.select(F.col("query_id").alias("seed_id"), "item_id", "score").hint("shuffle_hash"), "seed_id"
    )
    return pool_max(scored)


def rank_checks(ranking: DataFrame, pool: DataFrame) -> DataFrame:
    """One row: number of ranking rows, and of rows whose id is not in the request's pool."""
    known = pool.select("request_id", "item_id").distinct().withColumn("__known", F.lit(True))
    return ranking.join(known.hint("merge"), ["request_id", "item_id"], "left").agg(
        F.count("*").alias("n_rows"), F.count(F.when(F.col("__known").isNull(), 1)).alias("n_unknown")
    )


def rank_items(ranking: DataFrame, pool: DataFrame) -> DataFrame:
    """Checked ranking with a dense ``position`` per request, by rank then id."""
    found = rank_checks(ranking, pool).first()
    if not found["n_rows"]:
        raise ValueError("ranking has no rows")
    if found["n_unknown"]:
        raise ValueError(f"ranking names {found['n_unknown']} ids outside the pool")
    return positioned(ranking)


def positioned(ranking: DataFrame) -> DataFrame:
    order = Window.partitionBy("request_id").orderBy("rank", "item_id")
    return ranking.withColumn("position", F.row_number().over(order))


def fit_floor(ranking: DataFrame, n: int, config: PlaylistConfig = PlaylistConfig()) -> DataFrame:
    """Rows at or above the floor, renumbered and cut at n; every row carries the dropped count."""
    n = min(n, config.max_seeds)
    request = Window.partitionBy("request_id")
    low = F.count(F.when(F.col("fit") < config.fit_floor, 1)).over(request)
    kept = ranking.withColumn("dropped", low).where(F.col("fit") >= config.fit_floor)
    return positioned(kept).where(F.col("position") <= n)
