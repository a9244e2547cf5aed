"""Recommendation jobs over tables of requests.

Many requests run as one plan: seeds, retrieval, evidence, ranking and decoration are
joins and per-request limits. A ranker from outside may be plugged in between. Tables that grow with
the input carry a join hint: their files are small beside their rows, so Spark would broadcast them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vector_atlas.config import PlaylistConfig
from vector_atlas.functions.cells import clean_number, clean_text, seed_label
from vector_atlas.functions.tags import split_tags
from vector_atlas.operators.cleaning import resolve_audio_path
from vector_atlas.operators.joins import corpus_match_exact
from vector_atlas.operators.linking import catalogue_search_key, match_names, name_key
from vector_atlas.operators.neighbours import retrieve_top_k
from vector_atlas.operators.ranking import fit_floor, positioned, rank_items, retrieve_pool
from vector_atlas.operators.vectors import Encoder, encode_items, prepare_query
from vector_atlas.session import materialise

EVIDENCE_TAGS = ("style", "mood", "theme")
DESCRIBED_SEEDS = 5
NO_MATCH = "no catalogue match"
RANKING_SCHEMA = "request_id string, item_id string, rank int, fit double, reason string"


@dataclass(frozen=True)
class Corpus:
    """What recommendations are made from: unit vectors, index description, tracks, labels."""

    vectors: DataFrame
    meta: DataFrame
    tracks: DataFrame
    clusters: DataFrame | None = None
    audio_dir: str = "audio"


def decorate_results(results: DataFrame, corpus: Corpus, missing: str = "") -> DataFrame:
    """Add artist, title, region and path to ``results(item_id, ...)`` by left joins.

    Results are few per request, so they are the side that moves; the corpus tables are keyed
    by id and Spark chooses how to join them.
    """
    def shown(c):
        return F.coalesce(c, F.lit(missing))

    tracks = resolve_audio_path(corpus.tracks, corpus.audio_dir).select(
        F.col("song_id").alias("item_id"), shown("artist").alias("artist"), shown("title").alias("title"), "path"
    )
    named = results.join(tracks.hint("merge"), "item_id", "left")
    named = named.withColumns({c: F.coalesce(c, F.lit(missing)) for c in ("artist", "title")})
    if corpus.clusters is None:
        return named.withColumn("region", F.lit(""))
    regions = corpus.clusters.select(F.col("song_id").alias("item_id"), F.col("label").alias("region"))
    return named.join(regions.hint("merge"), "item_id", "left").withColumn("region", F.coalesce("region", F.lit("")))


def more_like_this(ids: DataFrame, corpus: Corpus, k: int = 10, missing: str = "?", **limits) -> DataFrame:
    """Top k for items of the index: ``ids(item_id)`` must all be known; each excludes itself."""
    wanted = ids.select("item_id").distinct()
    unknown = wanted.join(corpus.vectors, "item_id", "left_anti").count()
    if unknown:
        raise ValueError(f"{unknown} items are not in the index")
    queries = corpus.vectors.join(wanted, "item_id", "left_semi").select(F.col("item_id").alias("query_id"), "embedding")
    exclude = queries.select("query_id", F.col("query_id").alias("item_id"))
    return decorate_results(retrieve_top_k(queries, corpus.vectors, k, exclude, **limits), corpus, missing)


# --- seeds -----------------------------------------------------------------------------------


def as_requests(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """``request_id, position, artists, title``: ``plays(user_id, item_id, position)`` as one request per user.

    The plays may be recent ones, top ones of a window, or the entries of a list (``ranking``); entries
    without a track are left out.
    """
    named = tracks.select(F.col("song_id").alias("item_id"), F.array("artist").alias("artists"), "title")
    return plays.join(named.hint("merge"), "item_id").select(F.col("user_id").cast("string").alias("request_id"), "position", "artists", "title")


def resolve_seeds(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """Match ``seeds(request_id, position, artists, title)`` to a catalogue.

    ``candidates(search_key, position, candidate)`` holds the search results per key. Equal
    names are matched once, whatever the number of requests that ask for them. Adds
    ``artist, resolved, catalogue_id, catalogue_artist, catalogue_title, score, reason``.
    """
    named = seeds.withColumn("artist", clean_text(F.get("artists", F.lit(0)))).withColumn("title", clean_text("title"))
    keyed = catalogue_search_key(named).withColumn(
        "reason",
        F.when((F.col("artist") == "") | (F.col("title") == ""), "missing artist/title").otherwise(F.col("reason")),
    )
    best = match_names(keyed.where(F.col("reason").isNull()), candidates).select(
        "name_key",
        F.col("candidate.id").alias("catalogue_id"),
        F.col("cand_artist").alias("catalogue_artist"),
        F.col("cand_title").alias("catalogue_title"),
        "score",
    )
    found = keyed.withColumn("name_key", name_key()).join(best, "name_key", "left")
    usable = F.col("reason").isNull()
    hit = usable & F.col("score").isNotNull()
    for c in ("catalogue_id", "catalogue_artist", "catalogue_title", "score"):
        found = found.withColumn(c, F.when(usable, F.col(c)))
    return (
        found.withColumn("resolved", hit)
        .withColumn("reason", F.when(hit, F.lit(None)).otherwise(F.coalesce("reason", F.lit(NO_MATCH))))
        .drop("name_key", "search_key")
    )


def seed_vectors(resolved: DataFrame, vectors: DataFrame, corpus: Corpus) -> DataFrame:
    """``request_id, seed_id, embedding, corpus_id`` of resolved seeds with a usable vector.

    ``resolved`` is read several times; pass a written table.
    ``vectors(catalogue_id, embedding)`` holds raw vectors of catalogue entries. They are
    prepared once per entry; absent, empty or zero-length-norm vectors drop the seed.
    """
    wanted = resolved.where("resolved").select("request_id", "catalogue_id", "artist", "title")
    named = corpus_match_exact(wanted.select("artist", "title").distinct(), corpus.tracks)
    needed = vectors.join(wanted.select("catalogue_id").distinct(), "catalogue_id", "left_semi")
    prepared = prepare_seed_vectors(needed, corpus.meta)
    return (
        wanted.join(prepared.hint("shuffle_hash"), "catalogue_id")
        .join(named, ["artist", "title"], "left")
        .select(
            "request_id",
            F.concat_ws(":", F.col("catalogue_id").cast("string"), F.coalesce("corpus_id", F.lit(""))).alias("seed_id"),
            "embedding",
            "corpus_id",
        )
    )


def prepare_seed_vectors(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    from vector_atlas.functions import arrays
    from vector_atlas.operators.vectors import l2_normalize

    stored = meta.select(F.when(F.col("center"), F.col("mean").cast("array<double>")).alias("mean"))
    shifted = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).withColumn("__mean", stored.scalar())
    shifted = shifted.where(F.col("__mean").isNull() | (F.size("__mean") == F.size("embedding")))
    centred = shifted.select(
        "catalogue_id",
        F.when(F.col("__mean").isNull(), arrays.doubles("embedding"))
        .otherwise(arrays.subtract("embedding", "__mean"))
        .alias("embedding"),
    )
    return l2_normalize(centred, floor=arrays.ZERO_NORM, strict=False)


def describe_seeds(seeds: DataFrame) -> DataFrame:
    """``request_id, intent``: the first five seeds of each request as one line."""
    return (
        seeds.where(F.col("position") <= DESCRIBED_SEEDS)
        .groupBy("request_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("position", seed_label(F.get("artists", F.lit(0)), "title").alias("name")))
            ).alias("rows")
        )
        .select("request_id", F.concat(F.lit("tracks in the spirit of: "), F.array_join("rows.name", "; ")).alias("intent"))
    )


# --- evidence and ranking ---------------------------------------------------------------------


def build_evidence(pool: DataFrame, tracks: DataFrame) -> DataFrame:
    """Facts per candidate for a ranker; ids without a track are dropped."""
    facts = tracks.select(
        F.col("song_id").alias("item_id"),
        clean_text("title").alias("title"),
        clean_text("artist").alias("artist"),
        clean_number("valence").alias("valence"),
        clean_number("arousal").alias("arousal"),
        *[split_tags(c).alias(c) for c in EVIDENCE_TAGS],
    )
    return pool.select("request_id", "item_id", F.round("score", 4).alias("similarity")).join(facts.hint("merge"), "item_id")


def ranking_payload(intents: DataFrame, evidence: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """``request_id, payload``: one JSON document per request, candidates best first.

    A request has at most seeds x neighbours candidates, so its document is bounded.
    """
    fields = ["title", "artist", "valence", "arousal", "similarity", *EVIDENCE_TAGS]
    candidate = F.struct(F.col("item_id").alias("id"), *fields)
    candidates = evidence.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("o"), F.col("item_id").alias("i"), candidate.alias("c"))))["c"].alias("candidates")
    )
    document = intents.join(candidates.hint("merge"), "request_id")
    parts = ["intent"]
    if seeds is not None:
        listed = seeds.groupBy("request_id").agg(
            F.array_sort(F.collect_list(F.struct("position", F.struct("artist", "title").alias("s"))))["s"].alias("seeds")
        )
        document = document.join(listed.hint("merge"), "request_id", "left")
        parts.append("seeds")
    parts.append("candidates")
    return document.select("request_id", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("payload"))


def similarity_ranking(evidence: DataFrame) -> DataFrame:
    """Default ranker: by similarity, which is also the fit."""
    order = Window.partitionBy("request_id").orderBy(F.desc("similarity"), "item_id")
    return evidence.select(
        "request_id",
        "item_id",
        F.row_number().over(order).alias("rank"),
        F.col("similarity").alias("fit"),
        F.lit("").alias("reason"),
    )


def apply_ranker(evidence: DataFrame, ranker: Callable) -> DataFrame:
    """Run a ranker once per request; it maps a pandas frame of evidence to ranking rows.

    A request's evidence is bounded by seeds x neighbours rows.
    """
    return evidence.groupBy("request_id").applyInPandas(ranker, RANKING_SCHEMA)


def rerank(
    evidence: DataFrame,
    n: int,
    ranking: DataFrame | None = None,
    ranker: Callable | None = None,
    playlist: PlaylistConfig | None = None,
) -> DataFrame:
    """Ranked rows ``request_id, item_id, rank, fit, reason, position`` cut at n.

    ``ranking`` holds rows produced elsewhere; ``ranker`` produces them here; with neither,
    similarity decides. Rows from outside are checked. Playlists apply the fit floor.
    """
    if ranking is None and ranker is not None:
        ranking = materialise(apply_ranker(evidence, ranker), "ranking")
    if ranking is not None:
        ranked = rank_items(ranking, evidence)
    else:
        ranked = positioned(similarity_ranking(evidence))
    if playlist is not None:
        return fit_floor(ranked.drop("position"), n, playlist)
    return ranked.where(F.col("position") <= n)


def recommendations(ranked: DataFrame, corpus: Corpus, n: int) -> DataFrame:
    """First n ranked items per request, decorated."""
    rows = ranked.where(F.col("position") <= n).select("request_id", "item_id", "position", "fit", "reason")
    return decorate_results(rows, corpus).select(
        "request_id", "position", F.col("item_id").alias("song_id"), "artist", "title", "region", "fit", "reason", "path"
    )


# --- whole jobs -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Recommended:
    recommendations: DataFrame
    candidate_counts: DataFrame
    seeds: DataFrame | None = None


def _counts(pool: DataFrame) -> DataFrame:
    return pool.groupBy("request_id").agg(F.count("*").alias("candidate_count"))


def _single(hits: DataFrame, corpus: Corpus, n: int, rank: bool, **ranking) -> DataFrame:
    pool = hits.select(F.col("query_id").alias("request_id"), "item_id", "score", "rank")
    if not rank:
        plain = pool.select(
            "request_id", "item_id", F.col("rank").alias("position"), F.round("score", 4).alias("fit"), F.lit("").alias("reason")
        )
        return recommendations(plain, corpus, n)
    return recommendations(rerank(build_evidence(pool, corpus.tracks), n, **ranking), corpus, n)


def recommend_by_vector(queries: DataFrame, corpus: Corpus, n: int = 10, rank: bool = False, limits=None, **ranking) -> Recommended:
    """Requests that bring a raw vector: ``queries(request_id, embedding)``.

    With ``rank`` the hits pass the ranker; otherwise similarity order is final.
    """
    prepared = prepare_query(queries, corpus.meta).select(F.col("request_id").alias("query_id"), "embedding")
    hits = retrieve_top_k(prepared, corpus.vectors, n, **(limits or {}))
    pool = hits.select(F.col("query_id").alias("request_id"), "item_id")
    return Recommended(_single(hits, corpus, n, rank, **ranking), _counts(pool))


def recommend_by_text(queries: DataFrame, encoder: Callable[[], Encoder], corpus: Corpus, n: int = 10, rank: bool = False, **options) -> Recommended:
    """Requests in words: ``queries(request_id, text)`` are encoded, then searched like vectors.

    Requests that the encoder rejects get no rows; fails when it rejects all of them.
    """
    encoded = encode_items(queries.select(F.col("request_id").alias("item_id"), F.col("text").alias("content")), encoder, "text")
    encoded = materialise(encoded.where(F.col("error").isNull()), "encoded-requests")
    if encoded.isEmpty():
        raise ValueError("no request could be encoded")
    return recommend_by_vector(encoded.select(F.col("item_id").alias("request_id"), "embedding"), corpus, n, rank, **options)


def recommend_by_item(seeds: DataFrame, candidates: DataFrame, vectors: DataFrame, corpus: Corpus, n: int = 10, rank: bool = False, **ranking) -> Recommended:
    """One seed per request: matched, embedded, searched without its own corpus item.

    Fails when no request resolves or none has a vector.
    """
    resolved = materialise(resolve_seeds(seeds, candidates), "resolved-seeds")
    embedded = materialise(seed_vectors(resolved, vectors, corpus), "seed-vectors")
    _require(resolved, embedded)
    hits = materialise(_hits_of_requests(embedded, corpus.vectors, n), "hits")
    if hits.join(corpus.tracks, hits["item_id"] == corpus.tracks["song_id"], "left_semi").isEmpty():
        raise ValueError("no candidates")
    pool = hits.select(F.col("query_id").alias("request_id"), "item_id")
    return Recommended(_single(hits, corpus, n, rank, **ranking), _counts(pool), resolved)


def _hits_of_requests(embedded: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """``query_id, item_id, score, rank`` per request; requests with the same seeds are searched once."""
    mark = F.xxhash64("embedding")
    requests = materialise(
        embedded.groupBy("request_id").agg(F.concat_ws("\n", F.sort_array(F.collect_set("seed_id"))).alias("search"), F.min(mark).alias("lo"), F.max(mark).alias("hi")),
        "requests")
    odd = requests.where("lo <> hi").select("request_id").first()
    if odd:
        raise ValueError(f"query {odd[0]} has several vectors")
    seeds = embedded.select("seed_id", "embedding", "corpus_id").dropDuplicates(["seed_id"])
    asked = embedded.select("request_id", "seed_id").join(requests.select("request_id", "search").hint("merge"), "request_id").select("search", "seed_id").distinct()
    asked = materialise(asked.join(seeds.hint("merge"), "seed_id"), "searches")
    queries = asked.dropDuplicates(["search"]).select(F.col("search").alias("query_id"), "embedding")
    exclude = asked.where(F.col("corpus_id").isNotNull()).select(F.col("search").alias("query_id"), F.col("corpus_id").alias("item_id"))
    near = retrieve_top_k(queries, index, n, exclude).withColumnRenamed("query_id", "search")
    return requests.select(F.col("request_id").alias("query_id"), "search").join(near.hint("shuffle_hash"), "search").drop("search")


def _require(resolved: DataFrame, embedded: DataFrame) -> None:
    if resolved.where("resolved").isEmpty():
        raise ValueError("no seed could be matched")
    if embedded.isEmpty():
        raise ValueError("no seed has a usable vector")


def recommend_playlist(
    seeds: DataFrame,
    candidates: DataFrame,
    vectors: DataFrame,
    corpus: Corpus,
    n: int = 20,
    config: PlaylistConfig = PlaylistConfig(),
    **ranking,
) -> Recommended:
    """Many seeds per request (playlist, top or recent plays), pooled and ranked.

    The result carries every seed with its resolved flag, and the candidate count per request.
    """
    seeds = seeds.where(F.col("position") <= config.max_seeds)
    resolved = materialise(resolve_seeds(seeds, candidates), "resolved-seeds")
    embedded = materialise(seed_vectors(resolved, vectors, corpus), "seed-vectors")
    _require(resolved, embedded)
    pool = retrieve_pool(embedded, corpus.vectors, config)
    evidence = materialise(build_evidence(pool, corpus.tracks), "evidence")
    if evidence.isEmpty():
        raise ValueError("no candidates")
    ranked = rerank(evidence, n, playlist=config, **ranking)
    return Recommended(recommendations(ranked, corpus, min(n, config.max_seeds)), _counts(evidence), resolved)
