"""Quality of embeddings, clusters, labels and projections; one-row reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vector_atlas.config import SYMMETRIZE_MODES
from vector_atlas.functions import arrays
from vector_atlas.operators.graph import connected_components, degree_stats, modularity, symmetrize_graph
from vector_atlas.operators.indexing import average_rank, random_pairs
from vector_atlas.operators.neighbours import nearest
from vector_atlas.operators.ranks import rank_excess
from vector_atlas.operators.profile import tag_counts
from vector_atlas.operators.vectors import vector_matrix
from vector_atlas.operators.cleaning import sample_key
from vector_atlas.session import materialise

PAIR_SAMPLE = 10_000
SHEPARD_PAIRS = 5_000
GRAM_SALTS = 64  # groups in which the sums of tasks are added up first
PAIR_ROWS = 1_000_000  # drawn pairs that may be broadcast
SEED = 42


# --- embeddings -----------------------------------------------------------------------------


def _softened(vectors: DataFrame) -> DataFrame:
    """Rows divided by norm + epsilon, so that a zero vector stays zero."""
    return vectors.select(
        "item_id", arrays.scale_down("embedding", arrays.norm("embedding") + F.lit(arrays.ZERO_NORM)).alias("u")
    )


def gram_matrix(vectors: DataFrame, column: str, salts: int = GRAM_SALTS) -> DataFrame:
    """``dim, products``: the d x d matrix of column products.

    A task's sum travels as one binary row, the upper triangle. Tasks are added up per salt first, and the
    sums of the salts then, each as a running total: a group streams past, it is never held.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = vector_matrix(batch.column(0))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield _triangle(total[np.triu_indices(len(total))], len(total))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, dim = None, 0
        for batch in batches:
            for row in range(batch.num_rows):
                own = np.frombuffer(batch.column(1)[row].as_buffer(), np.float64)
                total, dim = own if total is None else total + own, batch.column(0)[row].as_py()
        if total is not None:
            yield _triangle(total, dim)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in added(batches):
            dim = batch.column(0)[0].as_py()
            whole = np.zeros((dim, dim))
            whole[np.triu_indices(dim)] = np.frombuffer(batch.column(1)[0].as_buffer(), np.float64)
            whole = whole + np.triu(whole, 1).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dim), pa.int32()), pa.array(whole.tolist(), pa.list_(pa.float64()))], names=["dim", "products"])

    packed = "dim int, triangle binary"
    parts = vectors.select(column).mapInArrow(partial, packed)
    salted = parts.repartition(salts, F.pmod(F.monotonically_increasing_id(), F.lit(salts))).mapInArrow(added, packed)
    return salted.coalesce(1).mapInArrow(unfold, "dim int, products array<double>")  # at most ``salts`` rows


def _triangle(values: np.ndarray, dim: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["dim", "triangle"])


def pairwise_cosine_exact(vectors: DataFrame) -> DataFrame:
    """One row: mean and deviation of the cosine over all ordered pairs, without forming a pair.

    The sum over pairs is |sum u|^2 - sum |u|^2, and the sum of squares is the squared norm of
    the Gram matrix minus sum |u|^4.
    """
    unit = _softened(vectors)
    sums = (
        unit.select(F.lit(0).alias("all"), "u", arrays.dot("u", "u").alias("s"))
        .groupBy("all")
        .agg(
            F.count("*").alias("n"),
            vector_to_array(Summarizer.sum(array_to_vector(F.col("u")))).alias("total"),
            F.sum("s").alias("s1"),
            F.sum(F.col("s") * F.col("s")).alias("s2"),
        )
        .agg(*[F.first(c).alias(c) for c in ("n", "total", "s1", "s2")])  # one row even without vectors
    )
    frobenius = gram_matrix(unit, "u").agg(F.sum(arrays.dot("products", "products")).alias("f"))
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (arrays.dot("total", "total") - F.col("s1")) / pairs
    second = (F.col("f") - F.col("s2")) / pairs
    return (
        sums.withColumn("f", frobenius.scalar())
        .withColumn("mean", F.when(F.col("n") >= 2, mean).otherwise(0.0))
        .select(
            F.col("mean").alias("exact_mean_cosine"),
            F.when(F.col("n") >= 2, F.sqrt(F.greatest(second - F.col("mean") * F.col("mean"), F.lit(0.0))))
            .otherwise(0.0)
            .alias("exact_std_cosine"),
        )
    )


def pairwise_cosine_sample(vectors: DataFrame, n_pairs: int = PAIR_SAMPLE, seed: int = SEED) -> DataFrame:
    """One row: mean and deviation over randomly drawn unequal pairs (a bounded table)."""
    unit = _softened(vectors)
    pairs = random_pairs(vectors, n_pairs, seed)
    pairs = F.broadcast(pairs) if n_pairs <= PAIR_ROWS else pairs
    cosines = (
        unit.select(F.col("item_id").alias("i"), F.col("u").alias("ui"))
        .join(pairs, "i")
        .select("pair", "j", "ui")
        .join(unit.select(F.col("item_id").alias("j"), F.col("u").alias("uj")), "j")
        .select(arrays.dot("ui", "uj").alias("c"))
    )
    return cosines.agg(
        F.coalesce(F.avg("c"), F.lit(0.0)).alias("mean_pairwise_cosine"),
        F.coalesce(F.stddev_pop("c"), F.lit(0.0)).alias("std_pairwise_cosine"),
    )


def embedding_sanity(vectors: DataFrame, n_pairs: int = PAIR_SAMPLE, seed: int = SEED) -> DataFrame:
    """One row: shape, defect flags, sampled and exact moments of the pairwise cosine."""
    x = arrays.doubles("embedding")
    flags = vectors.select(
        F.size("embedding").alias("dim"),
        F.exists(x, lambda v: F.isnan(v)).alias("nan"),
        F.exists(x, lambda v: F.abs(v) == float("inf")).alias("inf"),
        (arrays.norm("embedding") <= arrays.ZERO_NORM).alias("zero"),
    ).agg(
        F.count("*").alias("n_samples"),
        F.coalesce(F.max("dim"), F.lit(0)).alias("n_dims"),
        F.coalesce(F.max("nan"), F.lit(False)).alias("has_nan"),
        F.coalesce(F.max("inf"), F.lit(False)).alias("has_inf"),
        F.coalesce(F.max("zero"), F.lit(False)).alias("has_zero_norm"),
    )
    sampled = pairwise_cosine_sample(vectors, n_pairs, seed)
    exact = pairwise_cosine_exact(vectors)
    return beside(flags, sampled, exact)


def beside(*rows: DataFrame) -> DataFrame:
    """One-row tables next to each other; each further table is read by scalar subqueries."""
    first, *others = rows
    for other in others:
        packed = other.select(F.struct(*other.columns).alias("r"))
        first = first.withColumn("__r", packed.scalar()).select(
            *first.columns, *[F.col(f"__r.{c}").alias(c) for c in other.columns]
        )
    return first


# --- clusters --------------------------------------------------------------------------------


def cluster_sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("community").agg(F.count("*").alias("size"))


def size_balance(membership: DataFrame) -> DataFrame:
    """One row: deviation of community sizes over their mean (null when there is none)."""
    return cluster_sizes(membership).agg((F.stddev_pop("size") / F.avg("size")).alias("size_balance"))


def silhouette(vectors: DataFrame, membership: DataFrame, **limits) -> DataFrame:
    """``item_id, community, silhouette`` under cosine distance, from cluster sums alone.

    The mean distance to a cluster is 1 - x.m with m the mean of its unit vectors, so the
    nearest other cluster is a top-2 search over cluster means. A further coordinate makes
    the means unit length without changing any product, which the block search needs.
    """
    unit = (
        vectors.select(
            "item_id",
            arrays.scale_down(
                "embedding", F.when(arrays.norm("embedding") > 0, arrays.norm("embedding")).otherwise(1.0)
            ).alias("u"),
        )
        .join(membership.select("item_id", "community"), "item_id")
    )
    total = vector_to_array(Summarizer.sum(array_to_vector(F.col("u"))))
    sums = unit.groupBy("community").agg(total.alias("total"), F.count("*").alias("size"))
    means = sums.select(
        F.col("community").cast("string").alias("item_id"),
        arrays.scale_down("total", F.col("size").cast("double")).alias("m"),
    )
    padded = F.concat("m", F.array(F.sqrt(F.greatest(F.lit(1.0) - arrays.dot("m", "m"), F.lit(0.0)))))
    queries = unit.select(F.col("item_id").alias("query_id"), F.concat("u", F.array(F.lit(0.0))).alias("embedding"))
    two = nearest(queries, means.select("item_id", padded.alias("embedding")), 2, **limits)
    other = (
        two.join(unit.select(F.col("item_id").alias("query_id"), "community"), "query_id")
        .where(F.col("item_id") != F.col("community").cast("string"))
        .groupBy("query_id")
        .agg(F.max("score").alias("best"))
    )
    x_total, own = arrays.dot("u", "total"), arrays.dot("u", "u")
    a = 1.0 - (x_total - own) / (F.col("size") - 1)
    b = 1.0 - F.col("best")
    wide = F.greatest(F.col("a"), F.col("b"))
    scored = (
        unit.join(sums, "community")
        .withColumn("a", F.when(F.col("size") > 1, a))
        .select("item_id", "community", "a")
        .join(other.withColumnRenamed("query_id", "item_id"), "item_id", "left")
        .withColumn("b", b)
    )
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (wide == 0), 0.0).otherwise((F.col("b") - F.col("a")) / wide)
    return scored.select("item_id", "community", value.alias("silhouette"))


def cluster_quality(vectors: DataFrame, membership: DataFrame, **limits) -> DataFrame:
    """One row: cluster count, size range, balance and mean silhouette.

    With fewer than two clusters, or as many as items, the silhouette is null.
    """
    sizes = cluster_sizes(membership).agg(
        F.count("*").alias("n_clusters"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("n_samples"),
        F.max("size").alias("largest"),
        F.min("size").alias("smallest"),
    )
    mean = silhouette(vectors, membership, **limits).agg(F.avg("silhouette").alias("s"))
    defined = (F.col("n_clusters") >= 2) & (F.col("n_clusters") < F.col("n_samples"))
    row = beside(sizes, size_balance(membership), mean)
    return row.select(
        "n_clusters", "largest", "smallest", "size_balance", F.when(defined, F.col("s")).alias("silhouette_mean")
    )


# --- labels ----------------------------------------------------------------------------------


def tag_entropy(tracks: DataFrame, membership: DataFrame, columns=("style", "theme", "mood_all")) -> DataFrame:
    """``community, column, entropy``: tag entropy over its maximum; one tag or none gives 0."""
    counts = tag_counts(tracks, membership, columns)
    # sum p ln p from sums of n and n ln n: a single aggregate, no second pass
    per_group = counts.groupBy("community", "column").agg(
        F.count("*").alias("kinds"),
        F.sum("n").cast("double").alias("total"),
        F.sum(F.col("n") * F.ln("n")).alias("weighted"),
    )
    entropy = F.ln("total") - F.col("weighted") / F.col("total")
    found = per_group.select(
        "community",
        "column",
        F.when(F.col("kinds") > 1, entropy / F.ln("kinds")).otherwise(0.0).alias("entropy"),
    )
    wanted = membership.select("community").distinct().select(
        "community", F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")
    )
    return wanted.join(found, ["community", "column"], "left").na.fill(0.0, ["entropy"])


def _placed(tracks: DataFrame, membership: DataFrame) -> DataFrame:
    """Items with both coordinates; pairs with a missing value are ignored."""
    return (
        membership.select("item_id", "community")
        .join(tracks.select(F.col("song_id").alias("item_id"), F.col("arousal").cast("double"), F.col("valence").cast("double")), "item_id")
        .where(F.col("arousal").isNotNull() & F.col("valence").isNotNull() & ~F.isnan("arousal") & ~F.isnan("valence"))
    )


def va_spread(tracks: DataFrame, membership: DataFrame) -> DataFrame:
    """``community, va_spread``: deviation of the distances to the community's centre."""
    placed = _placed(tracks, membership)
    centres = placed.groupBy("community").agg(
        F.avg("arousal").alias("ca"), F.avg("valence").alias("cv"), F.count("*").alias("n")
    )
    distance = F.sqrt(F.pow(F.col("arousal") - F.col("ca"), 2) + F.pow(F.col("valence") - F.col("cv"), 2))
    spread = placed.join(centres, "community").groupBy("community").agg(F.stddev_pop(distance).alias("va_spread"))
    return membership.select("community").distinct().join(spread, "community", "left").na.fill(0.0, ["va_spread"])


def quadrant_coverage(tracks: DataFrame, membership: DataFrame, pivot: float = 0.0) -> DataFrame:
    """``community, quadrant_coverage``: share of the four sign quadrants that occur."""
    high_a, high_v = F.col("arousal") >= pivot, F.col("valence") >= pivot
    quadrants = [high_a & high_v, high_a & ~high_v, ~high_a & ~high_v, ~high_a & high_v]
    present = sum((F.max(F.when(q, 1).otherwise(0)) for q in quadrants), F.lit(0))
    found = _placed(tracks, membership).groupBy("community").agg((present / 4.0).alias("quadrant_coverage"))
    return membership.select("community").distinct().join(found, "community", "left").na.fill(0.0, ["quadrant_coverage"])


def label_coherence(tracks: DataFrame, membership: DataFrame, pivot: float = 0.0) -> DataFrame:
    """One row per community: size, three tag entropies, spread and coverage."""
    wide = (
        tag_entropy(tracks, membership)
        .groupBy("community")
        .agg(
            *[
                F.max(F.when(F.col("column") == c, F.col("entropy"))).alias(f"{name}_entropy")
                for name, c in (("style", "style"), ("theme", "theme"), ("mood", "mood_all"))
            ]
        )
    )
    return (
        cluster_sizes(membership)
        .join(wide, "community", "left")
        .join(va_spread(tracks, membership), "community", "left")
        .join(quadrant_coverage(tracks, membership, pivot), "community", "left")
    )


COHERENCE_METRICS = ("style_entropy", "theme_entropy", "mood_entropy", "va_spread", "quadrant_coverage")


def semantic_quality(coherence: DataFrame) -> DataFrame:
    """One row: label and item counts and the unweighted means of the per-community values."""
    return coherence.agg(
        F.count("*").alias("n_labels"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("n_samples"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in COHERENCE_METRICS],
    )


# --- projection ------------------------------------------------------------------------------


def neighbourhood_preservation(points: DataFrame, k: int, **limits) -> DataFrame:
    """One row ``trustworthiness, continuity, k, n_samples`` for ``points(item_id, embedding, x, y)``.

    Where the k nearest items of the two spaces differ, an item costs as much as its rank in the other
    space exceeds k (``ranks``). Equal distances go by id.
    """
    spark = points.sparkSession
    unit = arrays.scale_down("embedding", F.greatest(arrays.norm("embedding"), F.lit(arrays.ZERO_NORM)))
    points = materialise(points.select(F.col("item_id").cast("string"), unit.alias("u"), F.array("x", "y").cast("array<double>").alias("p")), "points")
    n = points.count()
    k_eval = max(1, min(k, n // 2 - 1))
    scale = float(n * k_eval * (2 * n - 3 * k_eval - 1))
    if n <= k or scale <= 0:
        row = (0.0, 0.0, k if n <= k else k_eval, n)
    else:
        t, c = rank_excess(points, k_eval, **limits)
        row = (1.0 - 2.0 / scale * t, 1.0 - 2.0 / scale * c, k_eval, n)
    return spark.createDataFrame([row], "trustworthiness double, continuity double, k int, n_samples int")


def shepard_rho(points: DataFrame, n_pairs: int = SHEPARD_PAIRS, seed: int = SEED) -> DataFrame:
    """One row ``shepard_rho``: rank correlation of high and low distances over drawn pairs."""
    pairs = random_pairs(points, n_pairs, seed)
    pairs = F.broadcast(pairs) if n_pairs <= PAIR_ROWS else pairs  # at most n_pairs rows
    unit = points.select(
        "item_id",
        arrays.scale_down("embedding", F.greatest(arrays.norm("embedding"), F.lit(arrays.ZERO_NORM))).alias("u"),
        "x",
        "y",
    )
    left = unit.toDF("i", "ui", "xi", "yi").join(pairs, "i")
    both = left.join(unit.toDF("j", "uj", "xj", "yj"), "j").select(
        (1.0 - arrays.dot("ui", "uj")).alias("high"),
        F.sqrt(F.pow(F.col("xi") - F.col("xj"), 2) + F.pow(F.col("yi") - F.col("yj"), 2)).alias("low"),
    )
    # written, since each of the two orders reads it
    both = materialise(both, "distances")
    ranked = average_rank(average_rank(both, "high", "rh"), "low", "rl")
    rho = ranked.agg(F.corr("rh", "rl").alias("r"))
    return rho.select(F.when(F.col("r").isNull() | F.isnan("r"), 0.0).otherwise(F.col("r")).alias("shepard_rho"))


def projection_quality(
    vectors: DataFrame,
    coords: DataFrame,
    k: int = 15,
    subsample_n: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """One row: trustworthiness, continuity, rank correlation, neighbours used, items scored.

    All items are scored unless ``subsample_n`` asks for a sample.
    """
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    points = vectors.select("item_id", "embedding").join(coords.select("item_id", "x", "y"), "item_id")
    if subsample_n is not None:
        points = points.orderBy(sample_key(seed, "item_id"), "item_id").limit(subsample_n)
    kept = neighbourhood_preservation(points, k)
    rho = shepard_rho(points, seed=seed)
    row = beside(kept, rho)
    return row.select(
        "trustworthiness",
        "continuity",
        F.when(F.col("n_samples") <= k, 0.0).otherwise(F.col("shepard_rho")).alias("shepard_rho"),
        "k",
        "n_samples",
    )


# --- graph -----------------------------------------------------------------------------------


def graph_quality(
    edges: DataFrame,
    membership: DataFrame,
    resolution: float = 1.0,
    directed: bool = True,
    mode: str = "max",
) -> DataFrame:
    """One row: sizes, components, modularity, communities and mean degree of a graph.

    Loops are dropped; directed input is made undirected first. Fewer than two nodes give zeros.
    """
    if mode not in SYMMETRIZE_MODES:
        raise ValueError(f"mode must be one of {SYMMETRIZE_MODES}, got {mode!r}")
    edges = symmetrize_graph(edges, mode) if directed else edges.where(F.col("src") != F.col("dst"))
    nodes = membership.select("item_id")
    stats = degree_stats(nodes, edges)
    components = connected_components(nodes, edges).agg(F.count_distinct("component").alias("n_components"))
    sizes = cluster_sizes(membership).agg(
        F.count("*").alias("n_communities"), F.max("size").alias("largest"), F.min("size").alias("smallest")
    )
    row = beside(stats, components, modularity(edges, membership, resolution), sizes)
    few = F.col("n_nodes") < 2
    zeroed = [
        F.when(few, F.lit(0)).otherwise(F.col(c)).cast(dict(row.dtypes)[c]).alias(c)
        for c in row.columns
        if c != "n_nodes"
    ]
    return row.select("n_nodes", *zeroed)
