"""Summaries and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vector_atlas.functions import arrays
from vector_atlas.functions.tags import split_tags
from vector_atlas.operators.vectors import mean_vector

MISS_SAMPLE = 10  # size of the reported sample of misses


def tag_counts(tracks: DataFrame, membership: DataFrame, columns, group: str = "community") -> DataFrame:
    """``community, column, tag, n``: one scan, counted on the map side before the shuffle."""
    present = [c for c in columns if c in tracks.columns]
    if not present:
        return tracks.sparkSession.createDataFrame([], f"{group} long, column string, tag string, n long")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), split_tags(c).alias("tags")) for c in present])
    return (
        tracks.select(F.col("song_id").alias("item_id"), cells.alias("cells"))
        .join(membership.select("item_id", group).hint("merge"), "item_id")
        .select(group, F.explode("cells").alias("c"))
        .select(group, "c.column", F.explode("c.tags").alias("tag"))
        .groupBy(group, "column", "tag")
        .agg(F.count("*").alias("n"))
    )


def top_tags(tracks: DataFrame, membership: DataFrame, columns=("mood_all",), top_n: int = 3) -> DataFrame:
    """``community, label``: most frequent tags over all columns, ties by tag; no tags give ""."""
    summed = tag_counts(tracks, membership, columns).groupBy("community", "tag").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("community").orderBy(F.desc("n"), "tag")
    named = (
        summed.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top_n)
        .groupBy("community")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "tag")))["tag"], ", ").alias("label"))
    )
    known = (
        membership.join(tracks.select(F.col("song_id").alias("item_id")).hint("merge"), "item_id", "left_semi")
        .select("community")
        .distinct()
    )
    return known.join(named, "community", "left").select("community", F.coalesce("label", F.lit("")).alias("label"))


def community_summary(clusters: DataFrame, rows: int = 12) -> DataFrame:
    """The largest communities with size and label."""
    return (
        clusters.groupBy("community")
        .agg(F.count("*").alias("size"), F.min("label").alias("label"))
        .orderBy(F.desc("size"), "community")
        .limit(rows)
    )


def cluster_run_summary(membership: DataFrame, edges: DataFrame, modularity_row: DataFrame, model: str) -> DataFrame:
    """One row: items, communities, modularity and undirected edge count."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return membership.agg(
        F.count("*").alias("n_items"), F.count_distinct("community").alias("n_communities")
    ).select(
        F.lit(model).alias("model"),
        "n_items",
        "n_communities",
        modularity_row.select("modularity").scalar().alias("modularity"),
        pairs.agg(F.count("*")).scalar().alias("n_edges"),
    )


NARROW = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def column_profile(table: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: type, null share, distinct values, and range of numeric columns. NaN counts as null.

    Distinct values are counted exactly in two steps: each task folds its own repetitions, and only one key per
    task, column and distinct value is shuffled. The key of a value of up to 64 bits is its 64-bit hash, which for
    inputs of that size is one to one; wider values have one of 128 bits. All columns of a kind share one shuffle,
    and all plain counts and ranges one aggregate of a single row.
    """
    floating = {f.name for f in table.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    numeric = {f.name for f in table.schema.fields if isinstance(f.dataType, T.NumericType)}
    narrow = {f.name for f in table.schema.fields if isinstance(f.dataType, NARROW)}

    def value(c):
        # adding zero folds the two signed zeros into one value
        return F.when(~F.isnan(F.col(c)), F.col(c) + F.lit(0.0).cast(table.schema[c].dataType)) if c in floating else F.col(c)

    def number(c):
        return value(c).cast("double") if c in numeric else F.lit(None).cast("double")

    def hashable(c):
        kind = table.schema[c].dataType
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
            return F.to_json(F.struct(F.col(c).alias("v")))
        return value(c) if isinstance(kind, NARROW) or isinstance(kind, (T.DecimalType, T.BinaryType)) else F.col(c).cast("string")

    facts = []
    for i, c in enumerate(table.columns):
        facts += [F.count(value(c)).alias(f"n{i}"), F.min(number(c)).alias(f"lo{i}"), F.max(number(c)).alias(f"hi{i}")]
        if approximate:
            facts.append(F.approx_count_distinct(hashable(c)).alias(f"d{i}"))
    entries = F.array(*[
        F.struct(
            F.lit(i).cast("short").alias("i"), F.lit(c).alias("column"), F.lit(table.schema[c].dataType.simpleString()).alias("type"),
            F.when(F.col("rows") > 0, (F.col("rows") - F.col(f"n{i}")) * 100.0 / F.col("rows")).otherwise(0.0).alias("null_pct"),
            (F.col(f"d{i}") if approximate else F.lit(None).cast("long")).alias("distinct"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(table.columns)
    ])
    plain = table.agg(F.count("*").alias("rows"), *facts).select(F.explode(entries).alias("e")).select("e.*")
    if approximate:
        return plain.drop("i")
    counts = []
    for wide in (False, True):
        columns = [(i, c) for i, c in enumerate(table.columns) if (c in narrow) != wide]
        if not columns:
            continue
        cells = F.array(*[
            F.struct(
                F.lit(i).cast("short").alias("i"), F.when(value(c).isNotNull(), F.xxhash64(hashable(c))).alias("a"),
                *([F.xxhash64(F.lit(1), hashable(c)).alias("b")] if wide else []))
            for i, c in columns
        ])
        keys = table.select(F.explode(cells).alias("e")).select("e.*").where("a is not null").distinct()
        counts.append(keys.groupBy("i").agg(F.count("*").alias("found")))
    found = reduce(DataFrame.unionByName, counts)  # one row per column
    return plain.join(F.broadcast(found), "i", "left").select(
        "column", "type", "null_pct", F.coalesce("found", F.lit(0).cast("long")).alias("distinct"), "min", "max")


def vector_profile(vectors: DataFrame) -> DataFrame:
    """Shape, norm moments (population), value range, norm of the mean vector."""
    per_row = vectors.select(
        F.size("embedding").alias("dim"),
        arrays.norm("embedding").alias("norm"),
        F.array_min("embedding").cast("double").alias("low"),
        F.array_max("embedding").cast("double").alias("high"),
    )
    mean_norm = mean_vector(vectors).select(arrays.norm("mean").alias("v"))
    return per_row.agg(
        F.count("*").alias("n_items"),
        F.max("dim").alias("n_dims"),
        F.avg("norm").alias("norm_mean"),
        F.stddev_pop("norm").alias("norm_std"),
        F.min("low").alias("value_min"),
        F.max("high").alias("value_max"),
    ).withColumn("mean_vector_norm", mean_norm.scalar())


def pool_max(scored: DataFrame) -> DataFrame:
    """Best score per request and candidate, not below zero, with the number of supporting seeds."""
    return scored.groupBy("request_id", "item_id").agg(
        F.greatest(F.max("score"), F.lit(0.0)).alias("score"), F.count("*").alias("support")
    )


def match_report(total: DataFrame, matches: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: totals, rate over attempted items, and the first misses by id."""
    counts = matches.agg(
        F.count(F.when(F.col("matched"), 1)).alias("matched"),
        F.count(F.when(~F.col("matched"), 1)).alias("missed"),
    )
    misses = miss_sample(matches.where(~F.col("matched")), "song_id").agg(
        F.array_join(F.array_sort(F.collect_list("song_id")), ",").alias("miss_sample")
    )
    attempted = F.col("total") - F.col("skipped")
    return (
        counts.withColumn("total", total.agg(F.count("*")).scalar())
        .withColumn("skipped", skipped.agg(F.count("*")).scalar())
        .withColumn("match_rate", F.when(attempted > 0, F.col("matched") / attempted).otherwise(0.0))
        .withColumn("miss_sample", misses.scalar())
        .select("total", "matched", "missed", "skipped", "match_rate", "miss_sample")
    )


def miss_sample(misses: DataFrame, order: str, rows: int = MISS_SAMPLE) -> DataFrame:
    """The first misses or failures, for a report."""
    return misses.orderBy(order).limit(rows)


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
