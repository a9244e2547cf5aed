"""Dense row numbers, running sums in a given order and repeatable random pairs, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vector_atlas.session import materialise

RUN_BITS = 12  # 4096 rows of a sorted range make a run
BUCKET_DIGITS = 3  # 16**3 = 4096 buckets


def dense_index(items: DataFrame, key: str = "item_id", seed: int = 42) -> DataFrame:
    """Add ``idx``: 0..n-1 in the order of a seeded digest of the key.

    Rows are numbered within digest-prefix buckets, which spread evenly whatever the keys
    are, and shifted by the sizes of the buckets before (a table of at most 4096 rows).
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    marked = items.withColumn("__digest", digest).withColumn("__bucket", F.substring("__digest", 1, BUCKET_DIGITS))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy("__bucket")
        .agg(F.count("*").alias("__n"))
        .select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    within = Window.partitionBy("__bucket").orderBy("__digest", key)
    return (
        marked.withColumn("__row", F.row_number().over(within))
        .join(F.broadcast(offsets), "__bucket")
        .withColumn("idx", F.col("__offset") + F.col("__row") - 1)
        .drop("__digest", "__bucket", "__offset", "__row")
    )


def sums_before(rows: DataFrame, order: list, value: str, out: str = "before") -> DataFrame:
    """``rows`` plus ``out``: the sum of the whole numbers in ``value`` over all rows that come before in ``order``.

    The rows are dealt to ranges between sampled split points, sorted there and written with their place
    (range, row within it). Sums run within runs of 4096 rows, over the runs of a range, and over the
    ranges (one row each), so no task sees more than a range and no window more than its runs. Rows that
    are equal in ``order`` fall into one range: fold them first, with their count as ``value``.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part, run = F.shiftright("__at", 33), F.shiftright("__at", RUN_BITS)

    def before(window):
        return F.coalesce(F.sum("__n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))

    runs = materialise(ranged.groupBy(part.alias("__part"), run.alias("__run")).agg(F.sum(value).alias("__n")), "runs")
    parts = runs.groupBy("__part").agg(F.sum("__n").alias("__n"))
    parts = parts.select("__part", before(Window.orderBy("__part")).alias("__base"))  # one row per range
    runs = runs.withColumn("__shift", before(Window.partitionBy("__part").orderBy("__run"))).join(F.broadcast(parts), "__part")
    runs = runs.select("__run", (F.col("__shift") + F.col("__base")).alias("__shift"))
    own = ranged.withColumns({"__run": run, "__n": F.col(value)}).withColumn("__own", before(Window.partitionBy("__run").orderBy("__at")))
    return own.join(runs, "__run").withColumn(out, F.col("__own") + F.col("__shift")).drop("__at", "__run", "__n", "__own", "__shift")


def average_rank(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``rows`` plus ``out``: the rank of ``value`` from 1, equal values sharing the mean of their ranks."""
    counts = rows.groupBy(value).agg(F.count("*").alias("__count"))
    ranks = sums_before(counts, [value], "__count", "__before").select(
        F.col(value).alias("__value"), (F.col("__before") + (F.col("__count") + 1) / 2.0).alias(out))
    return rows.join(ranks, rows[value].eqNullSafe(ranks["__value"])).drop("__value")


def draw(seed: int, *parts: Column) -> Column:
    """A repeatable non-negative 48-bit number from a seed and columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def random_pairs(items: DataFrame, n_pairs: int, seed: int = 42, key: str = "item_id") -> DataFrame:
    """``pair, i, j``: min(n_pairs, n(n-1)/2) draws of two unequal items, by key.

    The second item is the first one shifted by 1..n-1 places, so no draw is rejected.
    """
    indexed = dense_index(items.select(key), key, seed)
    n = items.agg(F.count("*").alias("n"))
    numbered = items.sparkSession.range(n_pairs).withColumnRenamed("id", "pair").withColumn("n", n.scalar())
    size = F.col("n")
    first = F.pmod(draw(seed, F.lit("a"), F.col("pair")), size)
    shift = F.pmod(draw(seed, F.lit("b"), F.col("pair")), size - 1) + 1
    drawn = (
        numbered.where((size >= 2) & (F.col("pair") < F.least(F.lit(n_pairs), (size * (size - 1) / 2).cast("long"))))
        .withColumn("first", first)
        .withColumn("second", F.pmod(F.col("first") + shift, size))
        .select("pair", "first", "second")
    )
    a = indexed.select(F.col("idx").alias("first"), F.col(key).alias("i"))
    b = indexed.select(F.col("idx").alias("second"), F.col(key).alias("j"))
    return drawn.join(a, "first").join(b, "second").select("pair", "i", "j")
