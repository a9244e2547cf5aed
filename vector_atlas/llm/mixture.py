"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a token target: shares of all tokens by weight, no source above ``cap`` times its own
tokens, the excess shared again by weight. A source takes every document as often as whole epochs fit;
the rest is filled by documents in the order of their exponential keys -ln(u) / quality, up to the
budget. The last document is taken if that brings the source nearer to its target.

Keys fall into buckets; token sums per (source, bucket) show which bucket a budget ends in, and only
rows of that bucket are ordered. The outcome is one cut per source, so taking part is decided row by
row, without moving texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vector_atlas.llm.tables import sized
from vector_atlas.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: A run of letters that ends with at most one stop mark and a space: what plain prose consists of.
PLAIN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+[.,]?[\x20\x0A]"
BUCKETS = 16384
WEIGHTS = (5, 2, 1)
CAP = 3


def _id(id_col: str):
    return F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))


def weighed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, quality=None) -> DataFrame:
    """``docs`` plus ``__s`` (source key, null last), ``size``, ``__quality`` and ``__id``, a digest of id and
    text. ``quality``: a positive column; by default the share of plain words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    quality = (1 + F.regexp_count(text, F.lit(PLAIN))) / (1 + size) if quality is None else quality
    digest = F.md5(F.concat(F.lit(f"{seed}:"), _id(id_col), F.lit(":"), F.md5(text.cast("binary"))))
    source = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    return docs.withColumns({"__s": source, "size": size, "__quality": quality, "__id": digest})


def occurrences(narrow: DataFrame, row_col: str) -> DataFrame:
    """``row_col, __nth``: rows equal in source, id and text, numbered from 1, in buckets of ``row_col``; such rows only."""
    again = materialise(narrow.groupBy("__s", "__id").agg(F.count("*").alias("n")).where("n > 1").select("__s", "__id"), "repeated")
    same = narrow.join(sized(again), ["__s", "__id"], "left_semi").select("__s", "__id", row_col, F.pmod(F.xxhash64(row_col), F.lit(BUCKETS)).alias("cell"))
    same = materialise(same, "repeats")
    cells = same.groupBy("__s", "__id", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__s", "__id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = materialise(cells.select("__s", "__id", "cell", F.coalesce(before, F.lit(0)).alias("before")), "cells")
    nth = F.row_number().over(Window.partitionBy("__s", "__id", "cell").orderBy(row_col))
    numbered = same.withColumn("nth", nth).join(cells, ["__s", "__id", "cell"])
    return materialise(numbered.select(row_col, (F.col("before") + F.col("nth")).alias("__nth")), "occurrences")


def keyed(rows: DataFrame, nth: DataFrame, row_col: str) -> DataFrame:
    """``rows`` plus the exponential key of each row, drawn from its digest and its number among its equals."""
    rows = rows.join(sized(nth), row_col, "left").withColumn("__id", F.md5(F.concat("__id", F.lit(":"), F.coalesce("__nth", F.lit(1)).cast("string"))))
    u = (F.conv(F.substring("__id", 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return rows.withColumn("__key", -F.log(u) / F.col("__quality")).drop("__nth", "__quality")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``__s, source_size, target``; one row per source, weights repeat over sources in code-point order."""
    order = F.row_number().over(Window.orderBy("__s"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(order - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", weight.cast("long")).withColumn("most", (F.col("source_size") * cap).cast("long"))
    rows = rows.withColumn("level", F.col("most") / F.col("w"))
    before = Window.orderBy("level", "__s").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    spent, gone = F.coalesce(F.sum("most").over(before), F.lit(0)), F.coalesce(F.sum("w").over(before), F.lit(0))
    rows = rows.withColumn("water", (F.sum("source_size").over(everything) - spent) / (F.sum("w").over(everything) - gone))
    # ascending by level, sources are filled to the brim until the water of the others stays below
    rows = rows.withColumn("settled", F.max(F.when(F.col("level") > F.col("water"), F.col("water"))).over(everything))
    target = F.when(F.col("level") <= F.col("water"), F.col("most").cast("double")).otherwise(F.col("w") * F.col("settled"))
    return rows.select("__s", "source_size", target.cast("double").alias("target"))


def plan(rows: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: ``__s, source_size, target, epochs, cut_key, cut_id``; of the fractional
    epoch all rows up to the cut are taken (none where it is null)."""
    bucket = F.floor(F.col("__key") / (1 + F.col("__key")) * BUCKETS)
    rows = rows.select("__s", "__id", "size", "__key", bucket.alias("bucket"))
    sums = materialise(rows.groupBy("__s", "bucket").agg(F.sum("size").alias("tokens")), "buckets")
    aims = targets(sums.groupBy("__s").agg(F.sum("tokens").alias("source_size")), weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    aims = aims.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    aims = materialise(aims, "targets")
    n = aims.count()
    so_far = F.sum("tokens").over(Window.partitionBy("__s").orderBy("bucket"))
    last = (
        sums.withColumn("upto", so_far).join(sized(aims.select("__s", "rest"), n), "__s")
        .where((F.col("rest") > 0) & (F.col("upto") >= F.col("rest"))).groupBy("__s")
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"), "rest"), "bucket").alias("last")).select("__s", "last.*")
    )
    edge = rows.join(sized(last, n), ["__s", "bucket"])
    through = F.col("before") + F.sum("size").over(Window.partitionBy("__s").orderBy("__key", "__id").rowsBetween(Window.unboundedPreceding, 0))
    taken = edge.withColumn("through", through).where(2 * F.col("through") - F.col("size") <= 2 * F.col("rest"))
    cuts = taken.groupBy("__s").agg(F.max(F.struct("__key", "__id")).alias("cut"))
    # nothing of the last bucket fits: the cut lies before the bucket's first key
    cuts = last.join(cuts, "__s", "left").select("__s", F.coalesce("cut.__key", F.col("bucket") / (BUCKETS - F.col("bucket"))).alias("cut_key"), F.coalesce("cut.__id", F.lit("")).alias("cut_id"), F.col("cut").isNotNull().alias("inside"), "bucket")
    return aims.join(cuts, "__s", "left").drop("rest")


def _copies():
    bucket = F.floor(F.col("__key") / (1 + F.col("__key")) * BUCKETS)
    upto = (F.col("__key") < F.col("cut_key")) | ((F.col("__key") == F.col("cut_key")) & (F.col("__id") <= F.col("cut_id")))
    part = F.when(bucket < F.col("bucket"), True).otherwise((bucket == F.col("bucket")) & F.col("inside") & upto)
    return F.col("epochs") + F.coalesce(part, F.lit(False)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP, seed: int = 23, quality=None, row_col: str | None = None) -> DataFrame:
    """``docs`` plus ``size, source_size, target, copies``: how often the mix takes each document.

    A null or empty text has size 0; a null source is a source of its own, the last. Keys come from digests
    of id and text, so reruns agree; rows equal in source, id and text are numbered and draw a key each, so a
    source of such rows meets its target too (which of them are taken more often is left open). ``row_col``
    names a column that tells rows apart; without it, ``docs`` are written with one. Columns of ``docs``
    named ``size``, ``source_size``, ``target`` or ``copies`` are replaced. No document gives no row.
    """
    own = row_col or "__row"
    docs = docs.drop("size", "source_size", "target", "copies")
    if row_col is None:
        docs = materialise(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    rows = weighed(docs, id_col, text_col, source_col, seed, quality)
    narrow = materialise(rows.select(own, "__s", "__id", "size", "__quality"), "weighed")
    nth = occurrences(narrow, own)
    return mix_keyed(keyed(rows, nth, own), keyed(narrow, nth, own), weights, cap).drop(own)


def mix_keyed(rows: DataFrame, narrow: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``mix`` for rows with keys; ``narrow`` are the same rows without their texts."""
    cuts = materialise(plan(narrow, weights, cap), "mixture")
    return rows.join(sized(cuts), "__s").withColumn("copies", _copies()).drop("__s", "__key", "__id", "epochs", "cut_key", "cut_id", "inside", "bucket")


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("__copy")
