"""Shards by proportional stratified interleaving.

Within each source, documents are ranked in a seeded shuffled order. Document r of n has the
fractional rank (2r + 1) / 2n; sorting all documents by it interleaves the sources in proportion, so
every stretch of the order has the mixture of the whole. The order is cut into equal stretches.

Both rankings are running counts over a sorted order that is cut into ranges between sampled split points,
whatever the sources are: many sources of one document each, which all have the fraction 1/2, are told
apart by their names, and rows that are equal in everything by their place in the input. So neither a hot
source nor the whole table is ever sorted in one task. The rankings run on ids and sources alone; texts
move once, when shards are attached to whole rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vector_atlas.llm.tables import sized
from vector_atlas.operators.indexing import sums_before
from vector_atlas.session import materialise


def assign_shards(rows: DataFrame, n_shards: int = 16, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` plus ``shard, slot`` (columns of these names are replaced); counts of shards differ by one at
    most, slots run from 0. An empty table gives no row.

    A null source is a source of its own, null ids are shuffled as one. Rows with the same id are
    ordered by ``tie_cols``; rows equal in those too may take each other's place.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    keyed = rows.drop("shard", "slot").withColumns({
        "__g": digest, "__s": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")),
        "__one": F.lit(1).cast("long"), "__salt": F.monotonically_increasing_id()})
    shuffled = materialise(sums_before(keyed, ["__s", "__g", id_col, *tie_cols, "__salt"], "__one", "__r"), "shuffled")
    sources = materialise(shuffled.groupBy("__s").agg(F.min("__r").alias("__first"), F.count("*").alias("__of")), "sources")
    fraction = (2 * (F.col("__r") - F.col("__first") + 1) - 1) / (2 * F.col("__of"))
    ranked = shuffled.join(sized(sources), "__s").withColumn("__f", fraction.cast("double")).drop("__g", "__r", "__first", "__of")
    placed = materialise(sums_before(ranked, ["__f", "__s", id_col, *tie_cols, "__salt"], "__one", "__p"), "placed")
    total = placed.count()
    shard = F.floor(F.col("__p") * n_shards / F.lit(max(total, 1)))
    first = F.ceil(shard * F.lit(total) / n_shards)
    return placed.withColumns({"shard": shard.cast("int"), "slot": (F.col("__p") - first).cast("long")}).drop("__f", "__s", "__p", "__one", "__salt")


def shard_rows(docs: DataFrame, n_shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """Whole rows of ``docs`` plus ``shard, slot``, which replace columns of these names. Places are computed on
    narrow rows and come back by ``row_col``, which tells rows apart; without it, ``docs`` are written with one."""
    own = row_col or "__row"
    docs = docs.drop("shard", "slot")
    if row_col is None:
        docs = materialise(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    narrow = docs.select(F.col(own).alias("__k"), F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), crc.alias("__crc"))
    placed = assign_shards(narrow, n_shards, seed, "__id", "__source", ("__crc",)).select(F.col("__k").alias(own), "shard", "slot")
    return docs.join(placed, own).drop(own)
