"""From raw documents to training shards: five stages, each reading what the one before has written.

Every stage keeps whole rows. A row's key is its place, the number of its file and its row there, so
rows with null or repeated ids are told apart and judged one by one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vector_atlas.llm.decontaminate import decontaminate
from vector_atlas.llm.knn_quality import held_out, score
from vector_atlas.llm.minmax import MinMaxConfig, near_duplicates
from vector_atlas.llm.mixture import mix, repeat
from vector_atlas.llm.shards import shard_rows
from vector_atlas.llm.tables import sized
from vector_atlas.session import materialise

KEY = "__document"
SHARDS = 16
#: Documents are near-duplicates from this similarity of their shingle sets on; op10 has its own contract.
NEAR_PERCENT = 80


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` plus the place of each row as ``KEY``; rows that come from no file are written first."""
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        placed = docs.withColumns({"__file": file, "__row": row})
    except AnalysisException:
        docs = materialise(docs, "rows")
        placed = docs.withColumns({"__file": file, "__row": row})
    files = materialise(placed.select("__file").distinct(), "files")
    # one row per file
    files = files.withColumn("__number", F.row_number().over(Window.orderBy("__file")).cast("long"))
    key = F.shiftleft("__number", 40) + F.col("__row")
    return placed.join(sized(files), "__file").withColumn(KEY, key).drop("__file", "__row", "__number")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of keyed ``docs`` whose key is not in ``keys``, which are broadcast only after they were counted."""
    keys = materialise(keys.distinct(), "dropped")
    return docs.join(sized(keys), KEY, "left_anti")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours vote for; learnt from the labels that are not held out."""
    labels = _table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    scored = score(docs, labels, out="__score")
    return scored.where("__score >= 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, null ids last, of
    equal ids the first row. Rows without words are no near-duplicates of anything and stay."""
    keyed = _keyed(docs)
    found = near_duplicates(keyed, KEY, "text", MinMaxConfig(percent=NEAR_PERCENT))
    found = materialise(found.select(KEY, "component_id"), "grouped")
    shared = materialise(found.where(F.col(KEY) != F.col("component_id")).select("component_id").distinct(), "groups")
    members = found.join(sized(shared), "component_id", "left_semi")
    members = materialise(keyed.select(KEY, "doc_id").join(sized(members), KEY), "group_members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY)).alias("first"))
    dropped = members.join(first.select("component_id", F.col(f"first.{KEY}").alias("stays")), "component_id").where(F.col(KEY) != F.col("stays"))
    return _without(keyed, dropped.select(KEY)).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    keyed = _keyed(docs)
    found = decontaminate(keyed, _table(spark, sf_dir, "benchmark"), KEY, "text")
    return _without(keyed, found.where("n_hit > 0").select(F.col("id").alias(KEY))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents as often as the mix takes them."""
    rows = _keyed(docs).select(F.struct(*docs.columns).alias("row"), KEY, *[F.col(c) for c in ("doc_id", "text", "source")])
    return repeat(mix(rows, row_col=KEY)).select("row.*")


def interleave_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its place there."""
    return shard_rows(_keyed(docs), SHARDS, row_col=KEY)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
    ("shard", interleave_shards),
]

#: Votes over latent-semantic vectors have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
