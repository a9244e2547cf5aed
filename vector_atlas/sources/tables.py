"""Metadata, arousal/valence and tracks tables."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vector_atlas import schemas
from vector_atlas.functions.tags import split_tags
from vector_atlas.operators.indexing import sums_before
from vector_atlas.session import materialise

CSV_OPTIONS = {"header": True, "escape": '"', "quote": '"'}


SPLIT_CONF, OPEN_CONF = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


def _files_by_header(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """Column names and the files that have them, in that order; one entry per distinct header.

    Each task opens one part of a file and stops after its first batch of lines, so the data is not read twice.
    The names of the files reach the driver, as the reader needs them there.
    """
    def first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    first = lines.mapInArrow(first_line, lines.schema).where("start = 0")
    found = first.groupBy(F.col("value").alias("header")).agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("header")
    before = spark.conf.get(OPEN_CONF)
    spark.conf.set(OPEN_CONF, spark.conf.get(SPLIT_CONF))  # no two parts of files in one task
    try:
        rows = found.collect()
    finally:
        spark.conf.set(OPEN_CONF, before)
    return [(next(csv.reader([row["header"].removeprefix("\ufeff")]), []), row["files"]) for row in rows]


def _read_csv(spark: SparkSession, path: str, types: T.StructType, multi_line: bool = False) -> DataFrame:
    """CSV by header name: columns may come in any order, other in each file; extra ones are ignored.

    Files are split between tasks unless ``multi_line`` says that quoted values hold line breaks.
    """
    by_name = {f.name: f.dataType for f in types.fields}
    tables = []
    for header, files in _files_by_header(spark, path):
        missing = sorted(set(types.fieldNames()) - set(header))
        if missing:
            raise ValueError(f"{files[0]}: missing columns {missing}")
        layout = T.StructType([T.StructField(c, by_name.get(c, T.StringType())) for c in header])
        table = spark.read.schema(layout).options(**CSV_OPTIONS, multiLine=multi_line).csv(files)
        tables.append(table.select(*types.fieldNames()))
    if not tables:
        raise ValueError(f"{path}: missing columns {sorted(by_name)}")
    return reduce(DataFrame.unionByName, tables)


def scan_metadata(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Raw metadata with every column as text, under the engine's names."""
    table = _read_csv(spark, path, schemas.METADATA_SCHEMA, multi_line)
    return table.select(*[F.col(s).alias(t) for s, t in schemas.METADATA_COLUMNS.items()])


def scan_av(spark: SparkSession, path: str) -> DataFrame:
    """Arousal and valence per item; the id stays text."""
    table = _read_csv(spark, path, schemas.AV_SCHEMA)
    return table.select(*[F.col(s).alias(t) for s, t in schemas.AV_COLUMNS.items()])


def read_tracks(spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = False) -> DataFrame:
    """Processed table with typed columns and a text id."""
    if fmt == "csv":
        by_name = {f.name: f.dataType for f in schemas.TRACKS_SCHEMA.fields}
        parts = []
        for header, files in _files_by_header(spark, path):
            if "song_id" not in header:
                raise ValueError("tracks table has no song_id column")
            layout = T.StructType([T.StructField(c, by_name.get(c, T.StringType())) for c in header])
            parts.append(spark.read.schema(layout).options(**CSV_OPTIONS, multiLine=multi_line).csv(files))
        if not parts:
            raise ValueError("tracks table has no song_id column")
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    table = spark.read.format(fmt).load(path)
    schemas.require_columns(table, ["song_id"], "tracks table")
    by_name = {f.name: f.dataType for f in schemas.TRACKS_SCHEMA.fields}
    return table.select(
        *[F.col(c).cast(by_name[c]).alias(c) if c in by_name else F.col(c) for c in table.columns]
    )


def write_tracks(tracks: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Exactly the output columns, in order."""
    schemas.require_columns(tracks, schemas.TABLE_COLUMNS, "tracks table")
    writer = tracks.select(*schemas.TABLE_COLUMNS).write.mode("overwrite")
    if fmt == "csv":
        writer.options(header=True, escape='"', quote='"').csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def label_vocabulary(metadata: DataFrame) -> DataFrame:
    """Distinct tags of the five source columns: ``(vocabulary, tag, position)``.

    All columns are unpivoted in one scan; distinct runs before the ordering, so only the
    vocabularies are ordered, all in one order that is cut into ranges. Tags are ordered without
    regard to case, then as written.
    """
    schemas.require_columns(metadata, schemas.VOCABULARY_COLUMNS.values(), "metadata")
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("vocabulary"), split_tags(raw).alias("tags"))
            for name, raw in schemas.VOCABULARY_COLUMNS.items()
        ]
    )
    distinct = (
        metadata.select(F.explode(entries).alias("e"))
        .select("e.vocabulary", F.explode("e.tags").alias("tag"))
        .distinct()
    )
    folded = distinct.withColumns({"folded": F.lower("tag"), "one": F.lit(1).cast("long")})
    placed = materialise(sums_before(folded, ["vocabulary", "folded", "tag"], "one"), "vocabularies")
    starts = placed.groupBy("vocabulary").agg(F.min("before").alias("start"))  # one row per vocabulary
    return placed.join(F.broadcast(starts), "vocabulary").select("vocabulary", "tag", (F.col("before") - F.col("start") + 1).alias("position"))


def label_vocabulary_json(metadata: DataFrame) -> DataFrame:
    """One JSON document: vocabulary name -> ordered tags (size of the vocabulary, not the corpus)."""
    lists = (
        label_vocabulary(metadata)
        .groupBy("vocabulary")
        .agg(F.array_sort(F.collect_list(F.struct("position", "tag"))).alias("rows"))
        .select("vocabulary", F.col("rows.tag").alias("tags"))
    )
    empty = F.lit(None).cast("array<string>")
    columns = []
    for name in schemas.VOCABULARY_COLUMNS:
        tags = F.first(F.when(F.col("vocabulary") == name, F.col("tags")), ignorenulls=True)
        columns.append(F.coalesce(tags, F.coalesce(empty, F.array().cast("array<string>"))).alias(name))
    return lists.agg(*columns).select(F.to_json(F.struct(*schemas.VOCABULARY_COLUMNS)).alias("document"))


def write_label_vocabulary(metadata: DataFrame, path: str) -> str:
    label_vocabulary_json(metadata).write.mode("overwrite").text(path)
    return path
