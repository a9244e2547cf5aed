"""Resumable jobs over growing inputs.

A job that skips finished ids and merges its rows into a table is an incremental stream:
every micro-batch holds rows that arrived since the last run, the checkpoint remembers them,
and the merge keeps the newest row per id (``versions.read_table`` reads the target). ``availableNow`` drains what is there and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vector_atlas.operators.joins import pending_ids, upsert_keep_last
from vector_atlas.session import materialise
from vector_atlas.sources.versions import merge_into, read_table


def merge_batch(job: Callable[[DataFrame], DataFrame], target: str, key: str = "song_id"):
    """A ``foreachBatch`` handler: run ``job`` on ids that ``target`` lacks, then merge.

    A batch that is replayed after a failure finds its ids present and changes nothing. Only the buckets of
    the new ids are read and written again.
    """
    def handle(batch: DataFrame, _batch_id: int) -> None:
        pending = pending_ids(batch.dropDuplicates([key]), read_table(batch.sparkSession, target), key)
        fresh = materialise(job(pending), "fresh")
        if not fresh.isEmpty():
            merge_into(fresh, target, [key], lambda existing, rows: upsert_keep_last(existing, rows, key))

    return handle


def run_incremental(
    arriving: DataFrame,
    job: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    key: str = "song_id",
) -> StreamingQuery:
    """Process everything that has arrived on the stream since the last run, then stop."""
    return (
        arriving.writeStream.foreachBatch(merge_batch(job, target, key))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
