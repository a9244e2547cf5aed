"""Small helpers shared by the operators: sized broadcasts and Arrow maps with a plain signature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows go to Python workers in smaller batches than Spark's defaults (10,000 rows, 64 MB), unless the
#: session sets sizes of its own: a batch of documents is held on both sides while it is worked on.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"),
}

#: A side is broadcast only after its rows were counted and found to be at most this many; one with lists or
#: texts only if they are at most so many bytes as well.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS, weight=None) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows (counted, unless ``rows`` is known).

    ``weight``: the bytes of a row's lists and texts; their sum must be at most ``BROADCAST_BYTES``.
    """
    if weight is not None:
        found = df.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
        return F.broadcast(df) if found[0] <= most and found[1] <= BROADCAST_BYTES else df
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= most else df


def map_batches(df: DataFrame, schema: str, start, step) -> DataFrame:
    """``step(state, batch)`` yields record batches for each input batch; ``start()`` makes the state of a task."""
    conf = df.sparkSession.conf
    for key, (default, size) in BATCHES.items():
        if conf.get(key) == default:
            conf.set(key, size)

    def run(batches):
        state = start()
        for batch in batches:
            if batch.num_rows:
                yield from step(state, batch)

    return df.mapInArrow(run, schema)


def _gathered(batches, rows: int):
    """Tables of at least so many rows, but for the last one."""
    import pyarrow as pa

    waiting, n = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield pa.Table.from_batches(waiting)
                waiting, n = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def whole_groups(batches, keys: int, rows: int = 1):
    """Tables of whole groups: rows are sorted by the first ``keys`` columns, groups may span batches. Batches are
    gathered until they have ``rows`` rows."""
    import pyarrow as pa

    held = None
    for table in _gathered(batches, rows):
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        cut = len(table) - 1
        tail = [table.column(c)[cut] for c in range(keys)]
        lo, hi = 0, cut  # first row of the last group, by bisection
        while lo < hi:
            mid = (lo + hi) // 2
            if all(table.column(c)[mid] == tail[c] for c in range(keys)):
                hi = mid
            else:
                lo = mid + 1
        if lo:
            yield table.slice(0, lo)
        held = table.slice(lo)
    if held is not None and len(held):
        yield held
