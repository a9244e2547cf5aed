"""Exact nearest neighbours by dot product.

Three physical forms give the same rows:

* the query side is small (rows and bytes checked): it is broadcast, every task of the searched
  side keeps a running k best per query, and only those rows are shuffled;
* the searched side is small: it is broadcast and every task of the query side emits its k best;
* both are large: a first pass works on short stand-ins of the vectors, a second one on the rows
  that may still be among the k best of some query.

The stand-in of a vector x are its first m coordinates in the principal directions of a sample, and
the length r of the rest. For stand-ins of q and x, ``q_m.x_m + r_q r_x`` is never below q.x and
``q_m.x_m - r_q r_x`` never above it, whatever the directions; with good ones m is small and the two
are close. So a search among stand-ins (vectors of m + 1 numbers themselves) gives a floor for the
k-th best score of each query, and drops every row whose upper bound is below it. Rows are grouped by
nearest pivot into blocks of bounded size, whole blocks are dropped by bounds on the pivots, and query
blocks that lie together form tiles: stand-ins go once to each large tile, whole vectors only to the
small tiles in which they are still wanted, and never to the tile that holds them as queries.

Where a stand-in is hardly shorter than its vector, nothing would be dropped so: then each tile of queries meets
all rows of the other side, as plain products of matrices, and only products that reach the k-th best score met
so far are looked at. The number of tiles is fixed, so what is shuffled grows with the rows.

The vectors may have any length: the bounds hold for all of them. Ties are broken by item id,
a repeated query row counts once. Nothing is sampled but the directions and pivots, on which no
result depends, and no pair of rows leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vector_atlas.functions import arrays
from vector_atlas.operators.vectors import l2_normalize, vector_matrix
from vector_atlas.session import materialise

SIDE_ROWS = 8192  # largest side that may be broadcast
SIDE_BYTES = 64 << 20
BLOCK_ROWS = 2048
MAX_PIVOTS = 4096
SAMPLE_ROWS = 8192  # vectors the directions and pivots are taken from
SHORT = 16  # vectors of up to so many coordinates stand for themselves
HEAD = 64  # most coordinates of a stand-in
HEAD_SHARE = 0.97  # of the squared lengths that the coordinates of a stand-in should hold
WIDE_TILE = 64  # query blocks that share the stand-ins sent to them
TILE_BLOCKS = 8  # query blocks that share the whole vectors sent to them
RUN_BLOCKS = 256  # searched blocks one task works through for one tile
NEAR_CELLS = 3  # cells whose first blocks give the floor of a query
CHUNK_QUERIES = 512
TILES = 24  # tiles of queries that meet all rows, unless one would have fewer or more rows than
TILE_ROWS = (2048, 32768)  # these
RUN_ROWS = 65536  # searched rows that meet a tile in one task, at least
RUNS = 4  # most tasks of a tile: each gives out its own k best, so what they give out grows with the rows
PACK_ROWS = 2048  # rows that travel, and are multiplied, together
SLACK = 1e-9
GROUP = 256  # products of a query of which the best is looked at first
CHUNK_PRODUCTS = 128  # queries whose products with PACK_ROWS rows stay near the processor
PENDING = 1 << 19  # products of a tile that wait until they are merged with its best ones
ROUGH = 1e-5  # error of products of stand-ins, which have single precision

HITS = "query_id string, item_id string, score double"
_HITS_ARROW = pa.schema([("query_id", pa.string()), ("item_id", pa.string()), ("score", pa.float64())])


class Best:
    """Running k best (score descending, id ascending) per query position; each query has its own k."""

    def __init__(self, k: np.ndarray):
        self.k = k
        self.sizes = np.unique(k)
        self.query = np.empty(0, dtype=np.int64)
        self.item = np.empty(0, dtype=object)
        self.score = np.empty(0)

    def add(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        if not len(x):
            return
        for k in self.sizes:
            rows = np.flatnonzero(self.k == k)
            for start in range(0, len(rows), CHUNK_QUERIES):
                self._add(q, rows[start : start + CHUNK_QUERIES], x, ids, int(k))

    def _add(self, q, rows, x, ids, k) -> None:
        own = q[rows]
        rough = own @ x.T
        if rough.shape[1] > k:
            floor = np.partition(rough, -k, axis=1)[:, -k]
            qi, xi = np.nonzero(rough >= floor[:, None] - SLACK)
        else:
            qi, xi = np.divmod(np.arange(rough.size), rough.shape[1])
        # matrix products round differently by position in the block; the survivors are scored
        # again one by one, so equal vectors get equal scores
        exact = np.concatenate(
            [np.empty(0)]
            + [(own[qi[s : s + 65536]] * x[xi[s : s + 65536]]).sum(axis=1) for s in range(0, len(qi), 65536)]
        )
        self.merge(rows[qi], ids[xi], exact)

    def merge(self, query, item, score) -> None:
        query = np.concatenate([self.query, query])
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, score])
        names = item.astype(str) if len(item) else np.empty(0, dtype="U1")
        order = np.lexsort((names, -score, query))
        query, item, score = query[order], item[order], score[order]
        first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.empty(0, dtype=bool)
        starts = np.flatnonzero(first)
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        keep = place < self.k[query]
        self.query, self.item, self.score = query[keep], item[keep], score[keep]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(query_ids[self.query] if len(self.query) else [], pa.string()),
                pa.array(self.item, pa.string()),
                pa.array(self.score, pa.float64()),
            ],
            schema=_HITS_ARROW,
        )


@dataclass
class Side:
    """All rows of a side that is proven small."""

    ids: np.ndarray
    x: np.ndarray
    k: np.ndarray | None = None


def _side(df: DataFrame, id_col: str, limit: int) -> Side | None:
    """The rows of ``df`` when they are few, else None. At most ``limit + 1`` rows move."""
    extra = ["k"] if "k" in df.columns else []
    table = df.select(id_col, F.col("embedding").cast("array<double>").alias("v"), *extra).limit(limit + 1).toArrow()
    if table.num_rows > limit or table.column("v").nbytes > SIDE_BYTES:
        return None
    k = table.column("k").to_numpy().astype(np.int64) if extra else None
    return Side(_ids(table.column(id_col).combine_chunks()), vector_matrix(table.column("v")), k)


def _ids(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object)


def _search_small_index(queries: DataFrame, side: Side) -> DataFrame:
    """The k best of a small index for every row of ``queries(query_id, embedding, k)``, which all differ."""
    shared = queries.sparkSession.sparkContext.broadcast(side)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = shared.value
        for batch in batches:
            if batch.num_rows == 0 or len(side.ids) == 0:
                continue
            best = Best(batch.column(2).to_numpy().astype(np.int64))
            best.add(vector_matrix(batch.column(1), side.x.shape[1]), side.x, side.ids)
            yield best.batch(_ids(batch.column(0)))

    rows = queries.select(F.col("query_id").cast("string"), F.col("embedding").cast("array<double>"), F.col("k").cast("long"))
    return rows.mapInArrow(search, HITS)


def _search_small_queries(index: DataFrame, side: Side) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(side)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = shared.value
        best = Best(side.k)
        for batch in batches:
            if batch.num_rows and len(side.ids):
                best.add(side.x, vector_matrix(batch.column(1), side.x.shape[1]), _ids(batch.column(0)))
        yield best.batch(side.ids)

    rows = index.select(F.col("item_id").cast("string"), F.col("embedding").cast("array<double>"))
    return _cut(rows.mapInArrow(search, HITS), int(side.k.max()) if len(side.k) else 1)


def _cut(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query (the most that any query asks for)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return hits.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k).drop("__place")


# --- both sides large -------------------------------------------------------------------


class Space:
    """Stand-ins of vectors, and pivots among them.

    ``sample`` is bounded. The directions are orthonormal; ``flip`` turns an upper bound into a lower one.
    """

    def __init__(self, sample: np.ndarray, pivots: int):
        dim = sample.shape[1]
        values, axes = np.linalg.eigh(sample.T @ sample)
        share = np.cumsum(values[::-1]) / max(values.sum(), 1e-300)
        kept = dim if dim <= SHORT else min(dim, HEAD, int(np.searchsorted(share, HEAD_SHARE)) + 1)
        self.axes = np.ascontiguousarray(axes[:, ::-1][:, :kept])
        self.dim = dim
        self.dense = dim > SHORT and 2 * kept > dim  # stand-ins as long as vectors leave nothing out
        self.pivots = self.stand_ins(sample[:pivots]).astype(np.float64)
        self.flip = np.ones(kept + 1, np.float32)
        self.flip[-1] = -1

    def stand_ins(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.axes
        rest = np.sqrt(np.maximum((x * x).sum(axis=1) - (y * y).sum(axis=1), 0.0))
        return np.hstack((y, rest[:, None])).astype(np.float32)


def _space(index: DataFrame, n_index: int, block_rows: int) -> Space:
    """From a bounded, repeatable sample: rows drawn by a hash of their id (at most SAMPLE_ROWS reach the driver)."""
    draw = F.pmod(F.xxhash64("item_id"), F.lit(1 << 30))
    most = (1 << 30) if n_index <= SAMPLE_ROWS else int((1 << 30) * 1.2 * SAMPLE_ROWS / n_index)
    picked = index.where(draw < most).orderBy(draw, "item_id").limit(SAMPLE_ROWS)
    table = picked.select(F.col("embedding").cast("array<double>").alias("v")).toArrow()
    return Space(vector_matrix(table.column("v")), max(1, min(MAX_PIVOTS, n_index // block_rows)))


def _placed(rows: DataFrame, id_col: str, shared) -> DataFrame:
    """``id, z, x, k, cell, gap, norm``: stand-in, vector, nearest pivot, distance to it and length of the stand-in."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = vector_matrix(batch.column(1), space.dim)
            z = space.stand_ins(x)
            cell, gap = np.empty(len(x), dtype=np.int32), np.empty(len(x))
            for s in range(0, len(x), CHUNK_QUERIES):
                away = _squared_distance(z[s : s + CHUNK_QUERIES].astype(np.float64), space.pivots)
                cell[s : s + CHUNK_QUERIES] = away.argmin(axis=1)
                gap[s : s + CHUNK_QUERIES] = np.sqrt(away.min(axis=1))
            norm = np.sqrt((x * x).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v.tobytes() for v in z], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary()),
                 batch.column(2), pa.array(cell), pa.array(gap), pa.array(norm)],
                names=["id", "z", "x", "k", "cell", "gap", "norm"],
            )

    slim = rows.select(F.col(id_col).cast("string").alias("id"), F.col("embedding").cast("array<double>"), F.col("k").cast("long"))
    return slim.mapInArrow(place, "id string, z binary, x binary, k bigint, cell int, gap double, norm double")


def _squared_distance(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2.0 * (x @ p.T))


class Cells:
    """Counts, radii and lengths of the cells of one side (at most MAX_PIVOTS rows), and their order.

    Cells are ordered so that near ones come together; blocks are numbered in this order, and consecutive
    blocks form tiles.
    """

    def __init__(self, placed: DataFrame, space: Space, block_rows: int):
        n = len(space.pivots)
        facts = placed.groupBy("cell").agg(
            F.count("*").alias("n"), F.max("gap").alias("radius"), F.max("norm").alias("longest")).toArrow()
        at = facts.column("cell").to_numpy()
        self.radius, self.longest = np.full(n, -np.inf), np.zeros(n)
        counts = np.zeros(n, np.int64)
        if len(at):
            counts[at] = facts.column("n").to_numpy()
            self.radius[at], self.longest[at] = facts.column("radius").to_numpy(), facts.column("longest").to_numpy()
        self.counts = counts
        self.parts = -(-counts // block_rows)
        order = _near_order(space.pivots)
        self.first = np.empty(n, np.int64)
        self.first[order] = np.cumsum(self.parts[order]) - self.parts[order]
        self.blocks = int(self.parts.sum())
        # blocks of a tile: small inputs are dealt to some TILES tasks too
        share = max(math.ceil(2 * TILE_ROWS[0] / block_rows), math.ceil(self.blocks / TILES))
        self.wide, self.tile = min(WIDE_TILE, share), min(TILE_BLOCKS, share)

    def packed(self, placed: DataFrame) -> DataFrame:
        """``block, cell, part, ids, z, x, k``: one row per block; a cell with many rows is split by a hash of the id."""
        parts, first = (F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("cell")) for values in (np.maximum(self.parts, 1), self.first))
        part = F.pmod(F.xxhash64("id"), parts).cast("int")
        return (
            placed.select("cell", part.alias("part"), F.struct("id", "z", "x", "k").alias("row"))
            .groupBy("cell", "part").agg(F.collect_list("row").alias("rows"))
            .select((first + F.col("part")).cast("int").alias("block"), "cell", "part", F.col("rows.id").alias("ids"), F.col("rows.z").alias("z"), F.col("rows.x").alias("x"), F.col("rows.k").alias("k"))
        )


def _near_order(points: np.ndarray) -> np.ndarray:
    """Rows in the order of a recursive halving along the widest direction."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= 2:
            out.append(rows)
            continue
        wide = np.ptp(points[rows], axis=0).argmax()
        rows = rows[np.argsort(points[rows, wide], kind="stable")]
        todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    return np.concatenate(out)


def _floats(column, row: int, kind) -> np.ndarray:
    """The vectors of one block, from a list of binaries of one size."""
    values = column[row].values
    n = len(values)
    if n == 0:
        return np.zeros((0, 1), kind)
    lo, hi = values.offset, values.offset + n
    offs = np.frombuffer(values.buffers()[1], np.int32)[lo : hi + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(kind).reshape(n, -1)


def _kth(scores: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th largest of each row, for the k of the row; minus infinity where there are fewer."""
    out = np.full(len(scores), -np.inf)
    for size in np.unique(k):
        rows = np.flatnonzero(k == size)
        if scores.shape[1] >= size:
            out[rows] = np.partition(scores[rows], -int(size), axis=1)[:, -int(size)]
    return out


def _floors(left: DataFrame, right: DataFrame, cells: Cells, shared) -> DataFrame:
    """``block, floor, cells`` of the query blocks: what the k-th best score of each query is at least, from the
    first blocks of the nearest cells, and the cells that may hold a better row by the bounds on their pivots."""
    space = shared.value
    held = np.flatnonzero(cells.parts > 0)
    near = _squared_distance(space.pivots, space.pivots[held]).argsort(axis=1, kind="stable")[:, :NEAR_CELLS]
    pairs = [(c, int(held[j])) for c in range(len(near)) for j in near[c]]
    pairs = left.sparkSession.createDataFrame(pairs, "cell int, near int")  # at most NEAR_CELLS rows per pivot
    first = right.where("part = 0").select(F.col("cell").alias("near"), F.col("z").alias("near_z"))
    around = materialise(F.broadcast(pairs).join(first, "near").groupBy("cell").agg(F.flatten(F.collect_list("near_z")).alias("near_z")), "near-blocks")
    radius, longest = cells.radius, cells.longest

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            blocks, floor, wanted = [], [], []
            for row in range(batch.num_rows):
                z, x = _floats(batch.column(1), row, np.float32), _floats(batch.column(2), row, np.float32)
                k = np.asarray(batch.column(3)[row].values, dtype=np.int64)
                low = np.empty(len(z))
                need = np.zeros(len(space.pivots), dtype=bool)
                for s in range(0, len(z), CHUNK_QUERIES):
                    q = z[s : s + CHUNK_QUERIES]
                    error = ROUGH * np.sqrt((q * q).sum(axis=1)) * max(1e-300, np.sqrt((x * x).sum(axis=1).max()))
                    low[s : s + CHUNK_QUERIES] = _kth((q * space.flip) @ x.T, k[s : s + CHUNK_QUERIES]) - error
                    need |= _may_reach(q.astype(np.float64), low[s : s + CHUNK_QUERIES], space.pivots, radius, longest).any(axis=0)
                blocks.append(batch.column(0)[row].as_py())
                floor.append(low.tobytes())
                wanted.append(np.flatnonzero(need & np.isfinite(radius)).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int32()), pa.array(floor, pa.binary()), pa.array(wanted, pa.list_(pa.int32()))], names=["block", "floor", "cells"])

    joined = left.select("block", "cell", "z", "k").join(around, "cell").select("block", "z", "near_z", "k")
    return materialise(joined.mapInArrow(floors, "block int, floor binary, cells array<int>"), "floors")


def _wanted(left: DataFrame, right: DataFrame, floors: DataFrame, cells: Cells) -> DataFrame:
    """``block, left_block, mask``: the rows of each searched block that a query block may want, as bits."""
    wide = F.floor(F.col("block") / cells.wide).cast("int").alias("tile")
    runs = max(1, math.ceil(cells.blocks / RUN_BLOCKS))
    parts, first = (F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("cell")) for values in (cells.parts, cells.first))
    # block numbers only: each wanted cell of a tile, with its blocks
    sought = (
        floors.select(wide, F.explode("cells").alias("cell")).distinct()
        .select("tile", F.explode(F.sequence(first, first + parts - 1)).alias("block"))
    )
    run = F.pmod(F.xxhash64("block"), F.lit(runs)).cast("int").alias("run")
    nothing = F.lit(None).cast("binary").alias("floor")
    sent = sought.select("tile", F.col("block").cast("int").alias("block")).join(right.select("block", "z"), "block").select("tile", run, F.lit(1).alias("kind"), "block", "z", nothing)
    held = left.select("block", "z").join(floors.select("block", "floor"), "block").select(
        wide, F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.lit(0).alias("kind"), "block", "z", "floor")
    rows = held.unionByName(sent).repartition("tile", "run").sortWithinPartitions("tile", "run", "kind")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, queries = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in range(batch.num_rows):
                tile, part, kind, block = (batch.column(c)[row].as_py() for c in range(4))
                if (tile, part) != current:
                    current, queries = (tile, part), []
                z = _floats(batch.column(4), row, np.float32)
                if kind == 0:
                    floor = np.frombuffer(batch.column(5)[row].as_buffer(), np.float64)
                    queries.append((block, z, floor, np.sqrt((z * z).sum(axis=1))))
                    continue
                longest = float(np.sqrt((z * z).sum(axis=1).max()))
                for left_block, q, floor, norm in queries:
                    bar = (floor - ROUGH * norm * longest).astype(np.float32)
                    bar = np.nextafter(bar, np.float32(-np.inf))
                    mask = np.zeros(len(z), bool)
                    for s in range(0, len(q), CHUNK_QUERIES):
                        mask |= (q[s : s + CHUNK_QUERIES] @ z.T >= bar[s : s + CHUNK_QUERIES, None]).any(axis=0)
                    if mask.any():
                        out.append((block, left_block, np.packbits(mask).tobytes()))
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["block", "left_block", "mask"])

    return materialise(rows.mapInArrow(sift, "block int, left_block int, mask binary"), "wanted")


def delivered(left: DataFrame, right: DataFrame, wanted: DataFrame, same: bool, extra: list[str], tile_blocks: int = TILE_BLOCKS) -> tuple[DataFrame, int]:
    """The whole vectors that the query blocks need, sorted by ``tile, run, kind``, and the number of runs.

    Kind 0 are the query blocks (``block, ids, x`` and their ``extra`` columns), once per run; kind 1 the
    searched rows: one row per block and tile with the rows that ``wanted(block, left_block, mask)`` names,
    and ``wants``, the masks of the tile's query blocks over them. With ``same`` sides, blocks that the tile
    holds as queries come without ids and vectors, and their masks are over all rows.
    """
    tile = lambda c: F.floor(F.col(c) / tile_blocks).cast("int")
    lists = wanted.groupBy(tile("left_block").alias("tile"), "block").agg(F.collect_list(F.struct("left_block", "mask")).alias("wants"))
    lists = materialise(lists, "wants")  # at most TILE_BLOCKS masks per row
    most = lists.groupBy("tile").count().agg(F.max("count")).first()[0] or 0
    runs = max(1, math.ceil(most / RUN_BLOCKS))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at, block = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                ids, wants = batch.column(2)[row].values, batch.column(4)[row].as_py()
                masks = [unpacked(w["mask"], len(ids)) for w in wants]
                held = same and block // tile_blocks == at
                rows = np.arange(len(ids)) if held else np.flatnonzero(np.logical_or.reduce(masks))
                x = b"" if held else _floats(batch.column(3), row, np.float64)[rows].tobytes()
                names = [] if held else ids.take(pa.array(rows)).to_pylist()
                wants = [{"left_block": w["left_block"], "mask": np.packbits(m[rows]).tobytes()} for w, m in zip(wants, masks)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int32()), pa.array([block], pa.int32()), pa.array([names], pa.list_(pa.string())), pa.array([x], pa.binary()),
                     pa.array([wants], pa.list_(pa.struct([("left_block", pa.int32()), ("mask", pa.binary())])))],
                    names=["tile", "block", "ids", "x", "wants"])

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [_floats(batch.column(2), row, np.float64).tobytes() for row in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(flat, pa.binary()), *batch.columns[3:]], names=names)

    masks = "array<struct<left_block:int,mask:binary>>"
    size = lists.agg(F.sum(F.aggregate("wants", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w["mask"]) + 16))).first()[0] or 0
    asked = F.broadcast(lists) if size <= SIDE_BYTES // 4 else lists
    sent = right.select("block", "ids", "x").join(asked, "block").select("tile", "block", "ids", "x", "wants").mapInArrow(
        extract, f"tile int, block int, ids array<string>, x binary, wants {masks}")
    kinds = dict(left.dtypes)
    run = F.pmod(F.xxhash64("block"), F.lit(runs)).cast("int").alias("run")
    sent = sent.select("tile", run, F.lit(1).alias("kind"), "block", "ids", "x", *[F.lit(None).cast(kinds[c]).alias(c) for c in extra], "wants")
    names = ["block", "ids", "x", *extra]
    held = left.select(*names).mapInArrow(flatten, ", ".join(["block int", "ids array<string>", "x binary", *[f"{c} {kinds[c]}" for c in extra]]))
    held = held.select(
        tile("block").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.lit(0).alias("kind"), *names, F.lit(None).cast(masks).alias("wants"))
    return held.unionByName(sent).repartition("tile", "run").sortWithinPartitions("tile", "run", "kind"), runs


def unpacked(mask: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(bool)


# --- all rows against all rows ----------------------------------------------------------


class Running:
    """The k best of the queries of a tile among the rows met so far; equal scores at the k-th place are kept until
    the end, where ids decide."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: np.ndarray):
        self.ids, self.x, self.k = ids, x, k
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.scale = max(float(self.norm.max(initial=0.0)), 1e-300)
        self.short = (x / self.scale).astype(np.float32)
        self.floor = np.full(len(x), -np.inf)
        self.query, self.item, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.names: list[np.ndarray] = []
        self.pending: list[tuple] = []
        self.seen = self.waiting = self.merged = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        longest = max(float(np.sqrt((x * x).sum(axis=1).max())), 1e-300)
        short = (x / longest).astype(np.float32)
        # error of products in single precision, as a share of the largest one
        error = 1.2e-7 * (x.shape[1] + 8) * self.norm / self.scale + 1e-30
        for s in range(0, len(self.x), CHUNK_PRODUCTS):
            part = slice(s, s + CHUNK_PRODUCTS)
            rough = self.short[part] @ short.T
            floor = self.floor[part] / self.scale / longest
            if not np.isfinite(floor).all():
                floor = np.maximum(floor, _kth(rough, self.k[part]) - error[part])
            bar = np.nextafter((floor - error[part]).astype(np.float32), np.float32(-np.inf))
            # the best of some products tells whether any of them counts; few do once rows were met (a nan is no answer)
            width = GROUP if rough.shape[1] % GROUP == 0 else rough.shape[1]
            rough = rough.reshape(-1, width)
            share = len(x) // width
            hot = np.flatnonzero(~(rough.max(axis=1).reshape(-1, share) < bar[:, None]).ravel())
            q, at = np.divmod(np.flatnonzero(rough[hot] >= bar[hot // share, None]), width)
            q, at = hot[q] // share + s, at + hot[q] % share * width
            for c in range(0, len(q), 65536):
                own, other = q[c : c + 65536], at[c : c + 65536]
                self.pending.append((own, other + self.seen, (self.x[own] * x[other]).sum(axis=1)))
                self.waiting += len(own)
                if self.waiting > PENDING:
                    self._merge(ids)
        self.names.append(ids)
        self.seen += len(ids)
        if self.seen >= 1.5 * self.merged:
            self._merge()
            self.merged = self.seen

    def _merge(self, unnamed=()) -> None:
        query, item, score = (np.concatenate((old, *new)) for old, new in zip((self.query, self.item, self.score), zip(*self.pending) if self.pending else ((), (), ())))
        self.pending, self.waiting = [], 0
        order = np.lexsort((-score, query))
        query, item, score = query[order], item[order], score[order]
        place = self._places(query)
        last = place == self.k[query] - 1
        self.floor[query[last]] = score[last]
        keep = score >= self.floor[query]
        self.query, self.item, self.score = query[keep], item[keep], score[keep]
        if len(self.query) > 2 * int(self.k.sum()) + 65536:
            self._by_name(np.concatenate([*self.names, unnamed]))

    @staticmethod
    def _places(query: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
        return np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))

    def _by_name(self, names: np.ndarray) -> None:
        """Of equal scores at the k-th place, those with the smallest ids stay."""
        many = (np.bincount(self.query, minlength=len(self.k)) > self.k)[self.query]
        rows = np.flatnonzero(many)
        keep = ~many
        if len(rows):
            rows = rows[np.lexsort((names[self.item[rows]].astype(str), -self.score[rows], self.query[rows]))]
            keep[rows[self._places(self.query[rows]) < self.k[self.query[rows]]]] = True
        self.query, self.item, self.score = self.query[keep], self.item[keep], self.score[keep]

    def batch(self) -> pa.RecordBatch:
        names = np.concatenate([np.empty(0, object), *self.names])
        self._merge()
        self._by_name(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[self.query], pa.string()), pa.array(names[self.item], pa.string()), pa.array(self.score, pa.float64())], schema=_HITS_ARROW)


def met(queries: DataFrame, index: DataFrame, n_queries: int, n_index: int, extra: list[str]) -> tuple[DataFrame, int]:
    """Every row of ``queries(id, embedding, *extra)`` with every row of ``index(id, embedding)``: groups sorted by
    ``tile, run, kind`` with the columns ``ids, x, *extra``, and the number of runs.

    Kind 0 are the queries of a tile, one a row and once per run; kind 1 the rows of the run, PACK_ROWS a row.
    """
    tile_rows = min(TILE_ROWS[1], max(TILE_ROWS[0], math.ceil(n_queries / TILES)))
    tiles, runs = max(1, math.ceil(n_queries / tile_rows)), min(RUNS, max(1, math.ceil(n_index / RUN_ROWS)))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, PACK_ROWS):
                part = batch.slice(s, PACK_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(pa.string())), pa.array([vector_matrix(part.column(1)).tobytes()], pa.binary())], names=["ids", "x"])

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, x = [[v] for v in batch.column(0).to_pylist()], [v.tobytes() for v in vector_matrix(batch.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.string())), pa.array(x, pa.binary()), *batch.columns[2:]], names=["ids", "x", *extra])

    kinds = dict(queries.dtypes)
    schema = "ids array<string>, x binary"
    vector = F.col("embedding").cast("array<double>")
    sent = index.select(F.col("id").cast("string"), vector).mapInArrow(together, schema)
    place = F.xxhash64(F.col("ids")[0])
    sent = sent.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.pmod(place, F.lit(runs)).cast("int").alias("run"), F.lit(1).alias("kind"), "ids", "x", *[F.lit(None).cast(kinds[c]).alias(c) for c in extra])
    # rows are made into bytes before they are copied for each run
    held = queries.select(F.col("id").cast("string"), vector, *extra).mapInArrow(one_by_one, ", ".join([schema, *[f"{c} {kinds[c]}" for c in extra]]))
    held = held.select(F.pmod(place, F.lit(tiles)).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.lit(0).alias("kind"), "ids", "x", *extra)
    rows = held.unionByName(sent).repartition(min(2 * tiles * runs, 2000), "tile", "run").sortWithinPartitions("tile", "run", "kind")
    return rows, runs


def groups(batches: Iterator[pa.RecordBatch]):
    """The groups of ``met``, one after the other: ``(ids, x, extra columns)`` of the queries, each extra column as
    the arrays of several batches, and an iterator over the ``(ids, x)`` of the rows they meet."""
    def parts():
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(axis=1)])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(marks)]):
                yield (int(marks[a, 0]), int(marks[a, 1])), int(marks[a, 2]), batch.slice(a, b - a)

    def bytes_of(part):
        return np.concatenate([np.frombuffer(v.as_buffer(), np.float64) for v in part.column(4)])

    todo = parts()
    ahead = next(todo, None)
    while ahead is not None:
        key, held = ahead[0], []
        while ahead is not None and ahead[0] == key and ahead[1] == 0:
            held.append(ahead[2])
            ahead = next(todo, None)

        def sent():
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                for row in range(ahead[2].num_rows):
                    ids = _ids(ahead[2].column(3)[row].values)
                    yield ids, np.frombuffer(ahead[2].column(4)[row].as_buffer(), np.float64).reshape(len(ids), -1)
                ahead = next(todo, None)

        meeting = sent()
        if held:
            ids = np.concatenate([_ids(p.column(3).flatten()) for p in held])
            x = np.concatenate([bytes_of(p) for p in held]).reshape(len(ids), -1)
            yield (ids, x, *[[p.column(c) for p in held] for c in range(5, held[0].num_columns)]), meeting
        for _ in meeting:  # what was not read, or met no query
            pass


def _search_all(queries: DataFrame, index: DataFrame, n_queries: int, n_index: int) -> DataFrame:
    """The k best rows of ``index`` for ``queries(query_id, embedding, k)``, by products of all with all."""
    asking = queries.select(F.col("query_id").alias("id"), "embedding", F.col("k").cast("long").alias("k"))
    rows, runs = met(asking, index.select(F.col("item_id").alias("id"), "embedding"), n_queries, n_index, ["k"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, sent in groups(batches):
            best = Running(held[0], held[1], np.concatenate([c.to_numpy() for c in held[2]]))
            for ids, x in sent:
                best.add(ids, x)
            yield best.batch()

    hits = rows.mapInArrow(search, HITS)
    return hits if runs == 1 else _cut(hits, int(queries.agg(F.max("k")).first()[0] or 1))


def _search_blocks(queries: DataFrame, index: DataFrame, block_rows: int) -> DataFrame:
    """The k best rows of ``index`` for ``queries(query_id, embedding, k)``, or for its own rows if that has a k."""
    spark = index.sparkSession
    same = queries is index
    searched = index if same else index.withColumn("k", F.lit(0))
    n_index = searched.count()
    if n_index == 0:
        return spark.createDataFrame([], HITS)
    space = _space(index, n_index, block_rows)
    if space.dense:
        asking = index.withColumn("query_id", F.col("item_id")) if same else queries
        return _search_all(asking, index, n_index if same else asking.count(), n_index)
    shared = spark.sparkContext.broadcast(space)
    placed = _placed(searched, "item_id", shared)
    cells = Cells(placed, space, block_rows)
    right = materialise(cells.packed(placed), "blocks")
    left = right
    if not same:
        asking = _placed(queries, "query_id", shared)
        mine = Cells(asking, space, block_rows)
        if not mine.blocks:
            return spark.createDataFrame([], HITS)
        left = materialise(mine.packed(asking), "query-blocks")
    floors = _floors(left, right, cells, shared)
    wanted = _wanted(left, right, floors, cells)

    # second pass: whole vectors of the rows that are left, to the small tiles that want them
    rows, runs = delivered(left, right, wanted, same, ["k"], cells.tile)
    dim = space.dim

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blocks = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                key = (batch.column(0)[row].as_py(), batch.column(1)[row].as_py())
                if key != current:
                    for names, _, best in blocks.values():
                        yield best.batch(names)
                    current, blocks = key, {}
                block = batch.column(3)[row].as_py()
                ids = _ids(batch.column(4)[row].values)
                x = np.frombuffer(batch.column(5)[row].as_buffer(), np.float64).reshape(-1, dim)
                if batch.column(2)[row].as_py() == 0:
                    blocks[block] = (ids, x, Best(np.asarray(batch.column(6)[row].values, dtype=np.int64)))
                    continue
                if not len(ids):
                    ids, x, _ = blocks[block]
                for want in batch.column(7)[row].as_py():
                    _, q, best = blocks[want["left_block"]]
                    mask = unpacked(want["mask"], len(ids))
                    best.add(q, x[mask], ids[mask])
        for names, _, best in blocks.values():
            yield best.batch(names)

    hits = rows.mapInArrow(search, HITS)
    if runs == 1:
        return hits  # a query's rows were all met in one task
    widest = (queries.agg(F.max("k")).first()[0] or 1)
    return _cut(hits, int(widest))


def _may_reach(q, floor, pivots, radius, longest) -> np.ndarray:
    """Cells that may hold a vector scoring at least ``floor``, for vectors of any length.

    With x within ``radius`` of the pivot p: q.x <= q.p + |q| radius, and, as |q - x| is at least
    |q - p| - radius, q.x <= (|q|^2 + longest^2 - (|q - p| - radius)^2) / 2.
    """
    squared = (q * q).sum(axis=1)[:, None]
    apart = np.maximum(0.0, np.sqrt(_squared_distance(q, pivots)) - radius[None, :] - 1e-5 * (1.0 + longest[None, :]))
    by_pivot = q @ pivots.T + np.sqrt(squared) * radius[None, :]
    by_distance = (squared + (longest * longest)[None, :] - apart * apart) / 2
    slack = ROUGH * (1.0 + np.abs(floor[:, None]) + np.sqrt(squared) * longest[None, :])
    return np.minimum(by_pivot, by_distance) >= floor[:, None] - slack


def _single(queries: DataFrame) -> DataFrame:
    """Queries without repeated rows; one id with two vectors is an error."""
    marks = queries.groupBy("query_id").agg(
        F.count("*").alias("n"), F.min(F.xxhash64("embedding")).alias("lo"), F.max(F.xxhash64("embedding")).alias("hi")
    ).where("n > 1")
    worst = marks.agg(F.count("*").alias("again"), F.max(F.struct(F.col("lo") != F.col("hi"), "query_id")).alias("odd")).first()
    if not worst["again"]:
        return queries
    if worst["odd"][0]:
        raise ValueError(f"query {worst['odd'][1]} has several vectors")
    return queries.dropDuplicates(["query_id"])


def _single_side(side: Side) -> Side:
    """``_single`` for a side that is at hand."""
    first: dict = {}
    for at, name in enumerate(side.ids):
        before = first.setdefault(name, at)
        if (side.x[before] != side.x[at]).any():
            raise ValueError(f"query {name} has several vectors")
    keep = np.array(sorted(first.values()), dtype=np.int64)
    return Side(side.ids[keep], side.x[keep], side.k[keep])


def nearest(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    side_rows: int = SIDE_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, item_id, score``: the k best rows of ``index(item_id, embedding)`` for every
    row of ``queries(query_id, embedding)``. A repeated query row counts once; item ids are distinct.
    With a column ``k``, each query has its own (and may get some rows more)."""
    own = "k" if "k" in queries.columns else F.lit(k).alias("k")
    queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding", own)
    side = _side(queries, "query_id", side_rows)
    if side is not None:
        return _search_small_queries(index, _single_side(side))
    queries = _single(queries)
    side = _side(index, "item_id", side_rows)
    if side is not None:
        return _search_small_index(queries, side)
    return _search_blocks(queries, index.select(F.col("item_id").cast("string").alias("item_id"), "embedding"), block_rows)


def retrieve_top_k(
    queries: DataFrame,
    index: DataFrame,
    k: int = 10,
    exclude: DataFrame | None = None,
    **limits,
) -> DataFrame:
    """``query_id, item_id, score, rank`` with ``exclude(query_id, item_id)`` rows left out.

    A query with exclusions fetches as many extra rows as its own list may hold (up to the next
    power of two), so removing them still leaves k whenever the index has them.
    """
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    if exclude is None:
        hits = nearest(queries, index, k, **limits)
    else:
        exclude = materialise(exclude.select("query_id", "item_id").distinct(), "excluded")
        extra = F.pow(F.lit(2), F.ceil(F.log2(F.count("*")))).cast("long").alias("extra")
        lengths = exclude.groupBy("query_id").agg(extra)
        wide = queries.select("query_id", "embedding").join(lengths.hint("merge"), "query_id", "left")
        wide = wide.select("query_id", "embedding", (F.lit(k) + F.coalesce("extra", F.lit(0))).cast("long").alias("k"))
        hits = nearest(wide, index, k, **limits).join(exclude.hint("merge"), ["query_id", "item_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_join(vectors: DataFrame, k: int, **limits) -> DataFrame:
    """Self join: ``src, dst, score, rank`` with the k nearest other items of every item.

    Copies of a vector are searched once. A group of copies is represented by its smallest
    ids, since ties are broken by id: k + 1 of them are enough for any item's list, so a
    group that holds a large share of the rows never meets itself pair by pair.
    """
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    unit = l2_normalize(
        vectors.select(F.col("item_id").cast("string").alias("item_id"), "embedding"),
        floor=arrays.ZERO_NORM,
    )
    # vectors are met by a hash first, so that sorts seldom compare whole vectors
    unit = materialise(unit.select("item_id", F.xxhash64("embedding").alias("__hash"), "embedding"), "unit-vectors")
    groups = materialise(unit.groupBy("__hash", "embedding").agg(F.min("item_id").alias("item_id")), "distinct-vectors")
    members = materialise(
        unit.join(groups.withColumnRenamed("item_id", "rep"), ["__hash", "embedding"]).select("item_id", "rep"),
        "copies",
    )
    groups = groups.select("item_id", "embedding")
    limits.setdefault("side_rows", SIDE_ROWS)
    limits.setdefault("block_rows", BLOCK_ROWS)
    side = _side(groups, "item_id", limits["side_rows"])
    groups = groups.withColumn("k", F.lit(k + 1))
    if side is not None:
        hits = _search_small_index(groups.withColumnRenamed("item_id", "query_id"), side)
    else:
        hits = _search_blocks(groups, groups, limits["block_rows"])

    by_id = Window.partitionBy("rep").orderBy("item_id")
    # written, so that a vector that is near to many, or has many copies, can be split in the joins below
    fronts = materialise(members.withColumn("__n", F.row_number().over(by_id)).where(F.col("__n") <= k + 1), "fronts")
    found = hits.join(fronts.select(F.col("rep").alias("item_id"), F.col("item_id").alias("dst")), "item_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "dst")
    lists = (
        found.withColumn("__n", F.row_number().over(best))
        .where(F.col("__n") <= k + 1)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("__n", "dst", "score"))).alias("near"))
    )
    lists = materialise(lists, "lists")
    others = F.slice(F.filter("near", lambda e: e["dst"] != F.col("src")), 1, k)
    return (
        members.withColumnRenamed("item_id", "src")
        .join(lists.withColumnRenamed("query_id", "rep"), "rep")
        .select("src", F.posexplode(others).alias("pos", "e"))
        .select("src", F.col("e.dst").alias("dst"), F.col("e.score").alias("score"), (F.col("pos") + 1).alias("rank"))
    )
