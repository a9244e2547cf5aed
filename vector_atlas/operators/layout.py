"""Two-dimensional layout: principal components, then rounds of attraction and repulsion.

Neighbours attract along a fuzzy graph. All other points repel, seen as centres of mass of the cells
of a quadrant tree, which are finer the nearer they are. A round is one sum per node and one pass over
the coordinates; its result is a written table. Rounds end when the points hardly move. Coordinates
differ from those of a sequential optimiser; what counts is neighbourhood quality, which tests measure.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vector_atlas.config import LayoutConfig
from vector_atlas.functions import arrays
from vector_atlas.operators.graph import both_ways
from vector_atlas.operators.indexing import dense_index
from vector_atlas.operators.neighbours import knn_join
from vector_atlas.operators.vectors import l2_normalize, validate_vectors
from vector_atlas.session import materialise

START_SPAN = 10.0  # largest start coordinate
MAX_STEP = 4.0
COOLING = 0.9  # how much shorter steps get after a round that moved about as much as the one before
MAX_DEPTH = 8  # halvings of the plane: at most 65,536 cells
CELL_POINTS = 4  # points of a cell of the last level, about
COORD_ROWS = 2_000_000  # points whose coordinates (16 bytes each) may be sent to every task
STEP_ROWS = 8192  # points that one task moves, about


def principal_coords(vectors: DataFrame) -> DataFrame:
    """``item_id, x, y``: first two principal components of the unit vectors.

    The sign of each axis is fixed by its largest loading, so the result is repeatable.
    """
    unit = l2_normalize(vectors.select("item_id", "embedding"), floor=arrays.ZERO_NORM).select(
        "item_id", array_to_vector("embedding").alias("features")
    )
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(unit)
    loadings = model.pc.toArray()
    signs = [1.0 if column[np.argmax(np.abs(column))] >= 0 else -1.0 for column in loadings.T]
    pc = vector_to_array("pc")
    return model.transform(unit).select(
        "item_id", (pc[0] * signs[0]).alias("x"), (pc[1] * signs[1]).alias("y")
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _memberships(distances: pd.Series) -> pd.Series:
    """Fuzzy membership of each neighbour: the bandwidth gives every node log2(k) in total."""
    rows = [np.asarray(row, dtype="float64") for row in distances]
    sizes = np.array([len(row) for row in rows])
    out: list = [None] * len(rows)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        d = np.stack([rows[i] for i in at])
        gap = np.maximum(d - d.min(axis=1, keepdims=True), 0.0) if size else d
        target = math.log2(size) if size > 1 else 1.0
        low, high = np.full(len(at), 1e-9), np.full(len(at), 1e3)
        mid = np.sqrt(low * high)
        for _ in range(60):
            mid = np.sqrt(low * high)
            above = np.exp(-gap / mid[:, None]).sum(axis=1) > target
            high, low = np.where(above, mid, high), np.where(above, low, mid)
        for i, row in zip(at, np.exp(-gap / np.maximum(mid, 1e-3)[:, None])):
            out[i] = row
    return pd.Series(out)


def fuzzy_graph(neighbours: DataFrame) -> DataFrame:
    """``src, dst, weight``: union a + b - ab of the two directed memberships, one row per pair."""
    lists = neighbours.groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct("rank", "dst", (1.0 - F.col("score")).alias("d")))).alias("near")
    )  # at most k entries per node
    directed = (
        lists.withColumn("w", _memberships(F.col("near.d")))
        .select("src", F.explode(F.arrays_zip(F.col("near.dst").alias("dst"), F.col("w").alias("w"))).alias("e"))
        .select("src", F.col("e.dst").alias("dst"), F.col("e.w").alias("w"))
    )
    return (
        directed.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(F.sum("w").alias("s"), F.max("w").alias("hi"))
        .select("src", "dst", (F.col("s") - F.col("hi") * (F.col("s") - F.col("hi"))).alias("weight"))
    )


def _curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """Parameters of 1 / (1 + a d^(2b)) that follow an exponential beyond ``min_dist``."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    wanted = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    best = (math.inf, 1.0, 1.0)
    for b in np.linspace(0.5, 1.5, 101):
        for a in np.geomspace(0.3, 4.0, 101):
            error = float(((1.0 / (1.0 + a * d ** (2 * b)) - wanted) ** 2).sum())
            best = min(best, (error, float(a), float(b)))
    return best[1], best[2]


class Quadrants:
    """Centres of mass of the cells of a quadrant tree, and their push on points.

    The plane is halved ``depth`` times in both directions. A point is pushed by the cells that are near on
    a level, but not adjacent on it (their parents are adjacent), and on the last level by the adjacent
    cells as well, its own without itself. So each other point counts once, in about 27 cells a level.
    """

    def __init__(self, box: tuple[float, float, float], depth: int, cells: list[tuple[int, int, float, float]]):
        self.x0, self.y0, self.span = box
        self.depth = depth
        side = 1 << depth
        grid = np.zeros((3, side, side))
        if cells:
            code, n, sx, sy = (np.array(c) for c in zip(*cells))
            cx, cy = _uninterleave(code.astype(np.int64), depth)
            grid[:, cx, cy] = n, sx, sy
        self._sum_up(grid)

    @classmethod
    def of(cls, places: np.ndarray) -> Quadrants:
        """The tree of points that are at hand."""
        low, n = places.min(axis=0), len(places)
        depth = _depth(n)
        span = max(float((places.max(axis=0) - low).max()), 1e-9) * 1.000001
        cell = np.minimum(((places - low) / span * (1 << depth)).astype(np.int64), (1 << depth) - 1)
        flat, back, counts = np.unique(cell[:, 0] << depth | cell[:, 1], return_inverse=True, return_counts=True)
        tree = cls((float(low[0]), float(low[1]), span), depth, [])
        finest = tree.levels[-1]
        finest[:, flat >> depth, flat & ((1 << depth) - 1)] = counts, *(np.bincount(back, weights=places[:, c]) for c in (0, 1))
        tree._sum_up(finest)
        return tree

    def _sum_up(self, grid: np.ndarray) -> None:
        self.levels = [grid]
        while grid.shape[1] > 1:
            half = grid.shape[1] // 2
            grid = grid.reshape(3, half, 2, half, 2).sum(axis=(2, 4))
            self.levels.append(grid)
        self.levels.reverse()
        self.n = float(self.levels[0][0].sum())

    def push(self, x: np.ndarray, y: np.ndarray, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
        """The mean push of all other points on each of the points."""
        fx, fy = np.zeros(len(x)), np.zeros(len(x))
        for level in range(1, self.depth + 1):
            side = 1 << level
            n, sx, sy = self.levels[level]
            cx, cy = (np.clip(((c - c0) / self.span * side).astype(np.int64), 0, side - 1) for c, c0 in ((x, self.x0), (y, self.y0)))
            for ox in range(-3, 4):
                for oy in range(-3, 4):
                    adjacent = max(abs(ox), abs(oy)) <= 1
                    if adjacent and level < self.depth:
                        continue
                    tx, ty = cx + ox, cy + oy
                    use = (tx >= 0) & (tx < side) & (ty >= 0) & (ty < side)
                    if not adjacent:
                        use &= (np.abs((tx >> 1) - (cx >> 1)) <= 1) & (np.abs((ty >> 1) - (cy >> 1)) <= 1)
                    at = np.flatnonzero(use)
                    mass, mx, my = n[tx[at], ty[at]], sx[tx[at], ty[at]], sy[tx[at], ty[at]]
                    if ox == 0 and oy == 0:
                        mass, mx, my = mass - 1, mx - x[at], my - y[at]
                    held = mass > 0.5
                    at, mass, mx, my = at[held], mass[held], mx[held], my[held]
                    dx, dy = x[at] - mx / mass, y[at] - my / mass
                    d2 = np.maximum(dx * dx + dy * dy, 1e-6)
                    f = 2 * b / ((0.01 + d2) * (1 + a * d2**b))
                    fx[at] += mass * np.clip(f * dx, -MAX_STEP, MAX_STEP)
                    fy[at] += mass * np.clip(f * dy, -MAX_STEP, MAX_STEP)
        return fx / max(self.n - 1, 1), fy / max(self.n - 1, 1)


def _uninterleave(code: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros_like(code), np.zeros_like(code)
    for bit in range(depth):
        x |= ((code >> (2 * bit)) & 1) << bit
        y |= ((code >> (2 * bit + 1)) & 1) << bit
    return x, y


def _depth(n: int) -> int:
    return min(MAX_DEPTH, max(2, math.ceil(math.log(max(n / CELL_POINTS, 1), 4))))


def quadrants(coords: DataFrame, n: int) -> Quadrants:
    """The tree of ``coords(x, y)``: at most 4 ** MAX_DEPTH cells reach the driver, whatever ``n`` is."""
    depth = _depth(n)
    edge = coords.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)]).first()
    span = max(edge["max_x"] - edge["min_x"], edge["max_y"] - edge["min_y"], 1e-9) * 1.000001
    side = 1 << depth
    cx, cy = (F.least(F.floor((F.col(c) - F.lit(edge[f"min_{c}"])) / F.lit(span) * side), F.lit(side - 1)).cast("long") for c in "xy")
    code = F.lit(0).cast("long")
    for bit in range(depth):
        for shift, c in ((2 * bit, cx), (2 * bit + 1, cy)):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1).cast("long")), shift))
    cells = coords.groupBy(code.alias("cell")).agg(F.count("*"), F.sum("x"), F.sum("y")).collect()
    return Quadrants((edge["min_x"], edge["min_y"], span), depth, [tuple(r) for r in cells])


def layout_2d(
    vectors: DataFrame, config: LayoutConfig = LayoutConfig(), neighbours: DataFrame | None = None, **limits
) -> DataFrame:
    """``item_id, x, y`` for every vector; finite and repeatable for a seed.

    Rounds go on until the mean movement is below ``tolerance`` of the layout's extent (its mean distance from
    the centre). A round that moves more than nine tenths of the one before shortens the steps. A layout that
    has not settled after ``max_rounds`` is an error.
    """
    n = validate_vectors(vectors, config.n_neighbors)
    if neighbours is None:
        neighbours = knn_join(vectors, config.n_neighbors, **limits)
    start = materialise(dense_index(principal_coords(vectors), seed=config.seed), "layout-start")
    scale = start.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    coords = start.select("idx", (F.col("x") * START_SPAN / scale).alias("x"), (F.col("y") * START_SPAN / scale).alias("y"))
    numbers = start.select("item_id", "idx")
    pairs = (
        fuzzy_graph(neighbours)
        .join(numbers.select(F.col("item_id").alias("src"), F.col("idx").alias("i")), "src")
        .join(numbers.select(F.col("item_id").alias("dst"), F.col("idx").alias("j")), "dst")
        .select("i", "j", "weight")
    )
    graph = materialise(both_ways(pairs, "i", "j").repartition("i").sortWithinPartitions("i", "j"), "layout-graph")
    a, b = _curve(config.min_dist)
    rate, before = 1.0, math.inf
    coords = materialise(coords, "layout-state")
    for _ in range(config.max_rounds):
        coords, moved, extent = _turn(coords, graph, n, rate, a, b, config)
        if moved <= config.tolerance * max(extent, 1e-12):
            return numbers.join(coords, "idx").select("item_id", "x", "y")
        if moved > 0.9 * before:
            rate *= COOLING
        before = moved
    raise RuntimeError(f"layout did not settle in {config.max_rounds} rounds")


def _turn(coords, graph, n, rate, a, b, config) -> tuple[DataFrame, float, float]:
    """The coordinates after one step, their mean movement and extent."""
    if n <= COORD_ROWS:
        places = _places(coords)
        seen, pulls = Quadrants.of(places), _pulls_of_few(places, graph, a, b)
    else:
        seen, pulls = quadrants(coords, n), _pulls(coords, graph, a, b)
    tree = coords.sparkSession.sparkContext.broadcast(seen)
    strength = config.repulsion

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, ax, ay, w = (batch.column(c).to_numpy() for c in range(1, 6))
            fx, fy = tree.value.push(x, y, a, b)
            linked = w > 0
            dx, dy = (np.clip(np.where(linked, p / np.where(linked, w, 1.0), 0.0) + strength * f, -MAX_STEP, MAX_STEP) * rate for p, f in ((ax, fx), (ay, fy)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(x + dx), pa.array(y + dy), pa.array(np.hypot(dx, dy))], names=["idx", "x", "y", "moved"])

    watch = Observation()
    rows = coords.join(pulls, coords["idx"] == pulls["i"], "left").select("idx", "x", "y", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ax", "ay", "w")])
    # by number of rows: a table of coordinates is a few MB, which would go to a few tasks, but a row is some 10,000 operations
    rows = rows.repartition(math.ceil(n / STEP_ROWS), "idx")
    moved = rows.mapInArrow(step, "idx long, x double, y double, moved double").observe(
        watch, F.avg("moved").alias("moved"), *[f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.avg, F.stddev_pop)])
    after = materialise(moved, "layout-state").drop("moved")
    facts = watch.get
    return after, facts["moved"], math.hypot(facts["stddev_pop_x"], facts["stddev_pop_y"])


def _places(coords: DataFrame) -> np.ndarray:
    """All coordinates (at most COORD_ROWS) by number; nodes are numbered from 0 without gaps."""
    table = coords.select("idx", "x", "y").toArrow()
    places = np.empty((table.num_rows, 2))
    places[table.column("idx").to_numpy()] = np.stack([table.column(c).to_numpy() for c in "xy"], axis=1)
    return places


def _pulls_of_few(places: np.ndarray, graph: DataFrame, a: float, b: float) -> DataFrame:
    """``i, ax, ay, w`` with all coordinates at every task: links stay where they are, and only sums per task
    and node are shuffled."""
    shared = graph.sparkSession.sparkContext.broadcast(places)

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            i, j, w = (batch.column(c).to_numpy() for c in range(3))
            gap = places[j] - places[i]
            d2 = np.maximum((gap * gap).sum(axis=1), 1e-6)
            force = np.minimum(2 * a * b * d2 ** (b - 1) / (1 + a * d2**b), 1.0) * w
            nodes, back = np.unique(i, return_inverse=True)
            sums = [np.bincount(back, weights=v, minlength=len(nodes)) for v in (force * gap[:, 0], force * gap[:, 1], w)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), *[pa.array(v) for v in sums]], names=["i", "ax", "ay", "w"])

    parts = graph.select("i", "j", "weight").mapInArrow(pull, "i long, ax double, ay double, w double")
    return parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("ax", "ay", "w")])


def _pulls(coords: DataFrame, graph: DataFrame, a: float, b: float) -> DataFrame:
    """``i, ax, ay, w``: weighted sums of the pull of each node's neighbours, by two joins."""
    other = coords.select(F.col("idx").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    mine = coords.select(F.col("idx").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    links = graph.join(other, "j").join(mine, "i")
    dx, dy = F.col("xj") - F.col("xi"), F.col("yj") - F.col("yi")
    d2 = F.greatest(dx * dx + dy * dy, F.lit(1e-6))
    pull = F.least(F.lit(2 * a * b) * F.pow(d2, b - 1) / (1 + F.lit(a) * F.pow(d2, b)), F.lit(1.0)) * F.col("weight")
    return links.groupBy("i").agg(F.sum(pull * dx).alias("ax"), F.sum(pull * dy).alias("ay"), F.sum("weight").alias("w"))
