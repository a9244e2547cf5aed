"""Forms for large inputs against brute force, with the bytes they shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vector_atlas.operators import indexing, neighbours, profile, quality, ranks
from vector_atlas.plans import acoustic
from vector_atlas.session import materialise
from vector_atlas.sources import tables


def shuffled_bytes(spark) -> int:
    """What all stages of the session have written for shuffles so far."""
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def written(spark, name, ids, x):
    rows = [(i, v.tolist()) for i, v in zip(ids, x)]
    return materialise(spark.createDataFrame(rows, "item_id string, embedding array<double>").repartition(6), name)


@pytest.mark.parametrize("n,dim", [(1500, 64), (700, 512)])
def test_stand_ins_lose_no_neighbour(spark, n, dim):
    """Vectors of one length whose spectrum falls, as that of embeddings does."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(n, dim)) * np.geomspace(1, 0.01, dim) + rng.normal(size=(12, dim))[rng.integers(0, 12, n)] * np.geomspace(1, 0.01, dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [f"i{i:05d}" for i in range(n)]
    rows = written(spark, "vectors", ids, x)
    before = shuffled_bytes(spark)
    found = neighbours.knn_join(rows, 5, side_rows=50, block_rows=64).collect()
    moved = shuffled_bytes(spark) - before
    scores = np.round(x @ x.T, 10)
    np.fill_diagonal(scores, -9)
    want = {(ids[i], ids[j]) for i in range(n) for j in np.lexsort((np.arange(n), -scores[i]))[:5]}
    assert {(r.src, r.dst) for r in found} == want and len(found) == 5 * n
    # blocks of 64 in tiles of 8: whole vectors to every tile would be n / 512 copies and the blocks themselves
    assert moved < (6 if dim == 512 else 9) * n * dim * 8


def test_ranks_of_cells_equal_ranks_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    x, p = rng.normal(size=(130, 20)) * np.geomspace(3, 0.05, 20), rng.normal(size=(130, 2))
    x[7], p[11], p[30:36] = x[9], p[12], p[30]  # equal vectors, equal places
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(f"i{n:03d}", a.tolist(), b.tolist()) for n, (a, b) in enumerate(zip(u, p))]
    points = materialise(spark.createDataFrame(rows, "item_id string, u array<double>, p array<double>"), "points")
    few = ranks.rank_excess(points, 5)
    assert ranks.rank_excess(points, 5, side_rows=10, block_rows=12) == few
    high, low = 1 - u @ u.T, np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    places = []
    for away in (high, low):
        away = np.round(away, 11)
        np.fill_diagonal(away, -1)
        places.append(np.argsort(np.lexsort((np.broadcast_to(np.arange(130), away.shape), away), axis=1), axis=1))
    rh, rl = places
    others = ~np.eye(130, dtype=bool)
    assert few == (int((np.where((rl <= 5) & (rh > 5) & others, rh - 5, 0)).sum()), int((np.where((rh <= 5) & (rl > 5) & others, rl - 5, 0)).sum()))


def test_ranks_of_all_pairs_in_tiles(spark, monkeypatch):
    """Vectors without leading directions, some of them equal: tiles meet all points."""
    rng = np.random.default_rng(8)
    x, p = rng.normal(size=(300, 20)), rng.normal(size=(300, 2))
    x[7], x[40:60], p[30:36] = x[9], x[40], p[30]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(f"i{n:03d}", a.tolist(), b.tolist()) for n, (a, b) in enumerate(zip(u, p))]
    points = materialise(spark.createDataFrame(rows, "item_id string, u array<double>, p array<double>"), "points")
    for name, value in (("RUN_ROWS", 120), ("TILE_ROWS", (90, 200)), ("PACK_ROWS", 50)):
        monkeypatch.setattr(neighbours, name, value)
    monkeypatch.setattr(ranks, "_open_cells", None)  # no cell is looked at
    assert ranks.rank_excess(points, 5, side_rows=10, block_rows=12) == ranks.rank_excess(points, 5)


def test_gram_matrix_of_many_partitions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 7))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "u array<double>").repartition(500)
    got = np.zeros((7, 7))
    for r in quality.gram_matrix(rows, "u").collect():
        got[r["dim"]] = r["products"]
    assert np.allclose(got, x.T @ x)
    assert quality.gram_matrix(rows.limit(0), "u").count() == 0


def test_vocabularies_of_many_tags(spark):
    from vector_atlas.schemas import VOCABULARY_COLUMNS

    n = 200_000
    names = list(dict.fromkeys(VOCABULARY_COLUMNS.values()))
    rows = spark.range(n).select(*[F.concat(F.lit("T" if i % 2 else "t"), F.lpad(((F.col("id") * 7919) % n).cast("string"), 7, "0")).alias(c) if i == 0 else F.lit("b, A, a").alias(c) for i, c in enumerate(names)])
    got = tables.label_vocabulary(rows)
    first = [v for v, c in VOCABULARY_COLUMNS.items() if c == names[0]][0]
    own = got.where(F.col("vocabulary") == first).selectExpr("cast(substring(tag, 2) as long) as n", "position").agg(F.count("*"), F.max(F.abs(F.col("position") - F.col("n") - 1))).first()
    assert tuple(own) == (n, 0)
    small = got.where(F.col("vocabulary") != first).select("tag", "position").distinct().collect()
    assert sorted((r.position, r.tag) for r in small) == [(1, "A"), (2, "a"), (3, "b")]


def test_average_ranks_share_ties(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0, 1.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["r"] for r in indexing.average_rank(rows, "v", "r").collect()}
    assert got == {0: 5.0, 1: 1.5, 2: 5.0, 3: 3.0, 4: 5.0, 5: 1.5}


def test_column_profile_shuffles_less_than_the_table(spark):
    n = 60_000
    rows = spark.range(n).selectExpr(
        "id", "id % 7 as few", "cast(id % 1000 as double) / 3 as d", "if(id % 5 = 0, null, if(id % 2 = 0, 0.0d, -0.0d)) as z", "if(id % 3 = 0, double('nan'), 1.0d) as f",
        "concat('name ', id % 50) as s", "array(id % 3, 1) as a", "cast(id % 11 as decimal(20, 2)) as dec", "id % 2 = 0 as b")
    rows = materialise(rows, "profiled")
    size = n * (8 * 5 + 12 + 24 + 16 + 1)
    before = shuffled_bytes(spark)
    got = {r.column: r for r in profile.column_profile(rows).collect()}
    assert shuffled_bytes(spark) - before < size
    assert {c: r.distinct for c, r in got.items()} == {"id": n, "few": 7, "d": 1000, "z": 1, "f": 1, "s": 50, "a": 3, "dec": 11, "b": 2}
    assert got["z"].null_pct == 20 and abs(got["f"].null_pct - 100 / 3) < 0.01 and (got["id"].min, got["id"].max, got["s"].min) == (0, n - 1, None)
    empty = {r.column: (r.distinct, r.null_pct) for r in profile.column_profile(rows.limit(0)).collect()}
    assert set(empty.values()) == {(0, 0.0)} and len(empty) == 9


def test_acoustic_rows_of_what_is_known(spark):
    items = spark.createDataFrame([("a",), ("b",), ("a",)], "item_id string")
    onset = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "item_id string, value double")
    hpcp = spark.createDataFrame([("b", [1.0] + [0.0] * 11), ("b", [0.0] * 11 + [1.0])], "item_id string, bins array<double>")
    rows = {r.item_id: r for r in acoustic.acoustic_rows(items, acoustic.FrameTables(onset=onset, hpcp=hpcp)).collect()}
    assert len(rows["a"]) == 57 and set(rows) == {"a", "b"}
    assert (rows["a"].onset_strength_mean, rows["a"].onset_strength_std, rows["a"].hpcp_0, rows["a"].tempo_bpm) == (2.0, 1.0, 0.0, 0.0)
    assert (rows["b"].hpcp_0, rows["b"].hpcp_11, rows["b"].hpcp_max, rows["b"].hpcp_entropy) == (0.5, 0.5, 0.5, pytest.approx(1.0, abs=1e-6))
    assert rows["b"].onset_strength_mean == 0.0
    rhythm = acoustic.acoustic_rows(items, acoustic.FrameTables(onset=onset, hpcp=hpcp), groups=["rhythm"])
    assert len(rhythm.columns) == 24 and acoustic.acoustic_rows(items, acoustic.FrameTables()).count() == 2
    wrong = acoustic.acoustic_rows(items, acoustic.FrameTables(hpcp=hpcp.withColumn("bins", F.slice("bins", 1, 5))))
    with pytest.raises(Exception, match="12 bins"):
        wrong.collect()
