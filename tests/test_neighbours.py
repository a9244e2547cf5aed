"""The physical forms of the neighbour search give the rows of brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vector_atlas.operators import neighbours
from vector_atlas.operators.neighbours import knn_join, retrieve_top_k

FORMS = {"small index": {}, "blocks": {"side_rows": 30, "block_rows": 40}}


def brute(rows, k):
    ids = [r.item_id for r in rows]
    x = np.array([r.embedding for r in rows], dtype="float64")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(x @ x.T, 10)
    out = []
    for i, one in enumerate(ids):
        near = sorted((-scores[i, j], other) for j, other in enumerate(ids) if j != i)[:k]
        out += [(one, other, n + 1) for n, (_, other) in enumerate(near)]
    return sorted(out)


def rows_of(df):
    return sorted((r.src, r.dst, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("form", FORMS)
def test_knn(vectors, form):
    assert rows_of(knn_join(vectors, 5, **FORMS[form])) == brute(vectors.collect(), 5)


@pytest.mark.parametrize("form", FORMS)
def test_knn_with_a_third_of_copies(vectors, form):
    same = F.array(*[F.lit(float(i % 5 - 2)) for i in range(64)])
    copied = vectors.withColumn(
        "embedding", F.when(F.col("item_id").cast("int") % 3 == 0, same).otherwise(F.col("embedding").cast("array<double>"))
    )
    assert rows_of(knn_join(copied, 4, **FORMS[form])) == brute(copied.collect(), 4)


def test_partitioning_does_not_matter(vectors):
    assert rows_of(knn_join(vectors.repartition(9), 3)) == rows_of(knn_join(vectors.coalesce(1), 3))


@pytest.mark.parametrize("limits", [{}, {"side_rows": 60}, {"side_rows": 5, "block_rows": 50}])
def test_excluded_items_are_replaced(vectors, limits):
    queries = vectors.where("label < 1").select(F.col("item_id").alias("query_id"), "embedding")
    own = queries.select("query_id", F.col("query_id").alias("item_id"))
    found = retrieve_top_k(queries, vectors, 6, own, **limits).collect()
    want = brute(vectors.collect(), 6)
    asked = {r.query_id for r in found}
    assert sorted((r.query_id, r.item_id, r["rank"]) for r in found) == [w for w in want if w[0] in asked]
    assert len(asked) == queries.count()


def test_k_beyond_the_index(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "item_id string, embedding array<double>")
    queries = rows.withColumnRenamed("item_id", "query_id")
    own = queries.select("query_id", F.col("query_id").alias("item_id"))
    assert retrieve_top_k(queries, rows, 10, own).count() == 2


ALL_FORMS = [{}, {"side_rows": 45}, {"side_rows": 5, "block_rows": 20}]


@pytest.mark.parametrize("limits", ALL_FORMS)
def test_repeated_queries_and_vectors_of_any_length(spark, limits):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) * rng.uniform(0.1, 5, size=(300, 1))
    x[::50] = 0
    items = spark.createDataFrame([(f"i{n:03d}", v) for n, v in enumerate(x.tolist())], "item_id string, embedding array<double>")
    rows = [(f"q{n:02d}", v) for n, v in enumerate(x[:40].tolist())]
    queries = spark.createDataFrame(rows + rows[:7] + rows[:3], "query_id string, embedding array<double>")
    skip = [(f"q{n:02d}", f"i{m:03d}") for n in range(5) for m in range(0, 300, 3 + 20 * n)]
    found = retrieve_top_k(queries, items, 4, spark.createDataFrame(skip, "query_id string, item_id string"), **limits).collect()
    want = []
    for n in range(40):
        scores = np.round(x @ x[n], 9)
        near = sorted((-scores[m], f"i{m:03d}") for m in range(300) if (f"q{n:02d}", f"i{m:03d}") not in set(skip))[:4]
        want += [(f"q{n:02d}", item, place + 1) for place, (_, item) in enumerate(near)]
    assert sorted((r.query_id, r.item_id, r["rank"]) for r in found) == sorted(want)


def test_one_query_with_two_vectors_is_an_error(spark):
    rows = spark.createDataFrame([("a", [1.0]), ("a", [2.0])], "query_id string, embedding array<double>")
    with pytest.raises(ValueError, match="several vectors"):
        retrieve_top_k(rows, rows.withColumnRenamed("query_id", "item_id"), 1)


def test_all_against_all_equals_brute_force(spark, monkeypatch):
    """Vectors without leading directions: no stand-ins, tiles meet all rows. Copies tie at the k-th place."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 40)) * rng.uniform(0.1, 9, size=(500, 1))
    x[5:30], x[300] = x[4], 0
    ids = [f"i{i:04d}" for i in rng.permutation(500)]
    for name, value in (("RUN_ROWS", 200), ("TILE_ROWS", (150, 300)), ("PACK_ROWS", 64)):
        monkeypatch.setattr(neighbours, name, value)

    def stand_ins(*_):
        raise AssertionError("stand-ins are as long as the vectors")

    monkeypatch.setattr(neighbours, "_floors", stand_ins)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "item_id string, embedding array<double>").repartition(5)
    asked = rows.select(F.col("item_id").alias("query_id"), "embedding")
    found = {(r.query_id, r.item_id): r.score for r in neighbours.nearest(asked, rows, 7, side_rows=10, block_rows=50).collect()}
    scores = [(x[i] * x).sum(axis=1) for i in range(500)]
    want = {(ids[i], ids[j]): scores[i][j] for i in range(500) for j in np.lexsort((np.array(ids), -scores[i]))[:7]}
    assert found == want


def test_products_that_wait_are_bounded(monkeypatch):
    """Every row that comes is nearer than those before, so all its products are among the best met so far."""
    import numpy as np

    from vector_atlas.operators import neighbours as nb

    monkeypatch.setattr(nb, "PENDING", 4096)
    rng = np.random.default_rng(5)
    x = np.abs(rng.standard_normal((600, 8)))
    best, most = nb.Running(np.array([f"q{i}" for i in range(600)], object), x, np.full(600, 3)), [0]
    merge = best._merge
    monkeypatch.setattr(best, "_merge", lambda *a: (most.append(best.waiting), merge(*a)))
    rows = np.abs(rng.standard_normal((8 * 512, 8))) * (1 + np.arange(8 * 512))[:, None]
    names = np.array([f"r{i:05d}" for i in range(len(rows))], object)
    for a in range(0, len(rows), 512):
        best.add(names[a : a + 512], rows[a : a + 512])
    got = best.batch().to_pydict()
    assert max(most) <= 4096 + 65536
    want = {(f"q{i}", names[j]) for i, row in enumerate(x @ rows.T) for j in np.argsort(-row)[:3]}
    assert set(zip(got["query_id"], got["item_id"])) == want


def test_what_tiles_give_out_grows_with_the_rows(spark, monkeypatch):
    """Each run of a tile gives out k rows per query, so their number must not grow with the rows that are searched."""
    monkeypatch.setattr(neighbours, "RUN_ROWS", 50)
    rows = spark.range(1000).selectExpr("cast(id as string) as id", "array(sin(id), cos(id), sin(2.0 * id)) as embedding")
    found, runs = neighbours.met(rows.selectExpr("*", "3L as k"), rows, 1000, 1000, ["k"])
    assert runs == 4
    assert found.where("kind = 0").count() == 4 * 1000 and found.where("kind = 1").selectExpr("sum(size(ids)) as n").first()["n"] == 1000
