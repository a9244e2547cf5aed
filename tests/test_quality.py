"""Closed forms against direct computation."""

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from vector_atlas.operators import indexing, quality, vectors as V


def test_silhouette_equals_evaluator(vectors):
    member = vectors.select("item_id", F.col("label").alias("community"))
    row = quality.cluster_quality(vectors, member).first()
    table = vectors.select(array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("prediction"))
    want = ClusteringEvaluator(distanceMeasure="cosine").evaluate(table)
    assert abs(row.silhouette_mean - want) < 1e-9
    blocks = quality.silhouette(vectors, member, side_rows=4, block_rows=5).agg(F.avg("silhouette")).first()[0]
    assert abs(blocks - want) < 1e-9


def test_silhouette_needs_two_clusters(vectors):
    one = vectors.select("item_id", F.lit(1).cast("long").alias("community"))
    assert quality.cluster_quality(vectors, one).first().silhouette_mean is None


def test_exact_pairwise_cosine(vectors):
    x = np.array([r.embedding for r in vectors.collect()], dtype="float64")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = (x @ x.T)[~np.eye(len(x), dtype=bool)]
    row = quality.pairwise_cosine_exact(vectors).first()
    assert abs(row.exact_mean_cosine - c.mean()) < 1e-9 and abs(row.exact_std_cosine - c.std()) < 1e-9


def test_sanity_flags(spark):
    rows = spark.createDataFrame(
        [("a", [1.0, float("nan")]), ("b", [float("inf"), 0.0]), ("c", [0.0, 0.0])], "item_id string, embedding array<double>"
    )
    flags = quality.embedding_sanity(rows).first()
    assert flags.has_nan and flags.has_inf and flags.has_zero_norm and flags.n_dims == 2
    empty = quality.embedding_sanity(rows.where("item_id = 'x'")).first()
    assert (empty.n_samples, empty.has_nan, empty.mean_pairwise_cosine) == (0, False, 0.0)


def test_dense_index_and_pairs(spark):
    items = spark.range(1000).select(F.col("id").cast("string").alias("item_id"))
    a = sorted(r.idx for r in indexing.dense_index(items).collect())
    assert a == list(range(1000))
    pairs = indexing.random_pairs(items, 300).collect()
    assert len(pairs) == 300 and all(p.i != p.j for p in pairs)
    assert sorted(pairs) == sorted(indexing.random_pairs(items.repartition(5), 300).collect())
    assert indexing.random_pairs(items.limit(3), 300).count() == 3
    assert indexing.random_pairs(items.limit(1), 300).count() == 0


def test_projection_by_hand(spark):
    """A line kept in order is perfect; few points give zeros."""
    rows = spark.range(40).select(
        F.format_string("%02d", "id").alias("item_id"),
        F.array(F.cos(F.col("id") / 40.0), F.sin(F.col("id") / 40.0)).alias("embedding"),
        (F.col("id") / 40.0).alias("x"),
        F.lit(0.0).alias("y"),
    )
    row = quality.projection_quality(rows.select("item_id", "embedding"), rows.select("item_id", "x", "y"), k=4).first()
    assert row.k == 4 and row.n_samples == 40 and row.trustworthiness > 0.97 and row.shepard_rho > 0.99
    few = rows.limit(5)
    row = quality.projection_quality(few.select("item_id", "embedding"), few.select("item_id", "x", "y"), k=15).first()
    assert (row.trustworthiness, row.continuity, row.shepard_rho) == (0.0, 0.0, 0.0)


def test_graph_quality_without_edges(spark):
    edges = spark.createDataFrame([], "src string, dst string, weight double")
    one = spark.createDataFrame([("a", 1)], "item_id string, community long")
    row = quality.graph_quality(edges, one).first()
    assert (row.n_nodes, row.n_components, row.n_communities, row.modularity) == (1, 0, 0, 0.0)
    two = spark.createDataFrame([("a", 1), ("b", 2)], "item_id string, community long")
    assert quality.graph_quality(edges, two).first().n_components == 2


def test_failing_items_become_rows(spark):
    class Picky(V.HashingEncoder):
        def embed_text(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("refused")
            return super().embed_text(texts)

    items = spark.createDataFrame([(str(i), "bad" if i % 4 == 0 else f"good words {i}") for i in range(20)], "item_id string, content string")
    from vector_atlas.config import EmbeddingConfig

    rows, meta, failures = V.embed_items(items, EmbeddingConfig("picky"), Picky)
    assert rows.count() == 15 and failures.count() == 5 and failures.first().error == "refused"
    assert len(meta.first()["mean"]) == 32


def test_seed_vectors_are_distinct_before_they_are_laid_out(spark):
    """No aggregate lies over the rows of the exploded vectors."""
    import bindings.queries  # noqa: F401
    from bindings.registry import QUERIES

    rows = QUERIES["seed_vectors"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Generate posexplode")[0]
    assert rows.count() == rows.distinct().count() > 0


def test_tables_that_grow_are_not_broadcast(spark):
    """Their files are small beside their rows; labels of communities are few and may be."""
    from bindings import queries, roles

    t = roles.Tables(spark, "/root/testdata/sf0.001")
    for rows in (t.tracks(), queries._requests(t)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_requests_with_the_same_seed_are_searched_once(spark, monkeypatch):
    from vector_atlas.plans import recommend

    asked = []

    def search(queries, *rest, **limits):
        asked.append(queries.count())
        return retrieve_top_k(queries, *rest, **limits)

    retrieve_top_k = recommend.retrieve_top_k
    monkeypatch.setattr(recommend, "retrieve_top_k", search)
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0])], "item_id string, embedding array<double>")
    rows = [(f"r{i}", "1:a", [1.0, 0.0], "a") for i in range(9)] + [("s", "2:", [0.0, 1.0], None)]
    embedded = spark.createDataFrame(rows, "request_id string, seed_id string, embedding array<double>, corpus_id string")
    found = {(r.query_id, r.item_id, r["rank"]) for r in recommend._hits_of_requests(embedded, index, 2).collect()}
    assert asked == [2]
    assert found == {(f"r{i}", x, n) for i in range(9) for x, n in (("b", 1), ("c", 2))} | {("s", "c", 1), ("s", "b", 2)}


def test_the_plane_is_counted_and_searched_by_cells(monkeypatch):
    """Circles and nearest points from the grid equal brute force, also with copies, ties and crowded cells; of a wide circle
    only the points on its rim are looked at."""
    import numpy as np

    from vector_atlas.operators import ranks

    rng = np.random.default_rng(5)
    plain = rng.standard_normal((400, 2))
    far = plain.copy()
    far[0] = 1e9
    copies = plain.copy()
    copies[:200] = copies[0]
    for places in (plain, np.round(plain, 1), far, plain * [1, 0], copies, np.ones((30, 2)), plain[:9]):
        n = len(places)
        field = ranks.Field(places)
        away = np.sqrt(((places[:, None] - places[None]) ** 2).sum(axis=2))
        np.fill_diagonal(away, np.inf)
        pairs = [np.concatenate(c) for c in zip(*(field.nearest(b, 5) for b in range(field.blocks)))]
        want = {(i, int(j)) for i in range(n) for j in np.lexsort((np.arange(n), away[i]))[:5]}
        assert len(pairs[0]) == len(want) and set(zip(*(p.tolist() for p in pairs))) == want
        i, j = rng.integers(0, n, 60), rng.integers(0, n, 60)
        i, j = i[i != j], j[i != j]
        before = [(away[a] - away[a, b] < -ranks.TIE) | ((np.abs(away[a] - away[a, b]) <= ranks.TIE) & (np.arange(n) < b)) for a, b in zip(i, j)]
        assert field.count(i, j) == sum(int(v.sum()) for v in before)
    field = ranks.Field(rng.standard_normal((40_000, 2)))
    looked, plain_ranges = [], ranks._ranges
    monkeypatch.setattr(ranks, "_ranges", lambda a, b: looked.append(int(np.maximum(b - a, 0).sum())) or plain_ranges(a, b))
    field.count(np.arange(50), np.arange(50, 100))
    assert sum(looked) < 50 * 40_000 / 10


def test_products_in_single_precision_count_as_whole_ones():
    import numpy as np

    from vector_atlas.operators import ranks

    rng = np.random.default_rng(6)
    u = rng.standard_normal((300, 40))
    u /= np.linalg.norm(u, axis=1)[:, None]
    u[10:90], u[5] = u[10], 0
    u[100:200] = u[100] + 1e-8 * rng.standard_normal((100, 40))  # closer to each other than single precision tells
    names = np.array([f"n{k:03d}" for k in rng.permutation(300)], dtype=object)
    js, away = [], []
    for r in range(300):
        asked = rng.choice(300, rng.integers(0, 15), replace=False)
        asked = asked[asked != r]
        js.append(names[asked])
        away.append(1.0 - u[asked] @ u[r])
    own = np.stack((np.arange(300), np.arange(300)), axis=1)
    assert ranks._Products(u, js, away).count(names, u, own) == ranks._count_apart(ranks.Cosine, u, js, away, names, u, own)
