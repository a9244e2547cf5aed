"""One test per rule that must fail."""

import pytest
from pyspark.sql import functions as F

from vector_atlas import config
from vector_atlas.operators import cleaning, communities, frames, graph, joins, neighbours, quality, ranking, vectors as V
from vector_atlas.plans import recommend
from vector_atlas.sources import tables


def frame(spark, rows, schema="item_id string, embedding array<double>"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "make",
    [
        lambda: config.FilterConfig(required_groups=("mood", "x")),
        lambda: config.FilterConfig(sample_size=0),
        lambda: config.KnnConfig(k=0),
        lambda: config.KnnConfig(mode="sum"),
        lambda: config.CommunityConfig(resolution=0),
        lambda: config.LayoutConfig(n_neighbors=1),
        lambda: config.LayoutConfig(min_dist=2.0),
        lambda: config.LabelConfig(top_n=0),
        lambda: config.EmbeddingConfig("x", batch_size=0),
        lambda: ranking.check_limit(51),
        lambda: frames.feature_columns(["rhythm", "x"]),
    ],
)
def test_settings(make):
    with pytest.raises(ValueError):
        make()


@pytest.mark.parametrize(
    "rows,k",
    [
        ([("a", [1.0])], 1),
        ([("a", [1.0]), ("b", [1.0, 2.0])], 1),
        ([("a", [1.0]), ("b", [2.0])], 2),
        ([("a", [1.0]), ("b", [float("nan")])], 1),
    ],
)
def test_vector_rules(spark, rows, k):
    with pytest.raises(ValueError):
        V.validate_vectors(frame(spark, rows), k)


def test_zero_norm(spark):
    rows = frame(spark, [("a", [0.0, 0.0]), ("b", [1.0, 0.0])])
    with pytest.raises(Exception, match="zero-norm"):
        V.l2_normalize(rows).collect()
    assert V.l2_normalize(rows, strict=False).count() == 1


def test_join_rules(spark):
    a = spark.createDataFrame([("1",), ("2",)], "song_id string")
    with pytest.raises(ValueError, match="loses 1"):
        joins.join_one_to_one(a, a.limit(1), "song_id")
    with pytest.raises(ValueError, match="not unique"):
        joins.join_one_to_one(a.union(a), a, "song_id")


def test_missing_columns(spark, tmp_path):
    rows = spark.createDataFrame([("1",)], "song_id string")
    with pytest.raises(ValueError, match="missing columns"):
        cleaning.select_columns(rows, ["mood"])
    with pytest.raises(ValueError, match="unknown tag groups"):
        cleaning.select_columns(rows, ["x"])
    with pytest.raises(ValueError, match="missing columns"):
        cleaning.mark_drops(rows, config.FilterConfig())
    rows.write.csv(str(tmp_path / "m"), header=True)
    with pytest.raises(ValueError, match="missing columns"):
        tables.scan_metadata(spark, str(tmp_path / "m"))


def test_coords_must_be_complete(spark):
    vectors = frame(spark, [("a", [1.0]), ("b", [1.0])])
    coords = spark.createDataFrame([("a", 1.0, float("inf"))], "item_id string, x double, y double")
    with pytest.raises(ValueError, match="2 vectors"):
        joins.align_coords(vectors, coords)


@pytest.mark.parametrize("rows", [[], [("a", "b", -1.0)], [("a", "b", float("nan"))]])
def test_graph_rules(spark, rows):
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    with pytest.raises(ValueError):
        communities.check_graph(edges)


def test_ranking_rules(spark):
    pool = spark.createDataFrame([("r", "a")], "request_id string, item_id string")
    empty = spark.createDataFrame([], recommend.RANKING_SCHEMA)
    with pytest.raises(ValueError, match="no rows"):
        ranking.rank_items(empty, pool)
    other = spark.createDataFrame([("r", "b", 1, 0.5, "")], recommend.RANKING_SCHEMA)
    with pytest.raises(ValueError, match="outside the pool"):
        ranking.rank_items(other, pool)


def test_other_rules(spark):
    rows = frame(spark, [("a", [1.0]), ("b", [2.0])])
    with pytest.raises(ValueError):
        neighbours.knn_join(rows, 0)
    with pytest.raises(ValueError):
        graph.symmetrize_graph(spark.createDataFrame([], "src string, dst string, weight double"), "x")
    with pytest.raises(ValueError):
        quality.projection_quality(rows, rows, k=0)
    with pytest.raises(ValueError):
        ranking.top_seeds(spark.createDataFrame([], "user_id long, item_id string, ts timestamp"), "weekly")
    with pytest.raises(RuntimeError, match="no item"):
        V.embed_items(spark.createDataFrame([("a", None)], "item_id string, content string"), config.EmbeddingConfig("x"))
    corpus = recommend.Corpus(rows, rows, rows)
    with pytest.raises(ValueError, match="not in the index"):
        recommend.more_like_this(spark.createDataFrame([("zz",)], "item_id string"), corpus)


def test_bin_width(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0])], "item_id string, bins array<double>")
    with pytest.raises(Exception, match="needs 12 bins"):
        frames.frame_vector_mean(rows, 12).collect()
