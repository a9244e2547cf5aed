"""Components, communities and layout against brute force and recorded floors."""

import pytest
from pyspark.sql import functions as F

from vector_atlas.config import CommunityConfig, LayoutConfig
from vector_atlas.operators import communities, graph, layout, quality
from vector_atlas.session import materialise


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60) if i % 13] + [(f"{i:03d}", "070") for i in range(75, 95)]
    nodes = [f"{i:03d}" for i in range(100)]
    got = graph.connected_components(
        spark.createDataFrame([(n,) for n in nodes], "item_id string"), spark.createDataFrame(edges, "src string, dst string")
    )
    assert {r.item_id: r.component for r in got.collect()} == components(nodes, edges)


@pytest.fixture(scope="module")
def planted(spark):
    """Groups of ten known communities: a test fixture, built from all pairs of a few hundred rows."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "label").collect()
    rows = []
    for x in e:
        for y in e:
            if x.vec_id < y.vec_id:
                h = (x.vec_id * 7919 + y.vec_id * 104729) % 1000
                if h < (200 if x.label == y.label else 5):
                    rows.append((str(x.vec_id), str(y.vec_id), 1.0))
    nodes = spark.createDataFrame([(str(x.vec_id), x.label) for x in e], "item_id string, label long")
    return nodes, materialise(spark.createDataFrame(rows, "src string, dst string, weight double"), "planted")


def test_communities_recover_planted_groups(spark, planted):
    nodes, edges = planted
    found = materialise(communities.detect_communities(nodes.select("item_id"), edges), "found")
    assert graph.modularity(edges, found).first()[0] >= 0.69
    counts = found.join(nodes, "item_id").groupBy("community", "label").count()
    best = counts.groupBy("community").agg(F.max("count").alias("n")).agg(F.sum("n")).first()[0]
    assert best / nodes.count() >= 0.97
    # every community is connected, and numbers are dense
    split = communities.split_disconnected(found, edges)
    assert split.select("name").distinct().count() == found.select("community").distinct().count()
    assert found.agg(F.max("community") + 1).first()[0] == found.select("community").distinct().count()
    # the same for any partitioning
    again = communities.detect_communities(nodes.select("item_id").repartition(7), edges.repartition(5))
    assert sorted(again.collect()) == sorted(found.collect())


def test_modularity_of_two_cliques(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    e = spark.createDataFrame([(*p, 1.0) for p in edges], "src string, dst string, weight double")
    m = spark.createDataFrame([(n, int(n > "m")) for n in "abcxyz"], "item_id string, community long")
    want = 2 * (3 / 7 - (7 / 14) ** 2)
    assert abs(graph.modularity(e, m).first()[0] - want) < 1e-12
    assert graph.modularity(e, m.withColumn("community", F.lit(1))).first()[0] == 0.0
    found = communities.detect_communities(m.select("item_id"), e, CommunityConfig())
    groups = {r.item_id: r.community for r in found.collect()}
    assert len(set(groups.values())) == 2 and len({groups[n] for n in "abc"}) == 1


def test_layout_keeps_neighbours(spark):
    """Clustered vectors: the layout must rank neighbourhoods at least as well as its start."""
    rows = spark.range(240).select(
        F.col("id").cast("string").alias("item_id"),
        F.transform(
            F.sequence(F.lit(0), F.lit(23)),
            lambda d: F.sin((F.col("id") % 8 + 1) * (d + 1) * 1.7)
            + 0.9 * F.sin(F.pmod(F.xxhash64(F.col("id"), d), F.lit(1000)).cast("double")),
        ).alias("embedding"),
    )
    rows = materialise(rows, "clustered")
    placed = materialise(layout.layout_2d(rows, LayoutConfig(n_neighbors=10)), "layout")
    start = layout.principal_coords(rows)
    after = quality.projection_quality(rows, placed).first()
    before = quality.projection_quality(rows, start).first()
    assert after.trustworthiness >= before.trustworthiness + 0.02
    assert placed.where("isnan(x) or isnan(y)").count() == 0 and placed.count() == 240


def test_long_chains_of_moves_settle(spark):
    """More rounds than the former limit of 12: a ring of cliques, whose merging takes its time."""
    rows = [(f"n{c:02d}{i}", f"n{c:02d}{j}", 1.0) for c in range(24) for i in range(4) for j in range(i + 1, 4)]
    rows += [(f"n{c:02d}0", f"n{(c + 1) % 24:02d}1", 1.0) for c in range(24)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"n{c:02d}{i}",) for c in range(24) for i in range(4)], "item_id string")
    found = communities.detect_communities(nodes, edges)
    got = communities.partition_quality(edges, found, CommunityConfig()).first()["modularity"]
    cliques = nodes.selectExpr("item_id", "cast(substring(item_id, 2, 2) as long) as community")
    # the best known: pairs of neighbouring cliques
    pairs = nodes.selectExpr("item_id", "cast(substring(item_id, 2, 2) as long) div 2 as community")
    known = max(communities.partition_quality(edges, m, CommunityConfig()).first()["modularity"] for m in (cliques, pairs))
    assert got >= known - 1e-9
    split = communities.split_disconnected(materialise(found, "found"), edges)
    assert split.select("name").distinct().count() == found.select("community").distinct().count()


def test_blocks_and_hubs_do_not_lower_modularity(spark, planted, monkeypatch):
    """Small blocks split communities, and a low limit sends many nodes down the hubs' way. After the
    first rounds only the links of nodes whose neighbours went elsewhere are moved."""
    nodes, edges = planted
    for name, value in {"BLOCK_NODES": 16, "BLOCK_LINKS": 1500, "HEAVY": 16}.items():
        monkeypatch.setattr(communities, name, value)
    trace: list = []
    found = materialise(communities.detect_communities(nodes.select("item_id"), edges, trace=trace), "found")
    assert graph.modularity(edges, found).first()[0] >= 0.68
    links = [t["links"] for t in trace if t["level"] == 0]
    assert 0 < links[0] < 2 * edges.count() and min(links) < links[0] / 3 and len(links) > 2
    split = communities.split_disconnected(found, edges)
    assert split.select("name").distinct().count() == found.select("community").distinct().count()


def test_a_level_ends_when_modularity_hardly_rises(spark, planted, monkeypatch):
    """Blocks side by side come to rest late; coarser levels make up for what a level leaves."""
    nodes, edges = planted
    for name, value in {"BLOCK_NODES": 16, "BLOCK_LINKS": 1500, "RISE": 1.0}.items():
        monkeypatch.setattr(communities, name, value)
    trace: list = []
    found = materialise(communities.detect_communities(nodes.select("item_id"), edges, trace=trace), "found")
    assert len([t for t in trace if t["level"] == 0]) == communities.CHECK_EVERY
    assert graph.modularity(edges, found).first()[0] >= 0.65


def test_large_tables_of_nodes_are_not_broadcast(spark, planted, monkeypatch):
    nodes, edges = planted
    monkeypatch.setattr(communities, "BROADCAST_ROWS", 100)
    facts = communities.Facts(nodes.count(), 2 * edges.count(), 100)
    links = materialise(graph.both_ways(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "weight")), "links")
    first = nodes.select(F.col("item_id").cast("long").alias("node"), F.col("item_id").cast("long").alias("community"), F.lit(1.0).alias("degree"), F.lit(1).alias("ties"))
    state = materialise(communities._described(materialise(first, "state"), 0, facts).withColumn("active", F.lit(True)), "nodes")
    rows = communities._moves(links, state, facts, facts.nodes, 1e-4)
    for table in (communities._described(state.select("node", "community", "degree", "ties"), 0, facts), rows):
        assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()
    assert rows.count() > 0


def test_a_safety_limit_is_an_error(spark):
    rows = [(f"n{i:02d}", f"n{j:02d}", 1.0) for i in range(12) for j in range(i + 1, 12) if (i * j) % 3]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(12)], "item_id string")
    with pytest.raises(RuntimeError, match="did not settle"):
        communities.detect_communities(nodes, edges, CommunityConfig(max_rounds=1))


def test_pulls_of_joins_and_of_broadcast_agree(spark):
    coords = spark.range(50).selectExpr("id as idx", "sin(id * 1.3) * 5 as x", "cos(id * 0.7) * 4 as y")
    links = spark.range(50).selectExpr("id as i", "explode(sequence(1, 4)) as s").selectExpr("i", "(i + s) % 50 as j", "cast(0.2 * s as double) as weight")
    a, b = (sorted((r.i, round(r.ax, 9), round(r.ay, 9), round(r.w, 9)) for r in f(coords, links, 1.5, 0.9).collect()) for f in (layout._pulls, lambda c, *rest: layout._pulls_of_few(layout._places(c), *rest)))
    assert a == b and len(a) == 50


def test_quadrants_hold_every_other_point_once(spark):
    """With cells of one point each, the push is that of all pairs."""
    import numpy as np

    rng = np.random.default_rng(2)
    # few points far apart on a fine tree: the centre of mass of a cell is the point itself
    x, y = rng.permutation(256)[:40] + 0.5, rng.permutation(256)[:40] + 0.5
    coords = spark.createDataFrame([(float(u), float(v)) for u, v in zip(x, y)] + [(0.0, 0.0), (256.0, 256.0)], "x double, y double")
    tree = layout.quadrants(coords, 10**9)
    assert tree.depth == 8 and tree.n == 42
    x, y = np.append(x, [0.0, 256.0]), np.append(y, [0.0, 256.0])
    same = layout.Quadrants.of(np.stack((x, y), axis=1))
    assert all(np.allclose(a, b) for a, b in zip(same.levels[: same.depth + 1], tree.levels[: same.depth + 1]))
    fx, fy = tree.push(x, y, 0.0, 0.5)
    dx, dy = x[:, None] - x[None, :], y[:, None] - y[None, :]
    d2 = np.maximum(dx * dx + dy * dy, 1e-6)
    force = 2 * 0.5 / (0.01 + d2)
    want = (np.clip(force * dx, -layout.MAX_STEP, layout.MAX_STEP)).sum(axis=1) / 41
    assert np.abs(fx - want).max() < 0.1 * np.abs(want).max()


def test_a_layout_that_does_not_settle_is_an_error(spark, planted):
    rows = spark.range(60).selectExpr("cast(id as string) as item_id", "array(sin(id), cos(id), sin(2.0 * id), 0.1 * id) as embedding")
    with pytest.raises(RuntimeError, match="did not settle"):
        layout.layout_2d(rows, LayoutConfig(n_neighbors=5, max_rounds=2))


def test_points_are_moved_by_many_tasks(spark):
    """Coordinates are few bytes, so tasks are counted by points, not by size."""
    coords = materialise(spark.range(20000).coalesce(1).selectExpr("id as idx", "sin(id * 1.3) * 5 as x", "cos(id * 0.7) * 4 as y"), "coords")
    links = materialise(spark.range(20000).coalesce(1).selectExpr("id as i", "(id + 1) % 20000 as j", "1.0d as weight"), "links")
    after, moved, _ = layout._turn(coords, links, 20000, 1.0, 1.5, 0.9, LayoutConfig())
    assert len(after.inputFiles()) >= 3 and after.count() == 20000 and moved > 0


def test_rounds_of_moves_write_no_tables_of_nodes(spark, monkeypatch):
    """The state of a level travels as arrays; the form with tables finds the same communities in one block."""
    rows = [(f"n{c}{i}", f"n{c}{j}", 1.0) for c in range(3) for i in range(5) for j in range(i + 1, 5)] + [("n00", "n10", 0.5), ("n11", "n21", 0.5)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"n{c}{i}",) for c in range(3) for i in range(5)], "item_id string")
    written, plain, found = [], communities.materialise, []
    monkeypatch.setattr(communities, "materialise", lambda df, name: written.append(name) or plain(df, name))
    for limit in (communities.STATE_ROWS, 0):
        monkeypatch.setattr(communities, "STATE_ROWS", limit)
        written.clear()
        found.append({tuple(r) for r in communities.detect_communities(nodes, edges).collect()})
        assert ("community-moves" in written) == (limit == 0)
    assert found[0] == found[1] and len({c for _, c in found[0]}) == 3
