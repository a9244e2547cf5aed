"""Hand-made rows for scalar rules and small aggregates."""

import math

import pytest
from pyspark.sql import functions as F

from vector_atlas.config import FilterConfig
from vector_atlas.functions import arrays, cells, tags
from vector_atlas.functions.names import common_subsequence, normalize_name
from vector_atlas.operators import cleaning, frames, graph, linking, profile, quality, ranking
from vector_atlas.plans import recommend


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_split_tags(spark):
    got = column(spark, [None, "  ", "a, ,b,a", "\tX ,y\n"], "string", tags.split_tags("c"))
    assert got == [[], [], ["a", "b", "a"], ["X", "y"]]


def test_lower_tags_and_genres(spark):
    assert column(spark, ["A, b,A", None], "string", tags.lower_tags("c")) == ["a, b, a", ""]
    main = tags.main_genres("c", tags.GENRE_TAXONOMY, tags.EXCLUDED_GENRES)
    got = column(spark, ["Latin, Reggae, Rap", "Vocal", "rap", None, "Folk, Pop/Rock, Country"], "string", main)
    assert got == ["World, Hip-Hop/Rap", "", "", "", "Folk/Country, Rock/Pop"]


NAMES = {
    "Beyoncé": "beyonce",
    "Halo (feat. Someone)": "halo",
    "Live with Me": "live",
    "With You": "with you",
    "Ft. Nobody": "ft nobody",
    "Song [Remastered 2011] - Edit": "song edit",
    "AC/DC": "ac dc",
    "snake_case!": "snake_case",
    "Ünder  Prëssure ft. X": "under pressure",
    "(Intro)": "",
    "ﬁne": "fine",
}


def test_normalize_name(spark):
    rows = spark.createDataFrame([(k,) for k in NAMES] + [(None,)], "raw string")
    got = {r.raw: r.norm for r in normalize_name(rows, "raw", "norm").collect()}
    assert got == {**NAMES, None: ""}


def test_token_set_ratio(spark):
    pairs = {
        ("small ring", "ring small"): 100.0,
        ("small ring", "small ring deluxe"): 100.0,
        ("small ring", "small bolt"): 66.6667,
        ("red widget", "blue widget"): 76.1905,
        ("abc", "xyz"): 0.0,
        ("", "x"): 0.0,
    }
    rows = spark.createDataFrame(list(pairs), "left_name string, right_name string")
    got = {(r.left_name, r.right_name): round(r.ratio, 4) for r in linking.name_similarity(rows).collect()}
    assert got == pairs


def test_common_subsequence_against_table():
    def plain(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            previous = 0
            for j, y in enumerate(b, 1):
                previous, best[j] = best[j], previous + 1 if x == y else max(best[j], best[j - 1])
        return best[-1]

    words = ["", "a", "widget red", "widget blue", "abcabc", "cbacba", "x" * 70 + "y" * 70, "y" * 70 + "x" * 70]
    for a in words:
        for b in words:
            assert common_subsequence(a, b) == plain(a, b)


def test_refs_and_cells(spark):
    refs = ["https://open.spotify.com/track/Ab1?x=2", "spotify:track:Zz9", "  raw ", "https://open.spotify.com/playlist/Pp"]
    assert column(spark, refs, "string", cells.parse_ref_id("c")) == ["Ab1", "Zz9", "raw", refs[3]]
    assert column(spark, refs[3:], "string", cells.parse_ref_id("c", "playlist")) == ["Pp"]
    assert column(spark, ["1.23456", "x", None, "NaN"], "string", cells.clean_number("c")) == [1.2346, None, None, None]


def test_key_circular(spark):
    found = arrays.key_circular("c", F.lit("minor"))
    cosines = column(spark, ["C", "F#", "?", None], "string", found["key_cos"])
    assert [round(x, 9) for x in cosines] == [1.0, -1.0, 1.0, 1.0]


def test_arrays(spark):
    assert column(spark, [[1.0, 2.0, 3.0], [], [1.0]], "array<double>", arrays.pad_or_trim("c", 2)) == [[1, 2], [0, 0], [1, 0]]
    entropy = column(spark, [[1.0, 1.0], [0.0, 0.0], [], [4.0, 0.0]], "array<double>", arrays.histogram_entropy("c"))
    assert [round(x, 6) for x in entropy] == [1.0, 0.0, 0.0, 0.0]


def test_symmetrize(spark):
    edges = spark.createDataFrame([("1", "2", 0.8), ("2", "1", 0.6), ("1", "3", 0.4)], "src string, dst string, weight double")
    got = {
        m: {(r.src, r.dst): round(r.weight, 9) for r in graph.symmetrize_graph(edges, m).collect()} for m in ("max", "min", "mean")
    }
    assert got == {
        "max": {("1", "2"): 0.8, ("1", "3"): 0.4},
        "min": {("1", "2"): 0.6},
        "mean": {("1", "2"): 0.7, ("1", "3"): 0.2},
    }


def test_affinity_drops_loops_and_non_positive(spark):
    rows = spark.createDataFrame([("a", "a", 1.0), ("a", "b", -0.2), ("a", "c", 0.3), ("a", "c", 0.4)], "src string, dst string, score double")
    assert [(r.dst, round(r.weight, 9)) for r in graph.directed_affinity(rows).collect()] == [("c", 0.7)]


def test_pool_max(spark):
    rows = spark.createDataFrame([("r", "x", -0.2), ("r", "x", -0.1)], "request_id string, item_id string, score double")
    assert profile.pool_max(rows).first()["score"] == 0.0


def coverage(spark, points):
    tracks = spark.createDataFrame([(str(i), a, v) for i, (a, v) in enumerate(points)], "song_id string, arousal double, valence double")
    member = tracks.select(F.col("song_id").alias("item_id"), F.lit(1).cast("long").alias("community"))
    return quality.quadrant_coverage(tracks, member).first()["quadrant_coverage"]


def test_quadrant_coverage(spark):
    assert coverage(spark, [(0.0, 0.0), (1.0, -1.0), (-1.0, -1.0), (-1.0, 0.0)]) == 1.0
    assert coverage(spark, [(0.2, 0.7), (0.9, 0.1)]) == 0.25


def test_tag_entropy(spark):
    tracks = spark.createDataFrame([("1", "a, b"), ("2", "b, a"), ("3", "c, c"), ("4", None)], "song_id string, style string")
    member = spark.createDataFrame([("1", 1), ("2", 1), ("3", 2), ("4", 3)], "item_id string, community long")
    got = {(r.community, r["column"]): round(r.entropy, 9) for r in quality.tag_entropy(tracks, member, ("style", "theme")).collect()}
    assert got == {(1, "style"): 1.0, (2, "style"): 0.0, (3, "style"): 0.0, (1, "theme"): 0.0, (2, "theme"): 0.0, (3, "theme"): 0.0}


def test_match_report_without_attempts(spark):
    ten = spark.range(10).select(F.col("id").cast("string").alias("song_id"))
    none = spark.createDataFrame([], "song_id string, matched boolean")
    row = profile.match_report(ten, none, ten).first()
    assert (row.total, row.skipped, row.match_rate, row.matched) == (10, 10, 0.0, 0)


def test_filter_order_and_summary(spark):
    rows = [("1", "Q1", "a", "g", "t", "s"), ("2", "Q1", " ", "", "t", "s"), ("3", "Q1", "a", None, "t", "s"), ("4", "Q2", "a", "g", "t", "s")]
    tracks = spark.createDataFrame(rows, "song_id string, quadrant string, mood_all string, genre_main string, theme string, style string")
    listing = spark.createDataFrame([("Q1", "1"), ("Q1", "1"), ("Q1", "4")], "quadrant string, song_id string")
    kept, stats = cleaning.filter_tracks(tracks, FilterConfig(), listing)
    assert [r.song_id for r in kept.collect()] == ["1"]
    assert stats.first()["summary"] == "kept 1/4; dropped 3 (1 missing mood, 1 missing genre, 1 missing audio)"


def test_sample_is_exact_and_repeatable(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("song_id"))
    a = [r[0] for r in cleaning.sample_n(rows, 20, 3).collect()]
    b = [r[0] for r in cleaning.sample_n(rows.repartition(7), 20, 3).collect()]
    assert len(a) == 20 and a == b and a != [r[0] for r in cleaning.sample_n(rows, 20, 4).collect()]
    assert cleaning.sample_n(rows, 900).count() == 500


def test_describe_seeds(spark):
    rows = spark.createDataFrame([("r", i, [] if i == 2 else [f"A{i}"], f"T{i}") for i in range(1, 8)], "request_id string, position int, artists array<string>, title string")
    assert recommend.describe_seeds(rows).first()["intent"] == "tracks in the spirit of: A1 - T1; ? - T2; A3 - T3; A4 - T4; A5 - T5"


def test_search_key(spark):
    rows = spark.createDataFrame([('"A"', " t "), ("", "t"), ("a", None)], "artist string, title string")
    got = [(r.search_key, r.reason) for r in linking.catalogue_search_key(rows).collect()]
    assert got == [('artist:"A" track:"t"', None), (None, "artist must not be empty"), (None, "title must not be empty")]


def test_short_signals_and_few_intervals(spark):
    signal = spark.createDataFrame([("a", [1.0] * 10), ("b", [1.0] * 3)], "item_id string, samples array<double>")
    assert [(r.item_id, r.frame) for r in frames.frame_signal(signal, 4, 3).orderBy("frame").collect()] == [("a", 0), ("a", 1), ("a", 2)]
    items = signal.select("item_id")
    beats = spark.createDataFrame([("a", 0.0), ("a", 1.0)], "item_id string, t double")
    row = frames.interval_stats(frames.beat_intervals(beats), items).where("item_id = 'a'").first()
    assert (row["mean"], row["std"], row["cv"]) == (0.0, 0.0, 0.0)
    few = spark.createDataFrame([("a", [1.0, 2.0])], "item_id string, bins array<double>")
    assert frames.matrix_summary(few, items).where("item_id = 'a'").first()["max"] == 0.0


def test_pure_tone_has_its_frequency(spark):
    tone = [math.sin(2 * math.pi * 8 * t / 64) for t in range(256)]
    signal = spark.createDataFrame([("a", tone)], "item_id string, samples array<double>")
    rows = frames.spectrum_frames(frames.frame_signal(signal, 64, 32), 64.0).collect()
    assert len(rows) == 7 and all(abs(r.centroid - 8.0) < 1e-6 for r in rows)


def test_fit_floor_counts_dropped(spark):
    rows = spark.createDataFrame([("r", "a", 1, 0.9, ""), ("r", "b", 2, 0.4, ""), ("r", "c", 3, 0.5, "")], recommend.RANKING_SCHEMA)
    got = [(r.item_id, r.position, r.dropped) for r in ranking.fit_floor(rows, 99).orderBy("position").collect()]
    assert got == [("a", 1, 1), ("c", 2, 1)]


def test_best_match_prefers_score_then_rank_then_position(spark):
    rows = spark.createDataFrame(
        [("q", 1, 90.0, 90.0, None), ("q", 2, 90.0, 90.0, 5), ("q", 3, 90.0, 90.0, 5), ("q", 4, 100.0, 79.0, 9), ("z", 1, 50.0, 99.0, 1)],
        "song_id string, position int, artist_score double, title_score double, cand_rank long",
    )
    got = linking.pick_best(linking.score_candidate(rows), "song_id").collect()
    assert [(r.song_id, r.position) for r in got] == [("q", 2)]


@pytest.mark.parametrize("columns,label", [(("mood_all",), "b, a"), (("nothing",), "")])
def test_top_tags(spark, columns, label):
    tracks = spark.createDataFrame([("1", "a, b"), ("2", "b, c"), ("9", "z")], "song_id string, mood_all string")
    member = spark.createDataFrame([("1", 7), ("2", 7)], "item_id string, community long")
    assert [(r.community, r.label) for r in profile.top_tags(tracks, member, columns, 2).collect()] == [(7, label)]
