"""Every operator bound to the driver tables, next to the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import ORACLES, bind
from bindings.roles import EXCLUDED, TAXONOMY, VIEWS, Tables, with_views
from vector_atlas.config import (
    ClusterConfig, CommunityConfig, EmbeddingConfig, FilterConfig, KnnConfig, LayoutConfig, PlaylistConfig,
)
from vector_atlas.functions import arrays, cells, names, tags
from vector_atlas.operators import (
    cleaning, communities, frames, graph, indexing, joins, layout, linking, neighbours, profile, quality, ranking,
    vectors,
)
from vector_atlas.plans import cluster_space as clustering
from vector_atlas.plans import acoustic, evaluate, preprocess, recommend
from vector_atlas.schemas import TABLE_COLUMNS, require_columns
from vector_atlas.session import materialise, scratch_path
from vector_atlas.sources import catalogue, files, stores, tables

MODES = ("max", "min", "mean")


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _clean(t: Tables):
    return cleaning.clean_tracks(t.tracks(), TAXONOMY, EXCLUDED)


# --- A. sources and sinks -----------------------------------------------------------------------

_META_SQL = """select song_id, quadrant, artist, title, cast(duration as varchar) duration, mood, mood_all,
  mood_all_weights, genre, genre_weights, theme, theme_weights, style, style_weights from tracks"""


def _metadata_csv(t: Tables):
    path = scratch_path(t.spark, "metadata")
    t.raw_metadata().write.csv(path, header=True, escape='"', quote='"')
    return path


@bind("scan_metadata", _META_SQL, using="tracks")
def _(spark, d):
    return tables.scan_metadata(spark, _metadata_csv(Tables(spark, d)))


@bind("scan_av", "select song_id, round(arousal, 6) arousal, round(valence, 6) valence from tracks", using="tracks")
def _(spark, d):
    path = scratch_path(spark, "av")
    t = Tables(spark, d).tracks()
    t.select(F.col("song_id").alias("Song"), F.col("arousal").alias("Arousal"), F.col("valence").alias("Valence")).write.csv(path, header=True)
    return tables.scan_av(spark, path).select("song_id", *r6("arousal", "valence"))


_TABLE_SQL = """select song_id, quadrant, round(arousal, 6) arousal, round(valence, 6) valence, artist, title, duration,
  {tags} from clean"""
_TAG_LIST = "mood, mood_all, mood_all_weights, genre, genre_weights, genre_main, theme, theme_weights, style, style_weights"
# an empty cell of a CSV file reads back as null
_CSV_TAGS = ", ".join(f"nullif({c.strip()}, '') {c.strip()}" for c in _TAG_LIST.split(","))


@bind("read_tracks", _TABLE_SQL.format(tags=_TAG_LIST), using="clean")
def _(spark, d):
    path = tables.write_tracks(_clean(Tables(spark, d)), scratch_path(spark, "tracks"))
    return tables.read_tracks(spark, path).withColumns({c: F.round(c, 6) for c in ("arousal", "valence")})


@bind("write_tracks", _TABLE_SQL.format(tags=_CSV_TAGS), using="clean")
def _(spark, d):
    path = tables.write_tracks(_clean(Tables(spark, d)), scratch_path(spark, "tracks"), "csv")
    back = tables.read_tracks(spark, path, "csv")
    texts = [c for c, kind in back.dtypes if kind == "string"]
    return back.withColumns({c: F.nullif(c, F.lit("")) for c in texts}).withColumns(
        {c: F.round(c, 6) for c in ("arousal", "valence")}
    )


def _index(t: Tables, center: bool = True):
    raw = t.vectors()
    mean = vectors.mean_vector(raw)
    rows = vectors.l2_normalize(vectors.center_vectors(raw, mean, center))
    meta = mean.select(
        "mean", F.lit(center).alias("center"), F.lit(True).alias("normalize"), F.lit("bound").alias("name"),
        F.lit("given").alias("model_id"), F.lit(44100).alias("sample_rate"),
    )
    return rows, meta


@bind(
    "vector_store",
    """, stored as (select item_id, list_transform(u, lambda x: cast(cast(x as float) as double)) s from centred)
    select item_id, pos, round(v / n, 6) val from (
      select item_id, sqrt(list_inner_product(s, s)) n, unnest(s) v, generate_subscripts(s, 1) - 1 pos from stored)""",
    using="centred",
)
def _(spark, d):
    rows, meta = _index(Tables(spark, d))
    index = stores.read_vectors(spark, stores.write_vectors(rows, meta, scratch_path(spark, "index")))
    return index.vectors.select("item_id", F.posexplode("embedding").alias("pos", "v")).select(
        "item_id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("val")
    )


def _graph10(t: Tables, mode="max", **options):
    return graph.build_knn_graph(t.vectors(), KnnConfig(k=10, mode=mode, **options))


@bind(
    "graph_store",
    """select g.src, g.dst, round(g.weight, 6) weight, a.community src_community, b.community dst_community
    from graph10 g join membership a on a.item_id = g.src join membership b on b.item_id = g.dst""",
    using="graph10 membership",
)
def _(spark, d):
    t = Tables(spark, d)
    edges, member = stores.read_graph(spark, stores.write_graph(_graph10(t), t.membership(), scratch_path(spark, "graph")))
    a = member.toDF("src", "src_community")
    b = member.toDF("dst", "dst_community")
    return edges.join(a, "src").join(b, "dst").select("src", "dst", *r6("weight"), "src_community", "dst_community")


def _clusters(t: Tables):
    labels = profile.top_tags(t.tracks(), t.membership())
    return stores.clusters_table(t.membership(), labels, t.coords())


_CLUSTERS_SQL = """select m.item_id song_id, m.community, l.label, round(c.x, 6) x, round(c.y, 6) y
  from membership m join labels3 l on l.community = m.community join coords c on c.item_id = m.item_id"""


@bind("write_clusters", _CLUSTERS_SQL, using="membership labels3 coords")
def _(spark, d):
    path = stores.write_clusters(_clusters(Tables(spark, d)), scratch_path(spark, "clusters"))
    return stores.read_clusters(spark, path).select("song_id", "community", "label", *r6("x", "y"))


@bind(
    "upsert_metrics",
    """select o_orderstatus model, o_orderpriority section, 'mean_price' metric, round(avg(o_totalprice), 4) val
      from orders where o_orderpriority <> '1-URGENT' group by 1, 2
    union all
    select o_orderstatus, o_orderpriority, 'largest', max(o_totalprice) from orders
      where o_orderpriority = '1-URGENT' group by 1, 2
    union all
    select o_orderstatus, o_orderpriority, 'undefined', null from orders where o_orderpriority = '1-URGENT' group by 1, 2""",
)
def _(spark, d):
    orders = Tables(spark, d).orders
    by = [F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("section")]
    old = orders.groupBy(*by).agg(F.avg("o_totalprice").alias("value")).withColumn("metric", F.lit("mean_price"))
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT").groupBy(*by).agg(F.max("o_totalprice").alias("top"))
    entries = F.array(
        F.struct(F.lit("largest").alias("metric"), F.col("top").alias("value")),
        F.struct(F.lit("undefined").alias("metric"), F.lit(float("nan")).alias("value")),
    )
    new = urgent.select("model", "section", F.explode(entries).alias("e")).select("model", "section", "e.*")
    path = scratch_path(spark, "metrics")
    for section in (old, new):
        stores.write_metrics(spark, section.select("model", "section", "metric", "value"), path)
    return stores.read_metrics(spark, path).select("model", "section", "metric", F.round("value", 4).alias("val"))


@bind(
    "label_vocabulary",
    """, cells as (select 'mood' vocabulary, mood cell from tracks union all select 'mood_all', mood_all from tracks
      union all select 'genre', genre from tracks union all select 'theme', theme from tracks
      union all select 'style', style from tracks),
    found as (select distinct vocabulary, trim(tag) tag from (
      select vocabulary, unnest(string_split(cell, ',')) tag from cells) where trim(tag) <> '')
    select vocabulary, tag, row_number() over (partition by vocabulary order by lower(tag), tag) n from found""",
    using="tracks",
)
def _(spark, d):
    return tables.label_vocabulary(Tables(spark, d).raw_metadata()).select(
        "vocabulary", "tag", F.col("position").cast("long").alias("n")
    )


@bind(
    "match_store",
    """select cast(p_partkey as varchar) song_id, coalesce(case when p_type <> 'SMALL' then p_size > 25 end, false) matched,
      p_partkey deezer_id, p_brand deezer_artist, p_name deezer_title, cast(p_size as bigint) rank,
      round(p_retailprice, 2) score from part""",
)
def _(spark, d):
    part = Tables(spark, d).part
    none = F.lit(None)
    rows = part.select(
        F.col("p_partkey").cast("string").alias("song_id"),
        F.when(F.col("p_type") != "SMALL", F.col("p_size") > 25).alias("matched"),
        F.col("p_partkey").alias("deezer_id"),
        F.col("p_brand").alias("deezer_artist"),
        F.col("p_name").alias("deezer_title"),
        none.alias("isrc"), none.alias("link"),
        F.col("p_size").alias("rank"), none.alias("duration"),
        *[none.alias(f"cover_{s}") for s in ("small", "medium", "big", "xl")],
        *[none.alias(f"artist_picture_{s}") for s in ("small", "medium", "big", "xl")],
        F.col("p_retailprice").alias("score"), none.alias("artist_score"), none.alias("title_score"),
    )
    # most rows come first, with other scores for some; later rows replace them
    early = rows.where("deezer_id % 4 > 0").withColumn("score", F.when(F.col("deezer_id") % 4 == 1, -1.0).otherwise(F.col("score")))
    path = stores.write_matches(early, scratch_path(spark, "matches"))
    stores.merge_matches(rows.where("deezer_id % 4 < 2"), path)
    return stores.read_matches(spark, path).select(
        "song_id", "matched", "deezer_id", "deezer_artist", "deezer_title", "rank", F.round("score", 2).alias("score")
    )


def _quadrant_files(t: Tables):
    """A file of lines per quadrant, in the order of the songs."""
    lines = t.tracks().select("quadrant", "song_id", F.concat("song_id", F.lit(" "), F.coalesce("title", F.lit("?"))).alias("value"))
    path = scratch_path(t.spark, "listing")
    lines.repartition("quadrant").sortWithinPartitions("quadrant", "song_id").select("quadrant", "value").write.partitionBy("quadrant").text(path)
    return lines, path


@bind(
    "audio_listing",
    "select 'quadrant=' || quadrant quadrant, count(distinct quadrant) n_files, cast(sum(strlen(song_id || ' ' || coalesce(title, '?')) + 1) as bigint) total from tracks group by 1",
    using="tracks",
)
def _(spark, d):
    """Names and lengths of files that hold the tracks, against the lengths of their rows."""
    _, path = _quadrant_files(Tables(spark, d))
    found = files.audio_listing(spark, path, "*.txt")
    return found.groupBy("quadrant").agg(F.countDistinct("song_id").alias("n_files"), F.sum("length").alias("total"))


@bind(
    "checksum_audit",
    """select quadrant, case when quadrant = 'Q2' then repeat('0', 32) else md5(string_agg(song_id || ' ' || coalesce(title, '?') || chr(10), '' order by song_id)) end expected,
      md5(string_agg(song_id || ' ' || coalesce(title, '?') || chr(10), '' order by song_id)) actual, case when quadrant = 'Q2' then 'mismatch' else 'ok' end status from tracks group by 1
    union all select 'Q9', repeat('1', 32), null, 'missing'""",
    using="tracks",
)
def _(spark, d):
    """Sums of the files against sums of the rows they were written from; one expected sum is wrong, one file absent."""
    lines, path = _quadrant_files(Tables(spark, d))
    names = materialise(files.audio_listing(spark, path, "*.txt").select(F.substring_index("quadrant", "=", -1).alias("quadrant"), F.concat("song_id", F.lit(".txt")).alias("name")), "names")
    listed = F.array_sort(F.collect_list(F.struct("song_id", F.concat("value", F.lit("\n")).alias("value"))))  # as long as the file itself
    sums = lines.groupBy("quadrant").agg(F.md5(F.array_join(listed["value"], "")).alias("sum"))
    wrong = F.when(F.col("quadrant") == "Q2", F.repeat(F.lit("0"), 32)).otherwise(F.concat(F.lit(" MD5: "), F.upper("sum")))
    expected = materialise(names.join(sums, "quadrant").select("quadrant", "name", wrong.alias("checksum")), "expected")
    absent = spark.createDataFrame([("absent.txt", "1" * 32)], "name string, checksum string")
    audits = [files.checksum_audit(spark, f"{path}/quadrant=Q1", absent, "*.txt").withColumn("quadrant", F.lit("Q9"))]
    for q in ("Q1", "Q2", "Q3", "Q4"):  # files of one task have one name in all folders
        audits.append(files.checksum_audit(spark, f"{path}/quadrant={q}", expected.where(F.col("quadrant") == q).select("name", "checksum"), "*.txt").withColumn("quadrant", F.lit(q)))
    return profile.union_all(audits).select("quadrant", "expected", "actual", "status")


def _track_json(part):
    """Nested track objects; large parts carry a direct isrc as well."""
    return F.to_json(
        F.struct(
            F.col("p_partkey").cast("string").alias("id"),
            F.col("p_name").alias("name"),
            F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.col("p_type").alias("name"))).alias("artists"),
            F.when(F.col("p_size") > 25, F.concat(F.lit("D"), F.col("p_partkey").cast("string"))).alias("isrc"),
            F.struct(F.concat(F.lit("N"), F.col("p_partkey").cast("string")).alias("isrc")).alias("external_ids"),
            F.struct(F.concat(F.lit("u/"), F.col("p_partkey").cast("string")).alias("spotify")).alias("external_urls"),
            F.struct(
                F.when(F.col("p_type") != "PROMO", F.array(F.struct(F.concat(F.lit("i/"), F.col("p_brand")).alias("url")))).alias("images")
            ).alias("album"),
            (F.col("p_size") * 1000).alias("duration_ms"),
        )
    )


@bind(
    "flatten_catalogue_json",
    """select p_partkey, cast(p_partkey as varchar) id, p_name "name", p_brand || '|' || p_type artists,
      case when p_size > 25 then 'D' || p_partkey else 'N' || p_partkey end isrc, 'u/' || p_partkey link,
      case when p_type <> 'PROMO' then 'i/' || p_brand end cover_url, cast(p_size * 1000 as bigint) duration_ms from part""",
)
def _(spark, d):
    rows = Tables(spark, d).part.select("p_partkey", _track_json(None).alias("track_json"))
    return catalogue.flatten_catalogue_json(rows).select(
        "p_partkey", "id", "name", F.array_join("artists", "|").alias("artists"), "isrc", "link", "cover_url",
        F.col("duration_ms").cast("long").alias("duration_ms"),
    )


def _line_lists(t: Tables):
    """Order lines as item lists of part and supplier: returned goods are no tracks, accepted
    ones state no type, and a filled line holds nothing under ``track``."""
    kind = F.when(F.col("l_returnflag") == "R", "episode").when(F.col("l_returnflag") == "N", "track")

    def item(c, name):
        track = F.struct(
            F.col(c).cast("string").alias("id"), F.concat(F.lit(name), F.col(c).cast("string")).alias("name"), kind.alias("type")
        )
        return F.struct(F.when(F.col("l_linestatus") == "O", track).alias("track"), F.col("l_linenumber").alias("added"))

    items = F.array(item("l_partkey", "part "), item("l_suppkey", "supplier "))
    return t.lineitem.select(
        F.col("l_orderkey").alias("user_id"), "l_linenumber", "l_partkey", F.to_json(F.struct(items.alias("items"))).alias("items_json")
    )


_USABLE = """, usable as (
  select l_orderkey user_id, l_linenumber, l_partkey, 0 entry, cast(l_partkey as varchar) id, 'part ' || l_partkey "name"
    from lineitem where l_linestatus = 'O' and l_returnflag <> 'R' union all
  select l_orderkey, l_linenumber, l_partkey, 1, cast(l_suppkey as varchar), 'supplier ' || l_suppkey
    from lineitem where l_linestatus = 'O' and l_returnflag <> 'R')"""


@bind("explode_catalogue_items", _USABLE + ' select user_id, l_linenumber, cast(entry as bigint) entry, id, "name" from usable', using="items")
def _(spark, d):
    rows = catalogue.explode_catalogue_items(_line_lists(Tables(spark, d)))
    return rows.select("user_id", "l_linenumber", F.col("position").cast("long").alias("entry"), "id", "name")


# --- B. scalars ---------------------------------------------------------------------------------


@bind(
    "split_tags",
    """select song_id, pos, tag from (select song_id, unnest(t) tag, generate_subscripts(t, 1) - 1 pos from (
      select song_id, list_filter(list_transform(string_split(style, ','), lambda x: trim(x)), lambda x: x <> '') t from tracks))""",
    using="tracks",
)
def _(spark, d):
    rows = Tables(spark, d).tracks().select("song_id", F.posexplode(tags.split_tags("style")).alias("pos", "tag"))
    return rows.select("song_id", F.col("pos").cast("long").alias("pos"), "tag")


@bind("lower_tags", "select song_id, mood, mood_all, theme, style from clean", using="clean")
def _(spark, d):
    t = Tables(spark, d).tracks()
    return t.select("song_id", *[tags.lower_tags(c).alias(c) for c in tags.LOWERED_COLUMNS])


@bind("consolidate_genres", "select song_id, genre, genre_main from clean", using="clean")
def _(spark, d):
    return _clean(Tables(spark, d)).select("song_id", "genre", "genre_main")


@bind(
    "select_columns",
    """select song_id, quadrant, round(arousal, 6) arousal, round(valence, 6) valence, artist, title, duration,
      style, style_weights, mood, mood_all, mood_all_weights from clean""",
    using="clean",
)
def _(spark, d):
    rows = cleaning.select_columns(_clean(Tables(spark, d)), ["style", "mood", "style"])
    return rows.withColumns({c: F.round(c, 6) for c in ("arousal", "valence")})


@bind("filter_required_tags", "select song_id, genre_main from marked where drop_reason is null or drop_reason = 'missing audio'", using="marked")
def _(spark, d):
    kept = cleaning.filter_required_tags(_clean(Tables(spark, d)), FilterConfig().required_groups)
    return kept.select("song_id", "genre_main")


@bind("filter_has_audio", "select song_id, quadrant from audio_files", using="audio_files")
def _(spark, d):
    t = Tables(spark, d)
    return cleaning.filter_has_audio(t.tracks(), t.audio_files()).select("song_id", "quadrant")


_FILTER_STATS = """, counts as (select coalesce(drop_reason, 'kept') r, count(*) n from marked group by 1),
  sums as (select (select sum(n) from counts) total, coalesce((select n from counts where r = 'kept'), 0) kept,
    (select string_agg(n || ' ' || r, ', ' order by case r when 'missing mood' then 1 when 'missing genre' then 2
      when 'missing theme' then 3 when 'missing style' then 4 else 5 end) from counts where r <> 'kept') reasons)
  select cast(total as bigint) total, cast(kept as bigint) kept_before_sample, least(kept, 50) kept,
    'kept ' || kept || '/' || total || case when total > kept then '; dropped ' || (total - kept) || ' (' || reasons || ')' else '' end
    || case when kept > 50 then '; sampled to 50' else '' end summary from sums"""


@bind("filter_stats", _FILTER_STATS, using="marked")
def _(spark, d):
    t = Tables(spark, d)
    config = FilterConfig(sample_size=50)
    _, stats = cleaning.filter_tracks(_clean(t), config, t.audio_files())
    return stats.select("total", "kept_before_sample", F.col("kept").cast("long").alias("kept"), "summary")


@bind("sample_n", "select song_id from tracks order by md5('7:' || song_id), song_id limit 50", using="tracks")
def _(spark, d):
    return cleaning.sample_n(Tables(spark, d).tracks(), 50, 7).select("song_id")


@bind(
    "resolve_audio_path",
    """select song_id, case genre when 'PROMO' then '/abs/' || song_id when 'LARGE' then 'audio/rel/' || song_id
      else 'audio/' || quadrant || '/' || song_id || '.mp3' end path from tracks""",
    using="tracks",
)
def _(spark, d):
    given = F.when(F.col("genre") == "PROMO", F.concat(F.lit("/abs/"), "song_id")).when(
        F.col("genre") == "LARGE", F.concat(F.lit("rel/"), "song_id")
    )
    rows = Tables(spark, d).tracks().withColumn("audio_path", given)
    return cleaning.resolve_audio_path(rows, "audio/").select("song_id", "path")


@bind(
    "parse_ref_id",
    """select p_partkey, case p_type when 'PROMO' then 'https://open.spotify.com/playlist/k' || p_partkey || '?si=2' when 'ECONOMY' then 'spotify:playlist:k' || p_partkey
        else 'k' || p_partkey end track_id,
      case p_type when 'LARGE' then 'https://open.spotify.com/track/k' || p_partkey || '?si=1' when 'SMALL' then 'spotify:track:k' || p_partkey
        else 'k' || p_partkey end playlist_id from part""",
)
def _(spark, d):
    """Links and URIs of tracks and of playlists, and plain ids, each read as a track's and as a playlist's."""
    key, kind = F.concat(F.lit("k"), F.col("p_partkey").cast("string")), F.col("p_type")
    ref = (
        F.when(kind == "LARGE", F.concat(F.lit(" https://open.spotify.com/track/"), key, F.lit("?si=1 ")))
        .when(kind == "SMALL", F.concat(F.lit("spotify:track:"), key))
        .when(kind == "PROMO", F.concat(F.lit("https://open.spotify.com/playlist/"), key, F.lit("?si=2")))
        .when(kind == "ECONOMY", F.concat(F.lit("\tspotify:playlist:"), key))
        .otherwise(F.concat(F.lit("  "), key, F.lit(" ")))
    )
    return Tables(spark, d).part.select(
        "p_partkey", cells.parse_ref_id(ref).alias("track_id"), cells.parse_ref_id(ref, "playlist").alias("playlist_id")
    )


def _titles(part):
    return part.select(
        "p_partkey",
        F.concat(
            "p_name", F.lit(" ["), "p_type", F.lit("] (Live) - "), "p_brand",
            F.when(F.col("p_size") > 25, F.concat(F.lit(" feat. "), "p_name")).otherwise(F.lit(" Without")),
        ).alias("raw"),
    )


@bind(
    "normalize_name",
    """select p_partkey, trim(regexp_replace(lower(p_name || '   ' || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g'))
      || case when p_size > 25 then '' else ' without' end norm from part""",
)
def _(spark, d):
    return names.normalize_name(_titles(Tables(spark, d).part), "raw", "norm").select("p_partkey", "norm")


# the subsequence length is a reduction over one row of the table per character of the second name
_TOKEN_SET_SQL = """with raw as (select p_name || ' ' || p_brand left_name, p_brand || ' ' || p_type || ' ' || p_name right_name from part),
  pairs as (select distinct left_name, right_name from raw),
  plain as (select *, trim(regexp_replace(lower(left_name), '[^a-z0-9_]+', ' ', 'g')) l, trim(regexp_replace(lower(right_name), '[^a-z0-9_]+', ' ', 'g')) r from pairs),
  tokens as (select *, list_distinct(string_split(l, ' ')) a, list_distinct(string_split(r, ' ')) b from plain),
  parts as (select *, array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), ' ') both_,
    array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ' ') ra,
    array_to_string(list_sort(list_filter(b, lambda x: not list_contains(a, x))), ' ') rb from tokens),
  texts as (select *, case when both_ = '' then '' else ' ' end glue from parts),
  whole as (select *, both_ || glue || ra x, both_ || glue || rb y, both_ <> '' and (ra = '' or rb = '') contained from texts),
  tables as (select *, list_transform(string_split(y, ''), lambda ch: list_transform(string_split(x, ''), lambda c: case when c = ch then 1 else 0 end)) eq from whole),
  counted as (select *, list_reduce(list_prepend(list_transform(string_split(x, ''), lambda c: 0), eq), lambda row, e:
    list_transform(range(1, len(e) + 1), lambda i: list_max(list_transform(range(1, i + 1),
      lambda j: greatest(row[j], case when j = 1 then 0 else row[j - 1] end + e[j]))))) last from tables),
  scored as (select *, 200.0 * list_max(last) / (length(x) + length(y)) edit,
    case when both_ = '' then 0.0 else 200.0 * length(both_) / (2.0 * length(both_) + length(ra) + length(glue)) end more_a,
    case when both_ = '' then 0.0 else 200.0 * length(both_) / (2.0 * length(both_) + length(rb) + length(glue)) end more_b from counted)
  select left_name, right_name, round(case when l = '' or r = '' then 0.0 when contained then 100.0 else greatest(edit, more_a, more_b) end, 4) ratio from scored"""


@bind("token_set_ratio", _TOKEN_SET_SQL)
def _(spark, d):
    """Distinct titles of parts against the brand and type of the same part."""
    pairs = Tables(spark, d).part.select(
        F.concat_ws(" ", "p_name", "p_brand").alias("left_name"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("right_name")
    )
    return linking.name_similarity(pairs).select("left_name", "right_name", F.round("ratio", 4).alias("ratio"))


@bind(
    "score_candidate",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
      round((l_quantity * 2 * 0.5 + (100 - l_discount * 100) * 0.5) / 1.0, 6) score from lineitem""",
)
def _(spark, d):
    rows = Tables(spark, d).lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        (F.col("l_quantity") * 2).alias("artist_score"),
        (100 - F.col("l_discount") * 100).alias("title_score"),
    )
    return linking.score_candidate(rows).drop("artist_score", "title_score").withColumn("score", F.round("score", 6))


@bind(
    "catalogue_search_key",
    """select song_id, case when coalesce(artist, '') = '' then 'artist must not be empty' when coalesce(title, '') = ''
      then 'title must not be empty' end reason, 'artist:"' || artist || '" track:"' || title || '"' search_key from tracks""",
    using="tracks",
)
def _(spark, d):
    quoted = Tables(spark, d).tracks().select(
        "song_id", F.concat(F.lit('"'), "artist", F.lit(' " ')).alias("artist"), F.concat(F.lit(' "'), "title").alias("title")
    )
    return linking.catalogue_search_key(quoted).select("song_id", "reason", "search_key")


@bind(
    "clean_cell",
    """select event_id, coalesce(event_type, '') as text_cell, round(value, 4) number_cell, cast(null as double) bad_cell,
      round(cast(json_extract_string(props, '$.k') as double), 4) parsed_cell from events""",
)
def _(spark, d):
    return Tables(spark, d).events.select(
        "event_id",
        cells.clean_text("event_type").alias("text_cell"),
        cells.clean_number("value").alias("number_cell"),
        cells.clean_number("props").alias("bad_cell"),
        cells.clean_number(F.get_json_object("props", "$.k")).alias("parsed_cell"),
    )


def _requests(t: Tables):
    """Recent plays as seeds: one request per user."""
    named = t.tracks().select(F.col("song_id").alias("item_id"), F.array("artist").alias("artists"), "title")
    return ranking.recent_seeds(t.history(), 20).join(named.hint("merge"), "item_id").select(
        F.col("user_id").cast("string").alias("request_id"), "position", "artists", "title"
    )


@bind(
    "describe_seeds",
    """select cast(request_id as varchar) request_id, 'tracks in the spirit of: ' ||
      string_agg(coalesce(nullif(artist, ''), '?') || ' - ' || coalesce(title, ''), '; ' order by position) intent
    from requests where position <= 5 group by 1""",
    using="requests",
)
def _(spark, d):
    return recommend.describe_seeds(_requests(Tables(spark, d)))


@bind(
    "key_circular",
    """select p_partkey, round(cos(i / 12.0 * 2 * pi()), 6) key_cos, round(sin(i / 12.0 * 2 * pi()), 6) key_sin, cast(p_type = 'SMALL' as double) is_minor
    from (select *, coalesce(list_position(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'], upper(substr(p_name, 1, 1))) - 1, 0) i from part)""",
)
def _(spark, d):
    scale = F.when(F.col("p_type") == "SMALL", "minor").otherwise("major")
    columns = arrays.key_circular(F.upper(F.substring("p_name", 1, 1)), scale)
    return Tables(spark, d).part.select("p_partkey", *[F.round(c, 6).alias(n) for n, c in columns.items()])


# --- C. vectors ---------------------------------------------------------------------------------


@bind(
    "validate_vectors",
    """select count(*) n_items, cast(min(len(e)) as bigint) dim_min, cast(max(len(e)) as bigint) dim_max,
      count(*) filter (where len(list_filter(e, lambda x: isnan(x) or isinf(x))) > 0) n_non_finite,
      case when count(*) <= 10 then 'k must be positive and below the number of vectors' end problem from vectors""",
    using="vectors",
)
def _(spark, d):
    return vectors.vector_checks(Tables(spark, d).vectors(), 10).withColumns(
        {c: F.col(c).cast("long") for c in ("dim_min", "dim_max")}
    )


def _values(df, column="embedding", id_col="item_id"):
    return df.select(id_col, F.posexplode(column).alias("pos", "v")).select(
        id_col, F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("val")
    )


@bind("mean_vector", "select pos, round(m, 6) val from (select unnest(mean) m, generate_subscripts(mean, 1) - 1 pos from mean_row)", using="mean_row")
def _(spark, d):
    mean = vectors.mean_vector(Tables(spark, d).vectors()).withColumn("item_id", F.lit("mean"))
    return _values(mean, "mean").drop("item_id")


@bind(
    "center_vectors",
    """select item_id, pos, round(v, 6) val from (select v.item_id, unnest(list_transform(v.e, lambda x, i: x - m.mean[i])) v,
      generate_subscripts(v.e, 1) - 1 pos from vectors v, mean_row m)""",
    using="vectors mean_row",
)
def _(spark, d):
    raw = Tables(spark, d).vectors()
    return _values(vectors.center_vectors(raw, vectors.mean_vector(raw)))


@bind("l2_normalize", "select item_id, pos, round(v, 6) val from (select item_id, unnest(u) v, generate_subscripts(u, 1) - 1 pos from unit)", using="unit")
def _(spark, d):
    return _values(Tables(spark, d).unit())


@bind("prepare_query", "select item_id, pos, round(v, 6) val from (select item_id, unnest(u) v, generate_subscripts(u, 1) - 1 pos from centred)", using="centred")
def _(spark, d):
    t = Tables(spark, d)
    _, meta = _index(t)
    return _values(vectors.prepare_query(t.vectors(), meta))


@bind(
    "cosine_score",
    """select a.item_id, m.community, round(list_inner_product(a.u, c.u), 6) score from unit a
      join membership m on m.item_id = a.item_id
      join (select community, min(item_id) first_id from membership group by 1) f on f.community = m.community
      join unit c on c.item_id = f.first_id""",
    using="unit membership",
)
def _(spark, d):
    """Every item against the first item of its label."""
    t = Tables(spark, d)
    unit = t.unit().join(t.membership(), "item_id")
    first = t.membership().groupBy("community").agg(F.min("item_id").alias("first_id"))
    heads = first.join(t.unit().select(F.col("item_id").alias("first_id"), F.col("embedding").alias("head")), "first_id")
    pairs = unit.join(heads, "community")
    return vectors.cosine_score(pairs, "embedding", "head").select("item_id", "community", *r6("score"))


@bind(
    "embed_items",
    r""", tokens as (select doc_id, unnest(string_split_regex(text, '[\s]+')) tok from documents),
    hashed as (select doc_id, ('0x' || substr(md5(tok), 1, 8))::bigint % 32 d,
      case when substr(md5(tok), 9, 1) < '8' then 1.0 else -1.0 end s from tokens where tok <> ''),
    sums as (select doc_id, d, sum(s) v from hashed group by 1, 2),
    grid as (select t.doc_id, r.d, coalesce(s.v, 0) v from (select doc_id from documents) t
      cross join (select unnest(range(32)) d) r left join sums s on s.doc_id = t.doc_id and s.d = r.d),
    shifted as (select doc_id, d, v - avg(v) over (partition by d) v from grid)
    select cast(doc_id as varchar) item_id, d pos, round(v / sqrt(sum(v * v) over (partition by doc_id)), 6) val from shifted""",
    using="items",
)
def _(spark, d):
    docs = Tables(spark, d).documents.select(F.col("doc_id").cast("string").alias("item_id"), F.col("text").alias("content"))
    rows, _, _ = vectors.embed_items(docs, EmbeddingConfig("hashing"), partitions=spark.sparkContext.defaultParallelism)
    return _values(rows)


@bind(
    "pad_or_trim",
    """select item_id, pos, round(coalesce(samples[pos + 1], 0), 6) val from (
      select item_id, samples, unnest(range(20)) pos from frames16)""",
    using="frames16",
)
def _(spark, d):
    f = frames.frame_signal(Tables(spark, d).signal(), 16, 8)
    return _values(f.select("item_id", arrays.pad_or_trim("samples", 20).alias("v")), "v")


# --- D. joins -----------------------------------------------------------------------------------


@bind(
    "join_one_to_one",
    "select s_suppkey, s_name, balance from (select s_suppkey, s_name, round(s_acctbal, 2) balance from supplier)",
)
def _(spark, d):
    s = Tables(spark, d).supplier
    left = s.select("s_suppkey", "s_name")
    right = s.select("s_suppkey", F.round("s_acctbal", 2).alias("balance"))
    return joins.join_one_to_one(left, right, "s_suppkey")


@bind("pending_ids", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def _(spark, d):
    """Customers without an urgent order are still to be done."""
    t = Tables(spark, d)
    done = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.pending_ids(t.customer.select("c_custkey", "c_name"), done, "c_custkey")


@bind(
    "upsert_keep_last",
    """, last as (select o_custkey k, max_by(o_orderkey, (o_orderdate, o_orderkey)) o from orders group by 1)
    select c_custkey k, c_name, -1 o from customer left join last on k = c_custkey where o is null
    union all select k, null, o from last""",
    using="items",
)
def _(spark, d):
    t = Tables(spark, d)
    old = t.customer.select(F.col("c_custkey").alias("k"), "c_name")
    new = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return joins.upsert_keep_last(old, new, "k", order="at").na.fill(-1, ["o"]).select("k", "c_name", "o")


@bind("select_ids", "select song_id, title from tracks where song_id in (select item_id from history)", using="tracks history")
def _(spark, d):
    t = Tables(spark, d)
    ids = t.history().select(F.col("item_id").alias("song_id"))
    return joins.select_ids(t.tracks(), ids).select("song_id", "title")


@bind("attach_tracks", "select m.item_id song_id, m.community, t.artist, t.title from membership m left join tracks t on t.song_id = m.item_id", using="membership tracks")
def _(spark, d):
    t = Tables(spark, d)
    clusters = t.membership().select(F.col("item_id").alias("song_id"), "community")
    return joins.attach_tracks(clusters, t.tracks()).select("song_id", "community", "artist", "title")


@bind("align_coords", "select item_id, round(x, 6) x, round(y, 6) y from coords", using="coords")
def _(spark, d):
    t = Tables(spark, d)
    return joins.align_coords(t.vectors(), t.coords()).select("item_id", *r6("x", "y"))


_LIKE_THIS = """select p.src query_id, p.dst item_id, round(p.score, 6) score, p.rank, coalesce(t.artist, '?') artist,
  coalesce(t.title, '?') title, l.label region, 'audio/' || t.quadrant || '/' || t.song_id || '.mp3' path
  from knn10 p join tracks t on t.song_id = p.dst join membership m on m.item_id = p.dst join labels3 l on l.community = m.community"""


def _corpus(t: Tables, center: bool):
    rows, meta = _index(t, center)
    return recommend.Corpus(rows, meta, t.tracks(), _clusters(t), "audio")


@bind("lookup_more_like_this", _LIKE_THIS, using="knn10 tracks membership labels3")
def _(spark, d):
    """Every item of the index is looked up."""
    t = Tables(spark, d)
    found = recommend.more_like_this(t.vectors(), _corpus(t, center=False), 10)
    return found.select(
        "query_id", "item_id", *r6("score"), F.col("rank").cast("long").alias("rank"), "artist", "title", "region", "path"
    )


@bind(
    "corpus_match_exact",
    """select p.p_partkey, c.corpus_id from part p left join corpus_names c on c.a = lower(p.p_brand) and c.t = lower(p.p_name)""",
    using="corpus_names",
)
def _(spark, d):
    t = Tables(spark, d)
    seeds = t.part.select("p_partkey", F.upper("p_brand").alias("artist"), F.concat(F.lit("  "), "p_name").alias("title"))
    return joins.corpus_match_exact(seeds, t.tracks()).select("p_partkey", "corpus_id")


#: Ratios of the names in ``raw(left_name, right_name)``, from the checked SQL of ``token_set_ratio``.
_RATIOS = "pairs as" + _TOKEN_SET_SQL.split("pairs as", 1)[1].rsplit("select left_name, right_name, round(", 1)[0].rstrip() + """,
  ratios as (select left_name, right_name, case when l = '' or r = '' then 0.0 when contained then 100.0 else greatest(edit, more_a, more_b) end ratio from scored)"""


@bind(
    "best_match",
    """with asked as (select p_partkey song_id, p_brand || ' orchestra' qa, p_name || ' ' || lower(p_type) qt, p_name, p_type, p_brand, p_size, unnest([1, 2, 3, 4]) position from part),
    found as (select song_id, qa, qt, position, case position when 1 then p_brand || ' orchester' when 2 then p_brand || ' ensemble' when 3 then 'the ' || p_brand || ' orchestras' else p_brand end ca,
      case position when 1 then p_name || ' live ' || lower(p_type) || 's' when 2 then p_name when 3 then p_name || ' remix ' || lower(p_type) else substr(p_name, 1, length(p_name) - 2) || lower(p_type) end ct,
      case when song_id % 3 = 0 then null else (position * p_size) % 7 end rank from asked),
    raw as (select qa left_name, ca right_name from found union all select qt, ct from found), """ + _RATIOS + """,
    rated as (select f.*, a.ratio artist_ratio, t.ratio title_ratio, 0.5 * a.ratio + 0.5 * t.ratio score from found f join ratios a on a.left_name = qa and a.right_name = ca join ratios t on t.left_name = qt and t.right_name = ct),
    placed as (select *, row_number() over (partition by song_id order by round(score, 9) desc, coalesce(rank, -1) desc, position) n from rated where artist_ratio >= 80 and title_ratio >= 80)
    select song_id, cast(position as bigint) position, round(score, 4) score, round(artist_ratio, 4) artist_score, round(title_ratio, 4) title_score from placed where n = 1""",
)
def _(spark, d):
    """Four spellings of each part's brand and name, some above the thresholds and some below."""
    part = Tables(spark, d).part
    kind, brand, name, size = F.lower("p_type"), F.col("p_brand"), F.col("p_name"), F.col("p_size")
    spellings = [
        (F.concat(brand, F.lit(" orchester")), F.concat(name, F.lit(" live "), kind, F.lit("s"))),
        (F.concat(brand, F.lit(" ensemble")), name),
        (F.concat(F.lit("the "), brand, F.lit(" orchestras")), F.concat(name, F.lit(" remix "), kind)),
        (brand, F.concat(F.substr(name, F.lit(1), F.length(name) - 2), kind)),
    ]
    found = F.array(*[
        F.struct(
            F.lit(n + 1).alias("position"),
            F.struct(F.struct(artist.alias("name")).alias("artist"), title.alias("title"), F.when(F.col("p_partkey") % 3 != 0, ((n + 1) * size) % 7).alias("rank")).alias("candidate"))
        for n, (artist, title) in enumerate(spellings)
    ])
    queries = part.select(F.col("p_partkey").alias("song_id"), F.concat(brand, F.lit(" orchestra")).alias("artist"), F.concat(name, F.lit(" "), kind).alias("title"))
    candidates = part.select(F.col("p_partkey").alias("song_id"), F.explode(found).alias("c")).select("song_id", "c.position", "c.candidate")
    best = linking.best_match(queries, candidates)
    return best.select("song_id", F.col("position").cast("long").alias("position"), *[F.round(c, 4).alias(c) for c in ("score", "artist_score", "title_score")])


_MATCHED = """select t.song_id, b.id is not null matched, coalesce(b.id, -1) deezer_id, b.artist deezer_artist, b.cand_title deezer_title,
  'I' || b.id isrc, cast(null as varchar) link, coalesce(cast(b.rank as bigint), -1) rank, coalesce(cast(b.p_size as bigint), -1) duration, 'c/' || b.id cover_small,
  """ + ", ".join(f"cast(null as varchar) {c}" for c in ("cover_medium", "cover_big", "cover_xl", *(f"artist_picture_{s}" for s in ("small", "medium", "big", "xl")))) + """,
  case when b.id is not null then 100.0 end score, case when b.id is not null then 100.0 end artist_score, case when b.id is not null then 100.0 end title_score
  from tracks t left join catalogue_best b on b.artist = t.artist and b.title = t.title where t.artist is not null"""


@bind("match_catalogue", _MATCHED, using="tracks catalogue_best")
def _(spark, d):
    t = Tables(spark, d)
    rows, _ = linking.match_catalogue(t.tracks(), t.catalogue())
    return rows.na.fill(-1, ["deezer_id", "rank", "duration"])


@bind("knn_join", "select src, dst, round(score, 6) score, rank from knn10", using="knn10")
def _(spark, d):
    found = neighbours.knn_join(Tables(spark, d).vectors(), 10)
    return found.select("src", "dst", *r6("score"), F.col("rank").cast("long").alias("rank"))


@bind("directed_affinity", "select src, dst, round(weight, 6) weight from directed10", using="directed10")
def _(spark, d):
    return graph.directed_affinity(neighbours.knn_join(Tables(spark, d).vectors(), 10)).select("src", "dst", *r6("weight"))


@bind(
    "symmetrize_graph",
    """, two as (select least(src, dst) src, greatest(src, dst) dst, max(weight) hi, min(weight) lo, sum(weight) s, count(*) n
      from directed10 group by 1, 2)
    select 'max' mode, src, dst, round(hi, 6) weight from two union all
    select 'min', src, dst, round(lo, 6) from two where n = 2 union all
    select 'mean', src, dst, round(s / 2, 6) from two""",
    using="directed10",
)
def _(spark, d):
    directed = materialise(graph.directed_affinity(neighbours.knn_join(Tables(spark, d).vectors(), 10)), "directed")
    return profile.union_all(
        graph.symmetrize_graph(directed, m).select(F.lit(m).alias("mode"), "src", "dst", *r6("weight")) for m in MODES
    )


@bind(
    "decorate_results",
    """select cast(h.user_id as varchar) request_id, h.item_id, h.position, coalesce(t.artist, '') artist,
      coalesce(t.title, '') title, coalesce(l.label, '') region from seeds20 h left join tracks t on t.song_id = h.item_id
      left join membership m on m.item_id = h.item_id left join labels3 l on l.community = m.community""",
    using="seeds20 tracks membership labels3",
)
def _(spark, d):
    t = Tables(spark, d)
    rows = ranking.recent_seeds(t.history(), 20).select(
        F.col("user_id").cast("string").alias("request_id"), "item_id", F.col("position").cast("long").alias("position")
    )
    return recommend.decorate_results(rows, _corpus(t, False)).drop("path")


# --- E. profiles --------------------------------------------------------------------------------


@bind(
    "match_report",
    """, m as (select song_id, matched from (""" + _MATCHED + """))
    select (select count(*) from tracks) total, count(*) filter (where matched) matched, count(*) filter (where not matched) missed,
      (select count(*) from tracks where artist is null) skipped,
      round(count(*) filter (where matched) / greatest(count(*), 1), 6) match_rate,
      coalesce((select string_agg(song_id, ',' order by song_id) from (select song_id from m where not matched order by song_id limit 10)), '') miss_sample from m""",
    using="tracks catalogue_best",
)
def _(spark, d):
    t = Tables(spark, d)
    rows, skipped = linking.match_catalogue(t.tracks(), t.catalogue())
    return profile.match_report(t.tracks(), rows, skipped).withColumn("match_rate", F.round("match_rate", 6))


@bind("top_tags", "select community, label from labels3", using="labels3")
def _(spark, d):
    t = Tables(spark, d)
    return profile.top_tags(t.tracks(), t.membership())


@bind(
    "community_summary",
    "select m.community, count(*) size, min(label) label from membership m join labels3 l on l.community = m.community group by 1 order by size desc, community limit 12",
    using="membership labels3",
)
def _(spark, d):
    return profile.community_summary(_clusters(Tables(spark, d)))


_MODULARITY = """, labelled as (select a.community ca, b.community cb, weight w from {graph} g join membership a on a.item_id = g.src
    join membership b on b.item_id = g.dst),
  per as (select c, sum(inside) inside, sum(deg) deg from (
    select ca c, case when ca = cb then w else 0 end inside, w deg from labelled union all select cb, 0, w from labelled) group by 1),
  q as (select sum(inside) / (sum(deg) / 2) - sum(deg * deg) / (sum(deg) * sum(deg)) modularity from per)"""


@bind(
    "cluster_run_summary",
    _MODULARITY.format(graph="graph10")
    + """ select 'bound' model, count(*) n_items, count(distinct community) n_communities,
      round((select modularity from q), 6) modularity, (select count(*) from graph10) n_edges from membership""",
    using="graph10 membership",
)
def _(spark, d):
    t = Tables(spark, d)
    edges = materialise(_graph10(t), "edges")
    row = profile.cluster_run_summary(t.membership(), edges, graph.modularity(edges, t.membership()), "bound")
    return row.withColumn("modularity", F.round("modularity", 6))


def _profile_sql(table, columns):
    parts = []
    for name, kind, numeric in columns:
        lo, hi = (f"cast(min({name}) as double)", f"cast(max({name}) as double)") if numeric else ("null", "null")
        parts.append(
            f"select '{name}' col, '{kind}' type, round(count(*) filter (where {name} is null) * 100.0 / count(*), 6) null_pct, "
            f"count(distinct {name}) distinct_n, {lo} lo, {hi} hi from {table}"
        )
    return " union all ".join(parts)


_LINEITEM = [
    ("l_orderkey", "bigint", 1), ("l_partkey", "bigint", 1), ("l_suppkey", "bigint", 1), ("l_linenumber", "int", 1),
    ("l_quantity", "double", 1), ("l_extendedprice", "double", 1), ("l_discount", "double", 1), ("l_tax", "double", 1),
    ("l_returnflag", "string", 0), ("l_linestatus", "string", 0), ("l_shipdate", "timestamp_ntz", 0),
]


@bind("column_profile", _profile_sql("lineitem", _LINEITEM))
def _(spark, d):
    rows = Tables(spark, d).lineitem.select(*[n for n, _, _ in _LINEITEM])
    return profile.column_profile(rows).select(
        F.col("column").alias("col"), "type", F.round("null_pct", 6).alias("null_pct"), F.col("distinct").alias("distinct_n"),
        F.col("min").alias("lo"), F.col("max").alias("hi"),
    )


@bind(
    "vector_profile",
    """select count(*) n_items, max(len(e)) n_dims, round(avg(n), 6) norm_mean, round(stddev_pop(n), 6) norm_std,
      round(min(list_min(e)), 6) value_min, round(max(list_max(e)), 6) value_max,
      round((select sqrt(list_inner_product(mean, mean)) from mean_row), 6) mean_vector_norm
    from (select e, sqrt(list_inner_product(e, e)) n from vectors)""",
    using="vectors mean_row",
)
def _(spark, d):
    row = profile.vector_profile(Tables(spark, d).vectors())
    return row.select("n_items", F.col("n_dims").cast("long").alias("n_dims"), *r6(*row.columns[2:]))


@bind(
    "pool_max",
    "select o_custkey request_id, o_orderpriority item_id, greatest(max(v), 0) score, count(*) support from (select *, round(o_totalprice - 250000, 2) v from orders) group by 1, 2",
)
def _(spark, d):
    scored = Tables(spark, d).orders.select(
        F.col("o_custkey").alias("request_id"), F.col("o_orderpriority").alias("item_id"),
        F.round(F.col("o_totalprice") - 250000, 2).alias("score"),
    )
    return profile.pool_max(scored)


# --- F. ranking ---------------------------------------------------------------------------------


@bind("retrieve_top_k", "select src query_id, dst item_id, round(score, 6) score, rank from knn10", using="knn10")
def _(spark, d):
    """All vectors as queries, each leaving itself out."""
    unit = Tables(spark, d).unit()
    queries = unit.withColumnRenamed("item_id", "query_id")
    own = queries.select("query_id", F.col("query_id").alias("item_id"))
    found = neighbours.retrieve_top_k(queries, unit, 10, own)
    return found.select("query_id", "item_id", *r6("score"), F.col("rank").cast("long").alias("rank"))


@bind("retrieve_top_k_blocks", "select src query_id, dst item_id, round(score, 6) score, rank from knn10", using="knn10")
def _(spark, d):
    """The same search when neither side may be broadcast."""
    unit = Tables(spark, d).unit()
    queries = unit.withColumnRenamed("item_id", "query_id")
    own = queries.select("query_id", F.col("query_id").alias("item_id"))
    found = neighbours.retrieve_top_k(queries, unit, 10, own, side_rows=50, block_rows=128)
    return found.select("query_id", "item_id", *r6("score"), F.col("rank").cast("long").alias("rank"))


@bind("similarity_results", "select src query_id, dst item_id, rank, round(score, 4) fit, '' reason from knn3", using="knn3")
def _(spark, d):
    unit = Tables(spark, d).unit()
    queries = unit.withColumnRenamed("item_id", "query_id")
    own = queries.select("query_id", F.col("query_id").alias("item_id"))
    hits = neighbours.retrieve_top_k(queries, unit, 10, own)
    return ranking.similarity_results(hits, 3).withColumn("rank", F.col("rank").cast("long"))


def _seed_rows(t: Tables):
    corpus = _corpus(t, True)
    resolved = materialise(recommend.resolve_seeds(_requests(t), t.catalogue()), "resolved-seeds")
    return corpus, materialise(recommend.seed_vectors(resolved, t.catalogue_vectors(), corpus), "seed-vectors")


@bind(
    "retrieve_pool",
    """, plays as (select r.request_id, r.catalogue_id, c.corpus_id from resolved r left join corpus_names c on c.a = lower(trim(r.artist)) and c.t = lower(trim(r.title))),
    support as (select p.request_id, h.item_id, count(*) support from plays p join seed_hits h on h.catalogue_id = p.catalogue_id and h.corpus_id is not distinct from p.corpus_id group by 1, 2)
    select cast(p.request_id as varchar) request_id, p.item_id, round(score, 6) score, support from pool p join support s on s.request_id = p.request_id and s.item_id = p.item_id""",
    using="pool",
)
def _(spark, d):
    corpus, seeds = _seed_rows(Tables(spark, d))
    return ranking.retrieve_pool(seeds, corpus.vectors).select("request_id", "item_id", *r6("score"), "support")


@bind("recent_seeds", "select user_id, item_id, position from seeds20", using="seeds20")
def _(spark, d):
    rows = ranking.recent_seeds(Tables(spark, d).history(), 20)
    return rows.select("user_id", "item_id", F.col("position").cast("long").alias("position"))


@bind(
    "top_seeds",
    """select * from (select user_id, item_id, plays, row_number() over (partition by user_id order by plays desc, item_id) position
      from (select user_id, item_id, count(*) plays from history
        where ts >= (select max(ts) - interval 14 day from history) group by 1, 2)) where position <= 20""",
    using="history",
)
def _(spark, d):
    rows = ranking.top_seeds(Tables(spark, d).history(), "medium_term", 20)
    return rows.withColumn("position", F.col("position").cast("long"))


@bind(
    "playlist_seeds",
    _USABLE + """ select user_id, id, position from (select user_id, id,
      row_number() over (partition by user_id order by l_linenumber, l_partkey, entry, id) position from usable) where position <= 3""",
    using="items",
)
def _(spark, d):
    rows = catalogue.explode_catalogue_items(_line_lists(Tables(spark, d)))
    placed = rows.withColumn("position", F.struct("l_linenumber", "l_partkey", "position", "id"))
    return ranking.playlist_seeds(placed, 3).select("user_id", "id", F.col("position").cast("long").alias("position"))


def _outside_ranking(evidence):
    """Stand-in for an external ranker: fit from similarity, ranked by it.

    Half of a four-digit similarity has five digits, so nothing is rounded at a tie.
    """
    from pyspark.sql import Window

    fit = F.round((F.col("similarity") + 1) / 2, 5)
    order = Window.partitionBy("request_id").orderBy(F.desc("fit"), "item_id")
    return evidence.withColumn("fit", fit).select(
        "request_id", "item_id", F.row_number().over(order).alias("rank"), "fit", F.lit("near").alias("reason")
    )


_OUTSIDE = """, outside as (select request_id, item_id, fit, row_number() over (partition by request_id order by fit desc, item_id) rank
  from (select request_id, item_id, round((similarity + 1) / 2, 5) fit from evidence))"""


def _evidence(t: Tables):
    corpus, seeds = _seed_rows(t)
    return corpus, recommend.build_evidence(ranking.retrieve_pool(seeds, corpus.vectors), corpus.tracks)


@bind("rank_items", _OUTSIDE + " select cast(request_id as varchar) request_id, item_id, fit, rank as position from outside", using="evidence")
def _(spark, d):
    evidence = materialise(_evidence(Tables(spark, d))[1], "evidence")
    ranked = ranking.rank_items(_outside_ranking(evidence), evidence)
    return ranked.select("request_id", "item_id", "fit", F.col("position").cast("long").alias("position"))


@bind(
    "fit_floor",
    _OUTSIDE + """, counted as (select *, count(*) filter (where fit < 0.62) over (partition by request_id) dropped from outside)
    select cast(request_id as varchar) request_id, item_id, fit, dropped, position from (select *, row_number() over (
      partition by request_id order by rank, item_id) position from counted where fit >= 0.62) where position <= 20""",
    using="evidence",
)
def _(spark, d):
    evidence = _evidence(Tables(spark, d))[1]
    kept = ranking.fit_floor(_outside_ranking(evidence), 50, PlaylistConfig(fit_floor=0.62))
    return kept.select("request_id", "item_id", "fit", "dropped", F.col("position").cast("long").alias("position"))


@bind(
    "miss_sample",
    "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT') order by 1 limit 10",
)
def _(spark, d):
    t = Tables(spark, d)
    done = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return profile.miss_sample(joins.pending_ids(t.customer.select("c_custkey"), done, "c_custkey"), "c_custkey")


# --- G. graph -----------------------------------------------------------------------------------


@bind("build_knn_graph", "select src, dst, round(weight, 6) weight from graph10", using="graph10")
def _(spark, d):
    return _graph10(Tables(spark, d)).select("src", "dst", *r6("weight"))


@bind("detect_communities")
def _(spark, d):
    t = Tables(spark, d)
    return communities.detect_communities(t.vectors().select("item_id"), materialise(_graph10(t), "edges"), CommunityConfig())


@bind(
    "community_facts",
    _MODULARITY.format(graph="graph10") + """ select item_id, cast(1 as bigint) pieces, true at_least_labels from vectors""",
    using="vectors graph10 membership",
)
def _(spark, d):
    """What SQL can state of the communities: every item has one, each is one connected piece, and their
    modularity is above that of the given labels; no single item gains by moving to another community."""
    t = Tables(spark, d)
    edges = materialise(_graph10(t), "edges")
    found = materialise(communities.detect_communities(t.vectors().select("item_id"), edges, CommunityConfig()), "found")
    pieces = communities.split_disconnected(found, edges).join(found, "item_id").groupBy("community").agg(F.countDistinct("name").alias("pieces"))
    reached = graph.modularity(edges, found).first()["modularity"]
    given = graph.modularity(edges, t.membership()).first()["modularity"]
    return found.join(pieces, "community").select("item_id", "pieces", F.lit(bool(reached >= given)).alias("at_least_labels"))


@bind("layout_facts", "select item_id, true finite, true keeps_neighbours from vectors", using="vectors")
def _(spark, d):
    """Every item has finite coordinates, and neighbourhoods are kept clearly better than by the principal plane,
    from which the layout starts."""
    t = Tables(spark, d)
    placed = materialise(layout.layout_2d(t.vectors(), LayoutConfig()), "layout")
    start = layout.principal_coords(t.vectors())
    kept, was = (
        quality.neighbourhood_preservation(t.vectors().join(c.select("item_id", "x", "y"), "item_id"), 15).first()["trustworthiness"]
        for c in (placed, start)
    )
    finite = ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    return placed.select("item_id", finite.alias("finite"), F.lit(bool(kept >= was + 0.015)).alias("keeps_neighbours"))


@bind("layout_2d")
def _(spark, d):
    return layout.layout_2d(Tables(spark, d).vectors(), LayoutConfig())


_COMPONENTS = """, links as (select src a, dst b from {graph} union all select dst, src from {graph}),
  reach(item_id, low) as (select item_id, item_id from vectors union select l.b, r.low from reach r join links l on l.a = r.item_id),
  components as (select item_id, min(low) component from reach group by 1)"""


@bind("connected_components", _COMPONENTS.format(graph="mutual3") + " select item_id, component from components", using="vectors mutual3")
def _(spark, d):
    """Components of the mutual 3-nearest-neighbour graph."""
    v = Tables(spark, d).vectors()
    edges = graph.build_knn_graph(v, KnnConfig(k=3, mode="min"))
    return graph.connected_components(v.select("item_id"), edges)


@bind("modularity", _MODULARITY.format(graph="graph10") + " select round(modularity, 6) modularity from q", using="graph10 membership")
def _(spark, d):
    t = Tables(spark, d)
    return graph.modularity(_graph10(t), t.membership()).select(*r6("modularity"))


@bind(
    "degree_stats",
    """, d as (select v.item_id, count(e.a) n from vectors v left join (select src a from mutual3 union all select dst from mutual3) e
      on e.a = v.item_id group by 1) select count(*) n_nodes, cast(sum(n) / 2 as bigint) n_edges, round(avg(n), 6) mean_degree from d""",
    using="vectors mutual3",
)
def _(spark, d):
    v = Tables(spark, d).vectors()
    edges = graph.build_knn_graph(v, KnnConfig(k=3, mode="min"))
    return graph.degree_stats(v.select("item_id"), edges).withColumn("mean_degree", F.round("mean_degree", 6))


@bind("cluster_space")
def _(spark, d):
    t = Tables(spark, d)
    path = scratch_path(spark, "space")
    clustering.run_cluster_space(t.vectors(), t.tracks(), path, ClusterConfig(), "bound")
    return stores.read_clusters(spark, f"{path}/bound_clusters")


# --- H. quality ---------------------------------------------------------------------------------

_DRAWN = """, numbered as (select item_id, row_number() over (order by md5('42:' || item_id), item_id) - 1 idx from vectors),
  draws as (select p, f, (f + 1 + ('0x' || substr(md5('42:b:' || p), 1, 12))::bigint % (n - 1)) % n s, n from (
    select p, n, ('0x' || substr(md5('42:a:' || p), 1, 12))::bigint % n f from
      (select unnest(range({pairs})) p), (select count(*) n from vectors)) where p < least({pairs}, n * (n - 1) // 2)),
  drawn as (select p, a.item_id i, b.item_id j from draws join numbered a on a.idx = f join numbered b on b.idx = s)"""


@bind(
    "embedding_sanity",
    _DRAWN.format(pairs=10000)
    + """, soft as (select item_id, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-12)) u from vectors),
    c as (select list_inner_product(a.u, b.u) c from drawn d join soft a on a.item_id = d.i join soft b on b.item_id = d.j),
    everything as (select list_inner_product(a.u, b.u) c from soft a join soft b on a.item_id <> b.item_id)
    select (select count(*) from vectors) n_samples, (select max(len(e)) from vectors) n_dims, false has_nan, false has_inf,
      (select bool_or(sqrt(list_inner_product(e, e)) <= 1e-12) from vectors) has_zero_norm,
      round(avg(c), 6) mean_pairwise_cosine, round(stddev_pop(c), 6) std_pairwise_cosine,
      (select round(avg(c), 6) from everything) exact_mean_cosine, (select round(stddev_pop(c), 6) from everything) exact_std_cosine from c""",
    using="vectors",
)
def _(spark, d):
    row = quality.embedding_sanity(Tables(spark, d).vectors())
    return row.select(
        "n_samples", F.col("n_dims").cast("long").alias("n_dims"), "has_nan", "has_inf", "has_zero_norm", *r6(*row.columns[5:])
    )


_SILHOUETTE = """, dist as (select p.src item_id, m.community own, o.community other, sum(1 - p.score) s, count(*) n from pairs p
    join membership m on m.item_id = p.src join membership o on o.item_id = p.dst group by 1, 2, 3),
  ab as (select item_id, max(case when own = other then s / n end) a, min(case when own <> other then s / n end) b from dist group by 1),
  sil as (select m.item_id, m.community, case when a is null or b is null then 0 else (b - a) / greatest(a, b) end s
    from membership m left join ab on ab.item_id = m.item_id),
  sizes as (select community, count(*) n from membership group by 1)"""


@bind(
    "cluster_quality",
    _SILHOUETTE
    + """ select count(*) n_clusters, max(n) largest, min(n) smallest, round(stddev_pop(n) / avg(n), 6) size_balance,
      (select round(avg(s), 6) from sil) silhouette_mean from sizes""",
    using="pairs membership",
)
def _(spark, d):
    t = Tables(spark, d)
    row = quality.cluster_quality(t.vectors(), t.membership())
    return row.select("n_clusters", "largest", "smallest", *r6("size_balance", "silhouette_mean"))


@bind("size_balance", "select round(stddev_pop(n) / avg(n), 6) size_balance from (select count(*) n from events group by user_id)")
def _(spark, d):
    member = Tables(spark, d).events.select(F.col("event_id").alias("item_id"), F.col("user_id").alias("community"))
    return quality.size_balance(member).select(*r6("size_balance"))


_ENTROPY = """, shares as (select community, col, n / sum(n) over (partition by community, col) p, count(*) over (partition by community, col) k from tagged),
  entropies as (select c.community, c.col, coalesce(max(case when k > 1 then h end), 0) entropy from (
      select community, unnest(['style', 'theme', 'mood_all']) col from (select distinct community from membership)) c
    left join (select community, col, max(k) k, sum(-p * ln(p)) / ln(max(k)) h from shares where k > 1 group by 1, 2) e
      on e.community = c.community and e.col = c.col group by 1, 2)"""


@bind("tag_entropy", _ENTROPY + " select community, col, round(entropy, 6) entropy from entropies", using="tagged membership")
def _(spark, d):
    t = Tables(spark, d)
    return quality.tag_entropy(t.tracks(), t.membership()).select("community", F.col("column").alias("col"), *r6("entropy"))


_PLACED = """, placed as (select m.community, t.arousal a, t.valence v from membership m join tracks t on t.song_id = m.item_id
    where arousal is not null and valence is not null),
  spread as (select community, stddev_pop(sqrt((a - ca) * (a - ca) + (v - cv) * (v - cv))) va_spread from (
    select *, avg(a) over (partition by community) ca, avg(v) over (partition by community) cv from placed) group by 1),
  coverage as (select community, count(distinct case when a >= {p} and v >= {p} then 1 when a >= {p} then 2 when v < {p} then 3 else 4 end) / 4 quadrant_coverage
    from placed group by 1)"""


@bind("va_spread", _PLACED.format(p=0) + " select community, round(va_spread, 6) va_spread from spread", using="membership tracks")
def _(spark, d):
    t = Tables(spark, d)
    return quality.va_spread(t.tracks(), t.membership()).select("community", *r6("va_spread"))


@bind("quadrant_coverage", _PLACED.format(p=0.2) + " select community, round(quadrant_coverage, 6) quadrant_coverage from coverage", using="membership tracks")
def _(spark, d):
    t = Tables(spark, d)
    return quality.quadrant_coverage(t.tracks(), t.membership(), pivot=0.2).select("community", *r6("quadrant_coverage"))


_COHERENCE = _ENTROPY + _PLACED.format(p=0) + """, coherence as (select s.community, s.size,
    max(case when e.col = 'style' then entropy end) style_entropy, max(case when e.col = 'theme' then entropy end) theme_entropy,
    max(case when e.col = 'mood_all' then entropy end) mood_entropy, max(va_spread) va_spread, max(quadrant_coverage) quadrant_coverage
  from (select community, count(*) size from membership group by 1) s join entropies e on e.community = s.community
    join spread p on p.community = s.community join coverage c on c.community = s.community group by 1, 2)"""


@bind(
    "label_coherence",
    _COHERENCE + """ select community, size, round(style_entropy, 6) style_entropy, round(theme_entropy, 6) theme_entropy,
      round(mood_entropy, 6) mood_entropy, round(va_spread, 6) va_spread, round(quadrant_coverage, 6) quadrant_coverage from coherence""",
    using="tagged membership tracks",
)
def _(spark, d):
    t = Tables(spark, d)
    rows = quality.label_coherence(t.tracks(), t.membership())
    return rows.select("community", "size", *r6(*quality.COHERENCE_METRICS))


@bind(
    "semantic_quality",
    _COHERENCE + """ select count(*) n_labels, cast(sum(size) as bigint) n_samples, round(avg(style_entropy), 6) mean_style_entropy,
      round(avg(theme_entropy), 6) mean_theme_entropy, round(avg(mood_entropy), 6) mean_mood_entropy,
      round(avg(va_spread), 6) mean_va_spread, round(avg(quadrant_coverage), 6) mean_quadrant_coverage from coherence""",
    using="tagged membership tracks",
)
def _(spark, d):
    t = Tables(spark, d)
    row = quality.semantic_quality(quality.label_coherence(t.tracks(), t.membership()))
    return row.select("n_labels", "n_samples", *r6(*row.columns[2:]))


_RANKS = """, low as (select a.item_id src, b.item_id dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) d
    from coords a join coords b on a.item_id <> b.item_id),
  ranks as (select h.src, h.dst, row_number() over (partition by h.src order by 1 - h.score, h.dst) rh,
    row_number() over (partition by l.src order by l.d, l.dst) rl from pairs h join low l on l.src = h.src and l.dst = h.dst),
  sums as (select sum(case when rl <= 15 and rh > 15 then rh - 15 else 0 end) t, sum(case when rh <= 15 and rl > 15 then rl - 15 else 0 end) c,
    (select count(*) from coords) n from ranks)"""


@bind(
    "projection_quality",
    _RANKS + _DRAWN.format(pairs=5000) + """, both_d as (select 1 - p.score h, l.d l from drawn x join pairs p on p.src = x.i and p.dst = x.j
      join low l on l.src = x.i and l.dst = x.j),
    ranked as (select rank() over (order by h) + (count(*) over (partition by h) - 1) / 2.0 rh, rank() over (order by l) + (count(*) over (partition by l) - 1) / 2.0 rl from both_d)
    select round(1 - 2.0 / (n * 15 * (2 * n - 46)) * t, 6) trustworthiness, round(1 - 2.0 / (n * 15 * (2 * n - 46)) * c, 6) continuity,
      (select round(corr(rh, rl), 6) from ranked) shepard_rho, cast(15 as bigint) k, n n_samples from sums""",
    using="pairs coords vectors",
)
def _(spark, d):
    t = Tables(spark, d)
    row = quality.projection_quality(t.vectors(), t.coords(), 15)
    return row.select(
        *r6("trustworthiness", "continuity", "shepard_rho"), *[F.col(c).cast("long").alias(c) for c in ("k", "n_samples")]
    )


@bind(
    "shepard_rho",
    _RANKS.split(", ranks as")[0].rstrip().rstrip(",") + _DRAWN.format(pairs=20000) + """, both_d as (select 1 - p.score h, l.d l from drawn x
      join pairs p on p.src = x.i and p.dst = x.j join low l on l.src = x.i and l.dst = x.j),
    ranked as (select rank() over (order by h) + (count(*) over (partition by h) - 1) / 2.0 rh, rank() over (order by l) + (count(*) over (partition by l) - 1) / 2.0 rl from both_d)
    select round(corr(rh, rl), 6) shepard_rho from ranked""",
    using="pairs coords vectors",
)
def _(spark, d):
    t = Tables(spark, d)
    points = t.vectors().join(t.coords(), "item_id")
    return quality.shepard_rho(points, 20000).select(*r6("shepard_rho"))


def _graph_quality_sql(edges: str) -> str:
    return _COMPONENTS.format(graph=edges) + _MODULARITY.format(graph=edges) + """, d as (select v.item_id, count(e.a) n from vectors v
      left join (select src a from EDGES union all select dst from EDGES) e on e.a = v.item_id group by 1)
    select (select count(*) from d) n_nodes, (select count(*) from EDGES) n_edges, (select round(avg(n), 6) from d) mean_degree,
      (select count(distinct component) from components) n_components, (select round(modularity, 6) from q) modularity,
      count(*) n_communities, max(n) largest, min(n) smallest from (select community, count(*) n from membership group by 1)""".replace("EDGES", edges)


@bind("graph_quality", _graph_quality_sql("mutual3"), using="vectors mutual3 membership")
def _(spark, d):
    t = Tables(spark, d)
    directed = materialise(graph.directed_affinity(neighbours.knn_join(t.vectors(), 3)), "directed")
    row = quality.graph_quality(directed, t.membership(), mode="min")
    return row.withColumns({c: F.round(c, 6) for c in ("mean_degree", "modularity")})


def _as_section(section: str, sql: str) -> str:
    """The one row of a checked query as metrics."""
    return f"select '{section}' section, metric, value from (unpivot (select columns(*)::double from ({sql})) on columns(*) into name metric value value)"


_SIZES = "select '{section}' section, 'sizes.' || label metric, count(*)::double value from embeddings group by label"
_LABELS = """select 'coherence' section, metric, value from (select community, unnest([{names}]) metric, unnest([{values}]) value from ({sql}))"""
_LABEL_VALUES = ("size", *quality.COHERENCE_METRICS)


def _evaluation_sql() -> str:
    whole = with_views("vectors graph10 membership", _graph_quality_sql("graph10"))
    parts = [
        _as_section("embed", ORACLES["embedding_sanity"]), _as_section("topology", whole), _SIZES.format(section="topology"),
        _as_section("cluster", ORACLES["cluster_quality"]), _SIZES.format(section="cluster"), _as_section("coherence", ORACLES["semantic_quality"]),
        _LABELS.format(
            names=", ".join(f"'labels.' || community || '.{c}'" for c in _LABEL_VALUES), values=", ".join(f"{c}::double" for c in _LABEL_VALUES), sql=ORACLES["label_coherence"]),
        _as_section("manifold", ORACLES["projection_quality"]),
    ]
    return "select 'bound' model, section, metric, round(value, 4) val from (" + " union all ".join(parts) + ")"


@bind("evaluate_all", _evaluation_sql())
def _(spark, d):
    """Every metric of every section, against the SQL of the single reports."""
    t = Tables(spark, d)
    edges = materialise(_graph10(t), "edges")
    clusters = materialise(_clusters(t), "clusters")
    rows = evaluate.evaluate_all(t.vectors(), edges, clusters, t.tracks(), "bound")
    return rows.select("model", "section", "metric", F.round(F.round("value", 6), 4).alias("val"))


# --- I. signals ---------------------------------------------------------------------------------


@bind("feature_job", "select cast(item_id as varchar) song_id, round(list_sum(e), 6) total, round(list_max(e), 6) peak from vectors", using="vectors")
def _(spark, d):
    """Half of the items come from an earlier run; the rest are computed now."""
    def feature(samples):
        return {"total": float(sum(float(s) for s in samples)), "peak": float(max(samples))}

    items = Tables(spark, d).signal().select(F.col("item_id").alias("song_id"), F.col("samples").alias("content"))
    middle = F.col("song_id") < "3"
    before, _ = frames.feature_job(items.where(middle), feature, ["total", "peak"])
    rows, _ = frames.feature_job(items, feature, ["total", "peak"], existing=before)
    return rows.select("song_id", *r6("total", "peak"))


@bind(
    "frame_signal",
    "select item_id, frame, pos, round(v, 6) val from (select item_id, frame, unnest(samples) v, generate_subscripts(samples, 1) - 1 pos from frames16)",
    using="frames16",
)
def _(spark, d):
    f = frames.frame_signal(Tables(spark, d).signal(), 16, 8)
    return f.select("item_id", F.col("frame").cast("long").alias("frame"), F.posexplode("samples").alias("pos", "v")).select(
        "item_id", "frame", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("val")
    )


_SPECTRUM = """, cells as (select item_id, frame, unnest(samples) v, generate_subscripts(samples, 1) - 1 t from frames16),
  parts as (select item_id, frame, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * t / 16)) * cos(2 * pi() * k * t / 16)) re,
    sum(v * (0.5 - 0.5 * cos(2 * pi() * t / 16)) * sin(2 * pi() * k * t / 16)) im
    from cells, (select unnest(range(9)) k) group by 1, 2, 3),
  mags as (select item_id, frame, k, sqrt(re * re + im * im) m from parts)"""


@bind(
    "spectrum_frames",
    _SPECTRUM + " select item_id, frame, round(max(m), 6) peak, round(sum(m * k * 1000 / 16) / sum(m), 4) centroid from mags group by 1, 2",
    using="frames16",
)
def _(spark, d):
    f = frames.frame_signal(Tables(spark, d).signal(), 16, 8)
    s = frames.spectrum_frames(f, 1000.0)
    return s.select(
        "item_id", F.col("frame").cast("long").alias("frame"), F.round(F.array_max("spectrum"), 6).alias("peak"), F.round("centroid", 4).alias("centroid")
    )


@bind("frame_stats", "select cast(user_id as varchar) item_id, round(avg(value), 6) mean, round(stddev_pop(value), 6) std from events group by 1")
def _(spark, d):
    t = Tables(spark, d)
    values = t.events.select(F.col("user_id").cast("string").alias("item_id"), "value")
    return frames.frame_stats(values, t.beat_items()).select("item_id", *r6("mean", "std"))


@bind("frame_vector_mean", "select item_id, bin, round(mean, 6) mean from bins", using="bins")
def _(spark, d):
    rows = frames.frame_vector_mean(Tables(spark, d).frames(), 12)
    return rows.select("item_id", F.posexplode("bins").alias("bin", "mean")).select(
        "item_id", F.col("bin").cast("long").alias("bin"), *r6("mean")
    )


@bind(
    "filtered_frame_stats",
    """select i.item_id, round(coalesce(avg(v), 0), 6) mean, round(coalesce(stddev_pop(v), 0), 6) std from (select distinct cast(l_suppkey as varchar) item_id from lineitem) i
      left join (select cast(l_suppkey as varchar) item_id, l_extendedprice - 20000 v from lineitem
        where l_discount > 0 and l_linenumber > 1 and l_extendedprice - 20000 >= 0) f on f.item_id = i.item_id group by 1""",
)
def _(spark, d):
    rows = Tables(spark, d).lineitem.select(
        F.col("l_suppkey").cast("string").alias("item_id"), (F.col("l_extendedprice") - 20000).alias("value"),
        F.col("l_discount").alias("pitch"), F.col("l_linenumber").alias("peaks"),
    )
    return frames.filtered_frame_stats(rows, rows.select("item_id").distinct()).select("item_id", *r6("mean", "std"))


@bind(
    "interval_stats",
    """select b.item_id, round(coalesce(mean, 0), 6) mean, round(coalesce(std, 0), 6) std, round(coalesce(std / mean, 0), 6) cv
      from (select distinct item_id from beats) b left join (select item_id, avg(gap) mean, stddev_pop(gap) std
        from intervals group by 1 having count(*) >= 2) s on s.item_id = b.item_id""",
    using="beats intervals",
)
def _(spark, d):
    t = Tables(spark, d)
    return frames.interval_stats(frames.beat_intervals(t.beats(), span=1.0), t.beat_items()).select("item_id", *r6("mean", "std", "cv"))


@bind(
    "interval_histogram",
    """, h as (select item_id, cast(round(60 / gap) as bigint) bpm, count(*) n from intervals where gap > 0 group by 1, 2),
    p as (select item_id, bpm, n, n / sum(n) over (partition by item_id) p, sum(n) over (partition by item_id) total,
      1 - n / sum(n) over (partition by item_id order by bpm range between 1 preceding and 1 following) spread,
      row_number() over (partition by item_id order by n desc, bpm) place from h)
    select b.item_id, coalesce(max(case when place = 1 then bpm end), 0)::double first_peak, round(coalesce(max(case when place = 1 then p end), 0), 6) first_weight,
      round(coalesce(max(case when place = 1 then spread end), 0), 6) first_spread, coalesce(max(case when place = 2 then bpm end), 0)::double second_peak,
      round(coalesce(max(case when place = 2 then p end), 0), 6) second_weight, round(coalesce(max(case when place = 2 then spread end), 0), 6) second_spread,
      round(coalesce(sum(-p * log2(p)), 0), 6) entropy, round(coalesce(max(case when place = 2 then p end) / max(case when place = 1 then p end), 0), 6) peak_ratio
    from (select distinct item_id from beats) b left join (select * from p where total >= 2) p on p.item_id = b.item_id group by 1""",
    using="beats intervals",
)
def _(spark, d):
    t = Tables(spark, d)
    rows = frames.interval_histogram(frames.beat_intervals(t.beats(), span=1.0), t.beat_items())
    return rows.select("item_id", *r6(*[c for c in rows.columns if c != "item_id"]))


@bind(
    "histogram_entropy",
    "select item_id, frame, round(list_sum(list_transform(bins, lambda x: -x / list_sum(bins) * log2(x / list_sum(bins)))), 6) entropy from frames",
    using="frames",
)
def _(spark, d):
    f = Tables(spark, d).frames()
    return f.select("item_id", "frame", F.round(arrays.histogram_entropy("bins"), 6).alias("entropy"))


@bind(
    "scale_alignment",
    """select item_id, round(sum(-mean / s * log2(mean / s)), 6) entropy,
      round(sum(case when bin in (0, 2, 4, 5, 7, 9, 11) then mean else 0 end) / max(s), 6) major_alignment,
      round(sum(case when bin in (0, 2, 3, 5, 7, 8, 10) then mean else 0 end) / max(s), 6) minor_alignment
    from (select *, sum(mean) over (partition by item_id) s from bins) group by 1""",
    using="bins",
)
def _(spark, d):
    rows = frames.scale_alignment(frames.frame_vector_mean(Tables(spark, d).frames(), 12))
    return rows.select("item_id", *r6("entropy", "major_alignment", "minor_alignment"))


@bind(
    "pitch_class_summary",
    """select item_id, round(sum(-mean / s * log2(mean / s)), 6) entropy, round(stddev_pop(mean), 6) std, round(max(mean), 6) max,
      round(avg(std), 6) temporal_std from (select *, sum(mean) over (partition by item_id) s from bins) group by 1""",
    using="bins",
)
def _(spark, d):
    t = Tables(spark, d)
    rows = frames.pitch_class_summary(t.frames(), t.items())
    return rows.select("item_id", *r6("entropy", "std", "max", "temporal_std"))


@bind(
    "band_ratio_summary",
    """select item_id, round(avg(loudness), 6) loudness_mean, round(stddev_pop(loudness), 6) loudness_std, round(avg(bands[1] + bands[2]), 6) low,
      round(avg(bands[3] + bands[4]), 6) mid, round(avg(bands[5]), 6) high from bands group by 1""",
    using="bands",
)
def _(spark, d):
    t = Tables(spark, d)
    return frames.band_ratio_summary(t.bands(), t.items()).select("item_id", *r6("loudness_mean", "loudness_std", "low", "mid", "high"))


@bind(
    "matrix_summary",
    """, c as (select item_id, unnest(bins) v from frames),
    s as (select item_id, sum(abs(v)) m from c group by 1)
    select c.item_id, round(avg(v), 6) mean, round(stddev_pop(v), 6) std, round(max(v), 6) max,
      round(sum(-abs(v) / m * log2(abs(v) / m)), 6) entropy from c join s on s.item_id = c.item_id group by 1""",
    using="frames",
)
def _(spark, d):
    t = Tables(spark, d)
    return frames.matrix_summary(t.frames(), t.items()).select("item_id", *r6("mean", "std", "max", "entropy"))


_ACOUSTIC_SQL = """, items as (select distinct cast(user_id as varchar) item_id from events),
  people as (select cast(c_custkey as varchar) item_id, c_acctbal, c_nationkey % 12 note, c_mktsegment = 'BUILDING' minor from customer),
  onset as (select cast(user_id as varchar) item_id, avg(value) m, stddev_pop(value) s from events group by 1),
  gaps as (select item_id, avg(gap) m, stddev_pop(gap) s from intervals group by 1 having count(*) >= 2),
  h as (select item_id, cast(round(60 / gap) as bigint) bpm, count(*) n from intervals where gap > 0 group by 1, 2),
  p as (select item_id, bpm, n, n / sum(n) over (partition by item_id) p, sum(n) over (partition by item_id) total,
    1 - n / sum(n) over (partition by item_id order by bpm range between 1 preceding and 1 following) spread,
    row_number() over (partition by item_id order by n desc, bpm) place from h),
  peaks as (select item_id, max(case when place = 1 then bpm end) p1, max(case when place = 1 then p end) w1, max(case when place = 1 then spread end) s1,
    max(case when place = 2 then bpm end) p2, max(case when place = 2 then p end) w2, max(case when place = 2 then spread end) s2, sum(-p * log2(p)) e from p where total >= 2 group by 1),
  c as (select item_id, unnest(bins) v from frames),
  mass as (select item_id, sum(abs(v)) m from c group by 1),
  cells as (select c.item_id, avg(v) m, stddev_pop(v) s, max(v) x, sum(-abs(v) / m * log2(abs(v) / m)) e from c join mass using (item_id) group by 1),
  loud as (select item_id, avg(loudness) m, stddev_pop(loudness) s, avg(bands[1] + bands[2]) lo, avg(bands[3] + bands[4]) mid, avg(bands[5]) hi,
    avg(bands[1]) m1, avg(bands[2]) m2, avg(bands[3]) m3, avg(bands[4]) m4, avg(bands[5]) m5 from bands group by 1),
  inharm as (select cast(l_suppkey as varchar) item_id, avg(l_extendedprice - 20000) m, stddev_pop(l_extendedprice - 20000) s from lineitem
    where l_discount > 0 and l_linenumber > 1 and l_extendedprice - 20000 >= 0 group by 1),
  pitch as (select item_id, sum(-mean / t * log2(mean / t)) e, sum(case when bin in (0, 2, 4, 5, 7, 9, 11) then mean else 0 end) / max(t) major,
    sum(case when bin in (0, 2, 3, 5, 7, 8, 10) then mean else 0 end) / max(t) minor, stddev_pop(mean) s, max(mean) x, avg(std) ts,
    HPCP from (select *, sum(mean) over (partition by item_id) t from bins) group by 1)
  select i.item_id, VALUES from items i left join people using (item_id) left join onset using (item_id) left join gaps using (item_id)
    left join peaks using (item_id) left join cells using (item_id) left join loud using (item_id) left join inharm using (item_id) left join pitch using (item_id)"""

_ACOUSTIC_VALUES = {
    "tempo_bpm": "c_acctbal", "onset_strength_mean": "onset.m", "onset_strength_std": "onset.s", "beat_interval_mean": "gaps.m", "beat_interval_std": "gaps.s",
    "beat_interval_cv": "gaps.s / gaps.m", "bpm_first_peak": "p1", "bpm_first_weight": "w1", "bpm_first_spread": "s1", "bpm_second_peak": "p2",
    "bpm_second_weight": "w2", "bpm_second_spread": "s2", "bpm_peak_ratio": "w2 / w1", "bpm_histogram_entropy": "peaks.e",
    "rhythm_transform_mean": "cells.m", "rhythm_transform_std": "cells.s", "rhythm_transform_max": "cells.x", "rhythm_transform_entropy": "cells.e",
    "beats_loudness_mean": "loud.m", "beats_loudness_std": "loud.s", "beats_low_ratio": "lo", "beats_mid_ratio": "mid", "beats_high_ratio": "hi",
    **{f"mfcc_{i}_mean": f"m{i}" for i in range(1, 6)}, "spectral_centroid_mean": "2 * onset.m", "spectral_centroid_std": "2 * onset.s",
    "spectral_contrast_mean": "cells.m", "inharmonicity_mean": "inharm.m", "inharmonicity_std": "inharm.s",
    "chroma_entropy": "pitch.e", "major_alignment": "major", "minor_alignment": "pitch.minor", **{f"hpcp_{i}": f"h{i}" for i in range(12)},
    "hpcp_entropy": "pitch.e", "hpcp_std": "pitch.s", "hpcp_max": "pitch.x", "hpcp_temporal_std": "ts", "key_strength": "c_acctbal / 10000",
    "is_minor": "cast(people.minor as int)", "key_cos": "cos(note / 12.0 * 2 * pi())", "key_sin": "sin(note / 12.0 * 2 * pi())",
}


@bind(
    "acoustic_row",
    _ACOUSTIC_SQL.replace("HPCP", ", ".join(f"max(case when bin = {i} then mean end) h{i}" for i in range(12)))
    .replace("VALUES", ", ".join(f"round(coalesce({sql}, 0)::double, 5) {name}" for name, sql in _ACOUSTIC_VALUES.items())),
    using="beats intervals frames bins bands",
)
def _(spark, d):
    """All 56 features of the users: frames of the labels, beats and onsets of the events, keys of the customers."""
    t = Tables(spark, d)
    lines = t.lineitem.select(
        F.col("l_suppkey").alias("item_id"), (F.col("l_extendedprice") - 20000).alias("value"), F.col("l_discount").alias("pitch"), F.col("l_linenumber").alias("peaks"))
    values = t.events.select(F.col("user_id").alias("item_id"), "value")
    names = F.array(*[F.lit(k) for k in ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")])
    key = t.customer.select(
        F.col("c_custkey").alias("item_id"), (F.col("c_acctbal") / 10000).alias("strength"),
        F.element_at(names, (F.col("c_nationkey") % 12 + 1).cast("int")).alias("key"), F.when(F.col("c_mktsegment") == "BUILDING", "minor").otherwise("major").alias("scale"))
    known = acoustic.FrameTables(
        tempo=t.customer.select(F.col("c_custkey").alias("item_id"), F.col("c_acctbal").alias("bpm")), key=key, onset=values, beats=t.beats(),
        transform=t.frames(), loudness=t.bands(), mfcc=t.bands().select("item_id", F.col("bands").alias("bins")),
        centroid=values.withColumn("value", 2 * F.col("value")), contrast=t.frames(), inharmonicity=lines, chroma=t.frames(), hpcp=t.frames())
    rows = acoustic.acoustic_rows(t.beat_items(), known, span=1.0)
    return rows.select("item_id", *[F.round(c, 5).alias(c) for c in rows.columns[1:]])


# --- J. recommendations -------------------------------------------------------------------------


@bind(
    "resolve_seeds",
    """select cast(request_id as varchar) request_id, position, coalesce(artist, '') artist, coalesce(title, '') title, catalogue_id is not null resolved,
      coalesce(catalogue_id, -1) catalogue_id, cand_title catalogue_title, case when catalogue_id is not null then 100.0 end score,
      case when coalesce(artist, '') = '' or coalesce(title, '') = '' then 'missing artist/title' when catalogue_id is null then 'no catalogue match' end reason from resolved""",
    using="resolved",
)
def _(spark, d):
    t = Tables(spark, d)
    rows = recommend.resolve_seeds(_requests(t), t.catalogue())
    return rows.na.fill(-1, ["catalogue_id"]).select(
        "request_id", F.col("position").cast("long").alias("position"), "artist", "title", "resolved", "catalogue_id", "catalogue_title", "score", "reason"
    )


@bind(
    "seed_vectors",
    """select request_id, seed_id, corpus_id, pos, round(val, 6) val from (select cast(request_id as varchar) request_id, catalogue_id || ':' || coalesce(corpus_id, '') seed_id, corpus_id,
      unnest(u) val, generate_subscripts(u, 1) - 1 pos from (select distinct request_id, catalogue_id, corpus_id, u from seed_rows))""",
    using="seed_rows",
)
def _(spark, d):
    _, rows = _seed_rows(Tables(spark, d))
    # a seed has one vector: plays are made distinct before their vectors are laid out, and dealt anew, since files of
    # repeated vectors are small and few tasks would read them
    plays = rows.select("request_id", "seed_id", "corpus_id").distinct()
    seeds = rows.select("seed_id", "embedding").dropDuplicates(["seed_id"])
    cells_ = plays.repartition(200, "request_id").join(F.broadcast(seeds) if seeds.count() <= neighbours.SIDE_ROWS else seeds, "seed_id")
    cells_ = cells_.select("request_id", "seed_id", "corpus_id", F.posexplode("embedding").alias("pos", "val"))
    return cells_.select("request_id", "seed_id", "corpus_id", F.col("pos").cast("long").alias("pos"), F.round("val", 6).alias("val"))


@bind(
    "build_evidence",
    "select cast(request_id as varchar) request_id, item_id, similarity, title, artist, valence, arousal, coalesce(replace(style, ', ', '|'), '') style, coalesce(mood, '') mood, coalesce(theme, '') theme from evidence",
    using="evidence",
)
def _(spark, d):
    _, rows = _evidence(Tables(spark, d))
    return rows.select(
        "request_id", "item_id", "similarity", "title", "artist", "valence", "arousal",
        *[F.array_join(c, "|").alias(c) for c in recommend.EVIDENCE_TAGS],
    )


@bind(
    "ranking_payload",
    """, intents as (select cast(request_id as varchar) request_id, 'tracks in the spirit of: ' ||
      string_agg(coalesce(nullif(artist, ''), '?') || ' - ' || coalesce(title, ''), '; ' order by position) intent from requests where position <= 5 group by 1),
    listed as (select cast(request_id as varchar) request_id, string_agg(coalesce(artist, '-') || '/' || coalesce(title, '-'), ';' order by position) seeds from requests group by 1)
    select e.*, intent, seeds from (select cast(request_id as varchar) request_id, row_number() over (partition by request_id order by similarity desc, item_id) - 1 pos, item_id id,
      title, artist, valence, arousal, similarity, coalesce(replace(style, ', ', '|'), '') style, coalesce(mood, '') mood, coalesce(theme, '') theme from evidence) e
      join intents using (request_id) join listed using (request_id)""",
    using="evidence requests",
)
def _(spark, d):
    """The documents, read back field by field."""
    t = Tables(spark, d)
    requests = _requests(t)
    payload = recommend.ranking_payload(
        recommend.describe_seeds(requests), _evidence(t)[1],
        requests.select("request_id", "position", F.col("artists")[0].alias("artist"), "title"),
    )
    tags_ = ",".join(f"{c}:array<string>" for c in recommend.EVIDENCE_TAGS)
    shape = (
        "struct<intent:string,seeds:array<struct<artist:string,title:string>>,"
        f"candidates:array<struct<id:string,title:string,artist:string,valence:double,arousal:double,similarity:double,{tags_}>>>"
    )
    read = payload.select("request_id", F.from_json("payload", shape).alias("p"))
    seeds = F.array_join(F.transform("p.seeds", lambda x: F.concat(F.coalesce(x["artist"], F.lit("-")), F.lit("/"), F.coalesce(x["title"], F.lit("-")))), ";")
    rows = read.select("request_id", F.col("p.intent").alias("intent"), seeds.alias("seeds"), F.posexplode("p.candidates").alias("pos", "c"))
    return rows.select(
        "request_id", F.col("pos").cast("long").alias("pos"), *[F.col(f"c.{c}").alias(c) for c in ("id", "title", "artist", "valence", "arousal", "similarity")],
        *[F.array_join(f"c.{c}", "|").alias(c) for c in recommend.EVIDENCE_TAGS], "intent", "seeds")


_RANKED = """, ranked as (select request_id, item_id, similarity fit, row_number() over (partition by request_id order by similarity desc, item_id) position from evidence)"""


@bind("rerank", _RANKED + " select cast(request_id as varchar) request_id, item_id, fit, position from ranked where position <= 10", using="evidence")
def _(spark, d):
    rows = recommend.rerank(_evidence(Tables(spark, d))[1], 10)
    return rows.select("request_id", "item_id", "fit", F.col("position").cast("long").alias("position"))


_SHOWN = """select cast(request_id as varchar) request_id, r.position, r.item_id song_id, coalesce(t.artist, '') artist, coalesce(t.title, '') title,
  l.label region, r.fit, '' reason, 'audio/' || t.quadrant || '/' || t.song_id || '.mp3' path from {rows} r join tracks t on t.song_id = r.item_id
  join membership m on m.item_id = r.item_id join labels3 l on l.community = m.community"""


def _shown(rows):
    return rows.withColumn("position", F.col("position").cast("long"))


@bind("recommendations", _RANKED + _SHOWN.format(rows="ranked") + " where r.position <= 5", using="evidence tracks membership labels3")
def _(spark, d):
    corpus, evidence = _evidence(Tables(spark, d))
    return _shown(recommend.recommendations(recommend.rerank(evidence, 5), corpus, 5))


@bind(
    "recommend_by_vector",
    """, hits as (select q.item_id request_id, x.item_id, round(list_inner_product(q.u, x.u), 4) fit, row_number() over (partition by q.item_id
      order by round(list_inner_product(q.u, x.u), 12) desc, x.item_id) position from centred q, centred x) """
    + _SHOWN.format(rows="hits") + " where r.position <= 5",
    using="centred tracks membership labels3",
)
def _(spark, d):
    t = Tables(spark, d)
    queries = t.vectors().select(F.col("item_id").alias("request_id"), "embedding")
    return _shown(recommend.recommend_by_vector(queries, _corpus(t, True), 5).recommendations)


@bind(
    "recommend_by_text",
    """, words as (select p_name request_id, unnest(string_split(p_name, ' ')) w from (select distinct p_name from part)),
    slots as (select request_id, cast('0x' || substr(md5(w), 1, 8) as bigint) % 64 slot, case when substr(md5(w), 9, 1) < '8' then 1.0 else -1.0 end s from words),
    raw as (select request_id, list_transform(range(0, 64), lambda i: coalesce(list_sum(list_transform(list_filter(g, lambda x: x.slot = i), lambda x: x.s)), 0.0)) e
      from (select request_id, list({'slot': slot, 's': cast(s as double)}) g from slots group by 1)),
    moved as (select request_id, list_transform(e, lambda x, i: x - m.mean[i]) c from raw, mean_row m),
    asked as (select request_id, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) u from moved),
    hits as (select q.request_id, x.item_id, round(list_inner_product(q.u, x.u), 4) fit, row_number() over (partition by q.request_id
      order by round(list_inner_product(q.u, x.u), 12) desc, x.item_id) position from asked q, centred x) """
    + _SHOWN.format(rows="hits") + " where r.position <= 5",
    using="centred mean_row tracks membership labels3",
)
def _(spark, d):
    """Names of parts as requests in words."""
    t = Tables(spark, d)
    queries = t.part.select(F.col("p_name").alias("request_id"), F.col("p_name").alias("text")).distinct()
    return _shown(recommend.recommend_by_text(queries, lambda: vectors.HashingEncoder(64), _corpus(t, True), 5).recommendations)


@bind(
    "recommend_by_item",
    """, one as (select cast(p.p_partkey as varchar) request_id, b.id, c.corpus_id, q.u from part p join catalogue_best b on b.artist = p.p_brand and b.title = p.p_name
      join centred q on q.item_id = cast(b.id as varchar) left join corpus_names c on c.a = lower(p.p_brand) and c.t = lower(p.p_name)),
    kinds as (select distinct id, corpus_id, u from one),
    near as (select k.id, k.corpus_id, x.item_id, round(list_inner_product(k.u, x.u), 4) fit, row_number() over (partition by k.id, k.corpus_id
      order by round(list_inner_product(k.u, x.u), 12) desc, x.item_id) position from kinds k join centred x on x.item_id is distinct from k.corpus_id),
    hits as (select o.request_id, n.item_id, n.fit, n.position from one o join near n on n.id = o.id and n.corpus_id is not distinct from o.corpus_id where n.position <= 5) """
    + _SHOWN.format(rows="hits"),
    using="catalogue_best centred corpus_names tracks membership labels3",
)
def _(spark, d):
    """Every part is the seed of its own request."""
    t = Tables(spark, d)
    seeds = t.part.select(
        F.col("p_partkey").cast("string").alias("request_id"), F.lit(1).alias("position"), F.array("p_brand").alias("artists"), F.col("p_name").alias("title")
    )
    found = recommend.recommend_by_item(seeds, t.catalogue(), t.catalogue_vectors(), _corpus(t, True), 5)
    return _shown(found.recommendations)


@bind(
    "recommend_playlist",
    _RANKED + """, kept as (select request_id, item_id, fit, row_number() over (partition by request_id order by position, item_id) position
      from ranked where fit >= 0.45) """ + _SHOWN.format(rows="kept") + " where r.position <= 20",
    using="evidence tracks membership labels3",
)
def _(spark, d):
    t = Tables(spark, d)
    found = recommend.recommend_playlist(_requests(t), t.catalogue(), t.catalogue_vectors(), _corpus(t, True), 20)
    return _shown(found.recommendations)


_PLAYLIST_SQL = _RANKED + """, kept as (select request_id, item_id, fit, row_number() over (partition by request_id order by position, item_id) position
      from ranked where fit >= 0.45) """ + _SHOWN.format(rows="kept") + " where r.position <= 20"


def _with_seeds(sql: str, seeds: str) -> str:
    """The SQL of the playlist flow with other seeds than the recent plays."""
    whole = with_views("evidence tracks membership labels3", sql)
    assert VIEWS["seeds20"] in whole
    return whole.replace(VIEWS["seeds20"], seeds)


def _playlist(t: Tables, seeds):
    found = recommend.recommend_playlist(recommend.as_requests(seeds, t.tracks()), t.catalogue(), t.catalogue_vectors(), _corpus(t, True), 20)
    return _shown(found.recommendations)


@bind("recommend_top", _with_seeds(_PLAYLIST_SQL, """select user_id, item_id, position from (select user_id, item_id, row_number() over (partition by user_id order by count(*) desc, item_id) position
    from history where ts >= (select max(ts) - interval 14 day from history) group by 1, 2) where position <= 20"""))
def _(spark, d):
    """Top plays of two weeks as the seeds of each user."""
    t = Tables(spark, d)
    return _playlist(t, ranking.top_seeds(t.history(), "medium_term", 20))


@bind("recommend_list", _with_seeds(_PLAYLIST_SQL, """select user_id, item_id, position from (select user_id, item_id, row_number() over (partition by user_id order by event_id) position
    from history) where position <= 20"""))
def _(spark, d):
    """The first entries of a list as seeds: each user's events in the order of their ids."""
    t = Tables(spark, d)
    entries = t.events.select("user_id", F.get_json_object("props", "$.k").alias("item_id"), F.col("event_id").alias("position"))
    return _playlist(t, ranking.playlist_seeds(entries, 20))


@bind("preprocess", "select song_id, quadrant, artist, title, mood, mood_all, genre, genre_main, theme, style from marked where drop_reason is null", using="marked")
def _(spark, d):
    t = Tables(spark, d)
    metadata = tables.scan_metadata(spark, _metadata_csv(t))
    av = t.tracks().select("song_id", "arousal", "valence")
    kept, _ = preprocess.prepare_tracks(metadata, av, t.audio_files(), FilterConfig(), TAXONOMY, EXCLUDED)
    return kept.select("song_id", "quadrant", "artist", "title", "mood", "mood_all", "genre", "genre_main", "theme", "style")


@bind("require_columns", "select c_custkey, c_name, c_acctbal from customer")
def _(spark, d):
    """A table passes the check for columns it has and is read; one that it lacks stops the query."""
    rows = Tables(spark, d).customer
    wanted = ["c_custkey", "c_name", "c_acctbal"]
    require_columns(rows, wanted, "customer")
    try:
        require_columns(rows, [*wanted, "c_region"], "customer")
    except ValueError as missing:
        if "c_region" in str(missing):
            return rows.select(*wanted)
    raise RuntimeError("an absent column was not noticed")
