"""Role views over the driver tables: each plays the part of one of the engine's tables.

The same view is given twice, as DataFrames and as SQL for the check. Every view reads its
whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vector_atlas.operators.vectors import l2_normalize

# fixed values of the bound examples: a genre taxonomy over part types
TAXONOMY = {"Compact": ["SMALL", "ECONOMY"], "Regular": ["STANDARD", "MEDIUM"], "Big": ["LARGE"]}
EXCLUDED = ("PROMO",)


class Tables:
    """Lazy readers of one scale directory."""

    def __init__(self, spark, sf_dir):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def __getattr__(self, name):
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- vectors ------------------------------------------------------------------------
    def vectors(self):
        return self.embeddings.select(F.col("vec_id").cast("string").alias("item_id"), "embedding")

    def unit(self):
        return l2_normalize(self.vectors())

    def membership(self):
        return self.embeddings.select(
            F.col("vec_id").cast("string").alias("item_id"), F.col("label").cast("long").alias("community")
        )

    def coords(self):
        even = F.aggregate(F.filter("embedding", lambda v, i: i % 2 == 0), F.lit(0.0), lambda a, v: a + v.cast("double"))
        odd = F.aggregate(F.filter("embedding", lambda v, i: i % 2 == 1), F.lit(0.0), lambda a, v: a + v.cast("double"))
        return self.vectors().select("item_id", even.alias("x"), odd.alias("y"))

    # --- tracks -------------------------------------------------------------------------
    def tracks(self):
        e = self.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in ((0, "arousal"), (1, "valence"))])
        words = F.split("p_name", " ")
        null = F.lit(None).cast("string")
        return e.join(self.part.hint("merge"), e.vec_id == F.col("p_partkey"), "left").select(
            F.col("vec_id").cast("string").alias("song_id"),
            F.concat(F.lit("Q"), (1 + F.col("label") % 4).cast("string")).alias("quadrant"),
            "arousal",
            "valence",
            F.col("p_brand").alias("artist"),
            F.col("p_name").alias("title"),
            F.col("p_size").cast("double").alias("duration"),
            words[0].alias("mood"),
            F.replace("p_name", F.lit(" "), F.lit(", ")).alias("mood_all"),
            F.col("p_size").cast("string").alias("mood_all_weights"),
            F.col("p_type").alias("genre"),
            null.alias("genre_weights"),
            words[1].alias("theme"),
            null.alias("theme_weights"),
            F.concat("p_brand", F.lit(", "), "p_type").alias("style"),
            null.alias("style_weights"),
        )

    def raw_metadata(self):
        from vector_atlas.schemas import METADATA_COLUMNS

        t = self.tracks()
        return t.select(*[F.col(c).cast("string").alias(s) for s, c in METADATA_COLUMNS.items()])

    def audio_files(self):
        """Items that have a file: those with a label row of the same id."""
        ids = self.labels.select(F.col("doc_id").cast("string").alias("song_id"))
        return self.tracks().select("quadrant", "song_id").join(ids, "song_id", "left_semi")

    # --- plays --------------------------------------------------------------------------
    def history(self):
        return self.events.select(
            "user_id", "ts", F.get_json_object("props", "$.k").alias("item_id"), "event_id"
        )

    # --- signals ------------------------------------------------------------------------
    def items(self):
        return self.embeddings.select(F.col("label").cast("string").alias("item_id")).distinct()

    def _folded(self, width):
        def one(b):
            chosen = F.filter("embedding", lambda v, i: i % width == b)
            return F.aggregate(chosen, F.lit(0.0), lambda a, v: a + F.abs(v.cast("double")))

        return F.array(*[one(b) for b in range(width)])

    def frames(self):
        """Twelve-bin profiles: absolute components folded modulo 12; an item is a label."""
        return self.embeddings.select(
            F.col("label").cast("string").alias("item_id"), F.col("vec_id").alias("frame"), self._folded(12).alias("bins")
        )

    def bands(self):
        f = self._folded(5)
        return self.embeddings.select(
            F.col("label").cast("string").alias("item_id"),
            F.aggregate(F.col("embedding"), F.lit(0.0), lambda a, v: a + F.abs(v.cast("double"))).alias("loudness"),
            f.alias("bands"),
        )

    def signal(self):
        return self.vectors().select("item_id", F.col("embedding").alias("samples"))

    def beats(self):
        """Beat times in days per user."""
        return self.events.select(
            F.col("user_id").cast("string").alias("item_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400e6)).alias("t")
        )

    def beat_items(self):
        return self.events.select(F.col("user_id").cast("string").alias("item_id")).distinct()

    # --- catalogue ----------------------------------------------------------------------
    def catalogue(self):
        """Search results: parts under their brand and name. Promotional ones have another title."""
        key = F.concat(F.lit('artist:"'), "p_brand", F.lit('" track:"'), "p_name", F.lit('"'))
        shown = F.when(F.col("p_type") == "PROMO", "zzzz").otherwise(F.concat("p_name", F.lit(" "), F.lower("p_type")))
        small = F.concat(F.lit("c/"), F.col("p_partkey").cast("string"))
        none = F.lit(None).cast("string")
        artist = F.struct(
            F.col("p_size").cast("long").alias("id"), F.col("p_brand").alias("name"), none.alias("link"),
            *[none.alias(f"picture_{s}") for s in ("small", "medium", "big", "xl")],
        )
        album = F.struct(
            F.lit(None).cast("long").alias("id"), none.alias("title"), none.alias("link"),
            small.alias("cover_small"), *[none.alias(f"cover_{s}") for s in ("medium", "big", "xl")],
        )
        candidate = F.struct(
            F.col("p_partkey").alias("id"),
            shown.alias("title"),
            F.col("p_size").cast("long").alias("duration"),
            F.concat(F.lit("I"), F.col("p_partkey").cast("string")).alias("isrc"),
            none.alias("link"),
            none.alias("preview"),
            (F.lit(1_000_000_000) - F.col("p_partkey")).cast("long").alias("rank"),
            artist.alias("artist"),
            album.alias("album"),
        )
        return self.part.withColumn("search_key", key).select(
            "search_key", F.col("p_partkey").alias("position"), candidate.alias("candidate")
        )

    def catalogue_vectors(self):
        return self.embeddings.select(F.col("vec_id").alias("catalogue_id"), "embedding")


# --- the same views in SQL --------------------------------------------------------------------

_TRACKS = """
select cast(e.vec_id as varchar) song_id, 'Q' || cast(1 + e.label % 4 as varchar) quadrant,
       cast(e.embedding[1] as double) arousal, cast(e.embedding[2] as double) valence,
       p.p_brand artist, p.p_name title, cast(p.p_size as double) duration,
       split_part(p.p_name, ' ', 1) mood, replace(p.p_name, ' ', ', ') mood_all,
       cast(p.p_size as varchar) mood_all_weights, p.p_type genre, cast(null as varchar) genre_weights,
       split_part(p.p_name, ' ', 2) theme, cast(null as varchar) theme_weights,
       p.p_brand || ', ' || p.p_type style, cast(null as varchar) style_weights
from embeddings e left join part p on p.p_partkey = e.vec_id"""

_CENTRED = """
select item_id, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) u from (
  select v.item_id, list_transform(v.e, lambda x, i: x - m.mean[i]) c
  from vectors v, mean_row m)"""


def _fold(width: int) -> str:
    return "[" + ", ".join(
        f"list_sum(list_transform(list_filter(e, lambda x, i: (i - 1) % {width} = {b}), lambda x: abs(x)))" for b in range(width)
    ) + "]"


VIEWS = {
    "vectors": "select cast(vec_id as varchar) item_id, cast(embedding as double[]) e from embeddings",
    "unit": "select item_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) u from vectors",
    "mean_row": """select list(m order by pos) mean from (
        select pos, avg(x) m from (select unnest(e) x, generate_subscripts(e, 1) pos from vectors) group by pos)""",
    "centred": _CENTRED,
    "pairs": """select a.item_id src, b.item_id dst, list_inner_product(a.u, b.u) score
        from unit a join unit b on a.item_id <> b.item_id""",
    "knn10": """select * from (select src, dst, score,
          row_number() over (partition by src order by round(score, 12) desc, dst) rank from pairs) where rank <= 10""",
    "knn3": """select * from (select src, dst, score,
          row_number() over (partition by src order by round(score, 12) desc, dst) rank from pairs) where rank <= 3""",
    "directed10": "select src, dst, least(greatest(score, 0), 1) weight from knn10 where score > 0",
    "directed3": "select src, dst, least(greatest(score, 0), 1) weight from knn3 where score > 0",
    "graph10": """select least(src, dst) src, greatest(src, dst) dst, max(weight) weight
        from directed10 group by 1, 2""",
    "mutual3": """select least(src, dst) src, greatest(src, dst) dst, min(weight) weight
        from directed3 group by 1, 2 having count(*) = 2""",
    "membership": "select cast(vec_id as varchar) item_id, cast(label as bigint) community from embeddings",
    "coords": """select item_id,
          list_sum(list_filter(e, lambda x, i: (i - 1) % 2 = 0)) x,
          list_sum(list_filter(e, lambda x, i: (i - 1) % 2 = 1)) y from vectors""",
    "tracks": _TRACKS,
    "clean": """select * replace (coalesce(lower(mood), '') as mood, coalesce(lower(mood_all), '') as mood_all,
          coalesce(lower(theme), '') as theme, coalesce(lower(style), '') as style),
          coalesce(case when genre in ('SMALL', 'ECONOMY') then 'Compact'
               when genre in ('STANDARD', 'MEDIUM') then 'Regular'
               when genre = 'LARGE' then 'Big' end, '') genre_main from tracks""",
    "audio_files": "select quadrant, song_id from tracks where song_id in (select cast(doc_id as varchar) from labels)",
    "marked": """select c.*, case when coalesce(mood_all, '') = '' then 'missing mood'
            when genre_main = '' then 'missing genre'
            when coalesce(theme, '') = '' then 'missing theme'
            when coalesce(style, '') = '' then 'missing style'
            when a.song_id is null then 'missing audio' end drop_reason
        from clean c left join audio_files a on a.quadrant = c.quadrant and a.song_id = c.song_id""",
    "history": "select user_id, ts, json_extract_string(props, '$.k') item_id, event_id from events",
    "items": "select distinct cast(label as varchar) item_id from embeddings",
    "frames": f"""select cast(label as varchar) item_id, vec_id frame, {_fold(12)} bins
        from (select label, vec_id, cast(embedding as double[]) e from embeddings)""",
    "bands": f"""select cast(label as varchar) item_id, list_sum(list_transform(e, lambda x: abs(x))) loudness, {_fold(5)} bands
        from (select label, cast(embedding as double[]) e from embeddings)""",
    "bins": """select item_id, bin, avg(v) mean, stddev_pop(v) std from (
          select item_id, unnest(bins) v, generate_subscripts(bins, 1) - 1 bin from frames) group by 1, 2""",
    "beats": "select cast(user_id as varchar) item_id, epoch_us(ts) / 86400e6 t from events",
    "intervals": """select item_id, gap from (
          select item_id, t - lag(t) over (partition by item_id order by t) gap from beats) where gap is not null""",
    "frames16": """select item_id, s // 8 frame, list_slice(e, s + 1, s + 16) samples
        from vectors, (select unnest([0, 8, 16, 24, 32, 40, 48]) s) where len(e) = 64""",
    "tagged": """select community, col, trim(tag) tag, count(*) n from (
          select m.community, col, unnest(string_split(cell, ',')) tag from membership m join (
            select song_id, 'style' col, style cell from tracks union all
            select song_id, 'theme', theme from tracks union all
            select song_id, 'mood_all', mood_all from tracks) c on c.song_id = m.item_id)
        where trim(tag) <> '' group by 1, 2, 3""",
    "labels3": """select k.community, coalesce(l.label, '') label from (select distinct community from membership) k left join (
          select community, string_agg(tag, ', ' order by place) label from (
            select community, tag, row_number() over (partition by community order by n desc, tag) place
            from tagged where col = 'mood_all') where place <= 3 group by community) l on l.community = k.community""",
    "seeds20": """select * from (select user_id, item_id, ts,
          row_number() over (partition by user_id order by ts desc, item_id) position from history) where position <= 20""",
    "catalogue": """select p_brand artist, p_name title, p_partkey id, 1000000000 - p_partkey rank,
          case when p_type = 'PROMO' then 'zzzz' else p_name || ' ' || lower(p_type) end cand_title, p_size,
          row_number() over (partition by p_brand, p_name order by p_partkey) position from part""",
    "catalogue_best": """select * from (select *, row_number() over (partition by artist, title
          order by rank desc, position) n from catalogue where cand_title <> 'zzzz') where n = 1""",
    "requests": """select s.user_id request_id, s.position, t.artist, t.title
        from seeds20 s join tracks t on t.song_id = s.item_id""",
    "resolved": """select r.request_id, r.position, r.artist, r.title, b.id catalogue_id, b.cand_title
        from requests r left join catalogue_best b on b.artist = r.artist and b.title = r.title""",
    "corpus_names": """select lower(trim(artist)) a, lower(trim(title)) t, min(song_id) corpus_id
        from tracks where artist is not null group by 1, 2""",
    "seed_rows": """select distinct r.request_id, r.catalogue_id, c.corpus_id, q.u
        from resolved r join centred q on q.item_id = cast(r.catalogue_id as varchar)
        left join corpus_names c on c.a = lower(trim(r.artist)) and c.t = lower(trim(r.title))
        where r.catalogue_id is not null""",
    "seed_hits": """select * from (select s.catalogue_id, s.corpus_id, x.item_id, list_inner_product(s.u, x.u) score,
          row_number() over (partition by s.catalogue_id, s.corpus_id
            order by round(list_inner_product(s.u, x.u), 12) desc, x.item_id) n
        from (select distinct catalogue_id, corpus_id, u from seed_rows) s
        join centred x on x.item_id is distinct from s.corpus_id) where n <= 3""",
    "pool": """select s.request_id, h.item_id, greatest(max(h.score), 0) score
        from seed_rows s join seed_hits h on h.catalogue_id = s.catalogue_id and h.corpus_id is not distinct from s.corpus_id
        group by 1, 2""",
    "evidence": """select p.request_id, p.item_id, round(p.score, 4) similarity, coalesce(t.title, '') title, coalesce(t.artist, '') artist,
          round(t.valence, 4) valence, round(t.arousal, 4) arousal, t.style, t.mood, t.theme
        from pool p join tracks t on t.song_id = p.item_id""",
}

_NEEDS = {
    "unit": ["vectors"], "mean_row": ["vectors"], "centred": ["vectors", "mean_row"], "pairs": ["unit"],
    "knn10": ["pairs"], "knn3": ["pairs"], "directed10": ["knn10"], "directed3": ["knn3"],
    "graph10": ["directed10"], "mutual3": ["directed3"], "coords": ["vectors"], "clean": ["tracks"],
    "audio_files": ["tracks"], "marked": ["clean", "audio_files"], "bins": ["frames"], "intervals": ["beats"],
    "frames16": ["vectors"], "tagged": ["membership", "tracks"], "labels3": ["membership", "tagged"],
    "seeds20": ["history"], "catalogue_best": ["catalogue"], "requests": ["seeds20", "tracks"],
    "resolved": ["requests", "catalogue_best"], "corpus_names": ["tracks"],
    "seed_rows": ["resolved", "centred", "corpus_names"], "seed_hits": ["seed_rows", "centred"],
    "pool": ["seed_rows", "seed_hits"], "evidence": ["pool", "tracks"],
}


def with_views(names: str, sql: str) -> str:
    """Prefix ``sql`` with the named views and all they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    recursive = "recursive " if sql.lstrip().startswith(",") else ""
    if not order:
        return sql
    # views read several times are computed once
    ctes = ", ".join(f"{name} as materialized ({VIEWS[name].strip()})" for name in order)
    return f"with {recursive}{ctes} {sql.strip()}"
