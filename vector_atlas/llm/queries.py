"""The operators bound to the test tables, next to the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def bind(key: str, sql: str | None = None):
    def register(f):
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NEAR_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end s from words),
digests as (select doc_id, len(s) n, case when len(s) > 0 then md5(array_to_string(list_sort(s), '|')) end g, s from sets),
reps as (select min(doc_id) rep, any_value(n) n, any_value(s) s, g from digests where g is not null group by g),
grams as (select rep, n, unnest(s) x from reps),
links as (select a.rep a, b.rep b from grams a join grams b on a.x = b.x and a.rep < b.rep
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reach as (select rep node, rep root from reps union select e.b, r.root from reach r join both_ways e on e.a = r.node),
comps as (select node, min(root) component from reach group by node)
select d.doc_id, cast(d.n as bigint) n_shingles, coalesce(c.component, d.doc_id) component_id,
  coalesce(c.component, d.doc_id) = d.doc_id kept
from digests d left join reps r on d.g = r.g left join comps c on c.node = r.rep"""


@bind("op10_minmax_near_dedup", _NEAR_SQL)
def _(spark, d):
    from vector_atlas.llm.minmax import near_duplicates

    return near_duplicates(table(spark, d, "documents"))


_LEAK_SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
iw as (select distinct item_id, least(len(w), 10) k, array_to_string(w[i:i + 9], ' ') g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) i from bw where len(w) > 0)),
dg as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from dw, (select distinct k from iw) where len(w) >= k)),
hits as (select d.doc_id, d.i, d.k, iw.item_id from dg d join iw on d.k = iw.k and d.g = iw.g),
words_hit as (select doc_id, count(distinct p) n_hit from (select distinct doc_id, unnest(range(i, i + k)) p from hits) group by doc_id),
items_hit as (select doc_id, count(*) n_items, sha256(string_agg(item, ',' order by item)) s
  from (select distinct doc_id, cast(item_id as varchar) item from hits) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  coalesce(s, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join words_hit using (doc_id) left join items_hit using (doc_id)"""


@bind("op8_positional_index", _LEAK_SQL)
def _(spark, d):
    from vector_atlas.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _crc_nibbles() -> str:
    """The CRC-32 table for four bits, from its polynomial."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return str(out)


_SHARD_SQL = r"""
with bytes as (select doc_id, source, text, hex(encode(coalesce(text, ''))) x from documents),
crc as (select doc_id, source, coalesce(strlen(text), 0) + 1 size, xor(list_reduce(list_prepend(4294967295::bigint,
    list_transform(range(1, len(x) + 1), lambda i: (instr('0123456789ABCDEF', substr(x, case when i % 2 = 1 then i + 1 else i - 1 end, 1)) - 1)::bigint)),
    lambda c, n: xor(c >> 4, NIBBLES[1 + (xor(c, n) & 15)])), 4294967295) text_crc32,
  md5('17:' || coalesce(cast(doc_id as varchar), '')) g, coalesce('s' || source, '') s from bytes),
ranked as (select *, row_number() over (partition by s order by g, doc_id, text_crc32) r, count(*) over (partition by s) n from crc),
placed as (select *, row_number() over (order by cast((2 * r - 1) as double) / (2 * n), s, doc_id, text_crc32) - 1 p, count(*) over () total from ranked),
cut as (select *, (p * 16) // total shard from placed)
select doc_id, cast(size as bigint) size, cast(text_crc32 as bigint) text_crc32, 'rows' law, cast(shard as int) shard,
  cast(p - cast(ceil(shard * total / 16) as bigint) as bigint) slot, cast(null as int) grown_shard from cut""".replace("NIBBLES", _crc_nibbles())


@bind("op1_stratified_shards", _SHARD_SQL)
def _(spark, d):
    from vector_atlas.llm.shards import assign_shards

    text = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = assign_shards(rows, 16, tie_cols=("text_crc32",))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_MIX_SQL = r"""
with numbered as (select *, row_number() over (partition by source, doc_id, coalesce(text, '') order by doc_id) nth from documents),
sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size,
  len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+[.,]?[\x20\x0A]')) plain,
  md5(concat(md5(concat('23:', coalesce('i' || cast(doc_id as varchar), 'n'), ':', md5(coalesce(text, '')))), ':', nth)) g, coalesce('0' || source, '1') s from numbered),
hashed as (select *, cast('0x' || substr(g, 1, 12) as bigint) h from sized),
keyed as (select *, -ln((h + 0.5::double) / 281474976710656::double) / ((1 + plain)::double / (1 + size)) k from hashed),
sources as (select s, sum(size)::bigint source_size from keyed group by s),
weights as (select *, [5, 2, 1][1 + (row_number() over (order by s) - 1) % 3] w, 3 * source_size most from sources),
levels as (select *, most::double / w lev from weights),
water as (select *, (sum(source_size) over () - coalesce(sum(most) over b, 0))::double / (sum(w) over () - coalesce(sum(w) over b, 0))::double wat
  from levels window b as (order by lev, s rows between unbounded preceding and 1 preceding)),
aims as (select s, source_size, case when lev <= wat then most::double else w * max(case when lev > wat then wat end) over () end target from water),
parts as (select *, case when source_size > 0 then floor(target / source_size + 1e-9) else 0 end epochs from aims),
run as (select doc_id, size, source_size, target, epochs, greatest(0, target - epochs * source_size) rest,
  sum(size) over (partition by s order by k, g rows unbounded preceding) upto from keyed join parts using (s))
select doc_id, cast(size as bigint) size, source_size, target,
  cast(size * (epochs + case when rest > 0 and 2 * upto - size <= 2 * rest then 1 else 0 end) as bigint) taken from run"""


@bind("op4_weighted_mixture", _MIX_SQL)
def _(spark, d):
    from vector_atlas.llm.mixture import keyed, mix_keyed, occurrences, weighed
    from vector_atlas.session import materialise

    rows = weighed(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source", seed=23)
    rows = materialise(rows.drop("text").withColumn("row", F.monotonically_increasing_id()), "weighed")
    rows = keyed(rows, occurrences(rows, "row"), "row")
    mixed = mix_keyed(rows, rows)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@bind("op3_knn_quality")
def _(spark, d):
    from vector_atlas.llm.knn_quality import held_out, score

    labels = table(spark, d, "labels").where(~held_out()).select("doc_id", "quality")
    scored = score(table(spark, d, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@bind("op9_fuzzy_licenses")
def _(spark, d):
    from vector_atlas.llm.licenses import scan_licenses

    spans = F.transform("spans", lambda s: F.concat_ws(":", s["label"], F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")), s["edits"].cast("string")))
    return scan_licenses(table(spark, d, "documents")).withColumn("spans", F.array_join(spans, ",")).withColumnRenamed("id", "doc_id")


@bind("op2_path_templates")
def _(spark, d):
    from vector_atlas.llm.url_templates import judge_urls

    return judge_urls(table(spark, d, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


_CHAT_SQL = r"""
with turns as (select conv_id, turn, coalesce(role, 'unknown') role, replace(coalesce(text, ''), '<|', '< |') text from conversations),
seen as (select t.*, s.perspective from turns t join (select distinct conv_id, role perspective from turns where role <> 'system') s using (conv_id)),
heads as (select *, '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then 'system'
  else 'user name=' || replace(role, '<|', '< |') end || chr(10) head from seen),
placed as (select *, sum(length(head) + length(text) + 11) over w - length(text) - 11 a from heads
  window w as (partition by conv_id, perspective order by turn nulls first, role, text rows unbounded preceding))
select conv_id, perspective, count(*) n_turns,
  string_agg(head || text || '<|im_end|>' || chr(10), '' order by turn nulls first, role, text) rendered,
  coalesce(string_agg(cast(a as bigint) || '-' || cast(a + length(text) as bigint), ',' order by turn nulls first, role, text) filter (where role = perspective), '') masks
from placed group by conv_id, perspective"""


@bind("op6_perspective_rotation", _CHAT_SQL)
def _(spark, d):
    from vector_atlas.llm.perspectives import rotate

    spans = F.array_join(F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return rotate(table(spark, d, "conversations")).withColumn("masks", spans)


@bind("op7_order_minhash")
def _(spark, d):
    from vector_atlas.llm.order_minhash import as_text, fingerprint_edits, likeness

    rows = fingerprint_edits(table(spark, d, "documents"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("signature")).alias("fingerprint"), as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


@bind("op5_collinear_passages")
def _(spark, d):
    from vector_atlas.llm.passages import repeated_passages

    return repeated_passages(table(spark, d, "documents"))


@bind("op11_language_spans")
def _(spark, d):
    from vector_atlas.llm.language_spans import held_out, label_languages, learn

    docs = table(spark, d, "documents")
    found = label_languages(docs, learn(docs.where(~held_out())))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(":"), s["lang"])), ",")
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", spans.alias("spans"))


_RANK_SQL = r"""
with d as (select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents),
q as (select item_id, term, count(*) q from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark) group by item_id, term),
n as (select count(*)::bigint n_docs, sum(len(t))::bigint n_terms from d where len(t) > 0),
tf as (select r, term, count(*)::bigint tf from (select r, unnest(t) term from d) where term in (select term from q) group by r, term),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) w from tf, n group by term, n_docs),
m as (select r, doc_id, 25 + (75 * len(t)::bigint * n_docs) // n_terms m from d, n where len(t) > 0),
s as (select item_id, doc_id, r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
  from q join w using (term) join tf using (term) join m using (r) group by item_id, doc_id, r),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from s where score > 0)
select item_id, cast(rank as int) rank, doc_id, score from ranked where rank <= 10"""


@bind("op12_nra_ranking", _RANK_SQL)
def _(spark, d):
    from vector_atlas.llm.lexical_search import rank_documents

    return rank_documents(table(spark, d, "documents"), table(spark, d, "benchmark"))


_TRIE_SQL = r"""
with turns as (select conv_id c, turn, length(coalesce(text, '')) n, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) token
  from conversations where conv_id is not null),
placed as (select c, n, token, row_number() over (partition by c order by turn nulls first, token) - 1 pos from turns),
ids as (select distinct c, hex(encode(cast(c as varchar))) x from turns),
heads as (select c, c - c % 100 base, xor(list_reduce(list_prepend(4294967295::bigint,
    list_transform(range(1, len(x) + 1), lambda i: (instr('0123456789ABCDEF', substr(x, case when i % 2 = 1 then i + 1 else i - 1 end, 1)) - 1)::bigint)),
    lambda a, b: xor(a >> 4, NIBBLES[1 + (xor(a, b) & 15)])), 4294967295) % 6 h from ids),
rebuilt as (select h.c, p.pos, p.n, p.token, 0 part from heads h join placed p on p.c = h.base and p.pos < h.h
  union all select h.c, p.pos, p.n, p.token, 1 from heads h join placed p on p.c = h.c and p.pos >= h.h),
seq as (select c, n, token, row_number() over (partition by c order by part, pos) d from rebuilt),
path as (select c, d, n, sha256(string_agg(token, '') over (partition by c order by d)) k from seq union all select c, 0, 0, '' from heads),
size as (select c, max(d) size from path group by c),
nodes as (select d, k, any_value(n) n, min(c) conv_id, count(*) n_convs from path group by d, k),
ends as (select d, k, sha256(string_agg(cast(c as varchar), ',' order by c)) e from path join size using (c) where d = size group by d, k),
up as (select b.d, b.k, b.n, b.conv_id, b.n_convs, a.k pk from nodes b left join path a on a.c = b.conv_id and a.d = b.d - 1),
kids as (select d - 1 d, pk k, count(*) n from up where d > 0 group by all),
marked as (select u.*, coalesce(kids.n, 0) n_children, (kids.n is null)::int leaf, (u.n_convs - 1) * u.n saved from up u left join kids using (d, k)),
below as (select a.d, a.k, sum(m.leaf) n_leaves, sum(m.saved) saved from marked m join path a on a.c = m.conv_id and a.d <= m.d group by a.d, a.k)
select m.conv_id, cast(m.d as bigint) depth, p.conv_id parent_conv_id, cast(m.n_convs as bigint) n_convs, cast(m.n_children as bigint) n_children,
  cast(b.n_leaves as bigint) n_leaves, cast(b.saved as bigint) saved_tokens, coalesce(e.e, sha256('')) ends_sha256
from marked m join below b using (d, k) left join nodes p on p.d = m.d - 1 and p.k = m.pk left join ends e on e.d = m.d and e.k = m.k""".replace("NIBBLES", _crc_nibbles())


@bind("op13_euler_trie", _TRIE_SQL)
def _(spark, d):
    from vector_atlas.llm.prefix_trie import prefix_trie

    conv = F.col("conv")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    return prefix_trie(table(spark, d, "conversations"), head, conv - conv % 100)
