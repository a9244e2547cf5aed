"""Language spans, ranked search and the prefix trie against brute force and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vector_atlas.llm import language_spans, lexical_search, prefix_trie, textbuf

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_pieces_cut_long_texts_between_words():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["", None, "one two", " ".join("ab" * rng.randrange(1, 9) for _ in range(400)), "x" * 300, "a b", "tail " * 100 + "y" * 150]
    mask = textbuf.alnum_words()
    for size in (1, 7, 64, 10_000):
        got = defaultdict(list)
        for lo, data, offs in textbuf.pieces(pa.array(texts), mask, size):
            for i in range(len(offs) - 1):
                got[lo + i] += TERM.findall(bytes(data[offs[i] : offs[i + 1]]).decode())
        assert [got[i] for i in range(len(texts))] == [TERM.findall(t or "") for t in texts]


# --- language spans -------------------------------------------------------------------------------


def path_by_hand(scores, switch):
    best = None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        value = sum(int(scores[t, x]) for t, x in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
        best = value if best is None or value > best else best
    return best


def value_of(scores, labels, switch):
    return sum(int(scores[t, x]) for t, x in enumerate(labels)) - switch * int((labels[1:] != labels[:-1]).sum())


@pytest.mark.parametrize("block", [1, 2, 3, 128])
def test_paths_are_the_best_ones(block):
    rng = np.random.default_rng(3)
    for width in (1, 2, 3):
        counts = [0, 1, 7, 0, 3, 6, 0]
        offs = np.concatenate(([0], np.cumsum(counts)))
        scores = rng.integers(-9, 0, (offs[-1], width)).astype(np.int64)
        for switch in (0, 4, 100):
            labels = language_spans.best_paths(scores, offs, switch, block)
            for a, b in zip(offs, offs[1:]):
                if b > a:
                    assert value_of(scores[a:b], labels[a:b], switch) == path_by_hand(scores[a:b], switch)


def test_paths_do_not_depend_on_blocks():
    rng = np.random.default_rng(4)
    offs = np.concatenate(([0], np.cumsum(rng.integers(0, 900, 12))))
    scores = rng.integers(-2000, 0, (offs[-1], 4)).astype(np.int64)
    one = language_spans.best_paths(scores, offs, 900, 10_000)
    assert len(set(one.tolist())) == 4
    for block in (1, 16, 128):
        assert (language_spans.best_paths(scores, offs, 900, block) == one).all()


VOICES = {
    "en": "the of and that with this from have which there been their would about when people water".split(),
    "de": "der die und nicht mit auch über werden straße größe jahr zwischen können mehr haben zeit".split(),
    "el": "και το να της που είναι για με στην από δεν θα τους".split(),
    "zh": ["的", "一是", "不了", "人我在", "有他这", "中大来", "上国个"],
}


def voice(rng, lang, n):
    return " ".join(rng.choice(VOICES[lang]) for _ in range(n))


def corpus(spark, rng, n=40):
    rows = [(i, voice(rng, lang, rng.randrange(5, 60)), lang) for i, lang in enumerate(list(VOICES) * n)]
    return spark.createDataFrame([(i, t, lang, "x", "y", "z") for i, t, lang in rows], "doc_id bigint, text string, lang string, id string, score string, spans string")


def test_languages_spans_and_odd_texts(spark):
    rng = random.Random(5)
    model = language_spans.learn(corpus(spark, rng))
    assert model.names == sorted(VOICES)
    own = {lang: voice(rng, lang, 30) for lang in VOICES}
    mixed = own["en"] + ". " + own["de"] + " - " + own["el"]
    odd = [
        (1, None, "und"), (2, "", "und"), (3, " 12 ., 34 ✓", "und"), (4, own["de"], "de"), (5, own["zh"], "zh"), (6, mixed, None), (6, own["el"], "el"),
        (7, "ⴰⵎⴰⵣⵉⵖ", None), (8, "жизнь", None), (None, own["en"], "en"), (9, "The", "en"), (10, own["en"].upper(), "en"),
    ]
    docs = spark.createDataFrame([(i, t, "l", 0.5) for i, t, _ in odd], "doc_id bigint, text string, lang_pred string, score double")
    got = sorted(language_spans.label_languages(docs, model).collect(), key=lambda r: (r.id is None, r.id or 0))
    want = sorted(odd, key=lambda r: (r[0] is None, r[0] or 0))
    for r, (_, text, lang) in zip(got, want):
        assert 0 <= r.score <= 1
        if lang:
            assert r.lang_pred == lang
        if lang == "und":
            assert r.score == 0 and r.spans == []
        if text == "ⴰⵎⴰⵣⵉⵖ":  # a script that is not listed
            assert r.lang_pred in VOICES and r.spans == []
        if text == "жизнь":  # a script that no language of the model uses leaves all of them
            assert r.lang_pred in VOICES
        if text == mixed:
            assert [(s.lang, text[s.start : s.end]) for s in r.spans] == [(x, own[x]) for x in ("en", "de", "el")]


def test_language_of_a_long_text_is_that_of_its_pieces(spark):
    rng = random.Random(6)
    model = language_spans.learn(corpus(spark, rng))
    text = voice(rng, "el", 500_000) + " " + voice(rng, "en", 400_000)
    assert len(text.encode()) > 5_000_000
    docs = spark.createDataFrame([(1, text), (2, voice(rng, "de", 4))], "doc_id bigint, text string")
    rows = {r.id: r for r in language_spans.label_languages(docs, model).collect()}
    assert rows[1].lang_pred == "el" and [s.lang for s in rows[1].spans] == ["el", "en"]
    assert rows[1].spans[-1].end == len(text) and rows[2].lang_pred == "de"


def test_languages_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    model = language_spans.learn(empty)
    docs = spark.createDataFrame([(1, "words"), (2, None)], "doc_id bigint, text string")
    assert {(r.lang_pred, r.score) for r in language_spans.label_languages(docs, model).collect()} == {("und", 0.0)}
    assert language_spans.label_languages(empty, model).count() == 0
    alone = language_spans.learn(docs.withColumn("lang", F.lit("one")))
    assert [r.lang_pred for r in language_spans.label_languages(docs, alone).orderBy("id").collect()] == ["one", "und"]
    with pytest.raises(ValueError):
        language_spans.learn(docs.withColumn("lang", F.col("doc_id").cast("string")), cfg=language_spans.LanguageConfig(languages=1))


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_spans.held_out()
    found = language_spans.label_languages(docs.where(held), language_spans.learn(docs.where(~held)))
    rows = found.join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("right")).collect()
    assert len(rows) > 200 and sum(r.right for r in rows) / len(rows) > 0.97


# --- ranked search --------------------------------------------------------------------------------


def rank_by_hand(docs, items, k=10):
    bags = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(term for _, b, _ in bags for term in b)
    queries = defaultdict(Counter)
    for item, text in items:
        if text is not None:
            queries[item].update(TERM.findall(lower(text)))
    out = []
    for item, terms in queries.items():
        scored = []
        for i, bag, n in bags:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, q in terms.items() if t in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("cfg", [
    lexical_search.RankConfig(), lexical_search.RankConfig(depth=1, block_bytes=300), lexical_search.RankConfig(depth=2, portion=20, block_bytes=50), lexical_search.RankConfig(k=3, depth=4),
])
def test_ranking_equals_brute_force(spark, cfg):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(9000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60))).upper()) for i in range(150)]
    docs += [(i, docs[3][1]) for i in range(150, 190)]  # more equal scores than places
    docs += [(3, docs[3][1]), (3, "w1 other"), (None, docs[5][1]), (None, None), (200, None), (201, ""), (202, ".,"), (203, "é 你好 w7-w8")]
    items = [(j, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for j in range(25)]
    items += [(30, docs[3][1]), (31, None), (32, ""), (33, "nowhere"), (None, "w7 w7 w9"), (34, "w1"), (34, "w2 w1"), (35, "É 你好 é")]
    table = spark.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id bigint, text string, rank string, score int").repartition(5)
    asked = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id bigint, text string, doc_id string")
    got = lexical_search.rank_documents(table, asked, cfg=cfg)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == rank_by_hand(docs, items, cfg.k)


def test_ranking_of_nothing_and_of_long_texts(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", "word " * 1_000_000 + "two")], "doc_id string, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert lexical_search.rank_documents(docs, none).count() == 0
    items = spark.createDataFrame([("x", "two"), ("y", "one word")], "item_id string, text string")
    assert lexical_search.rank_documents(docs.limit(0), items).count() == 0
    got = sorted(tuple(r) for r in lexical_search.rank_documents(docs, items).collect())
    rows = [("a", "one two"), ("b", "word " * 1_000_000 + "two")]
    scores = {(i, d): s for i, _, d, s in got}
    n_terms = 1_000_003
    for (item, doc), score in scores.items():
        bag = Counter(dict(rows)[doc].split())
        m = 25 + (75 * sum(bag.values()) * 2) // n_terms
        df = {"one": 1, "two": 2, "word": 1}
        assert score == sum(math.floor(1000 * math.log(6 / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in {"x": ["two"], "y": ["one", "word"]}[item] if bag[t])
    assert set(scores) == {("x", "a"), ("x", "b"), ("y", "a"), ("y", "b")}


# --- prefix trie ----------------------------------------------------------------------------------


def trie_by_hand(rows, head, base):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            token = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, token, role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in convs.items()}
    built = {c: own.get(base(c), [])[: head(c)] + turns[head(c) :] for c, turns in own.items()}
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for node, held in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = sum(1 for m in below if not any(x[: len(m)] == m and len(x) == len(m) + 1 for x in below))
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = ",".join(str(c) for c in held if len(built[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((held[0], len(node), parent, len(held), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def crc_head(c):
    return zlib.crc32(str(c).encode()) % 6


SMALL = prefix_trie.TrieConfig(finish=60, block=4, buckets=3, ids=2)
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, n_convs string"


def conversations(rng, n):
    rows = []
    for c in rng.sample(range(0, 420), n):
        for t in range(rng.randrange(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ja", "né", "", None])))
    rows += [(c, None, "user", "late") for c in (3, 7, 7, 200)]
    rows += [(5, 1, "user", "same")] * 3 + [(5, 1, "user", "other"), (None, 1, "user", "lost")]
    rows += [(100, t, "user", f"turn {t % 2}") for t in range(37)] + [(300, t, "user", f"turn {t % 2}") for t in range(41)]
    return rows


@pytest.mark.parametrize("cfg", [SMALL, prefix_trie.TrieConfig()])
def test_trie_equals_brute_force(spark, cfg):
    rows = conversations(random.Random(11), 60)
    turns = spark.createDataFrame([(*r, "d", "n") for r in rows], SCHEMA).repartition(6)
    conv = F.col("conv")
    got = prefix_trie.prefix_trie(turns, F.crc32(conv.cast("string").cast("binary")) % 6, conv - conv % 100, cfg=cfg)
    assert sorted([tuple(r) for r in got.collect()], key=str) == trie_by_hand(rows, crc_head, lambda c: c - c % 100)


def test_trie_without_rebuilding_and_of_few_rows(spark):
    rows = [(1, 1, "a", "x"), (2, 1, "a", "x"), (2, 2, "b", "yy"), (3, 1, "a", "x")]
    turns = spark.createDataFrame([(*r, "d", "n") for r in rows], SCHEMA)
    plain = prefix_trie.prefix_trie(turns)
    assert sorted([tuple(r) for r in plain.collect()], key=str) == trie_by_hand(rows, lambda c: 0, lambda c: c)
    assert prefix_trie.prefix_trie(turns.limit(0)).count() == 0
    # every conversation loses all its turns: the root alone is left
    bare = prefix_trie.prefix_trie(turns, F.lit(5), F.col("conv") * 0 - 1).collect()
    assert [tuple(r) for r in bare] == trie_by_hand(rows, lambda c: 5, lambda c: -1)
    long = spark.createDataFrame([(1, 1, "a", "x" * 5_000_000, "", ""), (2, 1, "a", "x" * 5_000_000, "", "")], SCHEMA)
    assert sorted((r.depth, r.n_convs, r.saved_tokens) for r in prefix_trie.prefix_trie(long).collect()) == [(0, 2, 5_000_000), (1, 2, 5_000_000)]


def test_list_ranking_and_running_sums_in_rounds(spark):
    rng = random.Random(13)
    order = rng.sample(range(1000), 700)
    arcs = spark.createDataFrame([(a, b) for a, b in zip(order, [*order[1:], None])], "a bigint, s bigint")
    got = {r.a: r.pos for r in prefix_trie.rank_list(arcs, order[0], finish=20).collect()}
    assert got == {a: i for i, a in enumerate(order)}
    values = [rng.randrange(9) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(values)), "at bigint, v bigint")
    sums = {r["at"]: r["v"] for r in prefix_trie.running_sums(rows, "at", ["v"], 4).collect()}
    assert sums == dict(enumerate(itertools.accumulate(values)))
