"""The corpus operators against brute force, and on nulls, empty texts, repeated rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from vector_atlas.llm import components, decontaminate, knn_quality, licenses, minmax, mixture, order_minhash, passages, perspectives, shards, textbuf, url_templates

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, size string, score string, shard string, key string, n string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, rows):
    """Documents from (doc_id, text[, source]), with columns whose names clash with the operators' own."""
    rows = [r if len(r) == 3 else (*r, "s") for r in rows]
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), "i", "z", "c", "h", "k", "n") for i, t, s in rows], SCHEMA)


MESSY = [
    (1, "Alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, " \t\n "), (5, "alpha beta gamma delta epsilon zeta"), (6, "one two"),
    (6, "one two"), (7, "wörter über straße 你好 𝄞 x"), (None, "alpha beta gamma delta epsilon zeta"), (None, None), (8, "word " * 3000), (9, "."),
]


def prose(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def test_words_and_shingles_equal_regular_expressions():
    import pyarrow as pa

    texts = ["Hello, World  a\tb", "", None, "é x", " lead", "trail ", "a b c d e f", "你好 𝄞"]
    powers = textbuf.Powers()
    for mask, pattern in ((textbuf.space_words(), SPACE), (textbuf.alnum_words(), ALNUM)):
        for size in (4, 1 << 20):
            for lo, data, offs in textbuf.chunks(pa.array(texts), size):
                words = textbuf.Words(data, offs, mask, powers)
                for i in range(len(offs) - 1):
                    a, b = words.offs[i], words.offs[i + 1]
                    got = [lower(bytes(data[s:e]).decode()) for s, e in zip(words.starts[a:b], words.ends[a:b])]
                    assert got == pattern.findall(lower(texts[lo + i]))


# --- near-duplicates ------------------------------------------------------------------------------


def near_by_hand(rows, percent=85):
    sets = {}
    for i, t, *_ in rows:
        w = SPACE.findall(lower(t))
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("small,block", [(12, 512), (0, 7), (1000, 512)])
def test_near_duplicates_equal_all_pairs(spark, small, block):
    rng = random.Random(3)
    rows, base = [], prose(rng, 120)
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(60, 80):
        rows.append((i, " ".join(prose(rng, rng.randrange(1, 60)))))
    rows += [(80, rows[70][1]), (81, rows[70][1].upper()), (82, ""), (83, None), (84, "one"), (85, "one"), (86, "a b c d"), (87, "a b c d")]
    cfg = minmax.MinMaxConfig(small=small, block=block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minmax.near_duplicates(table(spark, rows), cfg=cfg).collect()}
    assert got == near_by_hand(rows)


def test_near_duplicates_on_odd_rows(spark):
    found = minmax.near_duplicates(table(spark, MESSY)).collect()
    assert len(found) == len(MESSY)
    by = {r["doc_id"]: r for r in found}
    assert (by[5]["component_id"], by[5]["kept"]) == (1, False)
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0
    assert all(r["kept"] and r["component_id"] is None for r in found if r["doc_id"] is None)
    assert minmax.near_duplicates(table(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 299)]
    got = dict(components.settle(spark.createDataFrame(links, "src bigint, dst bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}


def test_components_of_a_long_shuffled_chain(spark):
    ids = list(range(2000))
    random.Random(22).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:])) + [(5000, 5000)], "src bigint, dst bigint")
    got = dict(components.settle(links).collect())
    assert got == {**{i: 0 for i in range(2000)}, 5000: 5000}


# --- shards ---------------------------------------------------------------------------------------


def test_shards_match_the_mixture(spark):
    rng = random.Random(1)
    rows = [(i, f"t{i}", rng.choice(["hot"] * 5 + ["a", "b", None])) for i in range(1600)]
    got = shards.shard_rows(table(spark, rows)).select("doc_id", "source", "shard", "slot").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1600))
    sizes, total = Counter(r["shard"] for r in got), Counter(r["source"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 16
    for s in range(16):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        for source, n in Counter(r["source"] for r in own).items():
            assert abs(n - total[source] / 16) <= 1


def test_shards_on_odd_rows(spark):
    got = shards.shard_rows(table(spark, MESSY), 5).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in MESSY)
    assert sorted(Counter(r["shard"] for r in got).values()) == [2, 2, 2, 3, 3]
    assert {(r["doc_id"], r["text"]) for r in got} == set(MESSY)
    assert shards.shard_rows(table(spark, [])).count() == 0


def test_many_sources_of_one_document_and_rows_without_ids(spark):
    rows = [(i, "t", f"s{i}") for i in range(300)] + [(None, "same", "x")] * 100
    placed = shards.shard_rows(table(spark, rows)).collect()
    assert len(placed) == 400 and Counter(r["shard"] for r in placed) == {s: 25 for s in range(16)}
    assert sorted((r["shard"], r["slot"]) for r in placed) == [(s, p) for s in range(16) for p in range(25)]
    # the hot source is spread like the whole, and the sources of one document lie in its middle
    assert max(Counter(r["shard"] for r in placed if r["source"] == "x").values()) <= 25
    assert shards.shard_rows(table(spark, [])).columns[-2:] == ["shard", "slot"]


# --- mixture --------------------------------------------------------------------------------------


def targets_by_hand(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = sum(sizes.values()), {}, set(names)
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share >= cap * sizes[s]}
        if not over:
            return {**out, **{s: weight[s] * share for s in free}}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixture_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(prose(rng, rng.randrange(1, 40))), rng.choice(["a"] * 9 + ["b", "c", "d", "é", None])) for i in range(900)]
    got = mixture.mix(table(spark, rows)).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    aim = targets_by_hand(sizes)
    assert {r["doc_id"]: r["size"] for r in got} == {i: len(SPACE.findall(t)) for i, t, _ in rows}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], aim[r["source"]])
    for source in sizes:
        assert abs(taken[source] - aim[source]) <= 20.5
        copies = {r["copies"] for r in got if r["source"] == source}
        assert max(copies) - min(copies) <= 1
    again = mixture.mix(table(spark, rows[::-1]).repartition(7)).select("doc_id", "copies").collect()
    assert {r["doc_id"]: r["copies"] for r in got} == dict(again)


def test_mixture_prefers_quality(spark):
    rows = [(i, "a b c d e f g h i j", "a") for i in range(400)] + [(i, "x", "b") for i in range(400, 3400)]
    docs = table(spark, rows)
    good = F.when(F.col("doc_id") % 2 == 0, 10.0).otherwise(0.1)
    # of two sources with weights 1 and 9, the first is cut to a part of itself
    got = mixture.mix(docs, weights=(1, 9), quality=good).where("source = 'a'").groupBy(F.col("doc_id") % 2).agg(F.sum("copies")).collect()
    share = dict(got)
    assert share[0] > 5 * share[1]


def test_mixture_on_odd_rows(spark):
    rows = [(*r, s) for r, s in zip(MESSY, ["a", "a", "b", None, "b", "a", "a", None, "a", "c", "c", "d"])]
    got = mixture.mix(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["target"] <= 3 * r["source_size"] for r in got)
    assert mixture.repeat(mixture.mix(table(spark, []))).count() == 0


def test_tied_rows_meet_the_target(spark):
    # 300 rows with no id and one text, and as many words of another source
    docs = table(spark, [(None, "one two three four", "a")] * 300 + [(i, "w " * 40, "b") for i in range(30)] + [(7, "same id", "c"), (7, "other text here", "c")])
    for seed in range(3):
        rows = mixture.mix(docs, seed=seed).collect()
        taken = Counter()
        for r in rows:
            taken[r["source"]] += r["size"] * r["copies"]
            assert r["copies"] <= 3
        aims = {r["source"]: r["target"] for r in rows}
        assert len(rows) == 332 and all(abs(taken[x] - aims[x]) <= 40 for x in "ab") and {r["copies"] for r in rows if r["source"] == "a"} in ({1, 2}, {2, 3}, {1}, {2}, {0, 1})


# --- decontamination ------------------------------------------------------------------------------


def leaks_by_hand(docs, items):
    windows = defaultdict(set)
    for item, text, *_ in items:
        w = ALNUM.findall(lower(text))
        for at in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[at : at + 10])].add(item)
    out = {}
    for i, text, *_ in docs:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit |= set(range(at, at + n))
                    found |= windows[tuple(w[at : at + n])]
        out[i] = (len(w), len(hit), sorted(str(x) for x in found))
    return out


@pytest.mark.parametrize("portion", [1_000_000, 20])
def test_decontamination_equals_all_windows(spark, portion):
    rng = random.Random(5)
    items = [(i, " ".join(prose(rng, n, 60))) for i, n in enumerate([30, 12, 10, 9, 3, 1, 0])] + [(7, None), (1, "extra Words, of item one"), (9, "W1 w1 w1 w1")]
    docs = []
    for i in range(60):
        words = prose(rng, rng.randrange(0, 80), 60)
        if i % 3 == 0:
            own = ALNUM.findall(items[i % len(items)][1] or "")
            words[5:5] = own[: rng.randrange(1, 31)]
        docs.append((i, " ".join(words).title() if i % 2 else ", ".join(words)))
    docs += [(100, None), (101, ""), (102, "w1 " * 50)]
    cfg = decontaminate.PhraseConfig(portion=portion)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.decontaminate(table(spark, docs), benchmark, cfg=cfg).collect()
    assert {r["id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in got} == leaks_by_hand(docs, items)


def test_proximity_matches(spark):
    rng = random.Random(6)
    item = [f"q{i}" for i in range(12)]
    near = item[:4] + ["inserted"] + item[4:]
    rows = [(1, " ".join(prose(rng, 30) + near + prose(rng, 30))), (2, " ".join(prose(rng, 60))), (3, " ".join(item))]
    got = {r["id"]: r for r in decontaminate.decontaminate(table(spark, rows), spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")).collect()}
    assert (got[1]["n_hit"], got[1]["near"]) == (0, ["7"]) and (got[2]["n_hit"], got[2]["near"]) == (0, []) and got[3]["items"] == ["7"]


def test_decontamination_on_odd_rows(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r["n_hit"] == 0 for r in decontaminate.decontaminate(table(spark, MESSY), none).collect())
    some = spark.createDataFrame([(None, "beta gamma"), (2, "beta gamma")], "item_id bigint, text string")
    got = decontaminate.decontaminate(table(spark, MESSY), some).collect()
    assert len(got) == len(MESSY) and sorted(map(tuple, (r["items"] for r in got if r["n_hit"]))) == [("", "2")] * 3
    assert decontaminate.decontaminate(table(spark, []), some).count() == 0


# --- quality --------------------------------------------------------------------------------------


def test_votes_tell_held_out_junk(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(w.upper() + "!!" if i % 4 == 0 else w for w in prose(rng, 50))) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(240)], "doc_id bigint, quality int").where(~knn_quality.held_out())
    got = knn_quality.score(table(spark, rows), labels).withColumn("held", knn_quality.held_out()).collect()
    assert {r["doc_id"]: r["held"] for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(240)}
    held = [r for r in got if r["held"]]
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 4 != 0) for r in held) >= 0.97 * len(held)
    assert {r["size"] for r in got} == {"z"} and all(0 <= r["score"] <= 1 for r in got)


def test_neighbours_are_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    cfg = knn_quality.VoteConfig(features=40, rank=8, neighbours=5)
    x, labels = rng.random((70, 43)).astype(np.float32), rng.random(70) > 0.5
    space = knn_quality.Space(x, labels, cfg)
    fresh = rng.random((9, 43)).astype(np.float32)
    v = space._unit((space._unit(fresh * space.idf) - space.mean) @ space.axes)
    for row, score in zip(v, space.scores(fresh, cfg)):
        cos = space.vectors @ row
        top = np.argsort(-cos)[:5]
        votes = np.maximum(cos[top].astype(float), 0) ** cfg.power
        assert math.isclose(score, (votes * labels[top]).sum() / votes.sum(), rel_tol=1e-5)


def test_votes_on_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (5, None), (None, 1), (8, 0)], "doc_id bigint, quality int")
    got = knn_quality.score(table(spark, MESSY), labels).collect()
    assert len(got) == len(MESSY) and all(r["score"] == 0.5 for r in got if not (r["text"] or ""))
    assert all(r["score"] == 0.5 for r in knn_quality.score(table(spark, MESSY), labels.limit(0)).collect())
    assert knn_quality.score(table(spark, []), labels).count() == 0


# --- licenses -------------------------------------------------------------------------------------


def test_license_phrases_and_fuzzy_notices(spark):
    rows = [
        (1, "Under the MIT License. mit\nlicense"), (2, "an Apache-License and the GNU General Public License"), (3, "Released under the MITT Licence today"),
        (4, "Permission is hereby granted free of charge to any person obtaning a copy"), (5, "emit licensed"), (6, "all rights rezerved"), (7, "plain prose only"),
    ]
    got = {r["id"]: r for r in licenses.scan_licenses(table(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 2, 4, "mit")
    assert got[2]["base_labels"] == "apache,gpl" and got[2]["score"] == 1.0
    assert (got[3]["base_labels"], got[3]["labels"]) == ("", "") or got[3]["labels"] == "mit"
    assert got[4]["labels"] == "mit" and 0.9 < got[4]["score"] < 1
    span = got[4]["spans"][0]
    assert lower(rows[3][1])[span["start"] : span["end"]] == lower(rows[3][1]) and span["edits"] == 3
    assert got[6]["labels"] == "reserved" and got[5]["labels"] == got[7]["labels"] == "" and got[7]["first_word"] is None


def test_seeds_miss_no_notice_within_its_errors():
    import regex

    rng = random.Random(4)
    scanner = licenses.Scanner()
    for text, label in licenses.NOTICES:
        pattern = regex.compile(f"(?b)(?<![a-z0-9])(?:{regex.escape(text)}){{e<={licenses.errors(len(text))}}}(?![a-z0-9])")
        for _ in range(15):
            chars = list(text)
            for _ in range(rng.randrange(licenses.errors(len(text)) + 2)):
                at = rng.randrange(len(chars))
                chars[at : at + rng.randrange(2)] = rng.choice(["", "z", "q"])
            doc = f"some words {''.join(chars)} more words"
            m = pattern.search(doc)
            words = iter(re.findall("[a-z0-9]+", m.group()) if m else ())
            if m and all(w in words for w in re.findall("[a-z0-9]+", text) if len(w) <= 3):
                assert label in {f[0] for f in scanner.scan(doc)}, doc


def test_notices_side_by_side_and_short_words():
    scanner = licenses.Scanner()
    for doc in ("mit licence, mit license", "mit licence. mit license.", "mit license mit license", "mit license. mit licence, mit lcense"):
        found = [f for f in scanner.scan(doc) if f[0] == "mit"]
        assert [doc[a:b].strip(" .,") for _, a, b, _, _ in found] == re.findall("mit l[a-z]+", doc)
    for doc in ("the it license", "a bit license", "it is a m license", "sit license mist license", "mit licenses are"):
        assert "mit" not in {f[0] for f in scanner.scan(doc) if doc[f[1] : f[2]].split()[0] != "mit"}
    long = "some prose goes on. " * 60_000 + "mit licence, apache license " + "and on. " * 500_000
    assert len(long) > 5_000_000 and [f[0] for f in scanner.scan(long)] == ["mit", "apache"]


def test_licenses_on_odd_rows(spark):
    got = licenses.scan_licenses(table(spark, MESSY)).collect()
    assert len(got) == len(MESSY) and all(r["labels"] == "" and r["score"] == 0 for r in got)
    assert {r["id"]: r["n_words"] for r in got}[7] == len(ALNUM.findall(lower(MESSY[7][1])))
    assert licenses.scan_licenses(table(spark, [])).count() == 0


# --- urls -----------------------------------------------------------------------------------------


def url_by_hand(url):
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls_rules_and_templates(spark):
    urls = [
        "http://Sub.Example.ORG/es/1?x", "https://example.org/en/12", "https://example.org/en/2", "http://a.com/fr/9", "http://a.com/de/9#f", "http://a.com/DE/9",
        "nonsense", None, "", "://", "http://x.net", "ftp://y.net?q=1/2", "http://u://v/w", "http://org/", "http://notexample.org/es/", "https://example.org",
    ]
    urls += [f"http://shop.net/item/{i}" for i in range(30)]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    got = {r["page_id"]: r for r in url_templates.judge_urls(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = url_by_hand(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        fits = [r for r in url_templates.RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith("/" + r[0].partition("/")[2])]
        best = max(fits, key=lambda r: len(r[0]), default=None)
        assert got[i]["rule"] == (best and best[0]) and got[i]["verdict"] in ("allow", "block")
        if best:
            assert got[i]["verdict"] == best[1]
    assert url_templates.judge_urls(pages.limit(0)).count() == 0


def test_templates_reject_what_resembles_blocked_paths(spark):
    rows = [(f"h.com", f"/de/{i}", 1, 1, 1) for i in range(20)] + [("h.com", f"/fr/{i}", 1, 0, 1) for i in range(20)] + [("h.com", "/en/{n}", 20, 0, 0), ("only.com", "/x", 5, 5, 5)]
    shapes = spark.createDataFrame(rows, "host string, shape string, n bigint, blocked bigint, labelled bigint")
    got = {(r["host"], r["shape"]): r for r in url_templates.template_rates(shapes).collect()}
    assert got["h.com", "/de/3"]["rate"] > 0.8 and got["h.com", "/fr/3"]["rate"] < 0.2
    assert got["h.com", "/de/3"]["template"] == "/de/*" and got["only.com", "/x"]["rate"] > 0.7
    many = [("s.net", f"/tag/slug{chr(97 + i % 26)}{chr(97 + i // 26)}", 1, 0, 0) for i in range(300)]
    found = url_templates.template_rates(spark.createDataFrame(many, "host string, shape string, n bigint, blocked bigint, labelled bigint")).select("template").distinct().collect()
    assert [r[0] for r in found] == ["/tag/*"]


def test_templates_do_not_depend_on_the_number_of_siblings(spark):
    for siblings in (47, 48, 400):
        # 10,000 urls of one host: 300 allowed, 150 blocked, the rest without labels
        rows = [("h.com", "/fr/a", 300, 0, 300), ("h.com", "/de/a", 150, 150, 150)]
        rows += [("h.com", f"/s{chr(97 + i % 26)}{chr(97 + i // 26)}/a", 9550 // siblings, 0, 0) for i in range(siblings + 1)]
        shapes = spark.createDataFrame(rows, "host string, shape string, n bigint, blocked bigint, labelled bigint")
        got = {r["shape"]: r for r in url_templates.template_rates(shapes).collect()}
        assert got["/de/a"]["template"] == "/de/a" and got["/de/a"]["rate"] > 0.9
        assert got["/saa/a"]["template"] == "/*/a" and got["/saa/a"]["rate"] < 0.4


def test_templates_tell_deep_paths_apart(spark):
    deep = "/a/b/c/d/e/f/g"
    rows = [("h.com", f"{deep}/{kind}/{x}", 10, 10 * bad, 10) for kind, bad in (("good", 0), ("bad", 1)) for x in ("p", "q", "r")]
    rows += [("one.com", "/" + "/".join("abcdefghijkl"), 3, 0, 3), ("one.com", "/", 1, 0, 0), ("none.com", "", 1, 0, 0)]
    shapes = spark.createDataFrame(rows, "host string, shape string, n bigint, blocked bigint, labelled bigint")
    got = {(r["host"], r["shape"]): (r["template"], r["rate"]) for r in url_templates.template_rates(shapes).collect()}
    assert len(got) == len(rows)
    assert got["h.com", f"{deep}/bad/p"][0] == f"{deep}/bad/*" and got["h.com", f"{deep}/bad/p"][1] > 0.8
    assert got["h.com", f"{deep}/good/p"][0] == f"{deep}/good/*" and got["h.com", f"{deep}/good/p"][1] < 0.2
    template, rate = got["one.com", "/a/b/c/d/e/f/g/h/i/j/k/l"]
    by_hand = (4 * (30 + 1) / (63 + 2)) / (3 + 4)  # the host's rate, then one smoothing per segment
    for _ in range(12):
        by_hand = 4 * by_hand / (3 + 4)
    assert template == "/a/b/c/d/e/f/g/h/i/j/k/l" and math.isclose(rate, by_hand)
    assert got["one.com", "/"][0] == got["none.com", ""][0] == ""


def templates_by_hand(rows, cfg=url_templates.TreeConfig()):
    """The same tree, one segment after the other, with plain loops."""
    base = (sum(r[3] for r in rows) + 1) / (sum(r[4] for r in rows) + 2)
    smooth = lambda b, n, parent: (b + cfg.smoothing * parent) / (n + cfg.smoothing)
    out = {}

    def differs(part, whole, p_part, p_whole):
        p = p_part / p_whole if p_whole else 0
        spread = whole * p * (1 - p)
        return spread > 0 and max(abs(part - whole * p) - 0.5, 0) ** 2 > cfg.critical * spread

    def visit(host, prefix, rate, members, level):
        for segments, r in members:
            if len(segments) == level:
                out[host, r[1]] = (prefix, rate)
        on = [(s, r) for s, r in members if len(s) > level]
        kids = defaultdict(list)
        for s, r in on:
            kids[s[level]].append((s, r))
        total = [sum(r[c] for _, r in on) for c in (2, 3, 4)] + [sum(r[2] for s, r in on if len(s) == level + 1)]
        named = defaultdict(list)
        for name, own in kids.items():
            n, blocked, labelled = (sum(r[c] for _, r in own) for c in (2, 3, 4))
            ends = sum(r[2] for s, r in own if len(s) == level + 1)
            alike = not differs(blocked, labelled, total[1], total[2]) and not differs(ends, n, total[3], total[0])
            named["*" if len(kids) > 1 and alike else name] += own
        for name, own in named.items():
            visit(host, f"{prefix}/{name}", smooth(sum(r[3] for _, r in own), sum(r[4] for _, r in own), rate), own, level + 1)

    for host in {r[0] for r in rows}:
        own = [([s for s in r[1].split("/") if s], r) for r in rows if r[0] == host]
        visit(host, "", smooth(sum(r[3] for _, r in own), sum(r[4] for _, r in own), base), own, 0)
    return out


def test_templates_equal_plain_loops(spark):
    rng = random.Random(17)
    rows = {}
    for _ in range(140):
        path = "/long/common/start" * (rng.random() < 0.3) + "".join(f"/{rng.choice('abcdxyz')}" for _ in range(rng.randrange(5))) + "/tail/of/it" * (rng.random() < 0.3)
        n = rng.randrange(1, 200)
        labelled = rng.randrange(n + 1) * rng.randrange(2)
        rows["h%d" % rng.randrange(3), path] = (n, int(labelled * (("/a" in path) * 0.9 + 0.05)), labelled)
    rows = [(h, p, n, b, k) for (h, p), (n, b, k) in rows.items()]
    rows += [("deep", "/" + "/".join(f"s{i}" for i in range(400)) + f"/{x}", 30, 30 * (x == "q"), 30) for x in "pq"]
    shapes = spark.createDataFrame(rows, "host string, shape string, n bigint, blocked bigint, labelled bigint")
    got = {(r["host"], r["shape"]): (r["template"], round(r["rate"], 9)) for r in url_templates.template_rates(shapes).collect()}
    assert got == {k: (t, round(x, 9)) for k, (t, x) in templates_by_hand(rows).items()}


# --- conversations --------------------------------------------------------------------------------


def test_each_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", "Yo"), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, 0, None, "x"), (3, None, "ann", "late"), (3, 1, "ann", "first")]
    turns = spark.createDataFrame([(*r, "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")
    got = {(r["conv_id"], r["perspective"]): r for r in perspectives.rotate(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "ann")}
    assert got[3, "ann"]["rendered"].index("late") < got[3, "ann"]["rendered"].index("first")
    ann = got[1, "ann"]
    assert ann["rendered"] == (
        "<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>assistant\nHi < |im_end|><|im_end|>\n<|im_start|>user name=bob\nYo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
    assert [ann["rendered"][m["start"] : m["end"]] for m in ann["masks"]] == ["Hi < |im_end|>", ""]
    bob = got[1, "bob"]
    assert [bob["rendered"][m["start"] : m["end"]] for m in bob["masks"]] == ["Yo"] and "user name=ann" in bob["rendered"]
    assert perspectives.rotate(turns.limit(0)).count() == 0


def test_long_conversations_are_whole_or_come_in_parts(spark):
    turns = spark.range(1000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'u', 'v') as role", "concat('t', id) as text")
    whole = {r["perspective"]: r for r in perspectives.rotate(turns.unionByName(turns.where("id < 3"))).collect()}
    assert {p: r["n_turns"] for p, r in whole.items()} == {"u": 1003, "v": 1003} and "part" not in whole["u"].asDict()
    assert [whole["v"]["rendered"][m["start"] : m["end"]] for m in whole["v"]["masks"]] == ["t1", "t1", *[f"t{i}" for i in range(3, 1000, 2)]]
    got = perspectives.rotate(turns, block=256).collect()
    assert Counter((r["perspective"], r["n_turns"]) for r in got) == {("u", 256): 3, ("v", 256): 3, ("u", 232): 1, ("v", 232): 1}
    own = [r["rendered"][m["start"] : m["end"]] for r in sorted(got, key=lambda r: r["part"]) if r["perspective"] == "v" for m in r["masks"]]
    assert own == [f"t{i}" for i in range(1, 1000, 2)]


# --- fingerprints ---------------------------------------------------------------------------------

_MASK = (1 << 64) - 1


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _hash(*values):
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else (v & _MASK).to_bytes(8, "little") if isinstance(v, int) else v.to_bytes(4, "little")
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def _hash_int(value, count):
    seed = xxhash.xxh64_intdigest((value & _MASK).to_bytes(8, "little"), 42)
    return xxhash.xxh64_intdigest((count & 0xFFFFFFFF).to_bytes(4, "little"), seed)


def order_by_hand(text, m=64, k=2):
    words = re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text or "")
    if not words:
        return []
    low = (1 << 24) - 1
    seen, entries = Counter(), []
    for i in range(max(1, len(words) - k + 1)):
        h = _signed((_hash(*words[i : i + k]) & ~low) & _MASK) >> 24
        n = seen[h]
        seen[h] += 1
        entries.append(((h if n == 0 else _signed((_hash_int(h, n) & ~low) & _MASK) >> 24), i))
    entries.sort()
    out = []
    for j in range(m):
        start = (j * ((1 << 64) // m) - (1 << 63))
        at = sum(((h << 24) | p) < start for h, p in entries)
        pair = sorted((entries[(at + t) % len(entries)] for t in (0, 1)), key=lambda e: e[1])
        out.append(xxhash.xxh64_intdigest((pair[1][0] & _MASK).to_bytes(8, "little"), xxhash.xxh64_intdigest((pair[0][0] & _MASK).to_bytes(8, "little"), 42)) & 0xFFFFFFFF)
    return out


def test_signatures_equal_sorting_by_hand(spark):
    rng = random.Random(9)
    texts = [" ".join(prose(rng, n, size)) for n, size in ((1, 9), (2, 9), (3, 9), (50, 5), (300, 40), (200, 4000))] + ["", None, "a a a a a a a", "x" * 100, "a\nb\tc", "word " * 500]
    docs = table(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["sig"] for r in order_minhash.with_signature(docs, "text", "sig").collect()}
    assert {i: list(s) for i, s in got.items()} == {i: order_by_hand(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("rows_per_bucket", [250, 3])
def test_edited_texts_take_the_next_document(spark, rows_per_bucket):
    rng = random.Random(10)
    rows = [(i * 7, " ".join(prose(rng, rng.randrange(0, 30)))) for i in range(40)] + [(3, None), (4, "𝄞é" * 9), (5, "x")]
    cfg = order_minhash.OrderConfig(bucket_rows=rows_per_bucket)
    got = {r["doc_id"]: r for r in order_minhash.fingerprint_edits(table(spark, rows), cfg=cfg).collect()}
    down = sorted(rows, reverse=True)
    for at, (i, t) in enumerate(down):
        t, following = t or "", down[(at + 1) % len(down)][1] or ""
        half = len(t) // 2
        assert got[i]["edited"] == t[: len(t) - half] + following[:half]
        assert list(got[i]["next_signature"]) == order_by_hand(following) and list(got[i]["edited_signature"]) == order_by_hand(got[i]["edited"])
    assert order_minhash.fingerprint_edits(table(spark, [])).count() == 0
    assert len(order_minhash.fingerprint_edits(table(spark, MESSY)).collect()) == len(MESSY)


def test_order_counts(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words[::-1]), " ".join(words[100:] + words[:100]), " ".join(words[:190] + ["new"] * 3 + words[190:])]
    rows = order_minhash.with_signature(table(spark, list(enumerate(texts))), "text", "sig").select("doc_id", "sig")
    a = rows.where("doc_id = 0").select(F.col("sig").alias("a"))
    near = {r[0]: r[1] for r in rows.crossJoin(a).select("doc_id", order_minhash.likeness(F.col("sig"), F.col("a"))).collect()}
    assert near[0] == 1 and near[1] < 0.05 and near[3] > 0.85 and near[2] < near[3]


# --- passages -------------------------------------------------------------------------------------


def test_planted_passages_are_found_and_nothing_else(spark):
    rng = random.Random(12)
    docs = [prose(rng, rng.randrange(60, 300), 10**6) for _ in range(60)]
    passage, other = prose(rng, 52, 10**6), prose(rng, 90, 10**6)
    line = prose(rng, 12, 10**6)
    planted = set(range(0, 20))
    for i in range(20):
        docs[i][10:10] = passage
    fuzzy = {30, 31}
    docs[30][20:20] = other
    edited = list(other)
    for at in (20, 45, 70):
        edited[at] = "changed"
    del edited[60]
    docs[31][5:5] = edited
    for i in range(40, 60):
        docs[i][3:3] = line  # a common line is no passage
    got = passages.repeated_passages(table(spark, [(i, " ".join(w)) for i, w in enumerate(docs)])).collect()
    assert {r["doc_id"] for r in got} | {r["other_doc_id"] for r in got} == planted | fuzzy
    for r in got:
        mine, theirs = docs[r["doc_id"]][r["start_word"] : r["end_word"]], docs[r["other_doc_id"]][r["other_start"] : r["other_end"]]
        if r["identity"] == 1:
            assert mine == theirs == passage
        else:
            assert r["doc_id"] == 31 and r["equal_words"] == 86


def test_partial_holders_hide_no_passage(spark):
    """Each seed of a passage also lies in documents with lower and higher ids that hold parts of it only."""
    rng = random.Random(31)
    passage = prose(rng, 80, 10**6)
    for copies in (1, 9):  # few and many documents per seed
        docs = [prose(rng, 60, 10**6) for _ in range(4 * copies + 2)]
        for i in range(copies):
            docs[i] += passage[:40]
            docs[copies + i] += passage[35:]
            docs[2 * copies + 2 + i] += passage[:40]
            docs[3 * copies + 2 + i] += passage[35:]
        whole = {2 * copies, 2 * copies + 1}
        for i in whole:
            docs[i] = docs[i][:20] + passage + docs[i][20:]
        got = passages.repeated_passages(table(spark, [(i, " ".join(w)) for i, w in enumerate(docs)])).collect()
        assert whole <= {r["doc_id"] for r in got} | {r["other_doc_id"] for r in got}
        assert any({r["doc_id"], r["other_doc_id"]} == whole and r["equal_words"] >= 80 for r in got)


def test_recall_of_edited_passages(spark):
    """Pairs that share a passage of which every so manieth word was changed, dropped or doubled."""
    rng = random.Random(32)
    docs, wanted = [], {}
    for identity in (0.8, 0.85, 0.9, 0.95):
        for _ in range(40):
            passage = prose(rng, rng.randrange(70, 140), 10**6)
            edited = []
            for w in passage:
                kind = rng.random()
                edited += [w] if kind >= 1 - identity else [["new%d" % rng.randrange(10**6)], [], [w, w]][rng.randrange(3)]
            at = len(docs)
            docs += [prose(rng, 80, 10**6) + passage + prose(rng, 40, 10**6), prose(rng, 30, 10**6) + edited + prose(rng, 90, 10**6)]
            wanted.setdefault(identity, set()).add((at + 1, at))
    got = passages.repeated_passages(table(spark, [(i, " ".join(w)) for i, w in enumerate(docs)])).collect()
    found = {(r["doc_id"], r["other_doc_id"]) for r in got}
    recall = {i: len(pairs & found) / len(pairs) for i, pairs in wanted.items()}
    print(recall)
    assert found <= set().union(*wanted.values())
    assert recall[0.95] >= 0.97 and recall[0.9] >= 0.95 and recall[0.85] >= 0.9 and recall[0.8] >= 0.8, recall


def test_members_of_a_large_group_that_resemble_neither_end_are_linked(spark):
    """Every seed of the passage is held by more than ``few`` documents, whose first and last hold parts of it only."""
    rng = random.Random(33)
    passage = prose(rng, 90, 10**6)
    parts = [passage[a : a + 36] for a in (0, 18, 36, 54)]
    docs = [prose(rng, 60, 10**6) + parts[i % 4] + prose(rng, 60, 10**6) for i in range(32)]
    whole = {}
    for shift in (11, 17, 23):  # different texts: other words of the passage are changed, none has a long seed of another
        edited = [w if at % 24 != shift else "own%d" % (100 * shift + at) for at, w in enumerate(passage)]
        whole[len(docs) // 2 + len(whole)] = prose(rng, 30, 10**6) + edited + prose(rng, 40, 10**6)
    docs = docs[:16] + list(whole.values()) + docs[16:]
    got = passages.repeated_passages(table(spark, [(i, " ".join(w)) for i, w in enumerate(docs)])).collect()
    pairs = {(r["doc_id"], r["other_doc_id"]) for r in got if r["equal_words"] >= 75}
    assert {(17, 16), (18, 16), (18, 17)} <= pairs


def test_every_open_place_of_a_frequent_seed_is_compared(spark):
    """A line lies in more places than a block holds; two documents say it alone at first, then within a passage of which
    every fifth word is changed, so that no other seed leads to it. The first and the last document hold the line only."""
    rng = random.Random(34)
    line, before, behind = prose(rng, 12, 10**6), prose(rng, 30, 10**6), prose(rng, 30, 10**6)

    def edited(words, shift, first):
        return [w if at % 5 != first else "own%d" % (1000 * shift + at) for at, w in enumerate(words)]

    docs = [[w for _ in range(12) for w in prose(rng, rng.randrange(60, 90), 10**6) + line] + prose(rng, 60, 10**6) for _ in range(14)]
    for i in (5, 8):
        docs[i] += edited(before, 2 * i, 4) + line + edited(behind, 2 * i + 1, 0) + prose(rng, 10, 10**6)
    rows = table(spark, [(i, " ".join(w)) for i, w in enumerate(docs)])
    got = passages.repeated_passages(rows, cfg=passages.PassageConfig(block=8)).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} == {(8, 5)}
    assert all(r["start_word"] >= 924 and r["other_start"] >= 924 and r["equal_words"] >= 55 for r in got)


def test_places_with_equal_surroundings_stand_for_each_other(spark):
    """Documents that say a line again and again, in more places than a block holds: each is in a row, and what is
    compared does not grow with the square of the places."""
    from pyspark.sql import functions as F

    rng = random.Random(35)
    line = prose(rng, 6, 10**6)
    docs = [prose(rng, 40, 10**6) + line * 40 + prose(rng, 40, 10**6) for _ in range(12)]
    cfg = passages.PassageConfig(block=64)
    rows = table(spark, [(i, " ".join(w)) for i, w in enumerate(docs)])
    got = passages.repeated_passages(rows, cfg=cfg).collect()
    assert {r["doc_id"] for r in got} | {r["other_doc_id"] for r in got} == set(range(12))
    hits = passages._held(passages.seeds(rows, "doc_id", "text", cfg)).where("not long")
    places = hits.select("id", passages._place()).groupBy("id").agg(F.collect_set("q").alias("at"))
    seen = passages._surroundings(rows, places, "doc_id", "text", cfg).distinct()
    met, alike = passages._kinds(seen, cfg)
    n = seen.count()
    assert n >= 450 and met.count() < n / 2
    assert {r["id"] for r in alike.collect()} == set(range(1, 12))


def test_chains_equal_quadratic_programming():
    import numpy as np

    rng = random.Random(13)
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 14)):
            q, t, n = rng.randrange(200), rng.randrange(200), rng.randrange(5, 30)
            parts.append((q, q + n, q - t, n))
        parts = np.array(sorted(parts), dtype=np.int64)
        best = []
        for i, (q0, _, d, n) in enumerate(parts.tolist()):
            gains = [best[j] - 0.25 * (q0 - b1 + q0 - d - (b1 - bd)) for j, (_, b1, bd, _) in enumerate(parts[:i].tolist()) if b1 <= q0 and b1 - bd <= q0 - d]
            best.append(n + max([0, *gains]))
        first = passages.chains(parts, 0.25)[0]
        own = parts[first].tolist()
        score = own[0][3] + sum(y[3] - 0.25 * (y[0] - x[1] + (y[0] - y[2]) - (x[1] - x[2])) for x, y in zip(own, own[1:]))
        assert math.isclose(score, max(best))
        assert sorted(i for c in passages.chains(parts, 0.25) for i in c) == list(range(len(parts)))


def test_common_subsequences():
    import numpy as np

    rng = random.Random(14)
    for _ in range(30):
        x, y = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        row = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                row[i + 1][j + 1] = row[i][j] + 1 if a == b else max(row[i][j + 1], row[i + 1][j])
        assert passages._common(np.array(x, dtype=int), np.array(y, dtype=int)) == row[-1][-1]


def test_batches_of_chains_are_aligned_as_one_by_one(monkeypatch):
    """All rows at once, against a loop over words; gaps are compared only where the passage may be good enough."""
    import numpy as np

    def extend(same):
        total = best = n = 0
        for i, good in enumerate(same):
            total += 1 if good else -2
            if total > best:
                best, n = total, i + 1
            if best - total > 8:
                break
        return n, sum(same[:n])

    rng, compared, plain = random.Random(41), [], passages._common
    monkeypatch.setattr(passages, "_common", lambda x, y: compared.append(1) or plain(x, y))
    xs, ys, chains, want = [], [], [], {}
    gaps_of_all = 0
    for row in range(300):
        x = [rng.randrange(1, 10**6) for _ in range(rng.randrange(60, 120))]
        y = [w if rng.random() > (0.05 if row % 3 else 0.6) else rng.randrange(1, 10**6) for w in x]
        shift = rng.randrange(4)
        y[50:50] = [7] * shift
        parts = np.array([(20, 30, 0), (38, 45, 0), (52, 58, -shift)][: rng.randrange(1, 4)])
        q0, q1, d = parts[0].tolist()
        more, good = extend([x[q0 - 1 - i] == y[q0 - d - 1 - i] for i in range(min(q0, q0 - d))])
        from_x, from_y, equal = q0 - more, q0 - d - more, good
        for a, b, e in parts.tolist():
            if a != q0:
                equal, gaps_of_all = equal + plain(np.array(x[q1:a]), np.array(y[q1 - d : a - e])), gaps_of_all + 1
            equal += sum(x[i] == y[i - e] for i in range(a, b))
            q1, d = b, e
        more, good = extend([u == v for u, v in zip(x[q1:], y[q1 - d :])])
        q1, t1, equal = q1 + more, q1 - d + more, equal + good
        if min(q1 - from_x, t1 - from_y) >= 50 and equal >= 0.8 * max(q1 - from_x, t1 - from_y):
            want[row] = [from_x, q1, from_y, t1, equal]
        for all_rows, one in ((xs, x), (ys, y), (chains, parts)):
            all_rows.append(one)
    offs = lambda rows: np.cumsum([0, *map(len, rows)])
    rows, found = passages.align(np.concatenate(xs), offs(xs), np.concatenate(ys), offs(ys), np.concatenate(chains), offs(chains), 50, 0.8)
    assert dict(zip(rows.tolist(), found.tolist())) == want and 50 < len(want) < 250
    assert 0 < len(compared) < 0.9 * gaps_of_all


def test_first_minima():
    import numpy as np

    x = np.random.default_rng(5).integers(0, 40, 500).astype(np.uint64)
    for window in (1, 2, 8, 21):
        views = np.lib.stride_tricks.sliding_window_view(x, window)
        assert (passages._first_minima(x, window) == np.arange(len(views)) + views.argmin(axis=1)).all()


def test_passages_on_odd_rows(spark):
    rows = MESSY + [(20, "word " * 3000), (21, " ".join(f"u{i}" for i in range(80))), (21, " ".join(f"u{i}" for i in range(80)))]
    got = passages.repeated_passages(table(spark, rows)).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} <= {(20, 8)}
    assert passages.repeated_passages(table(spark, [])).count() == 0
