"""The stages of the pipeline on small tables, each held against brute force."""

import random
from collections import Counter

import corpus_pipeline as pipeline
from tests.llm.test_corpus import MESSY, leaks_by_hand, near_by_hand, prose


def stored(spark, tmp_path, docs, items=((1, "never seen words anywhere"),), labels=((1, 1), (5, 1), (8, 0))):
    path = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet")


def row(i, text, source="s"):
    return i, text, "en", source, len(text or "")


def corpus():
    rng = random.Random(21)
    rows = [row(i, " ".join(prose(rng, rng.randrange(20, 90))), rng.choice("abc")) for i in range(200)]
    for i in range(0, 40, 4):
        rows[i + 1] = row(i + 1, rows[i][1] + " tail", "a")
    item = " ".join(prose(rng, 15))
    for i in range(100, 110):
        rows[i] = row(i, f"{rows[i][1]} {item}", "b")
    for i in range(150, 190):
        rows[i] = row(i, " ".join(w.upper() + "!!" for w in prose(rng, 40)), "c")
    return rows, [(5, item)]


def test_each_stage_takes_effect(spark, tmp_path):
    rows, items = corpus()
    labels = [(i, 0 if 150 <= i < 190 else 1) for i in range(200)]
    path, docs = stored(spark, tmp_path, rows, items, labels)
    stages = dict(pipeline.STAGES)
    good = pipeline.materialise(stages["quality"](spark, docs, path), "t")
    kept = {r["doc_id"] for r in good.collect()}
    assert len(kept & set(range(150, 190))) <= 2 and len(set(range(150)) - kept) <= 2
    single = stages["near_dedup"](spark, docs, path)
    alone = {i for i, (_, c) in near_by_hand([r[:2] for r in rows]).items() if i == c}
    assert {r["doc_id"] for r in single.collect()} == alone and single.columns == docs.columns
    clean = {r["doc_id"] for r in stages["decontaminate"](spark, docs, path).collect()}
    assert clean == {i for i, (_, hit, _) in leaks_by_hand([r[:2] for r in rows], items).items() if not hit}
    mixed = Counter(r["doc_id"] for r in stages["mix"](spark, docs, path).collect())
    assert set(mixed) <= set(range(200)) and max(mixed.values()) <= 3
    dealt = stages["shard"](spark, docs, path).collect()
    assert Counter(r["shard"] for r in dealt) == {s: 13 if s % 2 == 0 else 12 for s in range(16)} and len({r["doc_id"] for r in dealt}) == 200


def test_near_dedup_links_from_four_fifths_on(spark, tmp_path):
    rng = random.Random(23)
    base = prose(rng, 94, 10**6)
    # 90 shingles; one changed word in the middle leaves 85 of 95, two leave 80 of 100, three 75 of 105
    rows, keep = [], set()
    for i, changes in enumerate((0, 2, 3)):
        words = [f"{w}x{i // 2}" for w in base]
        for at in range(changes):
            words[20 + 20 * at] = f"new{i}"
        rows.append(row(i, " ".join(words)))
    rows.append(row(3, " ".join(f"{w}x1" for w in base)))
    path, docs = stored(spark, tmp_path, rows)
    got = {r["doc_id"] for r in dict(pipeline.STAGES)["near_dedup"](spark, docs, path).collect()}
    assert got == {i for i, (_, c) in near_by_hand([r[:2] for r in rows], 80).items() if i == c} == {0, 2, 3}
    assert {i for i, (_, c) in near_by_hand([r[:2] for r in rows]).items() if i == c} == {0, 1, 2, 3}


def test_run_is_the_stages_one_after_the_other(spark, tmp_path):
    rows, items = corpus()
    path, docs = stored(spark, tmp_path, rows, items, [(i, 0 if 150 <= i < 190 else 1) for i in range(200)])
    got = sorted(map(tuple, pipeline.run(spark, path).collect()))
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialise(stage(spark, docs, path), name)
    assert got == sorted(map(tuple, docs.collect())) and len(got) > 100
    assert not {r[0] for r in got} & set(range(100, 110))


def test_stages_on_odd_rows(spark, tmp_path):
    path, docs = stored(spark, tmp_path, [row(i, t) for i, t in MESSY], [(1, "alpha beta"), (None, None)])
    stages = dict(pipeline.STAGES)
    single = Counter(r["doc_id"] for r in stages["near_dedup"](spark, docs, path).collect())
    assert single[1] == 1 and single[5] == 0 and single[6] == 1 and single[None] == 1
    clean = stages["decontaminate"](spark, docs, path).collect()
    assert {r["doc_id"] for r in clean} == {2, 3, 4, 6, 7, 8, 9, None} and [r["text"] for r in clean if r["doc_id"] is None] == [None]
    assert len(stages["shard"](spark, docs, path).collect()) == len(MESSY)
    assert pipeline.run(spark, path).count() >= 1


def test_rows_without_ids_are_no_other_rows(spark, tmp_path):
    """A null text hashes to 42 in Spark, a text id is no number: keys must not come from either."""
    plain = [row(42, "alpha beta gamma delta epsilon zeta"), row(7, "some quite different words stand here"), row(None, None), row(None, "alpha beta gamma delta epsilon zeta"), row(7, "seven again with other words"), row(7, "seven again with other words")]
    path, docs = stored(spark, tmp_path / "a", plain, [(1, "some quite different")])
    stages = dict(pipeline.STAGES)
    single = sorted(((r["doc_id"], r["text"]) for r in stages["near_dedup"](spark, docs, path).collect()), key=str)
    assert single == sorted([(42, plain[0][1]), (7, plain[1][1]), (None, None), (7, plain[4][1])], key=str)
    clean = sorted(((r["doc_id"], r["text"]) for r in stages["decontaminate"](spark, docs, path).collect()), key=str)
    assert clean == sorted(((r[0], r[1]) for i, r in enumerate(plain) if i != 1), key=str)
    named = docs.withColumn("doc_id", pipeline.F.concat(pipeline.F.lit("doc "), pipeline.F.col("doc_id").cast("string")))
    assert {r["doc_id"] for r in stages["near_dedup"](spark, named, path).collect()} == {"doc 42", "doc 7", None}
    many = [row(None, "same words for all") for _ in range(60)] + [row(i, f"text number {i} of b", "b") for i in range(12)]
    path, docs = stored(spark, tmp_path / "b", many)
    mixed = Counter(r["source"] for r in stages["mix"](spark, docs, path).collect())
    # 300 words by 5 to 2, of which the first source can give 180
    assert mixed == {"b": 36, "s": 30}


def test_empty_corpus(spark, tmp_path):
    path, _ = stored(spark, tmp_path, [], [], [])
    assert pipeline.run(spark, path).count() == 0
