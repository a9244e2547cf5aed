"""Ranked lexical search with NRA (no random access) over impact-sorted postings.

``build_index`` writes one row per block of documents: for each term the documents that hold it, by
falling impact (the term's part of a document's score before its weight). ``search`` reads every block
where it lies. For each query it reads the lists of the query's terms from the front, all to the same
depth, and keeps for every document an interval: the sum of what was read of it, and that plus the last
impact read of each list in which it was not met. A block is done with a query when no document, met or
not, with an upper end at the ``k``-th lower end or above has an open interval: then membership, ties
and scores are final. The best of the blocks before raise that bar. Each task gives out at most ``k``
rows per query, and the best of those are the result.

Queries are broadcast in portions of at most ``portion`` terms. Scores are whole numbers, so they are
the same in any order of blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vector_atlas.llm import textbuf
from vector_atlas.llm.tables import map_batches
from vector_atlas.session import materialise


@dataclass(frozen=True)
class RankConfig:
    k: int = 10
    length_share: int = 75  # how much of 100 parts a document's length counts
    saturation: int = 8
    portion: int = 1_000_000  # query terms searched (and broadcast) at a time
    depth: int = 64  # postings read of each list at first; doubled until the query is resolved
    block_bytes: int = 1 << 20  # text in one block of the index


class Queries:
    """A portion of the queries: their vocabulary of term hashes, and each query's terms with repeats."""

    def __init__(self, items: list[tuple], pieces_of: int):
        import pyarrow as pa

        powers, word_bytes = textbuf.Powers(), textbuf.alnum_words()
        own: dict = {}
        for lo, data, offs in textbuf.pieces(pa.array([text for _, text in items], pa.large_string()), word_bytes, pieces_of):
            words = textbuf.Words(data, offs, word_bytes, powers)
            for d in range(len(offs) - 1):
                own.setdefault(items[lo + d][0], []).append(words.hashes[words.offs[d] : words.offs[d + 1]])
        self.names = list(own)
        hashes = [np.concatenate(parts) for parts in own.values()]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        counted = [np.unique(np.searchsorted(self.vocabulary, h), return_counts=True) for h in hashes]
        self.terms = [t for t, _ in counted]
        self.repeats = [n for _, n in counted]
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, n_docs: int, found: dict[int, int]) -> None:
        """Weights from the number of documents and of documents per term; terms of weight 0 are dropped."""
        for term, df in found.items():
            self.weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        for q, (terms, repeats) in enumerate(zip(self.terms, self.repeats)):
            keep = self.weights[terms] > 0
            self.terms[q], self.repeats[q] = terms[keep], repeats[keep]


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indices of the ranges [first, first + count), one range after the other."""
    before = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return np.repeat(first - before, counts) + np.arange(int(counts.sum()))


def _count_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary: np.ndarray | None, cfg: RankConfig) -> DataFrame:
    """A written table ``ids, sizes, n_docs, n_terms, terms, docs, tf``, a row per block: occurrences per
    document and term, sorted by term; only terms of ``vocabulary``, unless it is None."""
    import pyarrow as pa

    shared = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        return textbuf.Powers(), textbuf.alnum_words()

    def step(state, batch):
        powers, word_bytes = state
        held = None  # the counts of a long document whose pieces are not yet all read
        for lo, data, offs in textbuf.pieces(batch.column(1), word_bytes, cfg.block_bytes):
            words = textbuf.Words(data, offs, word_bytes, powers)
            sizes = np.diff(words.offs)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            hashes = words.hashes
            if shared is not None:
                at = np.searchsorted(shared.value, hashes)
                at[at == len(shared.value)] = 0
                known = shared.value[at] == hashes if len(shared.value) else np.zeros(len(hashes), bool)
                hashes, doc = hashes[known], doc[known]
            order = np.lexsort((doc, hashes))
            hashes, doc = hashes[order], doc[order]
            new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))) if len(hashes) else np.zeros(0, np.int64)
            tf = np.diff(np.append(new, len(hashes)))
            now = [lo, sizes, hashes[new], doc[new], tf]
            if held is not None and held[0] == lo:
                terms, back = np.unique(np.concatenate((held[2], now[2])), return_inverse=True)
                tf = np.bincount(back, weights=np.concatenate((held[4], tf)), minlength=len(terms)).astype(np.int64)
                held = [lo, held[1] + sizes, terms, np.zeros(len(terms), np.int64), tf]
                continue
            if held is not None:
                yield block(batch, *held)
            held = now
        if held is not None:
            yield block(batch, *held)

    def block(batch, lo, sizes, terms, doc, tf):
        bounds = pa.array([0, len(sizes)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(bounds, batch.column(0).slice(lo, len(sizes))), pa.ListArray.from_arrays(bounds, pa.array(sizes, pa.int64())),
                pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]),
                pa.array([terms.tobytes()], pa.binary()), pa.array([doc.astype("<u4").tobytes()], pa.binary()), pa.array([tf.astype("<u4").tobytes()], pa.binary()),
            ],
            names=["ids", "sizes", "n_docs", "n_terms", "terms", "docs", "tf"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"ids array<{kind}>, sizes array<bigint>, n_docs bigint, n_terms bigint, terms binary, docs binary, tf binary"
    return materialise(map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), schema, start, step), "terms")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: np.ndarray | None = None, cfg: RankConfig = RankConfig()) -> tuple[DataFrame, int]:
    """The index as a scan of a written table ``ids, terms, docs, impacts``, and the number of documents
    with a term. Every document is indexed; ``vocabulary`` (sorted hashes) restricts the stored terms to
    those of known queries. Impacts need the corpus' mean length, so they are set in a second pass."""
    import pyarrow as pa

    counted = _count_terms(docs, id_col, text_col, vocabulary, cfg)
    n_docs, n_terms = (int(x or 0) for x in counted.agg(F.sum("n_docs"), F.sum("n_terms")).first())

    def step(_, batch):
        sizes = [np.asarray(s.values, dtype=np.int64) for s in batch.column(1)]
        first = np.concatenate(([0], np.cumsum([len(s) for s in sizes])))
        every = np.concatenate(sizes)
        m = (100 - cfg.length_share) + (cfg.length_share * every * n_docs) // max(n_terms, 1)
        terms, doc, tf = (
            [np.frombuffer(x.as_buffer(), kind) for x in batch.column(c)] for c, kind in ((2, "<u8"), (3, "<u4"), (4, "<u4")))
        doc = np.concatenate([d.astype(np.int64) + f for d, f in zip(doc, first)])
        terms, tf = np.concatenate(terms), np.concatenate(tf).astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + cfg.saturation * m[doc])
        order = np.lexsort((-impact, terms))
        yield pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), batch.column(0).flatten()),
                pa.array([terms[order].tobytes()], pa.binary()), pa.array([doc[order].astype("<u4").tobytes()], pa.binary()),
                pa.array([impact[order].astype("<u4").tobytes()], pa.binary()),
            ],
            names=["ids", "terms", "docs", "impacts"],
        )

    schema = f"ids {counted.schema['ids'].dataType.simpleString()}, terms binary, docs binary, impacts binary"
    index = map_batches(counted.select("ids", "sizes", "terms", "docs", "tf"), schema, lambda: None, step)
    return materialise(index, "impacts"), n_docs


class Block:
    """One row of the index, with the list of each term of the queries."""

    def __init__(self, ids, terms, docs, impacts, vocabulary):
        import pyarrow.compute as pc

        terms = np.frombuffer(terms, "<u8")
        self.docs, self.impacts = np.frombuffer(docs, "<u4").astype(np.int64), np.frombuffer(impacts, "<u4").astype(np.int64)
        self.first = np.searchsorted(terms, vocabulary)
        self.counts = np.searchsorted(terms, vocabulary, side="right") - self.first
        self.ids, self.n = ids, len(ids)
        self.id_rank = np.empty(self.n, np.int64)
        self.id_rank[pc.array_sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(self.n)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, scores: list[int], depth: int):
        """Places and scores of the block's documents that are among the ``k`` best; ``scores`` are those
        of the best documents elsewhere, falling."""
        held = self.counts[terms] > 0
        first, counts, weights = self.first[terms[held]], self.counts[terms[held]], weights[held]
        bar = max(1, scores[k - 1]) if len(scores) >= k else 1
        last = weights * self.impacts[first] if len(first) else weights
        if last.sum() < bar:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lower = np.zeros(self.n, np.int64)
        met_docs, met_lists = [], []
        read = 0
        while True:
            upto = np.minimum(counts, depth)
            now = np.maximum(upto - read, 0)
            at, lists = _ranges(first + np.minimum(read, counts), now), np.repeat(np.arange(len(first)), now)
            docs = self.docs[at]
            # sums stay far below 2**53, so they are exact
            lower += np.bincount(docs, weights=weights[lists] * self.impacts[at], minlength=self.n).astype(np.int64)
            met_docs.append(docs)
            met_lists.append(lists)
            read, depth = depth, depth * 2
            last = np.where(upto < counts, weights * self.impacts[first + upto - 1], 0)
            rivals = np.concatenate((lower[lower > 0], np.array(scores, np.int64)))
            if len(rivals) >= k:
                bar = max(bar, int(np.partition(rivals, len(rivals) - k)[len(rivals) - k]))
            unmet = int(last.sum())
            if unmet == 0:
                break
            if unmet < bar:
                open_part = unmet - np.bincount(np.concatenate(met_docs), weights=last[np.concatenate(met_lists)], minlength=self.n).astype(np.int64)
                if not ((open_part > 0) & (lower + open_part >= bar)).any():
                    break
        # a document below the bar may still have an open interval, but not one that reaches the bar
        places = np.flatnonzero(lower >= bar)
        places = places[np.lexsort((self.id_rank[places], -lower[places]))][:k]
        return places, lower[places]


def _search_portion(index: DataFrame, n_docs: int, queries: Queries, cfg: RankConfig, kind: str) -> DataFrame:
    """``query, id, score``: the best of each task."""
    import pyarrow as pa

    context = index.sparkSession.sparkContext
    vocabulary = context.broadcast(queries.vocabulary)

    def count(batches):
        total = np.zeros(len(vocabulary.value), np.int64)
        for batch in batches:
            for terms in batch.column(0):
                terms = np.frombuffer(terms.as_buffer(), "<u8")
                total += np.searchsorted(terms, vocabulary.value, side="right") - np.searchsorted(terms, vocabulary.value)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["term", "n"])

    # at most one row per term of the portion
    found = index.select("terms").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    queries.weigh(n_docs, {r["term"]: r["n"] for r in found})
    shared = context.broadcast(queries)

    def run(batches):
        queries, k = shared.value, cfg.k
        best: list[list] = [[] for _ in queries.names]  # (-score, id is null, id), ascending
        for batch in batches:
            for r in range(batch.num_rows):
                block = Block(batch.column(0)[r].values, *(batch.column(c)[r].as_buffer() for c in (1, 2, 3)), queries.vocabulary)
                for q, (terms, repeats) in enumerate(zip(queries.terms, queries.repeats)):
                    places, scores = block.best(terms, queries.weights[terms] * repeats, k, [-b[0] for b in best[q]], cfg.depth)
                    if len(places):
                        ids = block.ids.take(pa.array(places)).to_pylist()
                        best[q] = sorted(best[q] + [(-s, i is None, i) for s, i in zip(scores.tolist(), ids)], key=lambda b: b if not b[1] else (b[0], True))[:k]
        rows = [(q, b[2], -b[0]) for q, own in enumerate(best) for b in own]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], block.ids.type), pa.array([r[2] for r in rows], pa.int64())],
                names=["query", "id", "score"])

    return index.select("ids", "terms", "docs", "impacts").mapInArrow(run, f"query bigint, id {kind}, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cfg: RankConfig = RankConfig()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of the highest score above 0 for each item.

    Terms are runs of ASCII letters, digits and other characters from U+0080 on, A-Z lower-cased; null and
    empty texts have none. Equal scores are ranked by ascending id, a null id last; rows that repeat a
    document's id are documents of their own. Rows that repeat an item's id (null included) are one item
    with the terms of all of them; an item without terms, or none of whose terms any document holds, has
    no row. Columns besides ids and texts are not read.
    """
    spark = docs.sparkSession
    queries = items.select(F.col(item_col).alias("name"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    size = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    portions = max(1, -(-size // (4 * cfg.portion)))
    kind, names = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    whole = build_index(docs, id_col, text_col, cfg=cfg) if portions > 1 else None
    parts = []
    for p in range(portions):
        own = queries if portions == 1 else queries.where(F.pmod(F.xxhash64("name"), F.lit(portions)) == p)
        portion = Queries([tuple(r) for r in own.collect()], cfg.block_bytes)
        index, n_docs = whole or build_index(docs, id_col, text_col, portion.vocabulary, cfg)
        found = _search_portion(index, n_docs, portion, cfg, kind)
        table = spark.createDataFrame(list(enumerate(portion.names)), f"query bigint, item {names}")  # bounded by the portion
        parts.append(found.join(F.broadcast(table), "query").drop("query"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
