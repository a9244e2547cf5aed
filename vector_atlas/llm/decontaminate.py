"""Benchmark decontamination with a stored positional inverted index.

``build_index`` writes one row per block of documents: the block's sorted term hashes and, for each
term, the ascending positions of all its occurrences. ``search`` reads that table, takes each
benchmark window's terms from the rarest to the most frequent (by their counts in the whole corpus)
and intersects the positions, shifted by the terms' offsets. What is left are exact phrase matches;
windows whose three rarest terms stand within ``slop`` words of their places, without being exact, are
proximity matches. Index rows never move: every block is searched where it lies. Benchmark windows are
broadcast in portions of at most ``portion`` words, each searched against all blocks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vector_atlas.llm import textbuf
from vector_atlas.llm.tables import map_batches
from vector_atlas.session import materialise


@dataclass(frozen=True)
class PhraseConfig:
    window: int = 10
    slop: int = 3
    portion: int = 1_000_000  # benchmark words searched (and broadcast) at a time


def _pack(positions: np.ndarray, first: np.ndarray) -> bytes:
    """Gaps of ascending positions, list by list, as four byte planes (the high ones are mostly zero)."""
    gaps = np.diff(positions, prepend=0)
    gaps[first] = positions[first]
    return gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(packed: bytes, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = int(counts.sum())
    gaps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)
    total = np.cumsum(gaps)
    before = np.where(first > 0, total[first - 1], 0) if n else first
    return total - np.repeat(before, counts)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a scan of a written table: ``block, ids, n_words, terms, counts, postings``. A null text has no words."""
    import pyarrow as pa

    def start():
        return textbuf.Powers(), textbuf.alnum_words()

    def step(state, batch):
        powers, word_bytes = state
        ids = batch.column(0)
        for lo, data, offs in textbuf.chunks(batch.column(1)):
            words = textbuf.Words(data, offs, word_bytes, powers)
            order = np.argsort(words.hashes, kind="stable")
            ordered = words.hashes[order]
            first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(ordered)))
            rows = len(offs) - 1
            bounds = np.array([0, rows], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex]),
                    pa.ListArray.from_arrays(pa.array(bounds), ids.slice(lo, rows)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.diff(words.offs), pa.int64())),
                    pa.array([ordered[first].tobytes()], pa.binary()),
                    pa.array([counts.astype("<u4").tobytes()], pa.binary()),
                    pa.array([_pack(order, first)], pa.binary()),
                ],
                names=["block", "ids", "n_words", "terms", "counts", "postings"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"block string, ids array<{kind}>, n_words array<bigint>, terms binary, counts binary, postings binary"
    return materialise(map_batches(rows, schema, start, step), "postings")


class Windows:
    """Distinct windows of a portion of the benchmark: term ids, lengths, and the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        import pyarrow as pa

        found: dict[tuple, set] = {}
        powers, word_bytes = textbuf.Powers(), textbuf.alnum_words()
        names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(names)}
        for lo, data, offs in textbuf.chunks(pa.array([text for _, text in items], pa.large_string())):
            words = textbuf.Words(data, offs, word_bytes, powers)
            for d in range(len(offs) - 1):
                own = words.hashes[words.offs[d] : words.offs[d + 1]].tolist()
                for at in range(max(1, len(own) - size + 1) if own else 0):
                    found.setdefault(tuple(own[at : at + size]), set()).add(place[items[lo + d][0]])
        self.names = names
        self.vocabulary = np.array(sorted({t for w in found for t in w}), dtype=np.uint64)
        self.lengths = np.array([len(w) for w in found], dtype=np.int64)
        self.terms = np.full((len(found), size), -1, dtype=np.int64)
        for i, w in enumerate(found):
            self.terms[i, : len(w)] = np.searchsorted(self.vocabulary, np.array(w, dtype=np.uint64))
        self.item_counts = np.array([len(s) for s in found.values()], dtype=np.int64)
        self.items = np.array([i for s in found.values() for i in sorted(s)], dtype=np.int64)
        self.item_first = np.concatenate(([0], np.cumsum(self.item_counts)))[:-1].astype(np.int64)
        self.order = np.zeros_like(self.terms)

    def arrange(self, counts: np.ndarray) -> None:
        """Offsets of each window from its rarest term to its most frequent one; places past its end come last."""
        rarity = np.where(self.terms >= 0, counts[self.terms], np.iinfo(np.int64).max)
        self.order = np.argsort(rarity, axis=1, kind="stable")


class Block:
    """One index row, restricted to the terms of some windows."""

    def __init__(self, terms, counts, postings, n_words, vocabulary):
        terms, counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, "<u4").astype(np.int64)
        first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.positions = _unpack(postings, first, counts)
        self.bounds = np.concatenate(([0], np.cumsum(n_words)))
        self.n = int(self.bounds[-1])
        at = np.searchsorted(terms, vocabulary)
        at[at == len(terms)] = 0
        held = terms[at] == vocabulary if len(terms) else np.zeros(len(vocabulary), bool)
        self.first, self.counts = np.where(held, first[at] if len(terms) else 0, 0), np.where(held, counts[at] if len(terms) else 0, 0)
        self.term_at = np.full(self.n + 1, -2, dtype=np.int64)  # the last entry stands for places outside
        known = np.repeat(np.arange(len(vocabulary)), self.counts)
        self.term_at[self.positions[_ranges(self.first, self.counts)]] = known

    def same_document(self, start, end):
        """Whether words ``start`` and ``end`` exist and belong to one document."""
        inside = (start >= 0) & (end < self.n)
        doc = np.searchsorted(self.bounds, np.where(inside, start, 0), side="right") - 1
        return inside & (end < self.bounds[np.minimum(doc + 1, len(self.bounds) - 1)])

    def term(self, at):
        return self.term_at[np.where((at >= 0) & (at < self.n), at, self.n)]


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indices of the ranges [first, first + count), one range after the other."""
    before = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return np.repeat(first - before, counts) + np.arange(int(counts.sum()))


def _intersect(block: Block, windows: Windows, slop: int):
    """Windows and starts of exact matches, then windows and starts of the proximity matches."""
    order, terms = windows.order, windows.terms
    rows = np.arange(len(terms))
    lead = terms[rows, order[:, 0]] if len(rows) else rows
    near_terms = min(3, terms.shape[1])
    counts = block.counts[lead] if len(rows) else lead
    for j in range(1, near_terms):
        t = terms[rows, order[:, j]]
        counts = np.where((t < 0) | (block.counts[np.maximum(t, 0)] > 0), counts, 0)
    w = np.repeat(rows, counts)
    start = block.positions[_ranges(block.first[lead], counts)] - order[w, 0] if len(rows) else rows
    near_w, near_start = w, start
    for j in range(1, terms.shape[1]):
        t = terms[w, order[w, j]]
        keep = (t < 0) | (block.term(start + order[w, j]) == t)
        w, start = w[keep], start[keep]
    keep = block.same_document(start, start + windows.lengths[w] - 1)
    exact = w[keep], start[keep]
    for j in range(1, near_terms):
        t, place = terms[near_w, order[near_w, j]], near_start + order[near_w, j]
        lead_at = near_start + order[near_w, 0]
        keep = t < 0
        for shift in range(-slop, slop + 1):
            at = place + shift
            keep |= (block.term(at) == t) & block.same_document(np.minimum(at, lead_at), np.maximum(at, lead_at))
        near_w, near_start = near_w[keep], near_start[keep]
    return exact, (near_w, near_start + order[near_w, 0])


def _term_counts(index: DataFrame, vocabulary) -> np.ndarray:
    """Occurrences of each benchmark term in the whole corpus; bounded by the portion's vocabulary."""
    import pyarrow as pa

    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total = np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1)):
                terms, counts = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), "<u4")
                if len(terms):
                    at = np.searchsorted(terms, shared.value)
                    at[at == len(terms)] = 0
                    total += np.where(terms[at] == shared.value, counts[at], 0)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["term", "n"])

    rows = index.select("terms", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary), dtype=np.int64)
    for term, n in rows.collect():
        out[term] = n
    return out


def _search_portion(index: DataFrame, windows: Windows, cfg: PhraseConfig) -> DataFrame:
    """``block, place, id, n_words, spans, items, near``: spans are merged word ranges [from, to), flattened."""
    import pyarrow as pa

    shared = index.sparkSession.sparkContext.broadcast(windows)

    def step(_, batch):
        windows = shared.value
        for i in range(batch.num_rows):
            n_words = np.asarray(batch.column(2)[i].values, dtype=np.int64)
            block = Block(*(batch.column(c)[i].as_buffer() for c in (3, 4, 5)), n_words, windows.vocabulary)
            (w, start), (near_w, near_at) = _intersect(block, windows, cfg.slop)
            docs = len(n_words)
            doc_of = lambda at: np.searchsorted(block.bounds, at, side="right") - 1
            steps = np.zeros(block.n + 1, dtype=np.int64)
            np.add.at(steps, start, 1)
            np.add.at(steps, start + windows.lengths[w], -1)
            hit = np.cumsum(steps[: block.n]) > 0
            edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
            opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            # a run of hits that crosses documents is cut at their bounds
            cuts = block.bounds[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < block.n)]
            cuts = np.unique(cuts[hit[cuts] & hit[cuts - 1]]) if len(cuts) else cuts
            opens, closes = np.sort(np.concatenate((opens, cuts))), np.sort(np.concatenate((closes, cuts)))
            owner = doc_of(opens)
            spans = np.stack((opens - block.bounds[owner], closes - block.bounds[owner]), axis=1).ravel() if len(opens) else opens
            span_counts = 2 * np.bincount(owner, minlength=docs)[:docs]

            def held(w, at):
                pairs = np.repeat(doc_of(at) * len(windows.names), windows.item_counts[w]) + windows.items[_ranges(windows.item_first[w], windows.item_counts[w])]
                return np.unique(pairs)

            exact, close = held(w, start), held(near_w, near_at)
            close = close[~np.isin(close, exact)]

            def lists(pairs):
                counts = np.bincount(pairs // max(len(windows.names), 1), minlength=docs)[:docs]
                names = pa.array([windows.names[p] for p in (pairs % max(len(windows.names), 1)).tolist()], pa.string())
                return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), names)

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(0)[i].as_py()] * docs, pa.string()), pa.array(np.arange(docs), pa.int64()),
                    batch.column(1)[i].values, pa.array(n_words, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(span_counts))).astype(np.int32)), pa.array(spans, pa.int64())),
                    lists(exact), lists(close),
                ],
                names=["block", "place", "id", "n_words", "spans", "items", "near"],
            )

    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"block string, place bigint, id {kind}, n_words bigint, spans array<bigint>, items array<string>, near array<string>"
    return map_batches(index.select("block", "ids", "n_words", "terms", "counts", "postings"), schema, lambda: None, step)


def _merged(spans):
    """Ranges of several portions as one list of disjoint ranges, in SQL functions."""
    ordered = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(spans) / 2 - 1).cast("int")), lambda i: F.struct(
        F.get(spans, (2 * i).cast("int")).alias("s"), F.get(spans, (2 * i + 1).cast("int")).alias("e"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    return F.when(F.size(spans) == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(
        ordered, start,
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("bigint"), x["e"] - F.greatest(a["end"], x["s"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")),
        lambda a: a["n"]))


def search(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", cfg: PhraseConfig = PhraseConfig()) -> DataFrame:
    """One row per indexed document: ``id, n_words, n_hit, spans, items, near``.

    ``items`` are the ids (as strings; a null id is the empty string) of the items with a window in the
    document, ``near`` those with a proximity match only. Rows that repeat an item id count as one item;
    an item without words has no window. With an empty benchmark nothing is hit.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text")).where("text is not null")
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    portions = max(1, -(-words // (4 * cfg.portion)))
    parts = []
    for p in range(portions):
        own = items if portions == 1 else items.where(F.pmod(F.xxhash64("name"), F.lit(portions)) == p)
        windows = Windows([tuple(r) for r in own.collect()], cfg.window)
        windows.arrange(_term_counts(index, windows.vocabulary))
        parts.append(_search_portion(index, windows, cfg))
    found = parts[0]
    if portions > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.groupBy("block", "place").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"),
            *[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")],
        ).withColumn("items", F.array_distinct("items")).withColumn("near", F.array_except("near", "items"))
    return found.select("id", "n_words", _merged(F.col("spans")).alias("n_hit"), "spans", "items", "near")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: PhraseConfig = PhraseConfig()) -> DataFrame:
    """``search`` over a freshly built index of ``docs``."""
    return search(build_index(docs, id_col, text_col), benchmark, cfg=cfg)
