"""Near-duplicate documents by min-max hashing.

A document's set are its distinct shingles of five words. Under each permutation of the shingle
hashes both the smallest and the largest value are kept, so ``permutations`` evaluations give twice
as many signature positions. ``rows`` positions form a band; documents that agree in a band meet in
a bucket. With 75 bands of 9 positions two sets of Jaccard similarity s meet with probability
1 - (1 - s**9)**75: all but 3 in 10**9 pairs at s = 0.85, one in 50 at s = 0.4.

Copies are folded before: one representative stands for all documents of one set. First, every member
of a bucket is compared with the bucket's centre, the member that shares most buckets with others;
linked documents form components, and only buckets that still hold several components go on. Members
of small ones (at most ``small`` documents, so at most ``small`` / 2 rows per member) are compared in
pairs. Larger ones that share members are taken together as families, cut into blocks, and compared
block by block inside tasks: exact intersections of all sets of different components, of which only
links that join components come out. So each two members of a bucket are compared or already
connected, and no group's pairs are ever listed. Links are confirmed on the full sets, read again from
the texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vector_atlas.llm import textbuf
from vector_atlas.llm.tables import map_batches, sized, whole_groups
from vector_atlas.llm.components import settle
from vector_atlas.session import materialise


@dataclass(frozen=True)
class MinMaxConfig:
    shingle: int = 5
    bands: int = 75
    rows: int = 9
    percent: int = 85  # link when 100 * |intersection| >= percent * |union|
    small: int = 12  # members of a bucket that are compared in pairs
    block: int = 512  # members of a family per block

    @property
    def permutations(self) -> int:
        return (self.bands * self.rows + 1) // 2


def _sets(column, k: int, powers, words):
    """Per chunk of documents: first row, all set members ascending per document, offsets."""
    for lo, data, offs in textbuf.chunks(column):
        shingles, bounds = textbuf.Words(data, offs, words, powers).shingles(k)
        each = [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        yield lo, np.concatenate(each) if each else shingles, np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)


def _digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, cfg: MinMaxConfig) -> DataFrame:
    """``id, n, digest, bands``: size and digest of each document's set and one hash per band."""
    import pyarrow as pa

    def start():
        return textbuf.Powers(), textbuf.space_words()

    def step(state, batch):
        ids, column = batch.column(0), batch.column(1)
        scale = textbuf.stream(1, cfg.permutations) | np.uint64(1)
        shift = textbuf.stream(2, cfg.permutations)
        weights = textbuf.stream(3, cfg.rows) | np.uint64(1)
        salts = textbuf.stream(4, cfg.bands)
        for lo, members, bounds in _sets(column, cfg.shingle, *state):
            rows = len(bounds) - 1
            full = np.flatnonzero(np.diff(bounds))
            values = np.empty((2 * cfg.permutations, len(full)), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for p in range(cfg.permutations if len(full) else 0):
                    x = members * scale[p] + shift[p]
                    values[2 * p] = np.minimum.reduceat(x, bounds[full])
                    values[2 * p + 1] = np.maximum.reduceat(x, bounds[full])
                banded = values[: cfg.bands * cfg.rows].reshape(cfg.bands, cfg.rows, len(full))
                keys = textbuf.mix((textbuf.mix(banded) * weights[None, :, None]).sum(axis=1, dtype=np.uint64) + salts[:, None]).T
            counts = np.zeros(rows, dtype=np.int64)
            counts[full] = cfg.bands
            digests: list = [None] * rows
            for d in full:
                digests[d] = _digest(members[bounds[d] : bounds[d + 1]])
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, rows),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(textbuf.unsigned_to_long(keys.ravel()), pa.int64())),
                ],
                names=["id", "n", "digest", "bands"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
        f"id {kind}, n bigint, digest binary, bands array<bigint>", start, step,
    )


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, cfg: MinMaxConfig) -> DataFrame:
    """``rep, members``: the set of each representative as sorted 64-bit numbers."""
    import pyarrow as pa

    def start():
        return textbuf.Powers(), textbuf.space_words()

    def step(state, batch):
        ids, column, want = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        for lo, members, bounds in _sets(column, cfg.shingle, *state):
            each = [members[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            keep = [d for d, x in enumerate(each) if _digest(x) == want[lo + d]]
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([lo + d for d in keep])), pa.array([each[d].tobytes() for d in keep], pa.binary())],
                    names=["rep", "members"],
                )

    rows = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(sized(wanted), "rep")
    kind = docs.schema[id_col].dataType.simpleString()
    found = map_batches(rows.select("rep", "text", "digest"), f"rep {kind}, members binary", start, step)
    return found.dropDuplicates(["rep"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` for each pair, decided on the full sets."""
    import pyarrow as pa

    def step(_, batch):
        linked = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            shared = int((x[at] == y).sum())
            linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("members").alias("x")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("members").alias("y")), "b"
    )
    kind = pairs.schema["a"].dataType.simpleString()
    return map_batches(both.select("a", "b", "x", "y"), f"a {kind}, b {kind}, linked boolean", lambda: None, step)


def _pairs(rows: DataFrame, left, right, n_left, n_right, percent: int) -> DataFrame:
    """Distinct unordered pairs whose set sizes allow a link."""
    fits = F.least(n_left, n_right) * 100 >= F.greatest(n_left, n_right) * percent
    return rows.where((left != right) & fits).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct()


def confirmed_links(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, cfg: MinMaxConfig) -> DataFrame:
    """``item_id, component`` of the representatives that meet others in a bucket; ``reps``: rep, n, digest, bands."""
    rows = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = materialise(
        rows.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("met")).where("lo != hi").select("key", "met"), "buckets"
    )
    # a document's degree: with how many others it shares buckets, counted once per bucket
    degree = F.sum("met").over(Window.partitionBy("rep"))
    members = materialise(rows.join(shared, "key").withColumn("degree", degree).drop("met"), "members")
    nodes = materialise(members.select("rep").distinct(), "nodes")
    sets = materialise(_full_sets(docs, reps.select("rep", "digest").join(nodes, "rep", "left_semi"), id_col, text_col, cfg), "sets")
    centres = members.groupBy("key").agg(F.max_by(F.struct("rep", "n"), F.struct("degree", "rep")).alias("c"))
    centres = materialise(centres.select("key", "c.*").toDF("key", "centre", "n_centre"), "centres")
    spokes = _pairs(members.join(centres, "key"), F.col("rep"), F.col("centre"), F.col("n"), F.col("n_centre"), cfg.percent)
    tested = materialise(_confirm(spokes, sets, cfg.percent), "tested")
    links = tested.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comps = materialise(_component_of(nodes, links), "components")
    # buckets that still hold several components
    state = members.select("key", "rep", "n").join(comps, "rep")
    mixed = state.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.min("rep").alias("head"))
    mixed = materialise(mixed.where("least <> most").select("key", "m", "head"), "mixed")
    state = materialise(state.join(mixed, "key"), "state")
    few = state.where(F.col("m") <= cfg.small)
    a, b = few.alias("a"), few.alias("b")
    rows = a.join(b, F.col("a.key") == F.col("b.key")).where(F.col("a.comp") < F.col("b.comp"))
    pairs = _pairs(rows, F.col("a.rep"), F.col("b.rep"), F.col("a.n"), F.col("b.n"), cfg.percent).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    found = _confirm(pairs, sets, cfg.percent).where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    many = state.where(F.col("m") > cfg.small)
    if many.limit(1).count():
        found = found.unionByName(_family_links(many, sets, cfg))
    found = materialise(found, "more")
    if not found.limit(1).count():
        return comps.toDF("item_id", "component")
    return materialise(_component_of(nodes, links.unionByName(found)), "components").toDF("item_id", "component")


def _component_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``rep, comp`` of all nodes; a node without links is its own component."""
    placed = settle(links).toDF("rep", "comp")
    return nodes.join(placed, "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp"))


def _family_links(many: DataFrame, sets: DataFrame, cfg: MinMaxConfig) -> DataFrame:
    """``src, dst``: links between different components within families, which are the buckets of
    ``many`` (key, rep, comp, head) that hang together by their members."""
    ties = many.select(F.col("rep").alias("src"), F.col("head").alias("dst")).distinct()
    families = settle(ties).toDF("rep", "family")
    rows = materialise(many.select("rep", "comp").distinct().join(families, "rep"), "families")
    sizes = rows.groupBy("family").agg(F.count("*").alias("all"))
    blocks = F.ceil(F.col("all") / cfg.block).cast("int")
    rows = rows.join(sizes, "family").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.join(sets, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = rows.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "comp", "own", "members")
    tiles = tiles.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    def run(batches):
        import pyarrow as pa

        for table in whole_groups(batches, 3):
            keys = [table.column(c).to_pylist() for c in range(3)]
            first = [r for r in range(len(table)) if r == 0 or any(k[r] != k[r - 1] for k in keys)]
            out = []
            for lo, hi in zip(first, [*first[1:], len(table)]):
                own = table.slice(lo, hi - lo)
                members = [np.frombuffer(x.as_buffer(), np.uint64) for x in own.column(6)]
                _, comp = np.unique(np.asarray(own.column(4).to_numpy(zero_copy_only=False)), return_inverse=True)
                out += [(lo + a, lo + b) for a, b in _tile_links(members, comp, cfg.percent)]
            if out:
                yield pa.RecordBatch.from_arrays([table.column(3).take(pa.array([x[e] for x in out])).combine_chunks() for e in (0, 1)], names=["src", "dst"])

    kind = many.schema["rep"].dataType.simpleString()
    return tiles.mapInArrow(run, f"src {kind}, dst {kind}")


def _tile_links(members: list[np.ndarray], comp: np.ndarray, percent: int, width: int = 4096) -> list[tuple[int, int]]:
    """Links that join components of a tile: at most one fewer than there are components.

    Members of all components but the largest are compared with every member; intersections are sums of
    matrix products over columns of shared shingles."""
    sizes = np.array([len(x) for x in members])
    largest = np.bincount(comp).argmax()
    rows = np.flatnonzero(comp != largest)
    if not len(rows):
        return []
    _, ids, counts = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    rank = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[ids]
    owner = np.repeat(np.arange(len(members)), sizes)
    owner, rank = owner[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    owner, rank = owner[order], rank[order]
    shared = np.zeros((len(rows), len(members)), dtype=np.float32)
    for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        lo, hi = np.searchsorted(rank, (at, at + width))
        part = np.zeros((len(members), width), dtype=np.float32)
        part[owner[lo:hi], rank[lo:hi] - at] = 1
        shared += part[rows] @ part.T
    linked = 100 * shared.astype(np.int64) >= percent * (sizes[rows][:, None] + sizes[None, :] - shared.astype(np.int64))
    root = list(range(int(comp.max()) + 1))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(linked & (comp[rows][:, None] != comp[None, :]))):
        x, y = find(int(comp[rows[a]])), find(int(comp[b]))
        if x != y:
            root[x] = y
            out.append((int(rows[a]), int(b)))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: MinMaxConfig = MinMaxConfig()) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable over links, ``kept`` marks the document with that id.
    A null or empty text and a text of spaces have an empty set and link with nothing. Rows that repeat
    an id count as one document, for which the row with the smallest digest stands; they all get its
    component. A row with a null id is kept, with a null component.
    """
    found = materialise(signatures(docs, id_col, text_col, cfg), "signatures")
    first = found.where("digest is not null and id is not null").groupBy("id").agg(F.min("digest").alias("digest"))
    classes = materialise(first.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    own = found.select(F.col("id").alias("rep"), "n", "digest", "bands")
    reps = materialise(own.join(classes, ["rep", "digest"]).dropDuplicates(["rep"]), "representatives")
    comps = confirmed_links(docs, reps, id_col, text_col, cfg)
    grouped = first.join(classes, "digest").join(comps.toDF("rep", "component"), "rep", "left")
    placed = materialise(grouped.select("id", F.coalesce("component", "rep").alias("component")), "placed")
    component = F.coalesce("component", "id")
    return found.join(placed, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
