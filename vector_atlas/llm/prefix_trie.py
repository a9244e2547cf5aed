"""The prefix trie of conversations, measured along its Euler tour.

Every distinct sequence of leading turns is a node. Each node has an arc that enters it and one that
leaves it; the arcs form one list, the tour: into the first child or out of a leaf, from a child to
its next sibling or back out of the parent. The list is ranked by random-mate contraction: in each
round a coin per arc lets about a quarter of the arcs be spliced out by their predecessors, until at
most ``finish`` are left; the spliced ones get their places back in the reverse order. Work is linear
in the arcs, the rounds logarithmic. A sum over a subtree is then the difference of two prefix sums.

Nothing is gathered by conversation, node or parent: turns are numbered by ranges of the sorted table,
keys of prefixes are running XORs in blocks of turns, siblings are linked in buckets, prefix sums run
over blocks of places. Only digests and lengths of the turns move, never their texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vector_atlas.session import materialise


@dataclass(frozen=True)
class TrieConfig:
    finish: int = 1 << 14  # arcs that one task ranks at the end of the contraction
    block: int = 1 << 12  # rows in one window of a running sum
    buckets: int = 1 << 12  # buckets of the children of one parent
    ids: int = 1 << 12  # conversation ids in one piece of a digest's text


NO_ENDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of the empty string


def _before(order: Window) -> Window:
    return order.rowsBetween(Window.unboundedPreceding, -1)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def running_sums(rows: DataFrame, at: str, values: list[str], block: int) -> DataFrame:
    """``rows`` (a written table) with the inclusive running sum of each of ``values`` in the order of the
    non-negative integer column ``at``, whose values differ. Sums run in blocks of ``block`` places; the
    totals of the blocks are summed in the same way, so no window holds more than ``block`` rows."""
    top = rows.agg(F.max(at)).first()[0]
    keyed = rows.withColumn("__b", F.floor(F.col(at) / block).cast("long"))
    within = Window.partitionBy("__b").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.withColumns({v: F.sum(v).over(within) for v in values})
    if top is None or top < block:
        return summed.drop("__b")
    totals = materialise(keyed.groupBy(F.col("__b").alias("__at")).agg(*[F.sum(v).alias(v) for v in values]), "totals")
    carried = running_sums(totals, "__at", values, block).select(
        (F.col("__at") + 1).alias("__b"), *[F.col(v).alias(f"__{v}") for v in values])
    summed = summed.join(carried, "__b", "left")
    return summed.withColumns({v: F.col(v) + _zero(F.col(f"__{v}")) for v in values}).drop("__b", *[f"__{v}" for v in values])


def number_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, block: int) -> DataFrame:
    """``conv, pos, token, chars``: the turns of each conversation numbered from 0 by turn number (null
    first), equal numbers by the digest of role and text. Repeated rows are counted before they are
    sorted, and the order is cut into ranges, so neither a long conversation nor copies meet in one task."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    token = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), token.alias("token"), F.length(text).cast("long").alias("chars"))
    rows = rows.groupBy("conv", "turn", "token").agg(F.count("*").alias("n"), F.first("chars").alias("chars"))
    order = ["conv", F.col("turn").asc_nulls_first(), "token"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the written ids are (range, row within it): the order of the whole table
    ranged = materialise(ranged.withColumn("at", F.monotonically_increasing_id()), "turns")
    part, cell = F.shiftright("at", 33), F.shiftright("at", block.bit_length() - 1)
    cells = materialise(ranged.groupBy(part.alias("part"), cell.alias("cell")).agg(F.sum("n").alias("n")), "cells")
    parts = cells.groupBy("part").agg(F.sum("n").alias("n"))
    # one row per range of the sorted table
    parts = parts.select("part", _zero(F.sum("n").over(_before(Window.orderBy("part")))).alias("part_before"))
    cells = cells.withColumn("cell_before", _zero(F.sum("n").over(_before(Window.partitionBy("part").orderBy("cell")))))
    cells = cells.join(F.broadcast(parts), "part").select("cell", (F.col("cell_before") + F.col("part_before")).alias("before"))
    own = _zero(F.sum("n").over(_before(Window.partitionBy("cell").orderBy("at"))))
    placed = ranged.withColumn("cell", cell).withColumn("own", own).join(cells, "cell")
    placed = materialise(placed.select("conv", "token", "chars", "n", (F.col("own") + F.col("before")).alias("place")), "placed")
    starts = placed.groupBy("conv").agg(F.min("place").alias("start"))
    numbered = placed.join(starts, "conv").withColumn("first", F.col("place") - F.col("start"))
    each = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("pos")
    return materialise(numbered.select("conv", each, "token", "chars"), "numbered")


def rebuild(numbered: DataFrame, head: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``conv, q, token, chars, last`` and conversations ``conv, size`` (0 where none is left).

    A conversation gets the first ``head`` turns of the conversation ``base`` (all if it has fewer, none
    if there is no such), then its own turns after its first ``head``. Both are expressions over ``conv``."""
    sizes = materialise(numbered.groupBy("conv").agg(F.count("*").alias("own")).withColumns({"h": head.cast("long"), "base": base}), "conversations")
    bases = sizes.select(F.col("conv").alias("base"), F.col("own").alias("base_size"))
    plan = sizes.join(bases, "base", "left").withColumn("taken", F.least("h", _zero(F.col("base_size"))))
    plan = materialise(plan.withColumn("size", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "plans")
    # at most the longest head of each base, for every conversation that starts with it
    lead = numbered.where(F.col("pos") < sizes.agg(F.max("h")).first()[0]) if sizes.head(1) else numbered
    start = plan.where("taken > 0").select("base", "conv", "taken", "size").join(lead.withColumnRenamed("conv", "base"), "base")
    start = start.where("pos < taken").select("conv", F.col("pos").alias("q"), "token", "chars", "size")
    rest = numbered.join(plan.select("conv", "h", "taken", "size"), "conv").where("pos >= h")
    rest = rest.select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("q"), "token", "chars", "size")
    rows = start.unionByName(rest).withColumn("last", F.col("q") + 1 == F.col("size")).drop("size")
    return materialise(rows, "rebuilt"), plan.select("conv", "size")


def prefix_keys(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` plus ``depth, x, y`` (the key of the prefix that ends here) and ``px, py`` (of the one
    before): running XORs of two 64-bit hashes of (place, turn), in blocks of turns."""
    own = {n: F.xxhash64(F.lit(s), "q", "token") for n, s in (("ox", 1), ("oy", 2))}
    rows = rows.withColumns({**own, "cell": F.floor(F.col("q") / block).cast("long")})
    totals = rows.groupBy("conv", "cell").agg(F.bit_xor("ox").alias("cx"), F.bit_xor("oy").alias("cy"))
    carry = _before(Window.partitionBy("conv").orderBy("cell"))
    totals = totals.withColumns({c: _zero(F.bit_xor(c).over(carry)) for c in ("cx", "cy")}).where("cell > 0")
    within = Window.partitionBy("conv", "cell").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"x": F.bit_xor("ox").over(within), "y": F.bit_xor("oy").over(within)})
    rows = rows.join(totals, ["conv", "cell"], "left")
    for c in "xy":
        rows = rows.withColumn(c, F.col(c).bitwiseXOR(_zero(F.col(f"c{c}")))).withColumn(f"p{c}", F.col(c).bitwiseXOR(F.col(f"o{c}")))
    return rows.withColumn("depth", F.col("q") + 1).select("conv", "depth", "x", "y", "px", "py", "chars", "last")


def ends_digests(ends: DataFrame, per_piece: int) -> DataFrame:
    """``depth, x, y, ends_sha256`` of the ids ``conv`` at each key, ascending and joined by commas.

    The ids are sorted in ranges and joined piece by piece; a digest then reads the pieces of its key in
    order. One task reads all pieces of a key, as the digest demands, but holds one at a time."""
    import hashlib

    import pyarrow as pa

    keys = ["depth", "x", "y"]

    def join_ids(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(c).to_numpy() for c in range(4)]
            change = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            cuts = [0, *(change.nonzero()[0] + 1).tolist(), n]
            spans = [(a, min(a + per_piece, hi)) for lo, hi in zip(cuts, cuts[1:]) for a in range(lo, hi, per_piece)]
            firsts = [a for a, _ in spans]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[firsts]) for c in cols), pa.array([",".join(map(str, cols[3][a:b].tolist())) for a, b in spans], pa.large_string())],
                names=[*keys, "first", "ids"])

    def digest(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4))):
                if own != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*keys, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=[*keys, "ends_sha256"])

    order = [*keys, "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(join_ids, "depth bigint, x bigint, y bigint, first bigint, ids string")
    sorted_pieces = pieces.repartition(*keys).sortWithinPartitions(*keys, "first")
    return sorted_pieces.mapInArrow(digest, "depth bigint, x bigint, y bigint, ends_sha256 string")


def link_children(nodes: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Each child with its next sibling (``id, parent, next``), and each parent with its first child and
    their number (``parent, first, n_children``). Children are ordered by bucket, then id: windows hold
    one bucket of a parent, or its buckets."""
    children = nodes.where("parent is not null").select("id", "parent", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    inside = Window.partitionBy("parent", "bucket").orderBy("id")
    children = materialise(children.withColumns({"next": F.lead("id").over(inside), "row": F.row_number().over(inside)}), "children")
    filled = children.groupBy("parent", "bucket").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    over = Window.partitionBy("parent").orderBy("bucket")
    filled = materialise(filled.withColumns({"then": F.lead("first").over(over), "row": F.row_number().over(over)}), "filled")
    joined = children.join(filled.select("parent", "bucket", "then"), ["parent", "bucket"])
    parents = filled.groupBy("parent").agg(F.max(F.when(F.col("row") == 1, F.col("first"))).alias("first"), F.sum("n").alias("n_children"))
    return joined.select("id", "parent", F.coalesce("next", "then").alias("next")), parents


def rank_list(arcs: DataFrame, head: int, finish: int) -> DataFrame:
    """``a, pos``: the place of each arc of one list, from ``head`` at 0. ``arcs``: ``a, s`` (the next arc,
    null at the end), unique ``a``."""
    import pyarrow as pa

    state = materialise(arcs.select("a", "s", F.lit(1).cast("long").alias("w")), "arcs")
    spliced: list[DataFrame] = []

    def coin(c):
        return F.pmod(F.xxhash64(F.lit(len(spliced)), c), F.lit(2))

    left = state.count()
    while left > finish:
        mates = (coin(F.col("a")) == 0) & F.col("s").isNotNull() & (coin(F.col("s")) == 1)
        hosts = state.where(mates).select(F.col("s").alias("a"), F.col("a").alias("host"), F.col("w").alias("off"))
        met = state.where(coin(F.col("a")) == 1).join(hosts, "a", "left")
        # a matched row stands for two: the spliced arc, and its host with the arc's successor
        kept = F.struct(F.coalesce("host", "a").alias("a"), "s", (F.col("w") + _zero(F.col("off"))).alias("w"), F.lit(None).cast("long").alias("host"), F.lit(None).cast("long").alias("off"))
        gone = F.struct("a", F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("w"), "host", "off")
        met = met.select(F.inline(F.when(F.col("host").isNull(), F.array(kept)).otherwise(F.array(kept, gone))))
        still = state.where(~mates & (coin(F.col("a")) == 0)).select("a", "s", "w", F.lit(None).cast("long").alias("host"), F.lit(None).cast("long").alias("off"))
        written = materialise(still.unionByName(met), "round")
        spliced.append(written.where("host is not null").select("a", "host", "off"))
        state = written.where("host is null").select("a", "s", "w")
        left = state.count()

    def walk(batches):
        after = {}
        for batch in batches:
            after.update(zip(batch.column(0).to_pylist(), zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())))
        places, at, pos = [], head, 0
        while at is not None and after:
            places.append((at, pos))
            at, step = after[at]
            pos += step
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in places], pa.int64()) for i in (0, 1)], names=["a", "pos"])

    ranked = materialise(state.coalesce(1).mapInArrow(walk, "a bigint, pos bigint"), "places")
    for gone in reversed(spliced):
        hosts = ranked.select(F.col("a").alias("host"), "pos")
        ranked = ranked.unionByName(materialise(gone.join(hosts, "host").select("a", (F.col("pos") + F.col("off")).alias("pos")), "places"))
    return ranked


def subtree_sums(nodes: DataFrame, links: DataFrame, parents: DataFrame, root: int, values: list[str], cfg: TrieConfig) -> DataFrame:
    """``id`` plus the sum of each of ``values`` over the node's subtree, from prefix sums along the tour."""
    inward = nodes.select("id").join(parents.select(F.col("parent").alias("id"), "first"), "id", "left")
    inward = inward.select((F.col("id") * 2).alias("a"), F.coalesce(F.col("first") * 2, F.col("id") * 2 + 1).alias("s"))
    outward = links.select((F.col("id") * 2 + 1).alias("a"), F.coalesce(F.col("next") * 2, F.col("parent") * 2 + 1).alias("s"))
    end = nodes.where(F.col("parent").isNull()).select((F.col("id") * 2 + 1).alias("a"), F.lit(None).cast("long").alias("s"))
    places = rank_list(inward.unionByName(outward).unionByName(end), root * 2, cfg.finish)
    tour = places.select("pos", F.shiftright("a", 1).alias("id"), (F.col("a") % 2 == 1).alias("out"))
    entered = tour.where("not out").join(nodes.select("id", *values), "id").select("pos", "id", "out", *values)
    left = tour.where("out").select("pos", "id", "out", *[F.lit(0).cast("long").alias(v) for v in values])
    marks = materialise(entered.unionByName(left).withColumns({f"own_{v}": F.col(v) for v in values}), "tour")
    summed = running_sums(marks, "pos", values, cfg.block)
    inside = [(F.max(F.when(F.col("out"), F.col(v))) - F.max(F.when(~F.col("out"), F.col(v) - F.col(f"own_{v}")))).alias(v) for v in values]
    return summed.groupBy("id").agg(*inside)


def prefix_trie(turns: DataFrame, head: Column | None = None, base: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", cfg: TrieConfig = TrieConfig()) -> DataFrame:
    """One row per distinct sequence of leading turns (a node), from the empty one (the root) on:
    ``conv_id`` (its smallest member), ``depth, parent_conv_id`` (null at the root), ``n_convs`` (members),
    ``n_children, n_leaves`` (childless nodes of the subtree), ``saved_tokens`` (over the subtree: members
    but one, times code points of the node's last text), ``ends_sha256`` (of the ids of members that end here).

    ``head`` and ``base`` are expressions over the id column ``conv``: each conversation is first rebuilt
    as ``rebuild`` says; without them it is taken as it is. Null roles and texts are empty; equal turn
    numbers are ordered by a digest of role and text, repeated rows are turns of their own. Rows without
    a conversation id belong to none and are left out. Without any conversation there is no node.
    Columns besides the four are not read. Ids are whole numbers.
    """
    numbered = number_turns(turns, conv_col, turn_col, role_col, text_col, cfg.block)
    own = F.lit(0) if head is None else head
    rows, sizes = rebuild(numbered, own, F.col("conv") if base is None else base)
    keyed = materialise(prefix_keys(rows, cfg.block), "prefixes")
    grouped = keyed.groupBy("depth", "x", "y").agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.first("chars").alias("chars"), F.first("px").alias("px"), F.first("py").alias("py"))
    zero = F.lit(0).cast("long")
    root = sizes.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.withColumns({c: zero for c in ("depth", "x", "y", "chars")}).withColumns({c: F.lit(None).cast("long") for c in ("px", "py")})
    nodes = materialise(grouped.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    over = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(over, ["depth", "px", "py"], "left").drop("px", "py")
    nodes = materialise(nodes, "nodes")
    links, parents = link_children(nodes, cfg.buckets)
    shape = nodes.join(parents.select(F.col("parent").alias("id"), "n_children"), "id", "left").withColumn("n_children", _zero(F.col("n_children")))
    shape = materialise(shape.withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}), "shape")
    top = shape.where("depth = 0").select("id").first()
    if top is None:
        sums = shape.select("id", "n_leaves", "saved_tokens")
    else:
        sums = subtree_sums(shape, links, parents, top["id"], ["n_leaves", "saved_tokens"], cfg)
    ends = keyed.where("last").select("depth", "x", "y", "conv").unionByName(sizes.where("size = 0").select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv"))
    out = shape.drop("n_leaves", "saved_tokens").join(sums, "id").join(ends_digests(ends, cfg.ids), ["depth", "x", "y"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
