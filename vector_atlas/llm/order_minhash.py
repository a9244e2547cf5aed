"""Document fingerprints by Order MinHash, in built-in expressions only.

A text's k-mers are runs of ``k`` words (whitespace separated, pieces of at most 16 characters, so a
text without spaces has words too), numbered by occurrence: the second "a b" differs from the first.
Each numbered k-mer has one hash. Under permutation j, hashes are compared from a starting point on
the circle of hashes, j/m around it; the ``l`` minimal k-mers are the next ones on the circle. They are
put back into text order and the tuple of their hashes is hashed: component j of the signature. So
both content and order must agree, as edit distance asks for, and one sort serves all permutations.

Hash (upper 40 bits) and position (lower 24 bits) share one long; arrays of longs sort as primitives.
Positions from 2**24 on count as one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION_BITS = 24
POSITIONS = (1 << POSITION_BITS) - 1
WORD = r"[^\s]{1,16}"


@dataclass(frozen=True)
class OrderConfig:
    k: int = 2
    permutations: int = 64
    bucket_rows: int = 250  # documents per bucket when neighbours by id are looked up
    most_buckets: int = 16384


def _steps(most: int) -> Column:
    """Falling powers of two for a binary search."""
    return F.array(*[F.lit(1 << b) for b in range(most.bit_length() - 1, -1, -1)])


def with_signature(df: DataFrame, text_col: str, out: str, cfg: OrderConfig = OrderConfig()) -> DataFrame:
    """``df`` plus ``out``: the signature as an array of ``permutations`` longs, empty for a text without words.

    Each step is a column of its own that the next one uses more than once, so it is computed once.
    """
    words, sorted_, numbered, steps = (f"__{out}_{c}" for c in "wsnb")
    df = df.withColumn(words, F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)))

    def packed(i):
        grams = F.xxhash64(*[F.get(words, i + j) for j in range(cfg.k)])
        return grams.bitwiseAND(F.lit(~POSITIONS)).bitwiseOR(F.least(i, F.lit(POSITIONS)).cast("long"))

    kmers = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - cfg.k, F.lit(0))), packed)
    df = df.withColumn(sorted_, F.when(F.size(words) > 0, F.sort_array(kmers)).otherwise(F.array().cast("array<bigint>")))

    def same(i, x):
        return F.coalesce(F.shiftright(F.get(sorted_, i), POSITION_BITS) == F.shiftright(x, POSITION_BITS), F.lit(False))

    def number(x, i):
        # how many equal k-mers stand before: a binary search in the run of equal hashes
        before = F.aggregate(_steps(POSITIONS), F.lit(0), lambda n, step: F.when(same(i - n - step, x), n + step).otherwise(n))
        again = F.xxhash64(F.shiftright(x, POSITION_BITS), before).bitwiseAND(F.lit(~POSITIONS)).bitwiseOR(x.bitwiseAND(F.lit(POSITIONS)))
        return F.when((i > 0) & same(i - 1, x), again).otherwise(x)

    df = df.withColumn(numbered, F.sort_array(F.transform(sorted_, number)))
    df = df.withColumn(steps, F.filter(_steps(POSITIONS), lambda b: b <= F.size(numbered)))
    starts = F.array(*[F.lit(j * ((1 << 64) // cfg.permutations) - (1 << 63)) for j in range(cfg.permutations)])

    def below(start):
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.coalesce(F.get(numbered, n + step - 1) < start, F.lit(False)), n + step).otherwise(n))

    def component(pair):
        a, b = pair["a"], pair["b"]
        first, second = F.shiftright(a, POSITION_BITS), F.shiftright(b, POSITION_BITS)
        in_order = a.bitwiseAND(F.lit(POSITIONS)) <= b.bitwiseAND(F.lit(POSITIONS))
        return F.when(in_order, F.xxhash64(first, second)).otherwise(F.xxhash64(second, first)).bitwiseAND(F.lit((1 << 32) - 1))

    def minima(at):
        return F.struct(*[F.get(numbered, F.pmod(at + F.lit(t), F.size(numbered))).alias(c) for t, c in enumerate("ab")])

    signature = F.transform(F.transform(F.transform(starts, below), minima), component)
    empty = F.array().cast("array<bigint>")
    return df.withColumn(out, F.when(F.size(numbered) > 0, signature).otherwise(empty)).drop(words, sorted_, numbered, steps)


def as_text(signature: Column) -> Column:
    """Eight hexadecimal digits per component; the empty string for a text without words."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components; 1 for two empty signatures, 0 if only one is empty."""
    equal = F.size(F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda j: F.get(a, j) == F.get(b, j)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(equal / F.size(a))


def with_next(docs: DataFrame, id_col: str, text_col: str, cfg: OrderConfig = OrderConfig(), signature: str | None = None) -> DataFrame:
    """``docs`` plus ``next_text`` (and ``next_signature``) of the next document by descending id, the first after the last.

    Rows are dealt to ranges of ids of about ``bucket_rows`` rows; each range also gets the first row of
    the next range, so every neighbour is found within one range. Null ids come last, in one range; rows
    with one id are ordered by text.
    """
    head = docs.agg(F.count("*").alias("n"), F.count(id_col).alias("ids")).first()
    buckets = int(min(cfg.most_buckets, max(1, head["n"] // cfg.bucket_rows)))
    splits = []
    if buckets > 1 and head["ids"]:
        shares = [i / buckets for i in range(1, buckets)]
        splits = sorted(set(docs.agg(F.percentile_approx(id_col, shares, 10 * buckets)).first()[0]))
    if splits:
        bounds = F.array(*[F.lit(s) for s in splits])
        bucket = F.aggregate(_steps(len(splits)), F.lit(0), lambda n, step: F.when(F.coalesce(F.get(bounds, n + step - 1) < F.col(id_col), F.lit(False)), n + step).otherwise(n))
    else:
        bucket = F.lit(0)
    rows = docs.withColumns({"__bucket": F.when(F.col(id_col).isNull(), -1).otherwise(bucket), "__extra": F.lit(0)})
    tops = rows.groupBy("__bucket").agg(F.max(id_col).alias("top"))  # at most most_buckets + 1 rows
    down = Window.orderBy(F.col("__bucket").desc())
    following = F.coalesce(F.lead(F.struct("top")).over(down), F.first(F.struct("top")).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    links = tops.select(F.col("__bucket").alias("__to"), following.alias("f")).select("__to", F.col("f.top").alias("__top"))
    extra = rows.join(F.broadcast(links), F.col(id_col).eqNullSafe(F.col("__top"))).withColumns({"__bucket": F.col("__to"), "__extra": F.lit(1)}).select(*rows.columns)
    every = rows.unionByName(extra)
    order = Window.partitionBy("__bucket").orderBy("__extra", F.col(id_col).desc_nulls_last(), text_col)
    every = every.withColumn("next_text", F.lead(text_col).over(order))
    if signature:
        every = with_signature(every, text_col, signature, cfg).withColumn("next_signature", F.lead(signature).over(order))
    return every.where("__extra = 0").drop("__bucket", "__extra")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: OrderConfig = OrderConfig()) -> DataFrame:
    """``id_col, text, edited, signature, edited_signature, next_signature`` for each document and its edited
    text: the last half of its code points replaced by as many (or all) first ones of the next document."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, id_col, "text", cfg, "signature")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr(F.col("next_text"), F.lit(1), half)))
    return with_signature(rows, "edited", "edited_signature", cfg).drop("next_text")
