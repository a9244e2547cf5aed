"""Name normalisation and fuzzy name similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vector_atlas.functions.tags import _col

# fixed values: what is cut from a lower-cased ASCII name, in this order
_SPACE = r"[\s\x0B\x1C-\x1F]"
FEATURE_TAIL = rf"{_SPACE}+[\(\[]?{_SPACE}*(?:feat|ft|featuring|with)\b\.?{_SPACE}[^\n]*"
BRACKETED = r"[\(\[][^\n]*?[\)\]]"
PUNCTUATION = r"[^\w\s\x0B\x1C-\x1F]"
SPACES = rf"{_SPACE}+"


@F.pandas_udf(T.StringType())
def _to_ascii(names: pd.Series) -> pd.Series:
    """Compatibility decomposition; what has no ASCII form is dropped."""
    return names.map(
        lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()
    )


def ascii_fold(c) -> Column:
    return _to_ascii(_col(c))


def strip_name(c) -> Column:
    """The part of the normalisation that works on ASCII text, in plain expressions."""
    text = F.lower(_col(c))
    text = F.regexp_replace(text, FEATURE_TAIL, "")
    text = F.regexp_replace(text, BRACKETED, " ")
    text = F.regexp_replace(text, PUNCTUATION, " ")
    return F.btrim(F.regexp_replace(text, SPACES, " "))


def normalize_name(df, source: str, target: str):
    """Add ``target``: the comparable form of the name in ``source`` (null -> blank).

    Only rows with non-ASCII text pass through Python; distinct batches of the rest stay
    in generated code, because the UDF input of an ASCII row is null.
    """
    raw = F.coalesce(F.col(source), F.lit(""))
    foreign = raw.rlike(r"[^\x00-\x7F]")
    folded = "__folded"
    return (
        df.withColumn(folded, _to_ascii(F.when(foreign, raw)))
        .withColumn(target, strip_name(F.coalesce(F.col(folded), raw)))
        .drop(folded)
    )


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel over one big integer)."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """100 * (1 - insertions and deletions / total length); two blanks are equal."""
    out = []
    for a, b in zip(left, right):
        total = len(a) + len(b)
        out.append(100.0 if total == 0 else 200.0 * common_subsequence(a, b) / total)
    return pd.Series(out, dtype="float64")


def token_set_ratio(df, left: str, right: str, target: str):
    """Add ``target`` in 0..100 for two normalised names (blank on either side gives 0).

    Token sets are built with array expressions. The subsequence step runs on distinct
    combinations only where neither token set contains the other.
    """
    a, b = F.array_distinct(F.split(left, " ")), F.array_distinct(F.split(right, " "))
    df = (
        df.withColumn("__both", F.array_join(F.array_sort(F.array_intersect(a, b)), " "))
        .withColumn("__a", F.array_join(F.array_sort(F.array_except(a, b)), " "))
        .withColumn("__b", F.array_join(F.array_sort(F.array_except(b, a)), " "))
    )
    both, rest_a, rest_b = F.col("__both"), F.col("__a"), F.col("__b")
    glue = F.when(both == "", "").otherwise(" ")
    contained = (both != "") & ((rest_a == "") | (rest_b == ""))
    df = df.withColumn(
        "__edit",
        indel_ratio(
            F.when(contained, "").otherwise(F.concat(both, glue, rest_a)),
            F.when(contained, "").otherwise(F.concat(both, glue, rest_b)),
        ),
    )

    def appended(rest: Column) -> Column:
        # the shared tokens against themselves plus one rest differ only by the appended text
        extra = F.length(rest) + F.length(glue)
        return F.when(both == "", 0.0).otherwise(
            100.0 * 2.0 * F.length(both) / (2.0 * F.length(both) + extra)
        )

    ratio = (
        F.when((F.col(left) == "") | (F.col(right) == ""), 0.0)
        .when(contained, 100.0)
        .otherwise(F.greatest("__edit", appended(rest_a), appended(rest_b)))
    )
    return df.withColumn(target, ratio).drop("__both", "__a", "__b", "__edit")
