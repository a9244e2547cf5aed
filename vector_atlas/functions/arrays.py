"""Numeric array expressions: vectors, histograms and twelve-bin profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vector_atlas.functions.tags import _col

ZERO_NORM = 1e-12
ENTROPY_FLOOR = 1e-12

# fixed values: scale degrees and key numbers
MAJOR_DEGREES = (0, 2, 4, 5, 7, 9, 11)
MINOR_DEGREES = (0, 2, 3, 5, 7, 8, 10)
KEY_INDEX = {
    "C": 0, "C#": 1, "D": 2, "D#": 3, "E": 4, "F": 5,
    "F#": 6, "G": 7, "G#": 8, "A": 9, "A#": 10, "B": 11,
}


def doubles(c) -> Column:
    return _col(c).cast("array<double>")


def total(c) -> Column:
    return F.aggregate(doubles(c), F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(c) -> Column:
    return F.sqrt(dot(c, c))


def all_finite(c) -> Column:
    return ~F.exists(doubles(c), lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def subtract(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def scale_down(c, by: Column) -> Column:
    """Divide by one number per row; the divisor is evaluated once, not per element."""
    return F.zip_with(doubles(c), F.array_repeat(by, F.size(_col(c))), lambda x, y: x / y)


def pad_or_trim(c, length: int) -> Column:
    """Exactly ``length`` values, filled with zeros at the end."""
    return F.slice(F.concat(doubles(c), F.array_repeat(F.lit(0.0), length)), 1, length)


def histogram_entropy(c) -> Column:
    """Base-2 entropy of non-negative weights, not normalised; no mass gives 0."""
    mass = total(c)
    shares = F.zip_with(doubles(c), F.array_repeat(mass, F.size(_col(c))), lambda x, m: x / m)
    bits = F.transform(
        shares,
        lambda p: F.least(F.greatest(p, F.lit(ENTROPY_FLOOR)), F.lit(1.0)),
    )
    return F.when(mass > 0, total(F.transform(bits, lambda p: -p * F.log2(p)))).otherwise(0.0)


def degree_share(c, degrees) -> Column:
    """Share of the twelve-bin mass that falls on the given scale degrees."""
    mass = total(c)
    on_scale = sum((F.element_at(doubles(c), d + 1) for d in degrees), F.lit(0.0))
    return F.when(mass > 0, on_scale / mass).otherwise(0.0)


def key_index(key) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KEY_INDEX.items() for x in pair])
    return F.coalesce(F.try_element_at(table, _col(key)), F.lit(0))


def key_circular(key, scale) -> dict[str, Column]:
    angle = key_index(key) / F.lit(12.0) * F.lit(2 * math.pi)
    return {
        "key_cos": F.cos(angle),
        "key_sin": F.sin(angle),
        "is_minor": F.when(_col(scale) == "minor", 1.0).otherwise(0.0),
    }
