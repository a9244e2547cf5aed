"""Tag-list expressions. A tag cell is a comma-joined string; null and blank mean no tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def split_tags(c) -> Column:
    """Ordered tags of a cell; duplicates and case are kept, empty parts dropped."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), ","), strip)
    return F.filter(parts, lambda tag: tag != "")


def lower_tags(c) -> Column:
    """Cell with every tag in lower case, joined again."""
    return F.array_join(F.transform(split_tags(c), F.lower), ", ")


def is_blank(c) -> Column:
    return strip(F.coalesce(_col(c), F.lit(""))) == ""


def main_genres(c, taxonomy: dict[str, list[str]], excluded=()) -> Column:
    """Map source genres to main genres, keeping the order of first appearance.

    The taxonomy is configuration of a few dozen entries and becomes one map literal;
    genres that are excluded or not listed have no entry and fall out.
    """
    lookup: dict[str, str] = {}
    for main, sources in taxonomy.items():
        for source in sources:
            if source not in excluded:
                lookup.setdefault(source, main)
    if not lookup:
        return F.lit("")
    table = F.create_map(*[F.lit(x) for pair in lookup.items() for x in pair])
    mapped = F.transform(split_tags(c), lambda tag: F.try_element_at(table, tag))
    return F.array_join(F.array_distinct(F.filter(mapped, lambda g: g.isNotNull())), ", ")


# fixed values
GENRE_TAXONOMY = {
    "Rock/Pop": ["Pop/Rock"],
    "Electronic": ["Electronic", "Easy Listening"],
    "Hip-Hop/Rap": ["Rap"],
    "R&B/Soul": ["R&B"],
    "Jazz": ["Jazz"],
    "Classical": ["Classical"],
    "Folk/Country": ["Folk", "Country"],
    "Blues": ["Blues"],
    "World": ["International", "Latin", "Reggae"],
    "Experimental": ["Avant-Garde", "New Age"],
}
EXCLUDED_GENRES = (
    "Children's",
    "Holiday",
    "Religious",
    "Comedy/Spoken",
    "Stage & Screen",
    "Vocal",
)
LOWERED_COLUMNS = ("mood", "mood_all", "theme", "style")
