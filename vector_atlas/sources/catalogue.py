"""Nested catalogue JSON to flat track rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vector_atlas.schemas import USER_TRACK_STRUCT

_ITEMS = T.StructType([T.StructField("items", T.ArrayType(T.StringType()))])
_NESTED = T.StructType([T.StructField("track", T.StringType())])
_ARTIST = T.StructType([T.StructField("name", T.StringType())])
# fixed values: columns of a flat user track
FLAT_COLUMNS = (
    "id", "name", "artists", "isrc", "link", "preview_url", "popularity", "duration_ms", "cover_url",
)


def _artist_names(artists: Column) -> Column:
    """Artists arrive as objects with a name, or as plain names."""
    objects = F.filter(artists, lambda a: a.startswith("{"))
    names = F.transform(
        objects, lambda a: F.coalesce(F.from_json(a, _ARTIST).getField("name"), F.lit(""))
    )
    plain = F.coalesce(artists, F.array().cast("array<string>"))
    return F.when(F.size(names) > 0, names).otherwise(plain)


def _has_key(text: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(text), key)


def flatten_catalogue_json(df: DataFrame, source: str = "track_json") -> DataFrame:
    """Replace the JSON text in ``source`` by flat columns.

    A key that is present directly wins over the nested value, even when it is null. A cell
    that is not a JSON object gives nulls.
    """
    text = F.col(source)
    track = F.col("__track")
    image = F.get(track["album"]["images"], F.lit(0))["url"]
    nested = {
        "isrc": track["external_ids"]["isrc"],
        "link": track["external_urls"]["spotify"],
        "cover_url": image,
    }
    flat = []
    for name in FLAT_COLUMNS:
        if name == "artists":
            value = _artist_names(track["artists"])
        elif name in nested:
            value = F.when(_has_key(text, name), track[name]).otherwise(nested[name])
        else:
            value = track[name]
        flat.append(value.alias(name))
    others = [c for c in df.columns if c != source]
    return df.withColumn("__track", F.from_json(text, USER_TRACK_STRUCT)).select(*others, *flat)


def explode_catalogue_items(df: DataFrame, source: str = "items_json", nested: bool = True) -> DataFrame:
    """One row per usable track of a JSON item list, with its ``position`` in the list.

    Entries that are not objects, have no id, or carry a type other than ``track`` are
    dropped; a missing type counts as a track.
    """
    others = [c for c in df.columns if c != source]
    # a list may come bare or under an ``items`` key
    text = F.col(source)
    wrapped = F.when(F.btrim(text).startswith("["), F.concat(F.lit('{"items":'), text, F.lit("}"))).otherwise(text)
    entries = df.select(
        *others, F.posexplode(F.from_json(wrapped, _ITEMS).getField("items")).alias("position", "item")
    )
    item = F.col("item")
    raw = F.from_json(item, _NESTED).getField("track") if nested else item
    kept = (
        entries.withColumn("track_json", raw)
        .where(F.btrim("track_json").startswith("{"))
        .withColumn("__id", F.get_json_object("track_json", "$.id"))
        .withColumn("__type", F.get_json_object("track_json", "$.type"))
        .where(
            (F.coalesce("__id", F.lit("")) != "")
            & (F.when(_has_key(F.col("track_json"), "type"), F.col("__type")).otherwise(F.lit("track")) == "track")
        )
        .drop("item", "__id", "__type")
    )
    return flatten_catalogue_json(kept, "track_json")
