"""The acoustic row: all features of an item from its frame tables, in one grouping.

Frame tables of different shapes become one tagged table; every summary is a conditional aggregate of
a single grouping by item, whose sums are formed before anything is shuffled. Only what needs an order
(gaps between beats) or a grouping of its own (the histogram of tempos) is computed before, and enters
the union as rows of its own. Vectors are summed bin by bin, so no list of frames is ever built.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vector_atlas.functions import arrays
from vector_atlas.operators.frames import MIN_MATRIX_FRAMES, N_BANDS, beat_intervals, feature_columns, tempo_peaks

N_MFCC = 5
N_PITCHES = 12


@dataclass(frozen=True)
class FrameTables:
    """What is known of the items; a missing table leaves its features at zero.

    ``tempo(item_id, bpm)`` and ``key(item_id, strength, key, scale)`` have one row per item. The others have a row
    per frame: ``onset`` and ``centroid`` (``value``), ``beats`` (``t``), ``transform``, ``mfcc``, ``contrast``,
    ``chroma`` and ``hpcp`` (``bins``), ``loudness`` (``loudness, bands``), ``inharmonicity`` (``value, pitch, peaks``).
    """

    tempo: DataFrame | None = None
    key: DataFrame | None = None
    onset: DataFrame | None = None
    beats: DataFrame | None = None
    transform: DataFrame | None = None
    loudness: DataFrame | None = None
    mfcc: DataFrame | None = None
    centroid: DataFrame | None = None
    contrast: DataFrame | None = None
    inharmonicity: DataFrame | None = None
    chroma: DataFrame | None = None
    hpcp: DataFrame | None = None


GROUP_TABLES = {
    "rhythm": ("tempo", "onset", "beats", "transform", "loudness"),
    "spectral": ("mfcc", "centroid", "contrast", "inharmonicity"),
    "tonal": ("chroma", "hpcp", "key"),
}


def _wide(bins, width: int) -> Column:
    return F.when(F.size(bins) == width, arrays.doubles(bins)).otherwise(
        F.raise_error(F.lit(f"every frame needs {width} bins")).cast("array<double>"))


def _cells(bins: Column):
    """Sums over the cells of a frame: of values, squares, absolute values and |v| log2 |v|."""
    def total(f):
        return F.aggregate(bins, F.lit(0.0), lambda a, v: a + f(v))

    def entropy_part(v):
        return F.when(v != 0, F.abs(v) * F.log2(F.abs(v))).otherwise(0.0)

    return F.array(total(lambda v: v), total(lambda v: v * v), total(F.abs), total(entropy_part), F.size(bins).cast("double"), F.array_max(bins))


def tagged_rows(tables: FrameTables, span: float) -> DataFrame | None:
    """``item_id, tag, value, extra, bins``: the rows of all tables that are given."""
    none = F.lit(None)
    parts = []

    def add(tag: str, rows: DataFrame, value: Column = none, extra: Column = none, bins: Column = none):
        parts.append(rows.select(
            F.col("item_id").cast("string").alias("item_id"), F.lit(tag).alias("tag"), value.cast("double").alias("value"),
            extra.cast("double").alias("extra"), bins.cast("array<double>").alias("bins")))

    if tables.tempo is not None:
        add("tempo", tables.tempo, F.col("bpm"))
    if tables.key is not None:
        around = arrays.key_circular("key", "scale")
        add("key", tables.key, F.col("strength"), bins=F.array(around["is_minor"], around["key_cos"], around["key_sin"]))
    for tag in ("onset", "centroid"):
        rows = getattr(tables, tag)
        if rows is not None:
            add(tag, rows, F.col("value"))
    if tables.beats is not None:
        intervals = beat_intervals(tables.beats, span)
        add("interval", intervals, F.col("interval"))
        peaks = tempo_peaks(intervals)
        add("peaks", peaks, bins=F.array(*[F.col(c).cast("double") for c in PEAK_COLUMNS]))
    for tag in ("transform", "contrast"):
        rows = getattr(tables, tag)
        if rows is not None:
            add(tag, rows, bins=_cells(arrays.doubles("bins")))
    if tables.loudness is not None:
        bands = [F.coalesce(F.get("bands", F.lit(i)).cast("double"), F.lit(0.0)) for i in range(N_BANDS)]
        add("loudness", tables.loudness, F.col("loudness"), F.size("bands"), F.array(bands[0] + bands[1], bands[2] + bands[3], bands[4]))
    if tables.inharmonicity is not None:
        valid = (F.col("pitch") > 0) & (F.col("peaks") > 1) & (F.col("value") >= 0) & ~F.isnan("value")
        add("inharmonicity", tables.inharmonicity.where(valid), F.col("value"))
    for tag, width in (("mfcc", N_MFCC), ("chroma", N_PITCHES), ("hpcp", N_PITCHES)):
        rows = getattr(tables, tag)
        if rows is not None:
            add(tag, rows, bins=_wide("bins", width))
    return reduce(DataFrame.unionByName, parts) if parts else None


PEAK_COLUMNS = ("first_peak", "first_weight", "first_spread", "second_peak", "second_weight", "second_spread", "peak_ratio", "entropy")


def acoustic_rows(items: DataFrame, tables: FrameTables, groups=("rhythm", "spectral", "tonal"), span: float = 60.0) -> DataFrame:
    """``item_id`` and the feature columns of ``groups``, one row for each of ``items``; what is not known is 0.

    ``span`` is the stretch of time in which beats are ordered. Items without any frame have zeros throughout.
    """
    columns = feature_columns(groups)
    wanted = {t for g in groups for t in GROUP_TABLES[g]}
    tables = FrameTables(**{f.name: getattr(tables, f.name) for f in fields(FrameTables) if f.name in wanted})
    rows = tagged_rows(tables, span)
    known = items.select(F.col("item_id").cast("string").alias("item_id")).distinct()
    if rows is None:
        return known.select("item_id", *[F.lit(0.0).alias(c) for c in columns])

    def when(tag, c):
        return F.when(F.col("tag") == tag, c)

    def bin_of(tag, i):
        return when(tag, F.get("bins", F.lit(i)))

    sums = [F.count(when(t, 1)).alias(f"n_{t}") for t in ("interval", "transform", "loudness", "chroma", "hpcp")]
    for tag in ("onset", "centroid", "interval", "loudness", "inharmonicity"):
        sums += [F.avg(when(tag, F.col("value"))).alias(f"{tag}_avg"), F.stddev_pop(when(tag, F.col("value"))).alias(f"{tag}_dev")]
    sums += [F.max(when(t, F.col("value"))).alias(f"{t}_one") for t in ("tempo", "key")]
    sums += [F.max(bin_of("key", i)).alias(f"key_{i}") for i in range(3)]
    sums += [F.max(bin_of("peaks", i)).alias(f"peaks_{i}") for i in range(len(PEAK_COLUMNS))]
    sums += [F.sum(bin_of(t, i)).alias(f"{t}_{i}") for t in ("transform", "contrast") for i in range(5)]
    sums += [F.max(bin_of("transform", 5)).alias("transform_top")]
    sums += [F.min(when("loudness", F.col("extra"))).alias("band_width")] + [F.avg(bin_of("loudness", i)).alias(f"band_{i}") for i in range(3)]
    sums += [F.avg(bin_of("mfcc", i)).alias(f"mfcc_{i}") for i in range(N_MFCC)]
    sums += [F.avg(bin_of(t, i)).alias(f"{t}_{i}") for t in ("chroma", "hpcp") for i in range(N_PITCHES)]
    sums += [F.stddev_pop(bin_of("hpcp", i)).alias(f"hpcp_dev_{i}") for i in range(N_PITCHES)]
    wide = rows.groupBy("item_id").agg(*sums)

    c = F.col
    enough = c("n_transform") >= MIN_MATRIX_FRAMES
    beats = c("n_interval") >= 2
    bands = c("band_width") >= N_BANDS
    mean = c("transform_0") / c("transform_4")
    chroma, hpcp = (F.array(*[c(f"{t}_{i}") for i in range(N_PITCHES)]) for t in ("chroma", "hpcp"))
    hpcp_mean = sum((c(f"hpcp_{i}") for i in range(1, N_PITCHES)), c("hpcp_0")) / N_PITCHES
    hpcp_squares = sum(((c(f"hpcp_{i}") - hpcp_mean) * (c(f"hpcp_{i}") - hpcp_mean) for i in range(1, N_PITCHES)), (c("hpcp_0") - hpcp_mean) * (c("hpcp_0") - hpcp_mean))
    values = {
        "tempo_bpm": c("tempo_one"), "onset_strength_mean": c("onset_avg"), "onset_strength_std": c("onset_dev"),
        "beat_interval_mean": F.when(beats, c("interval_avg")), "beat_interval_std": F.when(beats, c("interval_dev")),
        "beat_interval_cv": F.when(beats & (c("interval_avg") > 0), c("interval_dev") / c("interval_avg")),
        **dict(zip(("bpm_first_peak", "bpm_first_weight", "bpm_first_spread", "bpm_second_peak", "bpm_second_weight", "bpm_second_spread", "bpm_peak_ratio", "bpm_histogram_entropy"),
                   [c(f"peaks_{i}") for i in range(len(PEAK_COLUMNS))])),
        "rhythm_transform_mean": F.when(enough, mean),
        "rhythm_transform_std": F.when(enough, F.sqrt(F.greatest(c("transform_1") / c("transform_4") - mean * mean, F.lit(0.0)))),
        "rhythm_transform_max": F.when(enough, c("transform_top")),
        "rhythm_transform_entropy": F.when(enough & (c("transform_2") > 0), F.log2("transform_2") - c("transform_3") / c("transform_2")),
        "beats_loudness_mean": c("loudness_avg"), "beats_loudness_std": c("loudness_dev"),
        **{f"beats_{name}_ratio": F.when(bands, c(f"band_{i}")) for i, name in enumerate(("low", "mid", "high"))},
        **{f"mfcc_{i + 1}_mean": c(f"mfcc_{i}") for i in range(N_MFCC)},
        "spectral_centroid_mean": c("centroid_avg"), "spectral_centroid_std": c("centroid_dev"),
        "spectral_contrast_mean": F.when(c("contrast_4") > 0, c("contrast_0") / c("contrast_4")),
        "inharmonicity_mean": c("inharmonicity_avg"), "inharmonicity_std": c("inharmonicity_dev"),
        "chroma_entropy": arrays.histogram_entropy(chroma),
        "major_alignment": arrays.degree_share(chroma, arrays.MAJOR_DEGREES), "minor_alignment": arrays.degree_share(chroma, arrays.MINOR_DEGREES),
        **{f"hpcp_{i}": c(f"hpcp_{i}") for i in range(N_PITCHES)},
        "hpcp_entropy": arrays.histogram_entropy(hpcp), "hpcp_std": F.sqrt(hpcp_squares / N_PITCHES), "hpcp_max": F.array_max(hpcp),
        "hpcp_temporal_std": sum((c(f"hpcp_dev_{i}") for i in range(1, N_PITCHES)), c("hpcp_dev_0")) / N_PITCHES,
        "key_strength": c("key_one"), "is_minor": c("key_0"), "key_cos": c("key_1"), "key_sin": c("key_2"),
    }
    needs = {"chroma": ("chroma_entropy", "major_alignment", "minor_alignment"), "hpcp": ("hpcp_entropy", "hpcp_std", "hpcp_max", "hpcp_temporal_std")}
    for tag, names in needs.items():
        values.update({name: F.when(c(f"n_{tag}") > 0, values[name]) for name in names})
    filled = [F.coalesce(values[name].cast("double"), F.lit(0.0)).alias(name) for name in columns]
    return known.join(wide, "item_id", "left").select("item_id", *filled)
