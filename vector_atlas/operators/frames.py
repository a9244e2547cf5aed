"""Summaries of frame-level signals, and the resumable feature job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vector_atlas.functions import arrays
from vector_atlas.operators.joins import pending_ids, upsert_keep_last

MIN_MATRIX_FRAMES = 8
N_BANDS = 5

# fixed values: columns of each feature group
FEATURE_GROUPS = {
    "rhythm": [
        "tempo_bpm", "onset_strength_mean", "onset_strength_std",
        "beat_interval_mean", "beat_interval_std", "beat_interval_cv",
        "bpm_first_peak", "bpm_first_weight", "bpm_first_spread",
        "bpm_second_peak", "bpm_second_weight", "bpm_second_spread",
        "bpm_peak_ratio", "bpm_histogram_entropy",
        "rhythm_transform_mean", "rhythm_transform_std", "rhythm_transform_max", "rhythm_transform_entropy",
        "beats_loudness_mean", "beats_loudness_std", "beats_low_ratio", "beats_mid_ratio", "beats_high_ratio",
    ],
    "spectral": [
        "mfcc_1_mean", "mfcc_2_mean", "mfcc_3_mean", "mfcc_4_mean", "mfcc_5_mean",
        "spectral_centroid_mean", "spectral_centroid_std", "spectral_contrast_mean",
        "inharmonicity_mean", "inharmonicity_std",
    ],
    "tonal": [
        "chroma_entropy", "major_alignment", "minor_alignment",
        "hpcp_0", "hpcp_1", "hpcp_2", "hpcp_3", "hpcp_4", "hpcp_5",
        "hpcp_6", "hpcp_7", "hpcp_8", "hpcp_9", "hpcp_10", "hpcp_11",
        "hpcp_entropy", "hpcp_std", "hpcp_max", "hpcp_temporal_std",
        "key_strength", "is_minor", "key_cos", "key_sin",
    ],
}


def frame_signal(signal: DataFrame, size: int, hop: int) -> DataFrame:
    """``item_id, frame, samples``: overlapping full frames; a signal shorter than one frame gives none."""
    last = F.size("samples") - F.lit(size)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(hop)))
    return (
        signal.withColumn("__start", F.explode(starts))
        .select(
            "item_id",
            (F.col("__start") / hop).cast("int").alias("frame"),
            F.slice("samples", F.col("__start") + 1, size).alias("samples"),
        )
    )


def spectrum_frames(frames: DataFrame, sample_rate: float) -> DataFrame:
    """Hann-windowed magnitude spectrum of each frame and its centroid in Hz (0 for silence)."""
    @F.pandas_udf("spectrum array<double>, centroid double")
    def spectrum(samples: pd.Series) -> pd.DataFrame:
        block = np.stack(samples.to_numpy()).astype("float64")
        size = block.shape[1]
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        magnitude = np.abs(np.fft.rfft(block * window, axis=1))
        frequency = np.fft.rfftfreq(size, 1.0 / sample_rate)
        mass = magnitude.sum(axis=1)
        centroid = np.divide(magnitude @ frequency, mass, out=np.zeros(len(block)), where=mass > 0)
        return pd.DataFrame({"spectrum": list(magnitude), "centroid": centroid})

    return frames.withColumn("__s", spectrum("samples")).select("item_id", "frame", "__s.spectrum", "__s.centroid")


def frame_stats(values: DataFrame, items: DataFrame | None = None, keep=None) -> DataFrame:
    """Mean and population deviation of ``values(item_id, value)``; items without frames get zeros."""
    used = values if keep is None else values.where(keep)
    stats = used.groupBy("item_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    if items is None:
        return stats
    return items.select("item_id").join(stats, "item_id", "left").na.fill(0.0, ["mean", "std"])


def filtered_frame_stats(values: DataFrame, items: DataFrame) -> DataFrame:
    """Like ``frame_stats`` over frames with a pitch, more than one peak and a valid value."""
    valid = (F.col("pitch") > 0) & (F.col("peaks") > 1) & (F.col("value") >= 0) & ~F.isnan("value")
    return frame_stats(values, items, valid)


def _bin_checks(bins, width: int):
    return F.when(F.size(bins) == width, F.col(bins)).otherwise(
        F.raise_error(F.lit(f"every frame needs {width} bins")).cast("array<double>")
    )


def bin_stats(frames: DataFrame, width: int) -> DataFrame:
    """``item_id, bin, mean, std``: counted per (item, bin) with partial sums on the map side."""
    return (
        frames.select("item_id", F.posexplode(_bin_checks("bins", width)).alias("bin", "v"))
        .groupBy("item_id", "bin")
        .agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    )


def _ordered(column: str):
    return F.array_sort(F.collect_list(F.struct("bin", column)))[column]


def frame_vector_mean(frames: DataFrame, width: int) -> DataFrame:
    """``item_id, bins``: mean profile of each item; any other width fails."""
    return bin_stats(frames, width).groupBy("item_id").agg(_ordered("mean").alias("bins"))


def scale_alignment(profiles: DataFrame) -> DataFrame:
    """Add entropy and the shares on the major and minor degrees of twelve-bin profiles."""
    return profiles.select(
        "item_id",
        arrays.histogram_entropy("bins").alias("entropy"),
        arrays.degree_share("bins", arrays.MAJOR_DEGREES).alias("major_alignment"),
        arrays.degree_share("bins", arrays.MINOR_DEGREES).alias("minor_alignment"),
    )


def pitch_class_summary(frames: DataFrame, items: DataFrame, width: int = 12) -> DataFrame:
    """Entropy, deviation and maximum of the mean profile, and the mean deviation over time."""
    per_item = (
        bin_stats(frames, width)
        .groupBy("item_id")
        .agg(
            _ordered("mean").alias("bins"),
            F.stddev_pop("mean").alias("std"),
            F.max("mean").alias("max"),
            F.avg("std").alias("temporal_std"),
        )
        .withColumn("entropy", arrays.histogram_entropy("bins"))
    )
    empty = F.array_repeat(F.lit(0.0), width)
    return (
        items.select("item_id")
        .join(per_item, "item_id", "left")
        .withColumn("bins", F.coalesce("bins", empty))
        .na.fill(0.0, ["std", "max", "temporal_std", "entropy"])
    )


def beat_intervals(beats: DataFrame, span: float = 60.0) -> DataFrame:
    """``item_id, interval`` between consecutive beats ``(item_id, t)``.

    Beats are ordered within stretches of ``span`` time units, so a long item is spread over
    many tasks; the gap between stretches comes from their first and last beats.
    """
    cut = beats.select("item_id", "t").withColumn("stretch", F.floor(F.col("t") / F.lit(span)))
    order = Window.partitionBy("item_id", "stretch").orderBy("t")
    inside = cut.withColumn("interval", F.col("t") - F.lag("t").over(order))
    ends = cut.groupBy("item_id", "stretch").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    by_stretch = Window.partitionBy("item_id").orderBy("stretch")
    between = ends.withColumn("interval", F.col("first") - F.lag("last").over(by_stretch))
    return (
        inside.select("item_id", "interval")
        .unionByName(between.select("item_id", "interval"))
        .where(F.col("interval").isNotNull())
    )


def interval_stats(intervals: DataFrame, items: DataFrame) -> DataFrame:
    """Mean, population deviation and their ratio; fewer than two intervals give zeros."""
    mean, std = F.avg("interval"), F.stddev_pop("interval")
    stats = (
        intervals.groupBy("item_id")
        .agg(F.count("*").alias("n"), mean.alias("mean"), std.alias("std"))
        .where("n >= 2")
        .select("item_id", "mean", "std", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0).alias("cv"))
    )
    return items.select("item_id").join(stats, "item_id", "left").na.fill(0.0, ["mean", "std", "cv"])


def tempo_peaks(intervals: DataFrame) -> DataFrame:
    """Histogram of beats per minute in whole-number bins, its two highest bins and its entropy, for items of
    at least two intervals.

    The peaks are the two fullest bins (ties: lower tempo). A weight is the bin's share; the
    spread is the share of its two neighbours left outside: 1 - share(bin) / share(bin-1..bin+1).
    """
    bins = (
        intervals.where(F.col("interval") > 0)
        .withColumn("bpm", F.round(60.0 / F.col("interval")).cast("long"))
        .groupBy("item_id", "bpm")
        .agg(F.count("*").alias("n"))
    )
    item = Window.partitionBy("item_id")
    by_bpm = item.orderBy("bpm").rangeBetween(-1, 1)
    shares = (
        bins.withColumn("total", F.sum("n").over(item))
        .where(F.col("total") >= 2)
        .withColumn("near", F.sum("n").over(by_bpm))
        .withColumn("place", F.row_number().over(item.orderBy(F.desc("n"), "bpm")))
        .withColumn("p", F.col("n") / F.col("total"))
        .withColumn("spread", 1.0 - F.col("n") / F.col("near"))
    )

    def peak(place, c):
        return F.coalesce(F.max(F.when(F.col("place") == place, F.col(c))).cast("double"), F.lit(0.0))

    p = F.greatest(F.col("p"), F.lit(arrays.ENTROPY_FLOOR))
    found = shares.groupBy("item_id").agg(
        peak(1, "bpm").alias("first_peak"),
        peak(1, "p").alias("first_weight"),
        peak(1, "spread").alias("first_spread"),
        peak(2, "bpm").alias("second_peak"),
        peak(2, "p").alias("second_weight"),
        peak(2, "spread").alias("second_spread"),
        F.sum(-p * F.log2(p)).alias("entropy"),
    )
    ratio = F.when(F.col("first_weight") > 0, F.col("second_weight") / F.col("first_weight")).otherwise(0.0)
    return found.withColumn("peak_ratio", ratio)


def interval_histogram(intervals: DataFrame, items: DataFrame) -> DataFrame:
    """``tempo_peaks`` for every item; zeros where there are fewer than two intervals."""
    found = tempo_peaks(intervals)
    names = [c for c in found.columns if c != "item_id"]
    return items.select("item_id").join(found, "item_id", "left").na.fill(0.0, names)


def band_ratio_summary(frames: DataFrame, items: DataFrame) -> DataFrame:
    """Loudness moments and mean low, mid and high shares of ``frames(item_id, loudness, bands)``."""
    def band(*index):
        return F.avg(sum((F.get("bands", F.lit(i)).cast("double") for i in index), F.lit(0.0)))

    stats = (
        frames.groupBy("item_id")
        .agg(
            F.avg("loudness").alias("loudness_mean"),
            F.stddev_pop("loudness").alias("loudness_std"),
            F.min(F.size("bands")).alias("width"),
            band(0, 1).alias("low"),
            band(2, 3).alias("mid"),
            band(4).alias("high"),
        )
    )
    wide = F.col("width") >= N_BANDS
    for name in ("low", "mid", "high"):
        stats = stats.withColumn(name, F.when(wide, F.col(name)).otherwise(0.0))
    names = ["loudness_mean", "loudness_std", "low", "mid", "high"]
    return items.select("item_id").join(stats.drop("width"), "item_id", "left").na.fill(0.0, names)


def matrix_summary(frames: DataFrame, items: DataFrame, min_frames: int = MIN_MATRIX_FRAMES) -> DataFrame:
    """Mean, deviation, maximum and entropy of absolute values over all cells of an item.

    With M = sum |v|, the entropy is log2 M - sum(|v| log2 |v|) / M, so one aggregate over
    cells is enough. Only a cell below 1e-12 of the mass is floored and counts nearly nothing.
    """
    mass = F.abs(F.col("v"))
    cells = frames.select("item_id", F.explode(arrays.doubles("bins")).alias("v"))
    stats = cells.groupBy("item_id").agg(
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.max("v").alias("max"),
        F.sum(mass).alias("__mass"),
        F.sum(F.when(mass > 0, mass * F.log2(mass)).otherwise(0.0)).alias("__mlog"),
    )
    enough = frames.groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_frames)
    entropy = F.when(F.col("__mass") > 0, F.log2("__mass") - F.col("__mlog") / F.col("__mass")).otherwise(0.0)
    names = ["mean", "std", "max", "entropy"]
    full = stats.withColumn("entropy", entropy).join(enough, "item_id", "left_semi").select("item_id", *names)
    return items.select("item_id").join(full, "item_id", "left").na.fill(0.0, names)


def feature_columns(groups) -> list[str]:
    unknown = [g for g in groups if g not in FEATURE_GROUPS]
    if unknown:
        raise ValueError(f"unknown feature groups {unknown}; known: {list(FEATURE_GROUPS)}")
    return [c for g in dict.fromkeys(groups) for c in FEATURE_GROUPS[g]]


def feature_job(
    items: DataFrame,
    feature: Callable[[object], dict],
    columns: list[str],
    existing: DataFrame | None = None,
    force: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Compute ``columns`` for pending ``items(song_id, content)``: ``(merged table, failures)``.

    ``feature`` handles one item and returns a dict. A failing item becomes a failure row.
    The computed rows are written once, because both results read them.
    """
    from vector_atlas.session import materialise

    schema = T.StructType(
        [T.StructField("song_id", T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in columns]
        + [T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for song_id, content in zip(frame["song_id"], frame["content"]):
                try:
                    values = feature(content)
                    rows.append([song_id, *[float(values[c]) for c in columns], None])
                except Exception as failure:
                    rows.append([song_id, *[None] * len(columns), str(failure)])
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    existing = None if force else existing
    pending = pending_ids(items.select("song_id", "content"), existing)
    done = materialise(pending.mapInPandas(run, schema), "features")
    good = done.where(F.col("error").isNull()).drop("error")
    failures = done.where(F.col("error").isNotNull()).select("song_id", "error")
    if existing is None and good.isEmpty():
        raise RuntimeError("no item gave features")
    return upsert_keep_last(existing, good), failures
