"""Checks, centring, normalisation and encoding of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vector_atlas.functions import arrays


def vector_checks(vectors: DataFrame, k: int) -> DataFrame:
    """One row of facts and the first violated rule (null when all hold)."""
    facts = vectors.agg(
        F.count("*").alias("n_items"),
        F.coalesce(F.min(F.size("embedding")), F.lit(0)).alias("dim_min"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim_max"),
        F.count(F.when(~arrays.all_finite("embedding"), 1)).alias("n_non_finite"),
    )
    problem = (
        F.when(F.col("dim_min") != F.col("dim_max"), "vectors differ in dimension")
        .when(F.col("n_items") < 2, "at least 2 vectors are needed")
        .when(~((F.lit(k) > 0) & (F.lit(k) < F.col("n_items"))), "k must be positive and below the number of vectors")
        .when(F.col("n_non_finite") > 0, "vectors must be finite")
    )
    return facts.withColumn("problem", problem)


def validate_vectors(vectors: DataFrame, k: int) -> int:
    """Raise on the first violated rule, else return the number of vectors (one aggregate job)."""
    row = vector_checks(vectors, k).first()
    if row["problem"] is not None:
        raise ValueError(f"{row['problem']}: {row.asDict()}")
    return row["n_items"]


def mean_vector(vectors: DataFrame) -> DataFrame:
    """One row: ``mean array<double>`` (no row without vectors); partial sums are merged on the JVM side."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding")))
    return vectors.groupBy(F.lit(0).alias("all")).agg(vector_to_array(mean).alias("mean")).drop("all")


def center_vectors(vectors: DataFrame, mean: DataFrame, center: bool = True) -> DataFrame:
    """Subtract the corpus mean, attached as a scalar subquery rather than a join."""
    if not center:
        return vectors
    return vectors.withColumn("__mean", mean.select("mean").scalar()).select(
        *[c for c in vectors.columns if c != "embedding"],
        arrays.subtract("embedding", "__mean").alias("embedding"),
    )


def l2_normalize(vectors: DataFrame, floor: float = 0.0, strict: bool = True) -> DataFrame:
    """Divide by the norm. A norm at or below ``floor`` fails the job, or drops the row if not strict."""
    with_norm = vectors.withColumn("__norm", arrays.norm("embedding"))
    if strict:
        problem = F.raise_error(F.lit("zero-norm vector cannot be normalised"))
        norm = F.when(F.col("__norm") <= floor, problem.cast("double")).otherwise(F.col("__norm"))
    else:
        with_norm = with_norm.where(F.col("__norm") > floor)
        norm = F.col("__norm")
    return with_norm.select(
        *[c for c in vectors.columns if c != "embedding"],
        arrays.scale_down("embedding", norm).alias("embedding"),
    )


def prepare_query(queries: DataFrame, meta: DataFrame) -> DataFrame:
    """Centre with the stored mean when the index was centred, then always normalise."""
    stored = meta.select(F.when(F.col("center"), F.col("mean").cast("array<double>")).alias("mean"))
    shifted = queries.withColumn("__mean", stored.scalar()).select(
        *[c for c in queries.columns if c != "embedding"],
        F.when(F.col("__mean").isNull(), arrays.doubles("embedding"))
        .otherwise(arrays.subtract("embedding", "__mean"))
        .alias("embedding"),
    )
    return l2_normalize(shifted, floor=arrays.ZERO_NORM)


def cosine_score(pairs: DataFrame, left: str, right: str, target: str = "score") -> DataFrame:
    """Dot product of two unit-vector columns."""
    return pairs.withColumn(target, arrays.dot(left, right))


class Encoder(Protocol):
    """What a model must offer: fixed width, expected sample rate, batch encoding."""

    dim: int
    sample_rate: int

    def embed_audio(self, audio: list[np.ndarray]) -> np.ndarray: ...

    def embed_text(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Deterministic default encoder: signed token hashing for text, folded samples for audio."""

    def __init__(self, dim: int = 32, sample_rate: int = 44100):
        self.dim = dim
        self.sample_rate = sample_rate
        self._slots: dict[str, tuple[int, float]] = {}

    def _slot(self, token: str) -> tuple[int, float]:
        slot = self._slots.get(token)
        if slot is None:
            digest = hashlib.md5(token.encode()).hexdigest()
            slot = (int(digest[:8], 16) % self.dim, 1.0 if digest[8] < "8" else -1.0)
            if len(self._slots) < 1_000_000:
                self._slots[token] = slot
        return slot

    def embed_text(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            slots = [self._slot(token) for token in text.split()]
            if slots:
                index, sign = zip(*slots)
                out[row] = np.bincount(index, weights=sign, minlength=self.dim)
        return out

    def embed_audio(self, audio: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(audio), self.dim))
        for row, samples in enumerate(audio):
            np.add.at(out[row], np.arange(len(samples)) % self.dim, samples)
        return out


ENCODED_SCHEMA = "item_id string, embedding array<double>, error string"


def encode_items(
    items: DataFrame,
    encoder: Callable[[], Encoder],
    kind: str = "text",
    batch_size: int = 8,
    partitions: int | None = None,
) -> DataFrame:
    """Encode ``items(item_id, content)``; a failing item yields an error row and the rest go on.

    The factory runs once per task. ``content`` is text, or an array of samples for audio.
    ``partitions`` spreads the rows first, for inputs with fewer splits than there are cores.
    """
    if partitions is not None:
        items = items.select("item_id", "content").repartition(partitions)
    if kind not in ("text", "audio"):
        raise ValueError(f"kind must be text or audio, got {kind!r}")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()

        def run(contents: list) -> np.ndarray:
            rows = model.embed_text(contents) if kind == "text" else model.embed_audio(contents)
            rows = np.asarray(rows, dtype="float64")
            if rows.shape != (len(contents), model.dim):
                raise ValueError(f"expected {(len(contents), model.dim)} encoded values, got {rows.shape}")
            return rows

        def one(item_id, content):
            try:
                if content is None:
                    raise ValueError("no content")
                return item_id, run([content])[0].tolist(), None
            except Exception as failure:
                return item_id, None, str(failure)

        for frame in batches:
            done = []
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                ids, contents = part["item_id"].tolist(), part["content"].tolist()
                try:
                    rows = run(contents)
                    done.extend((i, r.tolist(), None) for i, r in zip(ids, rows))
                except Exception:
                    done.extend(one(i, c) for i, c in zip(ids, contents))
            yield pd.DataFrame(done, columns=["item_id", "embedding", "error"])

    return items.select("item_id", "content").mapInPandas(encode, ENCODED_SCHEMA)


def finish_embedding(encoded: DataFrame, center: bool = True, normalize: bool = True) -> tuple[DataFrame, DataFrame]:
    """Centre and normalise the rows that were encoded; also return the mean (zeros when not centring).

    Pass a written table: the mean and the rows are two reads of it.
    """
    good = encoded.where(F.col("error").isNull()).select("item_id", "embedding")
    mean = mean_vector(good)
    if not center:
        mean = mean.select(F.transform("mean", lambda x: F.lit(0.0)).alias("mean"))
    vectors = center_vectors(good, mean, center)
    if normalize:
        vectors = l2_normalize(vectors)
    return vectors, mean


def embed_items(
    items: DataFrame,
    config,
    encoder: Callable[[], Encoder] = HashingEncoder,
    kind: str = "text",
    partitions: int | None = None,
):
    """Whole job: encode once, fail when nothing was encoded, centre, normalise, describe.

    Returns ``(vectors, meta, failures)``.
    """
    from vector_atlas.session import materialise

    encoded = materialise(encode_items(items, encoder, kind, config.batch_size, partitions), "encoded")
    if encoded.where(F.col("error").isNull()).isEmpty():
        raise RuntimeError("no item could be encoded")
    vectors, mean = finish_embedding(encoded, config.center, config.normalize)
    meta = mean.select(
        F.col("mean").cast("array<float>").alias("mean"),
        F.lit(config.center).alias("center"),
        F.lit(config.normalize).alias("normalize"),
        F.lit(config.name).alias("name"),
        F.lit(config.model_id).alias("model_id"),
        F.lit(encoder().sample_rate).alias("sample_rate"),
    )
    failures = encoded.where(F.col("error").isNotNull()).select("item_id", "error")
    return vectors, meta, failures


def vector_matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Arrow list column to a dense matrix without going through Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    rows = len(column)
    width = dim if dim is not None else (len(flat) // rows if rows else 0)
    return flat.reshape(rows, width)
