"""Document quality by nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled documents (``sample`` rows, drawn by a digest of the id; the bound is a
parameter) fits the space: square roots of relative frequencies of hashed byte trigrams and of three
repetition measures, inverse document frequencies, the sample's mean and its ``rank`` leading singular
directions. The sample's unit vectors and labels are broadcast (their size is fixed by the
parameters); every document of the corpus is compared with all of them by blocked matrix products, so
the neighbours are exact, and its ``neighbours`` nearest ones vote with weights by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vector_atlas.llm import textbuf
from vector_atlas.llm.tables import map_batches


@dataclass(frozen=True)
class VoteConfig:
    sample: int = 4096
    features: int = 1024  # hashed trigrams, before the repetition measures
    rank: int = 32
    neighbours: int = 15
    power: float = 2.0  # votes count similarity ** power
    seed: int = 29
    block: int = 256  # documents per matrix product


EXTRA = 3


def featurise(column, cfg: VoteConfig, powers, word_bytes):
    """``first row, rows x (features + EXTRA)`` for blocks of documents; null and empty texts are zero rows."""
    for lo, data, offs in textbuf.chunks(column, 1 << 19):
        words = textbuf.Words(data, offs, word_bytes, powers)
        rows = len(offs) - 1
        wide = data.astype(np.uint32)
        if len(data) > 2:
            code = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)
            code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(8)
            code = (code % np.uint32(cfg.features)).astype(np.int64)
        else:
            code = np.zeros(0, np.int64)
        for a in range(0, rows, cfg.block):
            b = min(a + cfg.block, rows)
            out = np.zeros((b - a, cfg.features + EXTRA), dtype=np.float32)
            for d in range(a, b):
                n = offs[d + 1] - offs[d]
                if n > 2:
                    out[d - a, : cfg.features] = np.sqrt(np.bincount(code[offs[d] : offs[d + 1] - 2], minlength=cfg.features) / (n - 2))
                own = words.hashes[words.offs[d] : words.offs[d + 1]]
                if len(own) > 1:
                    out[d - a, cfg.features] = (own[1:] == own[:-1]).mean()
                    out[d - a, cfg.features + 1] = 1 - len(np.unique(own)) / len(own)
                    out[d - a, cfg.features + 2] = min(1.0, 4 * (words.ends[words.offs[d] : words.offs[d + 1]] - words.starts[words.offs[d] : words.offs[d + 1]]).mean() / 100)
            yield lo + a, out


class Space:
    """The fitted space with the labelled vectors."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, cfg: VoteConfig):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        width = cfg.features + EXTRA
        if not len(labels):
            features = np.zeros((1, width), np.float32)
        seen = (features > 0).sum(axis=0)
        self.idf = (np.log((1 + len(features)) / (1 + seen)) + 1).astype(np.float32)
        x = self._unit(features * self.idf)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
        axes = axes[:, ::-1][:, : min(cfg.rank, width)]
        axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
        self.axes = axes.astype(np.float32)
        self.vectors = self._unit(x @ self.axes) if len(labels) else np.zeros((0, self.axes.shape[1]), np.float32)
        self.labels = labels.astype(np.float64)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(norm > 0, norm, 1)

    def scores(self, features: np.ndarray, cfg: VoteConfig) -> np.ndarray:
        out = np.full(len(features), self.prior)
        known = features.any(axis=1)
        if not len(self.labels) or not known.any():
            return out
        v = self._unit((self._unit(features[known] * self.idf) - self.mean) @ self.axes)
        near = v @ self.vectors.T
        k = min(cfg.neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(near, top, axis=1).astype(np.float64), 0) ** cfg.power
        total = votes.sum(axis=1)
        mean = (votes * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1)
        out[known] = np.where(total > 0, mean, self.prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, cfg: VoteConfig) -> Space:
    """Fits on at most ``cfg.sample`` labelled documents. Labels that repeat an id
    count by their mean, documents that repeat one by their smallest text."""
    import pyarrow as pa

    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.avg(label_col).alias("label"))
    drawn = marks.orderBy(F.md5(F.concat(F.lit(f"{cfg.seed}:"), F.col(id_col).cast("string")))).limit(cfg.sample)
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(drawn), id_col)
    rows = rows.groupBy(id_col).agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def start():
        return textbuf.Powers(), textbuf.space_words()

    def step(state, batch):
        for lo, x in featurise(batch.column(1), cfg, *state):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, len(x)), batch.column(2).slice(lo, len(x)), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())],
                names=["id", "label", "features"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_batches(rows.select(id_col, "text", "label"), f"id {kind}, label double, features binary", start, step).orderBy("id").toArrow()
    features = np.array([np.frombuffer(x.as_buffer(), np.float16) for x in found.column(2)], dtype=np.float32).reshape(len(found), cfg.features + EXTRA)
    return Space(features, np.asarray(found.column(1), dtype=np.float64) >= 0.5, cfg)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cfg: VoteConfig = VoteConfig(), out: str = "score") -> DataFrame:
    """``docs`` plus the column ``out`` (0 to 1, the weighted share of neighbours with label 1).

    Null and empty texts, and every document when there are no labels, get the share of label 1 in the
    sample (0.5 without any). Columns of ``docs`` other than the text are carried, never used.
    """
    import pyarrow as pa

    docs = docs.drop(out)
    space = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, cfg))
    names = docs.columns
    at = names.index(text_col)

    def start():
        return textbuf.Powers(), textbuf.space_words()

    def step(state, batch):
        parts = [space.value.scores(x, cfg) for _, x in featurise(batch.column(at), cfg, *state)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts), pa.float64())], names=[*names, out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])
    return map_batches(docs, schema, start, step)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
