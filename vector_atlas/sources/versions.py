"""Tables in key buckets, published version by version through a small manifest file.

Rows lie in buckets by a hash of their key columns. A merge reads and writes only the buckets that the
new rows touch, as new folders, and then publishes a manifest that names the folders of all buckets:
those it wrote and the old ones of the others. Readers follow the newest manifest. Until it is there
they see the version before, so a writer that is lost at any point changes nothing, and no folder is
ever renamed. A manifest is created only if its number is free: of two writers one wins, the other
merges again into what the first has published.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
BUCKET = "__bucket"
ATTEMPTS = 8  # merges of one writer before it gives up against others


@dataclass(frozen=True)
class Manifest:
    """One version: the key, the number of buckets, the columns, and the folder of each bucket that has rows."""

    version: int
    keys: tuple[str, ...]
    buckets: int
    schema: T.StructType
    folders: dict[int, str] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def _read_manifest(spark: SparkSession, path: str, version: int) -> Manifest | None:
    """The manifest, or None when its writer was lost while writing it."""
    fs, file = _fs(spark, f"{path}/manifest/{version:020d}.json")
    stream = fs.open(file)
    try:
        text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
    digest, _, body = text.partition("\n")
    if hashlib.sha256(body.encode()).hexdigest() != digest:
        return None
    found = json.loads(body)
    folders = {int(b): f for b, f in found["folders"].items()}
    return Manifest(version, tuple(found["keys"]), found["buckets"], T.StructType.fromJson(found["schema"]), folders)


def current(spark: SparkSession, path: str) -> Manifest | None:
    """The newest version that was published whole, None if there is none."""
    for version in reversed(_manifests(spark, path)):
        manifest = _read_manifest(spark, path, version)
        if manifest is not None:
            return manifest
    return None


def _publish(spark: SparkSession, path: str, manifest: Manifest) -> bool:
    """Whether the manifest became the next version (no other writer had taken its number)."""
    body = json.dumps({
        "keys": list(manifest.keys), "buckets": manifest.buckets, "schema": json.loads(manifest.schema.json()),
        "folders": {str(b): f for b, f in sorted(manifest.folders.items())},
    })
    fs, file = _fs(spark, f"{path}/manifest/{manifest.version:020d}.json")
    try:
        stream = fs.create(file, False)
    except Exception as failure:  # the class is the file system's own; only an existing file means a lost race
        if fs.exists(file):
            return False
        raise failure
    try:
        stream.write(bytearray(f"{hashlib.sha256(body.encode()).hexdigest()}\n{body}".encode()))
    finally:
        stream.close()
    return True


def _scan(spark: SparkSession, path: str, manifest: Manifest, only: set[int] | None = None) -> DataFrame:
    folders = [f"{path}/{f}" for b, f in sorted(manifest.folders.items()) if only is None or b in only]
    if not folders:
        return spark.createDataFrame([], manifest.schema)
    return spark.read.schema(manifest.schema).parquet(*folders)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the newest version, None if nothing was ever published at ``path``."""
    manifest = current(spark, path)
    return None if manifest is None else _scan(spark, path, manifest)


def _bucket(keys, buckets: int):
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def _stored(df: DataFrame, path: str, keys, buckets: int) -> dict[int, str]:
    """Write ``df`` by buckets into a fresh folder; the folder of each bucket that has rows."""
    spark, name = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{name}")
    fs, folder = _fs(spark, f"{path}/{name}")
    parts = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    return {int(p.split("=")[1]): f"{name}/{p}" for p in parts if p.startswith(f"{BUCKET}=")}


def merge_into(
    fresh: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = BUCKETS
) -> int:
    """Publish ``merge(rows of the touched buckets, fresh)`` in place of those buckets; the new version's number.

    ``merge`` gets None when there is no table yet. Its result must not change rows of other keys' buckets, so it
    may only add, replace or drop rows whose keys lie in the buckets of ``fresh``. ``buckets`` counts for a new
    table only.
    """
    spark = fresh.sparkSession
    for _ in range(ATTEMPTS):
        # numbers first: what is published after this makes the number below a taken one
        taken = _manifests(spark, path)
        number = taken[-1] + 1 if taken else 1
        known = current(spark, path)
        n = known.buckets if known else buckets
        if known is None:
            result = merge(None, fresh)
            manifest = Manifest(number, tuple(keys), n, result.schema, _stored(result, path, keys, n))
        else:
            touched = {r[0] for r in fresh.select(_bucket(keys, n)).distinct().collect()}  # at most ``buckets`` numbers
            result = merge(_scan(spark, path, known, touched), fresh)
            written = _stored(result.select(*known.schema.fieldNames()), path, keys, n)
            kept = {b: f for b, f in known.folders.items() if b not in touched}
            if set(written) & set(kept):
                raise ValueError("a merge gave rows for buckets that the fresh rows do not touch")
            manifest = Manifest(number, known.keys, n, known.schema, {**kept, **written})
        if _publish(spark, path, manifest):
            return manifest.version
    raise RuntimeError(f"{path}: other writers published first {ATTEMPTS} times")


def replace_table(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Publish ``df`` as the whole next version."""
    spark = df.sparkSession
    folders = _stored(df, path, keys, buckets)
    for _ in range(ATTEMPTS):
        versions = _manifests(spark, path)
        manifest = Manifest((versions[-1] if versions else 0) + 1, tuple(keys), buckets, df.schema, folders)
        if _publish(spark, path, manifest):
            return manifest.version
    raise RuntimeError(f"{path}: other writers published first {ATTEMPTS} times")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete what no manifest but the newest ``keep`` names: older manifests, and folders of data that no kept one
    uses. Only for times when no writer is at work. The folders that went."""
    versions = _manifests(spark, path)
    kept = [m for m in (_read_manifest(spark, path, v) for v in versions[-keep:]) if m is not None]
    used = {f.split("/")[1] for m in kept for f in m.folders.values()}
    fs, folder = _fs(spark, f"{path}/data")
    gone = []
    for status in fs.listStatus(folder):
        if status.getPath().getName() not in used:
            fs.delete(status.getPath(), True)
            gone.append(status.getPath().getName())
    for version in versions[:-keep]:
        fs.delete(_fs(spark, f"{path}/manifest/{version:020d}.json")[1], False)
    return sorted(gone)
