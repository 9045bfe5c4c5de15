"""Files: tolerant JSON, fingerprints, versioned publishing and a cache with a time limit."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_path

CHUNK = 262_144


def read_json(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON documents of a stated schema. Lenient: what can't be read comes as nulls with ``_corrupt_record``; strict: it fails."""
    if strict:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    s = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(s).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(relative, path, bytes, modified): files below a folder of any store, their contents not read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    base = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/") + "/"
    # a local store's paths come with one slash or three
    base, own = (re.sub("^file:/+", "file:/", base), F.regexp_replace("path", "^file:/+", "file:/"))
    return _files(spark, path, glob).select(F.substring(own, len(base) + 1, 1 << 30).alias("relative"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, full): SHA-256 of whole contents."""
    return _files(spark, path, glob).select("path", F.sha2("content", 256).alias("full"))


def sampled_fingerprints(spark: SparkSession, path: str, glob: str = "*", chunk: int = CHUNK) -> DataFrame:
    """(path, sampled): SHA-256 of the size and of the first, middle and last ``chunk`` bytes; no more is read.

    A file of up to three chunks is read whole.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with store.open_input_file(inner) as f:
                    n = f.size()
                    h = hashlib.sha256(str(n).encode())
                    places = [(0, n)] if n <= 3 * chunk else [(0, chunk), ((n - chunk) // 2, chunk), (n - chunk, chunk)]
                    for at, size in places:
                        f.seek(at)
                        h.update(f.read(size))
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["path", "sampled"])

    return _files(spark, path, glob).select("path").mapInArrow(digest, "path string, sampled string")


def publish(df: DataFrame, root: str, version: int) -> str:
    """Write a version beside the earlier ones; readers see it once its success marker is there."""
    path = f"{root}/v={version}"
    if version in versions(df.sparkSession, root):
        raise ValueError(f"version {version} is there")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions in order."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(done)


def latest(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest complete version, or None."""
    v = versions(spark, root)
    return spark.read.parquet(f"{root}/v={v[-1]}") if v else None


def forget(spark: SparkSession, root: str, keep: int = 3) -> list[int]:
    """Drop all but the newest ``keep`` versions; gives the dropped ones."""
    all_ = versions(spark, root)
    old = all_[: max(0, len(all_) - keep)]
    for v in old:
        drop_path(spark, f"{root}/v={v}")
    return old


def fresh(cache: DataFrame, now: Column, ttl_seconds: float = 86_400, cached_at: str = "cached_at") -> DataFrame:
    """Cache rows that are at most ``ttl_seconds`` old and not from the future."""
    age = now.cast("double") - F.col(cached_at).cast("double")
    return cache.where((age >= 0) & (age <= ttl_seconds))
