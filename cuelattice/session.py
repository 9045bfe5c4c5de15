"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine relies on; everything else is left to the cluster.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "cuelattice") -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", "12g")
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once a context, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_cuelattice_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="cuelattice-")) / "cuelattice_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._cuelattice_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, in local mode only: on a cluster a
    folder of one machine would not be seen by the others, so its absence is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="cuelattice-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/cuelattice/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path, os.getpid())
    return path


def _remove(spark: SparkSession, path: str, pid: int) -> None:
    if os.getpid() != pid:
        return
    try:
        drop_path(spark, path)
    except Exception:  # the session may be gone
        pass


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, so that it works on any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for steps that cost far more than a shuffle.

    A large input has more partitions than that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def write_out(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage: later plans read files that survive the loss of any executor, and a result
    that several branches use is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if partitions:
        df = df.coalesce(partitions)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``write_out`` that nothing will read again."""
    for t in tables:
        drop_path(t.sparkSession, t._written_to)
