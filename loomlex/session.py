"""Session helpers: reading tables, cutting lineage, shipping the package, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def local_session(app: str = "loomlex", cpus: str = "8", shuffle: int = 8) -> SparkSession:
    """A single-node session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or (
        sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None
    )
    if found:
        return found
    if not (sc.master or "").startswith("local") or "cluster" in sc.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="loomlex-")
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


_STAGED: list[str] = []


def release(spark: SparkSession) -> int:
    """Remove the staged tables of all queries so far, for drivers that live long; their number.

    Only for when no result of these queries is to be read any more.  Tables that are kept for later
    queries (:func:`kept`) stay.
    """
    n = len(_STAGED)
    while _STAGED:
        _remove(spark, _STAGED.pop())
    return n


def stage_table(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The files are removed when the driver process ends, or by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomlex-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, tuple[str, object]] = {}


def kept(spark: SparkSession, d: str, tables: tuple[str, ...], label: str, build, by: str | None = None) -> DataFrame:
    """A table derived from ``tables`` below ``d``, staged once a session and read again while these stay as
    they are (by size and time of change).

    ``build()`` gives the table; with ``by`` it is written in folders of that column, for pruning.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def state(name: str) -> tuple[int, int]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        fs = at.getFileSystem(conf)
        return fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()

    key = (spark.sparkContext.applicationId, label, d, *map(state, tables))
    if key not in _KEPT:
        df = build()
        path = f"{shared_dir(spark)}/loomlex-{label}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(path)
        drop_at_exit(spark, path)
        _KEPT[key] = path, df.schema
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Remove the files at ``path`` when the driver process ends."""

    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when it provably has at most ``rows`` rows, else as it is.

    Pass a staged or scanned table: the count runs at once.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship_package(spark: SparkSession) -> None:
    """Let executors outside the driver's host import this package (needed by its Python stages)."""
    sc = spark.sparkContext
    if (sc.master or "").startswith("local[") or getattr(sc, "_loomlex_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="loomlex-zip-")) / "loomlex_pkg.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(os.fspath(at))
    sc._loomlex_shipped = True


def spread(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``df`` over all cores when the files of ``source`` give fewer partitions than there are cores.

    A small file is one partition, however much work its texts make, and partitions of few bytes
    are put together after a shuffle; a repartition to a number is kept.  A table that fills the
    cluster by itself is left as it is, so this never shuffles much.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if (source or df).rdd.getNumPartitions() < cores else df


def blank(c: Column) -> Column:
    """NULL, or nothing but Unicode white space."""
    return F.coalesce(F.regexp_replace(c, r"(?U)\s+", "") == "", F.lit(True))
