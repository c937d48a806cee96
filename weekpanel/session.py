"""Session construction and scratch locations.

The library never picks a machine-local folder on its own: scratch output
(sink round trips, lineage cuts) goes under the folder named by
``spark.checkpoint.dir``.  Only :func:`local_session` (tests, bench) sets one,
and only when the session has none.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the engine relies on: ANSI (default in 4.x, hence try_* on dirty
# input), UTC session time, AQE with skew-join splitting and partition
# coalescing.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "weekpanel") -> SparkSession:
    """A local session for tests and the bench (UI off, engine settings on)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_engine_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    for k, v in ENGINE_CONF.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared scratch root.

    A session on one machine (master ``local...``) without one gets a temporary
    folder; on a cluster an unset ``spark.checkpoint.dir`` is an error, since a
    machine-local folder would lose every other executor's part."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current and not (sc.master.startswith("local[") or sc.master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="weekpanel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


_SCRATCH: list[str] = []  # scratch folders of this process that are not removed yet, oldest first


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root."""
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, f"weekpanel-{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.append(path)
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path and the path in its form: folders of any store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


class scratch_scope:
    """Removes the scratch folders made inside a ``with`` block when it ends, but for results.

    A result must be written (``scope.result(df, name)``) before the block ends, since
    what it was computed from is gone then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> scratch_scope:
        self.before = set(_SCRATCH)
        return self

    def result(self, df, name: str):
        written = set(_SCRATCH)
        out = materialize(df, name)
        self.kept |= set(_SCRATCH) - written
        return out

    def __exit__(self, *error) -> None:
        for path in [p for p in _SCRATCH if p not in self.before and p not in self.kept]:
            remove_folder(self.spark, path)
            _SCRATCH.remove(path)


def materialize(df, name: str):
    """Cut lineage: write ``df`` as Parquet under the shared checkpoint root and
    read it back.  One job; later reads prune columns and survive executor loss
    without recomputing the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # known schema: no inference job
