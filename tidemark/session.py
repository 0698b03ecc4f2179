"""Session creation and the shared scratch area.

Intermediate tables are written to the folder the cluster names in ``spark.checkpoint.dir``, which every executor
can read, so a lost executor never loses a result.  Only where that setting is unset and Spark runs in local mode
is a folder of our own used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_OPEN: dict[str, "Scratch"] = {}


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A local session with the settings the engine relies on; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


class Scratch:
    """Named intermediate tables under the shared folder, removed when the session's process ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a frame that reads the written rows: a cut in the lineage with real statistics."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._tidemark_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no live frame reads any more."""
        for df in frames:
            if path := getattr(df, "_tidemark_path", None):
                _delete(self.spark, path)

    def close(self) -> None:
        _delete(self.spark, self.root)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A written table with a broadcast hint where its counted size allows it, unchanged (a shuffle join) beyond that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scratch(spark: SparkSession) -> Scratch:
    """The scratch area of this application."""
    key = spark.sparkContext.applicationId
    if key not in _OPEN:
        _OPEN[key] = Scratch(spark)
    return _OPEN[key]


@atexit.register
def _close_all() -> None:
    for area in _OPEN.values():
        try:
            area.close()
        except Exception:  # the JVM may be gone already
            pass
