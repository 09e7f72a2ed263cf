"""Session helpers.

On a cluster the session is created by the platform; ``get_session`` only
fills in settings that are still unset, so cluster-level configuration
(shuffle partitions, checkpoint directory, AQE) always wins.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Applied only when the session lacks them.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, app: str = "tidemark") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and cut-off tables, shared by driver and executors.

    ``spark.checkpoint.dir`` names it on a cluster; the context makes a folder
    of its own below it, once.  Only a local master may go without the
    setting (tests and benches): it then gets a temporary folder.
    """
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not re.match(r"local(\[[^\]]*\])?$", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        sc.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never ``localCheckpoint``.

    The frame is persisted first so the checkpoint write reads the computed
    blocks instead of computing the plan a second time; the blocks are
    released once the checkpoint files exist.
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    where, system = _file_system(spark, path)
    return system.exists(where)


def remove_path(spark: SparkSession, path: str) -> None:
    where, system = _file_system(spark, path)
    system.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (one parquet file per table)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
