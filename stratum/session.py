"""Session construction and lineage cutting."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "stratum") -> SparkSession:
    """Return the active session, or build a local one with sane defaults.

    On a cluster the session already exists and its settings win; the defaults here
    only apply to local runs (tests, bench).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.python.worker.reuse", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def make_importable(spark: SparkSession) -> None:
    """Let the session's Python workers import this library from where the driver has it.

    Enough for a local session; on a cluster the library is installed on the executors or
    shipped with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a fresh folder under the system temp
    directory; a cluster session is refused, since its executors share no local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="stratum-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def reliable_checkpoint(df: DataFrame, cache: bool = True) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Survives executor loss (unlike cache or localCheckpoint), and later plans built on it
    start from a plain scan instead of re-analysing the whole upstream lineage. The input
    is persisted while the checkpoint is written so it is computed only once. With
    ``cache`` the checkpointed result is also kept in memory for repeated readers; a lost
    cached block is rebuilt from the checkpoint files, not from the old lineage.
    """
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cp = df.checkpoint(eager=True)
    finally:
        df.unpersist()
    return cp.persist(StorageLevel.MEMORY_AND_DISK) if cache else cp


def collect_garbage(spark: SparkSession) -> None:
    """Collect the driver's garbage. Spark drops the shuffles, broadcasts and plans that nothing
    refers to any more only then, and a driver that runs hundreds of small jobs grows to its
    largest heap before it collects by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
