"""Session defaults and the two cluster-wide helpers every job needs."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and for bench.py; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("compframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # small files and small shuffles still use every core
        .config("spark.sql.files.openCostInBytes", str(256 << 10))
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", str(64 << 10))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A temporary folder serves only where that setting is absent and the master is local;
    elsewhere its absence is an error, since executors would each write to their own disk.
    """
    sc = spark.sparkContext
    named = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
             or sc.getCheckpointDir())
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {sc.master})")
        named = tempfile.mkdtemp(prefix="compframe-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named


def job_folder(spark: SparkSession) -> str:
    """This application's own folder inside the shared one; the driver removes it when it ends."""
    path = f"{shared_folder(spark).rstrip('/')}/compframe-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(remove_path, spark, path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the job's folder."""
    return f"{job_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through Spark's own file system layer; nothing happens once Spark is gone."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt out evenly, four tasks a core, for work that costs far more a row than reading it.

    Files are cut by their bytes: a file of narrow rows gives a few tasks however many rows it has, and the rest of the cores idle.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def staged(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write an intermediate result to the job's folder and read it back.

    Cuts the lineage of multi-stage and iterative jobs: a lost executor repeats one stage,
    and the planner sees the true size of what was written when it chooses joins. With ``free``, Spark removes the
    shuffle files behind it as soon as it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(SHUFFLES_GO, "false")
    if free:
        spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Remove staged results that nothing reads any more."""
    for df in frames:
        remove_path(df.sparkSession, df.staged_at)


def staged_together(**frames: DataFrame) -> list[DataFrame]:
    """Stage several independent results at the same time, so that one job's tail does not idle the cluster."""
    job_folder(next(iter(frames.values())).sparkSession)
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(lambda item: staged(item[1], item[0].replace("_", "-")), frames.items()))
