"""Session settings the library relies on; every one is a stock Spark setting."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # gather compositions in hash maps: a task meets thousands of keys, each bounded
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("atlasledger")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_batches(df: DataFrame, size: str = "4m") -> DataFrame:
    """``df`` as it is; its session hands at most about ``size`` at once to Python.

    The setting holds for the session from now on, as it is read when a query runs. By default a
    batch has up to 10,000 rows or 64 MB, of which a JVM and a Python worker hold several copies.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def dealt(df: DataFrame, keys: list[str], pieces: int = 1) -> DataFrame:
    """``df`` by ``keys`` in ``pieces``, at least as many as shuffles have, however few bytes there are.

    For rows that become many or long ones in the same task: adaptive execution would put pieces
    together by what they have before that. Where ``pieces`` grows with the rows, no task does.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, pieces), *keys)


#: Seconds from which a step's shuffles are worth asking for their disk.
LONG_STEP_S = 5


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no query reads any more.

    It does so when the driver collects its garbage, which a driver with memory to spare rarely does.
    """
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and handed-over tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local-mode session
    (tests) may fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="atlasledger-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a table written to the shared folder.

    A columnar table is compressed and read back column by column, and it
    outlives any executor. Like checkpoint files, it stays until the shared
    folder is cleared.
    """
    return Scratch(df.sparkSession).save(df)


class Scratch:
    """Tables of one job in a folder of their own below the shared folder.

    As a context manager it deletes them at the end; use it so where nothing
    that reads them is handed out. ``drop`` deletes one table early.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/atlasledger-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._kept: list[DataFrame] = []  # so that ids stay unique

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back; a later reader depends on no executor."""
        path = self.path(f"t{len(self._paths)}")
        began = time.monotonic()
        df.write.option("compression", "zstd").parquet(path)
        if time.monotonic() - began > LONG_STEP_S:
            free_shuffles(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        self._kept.append(out)
        return out

    def drop(self, df: DataFrame) -> None:
        delete_folder(self.spark, self._paths[id(df)])

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_: object) -> None:
        delete_folder(self.spark, self.root)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partition_folders(spark: SparkSession, path: str, levels: int) -> list[str]:
    """The partitions below a table's folder, as paths from there; none where it has no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [("", where)] if store.exists(where) else []
    for _ in range(levels):
        found = [
            (f"{name}/{s.getPath().getName()}".lstrip("/"), s.getPath())
            for name, folder in found
            for s in store.listStatus(folder)
            if s.isDirectory() and "=" in s.getPath().getName()
        ]
    return [name for name, _ in found]


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to where another may be, which is deleted; both lie in one store."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = new(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(new(target), True)
    store.mkdirs(new(target).getParent())
    if not store.rename(new(source), new(target)):
        raise OSError(f"cannot move {source} to {target}")
