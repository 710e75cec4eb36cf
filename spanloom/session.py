"""Session set-up for tests and benches, and durable intermediate tables."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library assumes (UTC, AQE)."""

    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanloom")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPANLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "localhost")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for durable intermediates, as the session names it.

    Only a local-mode session without a setting gets a folder made for it: on a
    cluster, a machine-local folder would vanish with the machine.
    """

    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spanloom-")


class Workspace:
    """Intermediate Parquet tables of one computation.

    Iterative steps write each round here and read it back. That cuts the
    lineage, survives the loss of executors, keeps row ids fixed once written,
    and lets later reads prune columns.
    """

    def __init__(self, spark: SparkSession, label: str = "work"):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/spanloom/{label}-{uuid.uuid4().hex}"
        self._count = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove this workspace's own tables once nothing reads them any more."""

        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(hadoop_path, True)
