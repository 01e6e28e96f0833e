"""Session helper for tests, benches and scripts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution and UTC times."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; a local session without it uses its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = f"file://{tempfile.gettempdir()}/textloom-shared"
    return base.rstrip("/")


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the driver's Python ends, because results are lazy and may read it."""
    folder = f"{shared_folder(spark)}/textloom-{name}-{uuid.uuid4().hex}"

    def close() -> None:
        try:
            remove_folder(spark, folder)
        except Exception:  # the session has ended: nothing is left to ask
            pass

    atexit.register(close)
    return folder
