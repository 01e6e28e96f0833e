"""Shared helpers: tables in the shared folder, and shipping this package to the Python workers."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import remove_folder, temporary_folder

#: `[\x20\x09-\x0D]`: the white space that the contracts name.
SPACE = r"[\x20\x09-\x0D]"


class Workspace:
    """Tables written under the shared folder, so that later steps survive lost executors.

    `save` cuts the lineage: it writes Parquet and reads it again. `drop` removes a table that is no longer needed.
    The rest goes when the driver's Python ends, because results are lazy and may still read it.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = temporary_folder(spark, name)

    def save(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        for table in tables:
            remove_folder(self.spark, f"{self.root}/{table}")


#: A key that more rows share than this, and than a HOT_SHARE-th of all, is joined by broadcast: see join_counted.
HOT_ROWS, HOT_SHARE = 1000, 256


def join_counted(rows: DataFrame, table: DataFrame, key: str | list[str], total: int, how: str = "inner", count: str = "n") -> DataFrame:
    """`rows` with the row of `table` for their key. table: one row for each key, `count` says how many of `rows` have it.

    how: inner or left. Keys that very many rows share would put all of them in one task. There are at most HOT_SHARE such
    keys, as their counts add up to no more than `total`, so they are broadcast and their rows stay where they are.
    """
    hot = F.col(count) > max(HOT_ROWS, total // HOT_SHARE)
    many, few = F.broadcast(table.where(hot).drop(count)), table.where(~hot).drop(count)
    return rows.join(many, key).unionByName(rows.join(many.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(few.hint("merge"), key, how))


def returns_memory(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives free memory back to the system at its end: Python workers live on and serve other
    stages, next to others on their executor."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_textloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, str(path.relative_to(package.parent)))
    folder = tempfile.mkdtemp(prefix="textloom-ship-")
    target = os.path.join(folder, "textloom_ship.zip")
    Path(target).write_bytes(data.getvalue())
    sc.addPyFile(target)
    sc._textloom_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
