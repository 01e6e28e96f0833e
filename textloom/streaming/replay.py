"""Streams: the batch operators over files as they arrive, and a lexicon that grows with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_over_files(spark: SparkSession, source: str, schema: str, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, per_batch: int = 1) -> DataFrame:
    """Every file once, in batches; a batch that is repeated after a failure overwrites its own folder."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)

    def each(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target).drop("batch")


def grow_lexicon(spark: SparkSession, source: str, schema: str, analyse: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> DataFrame:
    """The forms of each batch that the lexicon lacks are analysed and added; later batches find them."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def each(forms: DataFrame, number: int) -> None:
        fresh = forms.select("wordform").distinct()
        if number:
            known = spark.read.parquet(*[f"{target}/batch={k}" for k in range(number)]).select("wordform")
            fresh = fresh.join(known, "wordform", "left_anti")
        analyse(fresh).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target).drop("batch")


def distinct_requests(requests: DataFrame, options: list[str]) -> DataFrame:
    """Each text with the same options once, by its digest; works on streams too."""
    return requests.withColumn("key", F.sha2(F.col("text").cast("binary"), 256)).dropDuplicates(["key", *options])
