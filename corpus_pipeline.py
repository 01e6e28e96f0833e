"""The pipeline: five operators over the documents, each stage written and read again.

Every stage takes all that its predecessor kept. Defined cases are those of the operators; in the near-dedup stage
documents without a doc_id stay, and of rows with the same doc_id one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from textloom.llm.common import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a toxicity score below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.learn(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without runs of lines that occurred before; those of which nothing is left go."""
    out = line_dedup.line_dedup(docs, emptied=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near copies."""
    kept = near_dedup.near_dedup(docs).where(F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_tl_kept")).distinct()
    one = docs.join(kept.hint("merge"), F.col("doc_id") == F.col("_tl_kept"), "left_semi")
    # Rows of one doc_id: the first by text, whichever task reads it. They are together already.
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", *[f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")])
    one = one.withColumn("_tl_nth", F.row_number().over(first)).where("_tl_nth = 1").drop("_tl_nth")
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is drawn."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document of the mix."""
    out = bpe.encode_column(docs, keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("BPE encoding", encode),
]

#: No SQL: the stages train a model and draw at random; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of sf_dir."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"{k}-{name.replace(' ', '-')}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0].replace(' ', '-')}")
    return docs
