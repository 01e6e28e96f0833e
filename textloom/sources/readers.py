"""Readers of texts, lexicons, lemma and ending tables, tagged corpora and stem libraries. All take paths that Spark reads.

Lines of a file keep their order through `seq`, which Spark's own ids give: they grow within a file's part, so a window by
file suffices and no driver counts lines.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Characters that a form's text may have.
FORM_CHARS = 50_000


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalise(text: Column) -> Column:
    """NFC; texts of ASCII alone do not leave the JVM."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, text).otherwise(nfc(F.when(~plain, text)))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Path and text of each file, trimmed and composed, without empty ones."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("text"))
    return raw.where(F.length("text") > 0).withColumn("text", normalise(F.col("text")))


def form_text(text: Column) -> Column:
    """A form's text: without carriage returns, cut, composed."""
    return normalise(F.substring(F.replace(text, F.lit("\r"), F.lit("")), 1, FORM_CHARS))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, seq and line."""
    raw = spark.read.text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def comment_or_blank(line: Column) -> Column:
    """P18."""
    return line.startswith("#") | (F.trim(line) == "")


def lexicon_rows(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Seq, wordform, tag, lemma and accented of lines of four columns (seq, line); strict fails on others."""
    parts = F.split(F.trim("line"), r"\s+")
    found = rows.where(~comment_or_blank(F.col("line"))).withColumn("p", parts)
    if strict:
        found = found.withColumn("p", F.when(F.size("p") == 4, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("not four columns: "), "line"))))
    return found.where(F.size("p") >= 4).select("seq", *[F.col("p")[i].alias(n) for i, n in enumerate(("wordform", "tag", "lemma", "accented"))])


def read_lexicon(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """S05-S07."""
    return lexicon_rows(lines(spark, required(spark, path)), strict)


def piped_rows(rows: DataFrame) -> DataFrame:
    """Seq, wordform, tag, lemma and accented of lines (seq, line) in either of two layouts of three columns or more.

    By tabs: wordform, tag, accented, lemma (else the wordform). By |: wordform, accented, lemma, tag (else no features).
    Lines of fewer columns are left out.
    """
    tabs, bars = F.split(F.trim("line"), "\t"), F.split(F.trim("line"), r"\|")
    names = ("wordform", "tag", "lemma", "accented")

    def columns(p: Column, places: tuple[int, ...], absent: dict[str, Column]) -> Column:
        return F.struct(*[F.trim(F.coalesce(F.get(p, F.lit(i)), absent.get(n, F.lit(None)))).alias(n) for n, i in zip(names, places, strict=True)])

    row = F.when(F.size(tabs) >= 3, columns(tabs, (0, 1, 3, 2), {"lemma": tabs[0]})).when(F.size(bars) >= 3, columns(bars, (0, 3, 2, 1), {"tag": F.lit("---------")}))
    return rows.where(~comment_or_blank(F.col("line"))).select("seq", row.alias("r")).where("r IS NOT NULL").select("seq", *[f"r.{n}" for n in names])


def read_lemmas(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """lemma_freq (lemma, freq) and corpus_lemmas (wordform, ord, lemma, freq) of a JSON file."""
    kind = "lemmaFrequency map<string,long>, corpus map<string,array<array<string>>>"
    raw = spark.read.schema(kind).json(path, multiLine=True)
    freq = raw.select(F.explode("lemmaFrequency").alias("lemma", "freq"))
    corpus = raw.select(F.explode("corpus").alias("wordform", "pairs")).select("wordform", F.posexplode("pairs").alias("ord", "p"))
    return freq, corpus.select("wordform", F.col("ord").cast("long").alias("ord"), F.col("p")[0].alias("lemma"), F.col("p")[1].cast("long").alias("freq"))


def read_endings(spark: SparkSession, path: str) -> DataFrame:
    """Tag, priority, accented_ending and plain_ending of a JSON object of ordered lists."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    each = raw.select(F.explode("m").alias("tag", "e")).select("tag", F.posexplode("e").alias("priority", "accented_ending"))
    return each.withColumn("plain_ending", F.translate("accented_ending", "_^", ""))


def tagged_rows(rows: DataFrame) -> DataFrame:
    """Path, sentence_id, pos, word, tag and lemma of lines by tabs (path, seq, line); blank lines end sentences."""
    order = Window.partitionBy("path").orderBy("seq")
    blank = F.trim("line") == ""
    numbered = rows.withColumn("sentence_id", F.sum(blank.cast("long")).over(order)).where(~blank)
    p = F.split(F.ltrim("line"), "\t")
    place = Window.partitionBy("path", "sentence_id").orderBy("seq")
    dense = F.dense_rank().over(Window.partitionBy("path").orderBy("sentence_id"))
    return numbered.select("path", (dense - 1).cast("long").alias("sentence_id"), (F.row_number().over(place) - 1).cast("long").alias("pos"), *[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("word", "tag", "lemma"))])


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    return tagged_rows(lines(spark, path))


def treebank_words(spark: SparkSession, path: str) -> DataFrame:
    """Sentence, pos, form, lemma and postag of XML treebanks; a clitic after its bearer joins it (`form` ending in -)."""
    raw = spark.read.format("xml").option("rowTag", "sentence").schema("_id string, word array<struct<_id:string,_form:string,_lemma:string,_postag:string>>").load(path)
    each = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_id").alias("sentence"), F.posexplode("word").alias("pos", "w"))
    order = Window.partitionBy("path", "sentence").orderBy("pos")
    rows = each.select("path", "sentence", "pos", F.col("w._form").alias("form"), F.col("w._lemma").alias("lemma"), F.col("w._postag").alias("postag"))
    before = F.lag("form").over(order)
    joined = F.when(before.rlike("^-"), F.concat("form", F.substr(before, F.lit(2), F.length(before)))).otherwise(F.col("form"))
    return rows.withColumn("joined", joined).where(~F.col("form").rlike("^-")).drop("form").withColumnRenamed("joined", "form")


def stem_rows(rows: DataFrame) -> DataFrame:
    """Lemma, kind, stem and keys of a stem library's lines (path, seq, line): a :le: line heads its stems."""
    order = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("line", r"^:le:\s*(\S+)", 1)
    filled = rows.withColumn("lemma", F.last(F.when(head != "", head), ignorenulls=True).over(order))
    stems = filled.where(F.col("line").rlike("^:(no|vs|aj|de|wd):"))
    p = F.split(F.regexp_extract("line", r"^:\w\w:\s*(.*)$", 1), r"\s+")
    return stems.select("lemma", F.regexp_extract("line", r"^:(\w\w):", 1).alias("kind"), p[0].alias("stem"), F.slice(p, F.lit(2), F.size(p)).alias("keys"))


def ending_rows(rows: DataFrame) -> DataFrame:
    """Ending, stemtype and features of a paradigm's lines; a line @name stands for the lines of the table `name`."""
    name = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]*$", "")
    named = rows.where(~comment_or_blank(F.col("line"))).withColumn("table", name)
    plain = named.where(~F.col("line").startswith("@"))
    used = named.where(F.col("line").startswith("@")).select(F.col("table").alias("into"), F.trim(F.substr("line", F.lit(2), F.length("line"))).alias("table"))
    expanded = plain.join(used, "table").select(F.col("into").alias("table"), "line")
    p = F.split(F.trim("line"), r"\s+")
    return plain.select("table", "line").unionByName(expanded).select("table", p[0].alias("ending"), F.get(p, F.lit(1)).alias("stemtype"), F.slice(p, F.lit(3), F.size(p)).alias("features"))


def driver_words(rows: DataFrame) -> DataFrame:
    """The first field of each line without digits behind it; comments are skipped."""
    return rows.where(~comment_or_blank(F.col("line"))).select("seq", F.regexp_extract(F.trim("line"), r"^(\S+?)\d*(?:\s|$)", 1).alias("word"))


def transducer_edges(rows: DataFrame) -> DataFrame:
    """State, symbol, next of lines by tabs; ordered is whether states never go down."""
    p = F.split("line", "\t")
    edges = rows.select("path", "seq", p[0].cast("long").alias("state"), F.get(p, F.lit(1)).alias("symbol"), F.get(p, F.lit(2)).cast("long").alias("next"))
    before = F.lag("state").over(Window.partitionBy("path").orderBy("seq"))
    return edges.withColumn("ordered", F.coalesce(F.col("state") >= before, F.lit(True)))


def with_supplement(corpus: DataFrame, supplement: DataFrame) -> DataFrame:
    """A tagged corpus and a supplement, whose sentences keep their own file."""
    return corpus.unionByName(supplement, allowMissingColumns=True)


def open_classes(lines: DataFrame) -> DataFrame:
    """The tags (tag) that unknown words may have, one on a line."""
    return lines.where(F.trim("line") != "").select(F.trim("line").alias("tag")).distinct()


def required(spark: SparkSession, path: str) -> str:
    """The path, or an error that names it if nothing is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(f"nothing to read at {path}")
    return path
