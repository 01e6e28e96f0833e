"""Inputs that the tables do not hold: a lexicon from the benchmark's words, and small linguistic tables.

The lexicon is made from word digests, so that DuckDB can make the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import words as W
from textloom.operators.tokens import tokenise

from .scalars import HEX_DIGITS, TAG_LETTERS

LEXICON_SQL = rf"""
bform AS MATERIALIZED (SELECT DISTINCT lower(text) AS wordform FROM (SELECT unnest(regexp_extract_all(text, '({W.TOKEN})', 1)) AS text FROM benchmark) WHERE regexp_matches(text, '^[\p{{L}}\p{{Nl}}\p{{No}}]')),
bvar AS (SELECT wordform, v, md5(wordform || v::VARCHAR) AS d FROM bform, (SELECT unnest([0, 1]) AS v) WHERE v = 0 OR substr(md5(wordform), 2, 1) < '8'),
lexicon AS MATERIALIZED (SELECT row_number() OVER (ORDER BY wordform, v) AS seq, wordform, translate(substr(d, 1, 9), '{HEX_DIGITS}', '{TAG_LETTERS}') AS tag,
  left(wordform, 4) || substr(d, 5, 1) AS lemma,
  CASE WHEN left(d, 1) < '8' THEN regexp_replace(wordform, '([aeiouy])', '\1_', 'g') ELSE regexp_replace(wordform, '([ae])', '\1_', 'g') END AS accented FROM bvar)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, wordform, tag, lemma and accented of the benchmark's words; half of them have two entries."""
    tokens = tokenise(table(spark, sf_dir, "benchmark"), key=("item_id",))
    forms = tokens.where(W.is_word(F.col("text"))).select(F.lower("text").alias("wordform")).distinct()
    both = forms.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).where((F.col("v") == 0) | (F.substring(F.md5(F.col("wordform").cast("binary")), 2, 1) < "8"))
    digest = F.md5(F.concat("wordform", F.col("v").cast("string")).cast("binary"))
    d = both.withColumn("d", digest)
    accented = F.when(F.substring("d", 1, 1) < "8", F.regexp_replace("wordform", "([aeiouy])", "$1_")).otherwise(F.regexp_replace("wordform", "([ae])", "$1_"))
    # The benchmark is a small table of fixed size, so one ordered window numbers it.
    seq = F.row_number().over(Window.orderBy("wordform", "v")).cast("long")
    return d.select(seq.alias("seq"), "wordform", F.translate(F.substring("d", 1, 9), HEX_DIGITS, TAG_LETTERS).alias("tag"), F.concat(F.substring("wordform", 1, 4), F.substring("d", 5, 1)).alias("lemma"), accented.alias("accented"))


#: (ending, stemtype, tag), (stem, stemtype, lemma, kind), (form, lemma, tag), prefixes: small tables of our own.
ENDINGS = [(e, t, f"{k}-{n}---{g}{c}-") for t, k, g, rows in (("o1", "n", "f", ("a s n", "am s a", "ae s g", "as p a", "arum p g")), ("o2", "n", "m", ("us s n", "um s a", "i s g", "os p a", "orum p g")), ("en", "n", "n", ("en s n", "e s d", "er p n", "n s a"))) for e, n, c in (r.split() for r in rows)]
PREFIXES = ["ab", "ad", "con", "de", "ex", "in", "per", "re", "th", "an", "er"]
PARSES = [
    ("amandi", "verb amand,amo gerundive sg masc/neut gen"),
    ("bonae", "adj bonae,bonus fem sg gen/dat"),
    ("boni", "adj boni,bonus masc/neut sg gen"),
    ("felix", "adj fe_lix,felix sg nom"),
    ("it", "verb it,eo pres ind act 3rd sg"),
    ("que", "conj que"),
]


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    quoted = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {quoted})"
