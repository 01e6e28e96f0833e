"""Scalar functions under SQL names, so that `spark.sql` can use them without Python workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import words as W

#: SQL name: function of one string.
FUNCTIONS = {
    "to_ascii": W.to_ascii, "to_ui": W.to_ui, "from_ui": W.from_ui, "normalize_word": W.normalize_word, "starts_with_vowel": W.starts_with_vowel,
    "is_word": W.is_word, "is_sentence_ender": W.is_sentence_ender, "escape_html": W.escape_html, "marks_to_unicode": W.marks_to_unicode,
    "unicode_to_marks": W.unicode_to_marks, "remove_marks": W.remove_marks, "filter_accents": W.filter_accents, "clean_lemma": W.clean_lemma,
    "is_title": W.is_title, "is_all_caps": W.is_all_caps, "all_vowels_ambiguous": W.all_vowels_ambiguous, "strip_quantities": W.strip_quantities,
    "toggle_length": W.toggle_length, "fallback_tag": W.fallback_tag, "breves_and_longs": W.breves_and_longs, "simplify_tag": W.simplify_tag,
}


def sql_of(spark: SparkSession, function: Callable[[Column], Column]) -> str:
    """The SQL text of a function of the column x, from the analysed plan."""
    plan = spark.range(1).select(F.lit("").alias("x")).select(function(F.col("x")).alias("y"))
    return plan._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession, prefix: str = "tl_") -> list[str]:
    """Temporary SQL functions; they are inlined into the plan."""
    names = []
    for name, function in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x STRING) RETURN {sql_of(spark, function)}")
        names.append(prefix + name)
    return names
