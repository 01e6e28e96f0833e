"""Writers: texts, marked-up texts, lexicons and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import words as W


def write_texts(docs: DataFrame, path: str) -> None:
    """K01."""
    docs.select(F.col("text").alias("value")).write.mode("overwrite").text(path)


def marked_html(text: Column, unknown: Column, ambiguous: Column) -> Column:
    """A word in a span of its class, its long vowels in spans of their own."""
    kind = F.when(unknown, "unknown").when(ambiguous, "ambig").otherwise("auto")
    vowels = F.regexp_replace(W.escape_html(text), f"([{W.LONG}])", "<span>$1</span>")
    return F.when(W.is_word(text), F.concat(F.lit('<span class="'), kind, F.lit('">'), vowels, F.lit("</span>"))).otherwise(W.escape_html(text))


def token_json(tokens: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id and the tokens as one JSON array."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", F.struct(*columns).alias("t"))))
    return tokens.groupBy("doc_id").agg(F.to_json(F.transform(ordered, lambda s: s["t"])).alias("tokens"))


def write_lexicon(lexicon: DataFrame, table: str, buckets: int = 64) -> None:
    """The lexicon as a table bucketed by wordform, so that joins on it need no shuffle of it."""
    lexicon.write.mode("overwrite").bucketBy(buckets, "wordform").sortBy("wordform", "seq").format("parquet").saveAsTable(table)


def new_entries(entries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The entries that a lexicon lacks, each once; what is unknown stays known as such by its nulls."""
    columns = ["wordform", "tag", "lemma", "accented"]
    fresh, old = entries.select(*columns).dropDuplicates(columns), lexicon.select(*[F.col(c).alias(f"_{c}") for c in columns])
    return fresh.join(old, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns], "left_anti")


def tagged_lines(rows: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Lines (value) of word, tag and lemma by tabs, with the columns `key`."""
    return rows.select(*key, F.concat_ws("\t", "word", "tag", "lemma").alias("value"))


def tagger_lines(rows: DataFrame) -> DataFrame:
    """Lines (value) of word, tag and lemma; a word whose accented form begins with a capital gets one."""
    capital = F.substring("accented", 1, 1)
    title = F.concat(F.upper(F.substring("word", 1, 1)), F.lower(F.substr("word", F.lit(2), F.length("word"))))
    word = F.when(capital != F.lower(capital), title).otherwise(F.col("word"))
    return tagged_lines(rows.withColumn("word", word))


def write_json(df: DataFrame, path: str) -> None:
    """K13, K14."""
    df.write.mode("overwrite").json(path)


def write_piped(lexicon: DataFrame, path: str, most: int | None = None) -> None:
    """K15."""
    rows = lexicon.orderBy("seq") if most is None else lexicon.orderBy("seq").limit(most)
    rows.select("wordform", "tag", "lemma", "accented").write.mode("overwrite").csv(path, sep="|")


def write_model(tables: dict[str, DataFrame], path: str) -> None:
    """A model's tables, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """S20."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def dead_letters(words: DataFrame, analyses: DataFrame) -> DataFrame:
    """The words without an analysis."""
    return words.join(analyses.select("word").distinct(), "word", "left_anti")


def is_populated(spark: SparkSession, table: str) -> bool:
    """Whether a lexicon table exists and has rows."""
    return spark.catalog.tableExists(table) and not spark.table(table).isEmpty()


def lexicon_size(spark: SparkSession, table: str) -> int:
    """S09."""
    return spark.table(table).count() if spark.catalog.tableExists(table) else 0


def metadata(restored: DataFrame, feet: DataFrame | None = None, coverage: DataFrame | None = None) -> DataFrame:
    """Beside the texts: doc_id, words, unknown, ambiguous, and the feet of the verses and the coverage where given."""
    out = restored.select("doc_id", "words", "unknown", "ambiguous")
    if feet is not None:
        ordered = F.array_sort(F.collect_list(F.struct("verse_id", "feet")))
        out = out.join(feet.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["feet"]).alias("feet")), "doc_id", "left")
    return out if coverage is None else out.join(coverage, "doc_id", "left")


def verse_html(tokens: DataFrame, feet: DataFrame | None = None) -> DataFrame:
    """doc_id and html of marked tokens (doc_id, idx, sub_idx, text, marked, is_unknown, is_ambiguous): a block for each
    line with its words in spans, numbered through the document, and behind it its feet (doc_id, verse_id, feet)."""
    order = Window.partitionBy("doc_id").orderBy("idx", "sub_idx")
    word = W.is_word(F.col("text"))
    nth = F.sum(word.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kinds = F.concat_ws(" ", F.when(F.col("is_ambiguous"), "ambig"), F.when(F.col("is_unknown"), "unknown"), F.lit("word"))
    span = F.concat(F.lit('<span class="'), kinds, F.lit('" data-word-index="'), F.coalesce(nth, F.lit(0)).cast("string"), F.lit('">'), W.escape_html(F.replace("marked", F.lit("_"), F.lit(""))), F.lit("</span>"))
    # A token with line feeds ends lines: what follows each feed is of the next one.
    pieces = F.split(F.when(word, span).otherwise(W.escape_html(F.col("text"))), "\n")
    feeds = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    line = F.coalesce(F.sum(feeds).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = tokens.withColumns({"_line": line, "_pieces": pieces}).select("doc_id", "idx", "sub_idx", "_line", F.posexplode("_pieces").alias("_k", "_piece"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "sub_idx", "_piece")))
    lines = each.groupBy("doc_id", (F.col("_line") + F.col("_k")).cast("long").alias("verse_id")).agg(F.array_join(F.transform(ordered, lambda x: x["_piece"]), "").alias("content"))
    foot = F.lit("")
    if feet is not None:
        lines = lines.join(feet, ["doc_id", "verse_id"], "left")
        foot = F.when(F.coalesce("feet", F.lit("")) != "", F.concat(F.lit('<span class="verse-foot">'), W.escape_html(F.col("feet")), F.lit("</span>"))).otherwise("")
    block = F.concat(F.lit('<div class="verse-line"><span class="verse-content">'), "content", F.lit("</span>"), foot, F.lit("</div>"))
    blocks = F.array_sort(F.collect_list(F.struct("verse_id", block.alias("b"))))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "").alias("html"))


def token_details(tokens: DataFrame, candidates: DataFrame, tags: DataFrame) -> DataFrame:
    """What is known of each word (doc_id, idx, sub_idx, text, marked, is_unknown, is_ambiguous): its tag in words and
    its candidates. candidates: form, accented; tags: form, tag."""
    known = tags.select("form", "tag", W.describe_tag(F.col("tag")).alias("features")).join(candidates.select("form", F.col("accented").alias("candidates")), "form", "full")
    return tokens.where(W.is_word(F.col("text"))).join(known, F.col("text") == F.col("form"), "left").drop("form")


def show_tokens(tokens: DataFrame, most: int = 500) -> list[str]:
    """The first tokens of the first document as lines of columns by tabs; the limit is the feature."""
    names = [c for c in ("text", "tag", "lemma", "marked") if c in tokens.columns]
    order = [c for c in ("doc_id", "idx", "sub_idx") if c in tokens.columns]
    rows = tokens.orderBy(*order).select(F.concat_ws("\t", *names).alias("line")).limit(most).collect()
    return [r["line"].expandtabs(16) for r in rows]


def model_lines(lexicon: DataFrame, guesser: DataFrame, trees: DataFrame) -> DataFrame:
    """A tagger's model as lines (part, line) to read: words and endings with their tags, and trees."""
    listed = F.concat_ws(" ", F.transform("tags", lambda x: F.concat_ws(" ", x["tag"], F.round(x["prob"], 6).cast("string"))))
    return (
        lexicon.select(F.lit("lexicon").alias("part"), F.concat_ws("\t", "word", F.col("freq").cast("string"), listed).alias("line"))
        .unionByName(guesser.select(F.lit("guesser").alias("part"), F.concat_ws("\t", "suffix", listed).alias("line")))
        .unionByName(trees.select(F.lit("tree").alias("part"), F.concat_ws("\t", "feature", "tree").alias("line")))
    )
