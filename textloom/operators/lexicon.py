"""Lexicon: lookups, lemmas, endings and candidates as joins. A lexicon has seq, wordform, tag, lemma and accented.

Tokens are reduced to distinct forms before the joins, so their size is the vocabulary's and no hot word is a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import words as W


def word_forms(tokens: DataFrame) -> DataFrame:
    """The distinct lower-case forms of the words: wordform."""
    return tokens.where(W.is_word(F.col("text"))).select(F.lower(W.to_ascii(F.col("text"))).alias("wordform")).distinct()


def join_all(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Each form with all of its entries; nulls for unknown ones."""
    return forms.join(lexicon, "wordform", "left")


def missing(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """J02, U02."""
    return forms.join(lexicon.select("wordform"), "wordform", "left_anti")


def known(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """J03."""
    return forms.join(lexicon.select("wordform"), "wordform", "left_semi")


def lookup_exact_or_first(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The accented form of a (wordform, tag): of the entry with this tag, else of the first one."""
    entry = lexicon.withColumnRenamed("tag", "_tag")
    best = F.min_by("accented", F.struct((F.col("_tag") != F.col("tag")).alias("other"), "seq"))
    return pairs.join(entry, "wordform").groupBy("wordform", "tag").agg(best.alias("accented"))


def best_lemmas(tokens: DataFrame, corpus: DataFrame, lexicon: DataFrame, frequency: DataFrame) -> DataFrame:
    """The lemma of each distinct form: of the corpus (wordform, ord, lemma, freq) by its own case, else of the
    lexicon by its lower case and the lemmas' frequency, else `-`. The first of equals wins."""
    forms = tokens.where(W.is_word(F.col("text"))).select(W.to_ascii(F.col("text")).alias("form")).distinct()
    first = corpus.groupBy(F.col("wordform").alias("form")).agg(F.max_by("lemma", F.struct("freq", (-F.col("ord")).alias("o"))).alias("l1"))
    counted = lexicon.join(frequency, "lemma", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    second = counted.groupBy(F.col("wordform").alias("low")).agg(F.max_by("lemma", F.struct("freq", (-F.col("seq")).alias("o"))).alias("l2"))
    joined = forms.withColumn("low", F.lower("form")).join(first, "form", "left").join(second, "low", "left")
    return joined.select("form", F.coalesce("l1", "l2", F.lit("-")).alias("lemma"))


def suffixes(word: Column, most: int = 11) -> Column:
    """The endings of a word of 1 to `most` letters, shorter than the word, the longest first."""
    n = F.least(F.length(word) - 1, F.lit(most))
    return F.when(n > 0, F.transform(F.sequence(n, F.lit(1)), lambda k: F.substr(word, F.length(word) - k + 1, k)))


def join_endings(words: DataFrame, endings: DataFrame) -> DataFrame:
    """Of (word, tag) the first ending by priority of its tag that the word has; accented is its stem with it.

    The theta join becomes an equi-join on (tag, ending) over the words' few endings.
    """
    each = words.select("word", "tag", F.explode(suffixes(F.col("word"))).alias("plain_ending"))
    best = each.join(endings, ["tag", "plain_ending"]).groupBy("word", "tag").agg(F.min_by(F.struct("plain_ending", "accented_ending"), "priority").alias("e"))
    stem = F.substr(F.col("word"), F.lit(1), F.length("word") - F.length("e.plain_ending"))
    return best.select("word", "tag", F.concat(stem, "e.accented_ending").alias("accented"))


def has_ending(words: DataFrame, endings: DataFrame) -> DataFrame:
    """The words with some known ending under any tag."""
    each = words.select("word", F.explode(suffixes(F.lower("word"))).alias("plain_ending"))
    return each.join(endings.select("plain_ending").distinct(), "plain_ending", "left_semi").select("word").distinct()


def longest_suffix(words: DataFrame, table: DataFrame) -> DataFrame:
    """The longest ending of each word that the table (suffix) has."""
    each = words.select("word", F.explode(suffixes(F.col("word"), 7)).alias("suffix"))
    return each.join(table.select("suffix").distinct(), "suffix").groupBy("word").agg(F.max_by("suffix", F.length("suffix")).alias("suffix"))


def known_lemma(words: DataFrame, corpus: DataFrame, lemmas: DataFrame) -> DataFrame:
    """The words that are a corpus form, a lemma, or a lemma in lower case."""
    every = corpus.select(F.col("wordform").alias("word")).unionByName(lemmas.select(F.col("lemma").alias("word"))).unionByName(lemmas.select(F.lower("lemma").alias("word")))
    return words.join(every.distinct(), "word", "left_semi")


def candidates(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The ranked accented forms of (form, tag, lemma): by case, tag distance, lemma distance, then text; only
    those of the least case distance, each once. One distinct form needs no ranking. A capital says nothing where the
    queries have `starts` and it is true: at a sentence's start."""
    key = [c for c in ("form", "tag", "lemma", "starts") if c in queries.columns]
    free = W.is_title(F.col("form")) & F.col("starts") if "starts" in key else F.lit(False)
    entries = lexicon.select("wordform", F.col("tag").alias("_tag"), F.col("lemma").alias("_lemma"), "accented").where("accented <> ''")
    joined = queries.join(entries, F.lower(W.to_ascii(F.col("form"))) == F.col("wordform"))
    case = F.when((W.is_title(F.col("form")) == W.is_title(F.col("_lemma"))) | free, 0).otherwise(1)
    row = F.struct(case.alias("c"), W.tag_distance(F.col("tag"), F.col("_tag")).alias("t"), F.levenshtein("lemma", "_lemma").alias("l"), F.col("accented").alias("a"))
    found = joined.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("r"), F.countDistinct(F.lower("accented")).alias("n"))
    best = F.array_distinct(F.transform(F.filter("r", lambda x: x["c"] == F.col("r")[0]["c"]), lambda x: x["a"]))
    return found.select(*key, best.alias("accented"), (F.col("n") > 1).alias("is_ambiguous"))


def best_of_tag(lexicon: DataFrame) -> DataFrame:
    """Of each (wordform, lemma, tag) the accented form with the most v, j and J; the last of equals wins."""
    count = F.length("accented") - F.length(F.translate("accented", "vjJ", ""))
    return lexicon.groupBy("wordform", "lemma", "tag").agg(F.max_by("accented", F.struct(count.alias("n"), "seq")).alias("accented"))


def lemma_tables(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lemma_freq (lemma, freq) and corpus_lemmas (wordform, ord, lemma, freq) of (pos, word, lemma); ord counts a
    word's lemmas in the order of their first place."""
    freq = tagged.groupBy("lemma").agg(F.count(F.lit(1)).alias("freq"))
    pairs = tagged.groupBy(F.col("word").alias("wordform"), "lemma").agg(F.count(F.lit(1)).alias("freq"), F.min("pos").alias("first"))
    order = Window.partitionBy("wordform").orderBy("first")
    return freq, pairs.select("wordform", (F.row_number().over(order) - 1).cast("long").alias("ord"), "lemma", "freq")


def positional_join(tokens: DataFrame, tags: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Tags written back by place."""
    return tokens.join(tags, list(key), "left")


def merge_distributions(a: DataFrame, b: DataFrame, wa: float, wb: float) -> DataFrame:
    """Word, tag and the weighted mean of two distributions (word, tag, prob)."""
    both = a.withColumnRenamed("prob", "pa").join(b.withColumnRenamed("prob", "pb"), ["word", "tag"], "full_outer")
    return both.select("word", "tag", ((F.coalesce("pa", F.lit(0.0)) * wa + F.coalesce("pb", F.lit(0.0)) * wb) / (wa + wb)).alias("prob"))


def multiword_units(tokens: DataFrame, units: DataFrame) -> DataFrame:
    """The longest units (unit: words joined by spaces) at each place of (doc_id, pos, word), from the left without
    overlap. A unit's words also match with a capital or all in capitals.

    Matches come from joins over n-grams, one for each length that units have; the choice runs over a document's matches
    alone.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    words = F.split("unit", " ")
    table = units.select("unit", F.size(words).alias("n"), F.array_join(F.transform(words, lambda x: F.lower(x)), " ").alias("key")).distinct()
    lengths = sorted(r["n"] for r in table.select("n").distinct().collect())  # as many rows as lengths of units
    found = None
    for n in lengths:
        window = [F.col("word"), *[F.lead("word", k).over(order) for k in range(1, n)]]
        rows = tokens.select("doc_id", "pos", F.array(*window).alias("w")).where(F.forall("w", lambda x: x.isNotNull()))
        each = rows.select("doc_id", "pos", "w", F.array_join(F.transform("w", lambda x: F.lower(x)), " ").alias("key")).join(table.where(F.col("n") == n), "key")
        wanted = F.split("unit", " ")
        fits = F.forall(F.zip_with("w", wanted, lambda x, u: (x == u) | (x == F.concat(F.upper(F.substring(u, 1, 1)), F.substr(u, F.lit(2), F.length(u)))) | (x == F.upper(u))), lambda x: x)
        met = each.where(fits).select("doc_id", "pos", "n", "unit")
        found = met if found is None else found.unionByName(met)
    if found is None:
        return tokens.select("doc_id", "pos", F.lit("").alias("unit")).limit(0)
    best = found.groupBy("doc_id", "pos").agg(F.max(F.struct("n", "unit")).alias("b")).select("doc_id", "pos", F.col("b.n").alias("n"), F.col("b.unit").alias("unit"))
    ordered = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "unit"))).alias("m"))
    empty = F.filter("m", lambda x: F.lit(False))
    chosen = F.aggregate(
        "m",
        F.struct(F.lit(-1).cast("long").alias("end"), empty.alias("out")),
        lambda s, x: F.when(x["pos"] >= s["end"], F.struct((x["pos"] + x["n"]).alias("end"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s),
        lambda s: s["out"],
    )
    return ordered.select("doc_id", F.explode(chosen).alias("x")).select("doc_id", "x.pos", "x.unit")


def lookup_lemma(tagged: DataFrame, table: DataFrame) -> DataFrame:
    """Word, tag and lemma: that of the table (word, tag, lemma), else the word."""
    return tagged.join(table, ["word", "tag"], "left").select(*tagged.columns, F.coalesce("lemma", "word").alias("lemma"))


def lemmatise(tagged: DataFrame, table: DataFrame, unknown: str | None = "<unknown>") -> DataFrame:
    """The lemma of each distinct (word, tag) by the first way that finds one: the word; its lower case; its tail behind
    a hyphen; a sign for numbers; the word under shorter tags (listed with three periods); its longest ending, beginning
    small or with a capital. Else `unknown`, or the word itself if that is null.

    Every way is a row with a rank, so the cascade is one join.
    """
    pairs = tagged.select("word", "tag").distinct()
    none = F.lit(None).cast("string")
    way = lambda rank, word, tag, before, small=False: F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("nth"), word.alias("w"), tag.alias("t"), before.alias("before"), F.lit(small).alias("small"))
    word, tag, blank = F.col("word"), F.col("tag"), F.lit("")
    tail = F.regexp_extract("word", r"^(?s)(.*)-(.+)$", 2)
    head = F.regexp_extract("word", r"^(?s)(.*-)(.+)$", 1)
    parts = F.split("tag", r"\.")
    shorter = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1))).otherwise(F.array().cast("array<int>"))
    general = F.transform(shorter, lambda k: F.struct(F.lit(5).alias("rank"), (F.size(parts) - k).alias("nth"), word.alias("w"), F.concat(F.array_join(F.slice(parts, F.lit(1), k), "."), F.lit("...")).alias("t"), blank.alias("before"), F.lit(False).alias("small")))
    cuts = F.when(F.length("word") > 5, F.sequence(F.lit(1), F.length("word") - 5)).otherwise(F.array().cast("array<int>"))
    rest = lambda i: F.substr(word, i + 1, F.length("word"))
    cut = lambda i, k, w, small: F.struct(F.lit(6).alias("rank"), (i * 2 + k).alias("nth"), w.alias("w"), tag.alias("t"), F.substr(word, F.lit(1), i).alias("before"), F.lit(small).alias("small"))
    endings = F.flatten(F.transform(cuts, lambda i: F.array(cut(i, 0, rest(i), False), cut(i, 1, F.concat(F.upper(F.substr(word, i + 1, F.lit(1))), F.substr(word, i + 2, F.length("word"))), True))))
    first = F.array(way(1, word, tag, blank), way(2, F.lower("word"), tag, blank), way(3, F.when(tail != "", tail), tag, head))
    each = pairs.select("word", "tag", F.explode(F.concat(first, general, endings)).alias("x")).select("word", "tag", "x.*").where("w IS NOT NULL")
    known = table.select(F.col("word").alias("w"), F.col("tag").alias("t"), "lemma")
    found = each.join(known, ["w", "t"]).withColumn("lemma", F.concat("before", F.when(F.col("small"), F.lower("lemma")).otherwise(F.col("lemma"))))
    best = found.groupBy("word", "tag").agg(F.min(F.struct("rank", "nth", "lemma")).alias("b"))
    sign = F.when(tag == "CARD", "<card>").when(word.rlike("^[0-9.,]+$") & tag.rlike(r"^ADJA\.Pos"), "<ord>")
    last = word if unknown is None else F.lit(unknown)
    joined = pairs.join(best, ["word", "tag"], "left")
    early = F.when(F.col("b.rank") <= 3, F.col("b.lemma"))
    return joined.select("word", "tag", F.coalesce(early, sign, F.col("b.lemma"), last, none).alias("lemma"))


def oracle_accuracy(tokens: DataFrame, lexicon: DataFrame, marked: str = "marked") -> DataFrame:
    """How the marked words of tokens (text, marked) agree with a lexicon's forms: words, unknown, correct, and correct
    and wrong ones of forms with one and with several readings."""
    form = W.comparable_word(W.comparable_accent(F.col("accented")))
    per_form = lexicon.where("accented IS NOT NULL").groupBy(F.col("wordform").alias("_form")).agg(F.collect_set(form).alias("_forms"))
    words = tokens.where(W.is_word(F.col("text"))).groupBy(F.lower("text").alias("_low"), F.col(marked).alias("_marked")).agg(F.count(F.lit(1)).alias("n"))
    joined = words.join(per_form, F.col("_low") == F.col("_form"), "left")
    right, one = F.array_contains("_forms", W.comparable_word(F.col("_marked"))), F.size("_forms") == 1
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(name)
    known = F.col("_forms").isNotNull()
    return joined.agg(total(F.lit(True), "words"), total(~known, "unknown"), total(right, "correct"), total(right & one, "unique_correct"), total(right & ~one, "ambiguous_correct"), total(known & ~right & one, "unique_wrong"), total(known & ~right & ~one, "ambiguous_wrong"))


def ordered_endings(endings: DataFrame) -> DataFrame:
    """The endings of each tag, the longest first, then by text."""
    row = F.struct((-F.length("ending")).alias("n"), "ending")
    return endings.groupBy("tag").agg(F.transform(F.array_sort(F.collect_set(row)), lambda x: x["ending"]).alias("endings"))


def ordered_lemmas(corpus: DataFrame) -> DataFrame:
    """The lemmas of each form of a corpus (wordform, ord, lemma, freq), the most frequent first."""
    row = F.struct((-F.col("freq")).alias("f"), "ord", "lemma", "freq")
    return corpus.groupBy("wordform").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["lemma"].alias("lemma"), x["freq"].alias("freq"))).alias("lemmas"))
