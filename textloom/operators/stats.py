"""Statistics: coverage, accuracy, and the counts that taggers are trained on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import words as W

from .lexicon import suffixes
from .tokens import left_join_words


def token_statistics(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, words, known, unknown and ambiguous ones."""
    per_form = lexicon.groupBy("wordform").agg(F.countDistinct(F.lower("accented")).alias("n"))
    forms = tokens.where(W.is_word(F.col("text"))).withColumn("wordform", F.lower(W.to_ascii(F.col("text"))))
    joined = forms.groupBy("doc_id", "wordform").agg(F.count(F.lit(1)).alias("c")).join(per_form, "wordform", "left")
    total = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0)).alias
    return joined.groupBy("doc_id").agg(F.sum("c").alias("words"), total(F.col("n").isNotNull())("known"), total(F.col("n").isNull())("unknown"), total(F.col("n") > 1)("ambiguous"))


def coverage(tokens: DataFrame, lexicon: DataFrame, endings: Column) -> DataFrame:
    """The mean label of all tokens: 0.95 known, 0.85 with a known ending, else 0.60."""
    known = lexicon.select(F.col("wordform").alias("_form"), F.lit(1).alias("_hit")).distinct()
    joined = left_join_words(tokens, known, W.is_word(F.col("text")), F.lower(W.to_ascii(F.col("text"))), "_form")
    # Hundredths, so that the sum is the same in any order.
    label = F.when(F.col("_hit").isNotNull(), 95).when(endings, 85).otherwise(60)
    return joined.groupBy("doc_id").agg((F.sum(label) / F.count(F.lit(1)) / 100).alias("coverage"))


def ending_counts(tagged: DataFrame) -> DataFrame:
    """Per tag the endings of accented forms (tag, accented with marks as letters) whose first letter is long and
    that are more frequent than their plain twin (once, where it is missing)."""
    n = F.least(F.length("accented") - 3, F.lit(12)) - 1
    each = tagged.where(n > 0).select("tag", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.substr(F.col("accented"), F.length("accented") - k + 1, k))).alias("ending"))
    counted = each.groupBy("tag", "ending").agg(F.count(F.lit(1)).alias("n"))
    twin = counted.select("tag", F.col("ending").alias("plain"), F.col("n").alias("twin"))
    marked = counted.where(F.substring("ending", 1, 1).rlike(f"[{W.LONG}]")).withColumn("plain", F.concat(W.remove_marks(F.substring("ending", 1, 1)), F.substr("ending", F.lit(2), F.length("ending"))))
    return marked.join(twin, ["tag", "plain"], "left").where(F.col("n") > F.coalesce("twin", F.lit(1))).select("tag", "ending", "n")


def tag_priors(tagged: DataFrame, sentences: int = 0) -> DataFrame:
    """The share of each tag, each counted once more than it occurs; the boundary occurs once in each sentence."""
    counted = tagged.groupBy("tag").agg((F.count(F.lit(1)) + 1).alias("n"))
    if sentences:
        counted = counted.unionByName(tagged.sparkSession.createDataFrame([("BOUNDARY", sentences + 1)], "tag string, n long"))
    return counted.select("tag", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prob"))


def word_tags(tagged: DataFrame, listed: DataFrame) -> DataFrame:
    """The count of each (word, tag) of a corpus, and 0 for listed ones that it lacks."""
    both = tagged.select("word", "tag", F.lit(1).cast("long").alias("n")).unionByName(listed.select("word", "tag", F.lit(0).cast("long").alias("n")))
    return both.groupBy("word", "tag").agg(F.sum("n").alias("n"))


def tag_probabilities(counts: DataFrame, priors: DataFrame, least_share: float = 0.0) -> DataFrame:
    """A10: p(tag | word): the prior alone if the word is unseen; without the tags rarer than `least_share` of the most
    frequent one, where that is one occurrence or more; Witten-Bell with the prior if some listed tag is unseen; else the
    relative frequency."""
    word = Window.partitionBy("word")
    rows = counts.join(priors.select("tag", F.col("prob").alias("prior")), "tag", "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    rows = rows.withColumns({"total": F.sum("n").over(word), "seen": F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(word), "listed": F.count(F.lit(1)).over(word), "mass": F.sum("prior").over(word)})
    prior = F.when(F.col("mass") > 0, F.col("prior") / F.col("mass")).otherwise(1 / F.col("listed"))
    backed = (F.col("n") + F.col("seen") * prior) / (F.col("total") + F.col("seen"))
    if least_share:
        least = F.max("n").over(word) * least_share
        rows = rows.withColumn("least", F.when(least >= 1, least))
        kept = F.sum(F.when(F.col("n") >= F.col("least"), F.col("n"))).over(word)
        rows = rows.withColumn("kept", kept).where(F.col("least").isNull() | (F.col("n") >= F.col("least")))
        pruned = F.when(F.col("least").isNotNull(), F.col("n") / F.col("kept"))
    else:
        pruned = F.lit(None).cast("double")
    prob = F.when(F.col("total") == 0, prior).when(pruned.isNotNull(), pruned).when(F.col("seen") < F.col("listed"), backed).otherwise(F.col("n") / F.col("total"))
    return rows.select("word", "tag", "n", prob.alias("prob"))


def tag_sets(counts: DataFrame) -> DataFrame:
    """Word and its set of tags as a key."""
    return counts.groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tagset"))


def class_distribution(probs: DataFrame) -> DataFrame:
    """The mean distribution of the words with the same tags."""
    classed = probs.join(tag_sets(probs), "word")
    sums = classed.groupBy("tagset", "tag").agg(F.sum("prob").alias("p"))
    return sums.select("tagset", "tag", (F.col("p") / F.sum("p").over(Window.partitionBy("tagset"))).alias("prob"))


def smooth_by_class(probs: DataFrame, classes: DataFrame, weight: float = 1.0) -> DataFrame:
    """Each word's distribution drawn towards its class's by `weight` observations."""
    total = F.sum("n").over(Window.partitionBy("word"))
    sets = probs.join(tag_sets(probs), "word").withColumn("total", total)
    joined = sets.join(classes.withColumnRenamed("prob", "p"), ["tagset", "tag"])
    return joined.select("word", "tag", ((F.col("prob") * F.col("total") + weight * F.col("p")) / (F.col("total") + weight)).alias("prob"))


def suffix_tag_sums(probs: DataFrame) -> DataFrame:
    """The sum of p(tag | word) over the words with each ending of up to 7 letters, and over all (empty ending)."""
    each = probs.select("tag", "prob", F.explode(F.concat(F.array(F.lit("")), F.coalesce(suffixes(F.col("word"), 7), F.array().cast("array<string>")))).alias("suffix"))
    return each.groupBy("suffix", "tag").agg(F.sum("prob").alias("freq"))


def suffix_probabilities(sums: DataFrame, depth: int = 7) -> DataFrame:
    """p(tag | suffix), Witten-Bell with the ending one letter shorter, level by level: `depth` joins."""
    node = Window.partitionBy("suffix")
    rows = sums.withColumns({"total": F.sum("freq").over(node), "kinds": F.count(F.lit(1)).over(node)})
    level = rows.where("suffix = ''").select("suffix", "tag", (F.col("freq") / F.col("total")).alias("prob"))
    out = level
    for n in range(1, depth + 1):
        own = rows.where(F.length("suffix") == n).withColumn("parent", F.substr("suffix", F.lit(2), F.length("suffix")))
        up = level.select(F.col("suffix").alias("parent"), "tag", F.col("prob").alias("p"))
        level = own.join(up, ["parent", "tag"]).select("suffix", "tag", ((F.col("freq") + F.col("kinds") * F.col("p")) / (F.col("total") + F.col("kinds"))).alias("prob"))
        out = out.unionByName(level)
    return out


def suffix_gains(sums: DataFrame) -> DataFrame:
    """How much each ending tells beyond the one a letter shorter: its divergence times its frequency."""
    node = Window.partitionBy("suffix")
    rows = sums.where("freq > 0").withColumn("total", F.sum("freq").over(node)).withColumn("p", F.col("freq") / F.col("total"))
    up = rows.select(F.col("suffix").alias("parent"), "tag", F.col("p").alias("q"))
    joined = rows.where("suffix <> ''").withColumn("parent", F.substr("suffix", F.lit(2), F.length("suffix"))).join(up, ["parent", "tag"])
    return joined.groupBy("suffix").agg(F.sum(F.col("freq") * F.ln(F.col("p") / F.col("q"))).alias("gain"), F.max("total").alias("freq"))


def context_grams(tagged: DataFrame, context: int = 2) -> DataFrame:
    """How often each tag follows the `context` tags before it in its sentence (key, pos, tag)."""
    order = Window.partitionBy("key").orderBy("pos")
    lags = {f"t{k}": F.coalesce(F.lag("tag", k).over(order), F.lit("BOUNDARY")) for k in range(1, context + 1)}
    return tagged.withColumns(lags).groupBy(*lags, "tag").agg(F.count(F.lit(1)).alias("n"))


def contingency(grams: DataFrame, feature: str, target: str) -> DataFrame:
    """Of each value of the feature how often the tag is `target` and how often another."""
    hit = F.when(F.col("tag") == target, F.col("n")).otherwise(0)
    return grams.groupBy(F.col(feature).alias("feature")).agg(F.sum(hit).alias("yes"), F.sum(F.col("n") - hit).alias("no"))


def information_gain(table: DataFrame) -> DataFrame:
    """The entropy (in nats, times the count) that knowing the feature takes away, for each of its values."""

    def h(a: Column, b: Column) -> Column:
        part = lambda x: F.when(x > 0, -x * F.ln(x / (a + b))).otherwise(0.0)
        return part(a) + part(b)

    every = Window.partitionBy()
    rows = table.withColumns({"Y": F.sum("yes").over(every), "N": F.sum("no").over(every)})
    gain = h(F.col("Y"), F.col("N")) - h(F.col("yes"), F.col("no")) - h(F.col("Y") - F.col("yes"), F.col("N") - F.col("no"))
    return rows.select("feature", "yes", "no", gain.alias("gain"))


def run_counters(words: DataFrame, analyses: DataFrame) -> DataFrame:
    """Words, hits, analyses per hit and lemmas per hit of (word) and (word, lemma); the longest word too."""
    per = analyses.groupBy("word").agg(F.count(F.lit(1)).alias("a"), F.countDistinct(F.when(~F.col("lemma").contains("-"), F.col("lemma"))).alias("l"))
    joined = words.join(per, "word", "left")
    hits = F.count("a")
    return joined.agg(F.count(F.lit(1)).alias("words"), hits.alias("hits"), (F.sum("a") / hits).alias("analyses_per_hit"), (F.sum("l") / hits).alias("lemmas_per_hit"), F.max_by("word", F.struct(F.length("word"), "word")).alias("longest"))


def character_pairs(pairs: DataFrame) -> DataFrame:
    """item_id, pos and the characters of two texts (gold, out) at each place that both have."""
    n = F.least(F.length("gold"), F.length("out"))
    each = pairs.where(n > 0).select("item_id", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.cast("long").alias("pos"), F.substr(F.col("gold"), i, F.lit(1)).alias("g"), F.substr(F.col("out"), i, F.lit(1)).alias("o")))).alias("x"))
    return each.select("item_id", "x.pos", "x.g", "x.o")


def vowel_accuracy(pairs: DataFrame) -> DataFrame:
    """Vowels, correct vowels, and characters that agree, of each item."""
    vowel = W.remove_marks(F.col("g")).rlike("(?i)[aeiouy]")
    chars = character_pairs(pairs)
    return chars.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("chars"), F.count(F.when(F.col("g") == F.col("o"), 1)).alias("same"), F.count(F.when(vowel, 1)).alias("vowels"), F.count(F.when(vowel & (F.col("g") == F.col("o")), 1)).alias("correct")
    )


def mismatches(pairs: DataFrame) -> DataFrame:
    """How often each pair of different characters occurs."""
    return character_pairs(pairs).where("g <> o").groupBy("g", "o").agg(F.count(F.lit(1)).alias("n"))


def mismatch_html(pairs: DataFrame) -> DataFrame:
    """The output with wrong characters marked."""
    shown = W.escape_html(F.col("o"))
    mark = F.when(F.col("g") == F.col("o"), shown).otherwise(F.concat(F.lit('<span class="wrong">'), shown, F.lit("</span>")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", mark.alias("v"))))
    return character_pairs(pairs).groupBy("item_id").agg(F.array_join(F.transform(ordered, lambda s: s["v"]), "").alias("html"))
