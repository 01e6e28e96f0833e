"""Tokens: cutting texts into rows, sentences, verses and clitics, and putting them together again.

A token table has doc_id, idx (from 0) and text; the texts of a document's tokens joined in order are the document.
Everything here partitions by document, and array functions avoid a shuffle where a document's text is at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import words as W

# Words that are split though the lexicon knows them.
SPECIAL = ("nec", "neque", "necnon", "seque", "seseque", "quique", "mecumque", "tecumque", "secumque")
# Compounds, and how many of their last letters are a word of their own.
COMPOUNDS = {
    "nequid": 4, "attamen": 5, "unusquisque": 7, "unaquaeque": 7, "unumquodque": 7, "uniuscuiusque": 8, "uniuscujusque": 8,
    "unicuique": 6, "unumquemque": 7, "unamquamque": 7, "unoquoque": 6, "unaquaque": 6, "cuiusmodi": 4, "cujusmodi": 4,
    "quojusmodi": 4, "eiusmodi": 4, "ejusmodi": 4, "huiuscemodi": 4, "hujuscemodi": 4, "huiusmodi": 4, "hujusmodi": 4,
    "istiusmodi": 4, "nullomodo": 4, "quodammodo": 4, "nudiustertius": 7, "nonnisi": 4, "plusquam": 4, "proculdubio": 5,
    "quamplures": 6, "quamprimum": 6, "quinetiam": 5, "uerumetiam": 5, "verumetiam": 5, "verumtamen": 5, "uerumtamen": 5,
    "paterfamilias": 8, "patrisfamilias": 8, "patremfamilias": 8, "patrifamilias": 8, "patrefamilias": 8, "patresfamilias": 8,
    "patrumfamilias": 8, "patribusfamilias": 8, "materfamilias": 8, "matrisfamilias": 8, "matremfamilias": 8,
    "matrifamilias": 8, "matrefamilias": 8, "matresfamilias": 8, "matrumfamilias": 8, "matribusfamilias": 8, "respublica": 7,
    "reipublicae": 8, "rempublicam": 8, "senatusconsultum": 9, "senatusconsulto": 8, "senatusconsulti": 8, "usufructu": 6,
    "usumfructum": 7, "ususfructus": 7, "supradicti": 5, "supradictum": 6, "supradictus": 6, "supradicto": 5, "seipse": 4,
    "seipsa": 4, "seipsum": 5, "seipsam": 5, "seipso": 4, "seipsos": 5, "seipsas": 5, "seipsis": 5, "semetipse": 4,
    "semetipsa": 4, "semetipsum": 5, "semetipsam": 5, "semetipso": 4, "semetipsos": 5, "semetipsas": 5, "semetipsis": 5,
    "teipsum": 5, "temetipsum": 5, "vosmetipsos": 5, "idipsum": 5,
}


#: Rows of a table that is broadcast; a larger one is joined by shuffling the words that need it.
MOST_BROADCAST = 500_000


def left_join_words(tokens: DataFrame, table: DataFrame, needed: Column, key: Column, on: str) -> DataFrame:
    """`tokens` with the row of `table` (one for each `on`) that `key` names, or nulls where it has none or is not `needed`.

    The table is counted: a small one goes to the tokens, which then stay where they are. Else only the tokens that need
    it move, so blanks and punctuation, which a corpus has most of, are no hot keys.
    """
    if table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return tokens.join(F.broadcast(table), needed & (key == F.col(on)), "left")
    met = tokens.where(needed).join(table, key == F.col(on), "left")
    return met.unionByName(tokens.where(~F.coalesce(needed, F.lit(False))), allowMissingColumns=True)


def token_array(text: Column) -> Column:
    """Letters, white space, punctuation, digits: runs of each; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(f"({W.TOKEN})"), F.lit(1))


def tokenise(docs: DataFrame, text: str = "text", key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """P01 as rows: the key, idx and text."""
    return docs.select(*key, F.posexplode(token_array(F.col(text))).alias("idx", "text")).withColumn("idx", F.col("idx").cast("long"))


def tokenise_ascii(docs: DataFrame) -> DataFrame:
    """Words of ASCII letters, digits, - and _; every other character by itself."""
    parts = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_-]+|[^A-Za-z0-9_-])"), F.lit(1))
    return docs.select("doc_id", F.posexplode(parts).alias("idx", "text")).withColumn("idx", F.col("idx").cast("long"))


def words_only(text: Column) -> Column:
    """The words between white space, punctuation and symbols of a composed text (see readers.normalise)."""
    return F.filter(F.split(text, rf"[{W.SPACE}\p{{P}}\p{{S}}]+"), lambda x: x != "")


def split_sentences(text: Column) -> Column:
    """Cut behind . ! ? and white space, trimmed, without empty ones."""
    cut = F.split(F.regexp_replace(text, r"([.!?])[\x09-\x0D\x20]+", "$1\n"), "\n")
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def plain_text(text: Column) -> Column:
    """P09."""
    return F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " "))


def _by_doc(*key: str):
    return Window.partitionBy(*key).orderBy("idx")


def sentence_flags(tokens: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """is_word, ends_sentence, sentence_id (from 0) and starts_sentence.

    A token with . ; : ? or ! ends a sentence if the last word before it has more than one letter and no such token has
    come since that word.
    """
    before = _by_doc(*key).rowsBetween(Window.unboundedPreceding, -1)
    word, ender = W.is_word(F.col("text")), ~W.is_word(F.col("text")) & W.is_sentence_ender(F.col("text"))
    last_word = F.last(F.when(word, F.struct("idx", F.length("text").alias("n"))), ignorenulls=True).over(before)
    last_ender = F.last(F.when(ender, F.col("idx")), ignorenulls=True).over(before)
    seen = tokens.withColumns({"is_word": word, "_w": last_word, "_e": last_ender})
    ends = F.coalesce(ender & (F.col("_w.n") > 1) & (F.col("_e").isNull() | (F.col("_e") < F.col("_w.idx"))), F.lit(False))
    flagged = seen.withColumn("ends_sentence", ends).drop("_w", "_e")
    numbered = flagged.withColumn("sentence_id", F.coalesce(F.sum(F.col("ends_sentence").cast("long")).over(before), F.lit(0)))
    earlier = F.sum(F.col("is_word").cast("long")).over(Window.partitionBy(*key, "sentence_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return numbered.withColumn("starts_sentence", F.col("is_word") & (F.coalesce(earlier, F.lit(0)) == 0))


def offsets(tokens: DataFrame) -> DataFrame:
    """Start and end of each token in its document."""
    end = F.sum(F.length("text")).over(_by_doc("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return tokens.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))


def detokenise(tokens: DataFrame, value: str = "text") -> DataFrame:
    """The document again."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", F.col(value).alias("v"))))
    return tokens.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["v"]), "").alias("text"))


def verse_ids(tokens: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The number of line feeds in the tokens before."""
    feeds = F.length(F.col("text")) - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    before = F.sum(feeds).over(_by_doc(*key).rowsBetween(Window.unboundedPreceding, -1))
    return tokens.withColumn("verse_id", F.coalesce(before, F.lit(0)).cast("long"))


def sentences(flagged: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The sentences of tokens with sentence_flags: sentence_id, the number of words and the text."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))
    text = F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias("sentence")
    return flagged.groupBy(*key, "sentence_id").agg(F.count(F.when(F.col("is_word"), 1)).alias("words"), text)


def word_tails(docs: DataFrame, text: str = "text") -> DataFrame:
    """The words of a document with what stands between them: doc_id, idx, text (a word, or nothing at the beginning), tail
    (what comes before the next word) and starts (W02: whether it starts a sentence: a longer word and . ; : ? or ! come
    before it). Joined in order they are the document, with half the rows of its tokens."""
    letter = r"\p{L}\p{Nl}\p{No}"
    pairs = [F.regexp_extract_all(text, F.lit(rf"(?s)([{letter}]+|^)([^{letter}]*)"), F.lit(k)) for k in (1, 2)]
    arrays = docs.select("doc_id", pairs[0].alias("w"), pairs[1].alias("t"))
    before = lambda i: (F.length(F.get("w", i - 1)) > 1) & W.is_sentence_ender(F.get("t", i - 1))
    starts = F.transform("w", lambda x, i: F.coalesce((i == 0) | ((i == 1) & (F.get("w", F.lit(0)) == "")) | before(i), F.lit(False)))
    rows = arrays.select("doc_id", F.posexplode(F.arrays_zip("w", "t", starts.alias("s"))).alias("idx", "x"))
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("x.w").alias("text"), F.col("x.t").alias("tail"), F.col("x.s").alias("starts")).where("text <> '' OR tail <> ''")


def generic_clitic(word: Column) -> Column:
    """The clitic that a word ends with, or nothing; the word must be longer."""
    low = F.lower(word)
    found = F.when((F.length(low) > 3) & low.endswith("que"), "que")
    for clitic in ("ve", "ue", "ne", "st"):
        found = found.when((F.length(low) > 2) & low.endswith(clitic), clitic)
    return found.otherwise("")


def could_split(text: Column, low: Column) -> Column:
    """P10: whether a word, in lower case `low`, could have parts."""
    ends = low.endswith("ue") | low.endswith("ve") | low.endswith("ne") | low.endswith("st")
    return ((ends & (F.length(low) > 2)) | low.isin("nec", "necnon", *COMPOUNDS)) & (low != "que") & W.is_word(text)


def clitic_size(low: Column) -> Column:
    """How many of a lower-case word's last letters are a part of their own."""
    size = F.element_at(F.create_map(*[F.lit(v) for kv in COMPOUNDS.items() for v in kv]), low)
    return F.when(low == "nec", 1).otherwise(F.coalesce(size, F.when((F.length(low) > 3) & low.endswith("que"), 3).otherwise(2)))


def clitic_parts(text: Column, low: Column, size: Column) -> Column:
    """The parts of a word, as structs of text and kind: word, bearer or clitic. size: of the last part, or null."""
    part = lambda x, kind: F.struct(x.alias("text"), kind.alias("kind"))
    word, bearer, clitic = F.lit("word"), F.lit("bearer"), F.lit("clitic")
    nec = F.array(part(F.substring(text, 1, 2), bearer), part(F.substring(text, 3, 1), clitic), part(F.substring(text, 4, 3), word))
    whole, left = low.isin(*COMPOUNDS), F.length(text) - size
    cut = F.array(part(F.substr(text, F.lit(1), left), F.when(whole, word).otherwise(bearer)), part(F.substr(text, left + 1, size), F.when(whole, word).otherwise(clitic)))
    return F.when(size.isNull(), F.array(part(text, word))).when(low == "necnon", nec).otherwise(cut)


def with_parts(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """`words` (text) with _parts, their clitic_parts. lexicon: wordform.

    Only words that could be split are looked up, and only among such forms of the lexicon.
    """
    form, low = F.col("_form"), F.col("_low")
    known = lexicon.select(F.col("wordform").alias("_form"), F.lit(True).alias("_known")).where(could_split(form, F.lower(form))).distinct()
    lowered = words.withColumn("_low", F.lower("text")).withColumn("_low", F.when(could_split(F.col("text"), low), low))
    marked = left_join_words(lowered, known, low.isNotNull(), low, "_form")
    # Steps of their own: what several expressions use is computed once for a token.
    sized = marked.withColumn("_size", F.when(low.isNotNull() & (F.col("_known").isNull() | low.isin(*SPECIAL)), clitic_size(low)))
    return sized.withColumn("_parts", clitic_parts(F.col("text"), low, F.col("_size"))).drop("_form", "_known", "_low", "_size")


def split_clitics(tokens: DataFrame, lexicon: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """P10 as rows: the token table with sub_idx and kind. lexicon: wordform."""
    marked = with_parts(tokens, lexicon)
    # No token is without parts; the outer form keeps Spark from making them once more for a filter on their number.
    return marked.select(*key, "idx", F.posexplode_outer("_parts").alias("sub_idx", "part")).select(*key, "idx", F.col("sub_idx").cast("long"), "part.text", "part.kind")


def tagger_stream(split: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The words as a tagger reads them: no spaces, all-capital ones lower, a clitic before its bearer."""
    shown = split.where(~W.is_space(F.col("text")))
    word = F.when(W.is_all_caps(F.col("text")), F.lower("text")).otherwise(F.col("text"))
    # A bearer moves behind the clitic that follows it.
    place = F.col("sub_idx") + F.when(F.col("kind") == "bearer", 1.5).otherwise(0.0)
    order = Window.partitionBy(*key).orderBy("idx", place)
    return shown.withColumn("pos", F.row_number().over(order).cast("long")).withColumn("word", W.to_ascii(word))


def display_lines(tokens: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """P25: verse_id and the line's text."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return verse_ids(tokens, key).groupBy(*key, "verse_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias("line"))


# Characters cut off before and behind a word, and clitics by language.
PEEL_FRONT, PEEL_BACK = r"[\[{(`\"‚„†‡‹‘’“”•–—›]", r"[\]}'`\"),;:!?%‚„…†‡‰‹‘’“”•–—›]"
FRONT_CLITICS = {"fr": "[dcjlmnstDCJLNMST]'|[Qq]u'|[Jj]usqu'|[Ll]orsqu'", "it": "[dD][ae]ll'|[nN]ell'|[Aa]ll'|[lLDd]'|[Ss]ull'|[Qq]uest'|[Uu]n'|[Ss]enz'|[Tt]utt'"}
BACK_CLITICS = {"en": "'(?:s|re|ve|d|m|em|ll)|n't", "fr": "-t-elles?|-t-ils?|-t-on|-ce|-elles?|-ils?|-je|-la|-les?|-leur|-lui|-mêmes?|-m'|-moi|-nous|-on|-toi|-tu|-t'|-vous|-en|-y|-ci|-là"}


def _characters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def peel(chunk: Column, language: str | None = None, whole: tuple[str, ...] = ()) -> Column:
    """One chunk between white space as the tokens it falls into.

    Punctuation comes off at both ends, but never all of a chunk. Listed words (`whole`, such as abbreviations) and letters
    with periods (U.S.) then stay; a last period parts from others that are no number; clitics come off last.
    """
    front = F.regexp_extract(chunk, rf"(?s)^({PEEL_FRONT}*)(.+)$", 1)
    rest = F.substr(chunk, F.length(front) + 1, F.length(chunk))
    # Behind a word: punctuation, each with a period behind it or not.
    core = F.regexp_extract(rest, rf"(?s)^(.+?)((?:{PEEL_BACK}\.?)*)$", 1)
    back = F.substr(rest, F.length(core) + 1, F.length(rest))
    listed = core.isin(*whole) if whole else F.lit(False)
    short = core.rlike(r"^([A-Za-z-]\.)+$")
    part = ~listed & ~short & core.rlike(r"(?s)^.+\.$") & (core != "...") & ~core.rlike(r"^[0-9]+\.$")
    stem = F.when(part, F.substr(core, F.lit(1), F.length(core) - 1)).otherwise(core)
    stays = listed | short | (stem.isin(*whole) if whole else F.lit(False))
    period = F.when(part, F.array(F.lit("."))).otherwise(F.array().cast("array<string>"))
    before, middle, behind = F.array().cast("array<string>"), stem, F.array().cast("array<string>")
    if language in FRONT_CLITICS:
        taken = F.regexp_extract(stem, rf"(?s)^((?:{FRONT_CLITICS[language]})+)(?=.)", 1)
        before = F.when(stays, before).otherwise(F.regexp_extract_all(taken, F.lit(f"({FRONT_CLITICS[language]})"), F.lit(1)))
        middle = F.when(stays, stem).otherwise(F.substr(stem, F.length(taken) + 1, F.length(stem)))
    if language in BACK_CLITICS:
        left = F.regexp_extract(middle, rf"(?s)^(.+?)((?:{BACK_CLITICS[language]})*)$", 1)
        cut = F.regexp_extract_all(F.substr(middle, F.length(left) + 1, F.length(middle)), F.lit(f"({BACK_CLITICS[language]})"), F.lit(1))
        behind, middle = F.when(stays, behind).otherwise(cut), F.when(stays, middle).otherwise(left)
    return F.filter(F.concat(_characters(front), before, F.array(middle), behind, period, _characters(back)), lambda x: x != "")


def tokenise_markup(pages: DataFrame, html: str = "html", language: str | None = None, whole: tuple[str, ...] = (), key: str = "page_id") -> DataFrame:
    """P04 as rows: idx and text; tags stay whole. Blanks that punctuation lacks are put in first."""
    parts = F.regexp_extract_all(html, F.lit(r"(?s)(<[^<>]*>|[^<]+|<)"), F.lit(1))

    def words(x: Column) -> Column:
        spaced = F.replace(F.concat(F.lit(" "), x, F.lit(" ")), F.lit("..."), F.lit(" ... "))
        spaced = F.regexp_replace(spaced, r"([;!?])([^\x20\x09-\x0D])", "$1 $2")
        spaced = F.regexp_replace(spaced, r"([.,:])([^\x20\x09-\x0D0-9.])", "$1 $2")
        chunks = F.filter(F.split(spaced, r"[\x20\x09-\x0D]+"), lambda c: c != "")
        return F.flatten(F.transform(chunks, lambda c: peel(c, language, whole)))

    peeled = F.flatten(F.transform(parts, lambda x: F.when(x.rlike("(?s)^<.*>$"), F.array(x)).otherwise(words(x))))
    return pages.select(key, F.posexplode(peeled).alias("idx", "text")).withColumn("idx", F.col("idx").cast("long"))
