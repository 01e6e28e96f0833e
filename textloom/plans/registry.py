"""Queries over the driver's tables, one or more for each family of operators, with DuckDB's SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import words as W
from textloom.operators import lexicon as L
from textloom.operators import morphology as M
from textloom.operators import sequence as Q
from textloom.operators import stats as S
from textloom.operators import tagger as G
from textloom.operators import tokens as T
from textloom.sources import readers as R
from textloom.sources import sinks as K

from . import fixtures as X
from .fixtures import LEXICON_SQL, table
from .pipeline import restore_marks
from .scalars import SQL_T, distance_sql, pseudo_tag

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

WORD = r"^[\p{L}\p{Nl}\p{No}]"
SPACE = W.SPACE
TOK = rf"tok AS MATERIALIZED (SELECT doc_id, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS idx FROM (SELECT doc_id, regexp_extract_all(text, '({W.TOKEN})', 1) AS t FROM documents))"
CTOK = rf"ctok AS MATERIALIZED (SELECT conv_id, turn, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS idx FROM (SELECT conv_id, turn, regexp_extract_all(text, '({W.TOKEN})', 1) AS t FROM conversations))"
FORMS = rf"forms AS MATERIALIZED (SELECT DISTINCT lower(translate(replace(replace(replace(replace(text, 'æ', 'ae'), 'Æ', 'Ae'), 'œ', 'oe'), 'Œ', 'Oe'), 'äëïöüÿ', 'aeiouu')) AS wordform FROM tok WHERE regexp_matches(text, '{WORD}'))"
ASCII = "translate(replace(replace(replace(replace({}, 'æ', 'ae'), 'Æ', 'Ae'), 'œ', 'oe'), 'Œ', 'Oe'), 'äëïöüÿ', 'aeiouu')"


def _comparable(x: str) -> str:
    """words.comparable_accent in SQL."""
    x = f"regexp_replace({x}, '_?\\^', '', 'g')"
    for p, q in zip(W.PLAIN, W.LONG, strict=True):
        x = x if p in "yY" else f"replace({x}, '{p}_', '{q}')"
    return x


def _unicode_marks(x: str) -> str:
    """words.marks_to_unicode in SQL."""
    for a, b in [*((p + "_", q) for p, q in zip(W.PLAIN, W.LONG, strict=True)), *W.DIAERESIS.items()]:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def sql() -> dict[str, str]:
    return dict(_SQL)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tokenise(docs(spark, sf_dir))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.word_forms(tokens(spark, sf_dir))


# Tokens


@query(f"WITH {TOK} SELECT * FROM tok")
def p01_tokenise(spark, d):
    return tokens(spark, d)


@query("SELECT doc_id, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS idx FROM (SELECT doc_id, regexp_extract_all(text, '([A-Za-z0-9_-]+|[^A-Za-z0-9_-])', 1) AS t FROM documents)".replace("[^A-Za-z0-9_-]", r"(?s:[^A-Za-z0-9_-])"))
def p02_tokenise_ascii(spark, d):
    return T.tokenise_ascii(docs(spark, d))


@query(rf"SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[{SPACE}\p{{P}}\p{{S}}]+'), lambda x: x <> '')) AS word FROM documents")
def p03_words_only(spark, d):
    return docs(spark, d).select("doc_id", F.explode(T.words_only(F.col("text"))).alias("word"))


_FRONT, _BACK = T.PEEL_FRONT.replace("'", "''"), T.PEEL_BACK.replace("'", "''")
_WS = r"[\x20\x09-\x0D]"
MARKUP_SQL = rf"""WITH segment AS (SELECT page_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)(<[^<>]*>|[^<]+|<)', 1) AS p FROM pages)),
spaced AS (SELECT page_id, i, regexp_matches(x, '(?s)^<.*>$') AS tag, x, regexp_replace(regexp_replace(replace(' ' || x || ' ', '...', ' ... '), '([;!?])([^\x20\x09-\x0D])', '\1 \2', 'g'), '([.,:])([^\x20\x09-\x0D0-9.])', '\1 \2', 'g') AS s FROM segment),
chunk AS (SELECT page_id, i, tag, unnest(c) AS c, generate_subscripts(c, 1) AS j FROM (SELECT page_id, i, tag, CASE WHEN tag THEN [x] ELSE list_filter(regexp_split_to_array(s, '{_WS}+'), lambda y: y <> '') END AS c FROM spaced)),
fronts AS (SELECT *, CASE WHEN tag THEN '' ELSE regexp_extract(c, '(?s)^({_FRONT}*)(.+)$', 1) END AS front FROM chunk),
rests AS (SELECT *, substr(c, length(front) + 1) AS rest FROM fronts),
cores AS (SELECT *, CASE WHEN tag THEN rest ELSE regexp_extract(rest, '(?s)^(.+?)((?:{_BACK}\.?)*)$', 1) END AS core FROM rests),
stems AS (SELECT *, substr(rest, length(core) + 1) AS back, NOT tag AND NOT regexp_matches(core, '^([A-Za-z-]\.)+$') AND regexp_matches(core, '(?s)^.+\.$') AND core <> '...' AND NOT regexp_matches(core, '^[0-9]+\.$') AS part FROM cores),
token AS (SELECT page_id, i, j, list_filter(list_concat(string_split(front, ''), [CASE WHEN part THEN left(core, length(core) - 1) ELSE core END], CASE WHEN part THEN ['.'] ELSE [] END, string_split(back, '')), lambda y: y <> '') AS t FROM stems),
each AS (SELECT page_id, i, j, unnest(t) AS text, generate_subscripts(t, 1) AS k FROM token)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i, j, k) - 1 AS idx, text FROM each"""


@query(MARKUP_SQL)
def p04_tokenise_markup(spark, d):
    return T.tokenise_markup(table(spark, d, "pages"))


@query(r"SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\x09-\x0D\x20]+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS sentence FROM documents")
def p05_split_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.explode(T.split_sentences(F.col("text"))).alias("sentence"))


FLAGS = rf"""{CTOK},
w AS (SELECT *, regexp_matches(text, '{WORD}') AS is_word, NOT regexp_matches(text, '{WORD}') AND regexp_matches(text, '[.;:?!]') AS ender FROM ctok),
s AS (SELECT *, last_value(CASE WHEN is_word THEN idx END IGNORE NULLS) OVER p AS w, last_value(CASE WHEN is_word THEN length(text) END IGNORE NULLS) OVER p AS n, last_value(CASE WHEN ender THEN idx END IGNORE NULLS) OVER p AS e
  FROM w WINDOW p AS (PARTITION BY conv_id, turn ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT conv_id, turn, idx, text, is_word, coalesce(ender AND n > 1 AND (e IS NULL OR e < w), false) AS ends_sentence FROM s),
g AS (SELECT *, coalesce(sum(ends_sentence::INT) OVER (PARTITION BY conv_id, turn ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence_id FROM f),
flagged AS (SELECT *, is_word AND coalesce(sum(is_word::INT) OVER (PARTITION BY conv_id, turn, sentence_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS starts_sentence FROM g)"""


def conversation_tokens(spark, d):
    return T.tokenise(table(spark, d, "conversations"), key=("conv_id", "turn"))


@query(f"WITH {FLAGS} SELECT * FROM flagged")
def w01_sentence_flags(spark, d):
    return T.sentence_flags(conversation_tokens(spark, d), ("conv_id", "turn"))


@query(f"WITH {FLAGS} SELECT conv_id, turn, sentence_id, count(*) FILTER (WHERE is_word) AS words, string_agg(text, '' ORDER BY idx) AS sentence FROM flagged GROUP BY ALL")
def p06_sentences(spark, d):
    key = ("conv_id", "turn")
    return T.sentences(T.sentence_flags(conversation_tokens(spark, d), key), key)


@query(f"WITH {TOK} SELECT *, (sum(length(text)) OVER w)::BIGINT AS \"end\", (sum(length(text)) OVER w)::BIGINT - length(text) AS start FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY idx)")
def w03_offsets(spark, d):
    return T.offsets(tokens(spark, d))


@query("SELECT doc_id, text FROM documents WHERE text <> ''")
def p07_detokenise(spark, d):
    return T.detokenise(tokens(spark, d))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g')) AS plain FROM documents")
def p09_plain_text(spark, d):
    return docs(spark, d).select("doc_id", T.plain_text(F.col("text")).alias("plain"))


@query(rf"WITH {TOK} SELECT text, regexp_matches(text, '{WORD}') AS word, NOT regexp_matches(text, '[\p{{L}}\p{{N}}_{SPACE}]') AS punctuation, regexp_full_match(text, '[{SPACE}]*') AS space, regexp_matches(text, '[.;:?!]') AS ender, count(*) AS n FROM tok GROUP BY ALL")
def p16_token_classes(spark, d):
    x = F.col("text")
    counted = tokens(spark, d).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("text", W.is_word(x).alias("word"), W.is_punctuation(x).alias("punctuation"), W.is_space(x).alias("space"), W.is_sentence_ender(x).alias("ender"), "n")


_COMPOUNDS = ", ".join(f"('{k}', {v})" for k, v in T.COMPOUNDS.items())
CLITIC = f"""{TOK}, {LEXICON_SQL},
compound(form, n) AS (VALUES {_COMPOUNDS}),
known AS (SELECT DISTINCT wordform FROM lexicon),
cand AS (SELECT tok.*, lower(text) AS low, regexp_matches(text, '{WORD}') AND lower(text) <> 'que' AND (k.wordform IS NULL OR lower(text) IN ({", ".join(f"'{x}'" for x in T.SPECIAL)})) AS tried
  FROM tok LEFT JOIN known k ON lower(text) = k.wordform),
cuts AS (SELECT c.*, CASE WHEN NOT tried THEN NULL WHEN low = 'nec' THEN 1 WHEN n IS NOT NULL THEN n WHEN length(low) > 3 AND ends_with(low, 'que') THEN 3
  WHEN length(low) > 2 AND (ends_with(low, 've') OR ends_with(low, 'ue') OR ends_with(low, 'ne') OR ends_with(low, 'st')) THEN 2 END AS cut, n IS NOT NULL AS whole FROM cand c LEFT JOIN compound ON low = form),
parts AS (SELECT doc_id, idx, CASE WHEN tried AND low = 'necnon' THEN [(substr(text, 1, 2), 'bearer'), (substr(text, 3, 1), 'clitic'), (substr(text, 4, 3), 'word')]
  WHEN cut IS NULL THEN [(text, 'word')] WHEN whole THEN [(left(text, length(text) - cut), 'word'), (right(text, cut), 'word')]
  ELSE [(left(text, length(text) - cut), 'bearer'), (right(text, cut), 'clitic')] END AS p FROM cuts),
split AS (SELECT doc_id, idx, generate_subscripts(p, 1) - 1 AS sub_idx, unnest(p) AS x FROM parts)"""


@query(f"WITH {CLITIC} SELECT doc_id, idx, sub_idx, x[1] AS text, x[2] AS kind FROM split")
def p10_split_clitics(spark, d):
    return T.split_clitics(tokens(spark, d), X.lexicon(spark, d))


@query(f"""WITH {CLITIC}, named AS (SELECT doc_id, idx, sub_idx, x[1] AS text, x[2] AS kind FROM split),
shown AS (SELECT * FROM named WHERE NOT regexp_full_match(text, '[{SPACE}]*'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx, sub_idx + CASE WHEN kind = 'bearer' THEN 1.5 ELSE 0 END) AS pos,
  {ASCII.format("CASE WHEN text = upper(text) THEN lower(text) ELSE text END")} AS word FROM shown""")
def p21_tagger_stream(spark, d):
    # Documents move before they are cut: their tokens, many times as many rows, are then numbered where they are.
    cut = T.tokenise(docs(spark, d).repartition("doc_id"))
    return T.tagger_stream(T.split_clitics(cut, X.lexicon(spark, d))).select("doc_id", "pos", "word")


VERSES = f"""{CTOK}, verse AS (SELECT *, coalesce(sum(length(text) - length(replace(text, chr(10), ''))) OVER (PARTITION BY conv_id, turn ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS verse_id FROM ctok)"""


@query(f"WITH {VERSES} SELECT * FROM verse")
def w06_verse_ids(spark, d):
    return T.verse_ids(conversation_tokens(spark, d), ("conv_id", "turn"))


@query(f"WITH {VERSES} SELECT conv_id, turn, verse_id, CASE verse_id % 2 WHEN 0 THEN 'hexameter' ELSE 'pentameter' END AS meter, string_agg(text, '' ORDER BY idx) AS line FROM verse GROUP BY ALL")
def w07_meter_cycle(spark, d):
    key = ("conv_id", "turn")
    lines = T.display_lines(conversation_tokens(spark, d), key)
    return lines.withColumn("meter", Q.meter_of(F.col("verse_id"), Q.METER_CYCLES["elegiac"]))


# Lexicon


@query(f"WITH {TOK}, {FORMS} SELECT * FROM forms")
def a01_word_forms(spark, d):
    return forms(spark, d)


@query(f"WITH {TOK}, {FORMS}, {LEXICON_SQL} SELECT wordform, seq, tag, lemma, accented FROM forms LEFT JOIN lexicon USING (wordform)")
def j01_lexicon_join(spark, d):
    return L.join_all(forms(spark, d), X.lexicon(spark, d))


@query(f"WITH {TOK}, {FORMS}, {LEXICON_SQL} SELECT wordform FROM forms WHERE wordform NOT IN (SELECT wordform FROM lexicon)")
def j02_missing_forms(spark, d):
    return L.missing(forms(spark, d), X.lexicon(spark, d))


@query(f"WITH {TOK}, {FORMS}, {LEXICON_SQL} SELECT wordform FROM forms WHERE wordform IN (SELECT wordform FROM lexicon)")
def j03_known_forms(spark, d):
    return L.known(forms(spark, d), X.lexicon(spark, d))


@query(f"WITH {LEXICON_SQL} SELECT wordform, tag, arg_min(accented, (other, seq)) AS accented FROM (SELECT l.wordform, w.tag, accented, l.tag <> w.tag AS other, seq FROM lexicon l JOIN (SELECT wordform, max(tag) AS tag FROM lexicon GROUP BY wordform) w ON l.wordform = w.wordform) GROUP BY ALL")
def j06_exact_or_first(spark, d):
    lexicon = X.lexicon(spark, d)
    return L.lookup_exact_or_first(lexicon.groupBy("wordform").agg(F.max("tag").alias("tag")), lexicon)


CORPUS = rf"corpus AS (SELECT {ASCII.format('text')} AS wordform, left(lower(text), 3) AS lemma, count(*) AS freq FROM ctok WHERE regexp_matches(text, '{WORD}') GROUP BY ALL)"


def corpus_lemmas(spark, d):
    """wordform, lemma, freq and ord: the lemma's first place in the corpus, so that of equally frequent ones the first wins."""
    words = conversation_tokens(spark, d).where(W.is_word(F.col("text")))
    pairs = words.groupBy(W.to_ascii(F.col("text")).alias("wordform"), F.substring(F.lower("text"), 1, 3).alias("lemma"))
    counted = pairs.agg(F.count(F.lit(1)).alias("freq"), F.min(F.struct("conv_id", "turn", "idx")).alias("first"))
    order = Window.partitionBy("wordform").orderBy("first", "lemma")
    return counted.select("wordform", "lemma", "freq", (F.row_number().over(order) - 1).cast("long").alias("ord"))


@query(f"""WITH {TOK}, {CTOK}, {LEXICON_SQL}, {CORPUS},
f AS (SELECT DISTINCT {ASCII.format('text')} AS form FROM tok WHERE regexp_matches(text, '{WORD}')),
c AS (SELECT wordform, arg_max(lemma, freq) AS l1 FROM corpus GROUP BY wordform),
q AS (SELECT lemma, count(*) AS freq FROM lexicon GROUP BY lemma),
s AS (SELECT wordform, arg_max(lemma, (freq, -seq)) AS l2 FROM lexicon JOIN q USING (lemma) GROUP BY wordform)
SELECT form, coalesce(l1, l2, '-') AS lemma FROM f LEFT JOIN c ON form = c.wordform LEFT JOIN s ON lower(form) = s.wordform""")
def j04_best_lemmas(spark, d):
    lexicon = X.lexicon(spark, d)
    return L.best_lemmas(tokens(spark, d), corpus_lemmas(spark, d), lexicon, lexicon.groupBy("lemma").agg(F.count(F.lit(1)).alias("freq")))


SUFFIX = "unnest(list_transform(range(1, least(length({w}) - 1, {n}) + 1), lambda k: right({w}, k)))"
ENDING_ROWS = [(t, i, e) for t, es in (("v1sp", ("a_re", "re")), ("a--s--m", ("e_us", "us")), ("a--s--f", ("ri_a", "ti_a", "a_")), ("---------", ("tio_n", "i_ng", "e_n", "ha_t", "e_"))) for i, e in enumerate(es)]


def endings(spark):
    return X.inline(spark, ENDING_ROWS, "tag string, priority int, accented_ending string").withColumn("plain_ending", F.translate("accented_ending", "_^", ""))


TAGGED_WORDS = f"tagged AS (SELECT wordform AS word, CASE WHEN wordform LIKE '%are' THEN 'v1sp' WHEN wordform LIKE '%ēre' THEN 'v2sp' WHEN wordform LIKE '%ere' THEN 'v3sp' WHEN wordform LIKE '%īre' THEN 'v4sp' WHEN wordform LIKE '%us' THEN 'a--s--m' WHEN wordform LIKE '%um' THEN 'a--s--n' WHEN wordform LIKE '%a' THEN 'a--s--f' ELSE '---------' END AS tag FROM forms)"
ENDINGS_SQL = "ending(tag, priority, accented_ending) AS (VALUES " + ", ".join(f"('{t}', {i}, '{e}')" for t, i, e in ENDING_ROWS) + ")"


@query(f"""WITH {TOK}, {FORMS}, {TAGGED_WORDS}, {ENDINGS_SQL},
hit AS (SELECT word, t.tag, arg_min(accented_ending, priority) AS e FROM tagged t JOIN ending e ON t.tag = e.tag AND ends_with(word, replace(accented_ending, '_', '')) AND length(word) > length(replace(accented_ending, '_', '')) GROUP BY ALL)
SELECT word, tag, left(word, length(word) - length(replace(e, '_', ''))) || e AS accented FROM hit""")
def j05_endings(spark, d):
    words = forms(spark, d).select(F.col("wordform").alias("word"), W.fallback_tag(F.col("wordform")).alias("tag"))
    return L.join_endings(words, endings(spark))


@query(f"WITH {TOK}, {FORMS}, {ENDINGS_SQL} SELECT wordform AS word FROM forms WHERE EXISTS (SELECT 1 FROM ending WHERE ends_with(wordform, replace(accented_ending, '_', '')) AND length(wordform) > length(replace(accented_ending, '_', '')))")
def j26_has_ending(spark, d):
    return L.has_ending(forms(spark, d).withColumnRenamed("wordform", "word"), endings(spark))


@query(f"""WITH {TOK}, {FORMS}, {LEXICON_SQL},
t AS (SELECT DISTINCT right(wordform, 3) AS suffix FROM lexicon WHERE length(wordform) > 3 UNION SELECT DISTINCT right(wordform, 5) FROM lexicon WHERE length(wordform) > 5),
e AS (SELECT wordform AS word, {SUFFIX.format(w='wordform', n=7)} AS suffix FROM forms)
SELECT word, arg_max(suffix, length(suffix)) AS suffix FROM e JOIN t USING (suffix) GROUP BY word""")
def j12_longest_suffix(spark, d):
    lexicon = X.lexicon(spark, d)
    of = lambda n: lexicon.where(F.length("wordform") > n).select(F.expr(f"right(wordform, {n})").alias("suffix"))
    return L.longest_suffix(forms(spark, d).withColumnRenamed("wordform", "word"), of(3).unionByName(of(5)))


@query(f"WITH {TOK}, {FORMS}, {CTOK}, {LEXICON_SQL}, {CORPUS} SELECT wordform AS word FROM forms WHERE wordform IN (SELECT wordform FROM corpus) OR wordform IN (SELECT lemma FROM lexicon) OR wordform IN (SELECT lower(lemma) FROM lexicon)")
def j27_known_lemma(spark, d):
    return L.known_lemma(forms(spark, d).withColumnRenamed("wordform", "word"), corpus_lemmas(spark, d), X.lexicon(spark, d))


@query(f"""WITH {LEXICON_SQL}, folded AS (SELECT lower({ASCII.format('wordform')}) AS wordform, tag, lemma, accented FROM lexicon), q AS (SELECT wordform AS form, min(tag) AS tag, min(lemma) AS lemma FROM folded GROUP BY wordform),
r AS (SELECT form, q.tag, q.lemma, accented, levenshtein(q.lemma, l.lemma) AS ld, {{DIST}} AS td,
  ((form = upper(left(form, 1)) || lower(substr(form, 2)) AND form <> lower(form)) <> (l.lemma = upper(left(l.lemma, 1)) || lower(substr(l.lemma, 2)) AND l.lemma <> lower(l.lemma)))::INT AS cd
  FROM q JOIN folded l ON form = wordform),
m AS (SELECT *, min(cd) OVER (PARTITION BY form, tag, lemma) AS best FROM r),
o AS (SELECT form, tag, lemma, accented, min((cd, td, ld, accented)) AS k FROM m WHERE cd = best GROUP BY ALL)
SELECT o.form, o.tag, o.lemma, string_agg(accented, ' ' ORDER BY k) AS accented, any_value(n > 1) AS is_ambiguous
FROM o JOIN (SELECT form, count(DISTINCT lower(accented)) AS n FROM r GROUP BY form) USING (form) GROUP BY ALL""".replace("{DIST}", distance_sql("q.tag", "l.tag")))
def w09_candidates(spark, d):
    lexicon = X.lexicon(spark, d).withColumn("wordform", F.lower(W.to_ascii(F.col("wordform"))))  # keys of a lexicon are folded
    wanted = lexicon.groupBy(F.col("wordform").alias("form")).agg(F.min("tag").alias("tag"), F.min("lemma").alias("lemma"))
    return L.candidates(wanted, lexicon).withColumn("accented", F.array_join("accented", " "))


@query(f"WITH {LEXICON_SQL} SELECT wordform, lemma, tag, arg_max(accented, (length(accented) - length(translate(accented, 'vjJ', '')), seq)) AS accented FROM lexicon GROUP BY ALL")
def a03_best_of_tag(spark, d):
    return L.best_of_tag(X.lexicon(spark, d))


@query(rf"WITH {CTOK}, t AS (SELECT lower(text) AS word, left(lower(text), 2) || length(text) % 3 AS lemma, conv_id * 1000000 + turn * 10000 + idx AS pos FROM ctok WHERE regexp_matches(text, '{WORD}')), p AS (SELECT word AS wordform, lemma, count(*) AS freq, min(pos) AS first FROM t GROUP BY ALL) SELECT wordform, row_number() OVER (PARTITION BY wordform ORDER BY first) - 1 AS ord, lemma, freq FROM p")
def a06_corpus_lemmas(spark, d):
    words = conversation_tokens(spark, d).where(W.is_word(F.col("text")))
    pos = F.col("conv_id") * 1000000 + F.col("turn") * 10000 + F.col("idx")
    tagged = words.select(F.lower("text").alias("word"), F.concat(F.substring(F.lower("text"), 1, 2), (F.length("text") % 3).cast("string")).alias("lemma"), pos.alias("pos"))
    return L.lemma_tables(tagged)[1]


@query(rf"WITH {CTOK} SELECT left(lower(text), 2) || length(text) % 3 AS lemma, count(*) AS freq FROM ctok WHERE regexp_matches(text, '{WORD}') GROUP BY ALL")
def a06_lemma_frequency(spark, d):
    words = conversation_tokens(spark, d).where(W.is_word(F.col("text")))
    return L.lemma_tables(words.select(F.lower("text").alias("word"), F.concat(F.substring(F.lower("text"), 1, 2), (F.length("text") % 3).cast("string")).alias("lemma"), F.col("idx").alias("pos")))[0]


@query(f"WITH {TOK}, {FORMS}, {LEXICON_SQL} SELECT wordform FROM forms UNION SELECT wordform FROM lexicon")
def u01_union_forms(spark, d):
    return forms(spark, d).union(X.lexicon(spark, d).select("wordform")).distinct()


@query(f"WITH {TOK}, {FORMS}, {LEXICON_SQL} SELECT wordform FROM forms INTERSECT SELECT wordform FROM lexicon")
def u03_intersect_forms(spark, d):
    return forms(spark, d).intersect(X.lexicon(spark, d).select("wordform"))


@query(f"WITH {TOK}, {FORMS}, {LEXICON_SQL}, e AS (SELECT wordform, NULL::VARCHAR AS tag, NULL::VARCHAR AS lemma, NULL::VARCHAR AS accented FROM forms UNION ALL SELECT wordform, tag, lemma, accented FROM lexicon UNION ALL SELECT wordform, tag, lemma, accented FROM lexicon) SELECT DISTINCT * FROM e EXCEPT SELECT wordform, tag, lemma, accented FROM lexicon")
def k09_new_entries(spark, d):
    lexicon = X.lexicon(spark, d).drop("seq")
    unknown = forms(spark, d).select("wordform", *[F.lit(None).cast("string").alias(c) for c in ("tag", "lemma", "accented")])
    return K.new_entries(unknown.unionByName(lexicon).unionByName(lexicon), lexicon)


UNITS = ["of the", "of the and", "and the", "to", "in the", "de la", "que", "la vie", "a", "de"]


@query(rf"""WITH RECURSIVE {CTOK}, unit(unit) AS (VALUES {", ".join(f"('{u}')" for u in UNITS)}),
w AS (SELECT conv_id * 1000 + turn AS doc_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY idx) AS pos, text AS word FROM ctok WHERE regexp_matches(text, '{WORD}')),
g AS (SELECT doc_id, pos, n, string_agg(word, ' ' ORDER BY place) AS gram FROM (SELECT a.doc_id, a.pos, n, b.pos AS place, b.word FROM w a CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) ns JOIN w b ON b.doc_id = a.doc_id AND b.pos BETWEEN a.pos AND a.pos + n - 1) GROUP BY doc_id, pos, n HAVING count(*) = n),
m AS (SELECT doc_id, pos, max((n, unit)) AS b FROM g JOIN unit ON lower(gram) = unit WHERE list_bool_and(list_transform(list_zip(string_split(gram, ' '), string_split(unit, ' ')), lambda z: z[1] = z[2] OR z[1] = upper(left(z[2], 1)) || substr(z[2], 2) OR z[1] = upper(z[2]))) GROUP BY doc_id, pos),
e AS (SELECT doc_id, pos, b[1] AS n, b[2] AS unit FROM m),
nxt AS (SELECT a.doc_id, a.pos, min(b.pos) AS next FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.pos >= a.pos + a.n GROUP BY ALL),
picked(doc_id, pos) AS (SELECT doc_id, min(pos) FROM e GROUP BY doc_id UNION ALL SELECT p.doc_id, next FROM picked p JOIN nxt ON p.doc_id = nxt.doc_id AND p.pos = nxt.pos)
SELECT doc_id, pos, unit FROM picked JOIN e USING (doc_id, pos)""")
def j22_multiword_units(spark, d):
    from pyspark.sql.window import Window

    words = conversation_tokens(spark, d).where(W.is_word(F.col("text"))).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("idx").alias("at"), F.col("text").alias("word"))
    ordered = words.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).cast("long")).drop("at")
    return L.multiword_units(ordered, X.inline(spark, [(u,) for u in UNITS], "unit string"))


# Statistics


@query(f"""WITH {TOK}, {LEXICON_SQL}, n AS (SELECT wordform, count(DISTINCT lower(accented)) AS n FROM lexicon GROUP BY wordform)
SELECT doc_id, count(*) AS words, count(n) AS known, count(*) - count(n) AS unknown, count(*) FILTER (WHERE n > 1) AS ambiguous
FROM tok LEFT JOIN n ON lower({ASCII.format('text')}) = wordform WHERE regexp_matches(text, '{WORD}') GROUP BY doc_id""")
def a04_statistics(spark, d):
    return S.token_statistics(tokens(spark, d), X.lexicon(spark, d))


@query(f"""WITH {TOK}, {LEXICON_SQL}, n AS (SELECT DISTINCT wordform FROM lexicon)
SELECT doc_id, sum(CASE WHEN wordform IS NOT NULL THEN 95 WHEN regexp_matches(text, '(tion|ing|en)$') THEN 85 ELSE 60 END)::DOUBLE / count(*) / 100 AS coverage
FROM tok LEFT JOIN n ON lower({ASCII.format('text')}) = wordform GROUP BY doc_id""")
def a05_coverage(spark, d):
    return S.coverage(tokens(spark, d), X.lexicon(spark, d), F.col("text").rlike("(tion|ing|en)$"))


LONGMARKS = "replace(replace(replace(replace(replace(replace({}, 'a_', 'ā'), 'e_', 'ē'), 'i_', 'ī'), 'o_', 'ō'), 'u_', 'ū'), 'y_', 'ȳ')"


@query(f"""WITH {LEXICON_SQL}, w AS (SELECT left(tag, 1) AS tag, {LONGMARKS.format('accented')} AS a FROM lexicon),
e AS (SELECT tag, unnest(list_transform(range(1, least(length(a) - 3, 12)), lambda k: right(a, k))) AS ending FROM w),
c AS (SELECT tag, ending, count(*) AS n FROM e GROUP BY ALL)
SELECT c.tag, c.ending, c.n FROM c LEFT JOIN c p ON c.tag = p.tag AND p.ending = translate(left(c.ending, 1), 'āēīōūȳ', 'aeiouy') || substr(c.ending, 2)
WHERE regexp_matches(c.ending, '^[āēīōūȳ]') AND c.n > coalesce(p.n, 1)""")
def a09_ending_counts(spark, d):
    words = X.lexicon(spark, d).select(F.substring("tag", 1, 1).alias("tag"), W.marks_to_unicode(F.col("accented")).alias("accented"))
    return S.ending_counts(words)


def tagged_words(spark, d):
    """Words of the conversations with tags by their ending: key (a turn), pos, word and tag."""
    words = conversation_tokens(spark, d).where(W.is_word(F.col("text")))
    tag = F.concat(F.substring(F.reverse(F.lower("text")), 1, 1), (F.length("text") % 2).cast("string"))
    return words.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.col("idx").alias("pos"), F.lower("text").alias("word"), tag.alias("tag"))


TAGGED = rf"{CTOK}, tagged AS MATERIALIZED (SELECT conv_id * 1000 + turn AS key, idx AS pos, lower(text) AS word, right(lower(text), 1) || length(text) % 2 AS tag FROM ctok WHERE regexp_matches(text, '{WORD}'))"
PRIORS = "priors AS MATERIALIZED (SELECT tag, n, n / sum(n) OVER () AS prob FROM (SELECT tag, count(*) + 1 AS n FROM tagged GROUP BY tag UNION ALL SELECT 'BOUNDARY', count(DISTINCT key) + 1 FROM tagged))"
COUNTS = """counts AS MATERIALIZED (SELECT word, tag, sum(n)::BIGINT AS n FROM (SELECT word, tag, 1 AS n FROM tagged UNION ALL SELECT DISTINCT word, left(tag, 1) || '9', 0 FROM tagged WHERE length(word) > 6) GROUP BY ALL)"""
PROBS = """probs AS MATERIALIZED (SELECT word, tag, n, CASE WHEN total = 0 THEN CASE WHEN mass > 0 THEN prior / mass ELSE 1 / listed END
  WHEN seen < listed THEN (n + seen * CASE WHEN mass > 0 THEN prior / mass ELSE 1 / listed END) / (total + seen) ELSE n / total END AS prob
  FROM (SELECT word, c.tag, c.n, coalesce(p.prob, 0) AS prior, sum(c.n) OVER w AS total, count(*) FILTER (WHERE c.n > 0) OVER w AS seen, count(*) OVER w AS listed, sum(coalesce(p.prob, 0)) OVER w AS mass
    FROM counts c LEFT JOIN priors p ON c.tag = p.tag WINDOW w AS (PARTITION BY word)))"""
SUMS = f"sums AS MATERIALIZED (SELECT suffix, tag, sum(prob) AS freq FROM (SELECT tag, prob, unnest(list_concat([''], list_transform(range(1, greatest(least(length(word) - 1, 7), 0) + 1), lambda k: right(word, k)))) AS suffix FROM probs) GROUP BY ALL)"


def priors(spark, d):
    tagged = tagged_words(spark, d)
    return S.tag_priors(tagged, tagged.select("key").distinct().count())


def word_counts(spark, d):
    tagged = tagged_words(spark, d)
    listed = tagged.where(F.length("word") > 6).select("word", F.concat(F.substring("tag", 1, 1), F.lit("9")).alias("tag")).distinct()
    return S.word_tags(tagged, listed)


def probabilities(spark, d):
    return S.tag_probabilities(word_counts(spark, d), priors(spark, d))


@query(f"WITH {TAGGED}, {PRIORS} SELECT tag, n, round(prob, 9) AS prob FROM priors")
def a07_tag_priors(spark, d):
    return priors(spark, d).withColumn("prob", F.round("prob", 9))


@query(f"WITH {TAGGED}, {COUNTS} SELECT * FROM counts")
def a08_word_tags(spark, d):
    return word_counts(spark, d)


@query(f"WITH {TAGGED}, {PRIORS}, {COUNTS}, {PROBS} SELECT word, tag, n, round(prob, 9) AS prob FROM probs")
def a10_tag_probabilities(spark, d):
    return probabilities(spark, d).withColumn("prob", F.round("prob", 9))


CLASSES = """sets AS (SELECT word, string_agg(DISTINCT tag, ' ' ORDER BY tag) AS tagset FROM probs GROUP BY word),
classes AS (SELECT tagset, tag, sum(prob) / sum(sum(prob)) OVER (PARTITION BY tagset) AS prob FROM probs JOIN sets USING (word) GROUP BY tagset, tag)"""


@query(f"WITH {TAGGED}, {PRIORS}, {COUNTS}, {PROBS}, {CLASSES} SELECT tagset, tag, round(prob, 9) AS prob FROM classes")
def a11_class_distribution(spark, d):
    return S.class_distribution(probabilities(spark, d)).withColumn("prob", F.round("prob", 9))


@query(f"WITH {TAGGED}, {PRIORS}, {COUNTS}, {PROBS}, {CLASSES} SELECT word, p.tag, round((p.prob * total + c.prob) / (total + 1), 9) AS prob FROM (SELECT *, sum(n) OVER (PARTITION BY word) AS total FROM probs) p JOIN sets USING (word) JOIN classes c ON c.tagset = sets.tagset AND c.tag = p.tag")
def a11_smooth_by_class(spark, d):
    probs = probabilities(spark, d)
    return S.smooth_by_class(probs, S.class_distribution(probs)).withColumn("prob", F.round("prob", 9))


@query(f"WITH {TAGGED}, {PRIORS}, {COUNTS}, {PROBS}, {SUMS} SELECT suffix, tag, round(freq, 6) AS freq FROM sums")
def a12_suffix_sums(spark, d):
    return S.suffix_tag_sums(probabilities(spark, d)).withColumn("freq", F.round("freq", 6))


@query(f"""WITH {TAGGED}, {PRIORS}, {COUNTS}, {PROBS}, {SUMS}, n AS (SELECT *, sum(freq) OVER (PARTITION BY suffix) AS total FROM sums WHERE freq > 0)
SELECT a.suffix, round(sum(a.freq * ln((a.freq / a.total) / (b.freq / b.total))), 4) AS gain, round(max(a.total), 4) AS freq FROM n a JOIN n b ON b.suffix = substr(a.suffix, 2) AND a.tag = b.tag WHERE a.suffix <> '' GROUP BY a.suffix""")
def a13_suffix_gains(spark, d):
    return S.suffix_gains(S.suffix_tag_sums(probabilities(spark, d))).select("suffix", F.round("gain", 4).alias("gain"), F.round("freq", 4).alias("freq"))


def _levels() -> str:
    parts = ["rows AS MATERIALIZED (SELECT *, sum(freq) OVER (PARTITION BY suffix) AS total, count(*) OVER (PARTITION BY suffix) AS kinds FROM sums)", "l0 AS MATERIALIZED (SELECT suffix, tag, freq / total AS prob FROM rows WHERE suffix = '')"]
    for n in range(1, 8):
        parts.append(f"l{n} AS MATERIALIZED (SELECT r.suffix, r.tag, (r.freq + r.kinds * u.prob) / (r.total + r.kinds) AS prob FROM rows r JOIN l{n - 1} u ON u.suffix = substr(r.suffix, 2) AND r.tag = u.tag WHERE length(r.suffix) = {n})")
    return ", ".join(parts)


@query(f"WITH {TAGGED}, {PRIORS}, {COUNTS}, {PROBS}, {SUMS}, {_levels()} SELECT suffix, tag, round(prob, 9) AS prob FROM (" + " UNION ALL ".join(f"SELECT * FROM l{n}" for n in range(8)) + ")")
def a14_suffix_probabilities(spark, d):
    return S.suffix_probabilities(S.suffix_tag_sums(probabilities(spark, d))).withColumn("prob", F.round("prob", 9))


GRAMS = "grams AS MATERIALIZED (SELECT t1, t2, tag, count(*) AS n FROM (SELECT coalesce(lag(tag, 1) OVER w, 'BOUNDARY') AS t1, coalesce(lag(tag, 2) OVER w, 'BOUNDARY') AS t2, tag FROM tagged WINDOW w AS (PARTITION BY key ORDER BY pos)) GROUP BY ALL)"


@query(f"WITH {TAGGED}, {GRAMS} SELECT * FROM grams")
def w11_context_grams(spark, d):
    return S.context_grams(tagged_words(spark, d))


CONTINGENCY = "ct AS (SELECT t1 AS feature, sum(CASE WHEN tag = 'e1' THEN n ELSE 0 END)::BIGINT AS yes, sum(CASE WHEN tag = 'e1' THEN 0 ELSE n END)::BIGINT AS no FROM grams GROUP BY t1)"


@query(f"WITH {TAGGED}, {GRAMS}, {CONTINGENCY} SELECT * FROM ct")
def a15_contingency(spark, d):
    return S.contingency(S.context_grams(tagged_words(spark, d)), "t1", "e1")


def _entropy(a: str, b: str) -> str:
    return " + ".join(f"(CASE WHEN {x} > 0 THEN -({x}) * ln(({x}) / ({a} + {b})) ELSE 0 END)" for x in (a, b))


@query(f"WITH {TAGGED}, {GRAMS}, {CONTINGENCY}, s AS (SELECT *, sum(yes) OVER () AS y, sum(no) OVER () AS n FROM ct) SELECT feature, yes, no, round(({_entropy('y', 'n')}) - ({_entropy('yes', 'no')}) - ({_entropy('(y - yes)', '(n - no)')}), 3) AS gain FROM s")
def a24_information_gain(spark, d):
    return S.information_gain(S.contingency(S.context_grams(tagged_words(spark, d)), "t1", "e1")).withColumn("gain", F.round("gain", 3))


@query(f"""WITH {TOK}, {FORMS}, {LEXICON_SQL}, a AS (SELECT wordform AS word, count(*) AS a, count(DISTINCT lemma) AS l FROM lexicon GROUP BY wordform)
SELECT count(*) AS words, count(a) AS hits, round(sum(a) / count(a), 6) AS analyses_per_hit, round(sum(l) / count(a), 6) AS lemmas_per_hit, arg_max(wordform, (length(wordform), wordform)) AS longest FROM forms LEFT JOIN a ON wordform = word""")
def a17_run_counters(spark, d):
    words = forms(spark, d).withColumnRenamed("wordform", "word")
    out = S.run_counters(words, X.lexicon(spark, d).select(F.col("wordform").alias("word"), "lemma"))
    return out.withColumns({c: F.round(c, 6) for c in ("analyses_per_hit", "lemmas_per_hit")})


PAIRS = "pairs AS (SELECT item_id, translate(text, 'aeo', 'āēō') AS gold, translate(text, 'ae', 'āe') || repeat('a', (length(text) % 3)::INT) AS out FROM benchmark), ch AS (SELECT item_id, unnest(range(1, least(length(gold), length(out)) + 1)) AS pos, gold, out FROM pairs), c AS (SELECT item_id, pos, gold[pos] AS g, out[pos] AS o FROM ch)"


def pairs(spark, d):
    text = F.col("text")
    longer = F.concat(F.translate(text, "ae", "āe"), F.repeat(F.lit("a"), F.length(text) % 3))
    return table(spark, d, "benchmark").select("item_id", F.translate(text, "aeo", "āēō").alias("gold"), longer.alias("out"))


@query(f"WITH {PAIRS} SELECT item_id, pos, g, o FROM c")
def j09_character_pairs(spark, d):
    return S.character_pairs(pairs(spark, d))


@query(f"WITH {PAIRS}, v AS (SELECT *, regexp_matches(translate(g, '{W.LONG}', '{W.PLAIN}'), '(?i)[aeiouy]') AS vowel FROM c) SELECT item_id, count(*) AS chars, count(*) FILTER (WHERE g = o) AS same, count(*) FILTER (WHERE vowel) AS vowels, count(*) FILTER (WHERE vowel AND g = o) AS correct FROM v GROUP BY item_id")
def a19_vowel_accuracy(spark, d):
    return S.vowel_accuracy(pairs(spark, d))


@query(f"WITH {PAIRS} SELECT g, o, count(*) AS n FROM c WHERE g <> o GROUP BY ALL")
def a21_mismatches(spark, d):
    return S.mismatches(pairs(spark, d))


@query(f"WITH {PAIRS} SELECT g, o, count(*) AS n FROM c WHERE g <> o GROUP BY ALL ORDER BY n DESC, g, o LIMIT 20")
def t10_top_mismatches(spark, d):
    return S.mismatches(pairs(spark, d)).orderBy(F.desc("n"), "g", "o").limit(20)


@query(f"WITH {PAIRS} SELECT item_id, string_agg(CASE WHEN g = o THEN {{E}} ELSE '<span class=\"wrong\">' || {{E}} || '</span>' END, '' ORDER BY pos) AS html FROM c GROUP BY item_id".replace("{E}", "replace(replace(replace(replace(replace(o, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"))
def k21_mismatch_html(spark, d):
    return S.mismatch_html(pairs(spark, d))


# Sources and sinks over the tables


@query(r"SELECT page_id, substr(replace(html, chr(13), ''), 1, 50000) AS text FROM pages")
def s03_form_text(spark, d):
    return table(spark, d, "pages").select("page_id", R.form_text(F.col("html")).alias("text"))


LINES = "lines AS (SELECT item_id AS seq, left(md5(text), 6) || chr(9) || 'n-s---fn-  ' || left(md5(text), 4) || CASE WHEN item_id % 3 = 0 THEN '' ELSE ' ' || left(md5(text), 5) || ' more' END AS line FROM benchmark UNION ALL SELECT item_id + 100000, '# ' || item_id FROM benchmark)"


@query(f"WITH {LINES}, p AS (SELECT seq, regexp_split_to_array(line, '[ \\t]+') AS p FROM lines WHERE left(line, 1) <> '#') SELECT seq, p[1] AS wordform, p[2] AS tag, p[3] AS lemma, p[4] AS accented FROM p WHERE len(p) >= 4")
def s05_lexicon_rows(spark, d):
    m = F.md5(F.col("text").cast("binary"))
    tail = F.when(F.col("item_id") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.substring(m, 1, 5), F.lit(" more")))
    bench = table(spark, d, "benchmark")
    lines = bench.select(F.col("item_id").alias("seq"), F.concat(F.substring(m, 1, 6), F.lit("\tn-s---fn-  "), F.substring(m, 1, 4), tail).alias("line"))
    return R.lexicon_rows(lines.unionByName(bench.select((F.col("item_id") + 100000).alias("seq"), F.concat(F.lit("# "), F.col("item_id").cast("string")).alias("line"))))


@query(f"WITH {TOK}, {LEXICON_SQL}, n AS (SELECT wordform, count(DISTINCT lower(accented)) AS n FROM lexicon GROUP BY wordform) SELECT doc_id, string_agg(CASE WHEN regexp_matches(text, '{WORD}') THEN '<span class=\"' || CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambig' ELSE 'auto' END || '\">' || text || '</span>' ELSE replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') END, '' ORDER BY idx) AS html FROM tok LEFT JOIN n ON lower(text) = wordform GROUP BY doc_id")
def k03_marked_html(spark, d):
    n = X.lexicon(spark, d).groupBy(F.col("wordform").alias("form")).agg(F.countDistinct(F.lower("accented")).alias("n"))
    joined = T.left_join_words(tokens(spark, d), n, W.is_word(F.col("text")), F.lower("text"), "form")
    shown = joined.withColumn("html", K.marked_html(F.col("text"), F.col("n").isNull(), F.col("n") > 1))
    return T.detokenise(shown, "html").withColumnRenamed("text", "html")


@query(f"WITH {TAGGED} SELECT key, string_agg(word || chr(9) || tag || chr(9) || left(word, 3), chr(10) ORDER BY pos) AS lines FROM tagged GROUP BY key")
def k10_tagged_lines(spark, d):
    rows = K.tagged_lines(tagged_words(spark, d).withColumn("lemma", F.substring("word", 1, 3)), ("key", "pos"))
    line = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return rows.groupBy("key").agg(F.array_join(F.transform(line, lambda s: s["value"]), "\n").alias("lines"))


@query(f"WITH {TOK}, {FORMS}, {LEXICON_SQL} SELECT wordform AS word FROM forms WHERE wordform NOT IN (SELECT wordform FROM lexicon)")
def k19_dead_letters(spark, d):
    return K.dead_letters(forms(spark, d).withColumnRenamed("wordform", "word"), X.lexicon(spark, d).withColumnRenamed("wordform", "word"))


# Sequences


@query(f"WITH {LEXICON_SQL} SELECT seq, accented AS aligned FROM lexicon")
def q01_align(spark, d):
    """Words written with u and i for v and j take both and their marks from the lexicon's forms."""
    plain = F.translate("wordform", "vj", "ui")
    return X.lexicon(spark, d).select("seq", Q.align_column(plain, F.col("accented"), utov=True, itoj=True).alias("aligned"))


@query(rf"""WITH {LEXICON_SQL}, m AS (SELECT seq, string_split(regexp_replace(accented, '([ae])_', '\1_^', 'g'), '_^') AS p FROM lexicon),
v AS (SELECT seq, p, unnest(range(0, (1 << (len(p) - 1)::INT))) AS nth FROM m)
SELECT seq, nth::BIGINT AS nth, array_to_string(list_transform(p, lambda x, i: x || CASE WHEN i < len(p) AND ((nth >> (i - 1)::INT) & 1) = 1 THEN '_' ELSE '' END), '') AS form FROM v""")
def j18_variants(spark, d):
    """The forms of the whole lexicon, its long a and e taken as uncertain."""
    uncertain = F.regexp_replace("accented", "([ae])_", "$1_^")
    return X.lexicon(spark, d).select("seq", F.posexplode(Q.variants_column(uncertain)).alias("nth", "form")).withColumn("nth", F.col("nth").cast("long"))


@query()
def q07_scan_verses(spark, d):
    lines = T.verse_ids(conversation_tokens(spark, d), ("conv_id", "turn")).where(W.is_word(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("idx", F.array(W.all_vowels_ambiguous(F.lower(W.to_ascii(F.col("text"))))).alias("forms"))))
    rows = lines.groupBy((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "verse_id").agg(ordered.alias("o"))
    verses = rows.select("doc_id", "verse_id", F.transform("o", lambda s: s["forms"]).alias("words"))
    return Q.scan_verses(verses, Q.METER_CYCLES["elegiac"])


@query()
def q09_viterbi(spark, d):
    return viterbi(spark, d)


def viterbi(spark, d):
    """Trains a tagger on all turns and tags all of them. Only priors and trees, as large as the tag set, are collected."""
    tagged = tagged_words(spark, d)
    return G.tag_tokens(tagged.select("key", "pos", "word"), G.fit(tagged))


_DASHES = "'---------'"
#: The whole flow in SQL. The tables have no ligatures, so a word and its form without marks are equally long, and marks
#: go where they stand in the lexicon's form.
RESTORE_SQL = f"""WITH {CLITIC.replace('FROM documents)', f"FROM (SELECT doc_id, translate(text, '{W.LONG}', '{W.PLAIN}') AS text FROM documents))")}, {ENDINGS_SQL},
seen AS (SELECT doc_id, idx, text, regexp_matches(text, '{WORD}') AS word, NOT regexp_matches(text, '{WORD}') AND regexp_matches(text, '[.;:?!]') AS ender FROM tok),
last AS (SELECT *, last_value(CASE WHEN word THEN idx END IGNORE NULLS) OVER p AS w, last_value(CASE WHEN word THEN length(text) END IGNORE NULLS) OVER p AS n, last_value(CASE WHEN ender THEN idx END IGNORE NULLS) OVER p AS e
  FROM seen WINDOW p AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT doc_id, idx, word, coalesce(sum((ender AND coalesce(n > 1 AND (e IS NULL OR e < w), false))::INT) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM last),
first AS (SELECT doc_id, min(idx) AS idx, true AS begins FROM numbered WHERE word GROUP BY doc_id, sentence),
part AS (SELECT s.doc_id, s.idx, sub_idx, x[1] AS text, regexp_matches(x[1], '{WORD}') AS word, coalesce(begins AND sub_idx = 0, false) AS starts FROM split s LEFT JOIN first f ON s.doc_id = f.doc_id AND s.idx = f.idx),
form AS (SELECT DISTINCT text AS form, starts, lower({ASCII.format('text')}) AS key FROM part WHERE word),
lemmas AS (SELECT wordform, arg_min(lemma, seq) AS lemma FROM lexicon GROUP BY wordform),
entry AS (SELECT form, starts, accented, lower(accented) AS low, (form = upper(left(form, 1)) || lower(substr(form, 2)) AND form <> lower(form)) <> (l.lemma = upper(left(l.lemma, 1)) || lower(substr(l.lemma, 2)) AND l.lemma <> lower(l.lemma)) AND NOT (starts AND form = upper(left(form, 1)) || lower(substr(form, 2)) AND form <> lower(form)) AS cd,
  {distance_sql(_DASHES, 'l.tag')} AS td, levenshtein(coalesce(m.lemma, '-'), l.lemma) AS ld FROM form JOIN lexicon l ON key = l.wordform LEFT JOIN lemmas m ON key = m.wordform WHERE accented <> ''),
ranked AS (SELECT form, starts, arg_min(accented, (cd::INT, td, ld, accented)) AS accented, count(DISTINCT low) > 1 AS ambiguous FROM entry GROUP BY form, starts),
guess AS (SELECT form, arg_min(e, priority) AS e FROM (SELECT form, priority, accented_ending AS e FROM form JOIN ending ON tag = {_DASHES} AND ends_with(lower(form), replace(accented_ending, '_', '')) AND length(form) > length(replace(accented_ending, '_', ''))) GROUP BY form),
target AS (SELECT f.form, f.starts, r.form IS NULL AS unknown, coalesce(ambiguous, false) AS ambiguous,
  replace(replace(coalesce(r.accented, left(lower(f.form), length(f.form) - length(replace(g.e, '_', ''))) || g.e, ''), '_^', ''), '^', '') AS t FROM form f LEFT JOIN ranked r ON f.form = r.form AND f.starts = r.starts LEFT JOIN guess g ON f.form = g.form),
marked AS (SELECT *, CASE WHEN contains(t, '_') THEN array_to_string(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN t[i] = '_' THEN '_' ELSE form[i - length(left(t, i)) + length(replace(left(t, i), '_', ''))] END), '') ELSE form END AS m FROM target),
shown AS (SELECT *, {_unicode_marks('m')} AS u FROM marked)
SELECT doc_id, string_agg(coalesce(u, text), '' ORDER BY idx, sub_idx) AS text, count(*) FILTER (WHERE word) AS words, count(*) FILTER (WHERE word AND unknown) AS unknown, count(*) FILTER (WHERE word AND ambiguous) AS ambiguous
FROM part LEFT JOIN shown ON word AND text = form AND part.starts = shown.starts GROUP BY doc_id"""


@query(RESTORE_SQL)
def restore_marks_query(spark, d):
    return restore(spark, d)


def restore(spark, d):
    return restore_marks(docs(spark, d), X.lexicon(spark, d), endings(spark))


for _table in (_QUERIES, _SQL):
    _table["restore_marks"] = _table.pop("restore_marks_query")


# Morphology


STEMS_SQL = f"{LEXICON_SQL}, stems AS (SELECT DISTINCT left(wordform, length(wordform) - 2) AS stem, ['o1', 'o2', 'en'][1 + length(wordform) % 3] AS stemtype, left(wordform, 3) AS lemma, 'noun' AS kind FROM lexicon WHERE length(wordform) > 3), {X.values_sql('ends', 'ending, stemtype, tag', X.ENDINGS)}"


def stems(spark, d):
    words = X.lexicon(spark, d).where(F.length("wordform") > 3)
    kind = F.get(F.array(F.lit("o1"), F.lit("o2"), F.lit("en")), F.length("wordform") % 3)
    return words.select(F.substr(F.col("wordform"), F.lit(1), F.length("wordform") - 2).alias("stem"), kind.alias("stemtype"), F.substring("wordform", 1, 3).alias("lemma"), F.lit("noun").alias("kind")).distinct()


def paradigm_endings(spark):
    return X.inline(spark, X.ENDINGS, "ending string, stemtype string, tag string")


@query(f"WITH {TOK}, {FORMS}, {STEMS_SQL} SELECT wordform AS word, lemma, tag, kind, stem, ending FROM (SELECT wordform, unnest(range(1, length(wordform) + 1)) AS k FROM forms) f JOIN stems ON stem = left(wordform, k) JOIN ends ON ending = substr(wordform, k + 1) AND ends.stemtype = stems.stemtype")
def j13_stem_endings(spark, d):
    return M.stem_endings(forms(spark, d).withColumnRenamed("wordform", "word"), stems(spark, d), paradigm_endings(spark))


@query(f"WITH {STEMS_SQL} SELECT DISTINCT stem || ending AS form, lemma, tag, kind, stem, ending FROM stems JOIN ends USING (stemtype)")
def g07_paradigm(spark, d):
    return M.paradigm(stems(spark, d), paradigm_endings(spark))


PRE = X.values_sql("pre", "prefix", [(p,) for p in X.PREFIXES])


@query(f"""WITH RECURSIVE {TOK}, {FORMS}, {PRE}, w(word, taken, rest, depth) AS (SELECT wordform, '', wordform, 0 FROM forms
UNION ALL SELECT word, CASE WHEN taken = '' THEN prefix ELSE taken || '-' || prefix END, substr(rest, length(prefix) + 1), depth + 1 FROM w JOIN pre ON starts_with(rest, prefix) AND length(prefix) <= length(rest) - 2)
SELECT word, taken, rest FROM w WHERE depth > 0""")
def j14_preverbs(spark, d):
    return M.preverbs(forms(spark, d).withColumnRenamed("wordform", "word"), X.inline(spark, [(p,) for p in X.PREFIXES], "prefix string"))


def _retries_sql(w: str) -> str:
    """The spellings of morphology.retries, in order, nulls for those that do not apply."""
    clitics = [f"CASE WHEN ends_with({w}, '{c}') AND length({w}) > {len(c) + 1} THEN left({w}, length({w}) - {len(c)}) END" for c in M.CLITICS]
    joined = [f"CASE WHEN ends_with({w}, '{e}') THEN left({w}, length({w}) - {len(e)}) || '{r}' END" for e, r in M.PRODELISION.items()]
    others = [
        f"CASE WHEN ends_with({w}, 'n') THEN left({w}, length({w}) - 1) END",
        f"CASE WHEN regexp_matches({w}, '^i[aeou]') THEN 'j' || substr({w}, 2) END",
        f"CASE WHEN regexp_matches({w}, '^I[aeou]') THEN 'J' || substr({w}, 2) END",
        f"CASE WHEN regexp_matches({w}, '^ex[cpt]') THEN 'exs' || substr({w}, 3) END",
        f"lower({w})",
        f"upper(left({w}, 1)) || lower(substr({w}, 2))",
    ]
    return "[" + ", ".join([w, *clitics, *joined, *others]) + "]"


@query(f"""WITH {TOK}, {FORMS}, {LEXICON_SQL}, r AS (SELECT wordform AS word, {_retries_sql('wordform')} AS r FROM forms),
e AS (SELECT word, unnest(r) AS form, generate_subscripts(r, 1) AS nth FROM r)
SELECT word, arg_min(form, nth) AS form FROM e WHERE form IN (SELECT wordform FROM lexicon) GROUP BY word""")
def p27_first_with_hits(spark, d):
    return M.first_with_hits(forms(spark, d).withColumnRenamed("wordform", "word"), X.lexicon(spark, d).select(F.col("wordform").alias("form")))


PARSES_SQL = f"""{X.values_sql('parses', 'word, line', X.PARSES)}, fields AS (SELECT word, regexp_split_to_array(line, '[\x20\x09]+') AS f FROM parses),
alt(word, f, k, line) AS (SELECT word, f, 0, '' FROM fields UNION ALL SELECT word, f, k + 1, line || CASE WHEN line = '' THEN '' ELSE ' ' END || x FROM (SELECT *, unnest(string_split(f[k + 1], '/')) AS x FROM alt WHERE k < len(f))),
expanded AS (SELECT word, line FROM alt WHERE k = len(f))"""


@query(f"WITH RECURSIVE {PARSES_SQL} SELECT word, line FROM expanded")
def j19_expand_alternatives(spark, d):
    return M.expand_alternatives(X.inline(spark, X.PARSES, "word string, line string"))


def _codes_sql(feature: str) -> str:
    names = ", ".join(f"'{c}'" for c, (kind, _) in M.CODES.items() if kind == feature)
    return f"list_filter(codes, lambda x: x IN ({names}))[{-1 if feature == 'pos' else 1}] AS \"{feature}\""


def _letters_sql(feature: str) -> str:
    value = "CASE WHEN mood = 'gerundive' AND voice IS NULL THEN 'pass' ELSE voice END" if feature == "voice" else f'"{feature}"'
    return f"CASE {value} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in M.LETTERS[feature].items()) + " ELSE '-' END"


@query(f"""WITH RECURSIVE {PARSES_SQL},
parts AS (SELECT word, string_split(line, ' ') AS f FROM expanded),
named AS (SELECT word, split_part(f[2], ',', 1) AS accented, CASE WHEN split_part(f[2], ',', 2) = '' THEN split_part(f[2], ',', 1) ELSE split_part(f[2], ',', 2) END AS lemma, list_concat(f[1:1], f[3:]) AS codes FROM parts),
features AS (SELECT word, accented, lemma, {", ".join(_codes_sql(f) for f in M.FEATURES)} FROM named),
every AS (SELECT * FROM features UNION ALL SELECT * REPLACE ('gerund' AS mood) FROM features WHERE mood = 'gerundive' AND number = 'sg' AND gender = 'neut' AND "case" <> 'nom'),
genders AS (SELECT DISTINCT * REPLACE (unnest(CASE WHEN "case" IS NOT NULL AND gender IS NULL THEN ['masc', 'fem', 'neut'] ELSE [gender] END) AS gender) FROM every)
SELECT *, {" || ".join(_letters_sql(f) for f in M.FEATURES)} AS tag FROM genders""")
def f45_parse_lines(spark, d):
    return M.parse_lines(X.inline(spark, X.PARSES, "word string, line string")).withColumn("tag", M.parse_to_tag())


@query(f"""WITH {LEXICON_SQL}, s AS (SELECT left(wordform, 1) AS word, left(tag, 2) || '----' || '%' || '--' AS rest, list(DISTINCT translate(substr(tag, 7, 1), 'nvadtspmf', 'mfnmfnmfn')) AS g FROM lexicon GROUP BY ALL),
l AS (SELECT word, rest, unnest(list_filter([CASE WHEN list_has_all(g, ['m', 'n']) THEN 'o' END, CASE WHEN list_has_all(g, ['m', 'f']) THEN 'p' END, CASE WHEN list_has_all(g, ['m', 'f', 'n']) THEN 'q' END, CASE WHEN list_has_all(g, ['f', 'n']) THEN 'r' END], lambda x: x IS NOT NULL)) AS letter FROM s)
SELECT word, replace(rest, '%', letter) AS tag FROM l""")
def a23_gender_syncretism(spark, d):
    gender = F.translate(F.substring("tag", 7, 1), "nvadtspmf", "mfnmfnmfn")
    tags = X.lexicon(spark, d).select(F.substring("wordform", 1, 1).alias("word"), F.concat(F.substring("tag", 1, 2), F.lit("----"), gender, F.lit("--")).alias("tag"))
    return M.gender_syncretism(tags)


@query(f"WITH words AS (SELECT DISTINCT lower(text) AS text FROM (SELECT unnest(regexp_extract_all(text, '({W.TOKEN})', 1)) AS text FROM benchmark) WHERE regexp_matches(text, '{WORD}')) SELECT text, {{P}} FROM words".replace("{P}", ", ".join(
    f"CASE substr({SQL_T}, {i + 1}, 1) " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in reversed(list(M.LETTERS[f].items())) if not (f == 'pos' and k == 'adverbial')) + (" WHEN 't' THEN 'verb'" if f == "pos" else "") + f" END AS {f}" if f != "mood" else f"CASE WHEN left({SQL_T}, 1) = 't' THEN 'part' ELSE CASE substr({SQL_T}, 5, 1) " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in M.LETTERS[f].items()) + " END END AS mood"
    for i, f in enumerate(M.FEATURES)
)).replace("AS case", 'AS "case"'))
def f21_tag_to_parse(spark, d):
    words = T.tokenise(table(spark, d, "benchmark"), key=("item_id",)).where(W.is_word(F.col("text"))).select(F.lower("text").alias("text")).distinct()
    return words.select("text", *M.tag_to_parse(pseudo_tag(F.col("text"))))


@query(f"""WITH {LEXICON_SQL}, p AS (SELECT wordform AS word, {SQL_T.replace('md5(text)', 'md5(wordform)')} AS t FROM (SELECT DISTINCT wordform FROM lexicon)),
l AS (SELECT word, CASE left(t, 1) WHEN 'n' THEN 'Nb' WHEN 'a' THEN 'A-' WHEN 'd' THEN 'Df' WHEN 'v' THEN 'V-' WHEN 't' THEN 'V-' WHEN 'p' THEN 'Pp' WHEN 'm' THEN 'Ma' ELSE 'F-' END || CASE WHEN substr(t, 2, 1) IN ('1', '2', '3') THEN substr(t, 2, 1) ELSE '-' END
  || CASE WHEN substr(t, 3, 1) IN ('s', 'p') THEN substr(t, 3, 1) ELSE '-' END || CASE WHEN substr(t, 4, 1) IN ('p', 'i', 'r', 'l', 't', 'f') THEN substr(t, 4, 1) ELSE '-' END
  || CASE WHEN left(t, 1) = 't' THEN 'p' WHEN substr(t, 5, 1) IN ('i', 's', 'n', 'm', 'g', 'u', 'd', 'p') THEN substr(t, 5, 1) ELSE '-' END
  || CASE WHEN substr(t, 6, 1) IN ('a', 'p') THEN substr(t, 6, 1) WHEN (left(t, 1) = 't' OR substr(t, 5, 1) = 'p') AND substr(t, 4, 1) = 'p' THEN 'a' WHEN (left(t, 1) = 't' OR substr(t, 5, 1) = 'p') AND substr(t, 4, 1) = 'r' THEN 'p' ELSE '-' END
  || CASE WHEN substr(t, 7, 1) IN ('m', 'f', 'n') THEN substr(t, 7, 1) ELSE '-' END || CASE WHEN substr(t, 8, 1) IN ('n', 'g', 'd', 'a', 'b', 'v', 'l') THEN substr(t, 8, 1) ELSE '-' END
  || CASE WHEN substr(t, 9, 1) IN ('c', 's') THEN substr(t, 9, 1) WHEN left(t, 1) = 'a' THEN 'p' ELSE '-' END || '-' AS tag FROM p)
SELECT word, tag || CASE WHEN substr(tag, 3) = '---------' THEN 'n' ELSE 'i' END AS tag FROM l""")
def f24_long_tags(spark, d):
    words = X.lexicon(spark, d).select(F.col("wordform").alias("word")).distinct()
    return words.select("word", *M.tag_to_parse(pseudo_tag(F.col("word")))).select("word", M.parse_to_long_tag().alias("tag"))


@query(f"""WITH {TOK}, {LEXICON_SQL}, t AS (SELECT DISTINCT wordform, left(tag, 1) || '.' || substr(tag, 2, 1) AS tag, min(lemma) OVER (PARTITION BY wordform, left(tag, 1), substr(tag, 2, 1)) AS lemma FROM lexicon),
f AS (SELECT DISTINCT text AS word, 'n.' || CASE WHEN length(text) % 2 = 0 THEN 'v' ELSE 'a' END AS tag FROM tok WHERE regexp_matches(text, '{WORD}'))
SELECT f.word, f.tag, coalesce(t.lemma, f.word) AS lemma FROM f LEFT JOIN t ON f.word = t.wordform AND f.tag = t.tag""")
def j20_lookup_lemma(spark, d):
    table, words = lemma_table(spark, d)
    return L.lookup_lemma(words, table)


def lemma_table(spark, d):
    """word, tag and lemma of the lexicon under shorter tags; the documents' words with tags by their length."""
    short = F.concat(F.substring("tag", 1, 1), F.lit("."), F.substring("tag", 2, 1)).alias("tag")
    table = X.lexicon(spark, d).groupBy(F.col("wordform").alias("word"), short).agg(F.min("lemma").alias("lemma"))
    tag = F.concat(F.lit("n."), F.when(F.length("text") % 2 == 0, "v").otherwise("a")).alias("tag")
    return table, tokens(spark, d).where(W.is_word(F.col("text"))).select(F.col("text").alias("word"), tag).distinct()


@query(f"""WITH {TOK}, {LEXICON_SQL}, t AS (SELECT DISTINCT wordform, left(tag, 1) || '.' || substr(tag, 2, 1) AS tag, min(lemma) OVER (PARTITION BY wordform, left(tag, 1), substr(tag, 2, 1)) AS lemma FROM lexicon),
f AS (SELECT DISTINCT text AS word, 'n.' || CASE WHEN length(text) % 2 = 0 THEN 'v' ELSE 'a' END AS tag FROM tok WHERE regexp_matches(text, '{WORD}')),
c AS (SELECT word, tag, 0 AS i, 0 AS k, word AS w FROM f UNION ALL SELECT word, tag, 0, 1, lower(word) FROM f
  UNION ALL SELECT word, tag, i, k, CASE WHEN k = 0 THEN substr(word, i + 1) ELSE upper(substr(word, i + 1, 1)) || substr(word, i + 2) END FROM (SELECT word, tag, unnest(range(1, length(word) - 4)) AS i, unnest([0, 1]) AS k FROM f) WHERE length(word) > 5),
h AS (SELECT c.word, c.tag, i, k, left(c.word, i) || CASE WHEN i > 0 AND k = 1 THEN lower(lemma) ELSE lemma END AS lemma FROM c JOIN t ON c.w = t.wordform AND c.tag = t.tag),
b AS (SELECT word, tag, arg_min(lemma, (i, k)) AS lemma FROM h GROUP BY ALL)
SELECT f.word, f.tag, coalesce(lemma, '<unknown>') AS lemma FROM f LEFT JOIN b USING (word, tag)""".replace("unnest(range(1, length(word) - 4)) AS i, unnest([0, 1]) AS k FROM f)", "i, k FROM f, (SELECT unnest([0, 1]) AS k) ks, LATERAL (SELECT unnest(range(1, length(word) - 4)) AS i) cuts)"))
def j21_lemmatise(spark, d):
    table, words = lemma_table(spark, d)
    return L.lemmatise(words, table)


@query(f"""WITH {TOK}, {LEXICON_SQL}, per AS (SELECT wordform, list(DISTINCT translate(lower({_comparable('accented')}), 'j', 'i')) AS fs FROM lexicon GROUP BY wordform),
w AS (SELECT lower(text) AS low, translate(lower(text), 'j', 'i') AS m FROM tok WHERE regexp_matches(text, '{WORD}')),
j AS (SELECT fs, list_contains(fs, m) AS ok, len(fs) = 1 AS one FROM w LEFT JOIN per ON low = wordform)
SELECT count(*) AS words, count(*) FILTER (WHERE fs IS NULL) AS unknown, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE ok AND one) AS unique_correct, count(*) FILTER (WHERE ok AND NOT one) AS ambiguous_correct,
  count(*) FILTER (WHERE fs IS NOT NULL AND NOT ok AND one) AS unique_wrong, count(*) FILTER (WHERE fs IS NOT NULL AND NOT ok AND NOT one) AS ambiguous_wrong FROM j""")
def a22_oracle_accuracy(spark, d):
    """The documents' unmarked words against the lexicon's forms."""
    return L.oracle_accuracy(tokens(spark, d).withColumn("marked", F.col("text")), X.lexicon(spark, d))


@query(f"WITH {LEXICON_SQL}, c AS (SELECT left(wordform, 1) AS wordform, lemma, count(*) AS freq, min(seq) AS ord FROM lexicon GROUP BY ALL) SELECT wordform, string_agg(lemma, ' ' ORDER BY freq DESC, ord) AS lemmas FROM c GROUP BY wordform")
def t09_ordered_lemmas(spark, d):
    corpus = X.lexicon(spark, d).groupBy(F.substring("wordform", 1, 1).alias("wordform"), "lemma").agg(F.count(F.lit(1)).alias("freq"), F.min("seq").alias("ord"))
    return L.ordered_lemmas(corpus).select("wordform", F.array_join(F.transform("lemmas", lambda x: x["lemma"]), " ").alias("lemmas"))


@query(f"WITH {LEXICON_SQL}, e AS (SELECT DISTINCT left(tag, 1) AS tag, right(wordform, 1 + length(wordform) % 3) AS ending FROM lexicon) SELECT tag, string_agg(ending, ' ' ORDER BY length(ending) DESC, ending) AS endings FROM e GROUP BY tag")
def t06_ordered_endings(spark, d):
    rows = X.lexicon(spark, d).select(F.substring("tag", 1, 1).alias("tag"), F.expr("right(wordform, 1 + length(wordform) % 3)").alias("ending"))
    return L.ordered_endings(rows).withColumn("endings", F.array_join("endings", " "))


# Streams


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '({T})', 1)) AS tokens FROM conversations".replace("{T}", W.TOKEN))
def x01_stream_tokens(spark, d):
    """The token counts of the conversations, read as a stream of files; the same as the batch."""
    from textloom.session import temporary_folder
    from textloom.streaming.replay import run_over_files

    folder = temporary_folder(spark, "stream")
    schema = table(spark, d, "conversations").schema
    table(spark, d, "conversations").write.parquet(f"{folder}/in")
    count = lambda df: df.select("conv_id", "turn", F.size(T.token_array(F.col("text"))).cast("long").alias("tokens"))
    return run_over_files(spark, f"{folder}/in", schema, count, f"{folder}/out", f"{folder}/checkpoint", 4)
