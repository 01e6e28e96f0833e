"""Scalar functions on words, marked forms and tags, as Column expressions.

Marked forms write a length mark `_` behind a long vowel and `^` behind a short one; `_^` means either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vowels with and without the mark, words whose j is short, and the classes of characters.
LONG, PLAIN = "āēīōūȳĀĒĪŌŪȲ", "aeiouyAEIOUY"
DIAERESIS = {"ä_": "ā", "ë_": "ē", "ï_": "ī", "ö_": "ō", "ü_": "ū", "ÿ_": "ȳ", "æ_": "æ", "œ_": "œ", "Æ_": "Æ", "Œ_": "Œ"}
SHORT_J = ("bij", "fidej", "Foroj", "foroj", "ju_rej", "multij", "praej", "quadrij", "rej", "retroj", "se_mij", "sesquij", "u_nij", "introj")
SPACE = r"\x09-\x0D\x1C-\x20\x85\p{Z}"
TOKEN = rf"[\p{{L}}\p{{Nl}}\p{{No}}]+|[{SPACE}]+|[^\p{{L}}\p{{N}}_{SPACE}]+|[\p{{Nd}}_]+"
ENDERS = "[.;:?!]"


def _replaced(x: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, x)


def to_ascii(x: Column) -> Column:
    """ligatures as two letters, letters with a diaeresis plain."""
    return F.translate(_replaced(x, [("æ", "ae"), ("Æ", "Ae"), ("œ", "oe"), ("Œ", "Oe")]), "äëïöüÿ", "aeiouu")


def to_ui(x: Column, capitals_to_v: bool = True) -> Column:
    """v as u and j as i; capitals as V (else as U)."""
    return F.translate(x, "vUjJ", "uViI") if capitals_to_v else F.translate(x, "vVjJ", "uUiI")


def from_ui(x: Column, utov: bool = True, itoj: bool = True) -> Column:
    """u as v and i as j throughout."""
    return F.translate(x, ("uU" if utov else "") + ("iI" if itoj else ""), ("vV" if utov else "") + ("jJ" if itoj else "")) if utov or itoj else x


def is_vowel(x: Column) -> Column:
    return x.rlike("^(?i)[aeiouy]$")


def is_consonant(x: Column) -> Column:
    return x.rlike("^(?i)[bcdfghjklmnpqrstvxz]$")


def starts_with_vowel(x: Column) -> Column:
    return x.rlike("^(?i)[aeiouy]")


def has_vowel(x: Column) -> Column:
    """P20."""
    return x.rlike("(?i)[aeiouy]")


def starts_with_short_j(x: Column) -> Column:
    """F05."""
    return x.rlike("^(" + "|".join(SHORT_J) + ")")


def normalize_word(x: Column) -> Column:
    """F06."""
    return F.trim(F.lower(to_ascii(x)))


def is_sentence_ender(x: Column) -> Column:
    """holds one of . ; : ? !"""
    return x.rlike(ENDERS)


def is_punctuation(x: Column) -> Column:
    return ~x.rlike(rf"[\p{{L}}\p{{N}}_{SPACE}]")


def is_space(x: Column) -> Column:
    return ~x.rlike(rf"[^{SPACE}]")


def is_word(x: Column) -> Column:
    """Begins with a letter."""
    return x.rlike(r"^[\p{L}\p{Nl}\p{No}]")


def vowel_clusters(x: Column) -> Column:
    """the vowels and diphthongs of a word, in order."""
    return F.regexp_extract_all(x, F.lit("(?i)(ae|au|ei|eu|oe|[aeiouy])"), F.lit(1))


def vowel_spans(x: Column) -> Column:
    """their begins and ends, as an array of structs."""
    start = lambda part: F.aggregate(part, F.lit(0), lambda n, y: n + F.length(y))
    parts = F.regexp_extract_all(x, F.lit("(?i)(ae|au|ei|eu|oe|[aeiouy]|[^aeiouy]+)"), F.lit(1))
    spans = F.transform(parts, lambda y, i: F.struct(y.alias("y"), start(F.slice(parts, F.lit(1), i)).alias("start")))
    return F.transform(F.filter(spans, lambda s: s["y"].rlike("^(?i)[aeiouy]")), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["y"])).alias("end")))


def is_ambiguous(x: Column) -> Column:
    """F09."""
    return x.contains("_^")


def escape_html(x: Column) -> Column:
    """F10."""
    return _replaced(x, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def marks_to_unicode(x: Column) -> Column:
    """a vowel and its mark as one letter."""
    return _replaced(x, [*((p + "_", q) for p, q in zip(PLAIN, LONG, strict=True)), *DIAERESIS.items()])


def unicode_to_marks(x: Column) -> Column:
    """F13."""
    return _replaced(x, [(q, p + "_") for p, q in zip(PLAIN, LONG, strict=True)])


def remove_marks(x: Column) -> Column:
    """F14."""
    return F.translate(x, LONG, PLAIN)


def filter_accents(x: Column) -> Column:
    """the order of both marks, and vowels whose length their surroundings decide."""
    x = F.replace(x, F.lit("^_"), F.lit("_^"))
    x = F.regexp_replace(x, r"_\^([bcdfgpt][lr])", "^$1")
    x = F.regexp_replace(x, "u_m$", "um")
    return F.regexp_replace(x, r"([AEIOUYaeiouy])\^?n([sfx]|ct)", "$1_n$2")


def clean_lemma(x: Column) -> Column:
    """F17."""
    return F.translate(x, " #1-^_", "+")


def normalize_tag(x: Column) -> Column:
    """tags of 9 or 12 characters as they are; others without dots, every other character if 9 or more are left."""
    plain = F.replace(x, F.lit("."), F.lit(""))
    every = F.array_join(F.filter(F.split(plain, ""), lambda _, i: i % 2 == 0), "")
    return F.when(F.length(x).isin(9, 12), x).when(F.length(plain) >= 9, F.substring(every, 1, 9)).otherwise(plain)


def dots_to_dashes(x: Column) -> Column:
    """F19, P24."""
    return F.translate(x, ".", "-")


# The positions of a tag and what their letters mean.
TAG = [
    ("POS", {"n": "noun", "v": "verb", "a": "adjective", "d": "adverb", "c": "conjunction", "r": "preposition", "p": "pronoun", "m": "numeral", "i": "interjection", "e": "exclamation", "u": "punctuation"}),
    ("Person", {"1": "1st person", "2": "2nd person", "3": "3rd person"}),
    ("Number", {"s": "singular", "p": "plural"}),
    ("Tense", {"p": "present", "i": "imperfect", "r": "perfect", "l": "pluperfect", "t": "future perfect", "f": "future"}),
    ("Mood", {"i": "indicative", "s": "subjunctive", "n": "infinitive", "m": "imperative", "p": "participle", "d": "gerund", "g": "gerundive", "u": "supine"}),
    ("Voice", {"a": "active", "p": "passive"}),
    ("Gender", {"m": "masculine", "f": "feminine", "n": "neuter"}),
    ("Case", {"n": "nominative", "g": "genitive", "d": "dative", "a": "accusative", "b": "ablative", "v": "vocative", "l": "locative"}),
    ("Degree", {"c": "comparative", "s": "superlative"}),
]


def decode_tag(x: Column) -> Column:
    """(feature, value, raw) of each position that is not `-`."""

    def part(i: int, name: str, names: dict[str, str]) -> Column:
        raw = F.substring(x, i + 1, 1)
        value = F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in names.items() for y in kv]), raw), F.concat(F.lit("unknown ("), raw, F.lit(")")))
        return F.struct(F.lit(name).alias("feature"), value.alias("value"), raw.alias("raw"))

    every = F.array(*[part(i, name, names) for i, (name, names) in enumerate(TAG)])
    return F.when(F.length(x) == 9, F.filter(every, lambda s: s["raw"] != "-"))


def describe_tag(x: Column) -> Column:
    """the values of a tag, joined; `unknown` if it has none."""
    values = F.array_join(F.transform(decode_tag(x), lambda s: s["value"]), ", ")
    return F.when(F.coalesce(values, F.lit("")) == "", "unknown").otherwise(values)


def tag_distance(a: Column, b: Column) -> Column:
    """positions that differ; tense, mood and voice do not count between nominal forms of two kinds. Null for odd lengths."""
    n = F.length(a)

    def nominal(t: Column) -> Column:
        verbal = F.when(F.length(t) == 9, F.substring(t, 4, 3)).otherwise(F.substring(t, 5, 3)).isin("rpp", "ppa")
        return F.lower(F.substring(t, 1, 1)).isin("n", "a") | ((F.lower(F.substring(t, 1, 1)) == "v") & verbal)

    skip = nominal(a) & nominal(b) & (F.substring(a, 1, 1) != F.substring(b, 1, 1))
    first = F.when(n == 9, F.lit(4)).otherwise(F.lit(5))
    count = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda d, i: d + F.when((F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))) & ~(skip & (i >= first) & (i < first + 3)), 1).otherwise(0),
    )
    return F.when((n == F.length(b)) & n.isin(9, 12), count)


def is_title(x: Column) -> Column:
    """the first letter upper, the rest lower."""
    return (x == F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))) & (x != F.lower(x))


def is_all_caps(x: Column) -> Column:
    """F28."""
    return x == F.upper(x)


def also_maius(x: Column) -> Column:
    """a vowel before j and a vowel is long, but for words whose j is short."""
    return F.when(starts_with_short_j(x), x).otherwise(F.regexp_replace(x, "([aeiouy])(j[aeiouy])", "$1_$2"))


def all_vowels_ambiguous(x: Column) -> Column:
    """the marked form of an unknown word."""
    x = F.regexp_replace(x, "([aeiouy])", "$1_^")
    x = F.replace(x, F.lit("qu_^"), F.lit("qu"))
    x = F.regexp_replace(x, r"_\^(ns|nf|nct)", "_$1")
    x = F.regexp_replace(x, r"_\^([bcdfgjklmnpqrstv]{2,}|[xz])", "$1")
    return F.regexp_replace(x, r"_\^m$", "m")


def segments(x: Column) -> Column:
    """the vowels and consonant clusters of a marked form."""
    plain = _replaced(F.lower(x), [("qu", "q"), ("x", "cs"), ("z", "ds"), ("+", "^")])
    # A diphthong whose second vowel has a mark of its own is two vowels.
    parted = F.regexp_replace(plain, r"(a|e|o)([eui])([_^])", "$1|$2$3")
    found = F.regexp_extract_all(parted, F.lit(r"(ae|au|ei|eu|oe|[aeiouy][_^]*|[^aeiouy|]+)"), F.lit(1))
    kept = F.filter(F.transform(found, lambda s: F.replace(s, F.lit("h"), F.lit(""))), lambda s: s != "")
    return F.when(x == "hoc", F.array(F.lit("o"), F.lit("cc"))).otherwise(kept)


def scansion_of(x: Column) -> Column:
    """F32: quantities of a string of vowels (V long as L, M for a final m) and consonants."""
    x = F.regexp_replace(x, "VMC*|VCCC*|LM?C*", "L")
    return F.regexp_replace(F.regexp_replace(x, "VC?", "S"), "^C*", "")


def strip_quantities(x: Column) -> Column:
    """F36."""
    return F.translate(x, "_^", "")


def feature_name(category: Column, feature: Column, pos: Column, context: Column) -> Column:
    """F37."""
    return F.concat(F.concat_ws(".", category, feature), F.lit("("), pos.cast("string"), F.lit(")."), context.cast("string"))


def ascii_lowered(x: Column) -> Column:
    """the lower-case word of one with a capital first; null for others."""
    return F.when(x.rlike("^[A-Z][a-z]*$"), F.lower(x))


def hyphen_tail(x: Column) -> Column:
    """F39."""
    return F.substring_index(x, "-", -1)


def log_sum(a: Column, b: Column) -> Column:
    """ln(e^a + e^b)."""
    return F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b)))


def strip_ending(x: Column, ending: str) -> Column:
    """the stem before an ending; null if the word has another."""
    return F.when(x.endswith(ending), F.substring(x, F.lit(1), F.length(x) - len(ending)))


def collation_key(x: Column) -> Column:
    """what words are ordered by: without marks, hyphens and case."""
    return F.translate(F.lower(x), "_^-'", "")


def trans_patch(accented: Column, lemma: Column) -> Column:
    """a prefix trans has a long a."""
    return F.when(lemma.startswith("trans") & (F.substring(accented, 4, 1) != "_"), F.concat(F.substring(accented, 1, 3), F.lit("_"), F.substring(accented, 4, 1 << 30))).otherwise(accented)


def enclitic_accent(x: Column) -> Column:
    """F48."""
    return F.when(F.lower(x) == "ue", "ve").otherwise(F.lower(x))


def comparable_accent(x: Column) -> Column:
    """marks as letters, without short and uncertain ones; y keeps its mark."""
    x = F.regexp_replace(x, r"_?\^", "")
    return _replaced(x, [(p + "_", q) for p, q in zip(PLAIN, LONG, strict=True) if p not in "yY"])


def comparable_word(x: Column) -> Column:
    """F50."""
    return F.translate(F.lower(x), "j", "i")


def toggle_length(x: Column) -> Column:
    """Each vowel of the other length."""
    return F.translate(x, LONG + PLAIN, PLAIN + LONG)


def strip_markers(x: Column) -> Column:
    """A line without its leading number marks."""
    return F.regexp_replace(x, r"^\[\d+\]\s*(\d+\s+)?", "")


def fallback_tag(x: Column) -> Column:
    """Q12: the tag of a word by its ending; the first that fits."""
    # Fixed values, in the order of the first place of each ending.
    rules = [("are", "v1sp"), ("ēre", "v2sp"), ("ere", "v3sp"), ("īre", "v4sp"), ("us", "a--s--m"), ("um", "a--s--n"), ("a", "a--s--f")]
    out = F.lit("---------")
    for ending, tag in reversed(rules):
        out = F.when(F.lower(x).endswith(ending), tag).otherwise(out)
    return out


def breves_and_longs(x: Column) -> Column:
    """F16: a long mark behind a vowel and a short one before it, as letters; y has neither."""
    # The vowels with a breve, in the order of PLAIN without y.
    plain, short = "aeiouAEIOU", "ăĕĭŏŭĂĔĬŎŬ"
    longs = [(p + "_", q) for p, q in zip(PLAIN, LONG, strict=True) if p not in "yY"]
    return _replaced(x, [*(("^" + p, q) for p, q in zip(plain, short, strict=True)), *longs])


def simplify_tag(x: Column) -> Column:
    """A tag with fewer distinctions: prepositions and conjunctions without attributes, both auxiliaries as one, no
    empty attributes."""
    x = F.regexp_replace(x, r"^(APPR|CONJ\.Coord)\..*", "$1")
    x = F.regexp_replace(x, r"\.(Haben|Sein)\.", ".Aux.")
    return F.replace(x, F.lit(".-"), F.lit(""))


def without_prefix(x: Column, prefix: str = "DEBUG") -> Column:
    """A text without a command before it and the white space behind that."""
    return F.when(x.startswith(prefix), F.regexp_replace(F.substr(x, F.lit(len(prefix) + 1), F.length(x)), f"^[{SPACE}]+", "")).otherwise(x)


# Names of the part-of-speech codes.
CODE_NAMES = {"N": "noun", "V": "verb", "A": "adjective", "P": "pronoun", "ADV": "adverb", "PREP": "preposition", "CONJ": "conjunction", "INTERJ": "interjection", "NUM": "numeral", "PART": "particle", "X": "unknown"}


def code_name(x: Column) -> Column:
    """the name of a part-of-speech code; other codes in lower case."""
    names = F.create_map(*[F.lit(v) for kv in CODE_NAMES.items() for v in kv])
    return F.coalesce(F.element_at(names, x), F.lower(x))


def word_class(x: Column, steps: dict[tuple[int, str], int], classes: dict[int, int]) -> Column:
    """Q13: the class of a word by an automaton over its letters, from state 0; 0 where it stops within the word or ends in a
    state without a class. steps: (state, letter) to the next state."""
    moves = F.create_map(*[v for (state, letter), to in steps.items() for v in (F.lit(f"{state}:{letter}"), F.lit(to))])
    named = F.create_map(*[F.lit(v) for kv in classes.items() for v in kv])
    state = F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0), lambda s, c: F.coalesce(F.element_at(moves, F.concat_ws(":", s.cast("string"), c)), F.lit(-1)))
    return F.coalesce(F.element_at(named, state), F.lit(0))
