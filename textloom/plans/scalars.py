"""Queries f_*: one scalar function each over the distinct words of the documents, with its SQL.

`{x}` is the word, `{m}` a marked form of it and `{t}` a tag made from it; both engines make them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import words as W
from textloom.operators import morphology as M
from textloom.operators.tokens import generic_clitic, tokenise

WORD = r"^[\p{L}\p{Nl}\p{No}]"
HEX_DIGITS, TAG_LETTERS = "0123456789abcdef", "nvadtvadspspfmnf"


def marked(x: Column) -> Column:
    digit = F.substring(F.md5(x.cast("binary")), 1, 1)
    return F.when(digit < "5", F.regexp_replace(x, "([aeiouy])", "$1_")).when(digit < "a", F.regexp_replace(x, "([aeo])", "$1_^")).otherwise(F.regexp_replace(x, "([iu])", "$1^"))


def pseudo_tag(x: Column) -> Column:
    return F.translate(F.substring(F.md5(x.cast("binary")), 3, 9), HEX_DIGITS, TAG_LETTERS)


SQL_M = r"CASE WHEN substr(md5(text), 1, 1) < '5' THEN regexp_replace(text, '([aeiouy])', '\1_', 'g') WHEN substr(md5(text), 1, 1) < 'a' THEN regexp_replace(text, '([aeo])', '\1_^', 'g') ELSE regexp_replace(text, '([iu])', '\1^', 'g') END"
SQL_T = f"translate(substr(md5(text), 3, 9), '{HEX_DIGITS}', '{TAG_LETTERS}')"
SQL_WORDS = rf"SELECT DISTINCT text FROM (SELECT unnest(regexp_extract_all(text, '({W.TOKEN})', 1)) AS text FROM documents) WHERE regexp_matches(text, '{WORD}')"


def _nested(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_ASCII = "translate(" + _nested("{x}", [("æ", "ae"), ("Æ", "Ae"), ("œ", "oe"), ("Œ", "Oe")]) + ", 'äëïöüÿ', 'aeiouu')"
_MARKS = [*((p + "_", q) for p, q in zip(W.PLAIN, W.LONG, strict=True)), *W.DIAERESIS.items()]
_SEGMENT = (
    "array_to_string(list_filter(list_transform(regexp_extract_all(regexp_replace(replace(replace(replace(replace(lower({m}), 'qu', 'q'), 'x', 'cs'), 'z', 'ds'), '+', '^'), "
    r"'(a|e|o)([eui])([_^])', '\1|\2\3', 'g'), '(ae|au|ei|eu|oe|[aeiouy][_^]*|[^aeiouy|]+)', 1), lambda s: replace(s, 'h', '')), lambda s: s <> ''), ' ')"
)
_SHORT_J = "^(" + "|".join(W.SHORT_J) + ")"
_TITLE = "({x} = upper(left({x}, 1)) || lower(substr({x}, 2)) AND {x} <> lower({x}))"


def _describe_sql() -> str:
    parts = []
    for i, (_, names) in enumerate(W.TAG):
        raw = f"substr({{t}}, {i + 1}, 1)"
        cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items())
        parts.append(f"CASE WHEN {raw} = '-' THEN NULL ELSE CASE {raw} {cases} ELSE 'unknown (' || {raw} || ')' END END")
    return "concat_ws(', ', " + ", ".join(parts) + ")"


def distance_sql(a: str, b: str) -> str:
    noun = lambda t: f"(lower(left({t}, 1)) IN ('n', 'a') OR (lower(left({t}, 1)) = 'v' AND substr({t}, 4, 3) IN ('rpp', 'ppa')))"
    skip = f"({noun(a)} AND {noun(b)} AND left({a}, 1) <> left({b}, 1))"
    parts = [f"(substr({a}, {i}, 1) <> substr({b}, {i}, 1)" + (f" AND NOT {skip}" if i in (4, 5, 6) else "") + ")::INT" for i in range(1, 10)]
    return "(" + " + ".join(parts) + ")"


Scalar = tuple[Callable[[Column, Column, Column], Column], str]
#: name: (Column of word, marked form and tag; SQL).
SCALARS: dict[str, Scalar] = {
    "f01_to_ascii": (lambda x, m, t: W.to_ascii(x), _ASCII),
    "f02_to_ui": (lambda x, m, t: W.to_ui(x), "translate({x}, 'vUjJ', 'uViI')"),
    "f02_to_ui_small": (lambda x, m, t: W.to_ui(x, False), "translate({x}, 'vVjJ', 'uUiI')"),
    "f03_from_ui": (lambda x, m, t: W.from_ui(x), "translate({x}, 'uUiI', 'vVjJ')"),
    "f04_starts_with_vowel": (lambda x, m, t: W.starts_with_vowel(x).cast("string"), "regexp_matches({x}, '(?i)^[aeiouy]')::VARCHAR"),
    "f04_letter_class": (
        lambda x, m, t: F.concat(W.is_vowel(F.substring(x, 1, 1)).cast("string"), W.is_consonant(F.substring(x, 1, 1)).cast("string")),
        "regexp_matches(left({x}, 1), '(?i)^[aeiouy]$')::VARCHAR || regexp_matches(left({x}, 1), '(?i)^[bcdfghjklmnpqrstvxz]$')::VARCHAR",
    ),
    "f05_short_j": (lambda x, m, t: W.starts_with_short_j(x).cast("string"), f"regexp_matches({{x}}, '{_SHORT_J}')::VARCHAR"),
    "f06_normalize_word": (lambda x, m, t: W.normalize_word(x), f"trim(lower({_ASCII}))"),
    "f08_vowel_clusters": (lambda x, m, t: F.array_join(W.vowel_clusters(x), " "), "array_to_string(regexp_extract_all({x}, '(?i)(ae|au|ei|eu|oe|[aeiouy])', 1), ' ')"),
    "f09_is_ambiguous": (lambda x, m, t: W.is_ambiguous(m).cast("string"), "contains({m}, '_^')::VARCHAR"),
    "f10_escape_html": (lambda x, m, t: W.escape_html(F.concat(x, F.lit("<&>"), x)), _nested("({x} || '<&>' || {x})", [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])),
    "f11_levenshtein": (lambda x, m, t: F.levenshtein(x, m).cast("string"), "levenshtein({x}, {m})::VARCHAR"),
    "f12_marks_to_unicode": (lambda x, m, t: W.marks_to_unicode(m), _nested("({m})", _MARKS)),
    "f13_unicode_to_marks": (lambda x, m, t: W.unicode_to_marks(W.marks_to_unicode(m)), _nested(_nested("({m})", _MARKS), [(q, p + "_") for p, q in zip(W.PLAIN, W.LONG, strict=True)])),
    "f14_remove_marks": (lambda x, m, t: W.remove_marks(W.marks_to_unicode(m)), f"translate({_nested('({m})', _MARKS)}, '{W.LONG}', '{W.PLAIN}')"),
    "f15_filter_accents": (
        lambda x, m, t: W.filter_accents(m),
        r"regexp_replace(regexp_replace(regexp_replace(replace({m}, '^_', '_^'), '_\^([bcdfgpt][lr])', '^\1', 'g'), 'u_m$', 'um'), '([AEIOUYaeiouy])\^?n([sfx]|ct)', '\1_n\2', 'g')",
    ),
    "f17_clean_lemma": (lambda x, m, t: W.clean_lemma(F.concat(m, F.lit("#1 -a"))), "translate({m} || '#1 -a', ' #1-^_', '+')"),
    "f18_normalize_tag": (
        lambda x, m, t: W.normalize_tag(F.concat_ws(".", F.substring(t, 1, 1), F.substring(t, 2, 3), F.substring(t, 5, 5), t, t)),
        "array_to_string([substr({t} || {t} || {t}, 2 * i + 1, 1) for i in range(9)], '')",
    ),
    "f19_dots_to_dashes": (lambda x, m, t: W.dots_to_dashes(F.concat_ws(".", t, t)), "{t} || '-' || {t}"),
    "f20_describe_tag": (lambda x, m, t: W.describe_tag(t), _describe_sql()),
    "f26_tag_distance": (lambda x, m, t: W.tag_distance(t, pseudo_tag(m)).cast("string"), distance_sql("{t}", SQL_T.replace("md5(text)", "md5({m})")) + "::VARCHAR"),
    "f27_is_title": (lambda x, m, t: W.is_title(x).cast("string"), f"{_TITLE}::VARCHAR"),
    "f28_is_all_caps": (lambda x, m, t: W.is_all_caps(x).cast("string"), "({x} = upper({x}))::VARCHAR"),
    "f29_also_maius": (lambda x, m, t: W.also_maius(F.concat(x, F.lit("aja"))), f"CASE WHEN regexp_matches({{x}} || 'aja', '{_SHORT_J}') THEN {{x}} || 'aja' ELSE regexp_replace({{x}} || 'aja', '([aeiouy])(j[aeiouy])', '\\1_\\2', 'g') END"),
    "f30_all_vowels_ambiguous": (
        lambda x, m, t: W.all_vowels_ambiguous(x),
        r"regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({x}, '([aeiouy])', '\1_^', 'g'), 'qu_^', 'qu'), '_\^(ns|nf|nct)', '_\1', 'g'), '_\^([bcdfgjklmnpqrstv]{{2,}}|[xz])', '\1', 'g'), '_\^m$', 'm')",
    ),
    "f31_segments": (lambda x, m, t: F.array_join(W.segments(m), " "), _SEGMENT),
    "f32_scansion": (
        lambda x, m, t: W.scansion_of(F.regexp_replace(F.regexp_replace(F.lower(x), "[aeouy]", "V"), "[^V]", "C")),
        "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[aeouy]', 'V', 'g'), '[^V]', 'C', 'g'), 'VMC*|VCCC*|LM?C*', 'L', 'g'), 'VC?', 'S', 'g'), '^C*', '')",
    ),
    "f34_consonantal_u": (lambda x, m, t: M.consonantal_u(x), r"regexp_replace(regexp_replace({x}, '^u([aeiou])', 'v\1', 'g'), '([aeio])u([aeiou])', '\1v\2', 'g')"),
    "f36_strip_quantities": (lambda x, m, t: W.strip_quantities(m), "translate({m}, '_^', '')"),
    "f37_feature_name": (lambda x, m, t: W.feature_name(F.substring(t, 1, 1), F.substring(t, 2, 1), F.lit(1), F.lit(2)), "left({t}, 1) || '.' || substr({t}, 2, 1) || '(1).2'"),
    "f38_ascii_lowered": (lambda x, m, t: F.coalesce(W.ascii_lowered(x), F.lit("-")), "CASE WHEN regexp_full_match({x}, '[A-Z][a-z]*') THEN lower({x}) ELSE '-' END"),
    "f39_hyphen_tail": (lambda x, m, t: W.hyphen_tail(F.concat(x, F.lit("-"), m)), "{m}"),
    "f40_log_sum": (lambda x, m, t: F.round(W.log_sum(-F.length(x).cast("double"), -F.length(m).cast("double")), 6).cast("decimal(18,6)").cast("string"), "round(ln(exp(-length({x})::DOUBLE) + exp(-length({m})::DOUBLE)), 6)::DECIMAL(18,6)::VARCHAR"),
    "f42_strip_ending": (lambda x, m, t: F.coalesce(W.strip_ending(x, "en"), F.lit("-")), "CASE WHEN ends_with({x}, 'en') THEN left({x}, length({x}) - 2) ELSE '-' END"),
    "f43_collation_key": (lambda x, m, t: W.collation_key(m), "translate(lower({m}), '_^-''', '')"),
    "f47_trans_patch": (lambda x, m, t: W.trans_patch(F.concat(F.lit("tra"), x), F.concat(F.lit("trans"), x)), "CASE WHEN left({x}, 1) <> '_' THEN 'tra_' || {x} ELSE 'tra' || {x} END"),
    "f48_enclitic_accent": (lambda x, m, t: W.enclitic_accent(x), "CASE WHEN lower({x}) = 'ue' THEN 've' ELSE lower({x}) END"),
    "f49_comparable_accent": (lambda x, m, t: W.comparable_accent(m), _nested(r"regexp_replace({m}, '_?\^', '', 'g')", [(p + "_", q) for p, q in zip(W.PLAIN, W.LONG, strict=True) if p not in "yY"])),
    "f50_comparable_word": (lambda x, m, t: W.comparable_word(x), "translate(lower({x}), 'j', 'i')"),
    "p13_generic_clitic": (
        lambda x, m, t: generic_clitic(x),
        "CASE WHEN length({x}) > 3 AND ends_with(lower({x}), 'que') THEN 'que' WHEN length({x}) <= 2 THEN '' "
        + " ".join(f"WHEN ends_with(lower({{x}}), '{c}') THEN '{c}'" for c in ("ve", "ue", "ne", "st"))
        + " ELSE '' END",
    ),
    "p20_has_vowel": (lambda x, m, t: W.has_vowel(x).cast("string"), "regexp_matches({x}, '(?i)[aeiouy]')::VARCHAR"),
    "p31_toggle_length": (lambda x, m, t: W.toggle_length(W.marks_to_unicode(m)), f"translate({_nested('({m})', _MARKS)}, '{W.LONG + W.PLAIN}', '{W.PLAIN + W.LONG}')"),
    "q12_fallback_tag": (
        lambda x, m, t: W.fallback_tag(x),
        "CASE WHEN lower({x}) LIKE '%are' THEN 'v1sp' WHEN lower({x}) LIKE '%ēre' THEN 'v2sp' WHEN lower({x}) LIKE '%ere' THEN 'v3sp' WHEN lower({x}) LIKE '%īre' THEN 'v4sp' WHEN lower({x}) LIKE '%us' THEN 'a--s--m' WHEN lower({x}) LIKE '%um' THEN 'a--s--n' WHEN lower({x}) LIKE '%a' THEN 'a--s--f' ELSE '---------' END",
    ),
}


def _query(build) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens = tokenise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        words = tokens.where(W.is_word(F.col("text"))).select("text").distinct()
        x = F.col("text")
        return words.select("text", build(x, marked(x), pseudo_tag(x)).alias("out"))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(build) for name, (build, _) in SCALARS.items()}


def sql() -> dict[str, str]:
    out = {}
    for name, (_, template) in SCALARS.items():
        body = template.replace("{{", "\0").replace("}}", "\1").replace("{x}", "text").replace("{m}", f"({SQL_M})").replace("{t}", f"({SQL_T})").replace("\0", "{").replace("\1", "}")
        out[name] = f"WITH words AS ({SQL_WORDS}) SELECT text, {body} AS out FROM words"
    return out
