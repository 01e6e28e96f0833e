"""Lemmas, analyses, long tags, outputs and the command line on small inputs of our own."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import words as W
from textloom.functions.register import FUNCTIONS, register
from textloom.operators import lexicon as L
from textloom.operators import morphology as M
from textloom.operators import stats as S
from textloom.operators import tagger as G
from textloom.operators import tokens as T
from textloom.plans.pipeline import Engine, Lemmas, Options, mark_tokens, restore_marks, scan_tokens
from textloom.sources import readers as R
from textloom.sources import sinks as K

LEXICON = [(0, "tela", "n-s---fn-", "tela", "te_la"), (1, "tela", "n-s---fb-", "tela", "te_la_"), (2, "viam", "n-s---fa-", "via", "viam"), (3, "iam", "d--------", "jam", "jam")]
ENTRY = "seq long, wordform string, tag string, lemma string, accented string"


def values(spark, function, *given):
    df = spark.createDataFrame([(x,) for x in given], "x string")
    return [r[0] for r in df.select(function(F.col("x"))).collect()]


def test_functions(spark):
    assert values(spark, W.breves_and_longs, "^a_e_y_", "U_^u") == ["ă_ēy_", "Ūŭ"]
    assert values(spark, W.simplify_tag, "APPR.Dat.-", "VFIN.Haben.3.Sg", "N.-.Nom", "CONJ.Coord.-") == ["APPR", "VFIN.Aux.3.Sg", "N.Nom", "CONJ.Coord"]
    assert values(spark, W.without_prefix, "DEBUG  text", "text") == ["text", "text"]
    assert values(spark, W.code_name, "ADV", "Zed") == ["adverb", "zed"]


def test_word_classes(spark):
    steps = {(0, "a"): 0, (0, "1"): 1, (1, "1"): 1}
    assert values(spark, lambda x: W.word_class(x, steps, {0: 3, 1: 2}), "aa", "1", "a11", "1a", "b", "") == [3, 2, 2, 0, 0, 3]


def test_functions_under_sql_names(spark):
    names = register(spark)
    df = spark.createDataFrame([("Tēla_v Jus qu'ē &<",), ("amare",), ("",), (None,)], "x string")
    for name, (key, function) in zip(names, FUNCTIONS.items(), strict=True):
        assert name.endswith(key)
        assert df.selectExpr(f"{name}(x) AS y").collect() == df.select(function(F.col("x")).alias("y")).collect()


def test_lemmatiser_cascade(spark):
    table = spark.createDataFrame([("Hund", "N.Sg", "Hund"), ("laut", "ADJD", "laut"), ("Mann", "N.Sg", "Mann"), ("gehe", "V...", "gehen"), ("kannten", "V.P", "kennen"), ("Hause", "N.Sg", "Haus")], "word string, tag string, lemma string")
    given = [("Hund", "N.Sg", "Hund"), ("Laut", "ADJD", "laut"), ("See-Mann", "N.Sg", "See-Mann"), ("7", "CARD", "<card>"), ("3.", "ADJA.Pos.Nom", "<ord>"), ("gehe", "V.1.Sg", "gehen"), ("bekannten", "V.P", "bekennen"), ("Bauernhause", "N.Sg", "Bauernhaus"), ("Bauernhaus", "N.Sg", "<unknown>"), ("xyz", "N.Sg", "<unknown>"), ("abhund", "N.Sg", "<unknown>")]
    tagged = spark.createDataFrame([x[:2] for x in given] * 2, "word string, tag string")
    got = {(r["word"], r["tag"]): r["lemma"] for r in L.lemmatise(tagged, table).collect()}
    assert got == {x[:2]: x[2] for x in given}
    assert {r["lemma"] for r in L.lemmatise(tagged.where("word = 'xyz'"), table, None).collect()} == {"xyz"}
    simple = {(r["word"], r["tag"]): r["lemma"] for r in L.lookup_lemma(tagged.distinct(), table).collect()}
    assert simple[("Hund", "N.Sg")] == "Hund" and simple[("gehe", "V.1.Sg")] == "gehe"


def test_orders(spark):
    endings = spark.createDataFrame([("n", "us"), ("n", "um"), ("n", "orum"), ("v", "re")], "tag string, ending string")
    assert {r["tag"]: r["endings"] for r in L.ordered_endings(endings).collect()} == {"n": ["orum", "um", "us"], "v": ["re"]}
    corpus = spark.createDataFrame([("a", 0, "x", 1), ("a", 1, "y", 3), ("a", 2, "z", 3)], "wordform string, ord long, lemma string, freq long")
    assert [x["lemma"] for x in L.ordered_lemmas(corpus).first()["lemmas"]] == ["y", "z", "x"]


def test_oracle_accuracy(spark):
    lexicon = spark.createDataFrame(LEXICON, ENTRY)
    tokens = spark.createDataFrame([("tela", "tēla"), ("Tela", "Telā"), ("viam", "viam"), ("viam", "vīam"), ("zzz", "zzz"), (" ", " ")], "text string, marked string")
    assert L.oracle_accuracy(tokens, lexicon).first().asDict() == {"words": 5, "unknown": 1, "correct": 2, "unique_correct": 1, "ambiguous_correct": 1, "unique_wrong": 1, "ambiguous_wrong": 1}


def test_long_tags(spark):
    schema = "pos string, person string, number string, tense string, mood string, voice string, gender string, `case` string, degree string"
    rows = [("noun", None, "sg", None, None, None, "masc", "gen", None), ("verb", "3rd", "sg", "pres", "ind", "act", None, None, None), ("verb", None, "sg", "pres", "part", None, "fem", "nom", None), ("adj", None, "pl", None, None, None, "neut", "acc", None), ("adv", None, None, None, None, None, None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(M.parse_to_long_tag()).collect()]
    assert got == ["Nb-s---mg--i", "V-3spia----i", "V--sppafn--i", "A--p---nap-i", "Df---------n"]
    tags = spark.createDataFrame([("a", "Nb-s---mg--i"), ("a", "Nb-s---ng--i"), ("b", "Df---------n")], "word string, tag string")
    found = {(r["word"], r["tag"]) for r in M.long_tags(tags).collect()}
    assert found == {("a", f"{p}-s---{g}g--i") for p in ("Nb", "Ne") for g in "mno"} | {("b", f"D{x}{y}") for x in "fqu" for y in ("---------n", "-------p-i")}


def analyser(words):
    line = F.when(F.col("word") == "lupa", "<NL>noun lupa_,lupa fem sg abl</NL><NL>noun lupa,lupa fem sg nom</NL>").when(F.col("word") == "Iulius", "<NL>noun Ju_lius,Julius masc sg nom</NL><NL>noun Iu_lius,Julius masc sg nom</NL>")
    return words.select("word", F.coalesce(line, F.lit("")).alias("analyses"))


def test_unknown_words_are_analysed_once_and_join_the_lexicon(spark):
    lexicon = spark.createDataFrame(LEXICON, ENTRY)
    forms = spark.createDataFrame([("Lupa",), ("iulius",), ("tela",), ("qqq",)], "wordform string")
    found = {tuple(r) for r in M.analyse_unknown(forms, lexicon, analyser).collect()}
    assert found == {("lupa", "n-s---fb-", "lupa", "lupa_"), ("lupa", "n-s---fn-", "lupa", "lupa"), ("iulius", "n-s---mn-", "Julius", "Ju_lius"), ("qqq", None, None, None)}
    engine = Engine(spark, analyser=analyser)
    engine.load_lexicon(lexicon)
    docs = spark.createDataFrame([(1, "Iulius lupa qqq")], "doc_id long, text string")
    assert engine.process(docs).first()["unknown"] == 3
    engine.analyse(docs)
    assert engine.process(docs, Options(itoj=True)).first().asDict() == {"doc_id": 1, "text": "Jūlius lupa qqq", "words": 3, "unknown": 1, "ambiguous": 1}
    engine.close()
    cache = spark.createDataFrame([tuple(x) for x in found], "wordform string, tag string, lemma string, accented string")
    held = {r["text"]: r["analyses"] for r in M.attach_analyses(T.tokenise(docs), cache).collect()}
    assert len(held["lupa"]) == 2 and held["qqq"] is None and held[" "] is None


def test_lines_of_analyses_round_trip(spark):
    rows = [("lupa", "noun", "lupa", "lupa_", "fem sg abl"), ("lupa", "noun", "lupa", "lupa", "fem sg nom"), ("it", "verb", "eo", "it", "pres ind act 3rd sg")]
    df = spark.createDataFrame(rows, "word string, pos string, lemma string, accented string, features string")
    entries = {tuple(r) for r in M.entries_of(M.analysis_lines(df)).collect()}
    assert entries == {("lupa", "n-s---fb-", "lupa", "lupa_"), ("lupa", "n-s---fn-", "lupa", "lupa"), ("it", "v3spia---", "eo", "it")}
    assert {r["word"]: r["lines"] for r in M.lemma_lines(df).collect()}["lupa"].count("\n") == 1
    lines = spark.createDataFrame([("f", 0, "lupa "), ("f", 1, "<NL>x</NL>"), ("f", 2, "it"), ("f", 3, "")], "path string, seq long, line string")
    assert {(r["word"], r["analyses"]) for r in M.paired_lines(lines).collect()} == {("lupa", "<NL>x</NL>"), ("it", "")}


def test_derivation_and_joined_sounds(spark):
    stems = spark.createDataFrame([("am", "are", "amo", "verb")], "stem string, stemtype string, lemma string, kind string")
    rules = spark.createDataFrame([("are", "av", "perf", "verb"), ("are", "a", "pres", "verb"), ("ere", "u", "perf", "verb")], "of string, suffix string, stemtype string, kind string")
    assert {(r["stem"], r["stemtype"]) for r in M.derived_stems(stems, rules).collect()} == {("amav", "perf"), ("ama", "pres")}
    words = spark.createDataFrame([("amav",), ("amu",)], "word string")
    assert [(r["word"], r["derived"]) for r in M.derivation_splits(words, stems, rules).collect()] == [("amav", "perf")]
    df = spark.createDataFrame([("reg", "si"), ("am", "o")], "s string, e string")
    assert [r[0] for r in df.select(M.joined_sounds(F.col("s"), F.col("e"), [("g+s", "x")])).collect()] == ["rexi", "amo"]


def test_outputs(spark, tmp_path):
    lexicon = spark.createDataFrame(LEXICON, ENTRY)
    docs = spark.createDataFrame([(1, "Tela <viam\niam> zz")], "doc_id long, text string")
    tokens = mark_tokens(docs, lexicon)
    html = K.verse_html(tokens, spark.createDataFrame([(1, 1, "DS")], "doc_id long, verse_id long, feet string")).first()["html"]
    assert html == (
        '<div class="verse-line"><span class="verse-content"><span class="ambig word" data-word-index="0">Tēla</span> &lt;<span class="word" data-word-index="1">viam</span></span></div>'
        '<div class="verse-line"><span class="verse-content"><span class="word" data-word-index="2">iam</span>&gt; <span class="unknown word" data-word-index="3">zz</span></span><span class="verse-foot">DS</span></div>'
    )
    feet = scan_tokens(tokens, Options(scan="hexameter"))[1]
    restored = spark.createDataFrame([(1, "x", 4, 1, 1)], "doc_id long, text string, words long, unknown long, ambiguous long")
    assert len(K.metadata(restored, feet).first()["feet"]) == 2
    tags = spark.createDataFrame([("Tela", "n-s---fn-")], "form string, tag string")
    cands = spark.createDataFrame([("Tela", ["te_la", "te_la_"])], "form string, accented array<string>")
    details = {r["text"]: r for r in K.token_details(tokens, cands, tags).collect()}
    assert details["Tela"]["candidates"] == ["te_la", "te_la_"] and details["Tela"]["features"] and details["zz"]["candidates"] is None
    assert K.show_tokens(tokens, 3)[0].startswith("Tela")
    K.write_lexicon(lexicon, "tl_test_lexicon", 2)
    assert K.is_populated(spark, "tl_test_lexicon") and K.lexicon_size(spark, "tl_test_lexicon") == 4 and not K.is_populated(spark, "tl_none")
    spark.sql("DROP TABLE tl_test_lexicon")
    with pytest.raises(FileNotFoundError):
        R.read_lexicon(spark, str(tmp_path / "none.txt"))
    rows = spark.createDataFrame([("arma", "n", "arma", "arma"), ("roma", "n", "roma", "Ro_ma")], "word string, tag string, lemma string, accented string")
    assert [r["value"] for r in K.tagger_lines(rows).collect()] == ["arma\tn\tarma", "Roma\tn\troma"]
    K.write_texts(docs, str(tmp_path / "texts"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "texts")).collect()] == ["Tela <viam", "iam> zz"]


def test_readers_of_small_tables(spark):
    lines = spark.createDataFrame([("f", 0, "# no"), ("f", 1, "amo12 x"), ("f", 2, " lupus")], "path string, seq long, line string")
    assert [r["word"] for r in R.driver_words(lines).orderBy("seq").collect()] == ["amo", "lupus"]
    edges = spark.createDataFrame([("f", 0, "0\ta\t1"), ("f", 1, "1\tb\t2"), ("f", 2, "0\tc\t1")], "path string, seq long, line string")
    assert [r["ordered"] for r in R.transducer_edges(edges).orderBy("seq").collect()] == [True, True, False]
    rows = spark.createDataFrame([("/a/us.end", 0, "us o nom sg"), ("/a/other.end", 0, "@us"), ("/a/other.end", 1, "i o gen")], "path string, seq long, line string")
    assert {(r["table"], r["ending"], tuple(r["features"])) for r in R.ending_rows(rows).collect()} == {("us", "us", ("nom", "sg")), ("other", "us", ("nom", "sg")), ("other", "i", ("gen",))}
    assert {r["tag"] for r in R.open_classes(spark.createDataFrame([("N",), (" ",), ("V",)], "line string")).collect()} == {"N", "V"}
    one, two = (spark.createDataFrame([(p, 0, 0, "w", "t")], "path string, sentence_id long, pos long, word string, tag string") for p in "ab")
    assert R.with_supplement(one, two).count() == 2
    strict = spark.createDataFrame([(0, "a b c d"), (1, "a b c")], "seq long, line string")
    assert R.lexicon_rows(strict).count() == 1
    with pytest.raises(Exception, match="not four columns"):
        R.lexicon_rows(strict, True).collect()


def test_verified_forms_positions_and_dialects(spark):
    generated = spark.createDataFrame([("te_la",), ("via_",)], "form string")
    words = spark.createDataFrame([("tela",)], "word string")
    assert [(r["form"], r["word"]) for r in M.verified(generated, words).collect()] == [("te_la", "tela")]
    tokens = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, idx long, text string")
    tags = spark.createDataFrame([(1, 1, "X")], "doc_id long, idx long, tag string")
    assert [r["tag"] for r in L.positional_join(tokens, tags, ("doc_id", "idx")).orderBy("idx").collect()] == [None, "X"]
    a = spark.createDataFrame([("w", "N", 1.0)], "word string, tag string, prob double")
    b = spark.createDataFrame([("w", "N", 0.5), ("w", "V", 0.5)], "word string, tag string, prob double")
    assert {(r["tag"], r["prob"]) for r in L.merge_distributions(a, b, 3.0, 1.0).collect()} == {("N", 0.875), ("V", 0.125)}
    masks = spark.createDataFrame([(0,), (1,), (2,)], "d int")
    assert [r["d"] for r in M.dialect_mask(masks, "d", 2).collect()] == [0, 2]


def test_engine_remembers_texts(spark):
    told = []
    engine = Engine(spark, progress=lambda percent, message: told.append(percent))
    engine.load_lexicon(spark.createDataFrame(LEXICON, ENTRY))
    out = engine.mark(["tela", "tela", ""])
    assert out[0]["text"] == "tēla" and out[2] == {"text": "", "words": 0, "unknown": 0, "ambiguous": 0} and engine.cache_size == 2
    engine.mark(["tela"])
    assert engine.cache_size == 2 and told[-1] == 100
    engine.clear_cache()
    assert engine.cache_size == 0
    engine.close()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import textloom.__main__ as command
    import textloom.session as session

    monkeypatch.setattr(session, "local_session", lambda *a, **k: spark)
    (tmp_path / "lex.txt").write_text("tela n-s---fn- tela te_la\niam d-------- jam jam\n")
    assert command.main(["--listscans"]) == 0 and "0: prose" in capsys.readouterr().out
    lexicon = ["-l", str(tmp_path / "lex.txt")]
    assert command.main([*lexicon, "-j", "tela iam"]) == 0 and capsys.readouterr().out == "tēla jam"
    assert command.main([*lexicon, "--nomacrons", "tela"]) == 0 and capsys.readouterr().out == "tela"
    assert command.main([*lexicon, "--evaluate", "tēla"]) == 0 and capsys.readouterr().out == "Accuracy: 100.000000\n"
    (tmp_path / "in.txt").write_text("tela")
    assert command.main([*lexicon, "-i", str(tmp_path / "in.txt"), "-o", str(tmp_path / "out.txt"), "-s", "1"]) == 0
    assert (tmp_path / "out.txt").read_text() == "tēla"
    assert command.main(["tela"]) == 2 and command.main([*lexicon, "-s", "nothing", "tela"]) == 2


def cut_chunk(chunk, front, back, whole, before, behind):
    """The tokens of a chunk, one character after the other."""
    head, tail, done = [], [], False
    while not done:
        done = True
        if len(chunk) > 1 and chunk[0] in front:
            head, chunk, done = [*head, chunk[0]], chunk[1:], False
        if len(chunk) > 1 and chunk[-1] in back:
            tail, chunk, done = [chunk[-1], *tail], chunk[:-1], False
        if len(chunk) > 1 and chunk[-1] == "." and chunk[-2] in back:
            tail, done = [".", *tail], False
            chunk, tail = (chunk[:-2], [chunk[-2], *tail]) if len(chunk) > 2 else (chunk[:-1], tail)
    if chunk in whole or re.fullmatch(r"([A-Za-z-]\.)+", chunk):
        return [*head, chunk, *tail]
    if len(chunk) > 1 and chunk.endswith(".") and chunk != "..." and not re.fullmatch(r"[0-9]+\.", chunk):
        chunk, tail = chunk[:-1], [".", *tail]
        if chunk in whole:
            return [*head, chunk, *tail]
    while before and (m := re.match(f"({before})(?=.)", chunk)):
        head, chunk = [*head, m[1]], chunk[m.end() :]
    while behind and (m := re.search(f"(?<=.)({behind})$", chunk)):
        chunk, tail = chunk[: m.start()], [m[1], *tail]
    return [*head, chunk, *tail]


@pytest.mark.parametrize("language", [None, "en", "fr", "it"])
def test_chunks_of_markup_against_a_plain_loop(spark, language):
    rng = random.Random(8)
    front, back = "[{(`\"‚„†‡‹‘’“”•–—›", "]}'`\"),;:!?%‚„…†‡‰‹‘’“”•–—›"
    before, behind = T.FRONT_CLITICS.get(language, ""), T.BACK_CLITICS.get(language, "")
    pool = ["(", "[", '"', ")", ",", "!", ".", ".", "U", "S", "l'", "qu'", "dell'", "dog", "n't", "'s", "-t-il", "-ce", "etc", "7", "-", "“", "…", "%"]
    chunks = list({"".join(rng.choice(pool) for _ in range(rng.randrange(1, 7))) for _ in range(600)}) + ["...", "etc.", "U.S.", "14.", ")."]
    df = spark.createDataFrame([(c,) for c in chunks], "c string")
    got = {r["c"]: r["t"] for r in df.select("c", T.peel(F.col("c"), language, ("etc", "dog.")).alias("t")).collect()}
    assert got == {c: cut_chunk(c, front, back, ("etc", "dog."), before, behind) for c in chunks}


def test_markup_keeps_tags_whole(spark):
    pages = spark.createDataFrame([(1, '<a href="x y">Hi,there!Now...</a> 3,5 < 4')], "page_id long, html string")
    assert [r["text"] for r in T.tokenise_markup(pages).orderBy("idx").collect()] == ['<a href="x y">', "Hi", ",", "there", "!", "Now", "...", "</a>", "3,5", "<", "4"]


def test_prefixed_and_irregular_words(spark):
    stems = spark.createDataFrame([("duc", "verb3", "duco", "verb", []), ("lup", "o", "lupus", "noun", ["masc"])], "stem string, stemtype string, lemma string, kind string, keys array<string>")
    endings = spark.createDataFrame([("it", "verb3", "v3spia---", []), ("us", "o", "n-s---mn-", ["masc"]), ("um", "o", "n-s---nn-", ["neut"])], "ending string, stemtype string, tag string, features array<string>")
    irregular = spark.createDataFrame([("est", "sum", "v3spia---")], "form string, lemma string, tag string")
    none = irregular.limit(0)
    words = spark.createDataFrame([("deducit",), ("ducit",), ("abest",), ("lupus",), ("lupum",)], "word string")
    prefixes = spark.createDataFrame([("de",), ("ab",)], "prefix string")
    got = {(r["word"], r["lemma"], r["kind"]) for r in M.check_words(words, stems, endings, none, irregular, prefixes).collect()}
    assert got == {("deducit", "de-duco", "verb"), ("ducit", "duco", "verb"), ("abest", "ab-sum", "irregular"), ("lupus", "lupus", "noun")}


def test_rare_tags_are_pruned(spark):
    counts = spark.createDataFrame([("w", "a", 90), ("w", "b", 10), ("w", "c", 1), ("x", "a", 3), ("x", "b", 0), ("y", "a", 0), ("y", "b", 0)], "word string, tag string, n long")
    priors = spark.createDataFrame([("a", 0.6), ("b", 0.3), ("c", 0.1)], "tag string, prob double")
    got = {(r["word"], r["tag"]): round(r["prob"], 6) for r in S.tag_probabilities(counts, priors, 0.05).collect()}
    assert got == {("w", "a"): 0.9, ("w", "b"): 0.1, ("x", "a"): round((3 + 2 / 3) / 4, 6), ("x", "b"): round(1 / 3 / 4, 6), ("y", "a"): round(2 / 3, 6), ("y", "b"): round(1 / 3, 6)}
    assert len(S.tag_probabilities(counts, priors).collect()) == 7


def test_a_capital_at_the_start_of_a_sentence_says_nothing(spark):
    rows = [(0, "rosa", "n", "Rosa", "ro_sa"), (1, "rosa", "n", "rosa", "rosa_"), (2, "alia", "a", "alius", "alia")]
    lexicon = spark.createDataFrame(rows, ENTRY)
    docs = spark.createDataFrame([(1, "alia Rosa. Rosa alia a. Rosa")], "doc_id long, text string")
    frequency = spark.createDataFrame([("rosa", 9)], "lemma string, freq long")
    lemmas = Lemmas(frequency, spark.createDataFrame([], "wordform string, ord long, lemma string, freq long"))
    want = "alia Rōsa. Rosā alia a. Rōsa"
    assert restore_marks(docs, lexicon, lemmas=lemmas).first()["text"] == want
    tokens = mark_tokens(docs, lexicon, lemmas=lemmas).orderBy("idx", "sub_idx").collect()
    assert "".join(r["marked"] for r in tokens) == want
    starts = [r["starts"] for r in T.word_tails(docs).orderBy("idx").collect()]
    assert starts == [True, False, True, False, False, False]


def test_a_trained_tagger_chooses_by_context(spark):
    rows = []
    for k in range(40):
        words = [("haec", "p"), ("cana", "n.a")] if k % 2 else [("cum", "r"), ("cana", "n.b")]
        rows += [(k, i, w, f"{t}.{'.'.join('-' * 7)}" if "." in t else f"{t}.{'.'.join('-' * 8)}") for i, (w, t) in enumerate(words)]
    model = G.fit(spark.createDataFrame(rows, "key long, pos long, word string, tag string"), threshold=2.0)
    entries = [(0, "cana", "na-------", "cana", "cana"), (1, "cana", "nb-------", "cana", "cana_"), (2, "haec", "p--------", "hic", "haec"), (3, "cum", "r--------", "cum", "cum")]
    lexicon = spark.createDataFrame(entries, ENTRY)
    docs = spark.createDataFrame([(1, "haec cana. cum cana!"), (2, "cum cana")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in restore_marks(docs, lexicon, model=model).collect()}
    assert got == {1: "haec cana. cum canā!", 2: "cum canā"}
    engine = Engine(spark, model=model)
    engine.load_lexicon(lexicon)
    assert engine.mark(["cum cana"])[0]["text"] == "cum canā"
    engine.close()


def test_tools(spark, tmp_path, monkeypatch, capsys):
    import textloom.session as session
    from textloom import tools

    monkeypatch.setattr(session, "local_session", lambda *a, **k: spark)
    path = lambda name: str(tmp_path / name)
    (tmp_path / "corpus.txt").write_text("the\tDT\nold\tADJ\nman\tN\n\nthe\tDT\nman\tN\nsat\tV\n\n" * 8)
    (tmp_path / "in.txt").write_text("the\nman\nsat\n\nold\n")
    assert tools.main(["train", path("corpus.txt"), path("model"), "-c", "1", "-p", "1"]) == 0
    assert tools.main(["annotate", path("model"), path("in.txt"), path("out")]) == 0
    lines = [r["value"] for r in spark.read.text(path("out")).collect()]
    assert [x for x in lines if x] == ["the\tDT", "man\tN", "sat\tV", "old\tADJ"] and lines.count("") == 2
    assert tools.main(["print", path("model"), path("shown")]) == 0
    assert {r["value"].split("\t")[0] for r in spark.read.text(path("shown")).collect()} == {"lexicon", "guesser", "tree"}
    (tmp_path / "words.txt").write_text("# list\nlupus1\nlupa\n")
    (tmp_path / "stems.txt").write_text(":le:lupus\n:no:lup us_i\n")
    (tmp_path / "us_i.end").write_text("us us_i masc nom sg\n")
    assert tools.main(["analyse", path("words.txt"), path("stems.txt"), path("us_i.end"), path("analysed")]) == 0
    assert [r["value"] for r in spark.read.text(path("analysed")).collect()] == ["lupus\tlupus\tmasc nom sg\tno\tlup\tus"]
    assert "words: 2" in capsys.readouterr().err
