"""Operators on small inputs of our own."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import words as W
from textloom.operators import lexicon as L
from textloom.operators import morphology as M
from textloom.operators import sequence as Q
from textloom.operators import stats as S
from textloom.operators import tagger as G
from textloom.operators import tokens as T
from textloom.plans.pipeline import Engine, Options, evaluate
from textloom.sources import readers as R
from textloom.sources import sinks as K
from textloom.streaming import replay

ROWS = [(0, "tela", "n-s---fn-", "tela", "te_la"), (1, "tela", "n-s---fb-", "tela", "te_la_"), (2, "tela", "n-p---nn-", "telum", "te_la"), (3, "viam", "n-s---fa-", "via", "viam"), (4, "iam", "d--------", "jam", "jam")]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(ROWS, "seq long, wordform string, tag string, lemma string, accented string")


def one(spark, build, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("build", "values", "want"),
    [
        (W.to_ascii, ["Æneas cœlum ÿ"], "Aeneas coelum u"),
        (W.marks_to_unicode, ["te_la_ ä_"], "tēlā ā"),
        (W.unicode_to_marks, ["tēlā"], "te_la_"),
        (W.remove_marks, ["ĀēȲ"], "AeY"),
        (W.filter_accents, ["pa^_tris u_m"], "pa^tris um"),
        (W.clean_lemma, ["a b#1-^_"], "a+b"),
        (W.normalize_tag, ["n-s---fb-"], "n-s---fb-"),
        (W.tag_distance, ["n-s---fb-", "n-s---fn-"], 1),
        (W.tag_distance, ["n-s---fb-", "v-srppfb-"], 1),
        (W.tag_distance, ["ab", "cd"], None),
        (W.describe_tag, ["v3spia---"], "verb, 3rd person, singular, present, indicative, active"),
        (W.describe_tag, ["---------"], "unknown"),
        (W.also_maius, ["majaj"], "ma_jaj"),
        (W.also_maius, ["rejaj"], "rejaj"),
        (W.segments, ["quoque"], ["q", "o", "q", "e"]),
        (W.segments, ["hoc"], ["o", "cc"]),
        (W.segments, ["ae^r"], ["a", "e^", "r"]),
        (W.scansion_of, ["CVCCVC"], "LS"),
        (W.all_vowels_ambiguous, ["canam"], "ca_^nam"),
        (W.is_title, ["Roma"], True),
        (W.is_title, ["roma"], False),
        (W.strip_markers, ["[3] 12 arma"], "arma"),
        (W.vowel_spans, ["aemo"], [(0, 2), (3, 4)]),
        (T.peel, ['("Hi).'], ["(", '"', "Hi", ")", "."]),
    ],
)
def test_scalars(spark, build, values, want):
    got = one(spark, build, *values)
    assert ([tuple(x) if not isinstance(x, str) else x for x in got] if isinstance(got, list) else got) == want


def flags(spark, text):
    rows = T.sentence_flags(T.tokenise(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("idx").collect()
    return [(r["text"], r["ends_sentence"], r["starts_sentence"]) for r in rows]


def test_sentences(spark):
    got = flags(spark, "A. B. venit! Ita?")
    assert "".join(t for t, _, _ in got) == "A. B. venit! Ita?"
    assert [t for t, e, _ in got if e] == ["!", "?"]
    assert [t for t, _, s in got if s] == ["A", "Ita"]


def test_sentence_ends_against_the_sequential_rule(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice(["a", "bc", " ", ".", "!?", "\n", "7"]) for _ in range(30))) for i in range(40)]
    rows = T.sentence_flags(T.tokenise(spark.createDataFrame(texts, "doc_id long, text string"))).orderBy("doc_id", "idx").collect()
    for _, group in itertools.groupby(rows, lambda r: r["doc_id"]):
        length = 0
        for r in group:
            ends = False
            if r["is_word"]:
                length = len(r["text"])
            elif any(c in ".;:?!" for c in r["text"]):
                ends, length = length > 1, 0
            assert r["ends_sentence"] == ends


@pytest.mark.parametrize(
    ("text", "want"),
    [("lupusque", ["lupus", "que"]), ("neque", ["ne", "que"]), ("necnon", ["ne", "c", "non"]), ("viam", ["viam"]), ("Respublica", ["Res", "publica"]), ("que", ["que"]), ("necne", ["nec", "ne"])],
)
def test_clitics(spark, lexicon, text, want):
    df = T.split_clitics(T.tokenise(spark.createDataFrame([(1, text)], "doc_id long, text string")), lexicon)
    assert [r["text"] for r in df.orderBy("idx", "sub_idx").collect()] == want


def test_tagger_stream_puts_the_clitic_first(spark, lexicon):
    df = T.split_clitics(T.tokenise(spark.createDataFrame([(1, "ARMA lupusque viam")], "doc_id long, text string")), lexicon)
    assert [r["word"] for r in T.tagger_stream(df).orderBy("pos").collect()] == ["arma", "que", "lupus", "viam"]


def test_candidates(spark, lexicon):
    wanted = spark.createDataFrame([("tela", "n-s---fb-", "tela"), ("viam", "n-s---fa-", "via")], "form string, tag string, lemma string")
    got = {r["form"]: (r["accented"], r["is_ambiguous"]) for r in L.candidates(wanted, lexicon).collect()}
    assert got == {"tela": (["te_la_", "te_la"], True), "viam": (["viam"], False)}


@pytest.mark.parametrize(("plain", "accented", "options", "want"), [("Hi", "hi_", {}, "Hi_"), ("uia", "vi_a", {"utov": True}, "vi_a"), ("iam", "jam", {"itoj": True}, "jam"), ("iam", "jam", {}, "iam"), ("tela", "te_la_", {"lengths": False}, "tela"), ("xyz", "abc", {}, "xyz")])
def test_align(plain, accented, options, want):
    assert Q.align(plain, accented, **options) == want


def test_alignment_keeps_letters_and_costs_are_least():
    rng = random.Random(2)
    for _ in range(200):
        p, a = ("".join(rng.choice(s) for _ in range(rng.randint(0, 7))) for s in ("aeuv", "aeuv_"))
        assert Q.align(p, a).replace("_", "") == p
        n, m = len(p), len(a)
        best = {(0, 0): 0}
        for i in range(n + 1):
            for j in range(m + 1):
                steps = [best[(i - 1, j)] + 2] if i else []
                steps += [best[(i, j - 1)] + (0 if a[j - 1] == "_" else 2)] if j else []
                steps += [best[(i - 1, j - 1)] + Q._sub_cost(p[i - 1], a[j - 1])] if i and j else []
                best[(i, j)] = min(steps, default=0)
        assert Q.alignment_cost(p, a) == best[(n, m)]


def test_variants_and_segments():
    assert Q.variants("ba_^ce_^") == ["bace", "ba_ce", "bace_", "ba_ce_"]
    assert Q.segment("quoque") == ["q", "o", "q", "e"] and Q.segment("hoc") == ["o", "cc"]


def test_scan_a_hexameter(spark):
    line = "arma virumque cano_ tro_jae qui_ pri_mus ab o_ri_s".split()
    df = spark.createDataFrame([(1, 0, [[w] for w in line])], "doc_id long, verse_id long, words array<array<string>>")
    row = Q.scan_verses(df, ["hexameter"]).first()
    assert row["feet"] == "DDSSDS" and row["forms"] == line


def test_scan_verse_against_all_choices():
    rng = random.Random(3)
    meter = Q.METERS["pentameter"]
    for _ in range(200):
        words = [[(rng.randint(0, 3), "".join(rng.choice("LS") for _ in range(rng.randint(1, 4))), f"w{k}") for k in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 5))]
        best = None
        for picks in itertools.product(*[range(len(w)) for w in words]):
            state, cost, fits = 0, 0, True
            for k, (p, w) in enumerate(zip(picks, words, strict=True)):
                cost += w[p][0]
                for i, q in enumerate(w[p][1]):
                    if (state, q) not in meter:
                        fits = False
                        break
                    state, _, extra = meter[(state, q)]
                    cost += extra
                    if state == 0 and (i < len(w[p][1]) - 1 or k < len(words) - 1):
                        fits = False
                        break
                if not fits:
                    break
            if fits and cost < 100 and (best is None or (cost, picks) < best):
                best = (cost, picks)
        found = Q.scan_verse(words, meter)
        assert (found[2], tuple(found[1])) == (best if best else (None, ()))


def test_query_scans_long_verses(spark, tmp_path):
    from textloom.plans import registry

    long, endless = "da te me si tu re de ne po sa mi lo vi".split(), ["da"] * 1500
    text = "\n".join(map(" ".join, (long, endless, long)))
    spark.createDataFrame([(7, 1, "user", text)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["verse_id"]: r for r in registry.queries()["q07_scan_verses"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2} and got[1]["penalty"] is None
    meter = Q.METERS["hexameter"]
    every = [Q.scans([w + "_^"], Q.follow_class("".join(long[k + 1 :]))) for k, w in enumerate(long)]
    costs = []
    for picks in itertools.product(*every):
        state, cost, syllables = 0, sum(p for p, _, _ in picks), "".join(q for _, q, _ in picks)
        for i, q in enumerate(syllables):
            state, _, extra = meter.get((state, q), (None, "", 0))
            cost += extra
            if state is None or (state == 0 and i < len(syllables) - 1):
                break
        else:
            if cost < 100:
                costs.append(cost)
    assert costs and got[0]["penalty"] == got[2]["penalty"] == min(costs) and len(got[0]["forms"]) == len(long)


def test_parts_are_made_once_for_a_token(spark):
    text = "Nec necnon NECNON attamen arma virumque que aque neQUE Estne tuve ve st est plusquam seseque"
    lexicon = spark.createDataFrame([("virumque",), ("neque",), ("plusquam",)], "wordform string")
    df = T.split_clitics(T.tokenise(spark.createDataFrame([(1, text)], "doc_id long, text string")), lexicon)
    # Spark infers a filter on the number of parts from a plain explode, and would make the parts twice.
    assert "(size(" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["text"], r["kind"][0]) for r in df.orderBy("idx", "sub_idx").collect() if r["text"] != " "]
    joined = " ".join(f"{t}/{k}" for t, k in got)
    assert joined == "Ne/b c/c ne/b c/c non/w NE/b C/c NON/w at/w tamen/w arma/w virumque/w que/w a/b que/c ne/b QUE/c Est/b ne/c tu/b ve/c ve/w st/w e/b st/c plusquam/w sese/b que/c"


def test_query_of_tagger_stream_moves_documents_not_tokens(spark):
    from textloom.plans import registry

    plan = registry.queries()["p21_tagger_stream"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    window, cut = plan.index("Window"), plan.index("posexplode(regexp_extract_all")
    assert "Exchange hashpartitioning(doc_id" not in plan[window:cut] and "Exchange hashpartitioning(doc_id" in plan[cut:]


def test_query_of_best_lemmas_takes_the_first_of_equally_frequent_ones(spark, tmp_path):
    from textloom.plans import registry

    # Each pair of words has one form without diaeresis and two lemmas; the later of a pair comes first in the file.
    pairs = [(a + k, b + k) for k in "bcdfghklmnpr" for a, b in (("äa", "aa"), ("eo", "ëo"))]
    rows = [(2, 0, "user", " ".join(y for _, y in pairs)), (1, 0, "user", " ".join(x for x, _ in pairs))]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, rows[0][3])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["form"]: r["lemma"] for r in registry.queries()["j04_best_lemmas"](spark, str(tmp_path)).collect()}
    plain = str.maketrans("äë", "ae")
    assert got == {x.translate(plain): x[:3] for x, _ in pairs}


def test_viterbi_against_all_paths():
    rng = random.Random(4)
    tags = ["N.sg", "N.pl", "V"]
    priors = {"N.sg": 0.5, "N.pl": 0.2, "V": 0.2, G.BOUNDARY: 0.1}
    trees = {(f, k): [1, "N", rng.random(), [2, "V", rng.random(), rng.random()]] for f, k in [("N", 0), ("V", 0), (G.BOUNDARY, 0), ("N.sg(0)", 1), ("N.pl(0)", 1)]}
    for normalise in (False, True):
        search = G.Search(priors, trees, 2, beam=1e-30, normalise=normalise)
        for _ in range(20):
            words = [[(t, rng.random()) for t in tags] for _ in range(4)]

            def weight(path, words=words, search=search):
                state, p = (G.BOUNDARY, G.BOUNDARY), 1.0
                for options, t in zip([*words, [(G.BOUNDARY, 1.0)]], [*path, G.BOUNDARY], strict=True):
                    p *= dict(options)[t] / priors[t] * search.transition(t, state)
                    state = (t, state[0])
                return p

            assert weight(search.tags(words)) == pytest.approx(max(map(weight, itertools.product(tags, repeat=4))))
    assert search.tags([]) == []


def test_query_tagger_learns_from_all_turns_and_long_endings(spark, tmp_path, monkeypatch):
    from textloom.plans import registry

    turns = [(1, 0, "user", "tame dog"), (1, 1, "user", "abcdefghij dog")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    made = []
    fit = G.fit
    monkeypatch.setattr(G, "fit", lambda *args: made.append(fit(*args)) or made[0])
    assert registry.queries()["q09_viterbi"](spark, str(tmp_path)).count() == 4
    ends = {r["suffix"] for r in made[0].guesser.collect()}
    assert {r["word"] for r in made[0].lexicon.collect()} == {"tame", "abcdefghij", "dog"}
    assert "defghij" in ends and max(map(len, ends)) == 7


def tagged_corpus(spark):
    rng = random.Random(21)
    rows = []
    for k in range(60):
        tags = ["DT.sg" if rng.random() < 0.5 else "DT.pl"]
        for _ in range(rng.randrange(1, 4)):
            tags += [f"N.{tags[-1][-2:]}" if tags[-1] != "V" else "N.sg", "V"]
        rows += [(k, i, t.lower().replace(".", "") + str(rng.randrange(2)), t) for i, t in enumerate(tags)]
    return rows, spark.createDataFrame(rows, "key long, pos long, word string, tag string")


def test_trees_against_counts_and_alike_by_passes_over_the_table(spark, monkeypatch):
    rows, tagged = tagged_corpus(spark)
    items = G.context_items(tagged, 2)
    features = G.FeatureMap([r[3] for r in rows], 2)
    trees = G.grow_forest(items, features, 2.0)
    search = G.Search({}, trees, 2)
    # The number of a noun follows that of its determiner; a verb comes after every noun.
    assert search.transition("N.sg", ("DT.sg", G.BOUNDARY)) > 0.9 > 0.1 > search.transition("N.pl", ("DT.sg", G.BOUNDARY))
    assert search.transition("V", ("N.sg", "DT.sg")) > 0.9 > 0.1 > search.transition("V", ("DT.sg", G.BOUNDARY))
    # The first question has the greatest gain of all that may be asked.
    table = [tuple(r) for r in items.collect()]
    total = [sum(n for t, *_, n in table if (t == "V") == y) for y in (True, False)]
    gains = {}
    for f in features.names:
        inside = [sum(n for t, one, _, n in table if f in G.features_of(one) and (t == "V") == y) for y in (True, False)]
        gains[f] = G._entropy(*total) - G._entropy(*inside) - G._entropy(total[0] - inside[0], total[1] - inside[1])
    assert trees[("V", 0)][0] == 1 and gains[trees[("V", 0)][1]] == pytest.approx(max(gains.values()))
    monkeypatch.setattr(G, "MOST_LOCAL", 3)
    assert G.grow_forest(items, features, 2.0) == trees


def test_features_of_a_category_must_agree():
    with pytest.raises(ValueError):
        G.FeatureMap(["N.sg", "N"], 2)


def test_model_round_trip_and_unknown_words(spark, tmp_path):
    rows, tagged = tagged_corpus(spark)
    model = G.fit(tagged, context=2, threshold=2.0)
    model.save(str(tmp_path))
    model = G.Model.load(spark, str(tmp_path))
    tokens = spark.createDataFrame([(1, 0, "Dtsg0"), (1, 1, "xnsg0"), (1, 2, "v0"), (2, 0, "("), (2, 1, "dtpl1"), (2, 2, "some-npl1")], "key long, pos long, word string")
    got = {(r["key"], r["pos"]): r["tag"] for r in G.tag_tokens(tokens, model).collect()}
    assert len(got) == 6 and [got[(1, k)] for k in range(3)] == ["DT.sg", "N.sg", "V"] and (got[(2, 1)], got[(2, 2)]) == ("DT.pl", "N.pl")
    started = {r["pos"]: r["starts"] for r in G.sentence_starts(tokens).where("key = 2").collect()}
    assert started == {0: True, 1: True, 2: False}


def test_merged_distributions_weigh_by_frequency(spark):
    schema = f"word string, freq long, tags {G.TAGS}"
    lexicon = spark.createDataFrame([("Mark", 3, [("NE", 1.0)]), ("mark", 1, [("N", 0.5), ("V", 0.5)])], schema)
    guesser = spark.createDataFrame([("", [("X", 1.0)])], f"suffix string, tags {G.TAGS}")
    model = G.Model(lexicon, guesser, spark.createDataFrame([("X", 1.0)], "tag string, prob double"), None, 2)
    words = spark.createDataFrame([("Mark", True), ("Mark", False), ("zzz", True), ("Zzz", True)], "word string, starts boolean")
    got = {(r["word"], r["starts"]): [tuple(x) for x in r["tags"]] for r in G.emissions(words, model).collect()}
    assert got == {("Mark", True): [("N", 0.125), ("NE", 0.75), ("V", 0.125)], ("Mark", False): [("NE", 1.0)], ("zzz", True): [("X", 1.0)], ("Zzz", True): [("X", 1.0)]}


def test_morphology(spark):
    lines = spark.createDataFrame([("amandi", "verb amand,amo gerundive sg masc/neut gen"), ("felix", "adj fe_lix,felix sg nom")], "word string, line string")
    got = sorted((r["word"], r["t"]) for r in M.parse_lines(lines).select("word", M.parse_to_tag().alias("t")).collect())
    assert got == [("amandi", "v-s-dpng-".replace("dp", "d-")), ("amandi", "v-s-gpmg-"), ("amandi", "v-s-gpng-"), ("felix", "a-s---fn-"), ("felix", "a-s---mn-"), ("felix", "a-s---nn-")]
    tags = spark.createDataFrame([("x", "n-s---mg-"), ("x", "n-s---ng-")], "word string, tag string")
    assert [r["tag"] for r in M.gender_syncretism(tags).collect()] == ["n-s---og-"]
    stems = spark.createDataFrame([("lup", "us_i", "lupus", "noun")], "stem string, stemtype string, lemma string, kind string")
    endings = spark.createDataFrame([("us", "us_i", "n-s---mn-"), ("i", "us_i", "n-s---mg-")], "ending string, stemtype string, tag string")
    words = spark.createDataFrame([("lupus",), ("lupa",)], "word string")
    none = spark.createDataFrame([("iam", "jam", "d--------")], "form string, lemma string, tag string")
    assert [(r["word"], r["tag"]) for r in M.check_words(words, stems, endings, none).collect()] == [("lupus", "n-s---mn-")]
    assert {r["form"] for r in M.paradigm(stems, endings).collect()} == {"lupus", "lupi"}
    found = M.preverbs(spark.createDataFrame([("deabduco",)], "word string"), spark.createDataFrame([("de",), ("ab",)], "prefix string")).collect()
    assert {(r["taken"], r["rest"]) for r in found} == {("de", "abduco"), ("de-ab", "duco")}


def test_sources_and_sinks(spark, tmp_path, lexicon):
    (tmp_path / "lex.txt").write_text("# comment\n\ntela n-s---fn- tela te_la\nviam  n-s---fa-\tvia viam extra\nshort line\n")
    assert [r["accented"] for r in R.read_lexicon(spark, str(tmp_path / "lex.txt")).orderBy("seq").collect()] == ["te_la", "viam"]
    (tmp_path / "tagged.txt").write_text("arma\tn\tarma\nvirum\tn\tvir\n\n\ncano\tv\tcano\n")
    got = [(r["sentence_id"], r["pos"], r["word"]) for r in R.read_tagged(spark, str(tmp_path / "tagged.txt")).collect()]
    assert sorted(got) == [(0, 0, "arma"), (0, 1, "virum"), (1, 0, "cano")]
    (tmp_path / "lemmas.json").write_text(json.dumps({"lemmaFrequency": {"via": 3}, "corpus": {"viam": [["via", 2], ["vis", 1]]}}))
    freq, corpus = R.read_lemmas(spark, str(tmp_path / "lemmas.json"))
    assert freq.collect()[0]["freq"] == 3 and corpus.count() == 2
    (tmp_path / "endings.json").write_text(json.dumps({"t": ["i_s", "a"]}))
    assert [(r["priority"], r["plain_ending"]) for r in R.read_endings(spark, str(tmp_path / "endings.json")).orderBy("priority").collect()] == [(0, "is"), (1, "a")]
    (tmp_path / "stems.txt").write_text(":le:lupus\n:no:lup us_i masc\n:le:amo\n:vs:am are_vb\n")
    assert [(r["lemma"], r["stem"]) for r in R.stem_rows(R.lines(spark, str(tmp_path / "stems.txt"))).collect()] == [("lupus", "lup"), ("amo", "am")]
    (tmp_path / "bank.xml").write_text('<t><sentence id="1"><word id="1" form="arma" lemma="arma" postag="n"/><word id="2" form="-que" lemma="que" postag="c"/><word id="3" form="viros" lemma="vir" postag="n"/></sentence></t>')
    assert [r["form"] for r in R.treebank_words(spark, str(tmp_path / "bank.xml")).orderBy("pos").collect()] == ["arma", "virosque"]
    (tmp_path / "text.txt").write_text("  ét  ")
    assert R.read_texts(spark, str(tmp_path / "text.txt")).first()["text"] == "ét"
    K.write_piped(lexicon, str(tmp_path / "out"), 2)
    assert spark.read.csv(str(tmp_path / "out"), sep="|").count() == 2
    K.write_model({"lexicon": lexicon}, str(tmp_path / "model"))
    assert K.read_model(spark, str(tmp_path / "model"), ["lexicon"])["lexicon"].count() == 5
    assert K.new_entries(lexicon.unionByName(lexicon), lexicon.where("seq < 3")).count() == 2
    tokens = T.tokenise(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert K.token_json(tokens, ["text"]).first()["tokens"] == '[{"text":"a"},{"text":" "},{"text":"b"}]'


def test_streams_give_the_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i % 5} tela") for i in range(40)], "doc_id long, text string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    out = replay.run_over_files(spark, str(tmp_path / "in"), df.schema.simpleString()[7:-1].replace(":", " "), T.tokenise, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, T.tokenise(df).collect()))
    words = df.select(F.split("text", " ")[0].alias("wordform"))
    words.repartition(4).write.parquet(str(tmp_path / "w"))
    grown = replay.grow_lexicon(spark, str(tmp_path / "w"), "wordform string", lambda x: x.withColumn("lemma", F.lit("l")), str(tmp_path / "lex"), str(tmp_path / "cp2"))
    assert sorted(r["wordform"] for r in grown.collect()) == [f"word{i}" for i in range(5)]
    assert replay.distinct_requests(df.select(F.substring("text", 1, 5).alias("text"), F.lit(1).alias("o")), ["o"]).count() == 5


def test_engine(spark, lexicon):
    engine = Engine(spark)
    docs = spark.createDataFrame([(1, "Tela viam, iam telaque xyz!"), (2, "")], "doc_id long, text string")
    with pytest.raises(ValueError):
        engine.process(docs)
    engine.load_lexicon(lexicon)
    got = engine.process(docs).collect()
    assert [(r["text"], r["words"], r["unknown"]) for r in got] == [("Tēla viam, iam tēlaque xyz!", 6, 2)]
    assert "jam" in engine.process(docs, Options(itoj=True)).first()["text"]
    engine.close()
    assert not engine.is_ready
    gold = spark.createDataFrame([(1, "tēla")], "item_id long, text string")
    assert evaluate(gold, spark.createDataFrame([(1, "tela")], "item_id long, text string")).first()["accuracy"] == 0.5


def by_enumeration(accented, follow):
    """Readings of a word by trying every variant, each by itself."""
    found = {}
    for nth, form in enumerate(v for a in accented for v in Q.variants(a)):
        for penalty, quantities, text in Q.scans([form.replace("_^", "")], follow):
            row = (penalty + (nth > 0), text)
            found[quantities] = min(found.get(quantities, row), row)
    return sorted((p, q, f) for q, (p, f) in found.items())


def test_scans_choose_uncertain_vowels_as_by_trying_all():
    rng = random.Random(11)
    for _ in range(400):
        forms = ["".join(rng.choice(["a", "e", "i", "u", "ae", "o_", "a_^", "e_^", "u_^", "i_^", "qu", "tr", "s", "m", "j", "x", "h", "n"]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 2))]
        for follow in ("V", "C", "CC", "#"):
            assert Q.scans(forms, follow) == by_enumeration(forms, follow), (forms, follow)
    assert Q.scans(["ho_^c"], "V") == by_enumeration(["ho_^c"], "V") and Q.scans(["hoc"], "V")[0][1] == "L"


def test_scans_of_known_words():
    assert Q.scans(["multum"], "V") == [(0, "L", "multum"), (3, "LL", "multum")]
    assert Q.scans(["patris"], "C") == [(0, "SL", "patris"), (1, "LL", "patris")]
    assert Q.scans(["rosae"], "#") == [(0, "SL", "rosae"), (2, "SSS", "rosae")]
    assert Q.scans(["arma"], "V")[0] == (0, "L", "arma")


@pytest.mark.parametrize("name", ["hexameter", "pentameter", "hendecasyllable", "trimeter", "dimeter"])
def test_lines_scan_as_by_all_readings(name):
    rng, meter, met = random.Random(5), Q.METERS[name], 0
    pool = ["da_^", "te", "me_^", "si_^t", "tu_", "re_^be_^", "de_^nt", "no_^", "po_^tu_^", "san", "lae", "mi_^hi_^", "et", "tra_^"]
    for _ in range(150):
        words = [[rng.choice(pool)] for _ in range(rng.randint(4, 9))]
        follows = [Q.follow_class(" ".join(x[0] for x in words[k + 1 :])) for k in range(len(words))]
        every = [Q.scans(w, f) for w, f in zip(words, follows, strict=True)]
        feet, picks, penalty = Q.scan_verse(every, meter)
        got = Q.scan_line(words, meter)
        assert got == (feet, [r[p][2] for r, p in zip(every, picks, strict=False)], penalty)
        met += penalty is not None
    assert met


def test_a_long_word_of_uncertain_vowels_is_read_fast():
    feet, forms, penalty = Q.scan_line([["na_^" * 60], ["te_^"]], Q.METERS["hexameter"])
    assert (feet, forms, penalty) == ("", [], None)
    assert Q.scan_line([["na_^" * 13 + "nt"]], Q.METERS["hexameter"])[2] is not None


def test_feet_of_iambic_lines():
    def line(quantities, name):
        return Q.scan_verse([[(0, quantities, "w")]], Q.METERS[name])[::2]

    assert line("SLSLSLSLSLSL", "trimeter") == ("u-|u-|u-|u-|u-|u-", 0)
    assert line("LLSLLLSLLLSS", "trimeter") == ("--|u-|--|u-|--|uu", 0)
    assert line("LSSSSSSSLSLSSSSL", "trimeter") == ("-uu|uuu|uu-|u-|uuu|u-", 1)
    assert line("SLSLSLSL", "dimeter") == ("u-|u-|u-|u-", 0)
    assert line("SLLL", "trimeter") == ("", None)
    assert line("LLLLLLSSLSSS"[:0] + "LLLLLLSSLSSS", "pentameter") == ("SS-DD-", 0)


def test_following_segment():
    assert [Q.follow_class(x) for x in ("", None, "ab", "hic", "qui_", "tra_", "sta", "xe", "s", " ruit")] == ["#", "#", "V", "V", "C", "C", "CC", "CC", "CC", "C"]


def test_variants_in_the_engine(spark):
    forms = ["ba_^ce_^", "nescio_", "plain", "a_^b_^c_^"]
    df = spark.createDataFrame([(x,) for x in forms], "f string")
    assert {r["f"]: r["v"] for r in df.select("f", Q.variants_column(F.col("f")).alias("v")).collect()} == {x: Q.variants(x) for x in forms}


def test_piped_rows_of_both_layouts(spark):
    rows = [(0, "# note"), (1, "tela\tn-s\tte_la\ttelum"), (2, "via\tn-s\tvi^a"), (3, "iam|jam|jam|d--"), (4, "et|et|et"), (5, "too few")]
    got = {r["seq"]: tuple(r)[1:] for r in R.piped_rows(spark.createDataFrame(rows, "seq long, line string")).collect()}
    assert got == {1: ("tela", "n-s", "telum", "te_la"), 2: ("via", "n-s", "via", "vi^a"), 3: ("iam", "d--", "jam", "jam"), 4: ("et", "---------", "et", "et")}


def test_long_words_are_not_cut(spark):
    word = "i" + "a" * 150
    got = spark.createDataFrame([(word,)], "w string").select(M.retries(F.col("w")).alias("r")).first()["r"]
    assert "j" + word[1:] in got
    words = spark.createDataFrame([("deabdeabdenter",)], "word string")
    out = M.preverbs(words, spark.createDataFrame([("de",), ("ab",)], "prefix string")).collect()
    assert {r["taken"] for r in out} == {"de", "de-ab", "de-ab-de", "de-ab-de-ab", "de-ab-de-ab-de"}


def test_words_are_joined_alike_whatever_the_size_of_the_table(spark, lexicon, monkeypatch):
    docs = spark.createDataFrame([(1, "Telaque, que viamne; neque 12 iam!\n atque"), (2, ""), (3, " .. ")], "doc_id long, text string")
    tokens = T.tokenise(docs)
    small = sorted(map(tuple, T.split_clitics(tokens, lexicon).collect()))
    cover = sorted(map(tuple, S.coverage(tokens, lexicon, F.lit(False)).collect()))
    monkeypatch.setattr(T, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, T.split_clitics(tokens, lexicon).collect())) == small
    assert sorted(map(tuple, S.coverage(tokens, lexicon, F.lit(False)).collect())) == cover
    tails = T.word_tails(docs)
    assert {r["doc_id"]: "".join(x["text"] + x["tail"] for x in sorted(tails.where(F.col("doc_id") == r["doc_id"]).collect(), key=lambda x: x["idx"])) for r in docs.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_flow_scans_verses_and_strips_marks(spark):
    rows = [(0, "arma", "n", "arma", "arma"), (1, "virum", "n", "vir", "virum"), (2, "virum", "n", "virus", "vi_rum"), (3, "cano", "v", "cano", "cano_"), (4, "troiae", "n", "troia", "tro_jae"), (5, "qui", "p", "qui", "qui_"), (6, "primus", "a", "primus", "pri_mus"), (7, "ab", "r", "ab", "ab"), (8, "oris", "n", "ora", "o_ri_s")]
    words = spark.createDataFrame(rows, "seq long, wordform string, tag string, lemma string, accented string")
    docs = spark.createDataFrame([(1, "\nArmā virumque cano, Troiae qui primus ab oris\n\nnihil\n")], "doc_id long, text string")
    from textloom.plans.pipeline import mark_tokens, restore_marks, scan_tokens

    plain = restore_marks(docs, words).first()["text"]
    assert plain.startswith("\nArma v") and "canō" in plain
    scanned = restore_marks(docs, words, options=Options(scan="hexameter")).first()
    assert scanned["text"] == "\nArma virumque canō, Trōiae quī prīmus ab ōrīs\n\nnīhīl\n"
    assert (scanned["words"], scanned["unknown"]) == (10, 2)
    feet = scan_tokens(mark_tokens(docs, words), Options(scan="hexameter"))[1].orderBy("verse_id").collect()
    assert [r["feet"] for r in feet] == ["", "DDSSDS", "", "S", ""]  # the last line has begun and ends early


def test_lemmas_choose_among_entries(spark):
    rows = [(0, "tela", "---------", "tela", "te_la"), (1, "tela", "---------", "telum", "te_la_")]
    words = spark.createDataFrame(rows, "seq long, wordform string, tag string, lemma string, accented string")
    docs = spark.createDataFrame([(1, "tela")], "doc_id long, text string")
    from textloom.plans.pipeline import Lemmas, restore_marks

    def marked(lemma):
        frequency = spark.createDataFrame([(lemma, 9)], "lemma string, freq long")
        corpus = spark.createDataFrame([], "wordform string, ord long, lemma string, freq long")
        return restore_marks(docs, words, lemmas=Lemmas(frequency, corpus)).first()["text"]

    assert marked("tela") == "tēla" and marked("telum") == "tēlā"


def test_search_reads_words_in_bounded_batches(spark, monkeypatch):
    rng = random.Random(5)
    trees = [(f, k, json.dumps([1, "N", rng.random(), rng.random()])) for f, k in [("N", 0), ("V", 0), (G.BOUNDARY, 0)]]
    priors = {"N": 0.5, "V": 0.4, G.BOUNDARY: 0.1}
    listed = {f"w{k}": [("N", p), ("V", 1 - p)] for k, p in enumerate(rng.random() for _ in range(9))}
    kinds = "array<struct<tag:string,prob:double>>"
    model = G.Model(
        spark.createDataFrame([(w, 3, t) for w, t in listed.items()], f"word string, freq long, tags {kinds}"),
        spark.createDataFrame([("z", [("V", 1.0)])], f"suffix string, tags {kinds}"),
        spark.createDataFrame(list(priors.items()), "tag string, prob double"),
        spark.createDataFrame(trees, "feature string, level int, tree string"),
        2,
    )
    rows = [(k, i, rng.choice(["xyz", "unlisted", *listed])) for k in range(70) for i in range(1 + k % 7)] + [(99, i, rng.choice(list(listed))) for i in range(300)]
    monkeypatch.setattr(G, "MOST_HELD", 20)
    monkeypatch.setattr(G, "MOST_OPTIONS", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        df = G.tag_tokens(spark.createDataFrame(rows, "key long, pos long, word string").repartition(3), model)
        got = sorted(map(tuple, df.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # A sentence as one value with all its words' tags made batches of any size.
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    search = G.Search(priors, {(f, k): json.loads(t) for f, k, t in trees}, 2)
    want = []
    for key in sorted({r[0] for r in rows}):
        words = [r[2] for r in rows if r[0] == key]
        tags = search.tags([listed.get(w, [("V", 1.0)] if w == "xyz" else sorted(priors.items())) for w in words])
        want += [(key, i, w, t) for i, (w, t) in enumerate(zip(words, tags, strict=True))]
    assert got == want
