"""Command line of the tagger and the analyser (Y09, Y10): train, annotate, print, analyse. Files are read and written by Spark.

A corpus has a word, its tag and its lemma by tabs on each line; a file to annotate has a word on each; blank lines end
sentences in both.
"""

from __future__ import annotations

import argparse
import sys


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="textloom.tools", description=__doc__)
    command = parser.add_subparsers(dest="command", required=True)
    train = command.add_parser("train")
    train.add_argument("corpus")
    train.add_argument("model")
    train.add_argument("-c", "--context", type=int, default=2, help="tags before that are looked at")
    train.add_argument("-p", "--threshold", type=float, default=6.0, help="the gain that a question must have")
    train.add_argument("-s", "--smoothing", type=float, default=1.0)
    train.add_argument("-l", "--listed", help="a file of further words and their tags")
    annotate = command.add_parser("annotate")
    annotate.add_argument("model")
    annotate.add_argument("infile")
    annotate.add_argument("outfile")
    annotate.add_argument("-b", "--beam", type=float, default=1e-3)
    annotate.add_argument("-n", "--normalise", action="store_true")
    shown = command.add_parser("print")
    shown.add_argument("model")
    shown.add_argument("outfile")
    analyse = command.add_parser("analyse")
    analyse.add_argument("words", help="a word on each line; # begins a comment")
    analyse.add_argument("stems")
    analyse.add_argument("endings")
    analyse.add_argument("outfile")
    analyse.add_argument("--prefixes", help="a prefix on each line")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> int:
    args = arguments(given)
    from pyspark.sql import functions as F

    from textloom.operators import morphology as M
    from textloom.operators import stats as S
    from textloom.operators import tagger as G
    from textloom.session import local_session
    from textloom.sources import readers as R
    from textloom.sources import sinks as K

    spark = local_session()
    sentence = F.struct("path", "sentence_id").alias("key")
    if args.command == "train":
        tagged = R.read_tagged(spark, R.required(spark, args.corpus)).select(sentence, "pos", "word", "tag")
        listed = R.read_tagged(spark, args.listed).select("word", "tag").distinct() if args.listed else None
        G.fit(tagged, args.context, args.threshold, args.smoothing, listed).save(args.model)
    elif args.command == "annotate":
        tokens = R.read_tagged(spark, R.required(spark, args.infile)).select(sentence, "pos", "word")
        found = G.tag_tokens(tokens, G.Model.load(spark, args.model), args.beam, args.normalise)
        line = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("\t", "word", "tag").alias("line"))))
        # A blank line behind each sentence.
        lines = found.groupBy("key").agg(F.concat(F.array_join(F.transform(line, lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))
        lines.orderBy("key").select("value").write.mode("overwrite").text(args.outfile)
    elif args.command == "print":
        model = G.Model.load(spark, args.model)
        K.model_lines(model.lexicon, model.guesser, model.trees).select(F.concat_ws("\t", "part", "line").alias("value")).write.mode("overwrite").text(args.outfile)
    else:
        words = R.driver_words(R.lines(spark, R.required(spark, args.words))).select("word").distinct()
        stems = R.stem_rows(R.lines(spark, args.stems)).select("stem", F.get("keys", F.lit(0)).alias("stemtype"), "lemma", "kind")
        endings = R.ending_rows(R.lines(spark, args.endings)).select("ending", "stemtype", F.concat_ws(" ", "features").alias("tag"))
        prefixes = spark.read.text(args.prefixes).select(F.trim("value").alias("prefix")) if args.prefixes else None
        none = spark.createDataFrame([], "form string, lemma string, tag string")
        found = M.check_words(words, stems, endings, none, None, prefixes)
        found.select(F.concat_ws("\t", "word", "lemma", "tag", "kind", "stem", "ending").alias("value")).write.mode("overwrite").text(args.outfile)
        counted = S.run_counters(words, found.select("word", "lemma")).first().asDict()
        print("\n".join(f"{k}: {v}" for k, v in counted.items()), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
