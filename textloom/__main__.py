"""Command line (Y07, Y08): marks a text, or the standard input, and prints it; what was found goes to the standard error."""

from __future__ import annotations

import argparse
import sys
import time
import unicodedata

from textloom.operators.sequence import METER_CYCLES

EXAMPLE = "O orbis terrarum te saluto!\n"


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="textloom", description=__doc__)
    parser.add_argument("text", nargs="?", help="the text; else --infile or the standard input")
    source = parser.add_mutually_exclusive_group()
    source.add_argument("-i", "--infile")
    source.add_argument("--test", action="store_true", help="a short example")
    parser.add_argument("-o", "--outfile")
    parser.add_argument("-l", "--lexicon", help="a file of wordform, tag, lemma and accented form")
    parser.add_argument("--endings", help="a JSON file of endings by tag")
    parser.add_argument("--lemmas", help="a JSON file of lemma frequencies")
    parser.add_argument("--table", help="with --initialize: the lexicon table that is written; else that is read")
    parser.add_argument("--initialize", action="store_true", help="write the lexicon table anew")
    parser.add_argument("-v", "--utov", action="store_true")
    parser.add_argument("-j", "--itoj", action="store_true")
    parser.add_argument("-s", "--scan", default="0", help="a meter, by name or number")
    parser.add_argument("--listscans", action="store_true")
    marks = parser.add_mutually_exclusive_group()
    marks.add_argument("--nomacrons", action="store_true")
    marks.add_argument("--maius", action="store_true", help="mark vowels before j too")
    parser.add_argument("--evaluate", action="store_true", help="accuracy of the marks against those of the text")
    return parser.parse_args(given)


def meters() -> list[str]:
    return ["prose", *METER_CYCLES]


def main(given: list[str] | None = None) -> int:
    args = arguments(given)
    if args.listscans:
        print("\n".join(f"{k}: {name}" for k, name in enumerate(meters())))
        return 0
    from textloom.plans.pipeline import Engine, Lemmas, Options, evaluate
    from textloom.session import local_session
    from textloom.sources import readers as R
    from textloom.sources import sinks as K

    if not args.lexicon and not args.table:
        print("a lexicon is needed: --lexicon or --table", file=sys.stderr)
        return 2
    scan = meters()[int(args.scan)] if args.scan.isdigit() and int(args.scan) < len(meters()) else args.scan
    if scan not in meters():
        print(f"no such meter: {args.scan}", file=sys.stderr)
        return 2
    spark = local_session()
    lexicon = R.read_lexicon(spark, args.lexicon) if args.lexicon else spark.table(args.table)
    if args.initialize:
        K.write_lexicon(lexicon, args.table or "lexicon")
        return 0
    if args.test:
        text = EXAMPLE
    elif args.text is not None:
        text = args.text
    elif args.infile:
        with open(args.infile, encoding="utf-8") as f:
            text = f.read()
    else:
        text = sys.stdin.read()
    text = unicodedata.normalize("NFC", text)
    if not text.strip():
        return 0
    began = time.perf_counter()
    lemmas = Lemmas(*R.read_lemmas(spark, args.lemmas)) if args.lemmas else None
    engine = Engine(spark, R.read_endings(spark, args.endings) if args.endings else None, lemmas=lemmas, progress=lambda percent, message: print(f"  {percent}% {message}", file=sys.stderr))
    engine.load_lexicon(lexicon)
    options = Options(not args.nomacrons, args.maius, args.utov, args.itoj, None if scan == "prose" else scan)
    found = engine.mark([text], options)[0]
    if args.evaluate:
        pair = [spark.createDataFrame([(0, x)], "item_id long, text string") for x in (text, found["text"])]
        print(f"Accuracy: {100 * (evaluate(*pair).first()['accuracy'] or 0):f}")
    elif args.outfile:
        with open(args.outfile, "w", encoding="utf-8") as f:
            f.write(found["text"])
    else:
        sys.stdout.write(found["text"])
    print(f"{found['words']} words, {found['unknown']} unknown, {found['ambiguous']} ambiguous, {1000 * (time.perf_counter() - began):.0f} ms", file=sys.stderr)
    engine.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
