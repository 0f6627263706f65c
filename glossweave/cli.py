"""Command line: `python -m glossweave scan <dir>` (the default command) and `python -m glossweave vocab <dir>`."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from .operators.alignment import DEFAULT_MODEL, MODEL_FOR, Routing
from .operators.completeness import code_files
from .operators.consistency import Options
from .operators.definitions import StubProvider
from .plans.scan import FAIL_ON, failures, scan
from .plans.vocab import vocab
from .sources.locales import load_locale_dir, locale_code, read_lines, read_zipf
from .sources.reports import json_parts, render_text, render_vocab_text, write_report


USAGE = {
    "scan": """Usage: glossweave [scan] <folder> [options]

Reports duplicate, variant, near-duplicate, missing and unused strings of a folder of JSON translation files.

  --source <locale>          source locale (en)
  --format <text|json|both>  form of the report (text); both writes JSON to --out
  --out <file>               where the JSON report is written; any file system that Spark knows
  --src <folder>             code that uses the keys
  --dynamic-prefix <prefix>  beginning of keys that are put together at run time (may be repeated)
  --fuzzy-threshold <x>      least similarity of near-duplicates, over 0 and at most 1 (0.85)
  --fuzzy-max-len <n>        longest string that is looked at for them (200)
  --no-fuzzy                 no near-duplicates
  --allow-identical <file>   strings that may stay as they are, one a line
  --separator <text>         between the parts of nested keys (.)
  --top <n>                  groups a section of the text report shows (10)
  --fail-on <list>           end with 1 if any is found: missing,untranslated,duplicates,variants,fuzzy,unused
  -h, --help                 this text
""",
    "vocab": """Usage: glossweave vocab <folder> [options]

Finds recurring terms of the source locale and how consistently they are translated.

  --source <locale>          source locale (en)
  --locales <list>           only these target locales or languages
  --min-df <n>               least distinct source strings of a term (5)
  --max-n <n>                longest phrase in words (3)
  --seed <file>              terms that are always listed, one a line
  --model <name>             aligner model (bert-base-multilingual-cased)
  --model-for <lang=model>   model of one language (may be repeated; th=xlm-roberta-base)
  --zipf <csv>               general-English frequencies (term, zipf)
  --cache <folder>           alignment and definition cache
  --format <text|json|both>  form of the report (text); both writes JSON to --out
  --out <file>               where the JSON report is written
  --top <n>                  terms a section of the text report shows (20)
  --define                   draft definitions of the first glossary terms
  --provider <name>          who drafts them (stub)
  --define-model <id>        the provider's model
  --define-top <n>           terms to define (40)
  --domain <text>            one line about the product
  -h, --help                 this text
""",
}
GENERAL = """Usage: glossweave <command> [options]

  scan <folder>    duplicate, variant, missing and unused strings (what is done without a command)
  vocab <folder>   terms and how consistently they are translated

"""
PROVIDERS = {"stub": StubProvider}


class Usage(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise Usage(message)


def _parser(name: str) -> argparse.ArgumentParser:
    p = _Parser(prog="glossweave", add_help=False, allow_abbrev=False)
    p.add_argument("folder", nargs="*")
    p.add_argument("-h", "--help", action="store_true")
    p.add_argument("--source", default="en")
    p.add_argument("--format", default="text")
    p.add_argument("--out")
    p.add_argument("--top", default="10" if name == "scan" else "20")
    if name == "scan":
        p.add_argument("--src")
        p.add_argument("--dynamic-prefix", action="append", default=[])
        p.add_argument("--fuzzy-threshold", default="0.85")
        p.add_argument("--fuzzy-max-len", default="200")
        p.add_argument("--no-fuzzy", action="store_true")
        p.add_argument("--allow-identical")
        p.add_argument("--separator", default=".")
        p.add_argument("--fail-on", default="")
    else:
        p.add_argument("--locales", default="")
        p.add_argument("--min-df", default="5")
        p.add_argument("--max-n", default="3")
        p.add_argument("--seed")
        p.add_argument("--model", default=DEFAULT_MODEL)
        p.add_argument("--model-for", action="append", default=[])
        p.add_argument("--zipf")
        p.add_argument("--cache")
        p.add_argument("--define", action="store_true")
        p.add_argument("--define-top", default="40")
        p.add_argument("--define-model")
        p.add_argument("--domain", default="")
        p.add_argument("--provider", default="stub")
    return p


def _checked(name: str, args: argparse.Namespace) -> argparse.Namespace:
    """args with numbers for texts; all that is wrong at once otherwise."""
    wrong = []

    def number(option: str, kind: type, fits, says: str) -> None:
        field = option[2:].replace("-", "_")
        try:
            value = kind(getattr(args, field))
        except ValueError:
            value = None
        if value is None or not fits(value):
            wrong.append(f"{option} {says}")
        setattr(args, field, value)

    if len(args.folder) != 1:
        wrong.append("one folder is needed")
    if args.format not in ("text", "json", "both"):
        wrong.append("--format must be text, json or both")
    if args.format == "both" and not args.out:
        wrong.append("--format both requires --out")
    if name == "scan":
        args.fail = [x.strip() for x in args.fail_on.split(",") if x.strip()]
        number("--top", int, lambda x: x >= 0, "must be a whole number, 0 or more")
        number("--fuzzy-threshold", float, lambda x: 0 < x <= 1, "must be over 0 and at most 1")
        number("--fuzzy-max-len", float, lambda x: x > 0, "must be over 0")
        if unknown := [x for x in args.fail if x not in FAIL_ON]:
            wrong.append("--fail-on doesn't know " + ", ".join(unknown))
    else:
        for option in ("--top", "--min-df", "--max-n", "--define-top"):
            number(option, int, lambda x: x >= 1, "must be a whole number over 0")
        routes = dict(MODEL_FOR)
        for x in args.model_for:
            lang, _, model = x.partition("=")
            if lang and model:
                routes[lang] = model
            else:
                wrong.append(f'--model-for takes lang=model, not "{x}"')
        args.routing = Routing(args.model, tuple(routes.items()))
        if args.provider not in PROVIDERS:
            wrong.append("--provider must be one of " + ", ".join(PROVIDERS))
        if args.define and not args.domain:
            wrong.append("--define needs --domain")
    if wrong:
        raise Usage("\n".join(f"error: {x}" for x in wrong))
    args.folder = args.folder[0]
    args.source = locale_code(args.source) or args.source
    return args


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    """0; 1 if --fail-on found something; 2 for wrong options or data."""
    if argv[:1] and argv[0] in ("help", "-h", "--help"):
        sys.stdout.write(USAGE["vocab"] if argv[1:2] == ["vocab"] else GENERAL + USAGE["scan"])
        return 0
    name, rest = (argv[0], argv[1:]) if argv[:1] and argv[0] in USAGE else ("scan", argv)
    say = lambda text: print(text, file=sys.stderr)
    try:
        args = _parser(name).parse_args(rest)
        if args.help:
            sys.stdout.write(USAGE[name])
            return 0
        args = _checked(name, args)
    except Usage as e:
        say(f"{e}\n\n{USAGE[name]}")
        return 2
    try:
        spark = spark or SparkSession.builder.appName("glossweave").getOrCreate()
        found = load_locale_dir(spark, args.folder, args.separator if name == "scan" else ".")
        if name == "scan":
            allowed = read_lines(spark, args.allow_identical) if args.allow_identical else None
            code = code_files(spark, args.src) if args.src else None
            threshold = None if args.no_fuzzy else args.fuzzy_threshold
            result = scan(found, args.source, threshold, int(args.fuzzy_max_len), allowed, code, args.dynamic_prefix)
            text = render_text(result, args.top, threshold, not args.no_fuzzy)
        else:
            seeds = [r["value"] for r in read_lines(spark, args.seed).collect()] if args.seed else []
            only = [x.strip().lower().replace("_", "-") for x in args.locales.split(",") if x.strip()] or None
            zipf = read_zipf(spark, args.zipf) if args.zipf else None
            made = PROVIDERS[args.provider]
            provider = (lambda: made(args.define_model) if args.define_model else made()) if args.define else None
            options = Options(routing=args.routing)
            result = vocab(found, args.source, only, seeds, args.min_df, args.max_n, zipf, cache=args.cache, options=options, provider=provider, domain=args.domain, define_top=args.define_top, shown=args.top, progress=say)
            text = render_vocab_text(result, args.top)
    except (Usage, ValueError, RuntimeError, AnalysisException) as e:
        say(f"error: {e}")
        return 2
    if args.format != "json":
        sys.stdout.write(text)
    if args.format != "text":
        if args.out:
            write_report(spark, result, args.out)
            say(f"JSON report written to {args.out}")
        else:
            sys.stdout.writelines(json_parts(result))
    found_bad = failures(result, args.fail) if name == "scan" else []
    if found_bad:
        say("fail-on: " + ", ".join(found_bad))
    return int(bool(found_bad))
