"""``python -m telltale FILE...``: scores files as ``telltale.operators.files`` does, and prints what it finds.

Exit status: 0 if all files are under the threshold, 1 if any isn't, 2 if one can't be read or nothing matches.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.functions.lexicon import packs
from telltale.operators import files
from telltale.sources import readers

IGNORE_NAME = ".telltaleignore"


class Unusable(Exception):
    """What makes the exit status 2."""


def arguments(argv: list[str] | None) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="telltale", description=__doc__.split("\n\n")[0])
    ap.add_argument("paths", nargs="*", default=["-"], metavar="PATH", help="files or globs, in any store that Spark reads; - is the standard input")
    form = ap.add_mutually_exclusive_group()
    form.add_argument("--json", action="store_true", help="records as JSON")
    form.add_argument("--rdjson", action="store_true", help="a line of JSON for each finding")
    form.add_argument("--quiet", action="store_true", help="one line for each file")
    ap.add_argument("--markdown", action="store_true", help="leave out code in all files; in .md files it always is")
    mode = ap.add_mutually_exclusive_group()
    mode.add_argument("--code", action="store_true", help="score as source code whatever the extension")
    mode.add_argument("--prose", action="store_true", help="score as prose whatever the extension")
    ap.add_argument("--threshold", type=float, default=10.0, help="score from which on the exit status is 1")
    ap.add_argument("--lang", default="auto", choices=["auto", *sorted(packs())])
    ap.add_argument("--config", help="configuration file; else the nearest one upwards")
    ap.add_argument("--no-config", action="store_true")
    ap.add_argument("--exclude", action="append", default=[], metavar="GLOB")
    return ap.parse_args(argv)


def configuration(args: argparse.Namespace) -> dict | None:
    if args.no_config:
        return None
    place = args.config or readers.find_config(os.getcwd())
    if not place:
        return None
    try:
        with open(place, encoding="utf-8") as file:
            return readers.load_config(file.read())
    except (OSError, ValueError) as error:
        raise Unusable(f"{place}: {error}") from error


def inputs(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """``path, text, ext`` of everything asked for."""
    ignored = list(args.exclude)
    if os.path.isfile(IGNORE_NAME):
        with open(IGNORE_NAME, encoding="utf-8") as file:
            ignored += readers.ignore_lines(file.read())
    found: list[str] = []
    for path in args.paths:
        if path != "-":
            here = readers.matching(spark, path)
            if not here:
                raise Unusable(f"{path}: " + ("no files match" if any(c in path for c in "*?[") else "no such file"))
            found += here
    parts = [readers.read_texts(spark, found, args.markdown, ignored)] if found else []
    if "-" in args.paths:
        parts.append(readers.from_text(spark, sys.stdin.read()))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("telltale").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    mode = "code" if args.code else "prose" if args.prose else "auto"
    try:
        config, given = configuration(args), inputs(spark, args).cache()
    except Unusable as error:
        print(f"telltale: {error}", file=sys.stderr)
        return 2
    scored = files.score_files(given, mode=mode, lang=args.lang, config=config).orderBy("path").cache()
    try:
        if args.rdjson:
            for row in files.file_diagnostics(given, mode=mode, lang=args.lang, config=config).toLocalIterator():
                print(row.value)
        elif args.json:
            records = [json.loads(row.record) for row in scored.toLocalIterator()]
            print(json.dumps(records[0] if len(records) == 1 else records, indent=2, ensure_ascii=False))
        else:
            told = files.file_reports(given, mode, args.lang, config, args.quiet).orderBy("path").toLocalIterator()
            several = scored.count() > 1
            for row in told:
                print(f"{row.path}: {row.report}" if several and args.quiet else f"== {row.path} ==\n{row.report}\n" if several else row.report)
        return int(scored.agg(F.coalesce(F.max((F.col("score") >= args.threshold).cast("int")), F.lit(0))).first()[0])
    finally:
        given.unpersist()
        scored.unpersist()


if __name__ == "__main__":
    sys.exit(main())
