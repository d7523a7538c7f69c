"""Command line: analyses the project in the current directory."""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import Options, tables
from .errors import ArgumentError, RiskError, translated
from .functions.scores import duration
from .operators.report import exit_code, report_text, row_counts
from .sources import collector
from .sources.project import detect_package, is_workspace_member, source_dirs

VERSION, COMMAND = "0.1.0", "riskloom"
HELP = """\
riskloom - change-risk analysis of Rust functions

OPTIONS:
    -p, --package <SPEC>   Analyze only this package of a workspace
    --threshold <N>        Exit with 1 if any function's score is above N
    --top <N>              Consider only the N worst functions
    --exclude-path <PAT>   Leave out functions whose path contains PAT (repeatable)
    --exclude-fn <NAME>    Leave out a function by qualified name (repeatable)
    --features <F>         Features to activate (repeatable)
    --all-features         Activate all features
    --no-default-features  Leave out the default feature
    --allowance <LINT>     Leave out functions that allow this lint
    --label <TEXT>         What reports call the score
    --coverage <FILE>      Read this coverage export instead of running the tests
    -h, --help             Print help
    -V, --version          Print version
"""


def parse(args: list[str]) -> tuple[str, Options, str | None]:
    """('run', options, coverage file), 'help' or 'version'; an unknown option asks
    for help.  Called as a sub-command, the first word is the tool's own name."""
    o, export, i = Options(), None, 0
    args = args[1:] if args[:1] == [COMMAND] else args

    def value(flag: str) -> str:
        nonlocal i
        i += 1
        if i >= len(args):
            raise ArgumentError(f"{flag} needs a value behind it")
        return args[i]

    while i < len(args):
        a = args[i]
        if a == "--threshold":
            try:
                o.threshold = float(value(a))
            except ValueError:
                raise ArgumentError(f"--threshold takes a number, not {args[i]!r}") from None
        elif a == "--top":
            v = value(a)
            if not v.removeprefix("+").isdecimal():
                raise ArgumentError(f"--top takes a whole number, not {v!r}")
            o.top = int(v)
        elif a == "--exclude-path":
            o.exclude_paths.append(value(a))
        elif a == "--exclude-fn":
            o.exclude_fns.append(value(a))
        elif a in ("-p", "--package"):
            o.package = value(a)
        elif a == "--features":
            o.features.append(value(a))
        elif a == "--all-features":
            o.all_features = True
        elif a == "--no-default-features":
            o.no_default_features = True
        elif a == "--allowance":
            o.allowance = value(a)
        elif a == "--label":
            o.label = value(a)
        elif a == "--coverage":
            export = value(a)
        elif a in ("-h", "--help"):
            return "help", o, export
        elif a in ("-V", "--version"):
            return "version", o, export
        else:
            print(f"unknown option: {a}", file=sys.stderr)
            return "help", o, export
        i += 1
    return "run", o, export


def bold(on: bool):
    """Wraps a column in terminal codes, if they are wanted."""
    codes = {"warning": "1;33", "note": "1;36", "blue": "1;34", "white": "1;37"}
    return lambda kind, c: F.concat(F.lit(f"\x1b[{codes[kind]}m"), c, F.lit("\x1b[0m")) if on else c


def say(text: str) -> None:
    """Progress goes to standard error; the report alone to standard output."""
    print(text, file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    args = sys.argv[1:] if argv is None else argv
    try:
        action, o, export = parse(args)
        if action == "help":
            print(HELP, file=sys.stderr)
            return 0
        if action == "version":
            print(f"riskloom {VERSION}")
            return 0
        began, project = time.time(), os.path.realpath(os.getcwd())
        if o.package is None and is_workspace_member(project):
            o.package = detect_package(project)
        spark = SparkSession.builder.appName("riskloom").getOrCreate()
        features = {"package": o.package, "features": o.features, "all_features": o.all_features, "no_default_features": o.no_default_features}
        made = None
        if export is None:
            say("Running the tests with coverage")
            export = made = collector.collect(spark, project, **features)
        try:
            dirs = source_dirs(spark, collector.metadata(project, **features), project, o.package)
            say("Reading source and coverage")
            with translated():
                covered, functions, records = tables(spark, project, dirs, export, o)
                records = records.persist()
                n = row_counts(covered=covered, functions=functions, records=records).first()
                took = spark.range(1).select(duration(F.lit(time.time() - began)).alias("took")).first().took
                say(f"Read {n.covered} functions with coverage, {n.functions} in the source")
                say(f"Scored {n.records} functions in {took}")
                print(report_text(records, o.threshold, o.top, bold(sys.stderr.isatty()), o.label), end="")
                return exit_code(records, o.threshold)
        finally:
            if made:
                os.remove(made)
    except (RiskError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
