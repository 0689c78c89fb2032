"""Command line: annotate one diff document. ``python -m relomap.cli IN.xml [OUT.xml] [--results FILE] [-v]``."""

from __future__ import annotations

import sys

USAGE = "usage: relomap <diff.xml> [annotated.xml] [--results FILE] [-v|--verbose] [--help] [--version]"
VERSION = "relomap 0.1.0"
DEFAULT_OUTPUT = "diff_new.xml"


class UsageError(Exception):
    """The arguments ask for help or the version, or make no sense; the message goes to standard error."""


def parse_arguments(arguments: list[str]) -> tuple[str, str, str | None, bool]:
    """Input, output, results file or None, verbosity."""
    places: list[str] = []
    results, verbose, rest = None, False, iter(arguments)
    for a in rest:
        if a in ("-h", "--help"):
            raise UsageError(USAGE)
        if a == "--version":
            raise UsageError(VERSION)
        if a in ("-v", "--verbose"):
            verbose = True
        elif a == "--results":
            results = next(rest, None)
            if results is None:
                raise UsageError("--results needs a file\n" + USAGE)
        elif a.startswith("--results="):
            results = a.split("=", 1)[1]
        elif a.startswith("-") and a != "-":
            raise UsageError(f"unknown option {a}\n" + USAGE)
        else:
            places.append(a)
    if not 1 <= len(places) <= 2:
        raise UsageError(USAGE)
    return places[0], places[1] if len(places) == 2 else DEFAULT_OUTPUT, results, verbose


def main(arguments: list[str]) -> int:
    """0: done; 1: usage; 2: failure."""
    try:
        source, target, results, verbose = parse_arguments(arguments)
    except UsageError as e:
        print(e, file=sys.stderr)
        return 1
    from relomap.plans.moves import debug_report, detect_moves
    from relomap.session import local_session

    try:
        spark = local_session()
        with open(source, encoding="utf-8") as file:
            documents = spark.createDataFrame([(0, file.read())], "doc_id long, xml string")
        moves = detect_moves(documents, strict=True)
        with open(target, "w", encoding="utf-8") as file:
            file.write(moves.xml.first()["xml"])
        if results:
            with open(results, "w", encoding="utf-8") as file:
                file.write(moves.json.first()["json"] + "\n")
        if verbose:
            for name, table in debug_report(moves).items():
                print(f"=== {name} ===")
                table.show(50, truncate=80)
    except Exception as e:
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
