"""Command line: lines of text in, JSON out."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import DEFAULT_SYMBOLS, ParserConfig
from .functions.regexes import compile_patterns
from .plans.parser import LogParser
from .sources.text import document, read_lines_local, write_document


def _switch(text: str) -> bool:
    if text.lower() in ("1", "t", "true"):
        return True
    if text.lower() in ("0", "f", "false"):
        return False
    raise argparse.ArgumentTypeError(f"not true or false: {text}")


def arguments() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="loomline", description="Mines templates from lines of text.", allow_abbrev=False)
    a.add_argument("-input", "--input", default="-", help="a file, or - for standard input")
    a.add_argument("-output", "--output", default="-", help="a file, or - for standard output")
    a.add_argument("-threshold", "--threshold", type=float, default=0.5)
    a.add_argument("-pattern-sample", "--pattern-sample", type=float, default=1.0)
    a.add_argument("-symbols", "--symbols", default=DEFAULT_SYMBOLS)
    for name, on in (("alphabetic", True), ("numeric", False), ("impure", False)):
        a.add_argument(f"-filter-{name}", f"--filter-{name}", type=_switch, nargs="?", const=True, default=on)
    a.add_argument("-templates", "--templates", action="store_true")
    a.add_argument("-masks", "--masks", action="store_true")
    a.add_argument("-special-white", "--special-white", action="append", default=[])
    a.add_argument("-special-black", "--special-black", action="append", default=[])
    return a


def run(args: list[str], stdin=None, stdout=None, spark: SparkSession | None = None) -> None:
    """Raises ValueError for options and patterns that can't be used."""
    o = arguments().parse_args(args)
    compile_patterns([*o.special_white, *o.special_black])
    config = ParserConfig(o.threshold, o.pattern_sample, o.symbols, o.special_white, o.special_black, o.filter_alphabetic, o.filter_numeric, o.filter_impure)
    spark = spark or SparkSession.builder.appName("loomline").config("spark.ui.enabled", "false").getOrCreate()
    parsed = LogParser(config).parse(read_lines_local(spark, o.input, stdin))
    write_document(document(parsed, o.templates, o.masks), o.output, stdout)


if __name__ == "__main__":
    try:
        run(sys.argv[1:])
    except (ValueError, OSError) as error:
        sys.exit(f"loomline: {error}")
