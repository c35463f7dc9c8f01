"""``python -m loomgraph.cli [path] [--cli | --compact | --languages | --tool NAME ARG...]``: reports of a project, or without any of
these a tool server on standard input and output; the first plain argument is the project's root, else the current folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import render, server
from .engine import Engine


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    parser.add_argument("root", nargs="?", default=".")
    parser.add_argument("--cli", action="store_true", help="overview and skeleton")
    parser.add_argument("--compact", action="store_true", help="overview and compact skeleton")
    parser.add_argument("--languages", action="store_true", help="what is extracted from which language")
    parser.add_argument("--tool", nargs="+", metavar=("NAME", "ARG"), help="one report")
    args = parser.parse_args(argv)
    if args.languages:
        print(render.languages_table())
        return 0
    spark = SparkSession.builder.appName("loomgraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark, args.root)
    if args.tool:
        print(engine.report(*args.tool), end="")
    elif not (args.cli or args.compact):
        server.serve(engine, sys.stdin, sys.stdout)
    else:
        print(engine.boot())
        print(render.compact(engine.graph) if args.compact else render.skeleton(engine.graph), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
