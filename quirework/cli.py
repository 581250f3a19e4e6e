"""Command line: settings, stages and queries."""

from __future__ import annotations

import argparse
import os

from . import catalog
from .config import Layout, Settings, default_yaml, load
from .log import logger
from .operators import state
from .plans import stages

#: Stages that read the newest table of another one.
AFTER = {"clean": "extract", "classify": "clean", "chunk": "classify"}


def parsed(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quirework", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="print default settings")
    sub.add_parser("queries", help="list the queries")
    run = sub.add_parser("query", help="run a query on a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    for name, about in (("extract", "read books"), ("run", "extract, clean, classify and chunk books"), ("rebuild", "write the books with their assembled documents")):
        book = sub.add_parser(name, help=about)
        book.add_argument("books")
        book.add_argument("work")
        book.add_argument("--settings")
    sub.choices["rebuild"].add_argument("out")
    for name in (*AFTER, "assemble", "status"):
        stage = sub.add_parser(name, help="states of items by stage" if name == "status" else f"the stage {name}, from the newest tables")
        stage.add_argument("work")
        stage.add_argument("--settings")
    return parser.parse_args(argv)


def stage(spark, name: str, layout: Layout, s: Settings, books: str | None = None):
    """Run a stage on the newest tables and commit its next version."""
    if name == "extract":
        out = stages.extract(spark, books)
    elif name == "assemble":
        out = stages.assembled(stages.newest(spark, layout, "translate"), stages.newest(spark, layout, "chunk"))
    else:
        before = stages.newest(spark, layout, AFTER[name])
        out = stages.clean(before) if name == "clean" else stages.classified(before).fillna({"classification": "unknown"}) if name == "classify" else stages.chunked(before, s)
    done = stages.commit(out, layout, name)
    stages.invalidate(spark, layout, name)
    logger().info("%s: version %s", name, stages.versions(spark, layout, name)[-1])
    return done


def rebuild(spark, books: str, layout: Layout, s: Settings, out: str) -> None:
    """Write each book into ``out``, one at a time."""
    whole = stages.require_complete(stages.newest(spark, layout, "assemble"))
    os.makedirs(out, exist_ok=True)
    for book in stages.rebuilt(spark, books, whole, stages.newest(spark, layout, "extract"), s).toLocalIterator():
        with open(os.path.join(out, os.path.basename(book.path)), "wb") as f:
            f.write(book.content)


def main(argv: list[str] | None = None) -> int:
    args = parsed(argv)
    if args.command == "init":
        print(default_yaml(), end="")
        return 0
    if args.command == "queries":
        print("\n".join(sorted(catalog.queries())))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "query":
        catalog.queries()[args.name](spark, args.tables).show(50, False)
        return 0
    s = load(args.settings) if args.settings else Settings()
    layout = Layout(args.work)
    if args.command == "status":
        state.stage_status(state.latest_state(spark.read.parquet(layout.log()))).orderBy("stage").show(50, False)
    elif args.command == "rebuild":
        rebuild(spark, args.books, layout, s, args.out)
    else:
        for name in ("extract", *AFTER) if args.command == "run" else (args.command,):
            stage(spark, name, layout, s, getattr(args, "books", None))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
