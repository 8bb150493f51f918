"""Command line: pack, audit or replay a folder of tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import constants as C


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="factloom", description="Fact-journal analytics")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("context", "compact", "list", "audit"):
        one = commands.add_parser(name)
        one.add_argument("--facts", required=True, help="parquet table of facts")
        one.add_argument("--out", required=True, help="folder to write")
        one.add_argument("--budget", type=int, default={"compact": C.COMPACTION_BUDGET}.get(name, C.CONTEXT_BUDGET))
        if name == "list":
            one.add_argument("--page", type=int, default=1)
            one.add_argument("--with-text", action="store_true")
    replay = commands.add_parser("replay")
    replay.add_argument("--journal", required=True)
    replay.add_argument("--out", required=True)
    return out


def main(argv: list[str] | None = None) -> None:
    from .api import Engine
    from .operators import legacy, pack

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    engine = Engine(spark)
    if args.command == "replay":
        from .sources import journal

        entries = journal.committed(spark, args.journal) if journal.last_commit(spark, args.journal) else journal.entries(spark, args.journal)
        result = legacy.rebuild(entries)
    else:
        facts = spark.read.parquet(args.facts)
        if args.command == "context":
            result = engine.context(facts, args.budget)
        elif args.command == "compact":
            result = engine.compaction(facts, args.budget)
        elif args.command == "list":
            result = engine.list(facts, offset=(max(1, args.page) - 1) * C.PAGE_SIZE, with_text=args.with_text)
        else:
            result = engine.audit(pack.full_contexts(facts), engine.context(facts, args.budget))
    result.write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
