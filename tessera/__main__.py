"""Command line: python -m tessera --root URI COMMAND ...

scrape PAGES FAMILIES OUT [--dry-run AVAILABLE]   manifest rows of the latest versions (parquet in, JSON out)
parse MANIFEST PARSED                              pages and nodes of the manifest's documents into the store
index                                              the index anew from the stored pages and nodes
add MANIFEST PARSED                                parse, sum up and index documents
ingest MANIFEST PARSED                             the same
ask QUESTION | eval GOLDEN | remove DOC_ID | status | health | documents | history
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera.plans.corpus import ingest, scrape
from tessera.plans.engine import Engine
from tessera.sources import readers

COMMANDS = {
    "scrape": ("pages", "families", "out"), "parse": ("manifest", "parsed"), "index": (), "add": ("manifest", "parsed"), "ingest": ("manifest", "parsed"),
    "ask": ("question",), "eval": ("golden",), "remove": ("doc_id",), "status": (), "health": (), "documents": (), "history": (),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--root", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, args in COMMANDS.items():
        command = commands.add_parser(name)
        for a in args:
            command.add_argument(a)
        if name == "scrape":
            command.add_argument("--available", help="parquet with the addresses (url) that could be loaded; without it a dry run")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    engine = Engine(spark, args.root)
    if args.command == "scrape":
        available = spark.read.parquet(args.available) if args.available else None
        scrape(spark.read.parquet(args.pages), spark.read.parquet(args.families), available).write.mode("overwrite").json(args.out)
    elif args.command == "parse":
        listed = readers.manifest(spark, args.manifest).select("doc_id")
        pages, nodes = engine.parse(spark.read.parquet(args.parsed).join(listed, "doc_id", "left_semi"))
        engine.store.replace_documents("pages", pages)
        engine.store.replace_documents("nodes", nodes)
    elif args.command == "index":
        engine.index(engine.store.read("meta"), engine.store.read("nodes"), engine.store.read("pages")).show()
    elif args.command in ("add", "ingest"):
        ingest(engine, readers.manifest(spark, args.manifest), spark.read.parquet(args.parsed)).show()
    elif args.command == "ask":
        rows, cited = engine.ask(spark.createDataFrame([(1, args.question)], "question_id long, question string"))
        row = rows.first()
        print(row.answer)
        if row.route != "retrieve":
            engine.corpus().filter(f"route = '{row.route}'").select("line").show(1000, False)
        cited.select("marker", "doc_title", "clause", "page").show(20, False)
    elif args.command == "eval":
        engine.evaluate(readers.golden(spark, args.golden)).show()
    elif args.command == "remove":
        engine.remove([args.doc_id]).show()
    elif args.command in ("documents", "history"):
        getattr(engine, args.command)().show(1000, False)
    else:
        print(getattr(engine, args.command)())


if __name__ == "__main__":
    main()
