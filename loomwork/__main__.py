"""python -m loomwork {ingest,query,status,reset}: the engine from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loomwork.plans.engine import Engine
from loomwork.sources.pdf import text_pages


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomwork")
    parser.add_argument("--store", default="chunk_store")
    parser.add_argument("--data", default="data", help="folder of PDF files")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("--reset", action="store_true", help="delete the stored chunks first")
    ingest.add_argument("--documents", help="a Parquet table of documents in place of PDF files")
    commands.add_parser("query").add_argument("question")
    commands.add_parser("status")
    commands.add_parser("reset")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("loomwork").getOrCreate()
    engine = Engine(spark, args.store, args.data)
    if args.command == "ingest":
        pages = text_pages(spark.read.parquet(args.documents)) if args.documents else None
        print(f"added {engine.ingest(pages, reset=args.reset)} chunks")
    elif args.command == "query":
        told = engine.query(args.question)
        print(told.answer, *told.sources, sep="\n")
    elif args.command == "status":
        print(engine.status().first().asDict())
    else:
        engine.reset()
        print("reset")


if __name__ == "__main__":
    main()
