"""Command line: ``index FOLDER [INDEX] [--genres CSV]``, ``search QUERY`` and an interactive prompt."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from folianto.operators.indexing import Index, append
from folianto.operators.search import Engine, highlight_terms
from folianto.plans.query import QueryParseError, query_string
from folianto.sources.files import FileError, enrich, read_parsed
from folianto.sources.metadata import load_genre_map

DEFAULT_INDEX = "./user_index"
#: The genre map that is used where none is named, if it is there.
DEFAULT_GENRES = "./genres_map.csv"


def session() -> SparkSession:
    spark = SparkSession.builder.appName("folianto").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def index_folder(spark: SparkSession, folder: str, index: str, genres: str | None, language: str) -> Index:
    mapping = load_genre_map(spark, genres) if genres else None
    return append(spark, index, enrich(read_parsed(spark, folder), mapping), language)


def show(engine: Engine, line: str, k: int, out=sys.stdout) -> None:
    try:
        hits = engine.execute(query_string(line), k, terms=highlight_terms(line)).collect()
    except QueryParseError as e:
        print(f"bad query: {e}", file=out)
        return
    for h in hits:
        print(f"{h.doc_id}\t{h.bm25_score:.4f}\t{h.title}\t{h.author}\t{len(h.highlights)} marks", file=out)
    print(f"{len(hits)} hits", file=out)


def prompt(spark: SparkSession, index: str, language: str, k: int) -> None:
    engine = Engine(Index.load(spark, index, language))
    for line in sys.stdin:  # ends with the input
        line = line.strip()
        if line in ("quit", "exit"):
            return
        if line.startswith("index "):
            _, folder, *rest = line.split()
            genres = rest.pop(rest.index("--genres") + 1) if "--genres" in rest[:-1] else DEFAULT_GENRES if os.path.exists(DEFAULT_GENRES) else None
            rest = [x for x in rest if x != "--genres"]
            try:
                engine = Engine(index_folder(spark, folder, rest[0] if rest else index, genres, language))
            except FileError as e:
                print(e)
                continue
            print(f"{engine.index.doc_count} chunks, {engine.index.indexed_files} files and {engine.index.indexed_chunks} chunks of them new")
        elif line:
            show(engine, line, k)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folianto")
    parser.add_argument("--language", default="russian", choices=("russian", "english"))
    sub = parser.add_subparsers(dest="command")
    one = sub.add_parser("index", help="index the files of a folder")
    one.add_argument("folder")
    one.add_argument("index", nargs="?", default=DEFAULT_INDEX)
    one.add_argument("--genres", help="file of two columns: genre as found, genre to be used")
    two = sub.add_parser("search", help="one query")
    two.add_argument("query")
    two.add_argument("--index", default=DEFAULT_INDEX)
    two.add_argument("-k", type=int, default=10)
    three = sub.add_parser("prompt", help="queries from the input, one a line")
    three.add_argument("--index", default=DEFAULT_INDEX)
    three.add_argument("-k", type=int, default=10)
    a = parser.parse_args(args)
    if a.command is None:
        parser.print_help()
        return 2
    spark = session()
    if a.command == "index":
        print(f"{index_folder(spark, a.folder, a.index, a.genres or (DEFAULT_GENRES if os.path.exists(DEFAULT_GENRES) else None), a.language).doc_count} chunks")
    elif a.command == "search":
        show(Engine(Index.load(spark, a.index, a.language)), a.query, a.k)
    else:
        prompt(spark, a.index, a.language, a.k)
    return 0


if __name__ == "__main__":
    sys.exit(main())
