"""Command line: index, search, update, reembed, list, stats, delete, config."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.engine import Engine
from .sources.config import load_with_sources
from .sources.web import registry


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paperloom", description=__doc__)
    p.add_argument("--data-dir")
    p.add_argument("--registry", help="folder with software/*.yaml")
    c = p.add_subparsers(dest="command", required=True)
    for name, help_ in (("index", "store the chunks of a table of pages"), ("update", "take over what changed in a table of pages")):
        x = c.add_parser(name, help=help_)
        x.add_argument("software")
        x.add_argument("--pages", required=True, help="Parquet with url and html, and etag and last_modified if known")
        if name == "index":
            x.add_argument("--version")
    x = c.add_parser("search", help="the chunks nearest to a query")
    x.add_argument("query"), x.add_argument("software"), x.add_argument("--version"), x.add_argument("-k", type=int, default=10), x.add_argument("--json", action="store_true")
    x = c.add_parser("reembed", help="embed a version with another model")
    x.add_argument("software"), x.add_argument("model"), x.add_argument("--version")
    x = c.add_parser("stats", help="sizes of one software")
    x.add_argument("software")
    x = c.add_parser("delete", help="remove a software or one of its versions")
    x.add_argument("software"), x.add_argument("--version")
    c.add_parser("list", help="what is indexed")
    x = c.add_parser("config", help="the settings in force")
    x.add_argument("--source", action="store_true", help="say where each comes from")
    return p


def shortened(text: str, most: int = 80) -> str:
    return text if len(text) <= most else text[: most - 3] + "..."


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    config, source = load_with_sources(overrides={"general": {"data_dir": a.data_dir}} if a.data_dir else None)
    if a.command == "config":
        if a.source:
            for section, values in config.items():
                for key, value in values.items():
                    print(f"{section}.{key}  {json.dumps(value)}  {source[section][key]}")
        else:
            print(json.dumps(config, indent=2))
        return 0
    spark = spark or SparkSession.builder.appName("paperloom").getOrCreate()
    e = Engine(spark, registry(spark, a.registry) if a.registry else None, config)
    try:
        if a.command == "index":
            r = e.index(a.software, a.version, pages=spark.read.parquet(a.pages))
            print(f"{r.software} {r.version}: {r.status}, {r.pages} pages, {r.chunks} chunks")
        elif a.command == "update":
            for r in e.update(a.software, pages=spark.read.parquet(a.pages)):
                print(f"{r.software} {r.version}: {r.status}, {r.pages} pages changed, {r.embedded} chunks embedded")
        elif a.command == "search":
            hits = e.search(a.query, a.software, a.version, a.k).select("chunk_id", "title", "url", "section_heading", "content", "score").collect()
            for r in hits:
                print(json.dumps(r.asDict()) if a.json else f"{r.score:.4f}  {shortened(r.title)}  {r.url}")
        elif a.command == "reembed":
            print(f"{e.reembed(a.software, a.model, a.version).embedded} chunks embedded with {a.model}")
        elif a.command == "stats":
            print(json.dumps(e.stats(a.software)))
        elif a.command == "delete":
            e.delete(a.software, a.version)
        else:
            for r in e.list_indexed().withColumn("versions", F.array_join("versions", ", ")).collect():
                print(f"{r.software}  {r.display_name}  {r.versions}  {r.pages} pages  {r.chunks} chunks")
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
