"""Command line: python -m lorebase.cli [--store ROOT] init|ingest|ingest-dir|sources|wiki|show|search|digest|project ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.search import render_digest
from .plans.knowledge_base import KnowledgeBase


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorebase")
    p.add_argument("--store")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    for name in ("ingest", "ingest-dir"):
        q = sub.add_parser(name)
        q.add_argument("path")
        q.add_argument("--type")
        q.add_argument("--title")
        q.add_argument("--pdf", action="store_true", help="read the text of PDF files, where a reader is installed")
    for name in ("sources", "wiki", "digest", "export"):
        sub.add_parser(name)
    q = sub.add_parser("show")
    q.add_argument("page_type")
    q.add_argument("slug")
    q = sub.add_parser("search")
    q.add_argument("query")
    q.add_argument("--limit", type=int, default=10)
    q = sub.add_parser("project")
    q.add_argument("action", choices=["add", "list"])
    q.add_argument("title", nargs="?")
    q.add_argument("--question")
    q.add_argument("--keywords", default="")
    return p


def rows(df: DataFrame) -> None:
    """All rows, a line each, held one partition at a time."""
    for r in df.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in r))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lorebase").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    base = KnowledgeBase(spark, a.store)
    if a.command == "init":
        base.ensure()
    elif a.command in ("ingest", "ingest-dir"):
        got = base.ingest(a.path, a.type, a.title, a.pdf)
        print(f"{got.n_new} new, {got.n_dup} duplicates")
        if got.changes is not None:
            rows(got.changes.select("source_id", "change", F.concat_ws("/", "page_type", "slug"), F.coalesce("effect", F.lit(""))).orderBy("source_id", "change", "page_type", "slug"))
    elif a.command == "sources":
        rows(base.sources().select("source_id", "source_type", F.substring(F.coalesce("title", F.lit("")), 1, 50).alias("title")).orderBy("source_id"))
    elif a.command == "wiki":
        rows(base.wiki())
    elif a.command == "show":
        text = base.show(a.page_type, a.slug)
        print(text if text is not None else "no such page")
        return int(text is None)
    elif a.command == "search":
        base.search(a.query, a.limit).show(a.limit, False)
    elif a.command == "digest":
        print(render_digest(base.digest()).first()["text"])
    elif a.command == "export":
        base.export()
    elif a.action == "add":
        print(base.add_project(a.title, a.question, a.keywords))
    else:
        rows(base.projects().select("project_id", "title"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
