"""python -m tarnweave.cli extract|clean|chunk|index|search: the stages over stored tables."""

from __future__ import annotations

import argparse
from dataclasses import asdict

from pyspark.sql import SparkSession

from .config import EngineConfig
from .functions.html import documents_from_pages
from .operators import chunking as C
from .operators import documents as D
from .plans.ingest import ingest
from .plans.search import hashed_embedding, search


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tarnweave")
    sub = p.add_subparsers(dest="stage", required=True)
    for name, extra in (("extract", ()), ("clean", ()), ("chunk", ("--recursive-only", "--stats-only")), ("index", ("--dry-run",)), ("search", ())):
        s = sub.add_parser(name)
        s.add_argument("--input", required=True)
        s.add_argument("--output")
        if name == "search":
            s.add_argument("--queries", required=True)
        for flag in extra:
            s.add_argument(flag, action="store_true")
    a = p.parse_args(argv)
    spark, config = SparkSession.builder.appName("tarnweave").getOrCreate(), EngineConfig()
    rows = spark.read.parquet(a.input)
    if a.stage == "extract":
        documents_from_pages(rows, config).selectExpr("page_id AS seq", "url", "title", "content").write.parquet(a.output)
    elif a.stage == "clean":
        D.clean_documents(rows, config.min_content).write.parquet(a.output)
    elif a.stage == "chunk":
        chunks = C.chunk_documents(rows, config, None if a.recursive_only else hashed_embedding)
        if a.stats_only:
            print(C.chunk_stats(chunks).first().asDict())
        else:
            chunks.write.parquet(a.output)
    elif a.stage == "index":
        print(asdict(ingest(spark, rows, a.output, config, dry_run=a.dry_run)))
    else:
        search(spark.read.parquet(a.queries), rows, config).write.parquet(a.output)


if __name__ == "__main__":
    main()
