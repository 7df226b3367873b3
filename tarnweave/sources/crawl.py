"""Stored crawls: sitemaps, link reachability, result adaption, PDF files and JSON snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sitemap_locs(xml: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(xml, "^﻿", ""), F.lit(r"(?is)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1))


def is_sitemap_index(xml: Column) -> Column:
    return F.contains(F.lower(xml), F.lit("sitemapindex"))


def crawl_results(raw: DataFrame) -> DataFrame:
    """(url, html) of successful results: the redirected address and the cleaned body where there are such."""
    pick = lambda a, b: F.coalesce(F.when(F.col(a) != "", F.col(a)), F.col(b))
    return raw.where("success").select(pick("redirected_url", "url").alias("url"), pick("cleaned_html", "html").alias("html"))


def reachable(spark: SparkSession, edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(page, depth) of everything within ``max_depth`` links of the seeds, breadth first.

    Each level joins only its new pages with the links and leaves out what is known; levels are written
    out and read back together, so plans stay short and a lost executor repeats one level.
    """
    from .storage import write_step

    new = write_step(spark, seeds.select("page").distinct().withColumn("depth", F.lit(0)), "reach")
    paths, schema = new.inputFiles(), new.schema
    known = new
    for depth in range(1, max_depth + 1):
        found = edges.join(new.select(F.col("page").alias("src")), "src").select(F.col("dst").alias("page")).distinct()
        found = found.join(known.select("page"), "page", "left_anti")
        new = write_step(spark, found.withColumn("depth", F.lit(depth)), "reach")
        if new.isEmpty():
            break
        paths = [*paths, *new.inputFiles()]
        known = spark.read.schema(schema).parquet(*paths)
    return known


def pdf_documents(files: DataFrame, parse: Callable[[bytes], tuple[str, list[str]]], least: int = 50) -> DataFrame:
    """(path, title, content) of binary files (path, content); ``parse`` gives a title and page texts.

    Files that fail or give too little text leave no row.
    """

    def run(batches):
        for b in batches:
            rows = []
            for p, raw in zip(b["path"], b["content"]):
                try:
                    title, pages = parse(bytes(raw))
                except Exception:  # one broken file must not fail the job
                    continue
                text = "\n\n".join(x for x in map(str.strip, pages) if x)
                if len(text) >= least:
                    rows.append((p, title, text))
            import pandas as pd

            yield pd.DataFrame(rows, columns=["path", "title", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, title string, content string")


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)


SNAPSHOT = "base_url string, ingested_at string, documents array<struct<url:string,title:string,content:string,type:string,content_type:string,language:string,metadata:map<string,string>>>"


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON snapshot, in their order."""
    raw = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
    return raw.select(F.posexplode("documents").alias("seq", "d")).select("seq", "d.*")
