"""Order-aware deduplication, statistics and snapshot differences of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import language as L


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in ``order`` (an aggregation with map-side combine, not a window)."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def clean_documents(df: DataFrame, least: int = 50) -> DataFrame:
    """(seq, url, title, content) cleaned; short ones go, then the first of each url stays with its language."""
    # A filter over the cleaned column would be pushed below it and clean every text twice; this one is part of its value.
    clean = F.filter(F.array(T.clean_content(F.col("content"), F.col("title"))), lambda x: F.length(x) >= least)
    c = df.select(*[x for x in df.columns if x != "content"], F.explode(clean).alias("content"))
    return first_by(c, "url", "seq").withColumn("language", L.detect(F.col("content"), F.col("url")))


def crawl_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("type") == "html").alias("html"), F.count_if(F.col("type") == "pdf").alias("pdf"),
        F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("total_content_chars"),
    )


def dedup_flags(df: DataFrame) -> DataFrame:
    """(seq, url, outcome): an earlier row of the url shadows even if it is empty; content repeats count among the rest."""
    blank = T.strip(F.coalesce("content", F.lit(""))) == ""
    h = F.when(~blank, T.content_hash(F.col("content")))
    narrow = df.select("seq", "url", blank.alias("blank"), h.alias("h"))  # texts stay behind
    by_url = Window.partitionBy("url").orderBy("seq")
    d = narrow.withColumn("again", F.row_number().over(by_url) > 1)
    d = d.withColumn("h", F.when(~F.col("again"), F.col("h")))
    live = d.where("h is not null")
    firsts = live.groupBy("h").agg(F.min("seq").alias("first"))
    kept = live.join(firsts, "h").select("seq", "url", F.when(F.col("seq") > F.col("first"), "duplicate_content").otherwise("kept").alias("outcome"))
    return kept.unionByName(d.where("h is null").select("seq", "url", F.when(F.col("again"), "duplicate_url").otherwise("empty").alias("outcome")))


def hash_index(df: DataFrame) -> DataFrame:
    return first_by(df.select("url", "seq", T.content_hash(F.coalesce("content", F.lit(""))).alias("hash")), "url", "seq").select("url", "hash")


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(url, change) with change added, removed, updated or unchanged."""
    p, c = (hash_index(x).withColumnRenamed("hash", n) for x, n in ((previous, "old"), (current, "new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "updated")
    return c.join(p, "url", "full_outer").select("url", change.otherwise("unchanged").alias("change"))


def diff_summary(diff: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("change") == k)
    changed = n("added") + n("updated") + n("removed")
    empty_before = n("removed") + n("updated") + n("unchanged") == 0
    return diff.agg(
        *[n(k).alias(k) for k in ("added", "removed", "unchanged", "updated")],
        changed.alias("documents_changed"), ((changed > 0) | empty_before).alias("has_changes"),
    )


def to_process(current: DataFrame, diff: DataFrame) -> DataFrame:
    return current.join(diff.where("change in ('added', 'updated')").select("url"), "url", "left_semi")


def reusable(chunks: DataFrame, diff: DataFrame) -> DataFrame:
    return chunks.join(diff.where("change = 'unchanged'").select(F.col("url").alias("source_url")), "source_url", "left_semi")


def metadata_column(c: str, key: str, default: Column) -> Column:
    return F.coalesce(F.col(c)[key], default)
