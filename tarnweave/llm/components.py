"""Connected components of a link table, as a distributed fixpoint of minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, materialize


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); the component is its smallest id.

    Every round takes the least label among the neighbours; from the third on also the label of that label,
    so long chains shrink geometrically.  Labels live in written tables, never on the driver.  Hubs and
    large components are joined by ``join_hot``.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(spark, both.where("a <> b").distinct(), "links")
    hubs = hot_keys(both, "b")
    labels = materialize(spark, both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")), "labels")
    turn = 0
    while True:
        turn += 1
        near = join_hot(spark, both, labels.select(F.col("a").alias("b"), "c"), "b", keys=hubs).groupBy("a").agg(F.min("c").alias("m"))
        after = materialize(spark, labels.join(near, "a").select("a", F.col("c").alias("old"), F.least("c", "m").alias("c")), "labels")
        if turn > 2:
            jump = after.select(F.col("a").alias("c"), F.col("c").alias("top"))
            after = materialize(spark, join_hot(spark, after, jump, "c").select("a", "old", F.col("top").alias("c")), "labels")
        if after.where("old <> c").isEmpty():
            return after.select(F.col("a").alias("id"), F.col("c").alias("component"))
        labels = after.select("a", "c")


def merged(spark: SparkSession, labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after further ``links`` (a, b): only the links between components are worked on."""
    if labels is None:
        return connected_components(spark, links)
    if links.isEmpty():
        return labels
    of = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
    tops = join_hot(spark, links, of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    tops = connected_components(spark, tops.distinct())
    old = join_hot(spark, labels, tops.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left")
    old = old.select("id", F.coalesce("top", "component").alias("component"))
    new = tops.join(labels.select("id"), "id", "left_anti").select("id", "component")
    return materialize(spark, old.unionByName(new), "labels")
