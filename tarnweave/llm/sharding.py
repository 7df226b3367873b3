"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Input rows lie in blocks.  How many rows a block sends to a shard is drawn exactly: the matrix of
block-to-shard counts follows the multivariate hypergeometric law of a uniform permutation, so its
rows sum to the block sizes and its columns to the shard sizes.  Each block then orders its rows by a
keyed hash and deals them out by those counts; after the exchange each shard orders what it received
by a second keyed hash.  Only narrow rows (id, size, checksum) move.

Rows of equal content are interchangeable, so ties of the keyed hash are broken by content and the
result does not depend on which of two identical rows comes first.  Null texts count as empty, null
ids are ordinary values, an empty table gives no rows, further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SHARDS = 16


def shard_sizes(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Draw block-to-shard counts one block after another from what the shards still lack."""
    import numpy as np

    rng, left, rows = np.random.default_rng(seed), np.array(sizes, dtype=np.int64), []
    for n in counts:
        row, need, pool = [], int(n), int(left.sum())
        for j in range(len(left)):
            rest = pool - int(left[j])
            take = need if rest == 0 else int(rng.hypergeometric(int(left[j]), rest, need)) if need and left[j] else 0
            row.append(take)
            need, pool = need - take, rest
        left -= np.array(row, dtype=np.int64)
        rows.append(row)
    return rows


def hypergeometric_shards(
    spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: int = 17, rows_per_bin: int = 100_000
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): counts at most one apart, slots gapless from 0.

    Blocks are the scan's own partitions, written once so that both passes see the same blocks even
    if an executor is lost; the driver sees one count for each block, never rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.spark_partition_id().alias("block"),
    )
    narrow = materialize(spark, narrow, "shard-rows")
    content = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    counts = sorted((r["block"], r["n"]) for r in narrow.groupBy("block").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], shard_sizes(total, shards), seed)
    rows = []
    for (block, _), row in zip(counts, matrix):
        bounds, at = [], 0
        for n in row:
            bounds.append(at := at + n)
        rows.append((block, bounds))
    plan = spark.createDataFrame(rows, "block int, bounds array<long>")

    first = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), *content), *content)
    # The second permutation is keyed by a row's place in the matrix, which no two rows share, so
    # copies of one row spread over all bins; bins have bounded size.
    bins = max(1, -(-total // (shards * rows_per_bin)))
    key = F.xxhash64(F.lit(seed + 1), "block", "rank")
    dealt = (
        narrow.withColumn("rank", F.row_number().over(first))
        .join(plan, "block")
        .select(*content, F.size(F.filter("bounds", lambda b: b < F.col("rank"))).alias("shard"), key.alias("key"))
        .withColumn("bin", F.pmod(F.xxhash64(F.lit(seed + 2), "key"), F.lit(bins)))
    )
    dealt = materialize(spark, dealt, "shard-dealt")
    per_bin = dealt.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bin.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    second = Window.partitionBy("shard", "bin").orderBy("key", *content)
    return (
        dealt.withColumn("at", F.row_number().over(second) - F.lit(1))
        .join(offsets, ["shard", "bin"])
        .select(*content, "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"))
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hypergeometric_shards(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
