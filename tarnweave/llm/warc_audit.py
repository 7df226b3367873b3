"""Merkle fixity audit of WARC collections.

Records are laid out in files in order.  A leaf hashes one record with its offset range; every FANOUT
neighbours hash into a node that covers their range, up to one root for each file.  Two replicas are
compared by their roots, and only branches that differ are descended, down to the damaged records.

All of it is aggregation over narrow rows (file, place, hash): texts are read once, to be hashed.  Files
hold about ``records_per_file`` records, so no group grows with the corpus.

Null urls and bodies count as empty, null page ids are ordinary values (first in order); repeated rows
are records of their own; an empty table has no files.  Records missing on one side, or of other length
or place, count as damaged.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

FANOUT = 16
RECORDS_PER_FILE = 1000
DAMAGED_EVERY, DAMAGED_AT = 101, 7


def record(url, html):
    """The bytes of one response record."""
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, html, F.lit("\r\n\r\n"))


def layout(spark: SparkSession, pages: DataFrame, records_per_file: int = RECORDS_PER_FILE, hurt=None) -> DataFrame:
    """(page_id, file, seq, offset, length, record_sha256): where each page's record lies, and its hash.

    Records for which the condition ``hurt`` holds have another last byte, whatever they hold.
    """
    files = max(1, -(-pages.count() // records_per_file))
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    spread = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("page_id").cast("string"), url).cast("binary")), 1, 8), 16, 10).cast("long")
    body = record(url, html).cast("binary")
    sha = F.sha2(body, 256)
    stored = sha if hurt is None else F.when(hurt, F.sha2(F.concat(F.substring(body, F.lit(1), F.octet_length(body) - 1), F.lit(b"?")), 256)).otherwise(sha)
    rows = pages.select("page_id", url.alias("url"), (spread % files).alias("file"), F.octet_length(body).cast("long").alias("length"), sha.alias("true_sha256"), stored.alias("record_sha256"))
    along = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "url", "true_sha256")
    return rows.select(
        "page_id", "file", (F.row_number().over(along) - 1).cast("long").alias("seq"),
        F.coalesce(F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        "length", "record_sha256",
    )


def tree(spark: SparkSession, records: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(level, file, node, start, end, hash) of every node; level 0 has the records."""
    leaf = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "record_sha256").cast("binary"), 256)
    level = records.select(F.lit(0).alias("level"), "file", F.col("seq").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), leaf.alias("hash"))
    levels = [materialize(spark, level, "merkle-level")]
    n = 0
    while not levels[-1].where("node > 0").isEmpty():
        n += 1
        below = levels[-1].groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("c")
        )
        content = F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), F.array_join(F.transform("c", lambda x: x["hash"]), ":"))
        levels.append(materialize(spark, below.select(F.lit(n).alias("level"), "file", "node", "start", "end", F.sha2(content.cast("binary"), 256).alias("hash")), "merkle-level"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file, node) of one level that differ or lie on one side only."""
    a, b = (x.select("file", "node", F.col("hash").alias(c)) for x, c in ((ours, "x"), (theirs, "y")))
    return a.join(b, ["file", "node"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("file", "node")


def audit(spark: SparkSession, ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, node) of the damaged records, found from the roots down; equal branches are never opened."""
    top = max(x.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0] for x in (ours, theirs))
    bad = materialize(spark, differing(ours.where(F.col("level") == top), theirs.where(F.col("level") == top)), "merkle-bad")
    for level in range(top - 1, -1, -1):
        up = bad.withColumnRenamed("node", "up")
        sides = [x.where(F.col("level") == level).withColumn("up", F.floor(F.col("node") / fanout)).join(up, ["file", "up"], "left_semi") for x in (ours, theirs)]
        bad = materialize(spark, differing(*sides), "merkle-bad")
    return bad


def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of ``pages`` with its place and hash, and whether a replica with known damage differs there."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    hurt = F.col("page_id") % DAMAGED_EVERY == DAMAGED_AT
    records = materialize(spark, layout(spark, pages), "merkle-records")
    other = layout(spark, pages, hurt=hurt)
    bad = audit(spark, tree(spark, records), tree(spark, other)).select("file", F.col("node").alias("seq"), F.lit(True).alias("d"))
    return records.join(bad, ["file", "seq"], "left").select(
        "page_id", "file", "seq", "offset", "length", "record_sha256", F.coalesce("d", F.lit(False)).alias("damaged")
    )


ORACLE = r"""
WITH n AS (SELECT greatest(1, ceil(count(*) / 1000.0)::BIGINT) AS files FROM pages),
r AS (
  SELECT page_id, coalesce(url, '') AS url, ('0x' || substr(md5(concat_ws('|', page_id::VARCHAR, coalesce(url, ''))), 1, 8))::BIGINT % files AS file,
    concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
           'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, ''))::VARCHAR, chr(13), chr(10), chr(13), chr(10),
           coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS body
  FROM pages, n),
h AS (SELECT page_id, url, file, strlen(body)::BIGINT AS length, sha256(body) AS record_sha256 FROM r)
SELECT page_id, file, row_number() OVER w - 1 AS seq,
  coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, url, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  length, record_sha256, coalesce(page_id % 101 = 7, false) AS damaged
FROM h WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, url, record_sha256)
"""
