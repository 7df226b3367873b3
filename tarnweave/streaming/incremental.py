"""Continuous ingestion: a file stream of crawled pages, each micro-batch brought into the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..functions.html import documents_from_pages
from ..plans.ingest import ingest

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(stream: DataFrame, root: str, checkpoint: str, config: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Every micro-batch is merged with the snapshot so far; a repeated batch finds nothing changed."""
    from ..operators.documents import first_by
    from ..sources.storage import VersionedTable

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = documents_from_pages(batch, config).selectExpr("page_id AS seq", "url", "title", "content")
        held = VersionedTable(spark, f"{root}/documents").read()
        if held is not None:  # pages that this batch does not mention stay as they are
            old = held.select("seq", "url", "title", "content").join(new.select("url"), "url", "left_anti")
            new = new.unionByName(old)
        ingest(spark, first_by(new, "url", "seq"), root, config)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
