"""Incremental ingestion: clean, compare with the last snapshot, chunk what changed, maintain the index.

The snapshot is committed after the index, so a failed run is repeated in full by the next one.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import chunking as C
from ..operators import documents as D
from ..operators import retrieval as R
from ..sources.storage import VersionedTable


@dataclass
class IngestReport:
    skipped: bool
    changes: dict
    chunks_reused: int = 0
    chunks_new: int = 0
    removed_points: int = 0
    seconds: dict = field(default_factory=dict)


def ingest(spark: SparkSession, crawled: DataFrame, root: str, config: EngineConfig = EngineConfig(), embed=None, dry_run: bool = False) -> IngestReport:
    """Bring the tables under ``root`` up to (seq, url, title, content)."""
    documents, index = VersionedTable(spark, f"{root}/documents"), VersionedTable(spark, f"{root}/index")
    began = time.time()
    current = D.clean_documents(crawled, config.min_content).persist()
    try:
        previous, held = documents.read(), index.read()
        base = previous if previous is not None else current.limit(0)
        diff = D.snapshot_diff(base, current)
        changes = D.diff_summary(diff).first().asDict()
        if not changes["has_changes"] and held is not None:
            return IngestReport(True, changes, seconds={"diff": round(time.time() - began, 1)})
        if held is None or changes["unchanged"] == 0:
            kept, todo = None, current
        else:
            kept, todo = D.reusable(held, diff).select(*held.columns), D.to_process(current, diff)
        outcome = D.dedup_flags(todo).where("outcome = 'kept'").select("seq")
        fresh = C.chunk_documents(todo.join(outcome, "seq", "left_semi"), config, embed).drop("document_chunk_count")
        merged = C.with_counts(fresh if kept is None else kept.drop("document_chunk_count").unionByName(fresh, allowMissingColumns=True))
        if dry_run:
            return IngestReport(False, changes, kept.count() if kept is not None else 0, fresh.count())
        written = index.write(merged)
        removed = R.stale_count(held, written, "chunk_id").first()[0] if held is not None else 0
        wrong = R.validate_index(merged, written).where("kind <> 'equal'").agg(F.sum("n")).first()[0]
        if wrong:
            raise RuntimeError(f"index validation failed for {wrong} chunks")
        documents.write(current)
        reused = kept.count() if kept is not None else 0
        return IngestReport(False, changes, reused, written.count() - reused, removed, {"total": round(time.time() - began, 1)})
    finally:
        current.unpersist()
