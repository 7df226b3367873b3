"""A corpus from raw documents to token ids: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each stage's rows to the shared
folder and reads them back as the next one's input.  All but the last return the columns of documents.

An executor's memory holds its heap and its Python workers.  Each stage therefore starts with ``_begin``: it
bounds the batches that the session sends to workers, and what earlier steps held goes back to the machine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm.bpe_sql import encode
from tarnweave.llm.common import materialize, release_shuffles, relieve, small_batches, table, wrapped
from tarnweave.llm.decontamination import uncontaminated
from tarnweave.llm.near_dedup import near_duplicates
from tarnweave.llm.substring_dedup import remove_repeats
from tarnweave.llm.toxicity import THRESHOLD, below, fit, training_sample

SHINGLE_WORDS, SIMILARITY = 5, 80
#: Bytes in a batch for a Python worker; repeats within one batch are sent once, so that stage takes larger ones.
BATCH, REPEATS_BATCH = 2 << 20, 16 << 20


def _begin(spark: SparkSession, batch: int = BATCH) -> None:
    small_batches(spark, batch)
    relieve(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    model = fit(training_sample(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return below(docs, model, THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group stays, in one row: of rows of one id, the one of least text hash.

    Rows without id are no document that could be linked; they all stay.
    """
    _begin(spark)
    found = materialize(spark, near_duplicates(spark, docs.select("doc_id", "text"), SHINGLE_WORDS, SIMILARITY), "near-verdicts")
    gone = found.where("not kept").select("doc_id").distinct()
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = wrapped(docs).withColumn("doc_id", F.col("row.doc_id"))
    once = rows.join(again, "doc_id").groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    rest = rows.join(gone.unionByName(again), "doc_id", "left_anti")
    return rest.select("row").unionByName(once.select("row")).select("row.*")


def remove_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the bytes that a document of smaller id already has."""
    _begin(spark, REPEATS_BATCH)
    out = remove_repeats(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that holds a window of any benchmark item goes."""
    _begin(spark)
    return uncontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return encode(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_spans),
    ("decontamination", drop_contaminated),
    ("bpe", encode_bpe),
]
#: SQL expresses neither the fitted model nor the tokens; tests/llm/test_queries.py has the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
        release_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
