"""The search plan and the boundaries to outside models, with deterministic offline defaults."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import language as L
from ..functions import text as T
from ..operators import bm25 as B
from ..operators import retrieval as R

DIMS = 64


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def __call__(self, hits: DataFrame) -> DataFrame: ...


class Generator(Protocol):
    def __call__(self, prompts: DataFrame) -> DataFrame: ...


class Judge(Protocol):
    def __call__(self, answers: DataFrame) -> DataFrame: ...


def hashed_embedding(text: Column) -> Column:
    """A bag of hashed tokens, counted in 64 dimensions (not scaled): the offline stand-in for an embedding service."""
    slot = F.transform(F.regexp_extract_all(text, F.lit(T.TOKEN), F.lit(0)), lambda t: F.pmod(F.xxhash64(F.lower(t)), F.lit(DIMS)).cast("int"))
    among = lambda s, i: (F.size(s) - F.size(F.array_remove(s, i))).cast("double")
    # Eight dimensions look through their own eighth of the slots only.
    eighth = lambda s, g: T.let(F.filter(s, lambda x: F.shiftright(x, 3) == g), lambda own: F.transform(F.sequence(g * 8, g * 8 + 7), lambda i: among(own, i)))
    return T.let(slot, lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(DIMS // 8 - 1)), lambda g: eighth(s, g))))


def embedded(queries: DataFrame, chunks: DataFrame, embed: Embedder = hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """Query and chunk vectors as ``search`` takes them."""
    vector = lambda c: embed(F.coalesce(F.col(c), F.lit(""))).alias("vector")
    return queries.select("query_id", vector("text")), chunks.select(F.col("chunk_id").alias("id"), vector("content"))


def keep_order(hits: DataFrame) -> DataFrame:
    """The offline reranker: candidates stay in order."""
    return hits


def search(queries: DataFrame, chunks: DataFrame, config: EngineConfig = EngineConfig(), rerank: Reranker = keep_order, vectors: tuple | None = None) -> DataFrame:
    """(query_id, language, context) for (query_id, text): sparse and, with ``vectors`` (query and chunk frames), dense retrieval, fused, reranked, packed."""
    docs = chunks.select(F.col("chunk_id").alias("id"), "content")
    f = B.fit(docs, config)
    terms = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    postings = B.postings(docs, B.idf_of(f, terms), f, config)
    weight = F.col("idf")
    if config.server_idf:
        n = F.lit(float(f.n))
        weight = weight * F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    q = f.terms.where("idf > 0").join(F.broadcast(terms), "term").select("query_id", "term", weight.alias("weight"))
    lists = [R.best_documents(q, postings, config.prefetch)]
    if vectors:
        from ..operators.vectors import nearest

        lists.append(nearest(*vectors, config.prefetch))
    hits = R.fuse(lists, config.candidates, config.rrf_k)
    title = F.coalesce("title", F.lit("")) if "title" in chunks.columns else F.lit("")
    # A few hits for each query go to the chunks, so that no chunk's text is exchanged.
    hits = chunks.select(F.col("chunk_id").alias("id"), "content", "source_url", title.alias("title")).join(F.broadcast(hits), "id")
    hits = R.keep_scores(rerank(hits).where(F.col("rank") <= config.rerank_top), config.min_rerank_score)
    packed = R.pack_context(hits, config.context_chars)
    return queries.select("query_id", L.of_query(F.col("text")).alias("language")).join(packed, "query_id", "left")
