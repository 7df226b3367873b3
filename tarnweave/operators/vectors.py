"""Vector similarity and exact nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let


#: Stored vectors that meet a block of queries at once.
TILE = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return let(norm(a) * norm(b), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def average(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def _best(best, s, own, k: int, digits: int):
    """The k best of each query, as (query, score, id) arrays in this order, of ``best`` and of scores (query, vector) of more vectors."""
    import numpy as np

    least, count = np.full(len(s), -np.inf), np.zeros(len(s), dtype=np.int64)
    if best:
        np.add.at(count, best[0], 1)
        np.minimum.at(low := np.full(len(s), np.inf), best[0], best[1])
        least = np.where(count == k, low, least)
    if s.shape[1] > k and not np.isfinite(least).all():
        least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
    x, y = np.nonzero(s >= (least - 10.0**-digits)[:, None])
    found = [x, np.round(s[x, y], digits), own[y]]
    if best:
        if not len(x):
            return best
        found = [np.concatenate(c) for c in zip(best, found)]
    order = np.lexsort((found[2], -found[1], found[0]))
    x, score, ids = (c[order] for c in found)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    kept = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)])) < k
    return x[kept], score[kept], ids[kept]


def _scanned(batches, q, k: int, digits: int):
    """(query, id, score) arrays: the k best of each row of ``q`` among batches of (id, vector)."""
    import numpy as np

    best = None
    for b in batches:
        for at in range(0, b.num_rows, TILE):
            own, m = b.slice(at, TILE).columns
            m = m.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
            s = q @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)).T
            best = _best(best, s, np.array(own.to_pylist()), k, digits)
    for at in range(0, len(best[0]) if best else 0, 65536):
        x, score, own = (c[at : at + 65536] for c in best)
        yield x, own, score


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int = 4096, digits: int = 9) -> DataFrame:
    """(query_id, id, score, rank): exact cosine neighbours of (query_id, vector) among (id, vector); ties of scores rounded to ``digits`` by id.

    A few stored vectors meet a block of at most ``block_rows`` queries in one matrix product, and only a task's
    own best k for each query are exchanged.  Queries are read block by block.
    """
    import numpy as np
    import pyarrow as pa

    rows = queries.select("query_id", "vector")
    kinds = [rows.schema["query_id"].dataType, vectors.schema["id"].dataType]
    query_kind, id_kind = (x.simpleString() for x in kinds)
    arrow = [*map(_arrow, kinds), pa.float64()]
    parts, block = [], []

    def scan(block):
        q = np.array([v for _, v in block], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = queries.sparkSession.sparkContext.broadcast(([i for i, _ in block], q))

        def run(batches):
            ids, q = shared.value
            for x, own, score in _scanned(batches, q, k, digits):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([ids[i] for i in x], own.tolist(), score), arrow)], names=["query_id", "id", "score"])

        return vectors.select("id", "vector").mapInArrow(run, f"query_id {query_kind}, id {id_kind}, score double")

    for r in rows.toLocalIterator():
        block.append((r[0], list(r[1])))
        if len(block) == block_rows:
            parts.append(scan(block))
            block = []
    if block or not parts:
        parts.append(scan(block) if block else vectors.select(F.lit(None).cast(query_kind).alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
