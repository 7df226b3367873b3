"""Helpers shared by the corpus operators: sources, shared storage, Arrow plumbing and word caches."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: str | None = None
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Words that a worker's memo of hashes holds.
WORDS = 60_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach (``spark.checkpoint.dir``).

    Only on a single machine (master ``local``) may the session leave it unset; a private folder then serves.
    """
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _OWN_DIR is None:
        folder = tempfile.mkdtemp(prefix="tarnweave-")
        atexit.register(shutil.rmtree, folder, True)
        _OWN_DIR = "file://" + folder
    return _OWN_DIR


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_once(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write a table; it then stands for the steps before it, whose shuffle files go."""
    held = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, held) if held is not None else spark.conf.unset(_CLEANUP)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    path = scratch(spark, name)
    write_once(spark, df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_scratch(spark: SparkSession, *steps: DataFrame | str) -> None:
    """Remove written steps (frames that ``materialize`` returned, or paths) that no later result reads."""
    for x in steps:
        p = spark._jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x.written_to)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


HOT_KEYS = 20_000


def hot_limit(rows: int) -> int:
    """Keys of more rows than this are hot; there are at most HOT_KEYS of them, whatever the table."""
    return max(1_000, -(-rows // HOT_KEYS))


def hot_keys(big: DataFrame, key: str) -> list | None:
    """The rows (key) of ``big``, a written table, that ``hot_limit`` calls hot."""
    rows = big.count()
    most = hot_limit(rows)
    return big.groupBy(key).count().where(F.col("count") > most).select(key).collect() if most < rows else []


def join_hot(spark: SparkSession, big: DataFrame, small: DataFrame, key: str, how: str = "inner", keys: list | None = None) -> DataFrame:
    """Join ``big`` (a written table) to ``small`` (one narrow row for each key) without meeting hot keys in one task.

    Rows of hot keys meet a broadcast of their at most HOT_KEYS partners, all others a shuffled join.
    """
    if keys is None:
        keys = hot_keys(big, key)
    if not keys:
        return big.join(small, key, how)
    hot = F.broadcast(spark.createDataFrame(keys, big.select(key).schema))
    cold = big.join(hot, key, "left_anti").join(small, key, how)
    return cold.unionByName(big.join(hot, key, "left_semi").join(F.broadcast(small.join(hot, key, "left_semi")), key, how))


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps whose frames are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, most: int) -> None:
    """From now on this session sends Python workers at most so many bytes at once; a batch is held by both sides, as rows and as
    columns, and Spark allows 64 MB."""
    spark.conf.set(_BATCH, str(most))


def relieve(spark: SparkSession) -> None:
    """Executors collect their garbage, as idle tasks on all cores, and so give the memory of finished steps back to the machine.

    Else a heap stays as large as the largest step made it, beside the memory of the workers.  No result depends on it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def wrapped(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as one column ``row``, so that no name of theirs meets one of an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def raw(texts) -> list[bytes]:
    """An Arrow column of strings or bytes as bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def slices(batches, rows: int = 512):
    """Arrow batches in parts of at most so many rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def uncollected(run):
    """``run`` over batches without Python's search for cycles, which reads all of a large dictionary again and again;
    its memory goes back at the end."""

    def out(batches):
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            _give_back()

    return out


def text_bytes(col: str = "text"):
    """Whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def byte_groups(column, most: int = 2 << 20, rows: int = 4096):
    """Row ranges with at most so many bytes of text (or one row); null counts as empty."""
    import pyarrow.compute as pc

    lo = total = 0
    for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        if i > lo and (total + n > most or i - lo >= rows):
            yield lo, i
            lo, total = i, 0
        total += n
    if len(column):
        yield lo, len(column)


def strings(column):
    """A column of UTF-8 bytes as strings; what is no UTF-8 is replaced."""
    import pyarrow as pa

    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in column.to_pylist()], pa.string())


def joined(offsets, values, between: bytes):
    """The runs of ``values`` between neighbouring offsets, each as one value."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values), pa.scalar(between, pa.large_binary()))


class Aged:
    """A memo of two generations: a full young one becomes the old one, and what is used again moves back."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit // 2, {}, {}

    def age(self) -> None:
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young

    def missing(self, keys) -> list:
        """The keys without a value; the others are in the young generation afterwards."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old.pop(k)
                else:
                    out.append(k)
        return out


class Memo(dict):
    """A bounded memo: ``memo[key]`` computes and stores missing values one at a time."""

    __slots__ = ("fn", "limit")

    def __init__(self, fn, limit: int = 400_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def worker_cache(name: str, make):
    """One object for each Python worker, kept between tasks until another operator asks for its own."""
    if name not in _CACHE:
        _CACHE.clear()
        _LATEST.clear()
        _give_back()
        _CACHE[name] = make()
    return _CACHE[name]


def _give_back() -> None:
    """Return the memory of dropped objects to the machine, as far as its C library can."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_CACHE: dict = {}
_LATEST: dict = {}


def latest(name: str, token: str, make):
    """Like worker_cache, but a new token replaces the object of the last one."""
    held = _LATEST.get(name)
    if held is None or held[0] != token:
        held = token, make()
        _LATEST[name] = held
    return held[1]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)
