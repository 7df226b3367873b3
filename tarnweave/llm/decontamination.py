"""Benchmark decontamination by winnowing.

Texts become word sequences; every run of GRAM words is hashed, and of each SPAN neighbouring runs the
one of least hash is a fingerprint.  GRAM + SPAN - 1 equals the window length, so any window that a
document shares with an item shares a fingerprint.  Fingerprints of documents are joined with those of
the benchmark, and each hit is extended to the exact windows around it, compared word by word.  Items
of fewer words than a window are one window of their own length and are looked up by that length.

The benchmark side is dealt in blocks of at most ``block_windows`` windows (that bounds what a worker
holds and what is broadcast); with more than one block the passes are merged by row.

Null and wordless texts have no windows and are never contaminated.  Items without id or words are left
out; rows of one item id count as one item.  Repeated documents each get their row; an empty table of
either side gives the obvious result.  Other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import WORDS, Memo, byte_groups, latest, materialize, raw, slices, table, text_bytes, worker_cache, wrapped

WINDOW, GRAM, SPAN = 8, 4, 5
BLOCK_WINDOWS = 200_000
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_P = 0x9E3779B97F4A7C15


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def word_hash():
    import xxhash

    return worker_cache("word-hash", lambda: Memo(xxhash.xxh64_intdigest, WORDS))


def gram_hashes(h, n: int):
    """Mixed hashes of every run of n neighbouring word hashes."""
    import numpy as np

    out, done, p = h, 1, 1
    mask = (1 << 64) - 1
    acc = None  # combine powers of two, like binary exponentiation
    taken, block, size, bp = 0, h, 1, _P
    while n:
        if n & 1:
            if acc is None:
                acc, taken = block, size
            else:
                m = len(h) - taken - size + 1
                if m <= 0:
                    return h[:0]
                acc = block[:m] * np.uint64(pow(_P, taken, 1 << 64)) + acc[size : size + m]
                taken += size
        n >>= 1
        if n:
            if len(block) <= size:
                return h[:0]
            block = block[:-size] * np.uint64(bp) + block[size:]
            bp, size = bp * bp & mask, size * 2
    acc = acc ^ (acc >> np.uint64(31))
    acc = acc * np.uint64(0xD6E8FEB86659FD93)
    return acc ^ (acc >> np.uint64(29))


def winnowed(g, span: int = SPAN):
    """Positions whose hash is the least of some ``span`` neighbours (all ties kept, so the choice depends on content alone)."""
    import numpy as np

    if len(g) < span:
        return np.zeros(0, dtype=np.int64)
    m = len(g) - span + 1
    least = g[:m].copy()
    for s in range(1, span):
        np.minimum(least, g[s : s + m], out=least)
    chosen = np.zeros(len(g), dtype=bool)
    for s in range(span):
        chosen[s : s + m] |= g[s : s + m] == least
    return np.flatnonzero(chosen)


def hashed(words: list[bytes]):
    import numpy as np

    return np.fromiter(map(word_hash().__getitem__, words), dtype=np.uint64, count=len(words))


class BenchmarkIndex:
    """The windows of one block of items: exact windows by their words, and the fingerprints that lead to them."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        import numpy as np

        self.windows: dict[bytes, list[str]] = {}
        prints, self.short = [], {}
        for item, words in items:
            n = min(WINDOW, len(words))
            for i in range(len(words) - n + 1):
                held = self.windows.setdefault(b" ".join(words[i : i + n]), [])
                if item not in held:
                    held.append(item)
            h = hashed(words)
            if n < WINDOW:
                self.short.setdefault(n, []).append(gram_hashes(h, n))
            else:
                g = gram_hashes(h, GRAM)
                prints.append(g[winnowed(g)])
        none = np.zeros(0, dtype=np.uint64)
        self.prints = np.unique(np.concatenate([none, *prints]))
        self.short = {n: np.unique(np.concatenate(x)) for n, x in self.short.items()}

    @staticmethod
    def _among(values, keys):
        import numpy as np

        if not len(keys):
            return np.zeros(len(values), dtype=bool)
        bits = np.zeros(1 << 20, dtype=bool)
        bits[(keys >> np.uint64(44)).astype(np.int64)] = True
        out = bits[(values >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        slot = np.minimum(np.searchsorted(keys, values[at]), len(keys) - 1)
        out[at] = keys[slot] == values[at]
        return out

    def hits(self, texts: list[bytes]):
        """For each text its word count, the set of hit words and the items whose windows occur."""
        import numpy as np

        words, bounds = [], [0]
        for t in texts:
            words += words_of(t)
            bounds.append(len(words))
        h, edges = hashed(words), np.array(bounds)
        found: dict[int, tuple[set, set]] = {}

        def extend(place: int, first: int, last: int, n: int):
            d = int(np.searchsorted(edges, place, side="right")) - 1
            lo, hi = bounds[d], bounds[d + 1]
            for s in range(max(first, lo), min(last, hi - n) + 1):
                items = self.windows.get(b" ".join(words[s : s + n]))
                if items:
                    hit, named = found.setdefault(d, (set(), set()))
                    hit.update(range(s - lo, s - lo + n))
                    named.update(items)

        g = gram_hashes(h, GRAM)
        chosen = winnowed(g)
        for p in chosen[self._among(g[chosen], self.prints)].tolist():
            extend(p, p - WINDOW + GRAM, p, WINDOW)
        for n, keys in self.short.items():
            g = gram_hashes(h, n)
            for p in np.flatnonzero(self._among(g, keys)).tolist():
                extend(p, p, p, n)
        return [(bounds[d + 1] - bounds[d], *found.get(d, ((), ()))) for d in range(len(texts))]


def benchmark_blocks(benchmark: DataFrame, block_windows: int):
    """Items in id order, in blocks of at most so many windows (one larger item is a block of its own)."""
    block, size = [], 0
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("i"), text_bytes().alias("t"))
    for r in rows.toLocalIterator():
        words = words_of(bytes(r["t"]))
        if not words:
            continue
        n = max(1, len(words) - WINDOW + 1)
        if block and size + n > block_windows:
            yield block
            block, size = [], 0
        block.append((r["i"], words))
        size += n
    if block:
        yield block


def _marked(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_windows: int) -> DataFrame:
    """(row, n_words, hit, items): every row of ``docs`` as a struct, with what was found in it."""
    import pyarrow as pa

    blocks = [spark.sparkContext.broadcast(b) for b in benchmark_blocks(benchmark, block_windows)] or [spark.sparkContext.broadcast([])]
    at = docs.columns.index("text")
    rows = wrapped(docs)
    found_in = "n_words long, hit array<int>, items array<string>"

    def scan(block, name, text):
        token = uuid.uuid4().hex

        def run(batches):
            index = latest("benchmark-index", token, lambda: BenchmarkIndex(block.value))
            for whole in batches:
                for lo, hi in byte_groups(text(whole), 1 << 20):
                    b = whole.slice(lo, hi - lo)
                    found = index.hits(raw(text(b)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0),
                            pa.array([x[0] for x in found], pa.int64()),
                            pa.array([sorted(x[1]) for x in found], pa.list_(pa.int32())),
                            pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())),
                        ],
                        names=[name, "n_words", "hit", "items"],
                    )

        return run

    if len(blocks) == 1:
        whole = StructType([*rows.schema.fields, *_parse_datatype_string(found_in).fields])
        return rows.mapInArrow(scan(blocks[0], "row", lambda b: b.column(0).field(at)), whole)
    rows = materialize(spark, rows.withColumn("key", F.monotonically_increasing_id()), "contamination-rows")
    narrow = rows.select("key", F.col("row.text").alias("t"))
    parts = [narrow.mapInArrow(scan(b, "key", lambda x: x.column(1)), f"key long, {found_in}").where("size(items) > 0").select("key", "hit", "items") for b in blocks]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    merged = merged.groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    counts = narrow.mapInArrow(_count_words, "key long, n_words long")
    none = F.array().cast
    out = rows.join(counts, "key").join(merged, "key", "left")
    return out.select("row", "n_words", F.coalesce("hit", none("array<int>")).alias("hit"), F.coalesce("items", none("array<string>")).alias("items"))


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with n_words, hit (word positions) and items (sorted ids), in place of columns of these names."""
    own = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_words", "hit", "items")]
    return _marked(spark, docs, benchmark, block_windows).select(*own, "n_words", "hit", "items")


def uncontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs``, with their own columns only, that hold no window of any item."""
    return _marked(spark, docs, benchmark, block_windows).where("size(items) = 0").select("row.*")


def _count_words(batches):
    import pyarrow as pa

    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(words_of(x)) for x in raw(b.column(1))], pa.int64())], names=["key", "n_words"])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )

