"""Near-duplicates by bottom-k sketches of one hash function.

A document's set holds its distinct shingles; its sketch keeps the K least hashes.  Documents of equal
sets form a class, and only class representatives are compared.

Candidates come from inverted lists of retained values.  Two sets of the wanted similarity share at least
``needed`` of their joint K least hashes (for 0.8: 22 of 48, but for odds below 1e-7; no exception for sets
of at most K shingles, whose sketch is the whole set).  Sketches that share so many values must meet in the
list of one of their rarest, so each sketch is listed only under those, and values that very many
documents retain (boilerplate, a common passage, a common word pair) mostly drop out.  An entry carries a
256-bit map of its sketch; the maps' common bits bound the overlap, so chance meetings end in the list.

No list is compared pair by pair while it is long:

1. Every member meets its list's pivot, the one with the fewest rarer values (the middle of a group of
   copies).  What is confirmed is joined to components, and lists within one component are done.
2. Lists that still hold several components are dealt by size of set (partners differ by 1 / similarity at
   most).  A part of at most SHORT members is compared pair by pair: linear work.
3. Members of longer parts are sketched anew with k = all: an exact prefix filter.  A set is listed under
   the rarest of its values that two sets of the similarity cannot all differ in, and each place in that
   order bounds the size of a partner.  Just-too-different members of a group of near copies have values
   of their own first, and so leave the group's lists without meeting its members.  Lists that stay mixed
   meet pivots again, then their pairs.

Every pair passes the size bound, the estimate from the union's sketch, and is confirmed on the full sets
of both texts.  No list is capped and no member dropped.

Null, empty and wordless texts have an empty set and link with nothing.  Rows without id are never linked
and are kept.  Rows of one id are one document: repeated rows share its component, and where its texts
differ it has the links of each.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS, Memo, byte_groups, drop_scratch, hot_limit, join_hot, materialize, release_shuffles, relieve, table, text_bytes, worker_cache
from .components import merged

K, SHORT, ODDS = 48, 48, 1e-7
#: Ids whose texts are fetched without shuffling the documents: two longs each.
BROADCAST_ROWS = 1_000_000
#: A pivot's text is sent to so many tasks at most, each with its share of the partners.
SPREAD = 64
#: Bytes of text whose words a worker holds at once.
TEXT_BYTES = 1 << 20
BITS = [f"bits{i}" for i in range(4)]
_P = 0x9E3779B97F4A7C15


@cache
def needed(size: int, percent: int) -> int:
    """The least number of values that a sketch of ``size`` values shares with any sketch of a linked set."""
    from math import ceil, comb

    p = percent / 100
    if size < K:  # the whole set; the partner's may be cut to K values
        most = size * 100 // percent
        return max(1, min(-(-size * percent // 100), K - max(0, most - -(-most * percent // 100))))
    below, t = 0.0, 0
    while (below := below + comb(K, t) * p**t * (1 - p) ** (K - t)) < ODDS:
        t += 1
    return max(1, t)


def _word_hash() -> Memo:
    import xxhash

    return worker_cache("word-hash", lambda: Memo(xxhash.xxh64_intdigest, WORDS))


def shingle_sets(texts: list[bytes], width: int) -> list:
    """For each text the sorted distinct 63-bit hashes of its runs of ``width`` words (ASCII lower-cased)."""
    import numpy as np

    words, bounds = [], [0]
    for t in texts:
        words += t.lower().split()
        bounds.append(len(words))
    h = np.fromiter(map(_word_hash().__getitem__, words), dtype=np.uint64, count=len(words))

    def mixed(x):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) >> np.uint64(1)

    grams, m = None, len(h) - width + 1
    if m > 0:
        grams = h[:m].copy()
        for k in range(1, width):
            grams *= np.uint64(_P)
            grams += h[k : k + m]
        grams = mixed(grams)
    out = []
    for lo, hi in zip(bounds, bounds[1:]):
        if hi - lo >= width:
            out.append(np.unique(grams[lo : hi - width + 1]))
        elif hi > lo:  # a shorter text is one shingle, told apart by its length
            x = np.uint64(hi - lo)
            for k in range(lo, hi):
                x = x * np.uint64(_P) + h[k]
            out.append(mixed(np.array([x], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketches(docs: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, text_hash, n, set_key, sketch, bits): the set's size, a 128-bit key of the whole set, its K least hashes and their map."""
    import pyarrow as pa

    def run(batches):
        import warnings
        from hashlib import md5

        import numpy as np

        warnings.simplefilter("ignore", RuntimeWarning)
        for whole in batches:
            for lo, hi in byte_groups(whole.column(2), TEXT_BYTES):
                b = whole.slice(lo, hi - lo)
                sets = shingle_sets([bytes(x) for x in b.column(2).to_pylist()], width)
                bits = np.zeros((len(sets), 256), dtype=np.uint8)
                for i, s in enumerate(sets):
                    bits[i, (s[:K] & np.uint64(255)).astype(np.int64)] = 1
                maps = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        b.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([md5(s.tobytes()).digest() for s in sets], pa.binary()),
                        pa.array([s[:K].astype(np.int64) for s in sets], pa.list_(pa.int64())),
                        *(pa.array(np.ascontiguousarray(maps[:, i])) for i in range(4)),
                    ],
                    names=["doc_id", "text_hash", "n", "set_key", "sketch", *BITS],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text_bytes().alias("t"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, set_key binary, sketch array<long>, " + ", ".join(f"{c} long" for c in BITS))


def classes(rows: DataFrame) -> DataFrame:
    """One row for each distinct set, with a number of its own, its least row and how many rows it has."""
    first = lambda c: F.first(c).alias(c)
    out = rows.where("n > 0 and doc_id is not null").groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count("*").alias("rows"), *(first(c) for c in ("n", "sketch", *BITS))
    )
    return out.select(F.monotonically_increasing_id().alias("id"), "set_key", "least.doc_id", "least.text_hash", "rows", "n", "sketch", *BITS)


def _near_sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _alike(x: str, y: str) -> Column:
    """Whether the maps leave enough common values; values that fell on one bit are allowed for on either side."""
    common = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseAND(F.col(f"{y}.{c}"))) for c in BITS), F.lit(0))
    return common >= F.greatest(f"{x}.need", f"{y}.need") - F.least(f"{x}.lost", f"{y}.lost")


def listed(spark: SparkSession, reps: DataFrame, percent: int) -> DataFrame:
    """(v, id, n, place, need, lost, bits): every sketch under its rarest retained values, as far as others retain them too."""
    held = reps.select("id", F.explode("sketch").alias("v"))
    common = materialize(spark, held.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "near-values")
    most = hot_limit(common.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0])
    hot = common.where(F.col("df") > most)
    met = held.join(common.where(F.col("df") <= most), "v")
    if not hot.isEmpty():
        met = met.unionByName(held.join(F.broadcast(hot), "v"))
    met = met.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("l")).join(reps, "id")
    need = F.element_at(F.array(*[F.lit(needed(s, percent)) for s in range(1, K + 1)]), F.size("sketch"))
    lost = F.size("sketch") - sum((F.bit_count(c) for c in BITS), F.lit(0))
    alone = F.size("sketch") - F.size("l")
    room = F.size("sketch") - need + 1 - alone
    met = met.where(room > 0).select("id", "n", need.alias("need"), lost.alias("lost"), alone.alias("alone"), *BITS, F.posexplode(F.slice("l", F.lit(1), room)).alias("i", "x"))
    out = materialize(spark, met.select(F.col("x.v").alias("v"), "id", "n", (F.col("alone") + F.col("i")).alias("place"), "need", "lost", *BITS), "near-lists")
    drop_scratch(spark, common)
    return out


def likely(spark: SparkSession, pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the union's sketch leaves possible; ``sure`` where both sketches are whole sets."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    p = join_hot(spark, pairs.select("a", "b"), side("a"), "a").join(side("b"), "b")
    both, any_ = F.array_intersect("s_a", "s_b"), F.array_union("s_a", "s_b")
    whole = (F.col("n_a") <= K) & (F.col("n_b") <= K)
    p = p.select("a", "b", whole.alias("sure"), both.alias("both"), any_.alias("any"))
    least = F.slice(F.sort_array("any"), 1, K)
    exact = 100 * F.size("both") >= percent * F.size("any")
    near = F.size(F.array_intersect("both", least)) >= needed(K, percent)
    return p.where(F.when(F.col("sure"), exact).otherwise(near)).select("a", "b", "sure")


def texts_of(ids: DataFrame, few: bool, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, t): one text for each class in ``ids``; ``few`` says that they are at most BROADCAST_ROWS."""
    wanted = ids.join(reps.select("id", "doc_id", "text_hash"), "id")
    if few:
        wanted = F.broadcast(wanted)
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text_bytes().alias("t")).join(wanted, ["doc_id", "text_hash"])
    return found.groupBy("id").agg(F.first("t").alias("t"))


def confirmed(pairs: DataFrame, few: bool, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity.

    The text of ``a`` comes once for each group of its partners, then theirs; a worker holds one set of
    ``a`` and the sets of one slice of partners.
    """
    import pyarrow as pa

    def run(batches):
        import warnings

        import numpy as np

        warnings.simplefilter("ignore", RuntimeWarning)
        at, mine = None, None
        for whole in batches:
            for lo, hi in byte_groups(whole.column(3), TEXT_BYTES):
                x = whole.slice(lo, hi - lo)
                sets = shingle_sets([bytes(t) for t in x.column(3).to_pylist()], width)
                left, right = [], []
                for a, b, s in zip(x.column(0).to_pylist(), x.column(2).to_pylist(), sets):
                    if b is None:
                        at, mine = a, s
                        continue
                    assert a == at
                    same = len(np.intersect1d(mine, s, assume_unique=True))
                    if 100 * same >= percent * (len(mine) + len(s) - same):
                        left.append(a)
                        right.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    pairs = pairs.select("a", (F.abs(F.hash("b")) % SPREAD).alias("part"), "b")
    firsts = pairs.select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("id")).distinct()
    asked = firsts.unionByName(pairs.withColumn("id", F.col("b")))
    texts = texts_of(asked.select("id").distinct(), few, reps, docs)
    rows = asked.join(texts, "id").select("a", "part", "b", "t").repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


def _placed(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with their component ``c``."""
    return entries.join(labels.select("id", "component"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _prefixes(spark: SparkSession, open_ids: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(v, id, n, place, most): whole sets under their rarest values; a partner that they meet first at v has at most ``most`` shingles."""
    import pyarrow as pa

    def run(batches):
        import warnings

        import numpy as np

        warnings.simplefilter("ignore", RuntimeWarning)
        for whole in batches:
            for lo, hi in byte_groups(whole.column(1), TEXT_BYTES):
                b = whole.slice(lo, hi - lo)
                sets = shingle_sets([bytes(x) for x in b.column(1).to_pylist()], width)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "n", "whole"])

    few = open_ids.count() <= BROADCAST_ROWS
    sets = materialize(spark, texts_of(open_ids, few, reps, docs).mapInArrow(run, "id long, n long, whole array<long>"), "near-wholes")
    held = sets.select("id", "n", F.explode("whole").alias("v"))
    common = materialize(spark, held.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "near-values")
    most = hot_limit(common.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0])
    hot = common.where(F.col("df") > most)
    met = held.join(common.where(F.col("df") <= most), "v")
    if not hot.isEmpty():
        met = met.unionByName(held.join(F.broadcast(hot), "v"))
    met = met.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("l"))
    # At least ceil(similarity * n) values are shared, so one of the first n - that + 1 is.
    alone = F.col("n") - F.size("l")
    room = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone).cast("int")
    met = met.where(room > 0).select("id", "n", alone.alias("alone"), F.posexplode(F.slice("l", F.lit(1), room)).alias("i", "x"))
    place = F.col("alone") + F.col("i")
    # Shared values lie at this place or later: n - place >= similarity / (1 + similarity) * (both sizes).
    bound = F.floor((F.col("n") - place) * (100 + percent) / percent) - F.col("n")
    met = materialize(spark, met.select(F.col("x.v").alias("v"), "id", "n", place.alias("place"), bound.alias("most")), "near-prefixes")
    bounds = met.groupBy("v").agg(F.min("n").alias("least"))
    out = materialize(spark, join_hot(spark, met, bounds, "v").where(F.col("most") >= F.col("least")).drop("least"), "near-fits")
    drop_scratch(spark, sets, common, met)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(spark, sketches(docs, width), "near-sketches")
    reps = materialize(spark, classes(rows), "near-classes")
    entries = listed(spark, reps.where("n > 1").select("id", "n", "sketch", *BITS), percent)
    release_shuffles(spark)
    relieve(spark)

    def linked(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
        """The components after the links among ``pairs``."""
        p = materialize(spark, pairs, "near-pairs")
        if labels is not None and p.isEmpty():
            return labels
        p = materialize(spark, likely(spark, p, reps, percent), "near-likely")
        few = 2 * p.count() <= BROADCAST_ROWS
        checked = confirmed(p.where("not sure"), few, reps, docs, width, percent)
        return merged(spark, labels, materialize(spark, p.where("sure").select("a", "b").unionByName(checked), "near-links"))

    def pair(x: str, y: str) -> list[Column]:
        return [F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b")]

    # 1. Every member of a list and its pivot.
    pivots = entries.groupBy("v").agg(F.min(F.struct("place", "id", "n", "need", "lost", *BITS)).alias("p"))
    met = join_hot(spark, entries, pivots, "v").withColumn("m", F.struct("id", "n", "need", "lost", *BITS))
    met = met.where((F.col("id") != F.col("p.id")) & _near_sizes("m.n", "p.n", percent) & _alike("m", "p"))
    labels = linked(met.select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct(), None)

    # 2. Lists of several components, dealt by size: partners lie in one band or in neighbouring ones.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9) if percent < 100 else F.col("n")
    placed = _placed(entries, labels).withColumn("band", band.cast("long"))
    placed = placed.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("up")).withColumn("band", F.col("band") + F.col("up"))
    placed = materialize(spark, placed, "near-placed")
    parts = placed.groupBy("v", "band").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("up").alias("least"))
    parts = materialize(spark, parts.where("lo < hi and least = 0").select("v", "band", "k"), "near-parts")
    short = placed.join(parts.where(F.col("k") <= SHORT), ["v", "band"])
    short = materialize(spark, short, "near-short")
    x, y = short.where("up = 0").alias("x"), short.alias("y")
    other = (F.col("y.up") == 1) | (F.col("x.id") < F.col("y.id"))
    met = x.join(y, ["v", "band"]).where(other & (F.col("x.c") != F.col("y.c")) & _near_sizes("x.n", "y.n", percent) & _alike("x", "y"))
    pairs = met.select(*pair("x", "y"))

    # 3. Members of longer parts, by their whole sets: pivots with the pairs above, then what is still mixed.
    long_parts = parts.where(F.col("k") > SHORT).select("v", "band")
    wholes = None
    if not long_parts.isEmpty():
        open_ids = materialize(spark, placed.join(long_parts, ["v", "band"], "left_semi").select("id").distinct(), "near-open")
        wholes = _prefixes(spark, open_ids, reps, docs, width, percent)
        met = _mixed(spark, wholes, labels).where("apart").where((F.col("n") <= F.col("p.most")) & (F.col("p.n") <= F.col("most")))
        pairs = pairs.unionByName(met.select(F.col("p.id").alias("a"), F.col("id").alias("b")))
    labels = linked(pairs.distinct(), labels)
    drop_scratch(spark, placed, short, parts, entries)
    if wholes is not None:
        rest = materialize(spark, _mixed(spark, wholes, labels).drop("p"), "near-rest")
        # Of two components one at least isn't the pivot's: its members meet the list, the others don't meet each other.
        x, y = rest.where("apart").alias("x"), rest.alias("y")
        fit = (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most")) & _near_sizes("x.n", "y.n", percent)
        met = x.join(y, "v").where((F.col("x.c") != F.col("y.c")) & fit)
        labels = linked(met.select(*pair("x", "y")).distinct(), labels)

    # Rows of one id are one document, whatever their sets.
    several = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi")
    several = materialize(spark, several.select("doc_id"), "near-several")
    if not several.isEmpty():
        apart = rows.where("n > 0").join(several, "doc_id").select("doc_id", "set_key").distinct()
        apart = materialize(spark, apart.join(reps.select("set_key", "id"), "set_key").select("doc_id", "id"), "near-apart")
        firsts = apart.groupBy("doc_id").agg(F.min("id").alias("a"))
        found = join_hot(spark, apart, firsts, "doc_id").where("a <> id").select("a", F.col("id").alias("b"))
        labels = merged(spark, labels, materialize(spark, found, "near-links"))

    # A component's name is its least doc_id; classes of many rows are broadcast to them.
    named = materialize(spark, reps.select("id", "doc_id", "set_key", "rows").join(labels, "id", "left").withColumn("c", F.coalesce("component", "id")), "near-named")
    names = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = materialize(spark, join_hot(spark, named, names, "c").select("set_key", "rows", "component_id"), "near-components")
    most = hot_limit(named.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    hot = F.broadcast(named.where(F.col("rows") > most).select("set_key", "component_id"))
    own = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key"))
    out = own.join(hot, "set_key", "left").withColumnRenamed("component_id", "known")
    cold = named.where(F.col("rows") <= most).select("set_key", "component_id")
    out = out.withColumn("open", F.when(F.col("known").isNull() & F.col("doc_id").isNotNull(), F.col("set_key")))
    rest = out.where("open is not null").drop("known").join(cold, "set_key")
    done = out.where("open is null").withColumn("component_id", F.coalesce("known", "doc_id")).drop("known")
    out = done.unionByName(rest)
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _mixed(spark: SparkSession, entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of lists of several components: component ``c``, the middle ``p`` of the list, and whether they lie in another than it."""
    placed = materialize(spark, _placed(entries, labels), "near-placed")
    lists = placed.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct("place", "id", "n", "most", "c")).alias("p"))
    return join_hot(spark, placed, lists.where("lo < hi").select("v", "p"), "v").withColumn("apart", F.col("c") != F.col("p.c"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
