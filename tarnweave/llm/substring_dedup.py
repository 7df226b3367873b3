"""Removal of repeated substrings through suffix arrays.

A byte is removed if it is covered by a string of SPAN bytes that also starts in a document of smaller
id; strings are judged on the input and never cross documents.

1. Every window of SPAN bytes holds an anchor, the run of GRAM bytes of least hash in it, which depends
   on the window's content alone, and at least HALF bytes on the left or on the right of it.  Anchors are
   dealt by hash; those that no other document has with the same HALF bytes on one side are done with
   (short anchors alone meet by chance, the more often the more documents there are).
2. Documents get back which of their anchors are shared, and send the bytes around them (every window
   that holds the anchor) to the anchor's shard.  Equal surroundings are settled at once: all but those
   of the smallest document are covered.
3. What differs around one anchor is sorted: a shard builds a suffix array of the distinct surroundings
   by induced sorting, and permuted common prefixes tell which windows also start in a smaller document.
4. The covered intervals are joined to the documents.

Anchors and surroundings of one batch of documents are collapsed before they are sent, so a passage in a
third of all documents costs a shard one entry for each batch.  Steps are written to the shared folder.

Null texts count as empty.  Rows without id are left as they are and remove nothing; rows of one id
never remove from each other.  Texts shorter than SPAN bytes keep everything.  Further columns of the
input are kept by ``remove_repeats`` and ignored by the query.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table, text_bytes, uncollected, worker_cache, wrapped

SPAN, GRAM = 50, 25
REACH = SPAN - GRAM  # bytes on either side of an anchor that a window may hold
HALF = (REACH + 1) // 2  # of these it holds so many on one side at least
SORT_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15
_PACKED = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"
_DONE, _ASK = 0, 1


def _sliding(x, width: int, pick):
    """Least or largest of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def _rolling(buf, *widths: int) -> list:
    """64-bit hashes of every run of so many bytes, by doubling; one array for each width."""
    import numpy as np

    block, size, p = buf.astype(np.uint64) + np.uint64(1), 1, _P
    out, taken, n = [None] * len(widths), [0] * len(widths), max(widths)
    while n:
        for k, w in enumerate(widths):
            if w & size:
                if out[k] is None:
                    out[k], taken[k] = block, size
                else:
                    m = len(buf) - taken[k] - size + 1
                    out[k] = out[k][:m] * np.uint64(p) + block[taken[k] : taken[k] + m]
                    taken[k] += size
        n >>= 1
        if n:
            block = block[:-size] * np.uint64(p) + block[size:]
            p, size = p * p & (1 << 64) - 1, size * 2
    return out


def _mix(h):
    import numpy as np

    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _side(rolled, at, ok):
    """16 bits of the HALF bytes at each place, and 0 where there are none."""
    import numpy as np

    return np.where(ok, _mix(rolled[np.where(ok, at, 0)]) % np.uint64(0xFFFF) + np.uint64(1), np.uint64(0))


def anchors(texts: list[bytes]):
    """(text number, place, hash, key) of every anchor: in each window the grams of least hash, all ties.

    A key has 32 bits of the gram and 16 of the bytes on each side of it.
    """
    import numpy as np

    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    if len(buf) < SPAN:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    h, half = _rolling(buf, GRAM, HALF)
    h = _mix(h)
    order = (h >> np.uint64(32)).astype(np.uint32)  # half a hash decides, which is four times as fast to compare
    least = _sliding(order, REACH + 1, np.minimum)
    # A gram is chosen if it is the least of some window around it.
    edge = np.zeros(REACH, dtype=np.uint32)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), REACH + 1, np.maximum) == order)
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, at, side="right")
    ok = (at + GRAM <= ends[doc]) & (sizes[doc] >= SPAN)
    at, doc = at[ok], doc[ok]
    place, h = at - (ends - sizes)[doc], h[at]
    left = _side(half, at - HALF, place >= HALF)
    right = _side(half, at + GRAM, at + GRAM + HALF <= ends[doc])
    return doc, place, h, h << np.uint64(32) | left << np.uint64(16) | right


def _groups(batch, most: int = 1 << 19):
    """Row ranges of a batch with at most so many bytes of text (or one row)."""
    sizes = [len(x) if x is not None else 0 for x in batch]
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if sizes:
        yield lo, len(sizes)


def _rows(rows: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*rows)) if rows else [[]] * 7
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bucket", "kind", "a", "b", "c", "d", "e"])


def _runs(sorted_values):
    """Starts of the runs of equal values."""
    import numpy as np

    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, dtype=np.int64)


def _by_owner(ids, keys, *values):
    """Split parallel arrays by (id, key): rows of (id, key, values...) as bytes."""
    import numpy as np

    order = np.lexsort((keys, ids))
    ids, keys, values = ids[order], keys[order], [v[order] for v in values]
    starts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))) if len(ids) else []
    for lo, hi in zip(starts, [*starts[1:], len(ids)]):
        yield int(ids[lo]), int(keys[lo]), *[v[lo:hi].tobytes() for v in values]


def _to_owners(ids, keys, n_buckets: int, *values):
    """Parallel arrays as one packed row for each bucket of documents: owners, how many values each has, the values."""
    import numpy as np

    bucket = (keys.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
    order = np.lexsort((keys, ids, bucket))
    ids, keys, bucket, values = ids[order], keys[order], bucket[order], [v[order] for v in values]
    new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))) if len(ids) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(ids))).astype(np.int32)
    starts = _runs(bucket)
    for lo, hi in zip(starts, [*starts[1:], len(ids)]):
        a, z = np.searchsorted(new, (lo, hi))
        owner = np.stack([ids[new[a:z]], keys[new[a:z]]], axis=1)
        yield (int(bucket[lo]), _DONE, owner.tobytes(), counts[a:z].tobytes(), *[v[lo:hi].tobytes() for v in values], *[b""] * (3 - len(values)))


def _owned(a: bytes, b: bytes):
    """The ids and keys of a packed row, repeated for each value."""
    import numpy as np

    owner, counts = np.frombuffer(a, np.int64).reshape(-1, 2), np.frombuffer(b, np.int32)
    return np.repeat(owner[:, 0], counts), np.repeat(owner[:, 1], counts)


def _one_row_each(schema_names: list[str], kinds: list):
    """Packed rows of one bucket of documents to one row for each document."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, keys, values = [], [], [[] for _ in kinds]
        for batch in batches:
            for a, b, *v in zip(*(batch.column(i).to_pylist() for i in range(2, 4 + len(kinds)))):
                i, k = _owned(a, b)
                ids.append(i)
                keys.append(k)
                for held, x, kind in zip(values, v, kinds):
                    held.append(np.frombuffer(x, kind))
        if not ids:
            return
        out = list(_by_owner(np.concatenate(ids), np.concatenate(keys), *map(np.concatenate, values)))
        for lo in range(0, len(out), 2000):
            cols = list(zip(*out[lo : lo + 2000]))
            types = [pa.int64(), pa.int64(), *[pa.binary()] * len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "text_key", *schema_names])

    return run


def _anchor_batches(n_buckets: int):
    """Documents to packed (hash, document) entries for each bucket; what a batch itself shows to be shared is done."""

    def run(batches):
        import numpy as np

        np.seterr(over="ignore")
        worker_cache("repeats", dict)  # other operators' memos go
        for b in slices(batches, 1 << 16):  # places within one batch take two bytes
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = [bytes(x) for x in b.column(2).to_pylist()]
            docs, hashes = [], []
            for lo, hi in _groups(texts):
                d, _, _, h = anchors(texts[lo:hi])
                docs.append(d.astype(np.int32) + lo)
                hashes.append(h)
            d, h = np.concatenate(docs), np.concatenate(hashes)
            order = np.lexsort((ids[d], h))
            d, h = d[order], h[order]
            once = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, dtype=bool)
            d, h = d[once], h[once]
            starts = _runs(h)
            sizes = np.diff(np.append(starts, len(h)))
            first = np.repeat(starts, sizes)
            last = np.repeat(starts + sizes - 1, sizes)
            shared = ids[d[first]] != ids[d[last]]
            out = list(_to_owners(ids[d[shared]], keys[d[shared]], n_buckets, h[shared]))
            ask = np.zeros(len(h), dtype=bool)
            ask[starts] = True  # one entry speaks for a shared anchor,
            same_id = ~shared  # rows of one id speak each for themselves
            ask |= same_id
            d, h = d[ask], h[ask]
            bucket = ((h >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)  # by the gram alone
            order = np.lexsort((d, bucket))
            d, h, bucket = d[order], h[order], bucket[order]
            starts = _runs(bucket)
            for lo, hi in zip(starts, [*starts[1:], len(h)]):
                own, place = np.unique(d[lo:hi], return_inverse=True)
                out.append((int(bucket[lo]), _ASK, h[lo:hi].tobytes(), place.astype(np.uint16).tobytes(), ids[own].tobytes(), keys[own].tobytes(), b""))
            yield _rows(out)

    return run


def _mixed(values, ids):
    """Whether each of the sorted values stands beside more than one id."""
    import numpy as np

    starts = _runs(values)
    sizes = np.diff(np.append(starts, len(values)))
    return np.repeat(ids[starts] != ids[starts + sizes - 1], sizes)


def _answer(n_buckets: int):
    """Which entries of a bucket have a gram and one side of it that other documents have too, packed by document."""

    def run(batches):
        import numpy as np

        hashes, ids, keys, known = [], [], [], [[], [], []]
        for batch in batches:
            for kind, a, b, c, d in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                if kind == _DONE:
                    for held, x in zip(known, (*_owned(a, b), np.frombuffer(c, np.uint64))):
                        held.append(x)
                    continue
                place = np.frombuffer(b, np.uint16)
                hashes.append(np.frombuffer(a, np.uint64))
                ids.append(np.frombuffer(c, np.int64)[place])
                keys.append(np.frombuffer(d, np.int64)[place])
        if hashes:
            h, i, k = np.concatenate(hashes), np.concatenate(ids), np.concatenate(keys)
            del hashes, ids, keys
            order = np.lexsort((i, h >> np.uint64(32)))
            h, i, k = h[order], i[order], k[order]
            met = _mixed(h >> np.uint64(32), i)
            h, i, k = h[met], i[met], k[met]
            shared = np.zeros(len(h), dtype=bool)
            low = np.uint64(0xFFFF)
            for side, rest in ((h >> np.uint64(16) & low, h >> np.uint64(16)), (h & low, h >> np.uint64(32) << np.uint64(16) | h & low)):
                order = np.lexsort((i, rest))
                order = order[side[order] > 0]
                shared[order[_mixed(rest[order], i[order])]] = True
            for held, x in zip(known, (i[shared], k[shared], h[shared])):
                held.append(x)
        if known[0]:
            i, k, h = map(np.concatenate, known)
            yield _rows(list(_to_owners(i, k, n_buckets, h)))

    return run


def _surroundings(n_buckets: int):
    """Documents and their shared anchors to packed surroundings for each bucket."""

    def run(batches):
        import numpy as np

        np.seterr(over="ignore")
        worker_cache("repeats", dict)  # other operators' memos go
        for b in slices(batches, 1 << 12):  # a dictionary holds all surroundings of one
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = [bytes(x) for x in b.column(2).to_pylist()]
            known = [np.unique(np.frombuffer(x, np.uint64)) for x in b.column(3).to_pylist()]
            numbers = ids.tolist()
            best: dict[tuple, tuple] = {}
            covered, sent = [], []
            for lo, hi in _groups(texts):
                doc, at, h, v = anchors(texts[lo:hi])
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    own = known[lo + i]
                    if a == z or not len(own):
                        continue
                    slot = np.minimum(np.searchsorted(own, v[a:z]), len(own) - 1)
                    hit = own[slot] == v[a:z]
                    t, n, d = texts[lo + i], lo + i, numbers[lo + i]
                    for p, x in zip(at[a:z][hit].tolist(), h[a:z][hit].tolist()):
                        s = p - REACH if p > REACH else 0
                        key = (x, p - s, t[s : p + SPAN])
                        got = best.setdefault(key, d)
                        if type(got) is int:  # this one's own id: the first of its kind
                            best[key] = (d, [(n, s)])
                        elif d == got[0]:
                            got[1].append((n, s))
                        elif d > got[0]:
                            covered.append((n, s, s + len(key[2])))
                        else:
                            covered += [(m, q, q + len(key[2])) for m, q in got[1]]
                            best[key] = (d, [(n, s)])
            out = []
            if covered:
                n, s, e = (np.array(x) for x in zip(*covered))
                out += _to_owners(ids[n], keys[n], n_buckets, s.astype(np.int32), e.astype(np.int32))
            buckets: dict[int, list] = {}
            for (x, lead, ctx), (_, places) in best.items():
                buckets.setdefault(x % n_buckets, []).extend((x, n, s, lead, ctx) for n, s in places)
            for bucket, rows in buckets.items():
                x, n, s, lead, ctx = zip(*rows)
                own, place = np.unique(np.array(n), return_inverse=True)
                owner = np.stack([ids[own], keys[own]], axis=1)
                spot = np.stack([place, np.array(s)], axis=1).astype(np.int32)
                shape = np.array([lead, [*map(len, ctx)]], dtype=np.uint8)
                out.append((bucket, _ASK, np.array(x, dtype=np.uint64).tobytes(), owner.tobytes(), spot.tobytes(), shape.tobytes(), zlib.compress(b"".join(ctx), 1)))
            yield _rows(out)

    return uncollected(run)


def _met_windows(s, ends, who):
    """For each of the texts that end at ``ends`` in ``s`` the first and last window whose hash texts of another id have; -1 for none."""
    import numpy as np

    first, last = np.full(len(ends), -1), np.full(len(ends), -1)
    if len(s) < SPAN:
        return first, last
    at = np.arange(len(s) - SPAN + 1)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(at)]
    inside = at + SPAN <= ends[owner]
    at, owner, h = at[inside], owner[inside], _rolling(s, SPAN)[0][inside]
    order = np.argsort(h, kind="stable")
    h, ids = h[order], who[owner[order]]
    starts = _runs(h)
    if len(starts):
        mixed = np.repeat(np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts), np.diff(np.append(starts, len(h))))
        hit = np.sort(order[mixed])
        new = _runs(owner[hit])
        first[owner[hit[new]]] = at[hit[new]]
        stop = np.append(new[1:], len(hit)) - 1 if len(new) else new
        last[owner[hit[stop]]] = at[hit[stop]]
    return first, last


def _covered_windows(groups: list[list[tuple[int, bytes]]]):
    """(group, member, start, end) of runs of windows that a member of smaller id in any group has as well.

    ``groups`` holds (id, surroundings) pairs.  What lies between the first and the last window of equal
    hash in each is sorted in one suffix array, which compares the bytes.
    """
    import numpy as np

    from .induced_sort import common_prefixes, suffix_array

    np.seterr(over="ignore")
    flat = [(g, m, i, c) for g, members in enumerate(groups) for m, (i, c) in enumerate(members)]
    sizes = np.array([len(x[3]) for x in flat])
    ends = np.cumsum(sizes)
    first, last = _met_windows(np.frombuffer(b"".join(x[3] for x in flat), dtype=np.uint8), ends, np.array([x[2] for x in flat]))
    flat, lead, stop = zip(*[(x, a, z) for x, a, z in zip(flat, (first - ends + sizes).tolist(), (last - ends + sizes + SPAN).tolist()) if z >= SPAN]) if (first >= 0).any() else ((), (), ())
    if not flat:
        return []
    s = np.frombuffer(b"".join(x[3][a:z] for x, a, z in zip(flat, lead, stop)), dtype=np.uint8)
    sizes = np.array(stop) - np.array(lead)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(flat)), sizes)
    order = suffix_array(s, SPAN)
    order = order[order + SPAN <= ends[owner[order]]]
    shared = common_prefixes(s, order, SPAN)
    starts = np.flatnonzero(shared < SPAN)
    if not len(starts):
        return []
    who = np.array([x[2] for x in flat])[owner[order]]
    least = np.minimum.reduceat(who, starts)
    at = np.sort(order[who > np.repeat(least, np.diff(np.append(starts, len(order))))]).astype(np.int64)
    if not len(at):
        return []
    o = owner[at]
    new = np.append(True, (np.diff(at) > 1) | (o[1:] != o[:-1]))
    o, at, to = o[new], at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + SPAN
    shift = np.array(lead)[o] - (ends - sizes)[o]
    return [(flat[x][0], flat[x][1], p, q) for x, p, q in zip(o.tolist(), (at + shift).tolist(), (to + shift).tolist())]


def _settle(n_buckets: int):
    """Covered intervals of one shard's surroundings, packed by document."""
    return uncollected(lambda batches: _settled(batches, n_buckets))


def _settled(batches, n_buckets: int):
    import numpy as np

    found: dict[int, dict[tuple, list]] = {}
    ids_, keys_, starts_, ends_, done = [], [], [], [], [[], [], [], []]
    for b in batches:
        for kind, a, o, sp, sh, text in zip(*(b.column(i).to_pylist() for i in range(1, 7))):
            if kind == _DONE:
                for held, v in zip(done, (*_owned(a, o), np.frombuffer(sp, np.int32), np.frombuffer(sh, np.int32))):
                    held.append(v)
                continue
            hashes = np.frombuffer(a, np.uint64).tolist()
            owner = np.frombuffer(o, np.int64).reshape(-1, 2).tolist()
            spot = np.frombuffer(sp, np.int32).reshape(-1, 2).tolist()
            lead, size = np.frombuffer(sh, np.uint8).reshape(2, -1).tolist()
            text, at = zlib.decompress(text), 0
            for x, (place, s), w, n in zip(hashes, spot, lead, size):
                ctx = text[at : at + n]
                at += n
                i, k = owner[place]
                group = found.setdefault(x, {})
                got = group.get((w, ctx))
                if got is None:
                    group[w, ctx] = [i, [(k, s)]]
                elif i == got[0]:
                    got[1].append((k, s))
                else:
                    late = [(i, k, s)] if i > got[0] else [(got[0], *p) for p in got[1]]
                    if i < got[0]:
                        group[w, ctx] = [i, [(k, s)]]
                    for j, q, z in late:
                        ids_.append(j)
                        keys_.append(q)
                        starts_.append(z)
                        ends_.append(z + n)

    def worth_sorting(group):
        """A window around the anchor reaches past it by half of REACH on one side, so two surroundings that
        share a window agree on that much on the left or on the right."""
        half = HALF
        left, right = {}, {}
        for w, c in group:
            if w >= half:
                left[c[w - half : w]] = left.get(c[w - half : w], 0) + 1
            if len(c) >= w + GRAM + half:
                right[c[w + GRAM : w + GRAM + half]] = right.get(c[w + GRAM : w + GRAM + half], 0) + 1
        return {k: v for k, v in group.items() if left.get(k[1][max(0, k[0] - half) : k[0]], 0) > 1 or right.get(k[1][k[0] + GRAM : k[0] + GRAM + half], 0) > 1}

    def sort(groups):
        members = [[(v[0], c) for (_, c), v in g.items()] for g in groups]
        places = [list(g.values()) for g in groups]
        for g, m, a, z in _covered_windows(members):
            i, spots = places[g][m]
            for k, s in spots:
                ids_.append(i)
                keys_.append(k)
                starts_.append(s + a)
                ends_.append(s + z)

    part, size = [], 0
    for group in found.values():
        if len(group) > 1 and (group := worth_sorting(group)):
            n = sum(len(c) for _, c in group)
            if part and size + n > SORT_BYTES:
                sort(part)
                part, size = [], 0
            part.append(group)
            size += n
    if part:
        sort(part)
    if ids_:
        for held, v, kind in zip(done, (ids_, keys_, starts_, ends_), (np.int64, np.int64, np.int32, np.int32)):
            held.append(np.array(v, dtype=kind))
    if done[0]:
        i, k, a, z = map(np.concatenate, done)
        yield _rows(list(_to_owners(i, k, n_buckets, a, z)))


def merged(starts: bytes | None, ends: bytes | None) -> list[tuple[int, int]]:
    """Maximal covered runs."""
    import numpy as np

    if not starts:
        return []
    a, z = np.frombuffer(starts, np.int32), np.frombuffer(ends, np.int32)
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    new = np.append(True, a[1:] > z[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
    return list(zip(a[new].tolist(), z[last].tolist()))


def covered_intervals(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, starts, ends), packed 32-bit places, of every document with covered bytes."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where("doc_id is not null and octet_length(text) >= %d" % SPAN)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_bytes().alias("t"))
    packed = rows.mapInArrow(_anchor_batches(n), _PACKED).repartitionById(n, F.col("bucket"))
    owners = packed.mapInArrow(_answer(n), _PACKED).repartitionById(n, F.col("bucket"))
    shared = owners.mapInArrow(_one_row_each(["shared"], ["u8"]), "doc_id long, text_key long, shared binary")
    shared = materialize(spark, shared, "repeat-anchors")
    packed = rows.join(shared, ["doc_id", "text_key"]).mapInArrow(_surroundings(n), _PACKED).repartitionById(n, F.col("bucket"))
    owners = packed.mapInArrow(_settle(n), _PACKED).repartitionById(n, F.col("bucket"))
    spans = owners.mapInArrow(_one_row_each(["starts", "ends"], ["i4", "i4"]), "doc_id long, text_key long, starts binary, ends binary")
    return materialize(spark, spans, "repeat-spans")


def _with_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(row, starts, ends): every row of ``docs`` as a struct, with the packed places of what goes."""
    spans = covered_intervals(spark, docs.select("doc_id", "text"))
    rows = wrapped(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("text_key"))
    return rows.join(spans, ["doc_id", "text_key"], "left").select("row", "starts", "ends")


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with the text that is left; characters that a cut splits are dropped whole."""
    import pyarrow as pa

    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in slices(batches, 2048):
            row, texts = b.column(0), []
            for t, s, e in zip(row.field(at).cast(pa.binary()).to_pylist(), *(b.column(i).to_pylist() for i in (1, 2))):
                texts.append(None if t is None else kept_bytes(t, merged(s, e)).decode("utf-8", "ignore"))
            cols = [row.field(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return _with_spans(spark, docs).mapInArrow(run, docs.schema)


def kept_bytes(t: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in runs:
        out.append(t[at:s])
        at = e
    out.append(t[at:])
    return b"".join(out)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = _with_spans(spark, docs).select("row.doc_id", text_bytes("row.text").alias("t"), "starts", "ends")

    def run(batches):
        for b in slices(batches, 2048):
            n, gone, runs_, sha = [], [], [], []
            for t, s, e in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                t, runs = bytes(t), merged(s, e)
                n.append(len(t))
                gone.append(sum(z - a for a, z in runs))
                runs_.append(len(runs))
                sha.append(hashlib.sha256(kept_bytes(t, runs)).hexdigest())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs_, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
