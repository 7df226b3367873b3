"""The contracts of the corpus queries, worked out row by row without Spark."""

import hashlib
import re
import zlib
from collections import Counter


def rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols, dups = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines))
    base = n < 20 or 100 * len(hit) > 30 * n
    kept = not (base or 10 * symbols > n or chars < 3 * n or chars > 12 * n or 2 * dups > len(lines))
    return n, chars, symbols, dups, len(hit), base, kept


def plain_words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def contamination(texts, items):
    """(n_words, n_hit, n_items, items_sha256, contaminated) of each text."""
    windows = {}
    for item, t in items:
        w = plain_words(t)
        if w and item is not None:
            n = min(8, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes, out = {len(k) for k in windows}, []
    for t in texts:
        w, hit, named = plain_words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    named |= got
        out.append((len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), len(named) >= 2))
    return out


def shingles(t, width=2):
    w = (t or "").encode().lower().split()
    return set(zip(*(w[k:] for k in range(width)))) or ({tuple(w)} if w else set())


def components(rows, width=2, percent=80):
    """{id: least id reachable} over rows (id, text); rows of one id are one document."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    comp = {i: i for i, _ in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                comp[hi] = lo
    return {i: root(i) for i in comp}


def repeats(rows, span=50):
    """For each row (id, text) the places that go; rows without id take no part."""
    first, out = {}, []
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, t in raws:
        for p in range(len(t) - span + 1) if i is not None else ():
            k = t[p : p + span]
            first[k] = min(first.get(k, i), i)
    for i, t in raws:
        gone, end = [], 0
        for p in range(len(t) - span + 1) if i is not None else ():
            if first[t[p : p + span]] < i:
                gone.append((max(p, end), p + span))
                end = p + span
        flags = bytearray(len(t))
        for a, z in gone:
            flags[a:z] = b"\1" * (z - a)
        kept = bytes(c for c, f in zip(t, flags) if not f)
        runs = len(re.findall(rb"\x01+", bytes(flags)))
        out.append((len(t), sum(flags), runs, kept))
    return out


def crc(b):
    return zlib.crc32(b)


def sha(b):
    return hashlib.sha256(b).hexdigest()
