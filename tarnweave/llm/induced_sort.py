"""Suffix arrays by induced sorting, in whole-array steps, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the end counts as smallest."""
    n = len(s)
    ends = np.append(np.flatnonzero(s[1:] != s[:-1]), n - 1)
    small = np.zeros(len(ends), dtype=bool)
    small[:-1] = s[ends[:-1]] < s[ends[:-1] + 1]
    return np.repeat(small, np.diff(ends, prepend=-1))


def _deal(at: np.ndarray, s: np.ndarray, buckets: list) -> None:
    """Append positions to the bucket of their first byte, in order."""
    if not len(at):
        return
    c = s[at]
    order = np.argsort(c, kind="stable")
    at, c = at[order], c[order]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    for first, part in zip([0, *cuts.tolist()], np.split(at, cuts)):
        buckets[c[first]].append(part)


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in order: larger ones first, then smaller ones."""
    left: list[list] = [[] for _ in range(256)]
    right: list[list] = [[] for _ in range(256)]
    start: list[list] = [[] for _ in range(256)]
    _deal(lms, s, start)
    large = ~small
    left[s[-1]].append(np.array([len(s) - 1], dtype=lms.dtype))

    def push(at, mask, buckets):
        p = at - 1
        p = p[p >= 0]
        _deal(p[mask[p]], s, buckets)

    def waves(buckets, c, mask):
        """Everything in a bucket in order; runs of one byte add to their own bucket, wave after wave."""
        k = 0
        while k < len(buckets[c]):
            wave = np.concatenate(buckets[c][k:])
            buckets[c][k:] = [wave]
            k += 1
            push(wave, mask, buckets)

    for c in range(256):
        waves(left, c, large)
        if start[c]:
            push(np.concatenate(start[c]), large, left)
    for c in range(255, -1, -1):
        waves(right, c, small)
        if left[c]:
            push(np.concatenate(left[c])[::-1], small, right)
    out = []
    for c in range(256):
        out += left[c]
        out += [part[::-1] for part in reversed(right[c])]
    return np.concatenate(out)


def _sorted_names(names: np.ndarray, rounds: int) -> np.ndarray:
    """Order of the suffixes of the reduced text, by doubling the sorted length."""
    n, step = len(names), 1
    rank = names.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    for _ in range(rounds):
        if n == 0 or rank[order[-1]] == n - 1 and len(np.unique(rank)) == n:
            break
        behind = np.zeros(n, dtype=np.int64)
        behind[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(key, kind="stable")
        k = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.cumsum(np.append(False, k[1:] != k[:-1]))
        rank, step = fresh, step * 2
    return order


def suffix_array(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of the bytes ``s`` in order; with ``depth``, suffixes equal that far may stand in any order.

    Suffixes are classified, leftmost-smaller substrings are sorted by induction and named, the text of
    their names is sorted the same way down to distinct names (neighbouring names lie at least two bytes
    apart, so ``depth`` bounds the rounds), and the whole array is induced from them.
    """
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = suffix_types(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        rough = induce(s, small, lms)
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        rough = rough[is_lms[rough]]
        size = np.zeros(n, dtype=np.int32)  # a leftmost-smaller substring reaches to the next one, inclusive
        size[lms[:-1]] = np.diff(lms) + 1
        size[lms[-1]] = n - lms[-1] + 1
        a, b = rough[:-1], rough[1:]
        same = (size[a] == size[b]) & (a != lms[-1]) & (b != lms[-1])
        live, k = np.flatnonzero(same), 0
        while len(live):
            x, y = a[live], b[live]
            equal = s[x + k] == s[y + k]
            same[live[~equal]] = False
            k += 1
            live = live[equal & (size[x] > k)]
        name = np.zeros(n, dtype=np.int64)
        name[rough] = np.cumsum(np.append(False, ~same))
        names = name[lms]
        rounds = 64 if depth is None else max(1, depth // 2).bit_length()
        lms = lms[_sorted_names(names, rounds)]
    return induce(s, small, lms)


def common_prefixes(s: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each of the ordered suffixes the length, at most ``cap``, that it shares with the one before it.

    Lengths are found in text order ("permuted"), eight bytes at a time, and put back in suffix order.
    """
    n = len(s)
    pad = np.concatenate([s, np.zeros(8 + cap, dtype=np.uint8)])
    word = np.empty(n + cap, dtype=np.uint64)
    for k in range(8):
        whole = np.frombuffer(pad.tobytes(), dtype="<u8", offset=k, count=(len(pad) - k) // 8)
        part = word[k::8]
        part[:] = whole[: len(part)]
    shared = np.zeros(n, dtype=np.int32)
    if len(order) < 2:
        return np.zeros(len(order), dtype=np.int32)
    text_order = np.argsort(order[1:])
    here, before = order[1:][text_order], order[:-1][text_order]
    live = np.arange(len(here))
    for k in range(0, cap, 8):
        x = word[here[live] + k] ^ word[before[live] + k]
        bits = x & (~x + np.uint64(1))  # lowest differing bit
        got = np.where(x == 0, 8, np.log2(np.maximum(bits, 1).astype(np.float64)).astype(np.int32) // 8)
        shared[here[live]] += got
        live = live[x == 0]
        if not len(live):
            break
    room = n - np.maximum(here, before)
    shared[here] = np.minimum(np.minimum(shared[here], room), cap)
    return np.append(0, shared[order[1:]]).astype(np.int32)
