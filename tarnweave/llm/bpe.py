"""Common parts of the byte-level BPE operators: the split pattern, chunks and plain merging."""

from __future__ import annotations

import heapq

#: The split of text before the merges, with white space spelled out as the Unicode property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def splitter():
    import regex

    return regex.compile(PATTERN).findall


def chunks(text: str) -> list[str]:
    """Cut before every single space that stands between two other characters; a piece never spans such a cut.

    The first chunk lacks the leading space that the others start with (it is left out of them here).
    Chunks that are empty or end in white space show that a cut is not safe; see ``irregular``.
    """
    return text.split(" ")


def irregular(chunk: str) -> bool:
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Exact byte-pair merging of one piece in O(n log n): least rank first, leftmost of equals."""
    if (whole := rank.get(piece)) is not None and len(piece) == 1:
        return [whole]
    n = len(piece)
    end, nxt, prv, live = [i + 1 for i in range(n)], [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n

    def pair(i):
        j = nxt[i]
        return rank.get(piece[i : end[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, to = heapq.heappop(heap)
        if not live[i] or nxt[i] >= n or end[nxt[i]] != to:
            continue
        j = nxt[i]
        live[j] = False
        end[i], nxt[i] = end[j], nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        if (s := pair(i)) is not None:
            heapq.heappush(heap, (s, i, end[nxt[i]]))
        if (p := prv[i]) >= 0 and (s := pair(p)) is not None:
            heapq.heappush(heap, (s, p, end[i]))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : end[i]]])
        i = nxt[i]
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + n)] = b
            n += 1
    return out
