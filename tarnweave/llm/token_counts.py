"""Exact token counts at every prefix, by dynamic programming.

The last token of a prefix's encoding is unique: it is the token t ending there whose predecessor, the
last token of the prefix without t, stays unmerged beside it.  So one pass over a piece gives the count
of every prefix from those of shorter ones.  Between pieces the split pattern decides; prefixes that end
inside white space, a contraction or a special string are treated as the texts they are.

``prefix_counts`` stores, for each document, the change of the count from each code point to the next;
their running sum is the exact count of each prefix, so truncation and budget questions are answered from
the stored column without encoding anything again.

Null texts count as empty (no tokens).  Repeated rows, ties and further columns pass through row by row;
an empty table gives an empty result; texts of any length are processed whole.
"""

from __future__ import annotations

import json
from array import array
from operator import sub

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet, chunks, irregular, splitter
from .common import Memo, table, text_bytes, tokenizer_path, worker_cache

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: The Unicode property White_Space; of a piece, the last character tells.
SPACE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
_CONTRACTIONS = {"'re", "'ve", "'ll"}


class PrefixCounter:
    """Prefix counts under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_heads = {s[0] for s in self.special}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[raw(a), raw(b)] = n
        self.longest = max(map(len, self.vocab))
        self.split = splitter()
        self.prefixes: dict[bytes, tuple[bytes, int]] = {}
        self.stays = Memo(self._stays, 500_000)
        self.alone = Memo(lambda t: self._merged(t) == [t], 200_000)
        self.pieces = Memo(self._piece, 250_000)
        self.first = Memo(lambda c: None if irregular(c) else self.deltas(c), 100_000)
        self.rest = Memo(lambda c: None if irregular(c) else self.deltas(" " + c), 500_000)

    def _merged(self, text: bytes) -> list[bytes]:
        parts, get, none = [text[i : i + 1] for i in range(len(text))], self.rank.get, 1 << 60
        while len(parts) > 1:
            ranks = [get(p, none) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stays(self, pair: tuple[bytes, bytes]) -> bool:
        return self._merged(pair[0] + pair[1]) == [*pair]

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Token counts after each code point of one piece."""
        raw = piece.encode()
        n, vocab, stays, alone, longest = len(raw), self.vocab, self.stays, self.alone, self.longest
        if n <= 32:
            known = self.prefixes  # many words begin alike
            if len(known) >= 600_000:
                known.clear()
            k = n
            while k and raw[:k] not in known:
                k -= 1
            for i in range(k + 1, n + 1):
                for a in range(i):
                    if (t := raw[a:i]) in vocab:
                        if not a:
                            if alone[t]:
                                known[raw[:i]] = t, 1
                                break
                        else:
                            last, c = known[raw[:a]]
                            if stays[last, t]:
                                known[raw[:i]] = t, c + 1
                                break
            count = [0, *[known[raw[:i]][1] for i in range(1, n + 1)]]
        else:
            last, count = [b""], [0]
            for i in range(1, n + 1):
                for a in range(i - longest if i > longest else 0, i):
                    if (t := raw[a:i]) in vocab and (stays[last[a], t] if a else alone[t]):
                        last.append(t)
                        count.append(count[a] + 1)
                        break
        if len(raw) == len(piece):
            return tuple(count[1:])
        out, at = [], 0
        for c in piece:
            at += len(c.encode())
            out.append(count[at])
        return tuple(out)

    def counts(self, text: str) -> list[int]:
        """Token counts after each code point of a text without special strings."""
        out: list[int] = []
        base, run, run_base = 0, "", 0
        found = self.split(text)
        if len(found) == 1 and text[-1] not in SPACE and text not in _CONTRACTIONS:
            return [*self.pieces[text]]
        for p in found:
            if p[-1] in SPACE:
                # White space: a prefix that ends in the run has the run so far as one piece.
                if not run:
                    run_base = base
                run += p
                got = self.pieces[run]
                out += [run_base + c for c in got[-len(p) :]]
                base += self.pieces[p][-1]
                continue
            got = self.pieces[p]
            if p in _CONTRACTIONS:
                one = self.pieces["'"][-1]
                got = (one, one + self.pieces[p[1]][-1], got[-1])
            if run and p[0] == " ":
                out.append(run_base + self.pieces[run + " "][-1])
                out += [base + c for c in got[1:]]
            else:
                out += [base + c for c in got]
            base += got[-1]
            run = ""
        return out

    def deltas(self, text: str) -> bytes:
        """Changes of the count at each code point, as native 16-bit integers."""
        parts: list[int] = []
        base, rest = 0, text
        while rest:
            places = [(at, -len(s), s) for s in self.special if (at := rest.find(s)) >= 0] if any(c in rest for c in self.special_heads) else None
            if not places:
                parts += [base + c for c in self.counts(rest)] if base else self.counts(rest)
                break
            at, _, s = min(places)
            parts += [base + c for c in self.counts(rest[: at + len(s) - 1])]
            base = (base + self.counts(rest[:at])[-1] if at else base) + 1
            parts.append(base)
            rest = rest[at + len(s) :]
        return array("h", map(sub, parts, [0, *parts[:-1]])).tobytes()

    def document(self, text: str) -> bytes:
        if not text:
            return b""
        head, *tail = chunks(text)
        try:
            return b"".join([self.first[head], *map(self.rest.__getitem__, tail)])
        except TypeError:  # a cut that isn't safe
            return self.deltas(text)


def counter(vocabulary: str) -> PrefixCounter:
    return worker_cache(("prefix-counter", vocabulary), lambda: PrefixCounter(tokenizer_path(vocabulary)))


def prefix_counts(docs: DataFrame, vocabulary: str = VOCABULARY, keep_prefixes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens[, deltas]): deltas holds a 16-bit change of the count for each code point."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np

        of = counter(vocabulary).document
        for b in batches:
            raw = [bytes(x) for x in b.column(1).to_pylist()]
            found = [of(x.decode("utf-8", "replace")) for x in raw]
            cols = [b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([int(np.frombuffer(d, "i2").sum(dtype=np.int64)) for d in found], pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens"]
            if keep_prefixes:
                cols, names = [*cols, pa.array(found, pa.binary())], [*names, "deltas"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {kind}, n_bytes long, n_tokens long" + ", deltas binary" * keep_prefixes
    return docs.select("doc_id", text_bytes().alias("t")).mapInArrow(run, schema)


def tokens_at(deltas: bytes, code_points: int) -> int:
    """The exact token count of a document's first ``code_points`` characters."""
    import numpy as np

    return int(np.frombuffer(deltas, "i2")[:code_points].sum(dtype=np.int64))


def longest_prefix_within(deltas: bytes, budget: int) -> int:
    """The most characters that a truncated text may have without exceeding ``budget`` tokens."""
    import numpy as np

    fits = np.flatnonzero(np.cumsum(np.frombuffer(deltas, "i2"), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def truncate_to_budget(docs: DataFrame, counted: DataFrame, budget: int) -> DataFrame:
    """(doc_id, text) cut to the longest prefix within the budget; ``counted`` is what prefix_counts returned."""
    cut = F.pandas_udf(lambda s: s.map(lambda d: longest_prefix_within(bytes(d), budget)), "long")
    at = counted.select("doc_id", cut("deltas").alias("_n"))
    return docs.join(at, "doc_id").select("doc_id", F.substring("text", F.lit(1), F.col("_n").cast("int")).alias("text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_counts(table(spark, sf_dir, "documents"), keep_prefixes=False)
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
