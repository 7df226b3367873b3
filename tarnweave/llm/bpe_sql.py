"""Byte-level BPE encoding and decoding by recursive queries in an embedded DuckDB, one per partition.

The split pattern's matches are encoded once for each distinct match: rows of (word, position, token)
join the merge table, every step contracts the leftmost pair of least rank in each word, and a word
leaves the recursion when no pair is left.  Decoding joins the tokens with their bytes and aggregates
them in order.  A document's ids are those of its matches in order.

Matches longer than ``LONG`` bytes (one step for each merge would read them quadratically often) are
merged by an exact heap instead.  Null texts count as empty: no ids, no bytes.  Repeated rows, ties and
further columns pass through row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import irregular, merge, splitter
from .common import Aged, byte_groups, joined, strings, table, text_bytes, tokenizer_path, worker_cache

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG = 48

#: A row is a token at the place of its last byte with its right neighbour; ``best`` is the rank and place of the pair to
#: contract.  The merged token takes the right one's row, the left one's row goes, and the row before points to the new token.
#: The rows of a word without such a pair come once more as final ones.
ENCODE = """
WITH RECURSIVE step(w, pos, tok, next, after, final) AS (
    SELECT w, pos, tok, next, after, false FROM symbols
  UNION ALL
    SELECT s.w, s.pos,
           CASE WHEN s.pos = c.gone THEN c.id ELSE s.tok END,
           CASE WHEN s.after = c.place THEN c.id ELSE s.next END,
           CASE WHEN s.after = c.place THEN c.gone ELSE s.after END,
           c.w IS NULL
    FROM step s LEFT JOIN (
        SELECT w, gone, (best >> 32)::INTEGER AS id, (best & 4294967295)::INTEGER AS place
        FROM (
            SELECT p.w, min((m.id::BIGINT << 32) | p.pos) AS best, arg_min(p.after, (m.id::BIGINT << 32) | p.pos) AS gone
            FROM step p JOIN merges m ON m.a = p.tok AND m.b = p.next WHERE NOT p.final GROUP BY p.w
        )
    ) c ON c.w = s.w
    WHERE NOT s.final AND s.pos IS DISTINCT FROM c.place
)
SELECT s.w, t.digits, t.bytes FROM step s JOIN tokens t ON t.id = s.tok WHERE s.final ORDER BY s.w, s.pos
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}


class SqlBpe:
    """Texts to ids and decoded bytes, through one DuckDB connection and one memo of words for each worker.

    A batch of texts is cut into chunks, chunks into words, and both are numbered by their distinct values
    as whole arrays; Python sees only the distinct ones.
    """

    def __init__(self, path: str, limit: int = 120_000, batch: int = 5_000):
        import duckdb
        import pyarrow as pa

        self.rank = read_ranks(path)
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.batch, self.split = batch, splitter()
        self.words = Aged(limit)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        # rank = id, and any split of a token into two tokens is a pair that merges into it
        a, b, ids = [], [], []
        for t, i in self.rank.items():
            for k in range(1, len(t)):
                x, y = self.rank.get(t[:k]), self.rank.get(t[k:])
                if x is not None and y is not None:
                    a.append(x)
                    b.append(y)
                    ids.append(i)
        merges = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "id": pa.array(ids, pa.int32())})  # noqa: F841
        numbers = self.rank.values()
        tokens = pa.table({"id": pa.array(numbers, pa.int32()), "digits": pa.array([str(i).encode() for i in numbers]), "bytes": pa.array([*self.rank], pa.binary())})  # noqa: F841
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.con.execute("CREATE TABLE tokens AS SELECT * FROM tokens")

    def encode_words(self, words: list[str]) -> None:
        """Put the words' ids and decoded bytes into the memo."""
        import numpy as np
        import pyarrow as pa

        single = np.array([self.rank[bytes([x])] for x in range(256)], dtype=np.int32)
        known, short = self.words.young, []
        for w in words:
            raw = w.encode()
            if len(raw) > LONG:
                ids = merge(raw, self.rank)
                known[w] = ",".join(map(str, ids)).encode(), b"".join(map(self.bytes_of.__getitem__, ids))
            else:
                short.append((w, raw))
        for at in range(0, len(short), self.batch):
            part = short[at : at + self.batch]
            sizes = np.array([len(r) for _, r in part])
            total = int(sizes.sum())
            ends = np.cumsum(sizes)
            tok = single[np.frombuffer(b"".join(r for _, r in part), dtype=np.uint8)]
            pos = (np.arange(total) - np.repeat(ends - sizes, sizes)).astype(np.int32)
            final = np.zeros(total, dtype=bool)
            final[ends - 1] = True
            symbols = pa.table(  # noqa: F841
                {
                    "w": np.repeat(np.arange(len(part), dtype=np.int32), sizes),
                    "pos": pos,
                    "tok": tok,
                    "next": pa.array(np.append(tok[1:], 0).astype(np.int32), mask=final),
                    "after": pos + 1,
                }
            )
            got = self.con.sql(ENCODE).to_arrow_table().combine_chunks()
            starts = np.searchsorted(got.column(0).to_numpy(), np.arange(len(part) + 1))
            ids, decoded = (joined(starts, got.column(k).cast(pa.large_binary()).combine_chunks(), between) for k, between in ((1, b","), (2, b"")))
            known.update(zip([w for w, _ in part], zip(ids.to_pylist(), decoded.to_pylist())))

    def _word_arrays(self, words: list[str]):
        """The words' ids as decimals joined by commas, and the bytes that these decode to."""
        import pyarrow as pa

        numbered = pa.array(words, pa.string()).dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        self.words.age()
        new = self.words.missing(distinct)
        self.encode_words(new)
        got = [*map(self.words.young.__getitem__, distinct)]
        for w in [w for w in new if len(w) > LONG]:  # the memo counts words, so long ones don't stay
            del self.words.young[w]
        return [pa.array([g[k] for g in got], pa.large_binary()).take(numbered.indices) for k in (0, 1)]

    def documents(self, texts):
        """For an Arrow column of strings the ids as decimals joined by commas, and the bytes that the ids decode to."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = pc.split_pattern(texts, " ")
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        numbered = parts.flatten().dictionary_encode()
        distinct, code = numbered.dictionary.to_pylist(), numbered.indices.to_numpy().astype(np.int64)
        unsafe = np.array([*map(irregular, distinct)], dtype=bool)
        whole = np.logical_or.reduceat(unsafe[code], starts)  # texts with a cut that isn't safe are split as they are
        # The units are the distinct chunks and, for each text, its first chunk (which no space precedes) or all of it.
        # All chunks are split in one go; the first word of each starts with the space before it, and no other word does.
        regular = [c for c, u in zip(distinct, unsafe.tolist()) if not u]
        words = self.split(" " + " ".join(regular)) if regular else []
        first = np.flatnonzero(pc.starts_with(pa.array(words, pa.string()), " ").to_numpy(zero_copy_only=False))
        units = np.zeros(len(distinct) + len(texts), dtype=np.int64)
        units[: len(distinct)][~unsafe] = np.diff(np.append(first, len(words)))
        for i, (w, c) in enumerate(zip(whole.tolist(), code[starts].tolist()), len(distinct)):
            own = self.split(texts[i - len(distinct)].as_py() if w else distinct[c])
            units[i] = len(own)
            words += own
        code[starts] = len(distinct) + np.arange(len(starts))
        keep = np.repeat(~whole, sizes)
        keep[starts] = True
        order, ends = pa.array(code[keep]), np.cumsum(np.append(0, np.where(whole, 1, sizes)))
        bounds = np.cumsum(np.append(0, units))
        return [joined(ends, joined(bounds, x, by).take(order), by) for x, by in zip(self._word_arrays(words), (b",", b""))]


def encoder(ranks: str) -> SqlBpe:
    return worker_cache(("sql-bpe", ranks), lambda: SqlBpe(tokenizer_path(ranks)))


def _each(docs: DataFrame, ranks: str, schema: str, make) -> DataFrame:
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        e = encoder(ranks)
        for whole in batches:
            for lo, hi in byte_groups(whole.column(1)):
                b = whole.slice(lo, hi - lo)
                columns = make(*e.documents(strings(b.column(1))))
                yield pa.RecordBatch.from_arrays([b.column(0), *columns.values()], names=["doc_id", *columns])
                del columns
                pa.default_memory_pool().release_unused()

    return docs.select("doc_id", text_bytes().alias("t")).mapInArrow(run, f"doc_id {kind}, {schema}")


def _counts(ids):
    """How many ids each row of decimals joined by commas has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.add(pc.count_substring(ids, ","), pc.greater(pc.binary_length(ids), 0).cast(pa.int64())).cast(pa.int64())


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, decoded string): the decoded text is the ids' bytes put together again."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def make(ids, decoded):
        n = _counts(ids)
        some = ids.filter(pc.greater(n, 0)).cast(pa.large_string())
        values = pc.split_pattern(some, ",").flatten().cast(pa.int32())
        offsets = np.cumsum(np.append(0, n.to_numpy())).astype(np.int32)
        return {"ids": pa.ListArray.from_arrays(pa.array(offsets), values), "n_tokens": n, "decoded": decoded.cast(pa.large_string()).cast(pa.string())}

    return _each(docs, ranks, "ids array<int>, n_tokens long, decoded string", make)


def digests(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    import pyarrow as pa
    from hashlib import sha256

    def make(ids, decoded):
        hashes = [pa.array([sha256(x).hexdigest() for x in column.to_pylist()], pa.string()) for column in (ids, decoded)]
        return {"n_tokens": _counts(ids), "ids_sha256": hashes[0], "decoded_sha256": hashes[1]}

    return _each(docs, ranks, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
