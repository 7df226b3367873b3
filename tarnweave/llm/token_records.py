"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A data set is a folder of ``part-NNNNNN.rec`` files and an ``index`` table.  A record is

    length   8 bytes, little-endian, of the payload
    check    4 bytes, masked CRC-32 of the length's bytes
    payload  doc id (8 bytes, signed), flags (1 byte), token ids (2 or 4 bytes each)
    check    4 bytes, masked CRC-32 of the payload

The mask rotates the checksum by 15 bits and adds a constant, so that records which hold checksums stay
distinguishable.  Flag 1 marks a null doc id, flag 2 ids of four bytes.  Rows are in ascending doc id
(nulls first); rows of one id are in order of their text's hash, then text.  The index has each record's
file, place, length and token count, so that shuffled readers seek to the records they want.

Every document gets an end token, so null and empty texts give records of one id.  Repeated rows give
repeated records; an empty table gives an empty index.  Texts are encoded whole; extra columns are ignored.

A task writes under a name of its own attempt and renames the finished file, so a repeated task
replaces the file by the same bytes.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import Aged, byte_groups, joined, release_shuffles, scratch, strings, table, text_bytes, tokenizer_path, worker_cache, write_once

VOCABULARY = "word_bpe_49k.json"
END = 1
LONG = 48
_INDEX = "file int, seq long, doc_id long, offset long, length long, n_tokens long"


#: Chunks of these characters are already in composed form, and this is how the vocabulary splits them once lower-cased.
_PLAIN = r"\A[!-~À-ÖØ-öø-ÿ]+\z"
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+|\n").findall


class ChunkEncoder:
    """Token ids of whole texts; texts are cut at spaces, which this vocabulary's split drops anyway.

    Chunks and words of a batch are numbered by their distinct values as whole arrays.  Chunks of common
    characters are split into words, and new words go to the library's merge model.  Other chunks go
    through the whole library as they are.
    """

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.words, self.others = Aged(limit), Aged(limit // 4)
        vocabulary = self.tok.get_vocab()
        self.wide = max(vocabulary.values()) > 0xFFFF
        self.spelling = {b: c for c, b in byte_alphabet().items()}
        self.plain = json.loads(self.tok.to_str())["model"].get("end_of_word_suffix") == "</w>"

    def _values(self, memo: Aged, keys, learn):
        """The ids of each of the keys, an Arrow column, as bytes."""
        import pyarrow as pa

        numbered = keys.dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        memo.age()
        new = memo.missing(distinct)
        learn(new)
        out = pa.array([*map(memo.young.__getitem__, distinct)], pa.large_binary()).take(numbered.indices)
        for k in [k for k in new if len(k) > LONG]:  # the memo counts keys, so long ones don't stay
            del memo.young[k]
        return out

    def _learn_words(self, new: list[str]) -> None:
        code, tokenize, spelling, known = "I" if self.wide else "H", self.tok.model.tokenize, self.spelling, self.words.young
        for w in new:
            spelt = w if w.isascii() else w.encode().decode("latin-1").translate(spelling)
            known[w] = array(code, [t.id for t in tokenize(spelt)]).tobytes()

    def _learn_others(self, new: list[str]) -> None:
        code, known = "I" if self.wide else "H", self.others.young
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for c, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                known[c] = array(code, e.ids).tobytes()

    def encode(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow column of strings, as bytes."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = pc.split_pattern(texts, " ")
        numbered = parts.flatten().dictionary_encode()
        chunks = numbered.dictionary
        plain = pc.and_(pc.match_substring_regex(chunks, _PLAIN), pc.invert(pc.match_substring(chunks, "<|")))
        if not self.plain:
            plain = pc.and_(plain, pa.scalar(False))
        # All plain chunks are split in one go, with a line feed, which none of them holds, after each.
        words = pa.array(_WORDS("\n".join([*chunks.filter(plain).to_pylist(), ""]).lower()), pa.string())
        feed = pc.equal(words, "\n").to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(feed)
        ends -= np.arange(len(ends))
        words = words.filter(pa.array(~feed))
        values = pa.concat_arrays(
            [
                joined(np.append(0, ends), self._values(self.words, words, self._learn_words), b""),
                self._values(self.others, chunks.filter(pc.invert(plain)), self._learn_others),
            ]
        )
        is_plain = plain.to_numpy(zero_copy_only=False)
        place = np.where(is_plain, np.cumsum(is_plain) - 1, is_plain.sum() + np.cumsum(~is_plain) - 1)
        order = pa.array(place[numbered.indices.to_numpy()])
        return joined(np.cumsum(np.append(0, pc.list_value_length(parts).to_numpy(zero_copy_only=False))), values.take(order), b"").to_pylist()


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = struct.pack("<qB", doc_id or 0, (doc_id is None) | wide << 1) + ids
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_record(stream) -> tuple[int | None, bytes, bool] | None:
    """The next (doc id, ids, wide), or None at the end; a damaged record raises ValueError."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record length")
    n = struct.unpack("<Q", head[:8])[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("damaged record")
    doc_id, flags = struct.unpack("<qB", body[:9])
    return None if flags & 1 else doc_id, body[9:n], bool(flags & 2)


def part_name(folder: str, n: int) -> str:
    return f"{folder}/part-{n:06d}.rec"


def open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_records(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Write the data set and return its index (file, seq, doc_id, offset, length, n_tokens)."""
    text = text_bytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "t").select("doc_id", "t")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        encoder = worker_cache(("records", vocabulary), lambda: ChunkEncoder(tokenizer_path(vocabulary)))
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        n, final = context.partitionId(), struct.pack("<I" if encoder.wide else "<H", end)
        own = f"{path}/.part-{n:06d}-{context.taskAttemptId()}"
        offset = seq = 0
        out = None
        try:
            for b in batches:
                if out is None:
                    out = store.open_output_stream(own, buffer_size=1 << 20)
                index = []
                for lo, hi in byte_groups(b.column(1), 8 << 20):
                    part = b.slice(lo, hi - lo)
                    for d, e in zip(part.column(0).to_pylist(), encoder.encode(strings(part.column(1)))):
                        r = frame(d, e + final, encoder.wide)
                        out.write(r)
                        index.append((n, seq, d, offset, len(r), len(e) // len(final) + 1))
                        offset += len(r)
                        seq += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*index), [pa.int32(), *[pa.int64()] * 5])], names=["file", "seq", "doc_id", "offset", "length", "n_tokens"]
                ) if index else pa.RecordBatch.from_pylist([], schema=_arrow_index())
        finally:
            if out is not None:
                out.close()
        if out is not None:
            store.move(own, part_name(path, n))

    write_once(spark, rows.mapInArrow(run, _INDEX), f"{folder}/index")
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def _arrow_index():
    import pyarrow as pa

    return pa.schema([("file", pa.int32()), *[(c, pa.int64()) for c in ("seq", "doc_id", "offset", "length", "n_tokens")]])


def scan_records(spark: SparkSession, folder: str, make, schema: str) -> DataFrame:
    """Read whole files in their order: ``make(start, [(doc_id, ids, wide), ...])`` gives Arrow columns.

    ``start`` counts the tokens of all earlier records.  One row for each file goes through a running sum;
    a file is read by one task, record after record.
    """
    import pyarrow as pa

    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        store, path = open_store(folder)
        for b in batches:
            for f, start in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_stream(part_name(path, f), buffer_size=1 << 20) as stream:
                    more = True
                    while more:
                        held, size = [], 0
                        while size < 8 << 20:
                            r = read_record(stream)
                            if r is None:
                                more = False
                                break
                            held.append(r)
                            size += len(r[1])
                        if held:
                            columns, count = make(start, held)
                            start += count
                            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return files.repartition(n, "file").mapInArrow(run, schema)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) from the files, in no particular order."""
    import numpy as np
    import pyarrow as pa

    def make(start, held):
        ids = [np.frombuffer(r[1], "<u4" if r[2] else "<u2").astype(np.int32) for r in held]
        return {"doc_id": pa.array([r[0] for r in held], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))}, sum(map(len, ids))

    return scan_records(spark, folder, make, "doc_id long, ids array<int>")


def read_shuffled(spark: SparkSession, folder: str, seed: int, tasks: int) -> DataFrame:
    """(task, at, doc_id, ids): a seeded order over all records, dealt to ``tasks`` readers that seek by the index."""
    import pyarrow as pa

    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    key = F.xxhash64(F.lit(seed), "file", "seq")
    order = index.select("file", "offset", "length", F.pmod(key, F.lit(tasks)).cast("int").alias("task"), key.alias("key"))
    order = order.repartition(tasks, "task").sortWithinPartitions("task", "key")

    def run(batches):
        import numpy as np
        from io import BytesIO

        store, path = open_store(folder)
        opened: dict[int, object] = {}
        at: dict[int, int] = {}
        for b in batches:
            rows = []
            for f, offset, length, task, _ in zip(*(c.to_pylist() for c in b.columns)):
                if f not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    opened[f] = store.open_input_file(part_name(path, f))
                doc_id, ids, wide = read_record(BytesIO(opened[f].read_at(length, offset)))
                at[task] = at.get(task, -1) + 1
                rows.append((task, at[task], doc_id, np.frombuffer(ids, "<u4" if wide else "<u2").astype(np.int32)))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["task", "at", "doc_id", "ids"])

    return order.mapInArrow(run, "task int, at long, doc_id long, ids array<int>")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    folder = scratch(spark, "token-records")
    write_records(spark, table(spark, sf_dir, "documents"), folder)
    release_shuffles(spark)

    def make(start, held):
        starts, counts, sums = [], [], []
        for _, ids, wide in held:
            ids = ids if wide else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            starts.append(start)
            counts.append(len(ids) // 4)
            sums.append(zlib.crc32(ids))
            start += counts[-1]
        cols = {"doc_id": [r[0] for r in held], "start": starts, "n_tokens": counts, "ids_crc32": sums}
        return {k: pa.array(v, pa.int64()) for k, v in cols.items()}, sum(counts)

    return scan_records(spark, folder, make, "doc_id long, start long, n_tokens long, ids_crc32 long")
