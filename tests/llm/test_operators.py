"""The corpus operators against brute force on small inputs with nulls, empties, ties and repeats."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.llm import bpe_sql, decontamination, near_dedup, quality_rules, sharding, substring_dedup, token_counts, token_records, toxicity, warc_audit
from tarnweave.llm.common import byte_groups, scratch, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, n long"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    words = [a + b for a in ("on", "the", "re", "Ünd", "ça", "x'll") for b in ("ble", "ing", "s.", "!", "é", "")]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randint(20, 90))) for _ in range(24)]
    out += [out[0], out[1] + " tail", out[2].replace(" ", "  ", 3), out[3] + "\n" + out[3], None, "", "one", " \t\n", "z" * 400, out[4][:200] + out[5]]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)] + [(None, "no id at all", "en", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_records_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(token_records.VOCABULARY))
    folder = scratch(spark, "records")
    index = token_records.write_records(spark, docs, folder)
    got = {r.doc_id: r.ids for r in token_records.read_tokens(spark, folder).collect()}
    assert got == {r.doc_id: r.ids for r in token_records.read_shuffled(spark, folder, 1, 3).collect()}
    assert index.count() == len(texts) + 1
    for i, t in enumerate(texts):
        assert got[i] == [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    from io import BytesIO

    frame = bytearray(token_records.frame(7, b"\1\0\2\0", False))
    assert token_records.read_record(BytesIO(bytes(frame))) == (7, b"\1\0\2\0", False)
    frame[15] ^= 1
    with pytest.raises(ValueError):
        token_records.read_record(BytesIO(bytes(frame)))


def test_record_chunks():
    """Every kind of chunk, in groups of any size, with memos that are far too small and never hold long words."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    rnd = random.Random(8)
    pieces = ["a", "Ab'll", " ", "  ", "\n", "\t", "\u00a0", "é", "É", "ÿß", "×÷", "e\u0301", "字", "🙂", "'S", "7", "x.y", "…", "<|", "<|endoftext|>", "</w>", "q" * 60, "Σς", "ſ", "12"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + ["", " ", "  ", "a", " a", "a ", "w" * 300]
    texts += [" ".join(f"w{rnd.randrange(10**6):x}" for _ in range(40)) for _ in range(200)]
    path = tokenizer_path(token_records.VOCABULARY)
    tok = Tokenizer.from_file(path)
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    own, column = token_records.ChunkEncoder(path, limit=1000), pa.array(texts, pa.string())
    for most in (1, 5_000, 1 << 20):
        got, held = [], []
        for lo, hi in byte_groups(column.cast(pa.binary()), most):
            got += own.encode(column.slice(lo, hi - lo))
            held.append(len(own.words.young) + len(own.words.old))
            assert all(len(w) <= token_records.LONG for m in (own.words, own.others) for w in m.young)
        assert got == want
        assert most > 5_000 or max(held) < 4000  # one group's words beyond the limit


def test_audit_finds_damage(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i % 5}", "<p>" * i) for i in range(300)] + [(None, None, None)] * 2, "page_id long, url string, html string")
    hurt = pages.withColumn("html", F.when(F.col("page_id").isin(5, 77), F.lit("bad")).otherwise(F.col("html")))
    a, b = (warc_audit.layout(spark, x, 100) for x in (pages, hurt))
    bad = warc_audit.audit(spark, warc_audit.tree(spark, a), warc_audit.tree(spark, b))
    assert {r.page_id for r in a.join(bad.withColumnRenamed("node", "seq"), ["file", "seq"]).collect()} >= {5, 77}
    assert warc_audit.audit(spark, warc_audit.tree(spark, a), warc_audit.tree(spark, a)).count() == 0


def test_rules(spark, docs, texts):
    import re
    from collections import Counter

    got = {r.doc_id: r for r in quality_rules.ledger(docs).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
    assert quality_rules.ablations(quality_rules.ledger(docs)).count() == 5 and quality_rules.ledger(none(spark)).count() == 0


def test_prefix_counts(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(token_counts.VOCABULARY))
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    got = {r.doc_id: r for r in token_counts.prefix_counts(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert (got[i].n_tokens, got[i].n_bytes) == (n(t), len(t.encode()))
        for k in range(1, min(len(t), 90)):
            assert token_counts.tokens_at(bytes(got[i].deltas), k) == n(t[:k])
        fit = token_counts.longest_prefix_within(bytes(got[i].deltas), 5)
        assert n(t[:fit]) <= 5


def test_decontamination(spark, docs, texts):
    items = [(1, texts[6][30:160]), (2, texts[7]), (3, "one"), (4, None), (4, "x y"), (None, texts[8])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = dict(enumerate(brute.contamination(texts, items)))
    for block in (200_000, 20):
        got = {r.doc_id: (r.n_words, len(r.hit), len(r["items"])) for r in decontamination.find_contamination(spark, docs, bench, block).collect()}
        assert {i: got[i] for i in want} == {i: v[:3] for i, v in want.items()}
    assert decontamination.find_contamination(spark, docs, bench.limit(0)).where("size(items) > 0").count() == 0


def test_near_duplicates(spark, docs, texts):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(w, w[1:])) or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark, docs).collect()}
    assert {i: got[i] for i in sets} == {i: (len(sets[i]), comp[i]) for i in sets} and got[None][1] is None


def test_bpe(docs, texts):
    import public_tokenizers
    import tiktoken

    ranks = bpe_sql.read_ranks(tokenizer_path(bpe_sql.RANKS))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe_sql.encode(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == enc.encode_ordinary(t or "") and got[i].decoded == (t or "")


def test_bpe_cuts():
    """Every kind of cut, in groups of any size, with a memo that is far too small and never holds long words."""
    import public_tokenizers
    import pyarrow as pa
    import tiktoken

    rnd = random.Random(6)
    pieces = ["a", "Ab'll", " ", "  ", "\n", "\t", "\u00a0", "\x1f", "\x85", "é", "字", "🙂", "'s", "7", "x.y", "…", "", "zz " * 9, "q" * 60, "x'"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + ["", " ", "  ", "a", " a", "a ", "w" * 300]
    texts += [" ".join(f"w{rnd.randrange(10**6):x}" for _ in range(40)) for _ in range(200)]
    path = tokenizer_path(bpe_sql.RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_sql.read_ranks(path), special_tokens={})
    own, column = bpe_sql.SqlBpe(path, limit=1000, batch=700), pa.array(texts, pa.string())
    for most in (1, 5_000, 1 << 20):
        got, held = [], []
        for lo, hi in byte_groups(column.cast(pa.binary()), most):
            got += zip(*(x.to_pylist() for x in own.documents(column.slice(lo, hi - lo))))
            held.append(len(own.words.young) + len(own.words.old))
            assert all(len(w) <= bpe_sql.LONG for w in own.words.young)
        assert got == [(",".join(map(str, enc.encode_ordinary(t))).encode(), t.encode()) for t in texts]
        assert most > 5_000 or max(held) < 4000  # one group's words beyond the limit


def test_shards(spark, docs):
    for shards, bin_rows in ((16, 100_000), (3, 4)):
        got = sharding.hypergeometric_shards(spark, docs, shards, rows_per_bin=bin_rows).collect()
        sizes = {}
        for r in got:
            sizes.setdefault(r.shard, []).append(r.slot)
        assert len(got) == docs.count() and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    m = sharding.communication_matrix([5, 0, 9], [5, 5, 4], 1)
    assert [sum(r) for r in m] == [5, 0, 9] and [sum(c) for c in zip(*m)] == [5, 5, 4]
    assert sharding.hypergeometric_shards(spark, none(spark)).count() == 0


def test_toxicity(spark):
    rnd = random.Random(2)
    plain = [f"w{i}" for i in range(60)]

    def text(bad):
        s = [" ".join(rnd.choice(plain) for _ in range(8)) for _ in range(rnd.randint(2, 9))]
        return ". ".join(s[:1] + (["you vile" + rnd.choice("abcd") + " crooks"] if bad else []) + s[1:])

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(toxicity.training_sample(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")))
    got = toxicity.score(docs, model).where(toxicity.held_out()).collect()
    assert np.mean([(r.toxicity >= 0.7) == r.toxic for r in got]) > 0.95
    found = toxicity.locate(docs.where("doc_id = 0").select("doc_id", "text"), model).collect()
    assert [r.sentence for r in found] == [1]
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "...")], "doc_id long, text string")
    assert [r.toxicity for r in toxicity.score(odd, model).collect()] == [0.0] * 3 and toxicity.fit([]) == {}


def test_repeats(docs, spark, texts):
    first = {}
    raw = [(t or "").encode() for t in texts]
    for i, t in enumerate(raw):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(spark, docs).collect()}
    for i, t in enumerate(raw):
        gone = set()
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone.update(range(p, p + 50))
        kept = bytes(c for p, c in enumerate(t) if p not in gone).decode("utf-8", "ignore")
        assert (got[i] or "") == kept
    assert got[None] == "no id at all" and hashlib.sha256(b"").hexdigest()[:4] == "e3b0" and zlib.crc32(b"") == 0


def test_repeats_met_by_chance():
    """Documents that share runs of 25 to 40 bytes at most ask for nothing; windows at every distance from an edge are found."""
    rnd = random.Random(9)
    line = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n)).encode()
    passage, long = line(30), line(50)
    rows = [(i, line(60) + passage + line(60)) for i in range(80)]
    rows += [(100 + k, line(k) + long + line(60 - k)) for k in range(0, 61, 3)] + [(200, long), (201, long), (202, long[:49])]
    import pyarrow as pa

    def steps(rows):
        names = ["doc_id", "text_key", "t"]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int64()), pa.array([r[0]], pa.int64()), pa.array([r[1]], pa.binary())], names=names) for r in rows]
        packed = [b for x in batches for b in substring_dedup._anchor_batches(1)([x])]
        return [b for b in substring_dedup._one_row_each(["shared"], ["u8"])(substring_dedup._answer(1)(packed))]

    assert {i for b in steps(rows) for i in b.column(0).to_pylist()} == {i for i, _ in rows if 100 <= i < 202}
    lone = substring_dedup._covered_windows([[(2, long + b"x"), (1, b"y" + long), (3, line(60)), (1, long)]])
    assert lone == [(0, 0, 0, 50)]
    two = line(70)
    assert substring_dedup._covered_windows([[(1, two)], [(5, b"?" + two[:60]), (4, two[10:])]]) == [(1, 0, 1, 61), (1, 1, 0, 60)]
