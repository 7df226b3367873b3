"""Every opN query and the pipeline over whole small tables, all contract columns against brute force or the named library."""

import random
from collections import Counter

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnweave.llm import near_dedup, toxicity
from tarnweave.llm.common import byte_groups, tokenizer_path
from tarnweave.llm.queries import ORACLE_SQL, QUERIES

CLASHING = "row key t n_words hit items toxicity n starts ends text_key _raw _key set_key shard slot kept".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n):
    return " ".join(rnd.choice(("on", "the", "re", "Ünd", "ça")) + rnd.choice(("ble", "ing", "s.", "!", "é", "x'll", "7")) for _ in range(n))


def corpus():
    rnd = random.Random(11)
    base = [words(rnd, rnd.randint(25, 120)) for _ in range(30)]
    near = base[3].split()
    out = list(enumerate(base))
    out += [(40, base[0]), (41, base[1] + " tail"), (42, " ".join(near[:-2] + ["other", "end"])), (43, base[4] + "\n" + base[4])]
    out += [(44, None), (45, ""), (46, " \t\r\n"), (47, "one"), (48, "z" * 700), (49, "see [a] and [b] # x <b> $5 | 100% & * more"), (50, "<|endoftext|> a\0b <|startoftext|>")]
    out += [(51, words(rnd, 9000)), (52, base[5]), (52, base[5]), (53, base[6] + " zz yy"), (53, "entirely " + base[7] + " now"), (54, base[7])]
    out += [(None, base[8]), (None, None), (55, "字" * 300 + " 漢字かな 🙂" * 20), (56, base[9] + "  " + base[10]), (57, "\n".join(["same line"] * 30))]
    out += [(60 + i, words(rnd, 40) + (". you vile crooks" if i % 2 else "")) for i in range(60)]
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


def store(spark, folder, rows, benchmark, labels, pages):
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)
    docs.select("*", *[F.lit("x").alias(c) for c in CLASHING]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, rows, tmp_path_factory):
    items = [(1, rows[6][1][30:160]), (2, rows[7][1]), (3, "one"), (4, None), (4, "x y"), (None, rows[8][1]), (5, ""), (6, rows[7][1])]
    labels = [(i, 1, int(i % 2)) for i in range(60, 120)] + [(60, 1, None), (61, 0, 1), (None, 0, 1)]
    pages = [(i, f"http://h/{i % 5}", "é<p>" * (i % 7)) for i in range(240)] + [(108, "?", "?"), (7, "u", None), (7, None, ""), (None, None, None)]
    return store(spark, tmp_path_factory.mktemp("odd"), rows, items, labels, pages), items, pages


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return store(spark, tmp_path_factory.mktemp("none"), [], [], [], [])


def run(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


def same(got, want):
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, empty, name):
    assert (corpus_pipeline.run if name == "pipeline" else QUERIES[name])(spark, empty).count() == 0


def test_op1(spark, odd, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")) for i, t in rows]
    got = run(spark, "op1_token_records", odd[0])
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(i, len(x), brute.crc(x.tobytes())) for i, x in ids])
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (last is None or r.doc_id is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id


def test_op2(spark, odd):
    import pyarrow as pa

    pages = pa.table({c: pa.array([p[k] for p in odd[2]], t) for k, (c, t) in enumerate((("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())))})  # noqa: F841
    want = duckdb.connect().sql(ORACLE_SQL["op2_merkle_audit"]).fetchall()
    got = [tuple(r) for r in run(spark, "op2_merkle_audit", odd[0])]
    same(got, want)
    assert sum(r[-1] for r in got) == sum((p[0] or 0) % 101 == 7 for p in odd[2])


def test_op3(spark, odd, rows):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in run(spark, "op3_quality_rules", odd[0])]
    same(got, [(i, *brute.rules(t)) for i, t in rows])


def test_op4(spark, odd, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op4_token_counts", odd[0])]
    same(got, [(i, len((t or "").encode()), count(t), count(t) > 1024) for i, t in rows])


def test_op5(spark, odd, rows):
    got = [(r.doc_id, r.n_words, r.n_hit, r["n_items"], r.items_sha256, r.contaminated) for r in run(spark, "op5_decontamination", odd[0])]
    same(got, [(i, *x) for (i, _), x in zip(rows, brute.contamination([t for _, t in rows], odd[1]))])


def test_op6(spark, odd, rows):
    comp = brute.components(rows)
    assert comp[53] == 6 and comp[54] == 6 and comp[7] == 6  # two texts under one id
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in run(spark, "op6_near_dedup", odd[0])]
    same(got, [(i, len(brute.shingles(t)), comp.get(i), i is None or comp[i] == i) for i, t in rows])


def test_near_groups(spark):
    """A large group of near copies with members just out of reach, for other widths and similarities."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(260):
        w = list(base)
        for p in rnd.sample(range(120), k % 24):
            w[p] = f"x{rnd.randrange(4000)}"
        texts.append((k * 3, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for width, percent in ((2, 80), (5, 60)):
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark, docs, width, percent).collect()}
        assert got == brute.components(texts, width, percent)


def tiktoken_encoding(name="byte_bpe_multi_50k.tiktoken"):
    import public_tokenizers
    import tiktoken

    from tarnweave.llm.bpe_sql import read_ranks

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(tokenizer_path(name)), special_tokens={})


def test_op7(spark, odd, rows):
    enc = tiktoken_encoding()
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op7_bpe", odd[0])]
    ids = [(i, (t or "").encode(), enc.encode_ordinary(t or "")) for i, t in rows]
    same(got, [(i, len(x), brute.sha(",".join(map(str, x)).encode()), brute.sha(raw)) for i, raw, x in ids])


def test_op8(spark, odd, rows):
    got = run(spark, "op8_sharding", odd[0])
    same([(r.doc_id, r["size"], r.text_crc32) for r in got], [(i, len((t or "").encode()) + 1, brute.crc((t or "").encode())) for i, t in rows])
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)}
    assert all(x == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op9(spark, odd, rows):
    got = run(spark, "op9_toxicity", odd[0])
    same([(r.doc_id, r.held_out) for r in got], [(i, i is not None and brute.crc(str(i).encode()) % 3 == 1) for i, _ in rows])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id >= 60]
    assert len(held) > 10 and all(r.predicted == r.doc_id % 2 for r in held)


def test_op10(spark, odd, rows):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op10_substring_dedup", odd[0])]
    same(got, [(i, n, gone, runs, brute.sha(kept)) for (i, _), (n, gone, runs, kept) in zip(rows, brute.repeats(rows))])


def test_stages_keep_columns(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd[0]).schema.names == docs.schema.names


def expected(rows, model, benchmark, span=50):
    """The pipeline's kept texts, stage by stage."""
    scorer = toxicity.Scorer(model)
    rows = [(i, t) for i, t in rows if scorer.document((t or "").encode()) < toxicity.THRESHOLD]
    comp = brute.components(rows, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY)
    first = {}
    for i, t in rows:
        if i is not None and comp[i] == i:
            first.setdefault(i, set()).add(t)
    rows = [(i, t) for i, t in rows if i is None] + [(i, next(iter(ts))) for i, ts in first.items()]
    assert all(len(ts) == 1 for ts in first.values())
    rows = [(i, t if t is None else kept.decode("utf-8", "ignore")) for (i, t), (_, _, _, kept) in zip(rows, brute.repeats(rows, span))]
    return [(i, t) for (i, t), found in zip(rows, brute.contamination([t for _, t in rows], benchmark)) if not found[2]]


def test_stages_bound_what_workers_get(spark, odd):
    """A batch is held by the executor and by its worker, beside the heap; stages let no batch grow to Spark's own 64 MB."""
    sizes = lambda batches: (b.from_pydict({"bytes": [b.nbytes]}) for b in batches)
    wide = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("some words "), 6_000).alias("text"))  # 26 MB
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs, odd[0])
        most = wide.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0]
        allowed = corpus_pipeline.REPEATS_BATCH if name == "substring_dedup" else corpus_pipeline.BATCH
        assert most <= allowed + 100_000, name


def test_byte_groups():
    texts = pa.array([None, "abc", "d" * 9, None, "", "ef", "g"])
    assert [*byte_groups(texts, 4)] == [(0, 2), (2, 3), (3, 7)]
    assert [*byte_groups(texts, 99, rows=3)] == [(0, 3), (3, 6), (6, 7)]


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_pipeline(spark, odd, sf, which):
    folder = odd[0] if which == "odd" else sf
    docs, labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = toxicity.fit(toxicity.training_sample(docs, labels.select("doc_id", "toxic")))
    enc = tiktoken_encoding()
    want = expected([(r.doc_id, r.text) for r in docs.collect()], model, [(r.item_id, r.text) for r in bench.collect()])
    got = corpus_pipeline.run(spark, folder).collect()
    same([(r.doc_id, r.n_tokens, tuple(r.ids)) for r in got], [(i, len(x), tuple(x)) for i, x in ((i, enc.encode_ordinary(t or "")) for i, t in want)])
