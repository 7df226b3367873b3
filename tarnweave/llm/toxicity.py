"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a logistic score over its words; the document's
score is their noisy-or, 1 - prod(1 - s).  Labels exist for documents alone, so the sentence weights are
fitted by gradient descent on the likelihood of the documents' labels; the fitted model then points out
the sentences that made a document toxic.

The fit takes at most ``per_class`` labelled training documents of each class, chosen by a keyed hash
of the id (the bound is what the driver holds, see SAMPLE_PER_CLASS).  Scoring covers every whole text.

Null and empty texts have no sentences and score 0.  Rows without id, or labelled twice, take part as
they are; of two labels of one id the larger counts.  With no labelled document of one class all scores
are 0.  Further columns are kept by ``score`` and ignored by the query.
"""

from __future__ import annotations

from math import exp, expm1, log1p

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Memo, raw, slices, table, text_bytes, worker_cache

SAMPLE_PER_CLASS = 2_500
MIN_DOCS = 4
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7)
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else 10 if c in b".!?\n\r" else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def sentences(text: bytes) -> list[list[bytes]]:
    """Words of each sentence, lower-cased; sentences end at . ! ? and line ends."""
    return [w for s in text.translate(_TABLE).split(b"\n") if (w := s.split())]


def features(word: bytes) -> list[bytes]:
    """A word and its beginnings, so that inflected forms of one stem share a weight."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


def held_out() -> Column:
    """Whether a row is kept from the fit; a row without id can't be labelled and counts as held out by no remainder: false."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, seed: int = 9) -> list[tuple[bytes, int]]:
    """At most ``per_class`` texts of each label, from rows that are not held out."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") != 0).cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(seed), "doc_id")
    chosen = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])  # at most 2 * per_class rows, so it may be broadcast
    rows = docs.select("doc_id", text_bytes().alias("t")).join(F.broadcast(sample), "doc_id").select("doc_id", "t", "toxic")
    # Copies of one id are one training document.
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("t").alias("t"))
    return [(bytes(r["t"]), r["toxic"]) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]


def fit(sample: list[tuple[bytes, int]], rounds: int = 160, rate: float = 0.12, l2: float = 2e-5, min_docs: int = MIN_DOCS) -> dict:
    """{word: weight}, with the bias at b"" (a word that never occurs)."""
    import numpy as np

    bags = [(sentences(t), y) for t, y in sample]
    seen: dict[bytes, list[int]] = {}
    for bag, y in bags:
        for w in {f for s in bag for w in s for f in features(w)}:
            seen.setdefault(w, [0, 0])[y] += 1
    pos = sum(y for _, y in bags)
    neg = len(bags) - pos
    if not pos or not neg:
        return {}
    # Words whose share among toxic documents differs clearly from their share among the others.
    vocab = {}
    for w, (a, b) in seen.items():
        if a + b >= min_docs:
            p, q, m = b / pos, a / neg, (a + b) / len(bags)
            if (p - q) ** 2 > 16 * m * (1 - m) * (1 / pos + 1 / neg):
                vocab[w] = len(vocab)
    rows, cols, owner, y, n = [], [], [], [], 0
    for d, (bag, label) in enumerate(bags):
        y.append(label)
        for s in bag:
            for c in {vocab[f] for w in s for f in features(w) if f in vocab}:
                rows.append(n)
                cols.append(c)
            owner.append(d)
            n += 1
    rows, cols, owner, y = (np.array(x, dtype=np.int64) for x in (rows, cols, owner, y))
    theta, m1, m2 = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    theta[-1] = -5.0
    share = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, weights=theta[cols], minlength=n) + theta[-1]
        total = np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(y))
        e = np.exp(-total)
        slope = np.where(y == 1, -e / np.maximum(1 - e, 1e-9), 1.0) * share
        dz = slope[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(cols, weights=dz[rows], minlength=len(vocab)), dz.sum()) + l2 * np.append(theta[:-1], 0)
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        theta -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
    model = {w: float(theta[c]) for w, c in vocab.items() if abs(theta[c]) > 1e-3}
    model[b""] = float(theta[-1])
    return model


class Scorer:
    """A fitted model with a memo of the features that each word has in it."""

    def __init__(self, model: dict):
        self.model = model
        self.of = Memo(lambda w: tuple(f for f in features(w) if f in model), 500_000)

    def sentence_logits(self, text: bytes) -> list[float]:
        """A feature counts once for each sentence, as in the fit."""
        bias, get, of, out = self.model[b""], self.model.get, self.of, []
        for s in sentences(text):
            hit = [f for w in set(s) for f in of[w]]
            out.append(bias + sum(map(get, set(hit))) if hit else bias)
        return out

    def document(self, text: bytes) -> float:
        if not self.model:
            return 0.0
        return -expm1(-sum(log1p(exp(z)) if z < 30 else z for z in self.sentence_logits(text)))


def _scorer(model: dict) -> Scorer:
    worker_cache("toxicity", dict)  # other operators' memos go
    return Scorer(model)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with a column toxicity in 0..1 (in place of one of that name); the model is bounded by its sample."""
    import pyarrow as pa

    docs = docs.drop("toxicity")
    at = docs.columns.index("text")

    def run(batches):
        scorer = _scorer(model)
        for b in slices(batches):
            s = [scorer.document(x) for x in raw(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "toxicity"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("toxicity", DoubleType())]))


def below(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold, with their own columns only."""
    import pyarrow as pa

    at = docs.columns.index("text")

    def run(batches):
        scorer = _scorer(model)
        for b in slices(batches):
            yield b.filter(pa.array([scorer.document(x) < threshold for x in raw(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def locate(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, sentence, score): the sentences whose own score reaches the threshold, by their number."""
    import pyarrow as pa

    def run(batches):
        scorer = _scorer(model)
        for b in slices(batches):
            ids, at, s = [], [], []
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, z in enumerate(scorer.sentence_logits(bytes(x)) if model else []):
                    if (p := 1 / (1 + exp(-z))) >= threshold:
                        ids.append(d)
                        at.append(i)
                        s.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(at, pa.int32()), pa.array(s, pa.float64())], names=["doc_id", "sentence", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes().alias("t")).mapInArrow(run, f"doc_id {kind}, sentence int, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_sample(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    s = F.col("toxicity")
    return score_only(docs, model).select(
        "doc_id", held_out().alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted")
    )


def score_only(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, toxicity), without sending the texts back from the workers."""
    import pyarrow as pa

    def run(batches):
        scorer = _scorer(model)
        for b in slices(batches):
            s = [scorer.document(x) for x in raw(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "toxicity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes().alias("t")).mapInArrow(run, f"doc_id {kind}, toxicity double")
