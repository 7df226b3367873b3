"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps its measurements and one failure
bit for each rule.  Policies are versioned masks over those bits, so a changed policy, or the effect
of leaving one rule out, is a bitwise aggregation over the ledger and never reads a text again.
Only built-in expressions are used: a document's words stay inside its row, nothing is exploded.

Null texts and texts of separators alone have no words and fail the length rule; ids, ties and
repeated rows are passed through row by row; an empty table gives an empty ledger.  Eight-word windows
of one document are told apart by 64-bit hashes (n windows are confused with odds of n^2 / 2^65).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 8
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"  # the class [#*$%&|<>]
TOO_SHORT, REPEATED, SYMBOLIC, WORD_LENGTH, DUP_LINES = 1, 2, 4, 8, 16
RULES = {"too_short": TOO_SHORT, "repeated": REPEATED, "symbolic": SYMBOLIC, "word_length": WORD_LENGTH, "dup_lines": DUP_LINES}
#: Versioned policies: a document is kept if none of the mask's bits is set.
POLICIES = {1: TOO_SHORT | REPEATED, 2: TOO_SHORT | REPEATED | SYMBOLIC | WORD_LENGTH | DUP_LINES}
CURRENT = 2


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a plain reference would be evaluated again at each use)."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in an eight-word window found twice or more among the document's windows."""

    def folded(hashes: Column, step: int) -> Column:
        return F.zip_with(hashes, F.slice(hashes, F.lit(step + 1), F.size(hashes)), lambda a, b: F.xxhash64(a, b))

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, other: F.coalesce(s["h"] == other["h"], F.lit(False))
        again = lambda t: F.filter(t, lambda s, i: same(s, F.get(t, i - 1)) | same(s, F.get(t, i + 1)))
        starts = let(placed, lambda t: F.sort_array(F.transform(again(t), lambda s: s["i"])))
        none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            starts, none,
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def counted(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered(windows)).otherwise(F.lit(0))

    def windows(words: Column) -> Column:
        return let(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda a: let(folded(a, 1), lambda b: let(folded(b, 2), lambda c: F.slice(folded(c, 4), F.lit(1), F.size(c) - (WINDOW - 1)))),
        )

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(windows(words), counted))


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed): one row for each document, every rule evaluated once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(SEPARATORS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    measured = docs.select(
        "doc_id",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    m = measured.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")
    n = F.col("n_words")
    bit = lambda failed, mask: F.when(failed, F.lit(mask)).otherwise(F.lit(0))
    bits = (
        bit(n < 20, TOO_SHORT)
        .bitwiseOR(bit(100 * F.col("n_repeat_words") > 30 * n, REPEATED))
        .bitwiseOR(bit(10 * F.col("n_symbols") > n, SYMBOLIC))
        .bitwiseOR(bit((F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n), WORD_LENGTH))
        .bitwiseOR(bit(2 * F.col("n_dup_lines") > F.col("n_lines"), DUP_LINES))
    )
    return m.withColumn("failed", bits)


def apply_policy(led: DataFrame, version: int = CURRENT) -> DataFrame:
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(led: DataFrame, version: int = CURRENT) -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without): what each rule removes, alone and at the margin."""
    mask = POLICIES[version]
    masks = led.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(b).alias("b")) for k, b in RULES.items() if b & mask])
    per = masks.select("bits", "n", F.inline(rules))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return per.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("b")) != 0)("n_failed"),
        count(F.col("bits") == F.col("b"))("n_only"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("b"))) == 0)("n_kept_without"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(TOO_SHORT | REPEATED)) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", F.col("failed").alias("failed_bits"),
    )
