"""From questions to checked answers: routing, generation with retries, fallbacks and log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import language as L
from ..operators import answers as A
from ..sources.storage import write_step

FALLBACK = {
    "en": "The pages at hand do not answer this. Please browse the site or ask its staff.",
    "ga": "Níl freagra air seo sna leathanaigh atá againn. Féach an suíomh nó cuir ceist ar an bhfoireann.",
}


def fallback(language: Column) -> Column:
    return F.when(language == "ga", FALLBACK["ga"]).otherwise(FALLBACK["en"])


def prompt(language: Column, context: Column, text: Column, errors: Column | None = None) -> Column:
    parts = [
        F.when(language == "ga", "Freagair i nGaeilge.").otherwise("Answer in English."),
        F.lit("Use only these excerpts; write '## Answer' and then '## Sources' with links."), context, text,
    ]
    if errors is not None:
        parts.append(F.when(F.size(errors) > 0, F.concat(F.lit("Mend: "), F.array_join(errors, "; "))))
    return F.concat_ws("\n\n", *parts)


def extractive(prompts: DataFrame) -> DataFrame:
    """The offline generator: the first excerpt as the answer, its address as the source."""
    first = F.regexp_extract("context", r"(?s)^\[1\] [^\n]*\n(.*?)(?:\n\n\[2\] |\z)", 1)
    title, url = (F.regexp_extract("context", r"^\[1\] (.*) \((https?://[^\n]*)\)\n", i) for i in (1, 2))
    text = F.concat(F.lit("## Answer\n"), first, F.lit(" [1]\n\n## Sources\n- ["), title, F.lit("]("), url, F.lit(")"))
    return prompts.select("query_id", text.alias("answer"))


def answer(spark: SparkSession, queries: DataFrame, contexts: DataFrame, allowed: DataFrame, config: EngineConfig = EngineConfig(), generate=extractive, greet=None) -> DataFrame:
    """(query_id, language, outcome, text, attempts) for (query_id, text).

    ``contexts`` has (query_id, context), ``allowed`` (query_id, urls).  Every round generates for what is
    still open and checks it; at most retries + 1 rounds run, each written out.
    """
    q = queries.select("query_id", F.col("text").alias("question"), L.of_query(F.col("text")).alias("language"), L.is_conversational(F.col("text"), config.topic_words).alias("chat"))
    q = q.join(contexts.select("query_id", "context"), "query_id", "left")
    chat = q.where("chat").select("query_id", "language", F.lit("conversational").alias("outcome"), F.when(F.col("language") == "ga", "Dia dhuit!").otherwise("Hello!").alias("text"), F.lit(0).alias("attempts"))
    bare = q.where("not chat and coalesce(context, '') = ''").select("query_id", "language", F.lit("no_context").alias("outcome"), fallback(F.col("language")).alias("text"), F.lit(0).alias("attempts"))
    remaining = write_step(spark, q.where("not chat and coalesce(context, '') <> ''").withColumn("errors", F.array().cast("array<string>")), "open")
    done = []
    for n in range(1, config.validation_retries + 2):
        p = remaining.withColumn("prompt", prompt(F.col("language"), F.col("context"), F.col("question"), F.col("errors")))
        got = generate(p).join(remaining.drop("errors"), "query_id")
        checked = A.check_citations(got.select(F.col("query_id").alias("answer_id"), F.col("answer").alias("text")), allowed.select(F.col("query_id").alias("answer_id"), "urls"))
        got = write_step(spark, got.join(checked.withColumnRenamed("answer_id", "query_id"), "query_id"), "answers")
        shown = A.format_answer(F.col("answer"), F.col("language"))
        done.append(got.where("passed").select("query_id", "language", F.lit("answered").alias("outcome"), shown.alias("text"), F.lit(n).alias("attempts")))
        remaining = got.where("not passed").select("query_id", "question", "language", "chat", "context", "errors")
        if remaining.isEmpty():
            break
    failed = remaining.select("query_id", "language", F.lit("validation_failed").alias("outcome"), fallback(F.col("language")).alias("text"), F.lit(config.validation_retries + 1).alias("attempts"))
    out = chat.unionByName(bare).unionByName(failed)
    for d in done:
        out = out.unionByName(d)
    return out


def log_rows(answers: DataFrame) -> DataFrame:
    validation = F.when(F.col("outcome") == "answered", "pass").when(F.col("outcome") == "validation_failed", "fail").otherwise("skipped")
    return answers.select("query_id", "language", "outcome", "attempts", validation.alias("validation"), F.length("text").alias("answer_chars"), F.current_timestamp().alias("at"))
