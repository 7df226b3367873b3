"""Citations, answer formatting, message assembly and event folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.url import citation_key

LINK = r"\[([^\]]+)\]\((https?://[^)]+)\)"


def links(text: Column) -> Column:
    """Distinct (title, url) pairs in order of their first place."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(LINK), F.lit(2)).alias("u"))
    clean = F.transform(both, lambda x: F.struct(strip(x["t"]).alias("title"), F.regexp_replace(strip(x["u"]), "[.,;]+$", "").alias("url")))
    same = lambda a, b: (F.lower(a["title"]) == F.lower(b["title"])) & (F.lower(a["url"]) == F.lower(b["url"]))
    return F.aggregate(clean, F.slice(clean, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: same(x, y)), acc).otherwise(F.concat(acc, F.array(x))))


def citations(text: Column) -> Column:
    at = F.instr(F.lower(text), "## sources")
    return links(F.when(at > 0, F.substr(text, at)).otherwise(text))


def check_citations(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """(answer_id, passed, errors) of (answer_id, text) against (answer_id, urls array<string>)."""
    a = answers.join(allowed, "answer_id", "left").withColumn("c", citations(F.col("text")))
    ok = F.transform(F.coalesce("urls", F.array().cast("array<string>")), citation_key)
    unknown = F.filter("c", lambda x: ~F.array_contains(ok, citation_key(x["url"])))
    errors = F.concat(
        F.when(~F.contains(F.lower("text"), F.lit("## answer")), F.array(F.lit("no answer section"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("c") == 0, F.array(F.lit("no citations"))).otherwise(F.array().cast("array<string>")),
        F.transform(unknown, lambda x: F.concat(F.lit("unknown url: "), x["url"])),
    )
    return a.select("answer_id", (F.size(errors) == 0).alias("passed"), errors.alias("errors"))


def format_answer(text: Column, language: Column, fallback: Column | None = None) -> Column:
    """Answer with [n] markers linked and a numbered source list; ``fallback`` has (title, url) of the chunks used."""
    t = strip(text)
    heading = r"^\s*#{1,3}\s*(?:sources|foins[ií])\s*$"
    parts = F.split(t, r"(?im)" + heading, 2)
    head, tail = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    answer = strip(F.regexp_replace(head, r"(?is)^.*?(?m:^\s*#{1,3}\s*answer[ \t]*\n)", ""))
    answer = F.rtrim(F.regexp_replace(answer, r"(?:\n\s*(?:-{3,}|\*{3,}|_{3,})\s*)+\z", ""))
    own = links(tail)
    sources = F.when(F.size(own) > 0, own).otherwise(fallback) if fallback is not None else own
    marked = F.aggregate(
        F.sequence(F.lit(1), F.least(F.size(sources), F.lit(99))), answer,
        lambda acc, i: F.regexp_replace(acc, F.concat(F.lit(r"(?<!\[)\["), F.lit("0?"), i.cast("string"), F.lit(r"\](?!\()")), F.concat(F.lit("["), i.cast("string"), F.lit("]("), F.replace(F.replace(F.get(sources, i - 1)["url"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")), F.lit(")"))),
    )
    listed = F.array_join(F.transform(sources, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". ["), s["title"], F.lit("]("), s["url"], F.lit(")"))), "\n")
    title = F.when(language == "ga", F.lit("### Foinsí")).otherwise(F.lit("### Sources"))
    full = F.concat(marked, F.lit("\n\n---\n\n"), title, F.lit("\n\n"), listed)
    return F.when((t == "") | (F.size(F.coalesce(sources, F.slice(own, 1, 0))) == 0), F.when(t == "", t).otherwise(answer)).otherwise(full)


def fallback_sources(hits: DataFrame) -> DataFrame:
    """(query_id, sources array<struct<title, url>>): sources of hits in rank order, one for each url."""
    h = hits.withColumn("u", strip("source_url")).where("u <> ''")
    first = h.groupBy("query_id", F.lower("u").alias("k")).agg(F.min_by(F.struct("rank", "title", "u"), "rank").alias("r"))
    name = F.when(F.coalesce("r.title", F.lit("")) == "", F.col("r.u")).otherwise(strip(F.col("r.title")))
    rows = first.select("query_id", F.struct(F.col("r.rank").alias("rank"), name.alias("title"), F.col("r.u").alias("url")).alias("s"))
    return rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: F.struct(s["title"], s["url"])).alias("sources"))


def messages(turns: DataFrame, system: str) -> DataFrame:
    """(conv_id, n, roles, transcript): the system prompt, then every turn in order."""
    m = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    g = turns.groupBy("conv_id").agg(m.alias("m"))
    roles = F.concat(F.array(F.lit("system")), F.transform("m", lambda x: x["role"]))
    texts = F.concat(F.array(F.lit(system)), F.transform("m", lambda x: x["text"]))
    return g.select("conv_id", F.size(roles).cast("long").alias("n"), F.array_join(roles, ",").alias("roles"), F.array_join(texts, "\n").alias("transcript"))


def fold_events(events: DataFrame) -> DataFrame:
    """(message_id, text): content appends, replace overwrites, reset clears, an error removes the message."""
    e = events.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "text"))).alias("e"))
    none = F.lit(None).cast("string")
    fold = F.aggregate(
        "e", F.lit(""),
        lambda acc, x: F.when(x["kind"] == "content", F.concat(F.coalesce(acc, F.lit("")), x["text"])).when(x["kind"] == "replace", x["text"])
        .when(x["kind"] == "reset", F.lit("")).when(x["kind"] == "error", none).otherwise(acc),
    )
    return e.select("message_id", fold.alias("text")).where("text is not null")
