from pyspark.sql import functions as F

from tarnweave.config import EngineConfig
from tarnweave.functions import html, language, text, url
from tarnweave.operators import answers, chunking, documents, retrieval
from tarnweave.plans.answering import answer
from tarnweave.plans.ingest import ingest
from tarnweave.streaming import incremental


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


def test_splitter_keeps_bounds():
    paragraphs = "\n\n".join(("word " * 9).strip() for _ in range(4))
    parts = chunking.split_text(paragraphs, 60)
    assert len(parts) >= 2 and all(len(p) <= 60 for p in parts)
    assert "".join(parts).replace(" ", "").replace("\n", "") == paragraphs.replace(" ", "").replace("\n", "")
    assert chunking.split_document("  short  ", EngineConfig()) == [("short", "document")] and chunking.split_document("   ", EngineConfig()) == []


def test_sections_and_hash(spark):
    assert one(spark, "## Dates\n\nbody", text.section) == "Dates"
    assert one(spark, "plain line here", text.section) is None
    assert one(spark, "a  b\n", text.content_hash) == one(spark, " a b", text.content_hash)


def test_cleaning(spark):
    raw = "Welcome\nBy anna 06/03/2026 | 0 comments Body  text\r\nRSS Feed\n\nGlac le Fianáin more"
    assert one(spark, raw, lambda c: text.clean_content(c, F.lit("Welcome"))) == "Body text"


def test_languages(spark):
    assert one(spark, "Cá bhfuil an scrúdú?", language.of_query) == "ga"
    assert one(spark, "Where is the hall?", language.of_query) == "en"
    assert one(spark, "Hello there!", lambda c: language.is_conversational(c, ("exam",))) is True
    assert one(spark, "Hello, which exam?", lambda c: language.is_conversational(c, ("exam",))) is False
    assert one(spark, "Tá an scrúdú ar siúl agus tá fáilte romhat", lambda c: language.needs_translation(c, F.lit("en"))) is True


def test_html_and_urls():
    page = "<html><head><title>T &amp; U</title></head><body><nav>menu</nav><main><p>" + "long text " * 9 + "<script>x</script></main></body>"
    title, body = html.extract(page, (), 50)
    assert title == "T & U" and body.startswith("long text") and "menu" not in body
    links = html.links_of("<a href='/a#x'>1</a><a href='b.pdf'>2</a><a href='mailto:x@y'>3</a><a href='http://other.org/'>4</a>", "http://site.org/d/", ("site.org",))
    assert links == ({"http://site.org/a"}, {"http://site.org/d/b.pdf"})
    assert url.resolve("", "http://site.org/", ()) is None


def test_url_first_shadows(spark):
    d = spark.createDataFrame([(1, "u", ""), (2, "u", "later"), (3, "v", "x"), (4, "w", " x ")], "seq long, url string, content string")
    got = {r.seq: r.outcome for r in documents.dedup_flags(d).collect()}
    assert got == {1: "empty", 2: "duplicate_url", 3: "kept", 4: "duplicate_content"}


def test_context_budget(spark):
    rows = [(1, i, "", "http://x/", "w" * 2000) for i in (1, 2)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, title string, source_url string, content string")
    assert len(retrieval.pack_context(hits, 500).first().context) <= 500


def test_citations(spark):
    good = "## Answer\nYes [1]\n\n## Sources\n- [A](http://a.org/x)"
    rows = spark.createDataFrame([(1, good), (2, good.replace("a.org", "b.org")), (3, "no")], "answer_id long, text string")
    allowed = spark.createDataFrame([(i, ["http://A.org/x/"]) for i in (1, 2, 3)], "answer_id long, urls array<string>")
    assert {r.answer_id: r.passed for r in answers.check_citations(rows, allowed).collect()} == {1: True, 2: False, 3: False}
    shown = one(spark, good, lambda c: answers.format_answer(c, F.lit("en")))
    assert shown == "Yes [1](http://a.org/x)\n\n---\n\n### Sources\n\n1. [A](http://a.org/x)"


def test_answer_rounds(spark):
    q = spark.createDataFrame([(1, "Where is the main hall today?"), (2, "hello"), (3, "Anything else here?")], "query_id long, text string")
    ctx = spark.createDataFrame([(1, "[1] Hall (http://a.org/x)\nIt is left.")], "query_id long, context string")
    allowed = spark.createDataFrame([(1, ["http://a.org/x"])], "query_id long, urls array<string>")
    got = {r.query_id: r.outcome for r in answer(spark, q, ctx, allowed).collect()}
    assert got == {1: "answered", 2: "conversational", 3: "no_context"}


def test_ingest_is_incremental(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = [(i, f"http://s.org/{i}", "", f"Document number {i} " * 8) for i in range(6)]
    make = lambda r: spark.createDataFrame(r, "seq long, url string, title string, content string")
    first = ingest(spark, make(rows), root)
    assert not first.skipped and first.changes["added"] == 6
    assert ingest(spark, make(rows), root).skipped
    rows[2] = (2, rows[2][1], "", "Something new " * 9)
    third = ingest(spark, make(rows[:5]), root)
    assert (third.changes["updated"], third.changes["removed"], third.chunks_reused, third.removed_points) == (1, 1, 4, 2)


def test_stream_ingests(spark, tmp_path):
    page = "<title>t</title><main>" + "some words here " * 8 + "</main>"
    spark.createDataFrame([(1, "http://s.org/1", page)], incremental.PAGES).write.parquet(f"{tmp_path}/in")
    q = incremental.start(incremental.page_stream(spark, f"{tmp_path}/in"), f"file://{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert q.exception() is None and spark.read.parquet(f"{tmp_path}/out/index/v1").count() == 1
