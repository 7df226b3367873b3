"""Language of texts, URLs and questions: English, Irish or mixed, from native expressions.

A statistical detector can be plugged in as a frame of (key, en, ga) probabilities; without one the
word and letter signals decide alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

STRONG = sorted("agus atá bhí gaeilge iarrthóir múinteoir ní scrúdú teastas".split())
WEAK = sorted("an ar do go le na".split())
ENGLISH = sorted("about and application exam for information register the with".split())
GA_URLS = sorted((
    "láibheil", "leibheil-scr", "éanadh", "/nuacht/", "séanadh", "polasaí", "náisc-", "cóipcheart",
    "maidir-le-scr", "ceisteanna-coitianta", "eolas-molta",
))
EN_URLS = sorted((
    "/site-map", "/resources/", "/news/", "/mailing-list", "/info-advice/", "/faqs", "/exam-levels", "/english/",
    "/cookie-policy", "/about-exams",
))
_GREETINGS = (
    r"(?:hi|hey|hello)(?:\s+there)?", "hiya", "howdy", "greetings", "yo", "sup", r"what'?s\s+up", r"how\s+are\s+you",
    r"good\s+(?:day|evening|afternoon|morning)", r"dia\s+d(?:h)?uit", "haigh", r"conas\s+at[aá]\s+t[uú]", "sl[aá]n",
    "thanks?", r"thank\s+you", "cheers", "ok(?:ay)?", "bye", "goodbye", r"good\s+bye",
)
GREETING = r"(?i)^(?:" + "|".join(_GREETINGS) + r")[\s!.?,]*$"


#: The known words among a small-letter text's words, which are runs of letters, digits and underscores.
_KNOWN = r"(?<![\p{L}\p{N}_])(?:" + "|".join(sorted({*STRONG, *WEAK, *ENGLISH})) + r")(?![\p{L}\p{N}_])"


def signals(c: Column) -> Column:
    """The text and its counts of accented letters, strong and weak Irish words and English words, as a struct."""
    # The one letter whose small form has more than one character would break a word in two; no known word has it.
    found = F.regexp_extract_all(F.lower(F.replace(c, F.lit("\u0130"), F.lit("\u00ef"))), F.lit(_KNOWN), F.lit(0))
    among = lambda w, known: F.size(F.filter(w, lambda x: x.isin(known)))
    counts = lambda w: F.struct(among(w, STRONG).alias("strong"), among(w, WEAK).alias("weak"), among(w, ENGLISH).alias("english"))
    return F.struct(c.alias("t"), (F.length(c) - F.length(F.translate(c, "áéíóúÁÉÍÓÚ", ""))).alias("chars"), let(found, counts).alias("w"))


def _counted(c: Column, body) -> Column:
    """``body`` of the stripped text and its signals by name, all worked out once."""
    named = lambda x: {"chars": x["chars"], **{k: x["w"][k] for k in ("strong", "weak", "english")}}
    return let(strip(F.coalesce(c, F.lit(""))), lambda t: let(signals(t), lambda x: body(x["t"], named(x))))


def of_url(u: Column) -> Column:
    low = F.lower(u)
    count = lambda marks: F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: F.contains(low, m)))
    ga, en = count(GA_URLS), count(EN_URLS)
    return F.when(ga > en, "ga").when(en > ga, "en").otherwise("mixed")


def detect(c: Column, url: Column | None = None, en: Column | None = None, ga: Column | None = None) -> Column:
    """Language of a text; ``en`` and ``ga`` are a detector's probabilities where there is one."""
    return _counted(c, lambda t, s: _detected(t, s, url, en, ga))


def _detected(t: Column, s: dict[str, Column], url: Column | None, en: Column | None, ga: Column | None) -> Column:
    score = s["chars"] + 2 * (2 * s["strong"] + s["weak"])
    known = of_url(F.coalesce(url, F.lit(""))) if url is not None else F.lit("mixed")
    irish = ((s["chars"] >= 2) | (s["strong"] >= 1) | (s["weak"] >= 2)) & (score >= s["english"] + 1)
    out = F.when(F.length(t) < 30, known).when(irish, "ga")
    if en is not None:
        out = out.when((ga > 0.45) & (en < 0.35), "ga").when((en > 0.45) & (ga < 0.35), "en").when((ga > 0.25) & (en > 0.25), "mixed")
        out = out.when(ga >= en, "ga").when(en > ga, "en")
    return out.when(score > s["english"], "ga").when(s["english"] > s["chars"], "en").otherwise(known)


def of_query(c: Column, en: Column | None = None, ga: Column | None = None) -> Column:
    return _counted(c, lambda t, s: _asked(t, s, en, ga))


def _asked(t: Column, s: dict[str, Column], en: Column | None, ga: Column | None) -> Column:
    out = F.when(t == "", "en").when((s["chars"] >= 1) | (s["strong"] >= 1), "ga")
    if en is not None:
        out = out.when(ga > en, "ga").when(en >= ga, "en")
    return out.when(s["weak"] >= 2, "ga").otherwise("en")


def answer_body(c: Column) -> Column:
    """An answer without what follows its first rule line and without a bare sources heading."""
    head = F.get(F.split(strip(F.coalesce(c, F.lit(""))), r"\n\s*---\s*\n", 2), F.lit(0))
    return strip(F.regexp_replace(head, r"(?im)^#{1,3}\s*sources\s*$", ""))


def needs_translation(c: Column, target: Column) -> Column:
    body = answer_body(c)
    found = detect(body)
    return (F.length(body) >= 15) & (((found == "en") & (target == "ga")) | ((found == "ga") & (target == "en")))


def is_conversational(c: Column, topics: tuple[str, ...]) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    topic = r"(?i)\b(?:" + "|".join(topics) + r")\b"
    return (t != "") & (F.length(t) <= 60) & ~t.rlike(topic) & t.rlike(GREETING)
