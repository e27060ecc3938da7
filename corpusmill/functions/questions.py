"""Understanding of search questions: prefixes, reference spelling, domain, intent, negation and expansion.

All expressions work on a whole column of questions at once. ``compat`` keeps two narrow readings (few books are seen
as references, and cues are looked for after prefixes are gone); without it every known book counts and cues are looked
for in the question as asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.refs import BOOK_NAMES
from corpusmill.functions.text import has_any, has_keyword, quote, strings

# Prefixes without meaning, in the order in which they are tried.
FILLERS = ("what does the bible say about", "what does scripture say about", "tell me about", "explain", "can you explain", "help me understand")
# Short book names as patterns and what they stand for, in the order in which they are replaced.
SHORT_BOOKS = (
    (r"jn\b", "John"), (r"jhn\b", "John"), (r"gen(?=\d|\s)", "Genesis "), (r"ge(?=\d|\s)", "Genesis "), (r"ex(?=\d|\s)", "Exodus "), (r"exo(?=\d|\s)", "Exodus "), (r"rom(?=\d|\s)", "Romans "),
    (r"psalm(?=\d|\s)", "Psalms "), (r"ps(?=\d|\s)", "Psalms "), (r"psa(?=\d|\s)", "Psalms "), (r"1\s*cor\b", "1 Corinthians"), (r"2\s*cor\b", "2 Corinthians"), (r"1\s*thess\b", "1 Thessalonians"), (r"2\s*thess\b", "2 Thessalonians"),
)
#: The books that the narrow reading knows: those that the short names stand for.
COMPAT_BOOKS = tuple(dict.fromkeys(name.strip().lower() for _, name in SHORT_BOOKS))
# Domains and their keywords, first match wins.
DOMAINS = (
    ("messianic", ("messiah", "son of god", "son of david", "suffering servant")),
    ("covenants", ("covenant", "law", "new covenant", "promise")),
    ("eschatology", ("end times", "beast", "tribulation", "revelation", "last days")),
    ("typology", ("typology", "shadow", "foreshadow", "antitype", "prefigure")),
)
# Per domain, trigger words and the terms they add.
EXPANSIONS = {
    "messianic": (("messiah", ("anointed one", "christ")), ("son of david", ("davidic king",)), ("suffering servant", ("pierced servant",))),
    "covenants": (("covenant", ("promise", "testament")), ("law", ("commandment", "statute")), ("new covenant", ("better covenant",))),
    "eschatology": (("end times", ("last days", "day of the lord")), ("tribulation", ("great tribulation",)), ("resurrection", ("raising of the dead",))),
    "typology": (("typology", ("shadow", "fulfillment")), ("antitype", ("fulfillment pattern",)), ("foreshadow", ("prophetic pattern",))),
}
# Words left out of a search, phrases kept whole, negations, cues of a wish for explanation.
LOW_VALUE = ("what", "does", "the", "say", "about", "explain", "meaning", "bible", "please", "show", "tell", "me")
PHRASES = ("kingdom of heaven", "kingdom of god", "son of man", "son of god", "holy spirit", "day of the lord", "new covenant", "suffering servant")
NEGATIONS = ("not", "without", "except", "never")
CUES = r"(?i)\b(?:mean|means|meaning|explain|explains|understand|context)\b"
# Synonyms of single words, and of phrases with the word that shows they were added already.
SYNONYMS = {
    "messiah": ("christ", "anointed", "shiloh", "son of david"),
    "christ": ("messiah", "jesus", "anointed"),
    "salvation": ("redeemed", "saved", "deliverance", "justification"),
    "covenant": ("testament", "promise", "agreement"),
    "commandments": ("laws", "statutes", "decrees", "precepts", "torah"),
    "gospel": ("good news", "evangel", "kerygma"),
    "trinity": ("godhead", "father son spirit"),
    "sin": ("iniquity", "transgression", "trespass", "wickedness"),
    "grace": ("favor", "lovingkindness", "mercy"),
    "faith": ("belief", "trust", "assurance"),
    "heaven": ("paradise", "kingdom of god", "glory"),
    "hell": ("sheol", "hades", "gehenna", "lake of fire"),
}
PHRASE_SYNONYMS = (
    ("holy spirit", ("comforter", "paraclete", "spirit of truth", "holy ghost"), "comforter"),
    ("eternal life", ("everlasting life", "immortality", "world to come"), "immortality"),
    ("end times", ("last days", "eschaton", "revelation", "day of the lord"), "eschaton"),
)


def strip_filler(question: Column) -> Column:
    """The question without its first matching filler prefix and the separators after it."""
    any_of = "|".join(quote(p) for p in FILLERS)
    return F.trim(F.regexp_replace(F.trim(question), rf"(?i)^(?:{any_of})\b[\s,:-]*", ""))


def space_references(question: Column) -> Column:
    """Short book names written out, and numbers set apart from names."""
    out = question
    for short, name in SHORT_BOOKS:
        out = F.regexp_replace(out, rf"(?i)\b{short}", name)
    for pattern, to in ((r"\b([1-3])\s*([A-Za-z]+)", "$1 $2"), (r"\b([A-Za-z]+)\s*(\d+):(\d+)\b", "$1 $2:$3"), (r"\b([A-Za-z]+)\s*(\d+)\b", "$1 $2"), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def domain(question: Column) -> Column:
    """The first domain with a keyword in the question, else general."""
    out = F.lit("general")
    for name, keywords in reversed(DOMAINS):
        out = F.when(has_any(question, list(keywords)), name).otherwise(out)
    return out


def negations(question: Column) -> Column:
    """The negations in a question, in fixed order."""
    return F.array_compact(F.array(*[F.when(has_keyword(question, n), n) for n in NEGATIONS]))


def quoted_phrases(question: Column) -> Column:
    """Phrases in double quotes, trimmed, lower-cased, empty ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(question, F.lit('"([^"]+)"'), F.lit(1)), lambda p: F.lower(F.trim(p))), lambda p: p != "")


def intent(normalized: Column, asked: Column | None = None, compat: bool = False) -> Column:
    """DIRECT_REFERENCE, VERSE_EXPLANATION or TOPICAL_QUERY."""
    books = COMPAT_BOOKS if compat else tuple(n.lower() for n in BOOK_NAMES)
    reference = F.rlike(normalized, F.lit(rf"(?i)\b(?:{'|'.join(quote(b) for b in books)})\s+\d+(?::\d+)?\b"))
    cue = F.rlike(normalized if compat or asked is None else asked, F.lit(CUES))
    return F.when(reference & cue, "VERSE_EXPLANATION").when(reference, "DIRECT_REFERENCE").otherwise("TOPICAL_QUERY")


def _additions(question: Column, of_domain: Column, aim: Column) -> Column:
    none = strings()
    out = none
    for name, rules in EXPANSIONS.items():
        matched = F.filter(F.array(*[F.when(has_keyword(question, t), strings(*a)) for t, a in rules]), lambda x: x.isNotNull())
        first = F.slice(F.coalesce(F.get(matched, F.lit(0)), none), 1, 2)
        out = F.when(of_domain == name, F.when(aim == "TOPICAL_QUERY", first).otherwise(F.flatten(matched))).otherwise(out)
    return F.filter(out, lambda term: ~F.contains(question, F.lower(term)))


def understand(questions: DataFrame, question: str, compat: bool = False) -> DataFrame:
    """``questions`` with domain, intent, normalized, expanded and negations.

    A null question gives nulls and the general domain; an empty one is topical with an empty expansion.
    """
    asked = F.col(question)
    stripped = strip_filler(asked)
    rows = questions.withColumn("normalized", space_references(F.when(stripped != "", stripped).otherwise(asked)))
    low = F.lower("normalized")
    rows = rows.withColumn("domain", domain(F.col("normalized"))).withColumn("intent", intent(F.col("normalized"), asked, compat)).withColumn("negations", negations(F.col("normalized")))
    preserved = F.array_distinct(F.concat(quoted_phrases(F.col("normalized")), F.filter(strings(*PHRASES), lambda p: F.contains(low, p))))
    rows = rows.withColumn("phrases_", preserved)
    guarded = F.aggregate("phrases_", low, lambda text, phrase: F.replace(text, phrase, F.lit(" ")))
    words = F.filter(F.split(F.regexp_replace(guarded, r"[^a-z0-9_:\- ]", " "), r"\s+"), lambda w: (w != "") & ~w.isin(*LOW_VALUE))
    cleaned = F.array_join(F.array_distinct(words), " ")
    quoted = F.transform("phrases_", lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    base = F.when(cleaned != "", cleaned).when(F.size("phrases_") > 0, F.array_join(quoted, " ")).otherwise(F.col("normalized"))
    parts = F.concat(F.array(base), quoted, _additions(low, F.col("domain"), F.col("intent")))
    expanded = F.when(F.col("intent") == "DIRECT_REFERENCE", F.col("normalized")).otherwise(F.trim(F.array_join(F.array_distinct(parts), " ")))
    return rows.withColumn("expanded", expanded).drop("phrases_")


def add_synonyms(text: Column, negated: Column, most: int | None = None) -> Column:
    """Words with the synonyms of those that have some, each once; unchanged but for repeats if ``negated``."""
    cut = {w: s[:most] for w, s in SYNONYMS.items()}
    table = F.create_map(*[x for w, s in cut.items() for x in (F.lit(w), strings(*s))])
    words = F.split(F.lower(text), r"\s+")
    out = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.when(negated, strings()).otherwise(F.coalesce(F.try_element_at(table, w), strings())))))
    for phrase, added, mark in PHRASE_SYNONYMS:
        due = ~negated & F.contains(F.lower(text), F.lit(phrase)) & ~F.array_contains(out, mark)
        out = F.concat(out, F.when(due, strings(*added[:most])).otherwise(strings()))
    return F.array_join(F.array_distinct(out), " ")
