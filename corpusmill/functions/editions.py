"""Translations, metadata of books and verses, flags and origins: small rules over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.refs import BOOK_CODES, book_ordinal, locale_key, testament
from corpusmill.functions.text import clamp01, has_any

# The translations that can be asked for, the first by default.
TRANSLATIONS = ("BSB", "KJV", "WEB", "ASV", "NHEB")
# Genres and their books.
GENRES = {
    "law": "GEN EXO LEV NUM DEU",
    "historical": "JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH EST ACT",
    "poetic": "JOB PSA PRO ECC SNG",
    "prophetic": "ISA JER LAM EZK DAN HOS JOL AMO OBA JON MIC NAM HAB ZEP HAG ZEC MAL",
    "gospel": "MAT MRK LUK JHN",
    "epistle": "ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE 2PE 1JN 2JN 3JN JUD",
    "apocalyptic": "REV",
}
# Themes and the words that show them, in order.
THEMES = (
    ("messianic", ("messiah", "anointed", "branch", "servant", "son of david")),
    ("covenant", ("covenant", "promise", "law", "new covenant")),
    ("resurrection", ("resurrection", "rise", "third day")),
    ("eschatology", ("end times", "beast", "judgment", "tribulation")),
)
# Stems and words of questions about the sky and the earth.
SKY_WORDS = (
    "cosmolog cosmo astronom science scientific universe cosmic celestial planet earth sun moon stars star\\s*light heaven heavens sky firmament expanse vault dome horizon constellation zodiac eclipse "
    "solar lunar sunrise sunset day\\s*night geocentr heliocentr flat\\s*earth round\\s*earth globe sphere orbit rotation revolv axis tilt equinox solstice pillar\\s*of\\s*the\\s*earth "
    "foundations\\s*of\\s*the\\s*earth corners\\s*of\\s*the\\s*earth ends\\s*of\\s*the\\s*earth"
).split(" ")
METADATA_CONFIDENCE = 0.5


def allowed_translation(asked: Column) -> Column:
    """A translation that can be asked for, in upper case; the first one for anything else, null included."""
    code = F.upper(F.trim(asked))
    return F.when(code.isin(*TRANSLATIONS), code).otherwise(TRANSLATIONS[0])


def translation_alias(code: Column, aliases: dict[str, str] | None = None) -> Column:
    """The translation that an alias stands for; an unknown one passes through trimmed and upper-cased."""
    upper = F.upper(F.trim(code))
    if not aliases:
        return upper
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, upper), upper)


def genre(code: Column) -> Column:
    """The genre of a book; null for an unknown code."""
    known = F.create_map(*[F.lit(x) for name, books in GENRES.items() for book in books.split() for x in (book, name)])
    return F.try_element_at(known, F.upper(code))


def themes(text: Column, rules: tuple = THEMES) -> Column:
    """The themes whose words occur in a text, in rule order."""
    return F.array_compact(F.array(*[F.when(has_any(text, list(words)), name) for name, words in rules]))


def verse_metadata(verses: DataFrame, reference: str, text: str) -> DataFrame:
    """(verse_id, testament, genre, themes, ord): what rules say of each verse with a known book and a text.

    The book is the reference's first word, upper-cased. ``ord`` is the key whose binary order lists the verses.
    """
    book = F.upper(F.regexp_extract(F.trim(reference), r"^(\S+)", 1))
    rows = verses.filter((F.length(text) > 0) & (F.length(reference) > 0) & book.isin(*BOOK_CODES))
    return rows.select(F.col(reference).alias("verse_id"), testament(book).alias("testament"), genre(book).alias("genre"), themes(F.col(text)).alias("themes"), locale_key(F.col(reference)).alias("ord"))


def metadata_confidence(rows: DataFrame, key: str, confidence: str) -> DataFrame:
    """(key, value): a confidence from 0 to 1 per trimmed, upper-cased key, 0.5 where it is missing; repeated keys take the largest."""
    named = rows.select(F.upper(F.trim(key)).alias("key"), F.when(F.col(confidence).isNull(), METADATA_CONFIDENCE).otherwise(clamp01(F.col(confidence))).alias("value"))
    return named.filter(F.length("key") > 0).groupBy("key").agg(F.max("value").alias("value"))


def asks_about_the_sky(question: Column) -> Column:
    """Whether a question has one of the words about the sky and the earth."""
    return F.coalesce(F.rlike(question, F.lit(rf"(?i)\b(?:{'|'.join(SKY_WORDS)})\b")), F.lit(False))


def chapter_path(book: Column, chapter: Column) -> Column:
    """``number/chapter`` of a book by its place in canonical order; null for an unknown book."""
    return F.concat(book_ordinal(book).cast("string"), F.lit("/"), chapter.cast("string"))


def flag(value: Column, default: bool = False) -> Column:
    """Whether a setting is on: exactly ``1``, or the default where it isn't set."""
    return F.coalesce(value == "1", F.lit(default))


def number_or(value: Column, fallback: float) -> Column:
    """The number a setting holds; the fallback where it is missing, blank, no number or not finite."""
    number = F.trim(value).try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), fallback).otherwise(number)


def allowed_origin(origin: Column, allowed: list[str], development: bool = False) -> Column:
    """The origin where it is on the list, or a local one during development; else null."""
    local = F.rlike(origin, F.lit(r"^https?://localhost(:\d+)?$")) if development else F.lit(False)
    return F.when(origin.isin(*allowed) | local, origin)


def model_id(model: Column, first: str, second: str, provider: str) -> Column:
    """A model's name with its provider: the first one for null, other names with a provider or unknown stay."""
    return F.when(model.isNull() | (model == ""), f"{provider}:{first}").when(model.isin(first, second), F.concat(F.lit(provider + ":"), model)).otherwise(model)


def retry_delays(base_ms: int, retries: int, budget_ms: int) -> Column:
    """The waits before each retry, doubling from ``base_ms``, as long as their sum stays within the budget."""
    waits = F.transform(F.sequence(F.lit(0), F.lit(max(0, retries - 1))), lambda i: (F.lit(base_ms) * F.pow(F.lit(2), i)).cast("long"))
    waits = waits if retries > 0 else F.array().cast("array<bigint>")
    sums = F.transform(waits, lambda w, i: F.aggregate(F.slice(waits, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    return F.slice(waits, 1, F.size(F.filter(sums, lambda s: s <= budget_ms)))


def may_retry(status: Column) -> Column:
    """Whether a failed request is worth repeating: timeouts, too early, too many, and errors of the server."""
    return F.coalesce(status.isin(408, 425, 429) | (status >= 500), F.lit(False))
