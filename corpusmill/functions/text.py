"""Text expressions: tokenisers, keyword predicates, clean-up. All are column expressions that run in the JVM.

A null input gives null, unless a docstring says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no meaning of their own in a fallback search.
STOP_WORDS = (
    "the and for with that this from what when where which can could should would does did are is to of in on a an about christian christians bible say"
).split()
# Glosses that say nothing about a word.
EMPTY_GLOSSES = ("and", "the", "of", "to")
#: Characters per token in the budget's estimate.
CHARS_PER_TOKEN = 3
#: Length of a streamed chunk.
CHUNK_CHARS = 220


def quote(literal: str) -> str:
    """A literal as a Java pattern without special meaning."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def strings(*values: str) -> Column:
    """An array of literal strings, of type array<string> even when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII word characters; other letters split words. Order and repeats stay."""
    return _words(F.regexp_replace(F.lower(text), r"[^\w\s]", " "))


def fallback_tokens(text: Column, stop_words: list[str] | tuple[str, ...] = tuple(STOP_WORDS)) -> Column:
    """Distinct lower-case ASCII tokens of three characters or more that aren't stop words, in order of appearance."""
    words = _words(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(strings(*stop_words), w)))


def topic_tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric tokens of three characters or more, repeats included."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)


def phrase_text(text: Column) -> Column:
    """Text as phrases are compared: lower case, only word characters, apostrophes and single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\w\s']", " "), r"\s+", " "))


def collapse(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def has_keyword(text: Column, keyword: str) -> Column:
    """A keyword with a space matches as a substring, a single word on word boundaries, both without regard to case."""
    low = keyword.lower()
    if " " in low:
        return F.contains(F.lower(text), F.lit(low))
    return F.rlike(F.lower(text), F.lit(rf"\b{quote(low)}\b"))


def has_keyword_column(text: Column, keyword: Column) -> Column:
    """``has_keyword`` for a keyword column."""
    low = F.lower(keyword)
    escaped = F.regexp_replace(low, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return F.when(F.contains(low, F.lit(" ")), F.contains(F.lower(text), low)).otherwise(F.regexp_like(F.lower(text), F.concat(F.lit(r"\b"), escaped, F.lit(r"\b"))))


def has_any(text: Column, keywords: list[str]) -> Column:
    """Whether any keyword matches; false without keywords."""
    out = F.lit(False)
    for k in keywords:
        out = out | has_keyword(text, k)
    return out


def contains_any(text: Column, parts: list[str]) -> Column:
    """Whether any part occurs as a substring, without regard to case; null text gives false."""
    return F.coalesce(F.exists(strings(*[p.lower() for p in parts]), lambda p: F.contains(F.lower(text), p)), F.lit(False))


def token_estimate(text: Column) -> Column:
    """Prompt tokens of a text, a third of its collapsed length rounded up."""
    return F.ceil(F.length(collapse(text)) / CHARS_PER_TOKEN).cast("int")


def strip_tags(text: Column) -> Column:
    """Markup in angle brackets removed."""
    return F.regexp_replace(text, "<[^>]+>", "")


def strip_notes(text: Column) -> Column:
    """Notes in square brackets removed."""
    return F.regexp_replace(text, r"\[[^\]]*?\]", "")


def decode_entities(text: Column) -> Column:
    """The five XML entities decoded, ampersand last."""
    # The entities of XML.
    for entity, char in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strongs_of_lemma(lemma: Column) -> Column:
    """The first number of a lemma with the prefix of the Hebrew lexicon; null without a number."""
    number = F.regexp_extract(lemma, r"(\d+)", 1)
    return F.when(F.length(number) > 0, F.concat(F.lit("H"), number))


def hebrew_letters(text: Column) -> Column:
    """Hebrew text without points and accents, other scripts dropped."""
    return F.regexp_replace(F.regexp_replace(text, "[\\u0591-\\u05C7]", ""), "[^\\u0590-\\u05FF]", "")


def tagged_words(text: Column) -> Column:
    """Words followed by a lexicon tag, ``word<S>number</S>``, as array<struct<word, strongs>>."""
    pieces = F.regexp_extract_all(text, F.lit(r"([^<>]*<S>[^<]*</S>)"), F.lit(1))
    return F.filter(
        F.transform(pieces, lambda p: F.struct(F.element_at(F.split(F.trim(F.regexp_extract(p, "^([^<]*)<S>", 1)), r"\s+"), -1).alias("word"), F.trim(F.regexp_extract(p, "<S>([^<]*)</S>", 1)).alias("strongs"))),
        lambda w: (F.length(w["word"]) > 0) & (F.length(w["strongs"]) > 0),
    )


def kebab(text: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, no hyphen at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title(text: Column) -> Column:
    """Hyphens and spaces as spaces, each word with a capital."""
    return F.initcap(F.trim(F.regexp_replace(text, r"[-\s]+", " ")))


def sorted_unique(values: Column) -> Column:
    """Distinct non-null values in order."""
    return F.array_sort(F.array_distinct(F.array_compact(values)))


def last_long_words(text: Column, letters: int = 4, count: int = 2) -> Column:
    """The last words of at least so many letters, lower-cased; fewer if there are fewer."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"\b([a-z]{{{letters},}})\b"), F.lit(1))
    return F.slice(words, F.greatest(F.lit(1), F.size(words) - (count - 1)), count)


def chunks(text: Column, size: int = CHUNK_CHARS) -> Column:
    """The text in chunks of ``size`` characters; an empty text is one empty chunk."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(size))
    return F.when(text.isNotNull(), F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size))))


def trim_any(text: Column) -> Column:
    """Without white space of any kind, Unicode's included, and byte-order marks at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")


def packed_fields(text: Column, separator: str = "｜") -> Column:
    """The parts of a field packed in tortoise-shell brackets, each trimmed."""
    return F.transform(F.split(F.regexp_replace(text, "[〔〕]", ""), separator), trim_any)


def prefix_int(text: Column) -> Column:
    """The leading integer of a string; null where there is none or it doesn't fit."""
    return F.regexp_extract(text, r"^\s*([-+]?\d+)", 1).try_cast("int")


def clamp01(value: Column) -> Column:
    """A number limited to 0..1; null, NaN and infinities give 0."""
    number = value.cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays; 0 where their lengths differ, null where one is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, v: s + v)).when(a.isNotNull() & b.isNotNull(), 0.0)


def norm(a: Column) -> Column:
    """The Euclidean length of an array."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def jaccard_by_larger(a: Column, b: Column) -> Column:
    """Shared members over the size of the larger array; 0 when both are empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(0.0)


def coverage(text_tokens: Column, found: Column) -> Column:
    """The share of tokens that occur in a text as substrings; 1 without tokens."""
    covered = F.size(F.filter(text_tokens, lambda t: F.contains(F.lower(found), t)))
    return F.when(F.size(text_tokens) == 0, 1.0).otherwise(covered / F.size(text_tokens))


def client_address(*headers: Column) -> Column:
    """The first usable address among headers in order of trust: head of a list, without brackets, port, prefix or zone."""

    def one(raw: Column) -> Column:
        value = F.trim(F.split_part(F.trim(raw), F.lit(","), F.lit(1)))
        value = F.when(F.rlike(value, F.lit(r"^\[.*\]")), F.regexp_extract(value, r"^\[([^\]]*)\]", 1)).otherwise(value)
        value = F.regexp_replace(value, r"^(\d{1,3}(?:\.\d{1,3}){3}):\d+$", "$1")
        value = F.lower(F.regexp_replace(F.regexp_replace(value, "(?i)^::ffff:", ""), "%.*$", ""))
        octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|0?\d?\d|00\d)"
        good = F.rlike(value, F.lit(rf"^{octet}(?:\.{octet}){{3}}$")) | (F.contains(value, F.lit(":")) & F.rlike(value, F.lit("^[0-9a-f:]+$")))
        return F.when(good, value)

    return F.coalesce(*[one(h) for h in headers])


def cache_key(*parts: Column) -> Column:
    """The SHA-256 of fields joined by NUL; null fields count as empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def hashed_vectors(rows: DataFrame, item: str, text: str, size: int = 384) -> DataFrame:
    """(item, vector): a vector of counts of hashed words with signs, where no embedding model is at hand.

    A word adds one, or takes one away, at a place that its digest names, so equal texts have equal vectors and texts
    with the same words similar ones. A text without a word gets no row.
    """
    words = rows.select(F.col(item).alias("item"), F.explode(tokens(F.col(text))).alias("word"))
    digest = F.md5("word")
    place = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % size
    sign = F.when(F.conv(F.substring(digest, 5, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = words.groupBy("item", place.alias("at")).agg(F.sum(sign).cast("double").alias("value"))
    cells = sums.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("cells"))  # at most ``size`` a row
    vector = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0)))
    return cells.select(F.col("item").alias(item), vector.alias("vector"))
