"""Building the layers of words: clauses with their translations, glosses by precedence, bundled chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clause_ids(words: DataFrame, groups: list[str], order: str, clause: str) -> DataFrame:
    """(groups..., ids): the distinct clause ids of each verse in order of appearance; null and empty ones left out."""
    first = words.filter(F.length(clause) > 0).groupBy(*groups, clause).agg(F.min(order).alias("first_"))
    return first.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_", clause))), lambda x: x[clause]).alias("ids"))


def clause_translations(words: DataFrame, translations: DataFrame, book: str, clause: str, text: str) -> DataFrame:
    """(book, clause, text): the translation of each clause that occurs in a book; clauses without one are left out.

    ``translations`` has (clause, text); a repeated clause takes its smallest text.
    """
    known = translations.filter(F.length(text) > 0).groupBy(clause).agg(F.min(text).alias(text))
    return words.filter(F.length(clause) > 0).select(book, clause).distinct().join(known, clause).select(book, clause, text)


def gloss_by_precedence(words: DataFrame, extended: DataFrame, key: str, own: str, plain: str) -> DataFrame:
    """``words`` with gloss: the word's extended gloss, else that of its sort number, else its plain one; null if all are blank.

    ``extended`` has (key, gloss); a repeated key takes its smallest gloss.
    """
    other = extended.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.nullif(F.trim("gloss"), F.lit(""))).alias("by_key_"))
    found = F.coalesce(F.nullif(F.trim(own), F.lit("")), F.col("by_key_"), F.nullif(F.trim(plain), F.lit("")))
    return words.join(other, key, "left").withColumn("gloss", found).drop("by_key_")


def bundled_chapters(texts: DataFrame, tagged: DataFrame, on: list[str], words: str) -> DataFrame:
    """``texts`` with the tagged words of the same verse; an empty array where there are none."""
    other = tagged.select(*on, F.col(words).alias("words_"))
    none = F.array().cast(dict(tagged.dtypes)[words])
    return texts.join(other, on, "left").withColumn(words, F.coalesce("words_", none)).drop("words_")
