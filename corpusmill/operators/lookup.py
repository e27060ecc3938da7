"""Keyed lookups: fallback chains, overrides, priority matches, layered enrichment of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import hebrew_letters

VERSE_KEY = ["book", "chapter", "verse"]


def fetch(keys: DataFrame, rows: DataFrame, on: list[str], where: Column | None = None) -> DataFrame:
    """Rows for every key, repeated keys repeating; rows that fail ``where`` don't exist."""
    return keys.join(rows if where is None else rows.filter(where), on)


def resolve(keys: DataFrame, sources: list[DataFrame], on: list[str], value: str, keep_missing: bool = False) -> DataFrame:
    """``keys`` with the value of the first source that has a non-empty one, and source, its number from 1.

    Each source must hold a key at most once; ``unique_rows`` makes it so. Keys without a value are dropped unless
    ``keep_missing``.
    """
    found, where = F.lit(None).cast("string"), F.lit(None).cast("int")
    out = keys
    for i, source in enumerate(sources):
        out = out.join(source.select(*on, F.nullif(F.col(value), F.lit("")).alias(f"value_{i}")), on, "left")
    names = [f"value_{i}" for i in range(len(sources))]
    found = F.coalesce(*names)
    for i in reversed(range(len(sources))):
        where = F.when(F.col(f"value_{i}").isNotNull(), i + 1).otherwise(where)
    out = out.withColumn(value, found).withColumn("source", where).drop(*names)
    return out if keep_missing else out.filter(F.col(value).isNotNull())


def unique_rows(rows: DataFrame, on: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order."""
    by = Window.partitionBy(*on).orderBy(*order)
    return rows.withColumn("first_", F.row_number().over(by)).filter("first_ = 1").drop("first_")


def override(rows: DataFrame, replacements: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with columns replaced where a replacement has the key, null values of it changing nothing."""
    other = replacements.select(*on, *[F.col(c).alias(f"{c}_new") for c in columns])
    out = rows.join(other, on, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"{c}_new", c))
    return out.drop(*[f"{c}_new" for c in columns])


def attach_if_any(rows: DataFrame, other: DataFrame, on: list[str], array: str) -> DataFrame:
    """``rows`` with an array column replaced by the other table's where that isn't empty."""
    found = other.select(*on, F.col(array).alias("array_new"))
    kept = F.when(F.size("array_new") > 0, F.col("array_new")).otherwise(F.col(array))
    return rows.join(found, on, "left").withColumn(array, kept).drop("array_new")


def first_cached(keys: DataFrame, cache: DataFrame, request: str, order: str, key: str, value: str) -> DataFrame:
    """(request, key, value): the first non-empty cached value among each request's keys in order."""
    hits = keys.join(cache.filter(F.length(F.trim(value)) > 0), key)
    best = hits.groupBy(request).agg(F.min_by(F.struct(key, value), order).alias("best"))
    return best.select(request, f"best.{key}", f"best.{value}")


def match_morphology(words: DataFrame, tagged: DataFrame, on: list[str], word: str, lemma: str, position: str, tag: str, normal=hebrew_letters) -> DataFrame:
    """``words`` with a tag filled in where it is null, from the best match of the same verse.

    A match on lemma and normalised word wins over one on the lemma, which wins over one on the word; among equals the
    first position. ``words`` has ord, which tells its rows apart; ``tagged`` has the columns word, lemma, position, tag.
    The two single-key matches are equi-joins.
    """
    left = words.withColumn("plain_", normal(F.col(word)))
    right = tagged.select(*on, F.col(lemma).alias("lemma_r"), normal(F.col(word)).alias("plain_r"), F.col(position).alias("at_r"), F.col(tag).alias("tag_r"))
    open_ = left.filter(F.col(tag).isNull()).select(*on, "ord", F.col(lemma).alias("lemma_l"), "plain_")
    by_lemma = open_.join(right, [*on]).filter(F.col("lemma_l") == F.col("lemma_r"))
    by_word = open_.join(right, [*on]).filter((F.col("plain_") == F.col("plain_r")) & ~F.col("lemma_l").eqNullSafe(F.col("lemma_r")))
    rank = F.when(F.col("lemma_l").eqNullSafe(F.col("lemma_r")), F.when(F.col("plain_") == F.col("plain_r"), 1).otherwise(2)).otherwise(3)
    best = by_lemma.unionByName(by_word).groupBy("ord").agg(F.min_by("tag_r", F.struct(rank, "at_r")).alias("tag_new"))
    return left.join(best, "ord", "left").withColumn(tag, F.coalesce(tag, "tag_new")).drop("plain_", "tag_new")


def gloss_from_lexicon(words: DataFrame, lexicon: DataFrame, lemma: str) -> DataFrame:
    """``words`` with gloss and transliteration of the lexicon entry, the short definition before the long one.

    ``lexicon`` has (lemma_id, short_definition, definition, transliteration); ids are compared trimmed and upper-cased.
    A repeated id has its first entry.
    """
    entries = unique_rows(lexicon.withColumn("id_", F.upper(F.trim("lemma_id"))), ["id_"], F.col("lemma_id"), F.col("short_definition"))
    entries = entries.select("id_", F.coalesce(F.nullif("short_definition", F.lit("")), F.nullif("definition", F.lit(""))).alias("gloss_new"), F.col("transliteration").alias("translit_new"))
    out = words.withColumn("id_", F.upper(F.trim(lemma))).join(entries, "id_", "left")
    out = out.withColumn("gloss", F.coalesce("gloss_new", F.col("gloss") if "gloss" in words.columns else F.lit(None).cast("string")))
    out = out.withColumn("transliteration", F.coalesce("translit_new", F.col("transliteration") if "transliteration" in words.columns else F.lit(None).cast("string")))
    return out.drop("id_", "gloss_new", "translit_new")


def join_layers(base: DataFrame, layers: list[DataFrame], on: list[str]) -> DataFrame:
    """``base`` with every layer's columns; where columns share a name the first non-null value wins."""
    out = base
    for i, layer in enumerate(layers):
        own = [c for c in layer.columns if c not in on]
        out = out.join(layer.select(*on, *[F.col(c).alias(f"{c}_{i}_") for c in own]), on, "left")
        for c in own:
            out = out.withColumn(c, F.coalesce(c, f"{c}_{i}_") if c in out.columns else F.col(f"{c}_{i}_")).drop(f"{c}_{i}_")
    return out


def last_write(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) of the last row of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def repair(rows: DataFrame, other: DataFrame, on: list[str], text: str) -> DataFrame:
    """``rows`` with empty texts filled from another source and repaired saying where."""
    found = other.select(*on, F.nullif(F.trim(text), F.lit("")).alias("text_new"))
    empty = F.coalesce(F.length(F.trim(text)) == 0, F.lit(True))
    out = rows.join(found, on, "left").withColumn("repaired", empty & F.col("text_new").isNotNull())
    return out.withColumn(text, F.when(empty, F.coalesce("text_new", text)).otherwise(F.col(text))).drop("text_new")
