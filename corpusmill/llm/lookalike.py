"""Visually identical text: one skeleton per appearance.

A text is decomposed, characters that don't show are dropped, every character is replaced by its prototype from a
look-alike table, and the result is decomposed again. Texts with equal skeletons may look the same. The table is read
from the Unicode confusables data of the ICU library that Spark ships, one look-up for every assigned code point. Since those data also join characters that differ visibly (capital and small theta, points on either side of
a letter), texts with equal skeletons are then compared character by character: two different letters or two different
marks of one script never look the same.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compatibility decompositions that change the width or the shape variant of a character, not what is seen.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
_TABLES: dict[str, dict[str, str]] = {}


def lookalike_table(spark: SparkSession) -> dict[str, str]:
    """Character to prototype, for every assigned character that isn't its own; read once per application."""
    key = spark.sparkContext.applicationId
    if key not in _TABLES:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        chars = [c for c in map(chr, range(33, 0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co", "Zs", "Zl", "Zp", "Cf", "Cc")]
        images = checker.getSkeleton("\n".join(chars)).split("\n")
        if len(images) != len(chars):
            raise RuntimeError("the look-alike data don't map character by character")
        _TABLES.clear()
        _TABLES[key] = {c: s for c, s in zip(chars, images, strict=True) if c != s}
    return _TABLES[key]


@lru_cache(maxsize=1 << 16)
def _shown_character(c: str) -> str:
    """How one decomposed character is displayed: one kind of space, nothing invisible, no width."""
    kind = unicodedata.category(c)
    if kind in ("Zs", "Zl", "Zp") or c in "\t\n\r\x0b\x0c\x85":
        return " "
    if kind in ("Cf", "Cc") or c == "\u034f" or "\ufe00" <= c <= "\ufe0f":
        return ""
    how = unicodedata.decomposition(c)
    letterlike = how.startswith("<compat>") and len(how.split()) == 2 and kind == "Lo"
    return unicodedata.normalize("NFKD", c) if how.startswith(SAME_LOOK) or letterlike else c


def _shown(text: str) -> str:
    """The text as it is displayed: decomposed, characters as shown, no outer spaces."""
    return unicodedata.normalize("NFD", "".join(map(_shown_character, unicodedata.normalize("NFD", text)))).strip(" ")


def skeleton(text: str, table: dict[str, str]) -> str:
    """Decompose, replace by prototypes, decompose again."""
    return unicodedata.normalize("NFD", "".join([table.get(c, c) for c in _shown(text)]))


def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    return "COMBINING" if name.startswith("COMBINING") else name.partition(" ")[0]


def looks_same(a: str, b: str, table: dict[str, str]) -> bool:
    """Whether two texts of equal skeleton differ nowhere visibly.

    Characters pair up one to one. Different letters pair up only across scripts; different marks of one script, such
    as the points of one alphabet, don't.
    """
    x, y = _shown(a), _shown(b)
    if x == y:
        return True
    if len(x) != len(y):
        return False
    for c, d in zip(x, y, strict=True):
        if c == d:
            continue
        if table.get(c, c) != table.get(d, d):
            return False
        kinds = unicodedata.category(c)[0] + unicodedata.category(d)[0]
        if kinds in ("LL", "MM") and _script(c) == _script(d) and _script(c) not in ("MODIFIER", "COMBINING", "LATIN"):
            return False
        if kinds in ("LN", "NL") or (kinds == "LL" and unicodedata.category(c) != unicodedata.category(d) and {unicodedata.category(c), unicodedata.category(d)} == {"Lu", "Ll"}):
            return False
    return True


def with_skeletons(df: DataFrame, text: str) -> DataFrame:
    """(form, skeleton) for the distinct non-null values of ``text``; the value itself is ``form``."""
    table = df.sparkSession.sparkContext.broadcast(lookalike_table(df.sparkSession))

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: skeleton(v, table.value))

    return df.select(F.col(text).alias("form")).filter(F.col("form").isNotNull()).distinct().withColumn("skeleton", of("form"))


def skeleton_groups(df: DataFrame, text: str) -> DataFrame:
    """(form, skeleton, group_form, forms): each distinct text, its skeleton, the group's representative and size.

    The representative is the group's smallest member in binary order. Null is in no group; the empty text and texts
    that show nothing form the group of the empty skeleton. Repeated texts count once. An empty table gives an empty
    result.
    """
    forms = with_skeletons(df, text)
    heads = forms.groupBy("skeleton").agg(F.min("form").alias("group_form"), F.count("*").alias("forms"))
    return forms.join(heads, "skeleton")


def match_forms(words: DataFrame, word: str, forms: DataFrame, form_id: str, form: str) -> DataFrame:
    """(text, form_id): each distinct text of ``words`` that isn't a listed form but looks like one.

    Texts equal to a listed form code point for code point, null texts and texts that show nothing give no row.
    Texts are reduced to distinct ones first, so a word repeated in a third of all rows costs as much as a rare one.
    """
    table = words.sparkSession.sparkContext.broadcast(lookalike_table(words.sparkSession))

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([looks_same(x, y, table.value) for x, y in zip(a, b, strict=True)], dtype=bool)

    listed = forms.select(F.col(form_id).alias("form_id"), F.col(form).alias("listed")).dropna()
    wanted = with_skeletons(listed, "listed").join(listed, F.col("form") == F.col("listed")).select("skeleton", "listed", "form_id")
    texts = with_skeletons(words, word).filter(F.length("skeleton") > 0).join(listed.select(F.col("listed").alias("form")).distinct(), "form", "left_anti")
    near = texts.join(wanted, "skeleton").filter(same("form", "listed"))
    return near.select(F.col("form").alias("text"), "form_id").distinct()
