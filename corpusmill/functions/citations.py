"""Citations in running text: extraction, normalisation, validation and removal."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.refs import book_name

# A citation by code or by name, not preceded by a book number.
CITATION = r"(?<![1-3]\s)\b(?:[1-3][A-Z]{2}|[A-Z]{2,3}|[1-3]\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+\d+:\d+(?:[-–]\d+)?\b"
_BLANKS = r"[ \n\r\t\f\x0B]+"


def normal_citation(citation: Column) -> Column:
    """Trimmed, without closing punctuation, white space runs as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(citation), r"[()\[\],.;:!?]+$", ""), _BLANKS, " "))


def citations(text: Column) -> Column:
    """The citations of a text in order, normalised, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({CITATION})"), F.lit(1)), normal_citation)


def long_citation(citation: Column) -> Column:
    """A citation by code with the book's name written out; others trimmed."""
    pattern = r"(?i)^([1-3]?[A-Z]{2,3})\s+(\d+:\d+(?:[-–]\d+)?)$"
    trimmed = F.trim(citation)
    spelled = F.concat(book_name(F.upper(F.regexp_extract(trimmed, pattern, 1))), F.lit(" "), F.regexp_extract(trimmed, pattern, 2))
    return F.when(F.rlike(trimmed, F.lit(pattern)), spelled).otherwise(trimmed)


def whitelist(references: Column) -> Column:
    """Distinct long forms of an array of references, in order, empty ones dropped."""
    return F.array_distinct(F.filter(F.transform(references, long_citation), lambda r: r != ""))


def invalid_citations(answers: DataFrame, allowed: DataFrame, answer_id: str, text: str, reference: str) -> DataFrame:
    """(answer_id, citation): the distinct citations of each answer that none of its references allow.

    ``allowed`` has (answer_id, reference). Citations and references compare by their long forms without regard to
    case; without references every citation is invalid.
    """
    cited = answers.select(answer_id, F.explode(citations(F.col(text))).alias("citation")).filter("citation <> ''").distinct()
    good = allowed.select(answer_id, F.lower(long_citation(normal_citation(F.col(reference)))).alias("key_")).distinct()
    return cited.withColumn("key_", F.lower(long_citation(F.col("citation")))).join(good, [answer_id, "key_"], "left_anti").select(answer_id, "citation")


CLOSERS = {"(": ")", "[": "]"}


def without_citations(text: str, unwanted: list[str]) -> str:
    """A text without the given citations, without the brackets that held them, and without the gaps that are left.

    One pass over the brackets and citations of the text. Open brackets wait on a stack with the place where they began
    and whether an unwanted citation stood in them; one that closes with such a citation in it takes all it holds away,
    and so does one that holds nothing.
    """
    marks = sorted({c for c in unwanted if c}, key=len, reverse=True)
    if not marks:
        return text
    kept: list[str] = []
    waiting: list[tuple[str, int, bool]] = []
    for part in re.split("(" + "|".join([*map(re.escape, marks), r"[()\[\]]"]) + ")", text):
        if part in marks:
            if waiting:
                waiting[-1] = (*waiting[-1][:2], True)
        elif part in CLOSERS:
            waiting.append((CLOSERS[part], len(kept), False))
            kept.append(part)
        elif waiting and part == waiting[-1][0]:
            _, began, spoiled = waiting.pop()
            if spoiled or not "".join(kept[began + 1 :]):
                del kept[began:]
            else:
                kept.append(part)
        elif part:
            kept.append(part)
    lines = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(kept)))
    return re.sub(r" (?=[,.;:!?])", "", lines).strip()


@F.pandas_udf(T.StringType())
def scrub(texts: pd.Series, unwanted: pd.Series) -> pd.Series:
    """``without_citations`` over columns: nested brackets need a stack, which no expression has."""
    return pd.Series([None if t is None else without_citations(t, list(u) if u is not None else []) for t, u in zip(texts, unwanted, strict=True)])


def scrub_answers(answers: DataFrame, allowed: DataFrame, answer_id: str, text: str, reference: str) -> DataFrame:
    """``answers`` with invalid citations removed from the text and listed in removed, in order of the text."""
    bad = invalid_citations(answers, allowed, answer_id, text, reference).groupBy(answer_id).agg(F.collect_set("citation").alias("bad_"))
    out = answers.join(bad, answer_id, "left")
    removed = F.array_distinct(F.filter(citations(F.col(text)), lambda c: F.array_contains(F.coalesce("bad_", F.array().cast("array<string>")), c)))
    return out.withColumn("removed", removed).withColumn(text, F.when(F.size("removed") > 0, scrub(F.col(text), F.col("removed"))).otherwise(F.col(text))).drop("bad_")
