"""Sources of the domain as tables: JSON documents with required fields, aliased rows, chapter replies, rule sources."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.refs import BOOK_CODES, book_code
from corpusmill.functions.text import collapse, prefix_int, strip_notes, tagged_words
from corpusmill.operators.ranking import place_in_parts, range_part

#: Members that stand in the text of a cluster.
CLUSTER_MEMBERS = 25
# Header spellings of the columns of verse rows, letters and digits in lower case, the first that has a value wins.
VERSE_HEADERS = {
    "book": ("book", "bookname"), "chapter": ("chapter", "chap"), "verse": ("verse", "versenum", "v"),
    "text": ("text", "versetext", "bereanstandardbible", "bsb", "content"), "reference": ("reference", "ref"),
}


def passage_items(documents: DataFrame, body: str) -> DataFrame:
    """(passage_id, anchor_verse, verse_ids, text) of JSON documents with an array ``items``; incomplete items are left out."""
    schema = "struct<items array<struct<passageId string, anchorVerse string, verseIds array<string>, text string>>>"
    rows = documents.select(F.explode(F.from_json(F.col(body), schema)["items"]).alias("i"))
    rows = rows.filter((F.length("i.passageId") > 0) & (F.length("i.anchorVerse") > 0) & F.col("i.verseIds").isNotNull() & (F.length("i.text") > 0))
    return rows.select(F.col("i.passageId").alias("passage_id"), F.col("i.anchorVerse").alias("anchor_verse"), F.transform("i.verseIds", F.upper).alias("verse_ids"), F.col("i.text").alias("text"))


def cluster_items(documents: DataFrame, body: str) -> DataFrame:
    """(cluster_id, label, member_verse_ids, vote_total, text) of JSON documents; incomplete items are left out."""
    schema = "struct<items array<struct<clusterId string, clusterLabel string, memberVerseIds array<string>, voteTotal int>>>"
    rows = documents.select(F.explode(F.from_json(F.col(body), schema)["items"]).alias("i"))
    rows = rows.filter((F.length("i.clusterId") > 0) & (F.length("i.clusterLabel") > 0) & F.col("i.memberVerseIds").isNotNull())
    members = F.col("i.memberVerseIds")
    return rows.select(
        F.col("i.clusterId").alias("cluster_id"), F.col("i.clusterLabel").alias("label"), F.transform(members, F.upper).alias("member_verse_ids"), F.coalesce("i.voteTotal", F.lit(0)).alias("vote_total"), cluster_text(F.col("i.clusterLabel"), members).alias("text")
    )


def cluster_text(label: Column, members: Column) -> Column:
    """What is embedded for a cluster: its label and its first members."""
    return F.concat(label, F.lit(": "), F.array_join(F.slice(members, 1, CLUSTER_MEMBERS), " | "))


def aliased_verse_rows(rows: DataFrame, translation: str) -> DataFrame:
    """(book, chapter, verse, text, translation) of rows under any of several header spellings.

    A row with book, chapter, verse and text counts by these; else one with a reference ``Book c:v``, in a column of its
    own or in the verse column, and a text. Other rows are left out. ``rows`` holds strings.
    """
    plain: dict[str, str] = {}
    for c in rows.columns:
        plain["".join(x for x in c.lower() if x.isascii() and x.isalnum())] = c

    def value(name: str) -> Column:
        there = [F.col(f"`{plain[h]}`") for h in VERSE_HEADERS[name] if h in plain]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    book, chapter, verse, text = (F.nullif(value(n), F.lit("")) for n in ("book", "chapter", "verse", "text"))
    pattern = r"^(.+?)\s+(\d+):(\d+)$"
    reference = F.coalesce(F.nullif(value("reference"), F.lit("")), F.when(F.contains(verse, F.lit(":")), verse))
    whole = book.isNotNull() & chapter.isNotNull() & verse.isNotNull()
    parts = [F.regexp_extract(reference, pattern, g) for g in (1, 2, 3)]
    out = rows.filter(text.isNotNull() & (whole | F.coalesce(F.rlike(reference, F.lit(pattern)), F.lit(False))))
    return out.select(
        book_code(F.when(whole, book).otherwise(parts[0])).alias("book"), F.when(whole, prefix_int(chapter)).otherwise(prefix_int(parts[1])).alias("chapter"), F.when(whole, prefix_int(verse)).otherwise(prefix_int(parts[2])).alias("verse"),
        F.trim(text).alias("text"), F.lit(translation).alias("translation"),
    )


def numbered_verse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(ref, text) of tab-separated lines ``book number, chapter, verse, text``; notes in brackets are dropped.

    A text may hold tabs. Lines with an unknown book, no chapter or verse, or no text are left out; of lines with one
    reference the last by text counts.
    """
    parts = F.split(F.col(line), "\t")
    number, chapter, verse = (prefix_int(F.get(parts, F.lit(i))) for i in range(3))
    text = collapse(strip_notes(F.array_join(F.slice(parts, F.lit(4), F.size(parts)), "\t")))
    code = F.get(F.array(*[F.lit(c) for c in BOOK_CODES]), F.when(number >= 1, number - 1).otherwise(-1))
    rows = lines.filter(F.size(parts) >= 4).select(F.concat(code, F.lit(" "), chapter.cast("string"), F.lit(":"), verse.cast("string")).alias("ref"), text.alias("text"), chapter.alias("c"), verse.alias("v"))
    return rows.filter("ref is not null and c > 0 and v > 0 and text <> ''").groupBy("ref").agg(F.max("text").alias("text"))


def chapter_reply_range(replies: DataFrame, keys: DataFrame) -> DataFrame:
    """(key_id, text): the verses from first to last of chapter replies, joined by spaces; keys without a text get no row.

    ``replies`` has (translation, book, chapter, body) with body a JSON chapter of typed content; ``keys`` has (key_id,
    translation, book, chapter, first, last), a null last meaning one verse. Only strings of a verse's content count.
    """
    schema = "struct<chapter struct<content array<struct<type string, number int, content array<string>>>>>"
    met = keys.join(replies, ["translation", "book", "chapter"]).withColumn("c", F.from_json("body", schema)["chapter"]["content"])
    own = F.filter("c", lambda x: (x["type"] == "verse") & x["number"].between(F.col("first"), F.coalesce("last", "first")))
    strings = F.transform(own, lambda x: F.trim(F.array_join(F.filter(x["content"], lambda s: ~F.startswith(s, F.lit("{"))), "")))
    return met.select("key_id", F.trim(F.array_join(strings, " ")).alias("text")).filter("text <> ''")


def verse_reply_text(body: Column) -> Column:
    """The text of a single-verse reply: trimmed, line breaks as spaces; null if there is none."""
    return F.nullif(F.translate(F.trim(F.from_json(body, "struct<text string>")["text"]), "\n", " "), F.lit(""))


def tagged_chapter_words(replies: DataFrame, body: str) -> DataFrame:
    """(reply columns, verse, words) of JSON arrays of (verse, text) whose words carry lexicon tags."""
    schema = "array<struct<verse int, text string>>"
    rows = replies.withColumn("v_", F.explode(F.from_json(F.col(body), schema)))
    return rows.select(*[c for c in replies.columns if c != body], F.col("v_.verse").alias("verse"), tagged_words(F.regexp_replace("v_.text", "</?span[^>]*>", "")).alias("words"))


def flat_text(node) -> str:
    """The text of nested content: strings, arrays of content, and objects with text, content or children.

    An object's text counts first, then its content, then its children. Nodes wait on a stack, so depth is no limit.
    """
    out, waiting = [], [node]
    while waiting:
        x = waiting.pop()
        if isinstance(x, dict):
            plain = next((x[n] for n in ("text", "content") if isinstance(x.get(n), str)), None)
            waiting.append(plain if plain is not None else next((x[n] for n in ("content", "children") if isinstance(x.get(n), list)), None))
        elif isinstance(x, list):
            waiting += reversed(x)
        elif isinstance(x, str):
            out.append(x)
    return "".join(out)


@F.pandas_udf(T.StringType())
def flat_content(bodies: pd.Series) -> pd.Series:
    """``flat_text`` of JSON documents of any depth, which no expression reaches; null for null or broken JSON."""

    def one(body: str) -> str | None:
        try:
            return flat_text(json.loads(body))
        except ValueError:
            return None

    return bodies.map(one, na_action="ignore")


def literals_of_rules(source: Column, most_words: int = 3) -> Column:
    """The quoted literals of ``keywords: [...]`` lists in a source text, trimmed and lower-cased, of at most so many words."""
    blocks = F.regexp_extract_all(source, F.lit(r"keywords:\s*\[([^\]]+)\]"), F.lit(1))
    found = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit("'([^']+)'"), F.lit(1))))
    return F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: F.size(F.split(x, r"\s+")) <= most_words)


def numbered_batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` with batch, from 0: runs of ``size`` rows in the order of the key, numbered without a global sort in one task."""
    spread = rows.withColumn("part_", range_part(rows, key)).withColumn("all_", F.lit(0))
    placed = place_in_parts(spread, ["all_"], [(F.col("part_"), False)], [F.col(key)], "at_")
    return placed.withColumn("batch", F.floor((F.col("at_") - 1) / size).cast("int")).drop("part_", "all_", "at_")
