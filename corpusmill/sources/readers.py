"""Readers of the file layouts of the domain. Schemas are explicit; a missing path is an empty table."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.refs import expand_dotted
from corpusmill.functions.text import decode_entities, packed_fields, prefix_int, strip_notes, strongs_of_lemma, trim_any

VERSE_MAP = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
#: Header spellings of verse files, the first that is there wins.
ALIASES = {"book": ("book", "b", "book_name", "bookname"), "chapter": ("chapter", "c", "chap"), "verse": ("verse", "v", "verse_number"), "text": ("text", "t", "verse_text", "scripture")}


def first_existing(paths: list[str]) -> str | None:
    """The first path that exists, plain or with a glob, on any file system Spark reads."""
    spark = SparkSession.getActiveSession()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
        if found is not None and len(found):
            return path
    return None


def json_table(spark: SparkSession, paths: list[str], schema: T.StructType, lines: bool = False) -> DataFrame:
    """A JSON table from the first existing path, plain, gzip or any codec Hadoop knows; empty if there is none.

    Files hold one document each, or with ``lines`` one a line.
    """
    path = first_existing(paths)
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=not lines)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def translation_books(spark: SparkSession, path: str) -> DataFrame:
    """``translation_book_rows`` of files."""
    return translation_book_rows(whole_texts(spark, path))


def translation_book_rows(files: DataFrame) -> DataFrame:
    """(translation, book, chapter, verse, text) of texts named ``TRANSLATION-BOOK.json`` with chapter and verse maps."""
    files = files.withColumn("chapters", F.from_json("text", VERSE_MAP))
    name = F.regexp_extract("path", r"([^/]+?)\.json(?:\.gz)?$", 1)
    rows = files.select(F.upper(F.split_part(name, F.lit("-"), F.lit(1))).alias("translation"), F.upper(F.split_part(name, F.lit("-"), F.lit(-1))).alias("book"), F.explode("chapters").alias("chapter", "verses"))
    rows = rows.select("translation", "book", "chapter", F.explode("verses").alias("verse", "text"))
    return rows.select("translation", "book", F.col("chapter").try_cast("int").alias("chapter"), F.col("verse").try_cast("int").alias("verse"), "text")


def layer_words(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """``layer_word_rows`` of files."""
    return layer_word_rows(whole_texts(spark, path), fields)


def layer_word_rows(files: DataFrame, fields: str) -> DataFrame:
    """(book, chapter, verse, at, fields...) of texts named ``layer-BOOK.json``: chapter and verse maps of arrays of words."""
    schema = f"map<string,map<string,array<struct<{fields}>>>>"
    files = files.withColumn("chapters", F.from_json("text", schema))
    book = F.upper(F.regexp_extract("path", r"([^/-]+)\.json(?:\.gz)?$", 1))
    rows = files.select(book.alias("book"), F.explode("chapters").alias("chapter", "verses")).select("book", "chapter", F.explode("verses").alias("verse", "words"))
    rows = rows.select("book", F.col("chapter").try_cast("int").alias("chapter"), F.col("verse").try_cast("int").alias("verse"), F.posexplode("words").alias("at", "word"))
    return rows.select("book", "chapter", "verse", (F.col("at") + 1).alias("at"), "word.*")


def cross_reference_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(source, target, votes) of tab-separated lines ``from  to  votes``, ranges on either side written out.

    Lines with fewer than two fields, unreadable references and a header give no row; unreadable votes are null.
    """
    parts = F.split(F.col(line), "\t")
    rows = lines.filter(F.size(parts) >= 2).select(expand_dotted(F.trim(F.get(parts, F.lit(0)))).alias("source"), expand_dotted(F.trim(F.get(parts, F.lit(1)))).alias("target"), prefix_int(F.get(parts, F.lit(2))).alias("votes"))
    return rows.filter("source is not null and target is not null").withColumn("source", F.explode("source")).withColumn("target", F.explode("target"))


def cross_references(spark: SparkSession, path: str) -> DataFrame:
    """``cross_reference_lines`` of files."""
    return cross_reference_lines(spark.read.text(path))


def sniffed_separator(line: str) -> str:
    """The separator that splits a header line into the most fields: tab, semicolon, pipe or comma."""
    return max("\t;|,", key=lambda s: (line.count(s), s == ","))


def verse_table(spark: SparkSession, path: str, translation: str) -> DataFrame:
    """(translation, book, chapter, verse, text) of a delimited file with one of several header spellings.

    The separator is told from the first line, a byte-order mark is ignored, quotes may enclose fields. Without a known
    header the first four columns count.
    """
    head = spark.read.text(path).limit(1).collect()
    first = head[0]["value"].lstrip("﻿") if head else ""
    separator = sniffed_separator(first)
    names = [n.strip().strip('"').lower().replace(" ", "_") for n in first.split(separator)]
    places = {c: next((names.index(a) for a in aliases if a in names), None) for c, aliases in ALIASES.items()}
    has_header = all(v is not None for v in places.values())
    places = places if has_header else {c: i for i, c in enumerate(ALIASES)}
    width = max(len(names), 4)
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = spark.read.schema(schema).csv(path, sep=separator, header=has_header, quote='"', escape='"', mode="PERMISSIVE")
    book = F.ltrim(F.col(f"c{places['book']}"), F.lit("﻿"))
    return rows.select(F.lit(translation).alias("translation"), F.trim(book).alias("book"), prefix_int(F.col(f"c{places['chapter']}")).alias("chapter"), prefix_int(F.col(f"c{places['verse']}")).alias("verse"), F.trim(strip_notes(F.col(f"c{places['text']}"))).alias("text"))


def osis_words(files: DataFrame, text: str = "text") -> DataFrame:
    """(book, chapter, verse, at, word, strongs, morph) of OSIS verse and word elements."""
    verses = files.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r'(?s)(<verse\s[^>]*osisID="[^"]+"[^>]*>.*?</verse>)'), F.lit(1))).alias("v"))
    at = F.split(F.regexp_extract("v", r'osisID="([^"]+)"', 1), r"\.")
    words = verses.select(F.get(at, F.lit(0)).alias("book"), F.get(at, F.lit(1)).try_cast("int").alias("chapter"), F.get(at, F.lit(2)).try_cast("int").alias("verse"), F.posexplode(F.regexp_extract_all("v", F.lit(r"(?s)(<w\s[^>]*>.*?</w>)"), F.lit(1))).alias("at", "w"))
    lemma, morph, body = (F.regexp_extract("w", p, 1) for p in (r'lemma="([^"]*)"', r'morph="([^"]*)"', r"(?s)<w\s[^>]*>(.*?)</w>"))
    return words.select("book", "chapter", "verse", (F.col("at") + 1).alias("at"), F.replace(decode_entities(body), F.lit("/"), F.lit("")).alias("word"), strongs_of_lemma(lemma).alias("strongs"), F.nullif(morph, F.lit("")).alias("morph"))


def packed_table(spark: SparkSession, path: str, packed: int, names: list[str]) -> DataFrame:
    """A tab-separated table whose column ``packed`` holds several bracketed fields; (others as c0.., names...)."""
    return packed_rows(spark.read.text(path), packed, names)


def packed_rows(lines: DataFrame, packed: int, names: list[str]) -> DataFrame:
    """``packed_table`` of lines in a column value."""
    parts = F.split("value", "\t")
    rows = lines.select(F.transform(parts, lambda p: trim_any(p)).alias("c"), packed_fields(F.get(parts, F.lit(packed))).alias("p"))
    return rows.select("c", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)])


def wrapped_json(files: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """The JSON object, first brace to last, of files that wrap one in other text; null if it can't be read."""
    return files.select(F.from_json(F.regexp_extract(F.col(text), r"(?s)(\{.*\})", 1), schema).alias("value"))


def nested_books(files: DataFrame, text: str = "text") -> DataFrame:
    """(book, chapter, verse, text) of JSON with nested books, chapters and verses."""
    schema = "struct<books array<struct<name string, chapters array<struct<chapter int, verses array<struct<verse int, text string>>>>>>>"
    rows = files.select(F.from_json(F.col(text), schema).alias("d")).select(F.explode("d.books").alias("b")).select("b.name", F.explode("b.chapters").alias("c"))
    return rows.select(F.col("name").alias("book"), F.col("c.chapter").alias("chapter"), F.explode("c.verses").alias("v")).select("book", "chapter", "v.verse", "v.text")


def chapter_range(chapters: DataFrame, keys: DataFrame) -> DataFrame:
    """(key_id, text): the verses from first to last of a chapter table joined by spaces, trimmed.

    ``chapters`` has (book, chapter, verse, text); ``keys`` has (key_id, book, chapter, first, last).
    """
    met = keys.join(chapters, ["book", "chapter"]).filter(F.col("verse").between(F.col("first"), F.col("last")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("verse", "text"))), lambda s: s["text"])
    return met.groupBy("key_id").agg(F.trim(F.array_join(texts, " ")).alias("text"))


def content_hash(spark: SparkSession, path: str) -> str:
    """One SHA-256 over the names and contents of files, independent of their order and of how they are read.

    Each file's digest is cut into four numbers, and the sums of these over all files are hashed: no list of files is
    ever gathered.
    """
    files = spark.read.format("binaryFile").load(path)
    own = F.sha2(F.concat_ws(":", F.regexp_extract("path", "([^/]+)$", 1), F.sha2("content", 256)), 256)
    pieces = [F.sum(F.conv(F.substring("own", 16 * i + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    sums = files.select(own.alias("own")).agg(F.count("*").alias("n"), *pieces).first()
    return hashlib.sha256(repr(tuple(str(v) for v in sums)).encode()).hexdigest()


def numbered_last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("last_", F.row_number().over(by)).filter("last_ = 1").drop("last_")


def local_files(folder: str, suffix: str) -> list[str]:
    """Files of a local folder by suffix, sorted."""
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(suffix))
