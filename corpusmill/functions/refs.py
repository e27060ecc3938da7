"""References to verses: the book dimension, parsers, ranges and their expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The codes of the books in canonical order, 39 of the first testament and 27 of the second.
BOOK_CODES = (
    "GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH EST JOB PSA PRO ECC SNG ISA JER LAM EZK DAN HOS JOL AMO OBA JON MIC NAM HAB ZEP HAG ZEC MAL "
    "MAT MRK LUK JHN ACT ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE 2PE 1JN 2JN 3JN JUD REV"
).split()
# The names of the books in the same order.
BOOK_NAMES = (
    "Genesis,Exodus,Leviticus,Numbers,Deuteronomy,Joshua,Judges,Ruth,1 Samuel,2 Samuel,1 Kings,2 Kings,1 Chronicles,2 Chronicles,Ezra,Nehemiah,Esther,Job,Psalms,Proverbs,"
    "Ecclesiastes,Song of Solomon,Isaiah,Jeremiah,Lamentations,Ezekiel,Daniel,Hosea,Joel,Amos,Obadiah,Jonah,Micah,Nahum,Habakkuk,Zephaniah,Haggai,Zechariah,Malachi,"
    "Matthew,Mark,Luke,John,Acts,Romans,1 Corinthians,2 Corinthians,Galatians,Ephesians,Philippians,Colossians,1 Thessalonians,2 Thessalonians,1 Timothy,2 Timothy,Titus,"
    "Philemon,Hebrews,James,1 Peter,2 Peter,1 John,2 John,3 John,Jude,Revelation"
).split(",")
FIRST_TESTAMENT = 39
# Spellings that no rule below yields.
EXTRA_ALIASES = {"JN": "JHN", "JO": "JHN", "PS": "PSA", "PSALM": "PSA", "MAR": "MRK", "JAM": "JAS", "PHI": "PHP", "EZE": "EZK", "JOE": "JOL", "NAH": "NAM", "SONG": "SNG", "SONGS": "SNG", "SOS": "SNG", "GE": "GEN", "EX": "EXO", "RM": "ROM", "JOH": "JHN", "JDE": "JUD", "JDGS": "JDG"}


def book_aliases() -> dict[str, str]:
    """Upper-case spellings without spaces to codes: codes, names, and prefixes of names that only one book has."""
    out: dict[str, str] = {}
    prefixes: dict[str, set[str]] = {}
    for code, name in zip(BOOK_CODES, BOOK_NAMES, strict=True):
        flat = name.upper().replace(" ", "")
        for n in range(3, len(flat) + 1):
            prefixes.setdefault(flat[:n], set()).add(code)
    out |= {p: next(iter(codes)) for p, codes in prefixes.items() if len(codes) == 1}
    out |= {name.upper().replace(" ", ""): code for code, name in zip(BOOK_CODES, BOOK_NAMES, strict=True)}
    out |= EXTRA_ALIASES
    return out | {code: code for code in BOOK_CODES}


def book_dimension(spark: SparkSession) -> DataFrame:
    """(code, ordinal, testament, name) of the 66 books."""
    rows = [(code, i + 1, "OT" if i < FIRST_TESTAMENT else "NT", name) for i, (code, name) in enumerate(zip(BOOK_CODES, BOOK_NAMES, strict=True))]
    return spark.createDataFrame(rows, "code string, ordinal int, testament string, name string")


def _lookup(values: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def book_code(book: Column, strict: bool = False) -> Column:
    """The code of a book in any known spelling; an unknown one passes through upper-cased, or is null if ``strict``."""
    flat = F.upper(F.regexp_replace(book, r"[\s.]+", ""))
    known = _lookup(book_aliases(), flat)
    return known if strict else F.coalesce(known, F.upper(F.trim(book)))


def book_name(code: Column) -> Column:
    """The display name of a code; an unknown code passes through."""
    return F.coalesce(_lookup(dict(zip(BOOK_CODES, BOOK_NAMES, strict=True)), F.upper(code)), code)


def book_ordinal(code: Column) -> Column:
    """The place of a book in canonical order from 1; null if unknown."""
    return F.nullif(F.array_position(F.array(*[F.lit(c) for c in BOOK_CODES]), F.upper(code)), F.lit(0)).cast("int")


def testament(code: Column) -> Column:
    """OT or NT; null for an unknown code."""
    place = book_ordinal(code)
    return F.when(place <= FIRST_TESTAMENT, "OT").when(place.isNotNull(), "NT")


def verse_id(book: Column, chapter: Column, verse: Column) -> Column:
    """``BOOK c:v`` with the book trimmed and upper-cased; null if a part is null."""
    return F.concat(F.upper(F.trim(book)), F.lit(" "), chapter.cast("string"), F.lit(":"), verse.cast("string"))


def parse_verse(reference: Column) -> Column:
    """struct<book, chapter, verse, verse_end> of ``BBB c:v`` or ``BBB c:v-w``; null where it isn't one."""
    pattern = r"^\s*([1-3]?[A-Za-z]{2,3})\s+(\d+):(\d+)(?:[-–](\d+))?\s*$"
    chapter, verse, end = (F.regexp_extract(reference, pattern, g).try_cast("int") for g in (2, 3, 4))
    parsed = F.struct(F.upper(F.regexp_extract(reference, pattern, 1)).alias("book"), chapter.alias("chapter"), verse.alias("verse"), F.coalesce(end, verse).alias("verse_end"))
    return F.when(F.rlike(reference, F.lit(pattern)) & chapter.isNotNull() & verse.isNotNull(), parsed)


def parse_dotted(reference: Column) -> Column:
    """struct<book, chapter, verse> of ``Book.c.v``, the book in any spelling; null where it isn't one."""
    pattern = r"^\s*([1-3]?\s*[A-Za-z]+)\.(\d+)\.(\d+)\s*$"
    parsed = F.struct(
        book_code(F.regexp_extract(reference, pattern, 1)).alias("book"), F.regexp_extract(reference, pattern, 2).try_cast("int").alias("chapter"), F.regexp_extract(reference, pattern, 3).try_cast("int").alias("verse")
    )
    return F.when(F.rlike(reference, F.lit(pattern)), parsed)


def expand_dotted(reference: Column) -> Column:
    """Verse ids of a dotted reference or range: all verses within one chapter, else both ends; null if unreadable."""
    start, end = parse_dotted(F.split_part(reference, F.lit("-"), F.lit(1))), parse_dotted(F.split_part(reference, F.lit("-"), F.lit(2)))
    single = ~F.contains(reference, F.lit("-"))
    same = (start["book"] == end["book"]) & (start["chapter"] == end["chapter"]) & (start["verse"] <= end["verse"])

    def key(p: Column, verse: Column) -> Column:
        return verse_id(p["book"], p["chapter"], verse)

    run = F.transform(F.sequence(start["verse"], F.when(same, end["verse"]).otherwise(start["verse"])), lambda v: key(start, v))
    return (
        F.when(single & start.isNotNull(), F.array(key(start, start["verse"])))
        .when(start.isNotNull() & end.isNotNull() & same, run)
        .when(start.isNotNull() & end.isNotNull(), F.array(key(start, start["verse"]), key(end, end["verse"])))
    )


#: How a reference stands in running text.
IN_TEXT = r"\b((?:[1-3]\s*)?[A-Za-z]{2,}(?:\s+of\s+[A-Za-z]+)?)\.?\s+(\d{1,3})\s*:\s*(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?\b"


def references_in(text: Column) -> Column:
    """array<struct<book, chapter, verse, verse_end>> of the references to known books in running text, in order."""
    whole = F.regexp_extract_all(text, F.lit(f"({IN_TEXT})"), F.lit(1))

    def one(t: Column) -> Column:
        parts = [F.regexp_extract(t, f"^{IN_TEXT}$", g) for g in (1, 2, 3, 4)]
        verse = parts[2].try_cast("int")
        return F.struct(book_code(parts[0], strict=True).alias("book"), parts[1].try_cast("int").alias("chapter"), verse.alias("verse"), F.coalesce(parts[3].try_cast("int"), verse).alias("verse_end"))

    return F.filter(F.transform(whole, one), lambda r: r["book"].isNotNull())


def reference_ids(parsed: Column) -> Column:
    """The verse ids of parsed references, ranges written out, each once in order. A range that runs backwards is its start."""
    runs = F.transform(parsed, lambda r: F.transform(F.sequence(r["verse"], F.greatest(r["verse"], r["verse_end"])), lambda v: verse_id(r["book"], r["chapter"], v)))
    return F.array_distinct(F.flatten(runs))


def passage_id(verses: Column) -> Column:
    """``B.c.v-c.v`` of the first and last id of a window; null for an empty one."""
    def dotted(v: Column) -> Column:
        return F.regexp_replace(v, r"^\S+ (\d+):(\d+)$", "$1.$2")

    first = F.try_element_at(verses, F.lit(1))
    return F.concat(F.split_part(first, F.lit(" "), F.lit(1)), F.lit("."), dotted(first), F.lit("-"), dotted(F.try_element_at(verses, F.lit(-1))))


def locale_key(reference: Column) -> Column:
    """A key whose binary order is the order in which references are listed, shorter numbers first."""
    return F.translate(reference, ":", ".")
