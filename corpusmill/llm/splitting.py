"""Splitting oversized passages at natural boundaries.

A text is a sequence of tokens, words with the white space after them; prefix sums of their lengths are the offsets at
which it can be cut between words. Some of these are starts of sentences, and some starts of verses. Each kind is a
sorted array of boundaries: a piece ends at the last verse start within both limits, found by binary search; where no
verse start fits, at the last sentence start; else between words; else hard at the limit. From a cut where a verse
starts the next piece steps back by the overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE_END = re.compile(r"[.!?…]+[\"'”’)\]]*\s+")
TOKEN = re.compile(r"\S+\s*|\s+")
PIECE = "array<struct<piece int, char_from int, char_to int, verse_from int, verse_to int, cut string>>"


def word_offsets(text: str) -> list[int]:
    """Where each token but the first starts: prefix sums of the tokens' lengths."""
    lengths = [len(t) for t in TOKEN.findall(text)]
    return np.cumsum(lengths[:-1]).tolist() if len(lengths) > 1 else []


def sentence_offsets(text: str) -> list[int]:
    return [m.end() for m in SENTENCE_END.finditer(text) if m.end() < len(text)]


def verse_starts(text: str, count: int, openings: list[tuple[int, str]]) -> tuple[list[int], list[bool]]:
    """Offsets where each of ``count`` verses starts, and whether each is a boundary that the text shows.

    ``openings`` are possible first words of verses, (verse number from 0, words). Their occurrences at the start of a
    word form the longest chain rising in both verse and offset. A verse without an occurrence is only placed between
    its neighbours, on sentence starts where there are enough, else on word starts, else evenly: such a place says
    which verses a piece is likely to hold, but isn't a boundary between verses.
    """
    hits: list[tuple[int, int]] = []
    for number, words in openings:
        at = text.find(words) if words else -1
        while at >= 0:
            if (number == 0) == (at == 0) and (at == 0 or text[at - 1].isspace()):
                hits.append((number, at))
            at = text.find(words, at + 1)
    hits = sorted(set(hits), key=lambda h: (h[0], -h[1]))
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(hits)
    for i, (_, at) in enumerate(hits):
        k = bisect_left(tails, at)
        back[i] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [at], [i]
    known = {0: 0}
    i = ends[-1] if ends else -1
    while i >= 0:
        known[hits[i][0]] = hits[i][1]
        i = back[i]
    known[0] = 0
    shown = [k in known for k in range(count)]
    known[count] = len(text)
    marks = sorted(known)
    sentences, words = sentence_offsets(text), word_offsets(text)
    for a, b in zip(marks, marks[1:], strict=False):
        missing, low, high = b - a - 1, known[a], known[b]
        if not missing:
            continue
        for grid in (sentences, words, range(len(text) + 1)):
            inside = grid[bisect_right(grid, low) : bisect_left(grid, high)]
            if len(inside) >= missing or isinstance(grid, range):
                break
        for k in range(1, missing + 1):
            place = (k * (len(inside) + 1)) // (missing + 1) - 1
            known[a + k] = inside[max(0, place)] if len(inside) else min(low, len(text))
    return [known[k] for k in range(count)], shown


def _last_within(grid: list[int], low: int, high: int) -> int | None:
    """The last offset of a sorted array above ``low`` and up to ``high``."""
    k = bisect_right(grid, high) - 1
    return grid[k] if k >= 0 and grid[k] > low else None


def cut_pieces(text: str, starts: list[int], max_chars: int, max_verses: int, overlap: int, shown: list[bool] | None = None) -> list[tuple[int, int, int, int, str]]:
    """Pieces (char_from, char_to, verse_from, verse_to, cut) within both limits; ends are exclusive.

    ``cut`` says what the piece ends at: verse, sentence, space, hard, or end; only starts that are ``shown`` (all by
    default) count as verse boundaries. Pieces cover the whole text and all verses. After a cut where a verse starts
    the next piece repeats ``overlap`` verses, fewer where they and the next verse don't fit together.
    """
    max_chars, max_verses = max(1, max_chars), max(1, max_verses)
    size, count = len(text), len(starts)
    overlap = max(0, min(overlap, max_verses - 1))
    edges = [*starts, size]
    sure = [e for e, s in zip(starts, shown if shown is not None else [True] * count, strict=True) if s]
    grids = (("verse", sure), ("sentence", sentence_offsets(text)), ("space", word_offsets(text)))
    out: list[tuple[int, int, int, int, str]] = []
    at, verse = 0, 0
    while True:
        reach = min(verse + max_verses, count)
        limit = min(at + max_chars, edges[reach])
        if limit >= size and reach == count:
            return [*out, (at, size, verse, count, "end")]
        end, kind = limit, "hard"
        for name, grid in grids:
            found = _last_within(grid, at, limit)
            if found is not None:
                end, kind = found, name
                break
        ahead = min(reach, bisect_right(edges, end, lo=verse) - 1)  # verses that start up to the end
        if ahead > verse and edges[ahead] == end:
            out.append((at, end, verse, ahead, kind))
            step = max(ahead - overlap, verse + 1)
            while step < ahead and edges[min(ahead + 1, count)] - edges[step] > max_chars:
                step += 1
            at, verse = edges[step], step
            continue
        out.append((at, end, verse, min(max(ahead, verse) + 1, count), kind))
        at = end
        while verse + 1 < count and edges[verse + 1] <= at:
            verse += 1


def split_oversized(passages: DataFrame, limits: DataFrame, verses: DataFrame | None = None) -> DataFrame:
    """Pieces of every passage: (passage_id, oversized, piece, char_from, char_to, text, verse_ids, cut).

    ``passages`` has passage_id, verse_ids, text, embedding_model; ``limits`` has embedding_model, max_chars,
    max_verses, overlap_verses; ``verses``, where given, has book, chapter, verse, text, whose first words help to find
    where verses start within a passage. Lengths count code points. A passage within its limits, or whose model is null
    or unlisted (a null limit limits nothing), is one piece, so every passage has at least one; only oversized passages
    go through Python. A null text counts as empty and null verse_ids as none: such pieces carry an empty text or an
    empty list. A repeated passage_id gives the pieces of each of its rows; a model listed twice has its smallest
    limits. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    bounds = limits.groupBy("embedding_model").agg(*[F.min(c).alias(c) for c in ("max_chars", "max_verses", "overlap_verses")])
    rows = passages.select("passage_id", F.coalesce("verse_ids", F.array().cast("array<string>")).alias("verse_ids"), F.coalesce("text", F.lit("")).alias("text"), "embedding_model")
    rows = rows.join(F.broadcast(bounds), "embedding_model", "left")  # one row per embedding model
    over = F.coalesce(F.char_length("text") > F.col("max_chars"), F.lit(False)) | F.coalesce(F.size("verse_ids") > F.col("max_verses"), F.lit(False))
    rows = rows.withColumn("oversized", over)
    whole = rows.filter(~F.col("oversized")).select("passage_id", "oversized", F.lit(0).alias("piece"), F.lit(0).alias("char_from"), F.char_length("text").alias("char_to"), "text", "verse_ids", F.lit("end").alias("cut"))
    large = rows.filter("oversized")
    if verses is not None:
        opening = F.regexp_extract(F.col("text"), r"^\s*(\S+(?:\s+\S+){0,2})", 1)
        ref = F.concat(F.upper(F.trim("book")), F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), F.col("verse").cast("string"))
        known = verses.select(ref.alias("ref"), opening.alias("opening")).filter((F.length("opening") > 0) & F.col("ref").isNotNull()).distinct()
        asked = large.select("passage_id", F.posexplode("verse_ids").alias("number", "ref"))
        found = asked.join(known, "ref").groupBy("passage_id").agg(F.collect_set(F.struct("number", "opening")).alias("openings"))
        large = large.join(found, "passage_id", "left")
    else:
        large = large.withColumn("openings", F.lit(None).cast("array<struct<number:int,opening:string>>"))

    @F.pandas_udf(PIECE)
    def pieces(text: pd.Series, ids: pd.Series, openings: pd.Series, chars: pd.Series, most: pd.Series, overlap: pd.Series) -> pd.Series:
        out = []
        for t, i, o, c, m, v in zip(text, ids, openings, chars, most, overlap, strict=True):
            starts, shown = verse_starts(t, len(i), sorted((x["number"], x["opening"]) for x in o) if o is not None else [])
            cuts = cut_pieces(t, starts, int(c) if c == c and c is not None else 1 << 60, int(m) if m == m and m is not None else 1 << 30, int(v) if v == v and v is not None else 0, shown)
            out.append([{"piece": k, "char_from": x[0], "char_to": x[1], "verse_from": x[2], "verse_to": x[3], "cut": x[4]} for k, x in enumerate(cuts)])
        return pd.Series(out)

    cut = large.withColumn("p", F.explode(pieces("text", "verse_ids", "openings", "max_chars", "max_verses", "overlap_verses")))
    p = F.col("p")
    cut = cut.select(
        "passage_id", "oversized", p["piece"].alias("piece"), p["char_from"].alias("char_from"), p["char_to"].alias("char_to"),
        F.substring("text", p["char_from"] + 1, p["char_to"] - p["char_from"]).alias("text"),
        F.slice("verse_ids", p["verse_from"] + 1, p["verse_to"] - p["verse_from"]).alias("verse_ids"), p["cut"].alias("cut"),
    )
    return whole.unionByName(cut)
