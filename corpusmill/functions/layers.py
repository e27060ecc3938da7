"""One-line previews of the word layers of a verse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(texts: Column, most: int, between: str) -> Column:
    return F.array_join(F.slice(texts, 1, most), between)


def _labelled(label: str, texts: Column, most: int, between: str = "; ") -> Column:
    return F.when(F.size(texts) > 0, F.concat(F.lit(label), _first(texts, most, between)))


def hebrew_preview(words: Column, paragraph: Column, poetic: Column, alignments: Column, gloss: Column) -> Column:
    """Clauses, breaks, alignments and glosses of a verse; null parts are left out, an empty string if all are.

    ``words`` is array<struct<w, c>>, ``paragraph`` and ``poetic`` are arrays of places, ``gloss`` array<struct<w, g>>.
    """
    clauses = F.array_distinct(F.filter(F.transform(words, lambda x: x["c"]), lambda c: F.length(c) > 0))
    glosses = F.transform(F.filter(gloss, lambda x: F.length(x["g"]) > 2), lambda x: F.concat(x["w"], F.lit("="), x["g"]))
    pairs = F.when(F.size(alignments) > 0, F.concat(F.lit("Alignments: "), F.size(alignments).cast("string"), F.lit(" word pairs")))
    many = 1 << 20
    return F.concat_ws(" | ", _labelled("Clauses: ", clauses, many, ", "), _labelled("Paragraph break at word(s) ", paragraph.cast("array<string>"), many, ", "), _labelled("Poetic line break at word(s) ", poetic.cast("array<string>"), many, ", "), pairs, _labelled("Glosses: ", glosses, 3))


def greek_preview(morphology: Column, interlinear: Column, clause_ids: Column, clause_texts: Column) -> Column:
    """Morphology, interlinear glosses and clauses of a verse.

    ``morphology`` is array<struct<w, s, r>>, ``interlinear`` array<struct<w, i>>, ``clause_texts`` map<id, text>.
    """
    def tagged(x: Column) -> Column:
        tags = F.concat_ws(" ", F.nullif(x["s"], F.lit("")), F.nullif(x["r"], F.lit("")))
        return F.when(tags != "", F.concat(x["w"], F.lit(" ("), tags, F.lit(")"))).otherwise(x["w"])

    glosses = F.transform(F.filter(interlinear, lambda x: F.length(x["i"]) > 0), lambda x: F.concat(x["w"], F.lit("="), x["i"]))
    previews = F.array_compact(F.transform(clause_ids, lambda i: F.try_element_at(clause_texts, i)))
    clause = F.when(F.size(clause_ids) > 0, F.concat(F.lit("Clause: "), F.array_join(clause_ids, ", "), F.when(F.size(previews) > 0, F.concat(F.lit(" ("), _first(previews, 2, " | "), F.lit(")"))).otherwise("")))
    return F.concat_ws(" | ", _labelled("Greek morphology: ", F.transform(morphology, tagged), 4), _labelled("Interlinear: ", glosses, 4), clause)
