"""Decoding of Hebrew morphology codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of a code and what they say.
STEMS = {"q": "Qal", "Q": "Qal", "p": "Piel", "P": "Pual", "h": "Hiphil", "H": "Hophal", "n": "Niphal", "N": "Niphal", "t": "Hithpael", "T": "Hithpael", "o": "Hithpoel", "O": "Hithpoel"}
ASPECTS = {"p": "Perfect", "q": "Sequential Perfect", "i": "Imperfect", "w": "Wayyiqtol", "j": "Jussive", "v": "Imperative", "h": "Cohortative", "r": "Participle", "s": "Passive Participle", "a": "Infinitive Absolute", "c": "Infinitive Construct"}
PERSONS = {"1": "1st Person", "2": "2nd Person", "3": "3rd Person"}
GENDERS = {"m": "Masculine", "f": "Feminine", "c": "Common"}
NUMBERS = {"s": "Singular", "p": "Plural", "d": "Dual"}
STATES = {"a": "Absolute", "c": "Construct", "d": "Determined"}
LABELS = {"N": "Noun", "A": "Adjective", "P": "Pronoun"}
PLAIN = {"R": "Preposition", "C": "Conjunction", "D": "Adverb"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _joined(head: Column, rest: Column) -> Column:
    return F.array_join(F.concat(head, F.array_compact(rest)), ", ")


def _segment(s: Column) -> Column:
    first = F.substring(s, 1, 1)
    verb = _joined(
        F.array_compact(F.array(F.lit("Verb"), F.try_element_at(_map(STEMS), F.substring(s, 2, 1)), F.try_element_at(_map(ASPECTS), F.substring(s, 3, 1)))),
        F.transform(_letters(F.substring(s, F.lit(4), F.length(s))), lambda c: F.try_element_at(_map(STATES | NUMBERS | GENDERS | PERSONS), c)),
    )
    noun = _joined(
        F.array(F.try_element_at(_map(LABELS), first)),
        F.transform(_letters(F.substring(s, F.lit(2), F.length(s))), lambda c: F.try_element_at(_map(STATES | NUMBERS | GENDERS | {"c": "Common", "p": "Proper"}), c)),
    )
    article = F.when(F.contains(s, F.lit("d")), "Definite Article").otherwise("Particle")
    return F.when(first == "V", verb).when(first.isin(*LABELS), noun).when(first == "T", article).otherwise(F.try_element_at(_map(PLAIN), first))


def describe_morphology(code: Column) -> Column:
    """What a code such as ``HVqp3ms`` or ``HC/Ncfsa`` says, its parts joined by slashes; null if nothing is known of it."""
    bare = F.regexp_replace(F.trim(code), "^[HA]", "")
    parts = F.array_compact(F.transform(F.split(bare, "/"), _segment))
    return F.when(F.size(parts) > 0, F.array_join(parts, " / "))
