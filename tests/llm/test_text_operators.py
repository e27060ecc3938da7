import random

import pytest

from corpusmill.llm import lookalike, splitting
from corpusmill.llm.queries import p3_found


@pytest.fixture(scope="module")
def table(spark):
    return lookalike.lookalike_table(spark)


@pytest.mark.parametrize(
    ("word", "form", "same"),
    [
        ("λόγος", "λόγος", True),
        ("λόγoς​", "λόγος", True),
        (" λо́γος　", "λόγος", True),
        ("Ｍｓ７", "Ms7", True),
        ("λογος", "λόγος", False),
        ("Θεός", "θεός", False),
        ("λὸγος", "λόγος", False),
        ("[λόγος]", "λόγος", False),
        ("שָׁ", "שָׁ", True),
        ("שׁ", "שׁ", True),
        ("שׂ", "שׁ", False),
        ("ℵב", "אב", True),
        ("א∶", "א׃", True),
        ("ן", "ו", False),
    ],
)
def test_what_looks_the_same(table, word, form, same):
    assert (lookalike.skeleton(word, table) == lookalike.skeleton(form, table) and lookalike.looks_same(word, form, table)) is same


def test_matches_and_groups(spark):
    words = spark.createDataFrame([("lógos", 1), ("lógos", 2), ("lо́gos", 3), (None, 4), ("", 5), ("​", 6), ("logos", 7), ("lо́gos", 8)], "w string, skeleton int")
    forms = spark.createDataFrame([(10, "lógos"), (11, None), (None, "x")], "form_id long, form string")
    got = {tuple(r) for r in lookalike.match_forms(words, "w", forms, "form_id", "form").collect()}
    assert got == {("lógos", 10), ("lо́gos", 10)}
    groups = {r["form"]: (r["group_form"], r["forms"]) for r in lookalike.skeleton_groups(words, "w").collect()}
    assert groups["lógos"] == ("lógos", 3) and groups[""] == ("", 2) and groups["logos"] == ("logos", 1)
    assert lookalike.match_forms(words.limit(0), "w", forms, "form_id", "form").count() == 0


def test_very_long_text(table):
    assert len(lookalike.skeleton("á" * 200_000, table)) == 400_000


LIMITS = [("m", 60, 3, 1), ("m", 50, 3, 1), ("wide", 1000, 40, 2)]


def passages(spark, rows):
    return spark.createDataFrame([(*r, "own", 1) for r in rows], "passage_id string, verse_ids array<string>, text string, embedding_model string, cut string, piece int")


def limits(spark):
    return spark.createDataFrame([(*x, "z") for x in LIMITS], "embedding_model string, max_chars int, max_verses int, overlap_verses int, oversized string")


def test_pieces_keep_the_limits_and_the_text(spark):
    rng = random.Random(2)
    verses, rows = [], []
    for p in range(40):
        count = rng.randrange(1, 12)
        own = [" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(2, 9))).capitalize() + "." for _ in range(count)]
        verses += [("GEN", p + 1, v + 1, t) for v, t in enumerate(own)]
        rows.append((f"p{p}", [f"GEN {p + 1}:{v + 1}" for v in range(count)], " ".join(own), "m"))
    rows += [("long", ["GEN 1:1"], "x" * 500, "m"), ("none", None, None, "m"), ("empty", [f"A 1:{i}" for i in range(8)], None, "m"), ("free", ["A 1:1"] * 50, "y" * 500, None), ("other", ["A 1:1"] * 50, "y" * 500, "unknown")]
    known = spark.createDataFrame(verses, "book string, chapter int, verse int, text string")
    out = splitting.split_oversized(passages(spark, rows), limits(spark), known).collect()
    by = {}
    for r in out:
        by.setdefault(r["passage_id"], []).append(r)
    assert set(by) == {r[0] for r in rows}
    for pid, ids, text, model in rows:
        parts = sorted(by[pid], key=lambda r: r["piece"])
        text, ids = text or "", ids or []
        over = model == "m" and (len(text) > 50 or len(ids) > 3)
        assert {r["oversized"] for r in parts} == {over} and (over or len(parts) == 1)
        covered, at = "", 0
        for r in parts:
            assert r["text"] == text[r["char_from"] : r["char_to"]] and r["char_from"] <= at
            covered += text[at : r["char_to"]]
            at = max(at, r["char_to"])
            if over:
                assert len(r["text"]) <= 50 and len(r["verse_ids"]) <= 3
        assert covered == text and [v for v in dict.fromkeys(x for r in parts for x in r["verse_ids"])] == list(dict.fromkeys(ids))


def test_cuts_between_verses_share_the_overlap(spark):
    own = ["Aa bb cc.", "Dd ee ff.", "Gg hh ii.", "Jj kk ll.", "Mm nn oo."]
    known = spark.createDataFrame([("GEN", 1, i + 1, t) for i, t in enumerate(own)], "book string, chapter int, verse int, text string")
    out = splitting.split_oversized(passages(spark, [("p", [f"GEN 1:{i}" for i in range(1, 6)], " ".join(own), "m")]), limits(spark), known).orderBy("piece").collect()
    assert [list(r["verse_ids"]) for r in out] == [["GEN 1:1", "GEN 1:2", "GEN 1:3"], ["GEN 1:3", "GEN 1:4", "GEN 1:5"]]
    assert out[0]["cut"] == "verse" and out[1]["text"].startswith("Gg hh ii.")


def test_fallbacks_in_order():
    text = "One two. Three four five six"
    cuts = splitting.cut_pieces(text, [0], 12, 9, 0)
    assert [text[a:b] for a, b, *_ in cuts] == ["One two. ", "Three four ", "five six"] and [c[4] for c in cuts] == ["sentence", "space", "end"]
    assert [c[4] for c in splitting.cut_pieces("x" * 25, [0], 10, 9, 0)] == ["hard", "hard", "end"]


def test_unknown_starts_are_no_boundaries():
    text = "aaaaabbbbbcccccddddd"
    starts, shown = splitting.verse_starts(text, 4, [])
    assert shown == [True, False, False, False]
    cuts = splitting.cut_pieces(text, starts, 10, 9, 0, shown)
    assert all(kind in ("hard", "end") for *_, kind in cuts) and "".join(text[a:b] for a, b, *_ in cuts) == text
    text = "Aa bb. Cc dd. Ee ff. Gg hh."
    starts, shown = splitting.verse_starts(text, 4, [(2, "Ee ff.")])
    assert shown == [True, False, True, False]
    kinds = [kind for *_, kind in splitting.cut_pieces(text, starts, 7, 9, 0, shown)]
    assert kinds == ["sentence", "verse", "sentence", "end"]
    assert [c[2:4] for c in splitting.cut_pieces(text, starts, 99, 2, 1, shown)] == [(0, 2), (1, 2), (2, 4)]


def test_word_offsets_are_prefix_sums():
    assert splitting.word_offsets(" a  bc d") == [1, 4, 7] and splitting.word_offsets("") == [] == splitting.word_offsets("x")


def test_more_verses_than_text():
    cuts = splitting.cut_pieces("", [0] * 8, 50, 3, 1)
    assert max(b - a for _, _, a, b, _ in cuts) <= 3 and cuts[-1][3] == 8 and cuts[0][2] == 0
    assert all(x[3] >= y[2] for x, y in zip(cuts, cuts[1:], strict=False))


def test_every_assigned_character_has_its_prototype(spark, table):
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    for c in ("\U0001d400", "\U00016f08", "\U000118a9", "\U0001f74c"):
        assert table.get(c, c) == checker.getSkeleton(c)


def test_empty_passages(spark):
    assert splitting.split_oversized(passages(spark, []), limits(spark)).count() == 0


def test_found_words_are_no_listed_forms(spark):
    import os

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    found = p3_found(spark, data)
    assert found.count() > 0 and found.count() == found.select("word_id").distinct().count()
