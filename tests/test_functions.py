import pytest
from pyspark.sql import functions as F

from corpusmill.functions import answers, citations, questions, refs, text
from corpusmill.functions.layers import hebrew_preview
from corpusmill.functions.morphology import describe_morphology

WORDS = "array<struct<word:string,strongs:string,gloss:string,morph:string,transliteration:string>>"


def test_tokens_split_on_other_letters(one):
    assert one(text.tokens(F.lit("Élan vital, l'été 2x!"))) == ["lan", "vital", "l", "t", "2x"]
    assert one(text.tokens(F.lit(""))) == []
    assert one(text.tokens(F.lit(None).cast("string"))) is None


def test_fallback_tokens_are_distinct_and_long(one):
    assert one(text.fallback_tokens(F.lit("What does the Bible say about grace, grace and of law?"))) == ["grace", "law"]


def test_keywords(one):
    assert one(text.has_keyword(F.lit("The KING came"), "king"))
    assert not one(text.has_keyword(F.lit("Kingdom come"), "king"))
    assert one(text.has_keyword(F.lit("new covenants"), "new covenant"))
    assert one(text.has_keyword_column(F.lit("a c+ b"), F.lit("c"))) and not one(text.has_keyword_column(F.lit("abc"), F.lit("b")))


def test_numbers_and_chunks(one):
    assert one(text.prefix_int(F.lit("12a"))) == 12 and one(text.prefix_int(F.lit("x"))) is None
    assert one(text.chunks(F.lit("abcde"), 2)) == ["ab", "cd", "e"] and one(text.chunks(F.lit(""), 2)) == [""]
    assert one(text.clamp01(F.lit(float("nan")))) == 0 and one(text.clamp01(F.lit(7))) == 1
    assert one(text.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0)))) == 0


def test_markup(one):
    assert one(text.decode_entities(F.lit("&lt;a&gt; &amp;quot;"))) == "<a> &quot;"
    assert one(text.strip_tags(F.lit("a<b>c</b>"))) == "ac"
    assert one(text.strongs_of_lemma(F.lit("b/7225 a"))) == "H7225" and one(text.strongs_of_lemma(F.lit("b"))) is None
    assert [tuple(w) for w in one(text.tagged_words(F.lit("In beginning<S>7225</S> God<S>430</S> x")))] == [("beginning", "7225"), ("God", "430")]
    assert one(text.kebab(F.lit("  New -- Covenant! "))) == "new-covenant" and one(text.title(F.lit("new-covenant"))) == "New Covenant"


@pytest.mark.parametrize(
    ("raw", "want"), [("1.2.3.4:80", "1.2.3.4"), ("[::1]:443", "::1"), ("::ffff:9.8.7.6", "9.8.7.6"), ("fe80::1%eth0, 1.1.1.1", "fe80::1"), ("300.1.1.1", None), ("", None), ("007.1.1.1", "007.1.1.1")]
)
def test_client_address(one, raw, want):
    assert one(text.client_address(F.lit(None).cast("string"), F.lit(raw))) == want


def test_references(one):
    assert one(refs.parse_verse(F.lit("jhn 3:16-18"))).asDict() == {"book": "JHN", "chapter": 3, "verse": 16, "verse_end": 18}
    assert one(refs.parse_verse(F.lit("John"))) is None
    found = one(refs.references_in(F.lit("See 1 John 4:8, Song of Solomon 2:1-3 and Xyz 1:1; John 3:16")))
    assert [tuple(r) for r in found] == [("1JN", 4, 8, 8), ("SNG", 2, 1, 3), ("JHN", 3, 16, 16)]
    assert one(refs.expand_dotted(F.lit("Gen.1.1-Gen.1.3"))) == ["GEN 1:1", "GEN 1:2", "GEN 1:3"]
    assert one(refs.expand_dotted(F.lit("Gen.1.31-Gen.2.1"))) == ["GEN 1:31", "GEN 2:1"]
    assert one(refs.expand_dotted(F.lit("bad line"))) is None
    assert one(refs.passage_id(F.array(F.lit("GEN 1:1"), F.lit("GEN 1:3")))) == "GEN.1.1-1.3"


def test_locale_order(spark):
    rows = spark.createDataFrame([("GEN 10:1",), ("GEN 1:10",), ("GEN 1:9",)], "r string")
    assert [r["r"] for r in rows.orderBy(refs.locale_key(F.col("r"))).collect()][-1] == "GEN 10:1"


def test_books_have_their_own_aliases():
    aliases = refs.book_aliases()
    assert len(set(aliases.values())) == 66 == len(refs.BOOK_CODES) == len(refs.BOOK_NAMES)
    assert aliases["PHILEMON"] == "PHM" and aliases["EXOD"] == "EXO" and aliases["JUDGES"] == "JDG" and "J" not in aliases


def test_morphology(one):
    assert one(describe_morphology(F.lit("HVqp3ms"))) == "Verb, Qal, Perfect, 3rd Person, Masculine, Singular"
    assert one(describe_morphology(F.lit("HC/Td/Ncfsa"))) == "Conjunction / Definite Article / Noun, Common, Feminine, Singular, Absolute"
    assert one(describe_morphology(F.lit("Hzz"))) is None and one(describe_morphology(F.lit(""))) is None


def test_questions(spark):
    asked = spark.createDataFrame([(1, "Explain Romans 8:28"), (2, "John 3:16"), (3, "What does the Bible say about forgiveness?"), (4, "new covenant"), (5, None), (6, "")], "i int, q string")
    rows = {r["i"]: r for r in questions.understand(asked, "q").collect()}
    assert rows[1]["intent"] == "VERSE_EXPLANATION" and rows[2]["intent"] == "DIRECT_REFERENCE" and rows[2]["expanded"] == "John 3:16"
    assert rows[3]["normalized"] == "forgiveness?" and rows[3]["expanded"] == "forgiveness"
    assert rows[4]["expanded"] == '"new covenant" promise testament' and rows[4]["domain"] == "covenants"
    assert rows[5]["normalized"] is None and rows[6]["intent"] == "TOPICAL_QUERY"
    compat = {r["i"]: r for r in questions.understand(asked, "q", compat=True).collect()}
    assert compat[1]["intent"] == "DIRECT_REFERENCE"


def test_synonyms(one):
    assert one(questions.add_synonyms(F.lit("messiah promise"), F.lit(False))) == "messiah christ anointed shiloh son of david promise"
    assert one(questions.add_synonyms(F.lit("grace"), F.lit(True))) == "grace"
    assert one(questions.add_synonyms(F.lit("end times"), F.lit(False), 2)) == "end times last days eschaton"


def test_citations_are_scrubbed(spark):
    rows = spark.createDataFrame([(1, "God so loved (JHN 3:16) and (ROM 99:1). See GEN 1:1 ."), (2, ""), (3, None), (4, "plain (JHN 3:16)")], "i int, t string")
    allowed = spark.createDataFrame([(1, "JHN 3:16"), (1, "Genesis 1:1")], "i int, r string")
    out = {r["i"]: r for r in citations.scrub_answers(rows, allowed, "i", "t", "r").collect()}
    assert out[1]["t"] == "God so loved (JHN 3:16) and. See GEN 1:1." and out[1]["removed"] == ["ROM 99:1"]
    assert out[2]["t"] == "" and out[3]["t"] is None and out[4]["t"] == "plain"


def test_long_citations(one):
    assert one(citations.long_citation(F.lit("1co 13:4-7"))) == "1 Corinthians 13:4-7"
    assert one(citations.citations(F.lit("as 1 John 4:8, and ROM 8:28–30."))) == ["1 John 4:8", "ROM 8:28–30"]


def test_answer_lines(one):
    assert one(answers.dump_lines(F.lit("- `orig|λόγος|logos|G3056|word`"))) == ["- Greek: λόγος (G3056; logos)", "  Meaning: word"]
    assert one(answers.dump_lines(F.lit("orig|דבר|H1697|word"))) == ["- Hebrew: דבר (H1697)", "  Meaning: word"]
    assert one(answers.dump_lines(F.lit("orig|x"))) == [] and one(answers.dump_lines(F.lit("plain"))) is None
    tidy = one(answers.tidy_answer(F.lit("Reference: JHN 3:16\n\n\n\n**Original key words:**\n- λόγος (word)\n- \"Next\"")))
    assert tidy == "- **JHN 3:16**\n\n**Original language details:**\n- `λόγος` (word)\n- \"Next\""
    assert one(answers.tidy_answer(F.lit(None).cast("string"))) is None and one(answers.tidy_answer(F.lit(" "))) == " "
    cut = one(answers.sections(F.lit("Summary.\n- \"A verse\"\n  - sub\nEnd line")))
    assert cut["before"] == "Summary." and cut["after"] == "End line"
    assert one(answers.summary(F.lit("Summary.\n- \"A verse\"\nAll quotes from BSB.\nDone."))) == "Summary. Done."
    assert one(answers.summary(F.lit(""))) is None


def test_blocks_end_and_begin_again(one):
    head = "**Original language details:**"
    lines = f"{head}\n- [λόγος] (word)\n- `done` x\norig|a|G1|b\nAll quotes from BSB\n- plain one\n{head}\n- θεός, god\n"
    want = f"{head}\n- `λόγος` (word)\n- `done` x\n- Greek: a (G1)\n  Meaning: b\nAll quotes from BSB\n- plain one\n{head}\n- `θεός`, god"
    assert one(answers.tidy_answer(F.lit(lines))) == want


def test_answers_get_the_verses_they_lack(spark):
    rows = spark.createDataFrame([("Said.", [("JHN 1:1", "BSB", [("λόγος", "G3056", "word", None, "logos"), ("x", "", "y", None, None)]), ("GEN 1:1", "KJV", [])])], f"a string, v array<struct<reference:string,translation:string,original:{WORDS}>>")
    got = rows.select(answers.tidy_answer(F.col("a"), F.col("v")).alias("x")).first()["x"]
    assert got == "Said.\n\n- **JHN 1:1 (BSB)**\n- **GEN 1:1 (KJV)**\n\n- **JHN 1:1**\n**Original language details:**\n- Greek: λόγος (G3056; logos)\n  Meaning: word"
    assert rows.select(answers.tidy_answer(F.lit("- **JHN 1:1** **Original key words:**"), F.col("v")).alias("x")).first()["x"] == "- **JHN 1:1** **Original key words:**"


@pytest.mark.parametrize(
    ("given", "unwanted", "want"),
    [
        ("God loved [JHN 3:16].", [], "God loved [JHN 3:16]."), ("Claim [MAT 5:3].", ["MAT 5:3"], "Claim."), ("Valid [JHN 3:16] and phantom [MAT 5:3].", ["MAT 5:3"], "Valid [JHN 3:16] and phantom."),
        ("(see MAT 5:3) a", ["MAT 5:3"], "a"), ("a (b [MAT 5:3] c) d", ["MAT 5:3"], "a (b c) d"), ("a (MAT 5:3", ["MAT 5:3"], "a ("), ("a MAT 5:3-7 b", ["MAT 5:3", "MAT 5:3-7"], "a b"), ("", ["x"], ""), ("x ([MAT 5:3])", ["MAT 5:3"], "x"),
    ],
)
def test_citations_go_with_their_brackets(given, unwanted, want):
    assert citations.without_citations(given, unwanted) == want


def test_prompt_round_trip(spark):
    rows = spark.createDataFrame([("JHN 1:1", "BSB", "In the beginning", [("λόγος", "G3056", "word", "N", "logos"), ("καί", "G2532", "and", None, None)])], f"r string, t string, b string, o {WORDS}")
    made = rows.select(answers.render_verse(F.col("r"), F.col("t"), F.col("b"), F.col("o")).alias("p"))
    verse = made.select(answers.prompt_verses(F.col("p")).alias("v")).first()["v"][0]
    assert verse["reference"] == "JHN 1:1" and verse["text"] == "In the beginning"
    assert verse["original"] == ["λόγος (logos, Strong's G3056 - word, Morph: N (Noun))"]


def test_structured_rows(spark):
    rows = spark.createDataFrame([("JHN 1:1 ", None, " In  the ", [("a", "G1", "- word", None, None), ("a", "G1", "word", None, "x"), ("b", "G2", "of", None, None)])], f"r string, t string, b string, o {WORDS}")
    got = rows.select(answers.verse_row(F.col("r"), F.col("t"), F.lit("WEB"), F.col("b"), F.col("o")).alias("v")).first()["v"]
    assert got["translation"] == "WEB" and got["text"] == "In the" and [tuple(w) for w in got["words"]] == [("a", "G1", "word", "x")]


def test_hebrew_preview(one):
    none = F.lit(None)
    made = hebrew_preview(none.cast("array<struct<w:string,c:string>>"), F.array(F.lit(2), F.lit(5)), none.cast("array<int>"), none.cast("array<int>"), F.array(F.struct(F.lit("x").alias("w"), F.lit("day").alias("g"))))
    assert one(made) == "Paragraph break at word(s) 2, 5 | Glosses: x=day"


def test_banner_and_quota(one):
    said = one(answers.with_banner(F.lit("x"), F.lit("m"), F.lit(True), F.lit(False)))
    assert said.startswith("Using fallback model: m") and one(answers.with_banner(F.lit(said), F.lit("m"), F.lit(True), F.lit(False))) == said
    assert one(answers.is_quota_error(F.lit(None).cast("int"), F.lit("Rate limit hit"))) and not one(answers.is_quota_error(F.lit(500), F.lit("no")))
