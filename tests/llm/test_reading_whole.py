"""The reading model is trained on every labelled document."""

from pyspark.sql import functions as F

from corpusmill.llm import reading


def test_every_labelled_document_is_trained_on(spark, monkeypatch):
    """More labels than the 3 000 that were taken before; bounds apply only where they are given."""
    taken = []

    def fit(sample, config):
        taken.append(sample.count())
        return None

    monkeypatch.setattr(reading, "fit", fit)
    docs = spark.range(3_200).select(F.col("id").alias("doc_id"), F.lit("One plain sentence.").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 4 + 1).alias("band"), F.lit("a").alias("rater"))
    reading.reading_levels(docs, "doc_id", "text", labels)
    reading.reading_levels(docs, "doc_id", "text", labels, reading.ReadingConfig(labelled_rows=100))
    reading.reading_levels(docs, "doc_id", "text", labels, reading.ReadingConfig(labelled_chars=190))
    assert taken == [3_200, 100, 10]


def test_scores_by_parts_are_the_same(monkeypatch):
    texts = [[["the", "king", f"word{i % 5}"], ["a", "ship"]] for i in range(30)]
    model = reading.train([(t, 1 + i % 2) for i, t in enumerate(texts)], reading.ReadingConfig())
    whole = reading._scores(texts, model)
    monkeypatch.setattr(reading, "SCORED_AT_ONCE", 7)
    assert (reading._scores(texts, model) == whole).all()
