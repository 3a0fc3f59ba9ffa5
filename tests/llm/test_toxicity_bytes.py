"""Texts without spaces count as one word, but not as short."""

from helpers import awkward

from tallyspark.llm import toxicity


def test_long_texts_without_spaces_are_not_learnt_from(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(toxicity.Model, "train", lambda self, texts, y: taught.extend(texts))
    monkeypatch.setattr(toxicity.Model, "calibrate", lambda self, texts, y, langs: taught.extend(texts))
    rows = [(1, "bad words", "en"), (2, "good words", "en"), (3, "line\n" * 10_000, "en"), (4, "\u6f22" * 11_000, "en")]
    labels = spark.createDataFrame([(i, None, i % 2) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    toxicity.fit(awkward(spark, rows), labels)
    assert set(taught) == {"bad words", "good words"}
