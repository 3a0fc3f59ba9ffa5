"""Counts, weights, scales and thresholds come from every labelled row, not from a sample."""

import numpy as np
import pytest

from tallyspark.llm import toxicity

DOCS = "doc_id long, text string, lang string"


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows], DOCS).repartition(3)
    return docs, spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")


def test_words_beyond_the_start_sample_are_learnt(spark):
    word = [f"zor{chr(97 + i // 6)}{chr(97 + i % 6)}k{i}" for i in range(30)]
    rows = [(i, f"plain words here {word[i // 2 % 30]} and more" if i % 2 else f"plain words here fine{i} and more", "en", i % 2) for i in range(900)]
    # a word that stands only in a text of some 2,400 words
    rows += [(1000 + i, "calm " * 2400 + "quarrel", "en", 1) for i in range(15)] + [(1100 + i, "calm " * 2400, "en", 0) for i in range(15)]
    docs, marks = tables(spark, rows)
    model = toxicity.fit(docs, marks, toxicity.Settings(per_class=4, steps=20))
    clean = model.scores(["plain words here and more", "some fine thing"]).max()
    found = model.scores([f"plain words here {w} and more" for w in word])
    assert (found > clean).all() and np.median(found) > 0.5
    assert model.scores(["quarrel"])[0] > clean
    assert "en" in model.thresholds


def test_calibration_over_all_rows_equals_the_plain_one(spark):
    rng = np.random.default_rng(3)
    z, langs = rng.normal(size=400), ["en", "de", None, "fr"]
    y = (z + rng.normal(size=400) > 0.7).astype(int)
    lang = [langs[i % 4] if i > 30 else "fr" for i in range(400)]
    plain, model = toxicity.Model(toxicity.Settings()), toxicity.Model(toxicity.Settings())
    plain.raw = lambda texts, book=None: np.array(texts)
    plain.calibrate(z.tolist(), y.astype(float), lang)
    toxicity.calibrate(spark.createDataFrame(list(zip(z.tolist(), y.tolist(), lang)), "z double, toxic int, lang string"), model)
    assert (model.scale, model.shift) == pytest.approx((plain.scale, plain.shift), rel=1e-6)
    assert model.thresholds == pytest.approx(plain.thresholds) and len(model.thresholds) == 3


def test_scores_of_one_pass_equal_those_of_the_model(spark):
    rows = [(i, f"bad{i % 5} thing" if i % 3 == 0 else f"good{i} thing", "en", int(i % 3 == 0)) for i in range(120)]
    docs, marks = tables(spark, [*rows, (None, None, None, 1)])
    out, model = toxicity.fit_scored(docs, marks, toxicity.Settings(steps=20))
    assert out.columns == [*docs.columns, "score"]
    got = {r["doc_id"]: (r["text"], r["score"]) for r in out.collect()}
    assert len(got) == 121 and out.count() == 121
    apart = np.abs(np.array([s for _, s in got.values()]) - model.scores([t or "" for t, _ in got.values()]))
    assert apart.max() < 1e-5


def test_texts_meet_their_labels_once(spark, monkeypatch):
    rows = [(i, f"bad{i % 5} thing" if i % 3 == 0 else f"good{i} thing", "en", int(i % 3 == 0)) for i in range(120)]
    docs, marks = tables(spark, rows)
    joins, joined = [], toxicity.labelled

    def counted(*args):
        joins.append(args)
        return joined(*args)

    monkeypatch.setattr(toxicity, "labelled", counted)
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    model = toxicity.learn(docs, toxicity.marks_of(marks, None), toxicity.Settings(steps=20))
    assert model.constant is None and model.counts[1].tolist() == [80, 40]
    assert len(joins) == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
