"""Codewords, held-out accuracy, and defined cases of language identification."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustweave.llm import language_id, queries

SF = "/root/testdata/sf0.01"


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 8, 30):
        code = language_id.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) == {-1, 1}
        least = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert least >= (1 if n < 4 else code.shape[1] // 4)


def test_held_out_accuracy(spark):
    out = queries.op3_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = out.join(docs, "doc_id").where("held_out")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    assert out.where("NOT score BETWEEN 0 AND 1").count() == 0 and out.count() == docs.count()


def test_defined_cases(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None)], "text string, lang string")
    model = language_id.fit(train)
    rows = [(1, "the dog and"), (2, None), (3, ""), (4, "123 !!"), (5, "A"), (None, "und die katze " * 20000), (1, "the dog and")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("__letter", F.lit(3))
    out = language_id.predict(df, model).collect()
    by = {(r.doc_id, r.text and r.text[:9]): r for r in out}
    assert by[1, "the dog a"].lang_pred == "en" and by[None, "und die k"].lang_pred == "de"
    assert [by[k, t].lang_pred for k, t in ((2, None), (3, ""), (4, "123 !!"))] == ["und"] * 3
    assert by[2, None].score == 0 and by[5, "A"].ambiguous and len(out) == len(rows)
    assert {r.lang_pred for r in language_id.predict(df, language_id.fit(train.limit(0))).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).count() == 0


def test_long_noise_is_undecided_and_documents_are_not(spark):
    """Of shorter noise only a part is undecided: see README."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    assert language_id.predict(docs, model, columns=["doc_id"]).where("undecided").count() == 0
    rng = np.random.default_rng(3)
    noise = [(k, " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), rng.integers(3, 9))) for _ in range(500))) for k in range(10, 16)]
    out = language_id.predict(spark.createDataFrame([*noise, (1, "De."), (2, None)], "doc_id long, text string"), model)
    assert {r.doc_id for r in out.where("undecided").collect()} == set(range(10, 16))


def test_decoding_is_the_nearest_codeword_by_weighted_loss():
    """Against every codeword in turn, bit by bit."""
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, (5, 64))
    model = language_id.Model.fit(list("abcde"), counts, 6)
    margins, n = rng.normal(0, 0.4, (200, model.code.shape[1])), rng.integers(0, 60, 200)
    best, score, lead, least = model.decode(margins, n)
    weight = model.reliability / model.reliability.sum()
    for i in range(200):
        losses = [sum(w * np.log1p(np.exp(-margins[i, b] * np.sqrt(n[i]) * word[b])) for b, w in enumerate(weight)) for word in model.code]
        order = sorted(losses)
        assert losses[best[i]] == pytest.approx(order[0]) and least[i] == pytest.approx(order[0]) and lead[i] == pytest.approx(order[1] - order[0])
        assert score[i] == pytest.approx(1 / sum(np.exp(-language_id.SHARPNESS * (x - order[0])) for x in losses))


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language_id.fit(spark.createDataFrame([("aaaa", str(k)) for k in range(3)], "text string, lang string"))
