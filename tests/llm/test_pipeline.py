"""The pipeline's stages on planted documents, and its whole run."""

import random

import pytest

import corpus_pipeline
from trustweave.llm import secrets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def planted(spark, tmp_path):
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "")]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage = prose(30)
    rows = [(k, prose(60), "en", "s", 1) for k in range(20)]
    near = rows[3][1].split()
    near[50] = "changed"
    rows += [(100, rows[2][1], "en", "s", 1), (101, " ".join(near), "en", "s", 1), (102, f"{prose(20)} {passage.upper()} {prose(20)}", "en", "s", 1)]
    rows += [(103, prose(30) + ' token = "0123456789abcdef0123" ' + prose(5), None, None, None), (104, "123 456", "en", "s", 1), (105, None, None, "s", 1), (106, "", "en", "s", 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_planted_documents_go_and_clean_ones_stay(spark, planted):
    sf_dir, rows = planted
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir), name)
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "secret_scans":
            text = docs.where("doc_id = 103").first()
            assert secrets.MASK in text.text and "0123456789abcdef" not in text.text and text.n_chars == len(text.text)
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everything = {r[0] for r in rows}
    assert left["language_id"] == everything - {104, 105, 106}
    assert left["ngram_jaccard_join"] == left["language_id"] - {100, 101}
    assert left["benchmark_decontamination"] == left["ngram_jaccard_join"] - {102}
    assert left["secret_scans"] == left["sentencepiece"] == left["benchmark_decontamination"]
    assert docs.where("NOT round_trip").count() == 0
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_extra_columns_and_empty_tables(spark, planted):
    sf_dir, _ = planted
    extra = spark.createDataFrame([(1, "some words of a text here", "en", "s", 3, "own", 5, "k", 1.5)], COLUMNS + ", hits string, score int, id string, digest double")
    docs = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == extra.columns, name
    row = docs.first()
    assert (row.hits, row.score, row.id, row.digest) == ("own", 5, "k", 1.5)
    empty = extra.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def test_language_stage_rejects_long_noise_and_keeps_documents(spark):
    """Of shorter noise only a part is rejected: see README."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    noise = []
    for k in range(10):
        rng = random.Random(1000 * k + 500)
        noise.append((10**6 + k, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randrange(3, 9))) for _ in range(500)), None, None, None))
    both = docs.unionByName(spark.createDataFrame(noise, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, both, "").select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}
