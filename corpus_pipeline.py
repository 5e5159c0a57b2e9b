"""The corpus pipeline: stages of dealt operators, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trustweave.llm import decontamination, language_id, ngram_join, queries, secrets, sentencepiece_codec
from trustweave.llm.staging import staged

#: The columns that stages work on; others are only carried.
OWN = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carried(stage: Stage) -> Stage:
    """The stage, with other columns numbered inside, so that their names can't clash."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = [c if c in OWN else f"other_{k}" for k, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*inner), sf_dir)
        return out.select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns)])

    return run_stage


@carried
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the documents' own languages (fold 1 held out); those whose language can't
    be told go: texts that are null or without a letter, and those that the decoder leaves
    undecided, being near no language's codeword. Others keep their row as it is."""
    model = language_id.fit(docs.where(language_id.fold(F.col("doc_id")) != 1))
    judged = language_id.predict(docs, model)
    # without any labelled text nothing is judged
    rejected = (F.col("lang_pred") == language_id.UNDETERMINED) | F.col("undecided") if model else F.lit(False)
    return judged.where(~rejected)


@carried
def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word n-grams, that of the smallest id stays."""
    return ngram_join.keep_one(docs)


@carried
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontamination.find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hits") == 0)


@carried
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and lengths follow; every document stays."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, proven by decoding them; texts are no longer carried."""
    kept = [c for c in docs.columns if c != "text"]
    return sentencepiece_codec.encode_texts(docs, queries.piece_model(), columns=kept, verify=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", remove_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("secret_scans", mask_secrets),
    ("sentencepiece", encode_pieces),
]

#: Learned, hashed and tokenizing stages can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
