"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, token output.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``; each works on every row its
predecessor kept, and its decisions take effect.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.llm import decontaminate, language_id, mixing, ngram_jaccard, token_output
from carelens.llm.entry import DOMAIN_TARGETS, domain_labels
from carelens.llm.tables import ship, stored

TOKENIZER = os.environ.get("CORPUS_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the language classifier rejects go (no letter,
    or too far from every language's centroids); null and empty texts go with them.

    A long text is judged by its pieces. Equal texts are judged alike, repeated
    rows each stay or go, ties between languages change nothing, an empty table
    stays empty. All columns keep their values, whatever their names.
    """
    ship(spark)
    model = language_id.fit(docs)
    own = {f"own_{i}": c for i, c in enumerate(docs.columns) if c != "text"}  # the classifier adds columns of its own
    judged = language_id.classify(docs.select("text", *[F.col(f"`{c}`").alias(k) for k, c in own.items()]), model)
    back = {c: k for k, c in own.items()} | {"text": "text"}
    return judged.filter("NOT rejected").select(*[F.col(back[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each near-duplicate group stays, that of the least doc_id
    (of equal ids, one row). Null and empty texts have no shingle and all stay; long texts are
    compared whole; an empty table stays empty; all columns keep their values."""
    ship(spark)
    return ngram_jaccard.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark item go. Null and empty texts and items match
    nothing; long texts are searched whole; equal rows are judged alike; an empty table stays
    empty, an empty benchmark takes nothing away; all columns keep their values."""
    ship(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each document is emitted as often as its rate says: the whole
    part of the rate always, once more with the probability of the rest (decided by a hash of
    text and doc_id, so equal rows are emitted alike). Null and empty texts have the rate of
    their posteriors and weigh nothing; an empty table stays empty; without labels every rate
    is 1; all columns keep their values."""
    ship(spark)
    labels = domain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = mixing.fit_domains(docs, labels)
    table = stored(mixing.posterior_table(docs, model), "posteriors")
    fit = mixing.fit_rates(table, [DOMAIN_TARGETS.get(x, 0.0) for x in model.names], plain=0)
    return mixing.emit(docs, model, fit)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: token ids in randomly addressable files, and each document's place in them.
    Null and empty texts have their end id alone; repeated rows each have a place, rows of one
    doc_id stay together in the order of their texts; an empty table gives no rows; other
    columns are not read. The last stage returns the places, not the documents' columns."""
    ship(spark)
    return token_output.token_table(docs, TOKENIZER)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("target_mix", target_mix),
    ("token_output", token_files),
]

#: SQL cannot express the stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
