"""The registered queries of this package, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_chunks, collocations, decontaminate, language_id, line_dedup, mixing, ngram_jaccard, pu_quality, quality_rules, suffix_dedup,
               token_alignment, token_output, url_filter)
from .oracle import oracle_sql  # noqa: F401
from .tables import crc32_mod, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, d):
    docs = table(spark, d, "documents")
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.fit(docs.filter(~held_out))
    return language_id.classify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_benchmark_decontamination(spark, d):
    return decontaminate.find_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op3_quality_classifier(spark, d):
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    scores, _ = pu_quality.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_suffix_array_dedup(spark, d):
    return suffix_dedup.remove_repeats(table(spark, d, "documents"), with_text=False)


def op5_quality_rules(spark, d):
    return quality_rules.quality_verdicts(table(spark, d, "documents"))


def op6_line_dedup(spark, d):
    return line_dedup.drop_frequent_lines(table(spark, d, "documents"), with_text=False)


def op7_url_filters(spark, d):
    return url_filter.judge_urls(table(spark, d, "pages"))


def op8_ngram_jaccard_join(spark, d):
    return ngram_jaccard.near_duplicates(table(spark, d, "documents"))


def op9_token_output(spark, d):
    import public_tokenizers
    return token_output.token_table(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_bpe_chunk_reuse(spark, d):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_chunks.encode(table(spark, d, "documents"), path, decoded=True).select(
        "doc_id", F.expr("bigint(length(ids) div 4)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_phrase_collocations(spark, d):
    return collocations.collocations(table(spark, d, "documents"))


def op13_token_alignment(spark, d):
    import public_tokenizers as P
    return token_alignment.alignment_table(table(spark, d, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


#: tokens wanted of each domain of ``labels`` (quality and toxicity)
DOMAIN_TARGETS = {"good": 0.95, "good_toxic": 0.03, "poor": 0.02, "poor_toxic": 0.0}


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table; rows with a null label have no domain."""
    return labels.filter("quality IS NOT NULL AND toxic IS NOT NULL").select(
        "doc_id", F.concat(F.when(F.col("quality") == 1, "good").otherwise("poor"),
                           F.when(F.col("toxic") == 1, "_toxic").otherwise("")).alias("domain"))


def op10_mixing(spark, d):
    return mixing.document_rates(table(spark, d, "documents"), domain_labels(table(spark, d, "labels")), DOMAIN_TARGETS)[0]


def pipeline(spark, d):
    import corpus_pipeline
    return corpus_pipeline.run(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_benchmark_decontamination, op3_quality_classifier, op4_suffix_array_dedup,
             op5_quality_rules, op6_line_dedup, op7_url_filters, op8_ngram_jaccard_join, op9_token_output, op10_mixing,
             op11_bpe_chunk_reuse, op12_phrase_collocations, op13_token_alignment]
    return {f.__name__: f for f in found} | {"pipeline": pipeline}
