"""The dealt operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from matchloom.llm import op1_simhash, op2_toxicity, op3_quality, op4_decontaminate, op5_bpe, op6_pii, op7_suffix, op8_lm, op9_licences, op10_secrets, op11_phrases, op12_runs, op13_minhash
from matchloom.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_simhash.simhash_groups(table(spark, sf_dir, "documents"), **op1_simhash.PRODUCTION).select("doc_id", "fingerprint", "component_id")


def op2_toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), **op2_toxicity.PRODUCTION)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), **op3_quality.PRODUCTION)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op4_decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), **op4_decontaminate.PRODUCTION)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_bpe.bpe(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op6_pii.find(table(spark, sf_dir, "documents"), **op6_pii.PRODUCTION)
    return found.select("doc_id", *[f"n_{k}" for k in op6_pii.KINDS], F.sha2("base_spans", 256).alias("base_sha256"), F.col("all_spans").alias("spans"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_suffix.repeats(table(spark, sf_dir, "documents"), **op7_suffix.PRODUCTION)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_lm.score(table(spark, sf_dir, "documents"), **op8_lm.PRODUCTION)


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_licences.scan(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_secrets.scan(table(spark, sf_dir, "documents"), **op10_secrets.PRODUCTION)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_phrases.phrases(table(spark, sf_dir, "documents"), **op11_phrases.PRODUCTION)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_runs.digests(op12_runs.runs(table(spark, sf_dir, "documents"), **op12_runs.PRODUCTION, words_of=op12_runs.periodic_tail))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_minhash.groups(table(spark, sf_dir, "documents"), **op13_minhash.PRODUCTION)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}
    return {**own, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op11_phrase_collocations": op11_phrases.SQL, "op13_minhash_near_dedup": op13_minhash.SQL}
