"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, divergence, langid, licences, linededup, packing, phrases, pii, simhash, sketch, spelling, tokenfile, toxicity
from tessera.plans.session import checkpoint_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(docs))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_token_file(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = f"{checkpoint_dir(spark)}/token-file-{uuid.uuid4().hex}"
    tokenfile.write(_read(spark, sf_dir, "documents"), path, tokenizer)
    return tokenfile.read(spark, path)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_read(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.dedup_passages(_read(spark, sf_dir, "documents")).drop("kept")


QUERIES = {f.__name__: f for f in (op1_pii_sanitise, op2_packing, op3_decontamination, op4_licence_scan, op5_fingerprints, op6_toxicity, op7_language_id, op8_simhash_near_dedup, op9_token_file, op10_line_dedup, op11_source_divergence, op12_spelling_variants, op13_substring_dedup)}

ORACLES = {"op3_decontamination": decontaminate.ORACLE, "op11_source_divergence": divergence.ORACLE, "op13_substring_dedup": phrases.ORACLE}
