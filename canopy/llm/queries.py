"""The queries of the corpus operators, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import langid, licenses, mixing, packing, quality, rules, simhash, sketch, tokens, warc
from canopy.llm.common import held_out, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnable = lambda df: df.where(~held_out(F.col("doc_id")))
    net = quality.learn(learnable(docs), learnable(table(spark, sf_dir, "labels")))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), net).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokens.histogram(docs.select(tokens.token_count(F.col("text")).alias("n_tokens")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(~held_out(F.col("doc_id"))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), langid.identify(F.col("text"), profiles).alias("r")).select("doc_id", "held_out", "r.lang_pred", "r.score")


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assess(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_tokens": op3_tokens,
    "op4_language": op4_language,
    "op5_rules": op5_rules,
    "op6_packing": op6_packing,
    "op7_sketch": op7_sketch,
    "op8_licenses": op8_licenses,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
}

ORACLES = {"op2_warc": warc.ORACLE, "op5_rules": rules.oracle(), "op10_mixing": mixing.oracle()}
