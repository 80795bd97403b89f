"""One query for each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import ivfpq, kdtree, licenses
from tracewell.llm.bpe import bpe_encode
from tracewell.llm.mixing import mixed_copies
from tracewell.llm.pii import sanitise
from tracewell.llm.sharding import external_shuffle
from tracewell.llm.simhash import near_duplicate_groups
from tracewell.llm.substrings import repeated_passages
from tracewell.llm.toxicity import learn_lexicon, toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(_table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.exact_top_k(_table(spark, sf_dir, "embeddings"), chosen=F.expr(kdtree.HUNDREDTH))


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external_shuffle(_table(spark, sf_dir, "documents"))


def op4_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_copies(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity_scores(docs, learn_lexicon(docs, _table(spark, sf_dir, "labels")))


def op6_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.approximate_top_k(_table(spark, sf_dir, "embeddings"), chosen=F.expr(kdtree.HUNDREDTH))


def op7_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_external_shuffle": op3_external_shuffle,
    "op4_entropy_mixing": op4_entropy_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_ivfpq": op6_ivfpq,
    "op7_license_templates": op7_license_templates,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_repeated_substrings": op9_repeated_substrings,
    "op10_bpe": op10_bpe,
}

#: SQL for the queries that SQL can state; the others are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": kdtree.ORACLE,
    "op7_license_templates": licenses.oracle(),
}
