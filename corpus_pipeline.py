"""A training corpus from raw documents: five stages, each over all that the stage before it kept.

Toxic documents go, one document of each group of near-duplicates stays, private data and the terms that
disclose it are generalised or removed, sources are brought to their target weights, and texts become
tokens.  Each stage takes and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.bpe import bpe_encode
from tracewell.llm.common import shared_dir
from tracewell.llm.mixing import mix
from tracewell.llm.pii import sanitise_in_place
from tracewell.llm.simhash import drop_near_duplicates
from tracewell.llm.toxicity import drop_toxic, learn_lexicon

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxic window go; the lexicon is learned from those of ``docs`` that are labelled."""
    return drop_toxic(docs, learn_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id."""
    return drop_near_duplicates(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, sanitised; ``n_chars`` is that of the new text."""
    return sanitise_in_place(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, those of sources under their target weight more than once."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, with its tokens."""
    return bpe_encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("pii", private_data),
    ("source_mixing", source_mix),
    ("bpe", tokens),
]

#: SQL can state neither the learned automata nor the encoder: tests/llm/test_pipeline.py holds the stages
#: against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/tracewell/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
