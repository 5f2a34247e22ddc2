"""A training corpus in stages: each one works on the table that the one before it has written.

Defined results: a null text is kept by the classifier, is a copy of every text without words, holds no benchmark words and no
personal data, and has no tokens; of rows that are alike the one with the smallest ``doc_id`` stays, a null id only if all
are null; an empty table passes through; further columns pass through whatever their names, but the last stage replaces
``ids`` and ``n_tokens``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, pii, quality, simhash
from plumbline.llm.common import WRITTEN, release, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the scorers take for junk or toxic."""
    return quality.clean(docs, table(spark, sf_dir, "labels"))


def deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts whose five-word shingles are alike by 0.8 or more."""
    return simhash.dedupe(docs, similar=True)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages to the extent of the contamination rule."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalise personal data and terms that disclose it."""
    return pii.sanitise(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add token ids and their number."""
    import public_tokenizers

    out = bpe.encode(docs.drop("n_tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("n_tokens", F.size("ids").cast("long")).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("near_duplicates", deduped),
    ("benchmark", benchmark),
    ("personal_data", private),
    ("encoding", encoded),
]

#: The stages are not expressible in SQL (XXH64, a trained scorer, subword merges); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has left in the shared folder goes once the next stage's input is written."""
    docs, since = table(spark, sf_dir, "documents"), len(WRITTEN)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
