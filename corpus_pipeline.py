"""A training corpus in five stages: toxicity, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.

In every stage a null text counts as empty and stays null; empty and null texts are neither copies nor passages nor
personal data and have no tokens; whether they are toxic the classifier's bias says. Rows of a null id are kept as they
are by near_dup, rows of equal id that differ in their texts stand for themselves but are dropped together. Further
columns, whatever they are called, go through all stages but the last. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, decontaminate, near_dup, pii, toxicity
from kinweave.llm.common import mod_crc, table
from kinweave.llm.shared import forget, scratch, stored


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of four fifths of the ids, doesn't call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(mod_crc("doc_id", 5) != 0))
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 on 5-word shingles."""
    return near_dup.dedup(docs, shingle=5, percent=80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 10 words that a benchmark text has; texts that were nothing else go."""
    return _measured(decontaminate.remove(docs, table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _measured(pii.mask(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("pii", mask_personal_data),
    ("byte_bpe", tokens),
]

#: The classifier, the sketches and the merges are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is stored before the next one reads it several times.

    What a stage stored on its way is deleted when its result has been written, and that result when the next one has.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), keep=True)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
