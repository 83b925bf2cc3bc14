"""A corpus from raw documents to token ids: five stages, each over all rows that the one before kept.

Every stage is a function of (spark, docs, sf_dir) that returns a DataFrame; all
but the last return the columns of ``documents``. ``run`` writes each stage's rows
as a table in the shared folder and reads them as the next one's input, so a
lost executor costs at most a stage's unfinished tasks.

Decisions, in order: documents that the quality rules reject go; lines of later
repeated runs are deleted; of each group of near copies the document of least
id stays (of one id, the text of least hash); contaminated documents go; what
is left is encoded, with the decoded bytes beside the ids as a round trip.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.llm import bpe, decontaminate, lines, quality, simhash
from loomtab.llm.tables import settled, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.remove_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(bpe.VOCABULARY)
    both = bpe.decode(bpe.encode(docs, path), path)
    return both.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("encode", encoding),
]

#: The classifier of the first stage and the tokenizer of the last are beyond SQL; tests/llm holds brute force against run().
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, f"stage-{name}", lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))  # what the stage itself wrote goes
    return docs
