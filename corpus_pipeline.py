"""The corpus pipeline: quality rules, near copies, benchmark leaks, personal data, packing.

Each stage reads what the stage before it kept and returns the columns of `documents`;
the last returns the packed pieces. The work is in `roomtable.llm`; nothing here is
recomputed from the raw documents, and every decision takes effect in the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from roomtable.llm.leaks import without_leaks
from roomtable.llm.near_copies import one_of_each
from roomtable.llm.packing import packed
from roomtable.llm.personal import without_personal_data
from roomtable.llm.quality import good_documents
from roomtable.llm.queries import reachable
from roomtable.llm.shared import ensure_checkpoint_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the classifier is fitted on labelled rows of `docs`."""
    reachable(spark)
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-copy group; rows without an id all stay."""
    reachable(spark)
    return one_of_each(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no piece of the benchmark."""
    reachable(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    reachable(spark)
    return without_personal_data(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece, with its sequence and place."""
    reachable(spark)
    return packed(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_copies", near_copy_stage),
    ("benchmark_leaks", leak_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: The stages fit models, align and tokenize, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written to the shared folder and read again."""
    reachable(spark)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
