"""Corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, personal data, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result as Parquet in the shared folder and rereads it as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, line_crf, mixing, near_dedup, pii
from millrace.llm.scratch import Scratch, table

STAGES = [
    ("quality_classifier", line_crf.stage),
    ("minhash_near_dedup", near_dedup.stage),
    ("benchmark_decontamination", decontam.stage),
    ("pii", pii.stage),
    ("mixing_to_target_weights", mixing.stage),
]

#: The classifier and the draws of the mix cannot be stated in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
