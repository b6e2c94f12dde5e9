"""Training-corpus pipeline: quality rules, near-duplicates, decontamination,
PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``, extra columns included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline.llm import decontaminate, packing, pii, quality_rules, simhash
from meterline.llm.common import stored
from meterline.llm.queries import PII_KEY, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps."""
    return quality_rules.apply_policy(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not contaminated by the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; ``n_chars`` follows the new text."""
    out = pii.replace_pii(docs, PII_KEY)
    cols = [F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
            for c in docs.columns]
    return out.select(*cols)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and offset of every piece of every document."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", surrogates),
    ("packing", packing_plan),
]

#: Surrogates and best-fit bins are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
