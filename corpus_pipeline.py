"""Training-corpus pipeline: five stages over ``documents``, each written as Parquet
and reread as the next one's input.

quality -> exact_dedup -> near_duplicates -> decontaminate -> pieces.  The first four
keep all columns of the rows they keep; the last returns the encoded corpus.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskmap.llm import decontaminate, exact_dedup, jaccard_join, pieces, quality
from riskmap.llm.common import table
from riskmap.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at Jaccard 0.8, the smallest doc_id."""
    return jaccard_join.keep_one(docs, theta=80, width=5)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the sha256 of the text they decode to."""
    return pieces.encode_texts(docs, keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("pieces", pieces_stage),
]

#: The quality classifier, the near-duplicate components and the encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, through the shared checkpoint folder."""
    base = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
