"""The corpus pipeline: toxicity, quality, near duplicates, contamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; models learn from the labels of those rows outside the
held-out folds. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import _shared, decontaminate, knn_quality, near_copies, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic segments score below the threshold."""
    return toxicity.drop_toxic(docs, _shared.table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their nearest labelled neighbours vote for."""
    return knn_quality.keep_good(docs, _shared.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class that five-word shingles of Jaccard similarity 0.8 or more connect."""
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words occurs."""
    return decontaminate.drop_contaminated(docs, _shared.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents, each with its place in a sequence of at most 1024 tokens."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Trained models and fingerprints are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what a stage returns is written and read again before the next."""
    docs = _shared.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = _shared.materialize(docs, "stage")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
