"""Documents to packed training sequences: one operator of ``rubrica.llm`` per stage.

Every stage takes the documents its predecessor kept, read back from Parquet, and all but the last
return the columns of ``documents``. Null or empty texts fail the quality rules and go there, so do
an empty table's rows, of which there are none; repeated rows and copies go in the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.llm import decontaminate, jaccard, packing, quality, secrets
from rubrica.llm.common import read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the thresholds of their language and source."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard.keep_representatives(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind and ``n_chars`` counted anew."""
    clean = secrets.mask_documents(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secret scan", secret_scan),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on the written result of the one before."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs


#: Packing and tokenising have no SQL form; the tests hold the pipeline against a plain version.
ORACLE_SQL = None
