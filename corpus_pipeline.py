"""The corpus pipeline: five stages, each one operator, from raw documents to packed sequences.

Stage functions take (spark, docs, sf_dir). All but the last return documents
with the columns of the ``documents`` table; each stage reads what the one
before it wrote. The last returns token pieces with their place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, near_dedup, packing, pii, quality_classifier
from palimpsest.llm._common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of five-word shingles) stays."""
    return near_dedup.keep_one_of_each(docs, percent=80).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item has leaked go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates; n_chars follows the new text."""
    out = pii.replace_entities(docs)
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("pii surrogates", surrogates),
    ("best-fit packing", pack),
]

#: Trained scores, random walks and token ids are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "_"))
    return docs
