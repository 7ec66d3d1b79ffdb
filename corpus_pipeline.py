"""A training corpus from raw documents, in five stages.

Each stage takes all that its predecessor kept, as Parquet. Documents that the
quality classifier rejects go, one document of each near-duplicate class stays,
secrets are replaced by their kind, sources are mixed to their weights (so a
document may come twice), and the texts are encoded to pieces and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotwise.llm import jaccard, mixing, pieces, quality, secrets
from plotwise.llm.common import table
from plotwise.session import configure, stage


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, the text as its ids decode, and the ids."""
    return pieces.encode(docs, decoded="text").select(*docs.columns, "ids")


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_masking),
    ("mixing sources", source_mixture),
    ("SentencePiece encoding", piece_encoding),
]

#: A trained model, hash-based draws and path folding have no SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
