"""The corpus pipeline: documents in, encoded training text out, one operator per stage.

Each stage gets what the one before has kept, and all but the last return the columns of documents.
"""

import public_tokenizers
from pyspark.sql import functions as F

from weatherloom.llm import bpe, decontamination, neardup, quality, secrets
from weatherloom.llm.queries import WORD_VOCABULARY
from weatherloom.plans.sizing import scratch_path, written


def quality_stage(spark, docs, sf_dir):
    """Drops what the classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def neardup_stage(spark, docs, sf_dir):
    """Keeps one document of each group of near-duplicates, as op6 links them."""
    return neardup.first_of_each(docs, shingle=neardup.SHINGLE, radius=neardup.RADIUS)


def decontamination_stage(spark, docs, sf_dir):
    """Drops documents contaminated by benchmark items."""
    return decontamination.without_contaminated(
        docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


def secrets_stage(spark, docs, sf_dir):
    """Replaces secrets in texts."""
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    ledger = scratch_path(spark, "secret-ledger")
    return secrets.redact(docs, secrets.findings(secrets.update_ledger(versions, ledger), ledger))


def encoding_stage(spark, docs, sf_dir):
    """doc_id, n_tokens and ids of every text."""
    encoded = bpe.encode_documents(docs, public_tokenizers.path(WORD_VOCABULARY))
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("bpe_encoding", encoding_stage),
]

# Model fitting, similarity and byte-pair merges have no SQL; tests hold the result against a
# brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on the table documents; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
