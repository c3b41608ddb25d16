"""From raw documents to token ids: quality rules, near duplicates, benchmark decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
``documents``.  Verdicts are given to rows, so rows that share an id are judged one by one.  Quality needs sums over the whole
corpus, so SQL can't express the pipeline without the estimates' iteration; it is tested stage by stage by brute force.

Defined results: null, empty and blank texts, and those under 20 words, fail the quality rules; rows that repeat are one group of near duplicates, of
which one stays; null ids are kept and never name a group; an empty table passes through every stage as one; texts of any length are
taken whole; columns of any names are carried along by all stages but the last, also where they bear an operator's own names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, decontaminate, jaccard_join, quality, secrets
from quillon.llm.common import documents, made_folders, remove_folders, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; the stage is op1's, and so are its shingle width and threshold."""
    return jaccard_join.one_of_each_group(docs, words=jaccard_join.WORDS, percent=jaccard_join.PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are marked out of the texts."""
    return secrets.redact_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE", byte_bpe),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again; what a stage stored on its
    way, and its input, goes when its result is written."""
    docs = documents(spark, sf_dir)
    mark = made_folders()
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs, "stage")
            remove_folders(spark, mark)
    return docs
