"""Training-corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies
them in order to ``documents``. All stages but the last return the columns of
``documents``:

1. toxicity: documents predicted toxic go;
2. near_dedup: one document of each SimHash component stays;
3. decontamination: documents that hold a benchmark window go;
4. secret_scan: secrets are cut out of the texts, which stay otherwise;
5. bpe: token ids and digests of what is left.

Nulls, empty and very long texts, repeated rows and empty tables are handled as
the operators' docstrings say. Rows that repeat a doc_id are one document to
near_dedup, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelight.llm import bpe, decontaminate, secret_ledger, simhash_tiles, toxicity_subword
from sievelight.llm.common import read, stored
from sievelight.llm.queries import word_bpe_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows of ``documents``, drop what is predicted toxic."""
    model = toxicity_subword.fitted(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity_subword.keep_clean(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    return simhash_tiles.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    return secret_ledger.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids of every document left."""
    return bpe.encode_documents(docs, word_bpe_path(), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", encode),
]

#: The fitted classifier and SimHash components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
