"""The corpus pipeline: five stages over ``documents``, each written to Parquet and read again.

Every stage but the last returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkeval.llm import chunks, common, hyperminhash, packing, pii, toxicity

END_ID = 2
#: Words whose ids a worker keeps at hand: few, as the same workers hold what the stages before need.
WORDS = 100_000


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores as toxic go; null and empty texts, repeated rows, null ids and clashing columns stay as they are, and so does an empty table."""
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def one_of_near_duplicates_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a likeness of 0.8 or more, the one with the smallest doc_id stays, with all its columns.

    Of rows that share that doc_id and text one stays; texts without words link with nothing, and rows without doc_id all stay.
    """
    return hyperminhash.keep_one(docs)


def repeated_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut from the texts of later ones; every row stays, a null or empty text as it is."""
    return chunks.without_repeats(docs)


def personal_data_is_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is masked; every row stays, a null or empty text as it is."""
    return pii.masked(docs)


def sequences_are_packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place in a sequence; null and empty texts are their end id alone, and an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, special=True, remembered=WORDS)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("near_dedup", one_of_near_duplicates_stays),
    ("substring_dedup", repeated_passages_go),
    ("pii", personal_data_is_masked),
    ("packing", sequences_are_packed),
]

#: No SQL: the stages learn, hash and search; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages; each stage is written and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.stage(docs, name)
    return docs
