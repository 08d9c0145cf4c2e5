"""A corpus pipeline: quality rules, language ID, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``. Between stages the documents are written as Parquet and read again.

Defined results, by stage. Null and empty texts, and those without words, are rejected by the quality rules; where they
come to language ID they are rejected there as ``und``; where they come to the near-duplicates stage they share
fingerprint zero, so one of them stays; packing gives each its end id alone. Rows without a doc_id pass all stages as
documents of their own, except that they are never anyone's near-duplicate. Rows that repeat are judged alike by the first
two stages, one of them is left by the third, and packing packs what comes to it one by one. Ties: of languages the one that
sorts first (though a tie is ambiguous, so its document goes), of near-duplicates the document of the least doc_id, and if
several texts have that id the one of the least fingerprint. Very long texts are read whole by every stage. An empty table
gives an empty table. Columns other than doc_id, text and, to learn languages from, lang are kept as they are through the
first three stages and may have any names; packing returns columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenweave.llm import langid, packing, quality, simhash
from lumenweave.llm.queries import VOCABULARY
from lumenweave.llm.shared import store, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that every quality rule passes."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is found without ambiguity."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least id."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens and their places in sequences."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

#: Fingerprints, classifiers and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
