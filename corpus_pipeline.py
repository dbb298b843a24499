"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents. ``run``
writes each stage's table as Parquet in the shared folder, reads it again for the next, and deletes it when that is written.

Defined cases. Null and empty texts, and texts of fewer than 50 words, fail the quality rules and go. Given to a later stage, they
are one near-duplicate group by their fingerprint, hold no personal data, are sampled like their cell, and are packed as an
end token. Of rows that repeat an id one stays after the second stage; rows without an id stay, draw by their text, and are packed like
any other. Equal texts are one group, of which the smallest id stays. An empty table gives empty tables. Other columns are kept
as they are by all stages but the last; names that an operator uses within do not clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, perplexity, pii, simhash
from tidemark.llm.common import discard, materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; models and bands are fitted on all documents given, without labels."""
    return perplexity.keep_documents(perplexity.fit_rules(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    return simhash.keep_one_per_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the kinds of personal data in place of the data."""
    return pii.mask(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the target weights of sources, languages and topics."""
    return mixing.mix(docs, describe=False)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequences and places."""
    return packing.pack(packing.token_pieces(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Tokens, fingerprints and language models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
