from __future__ import annotations

import pytest
from pyspark.sql import functions as F

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and very long texts, repeated rows, equal texts, and clashing column names."""
    prose = "The quick brown fox jumps over the lazy dog near the old stone bridge at noon today. " * 8
    rows = [
        (1, prose, "en", "a", len(prose), "x", 1),
        (1, prose, "en", "a", len(prose), "x", 1),  # a repeated row
        (2, prose, "en", "b", None, None, None),  # a copy
        (3, "", "en", "a", 0, "x", 1),
        (4, None, None, None, None, None, None),
        (None, prose.upper(), "en", "a", 5, "x", 1),
        (5, LONG, "fr", "a", 5, "x", 1),
        (6, "x" * 200_000, "fr", "c", 5, "x", 1),
        (7, "Éa b \U0001f600 c", "de", "a", 5, "x", 1),
        (8, " \t\n ", "de", "a", 5, "x", 1),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, kept int")
    clashing = ("removed", "mix_tokens", "mix_topic", "mix_probability", "component_id", "score", "code", "split", "range", "start", "end", "n", "name", "base", "spans")
    return frame.select("*", *(F.lit("x").alias(name) for name in clashing))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {row["doc_id"]: row["text"] for row in documents.select("doc_id", "text").collect()}
