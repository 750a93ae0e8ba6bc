"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as
the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tersa.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from tersa.llm.common import documents, scratch, written
from tersa.llm.queries import MIX_WEIGHTS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are frequent in a host go; documents that fail the rules or are depleted go; a null text fails them.

    In this and all further stages rows that repeat are rows of their own, a null id is a value like any other, further columns
    pass through, and an empty table gives an empty one."""
    return quality_rules.cleaned(docs, host="source", equal_texts_once=True)


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component stays; documents left without words go. Rows equal in id and text lose the same lines."""
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the first by id: shingles of five words, similarity of 0.8 or more. Rows without words all stay."""
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as come in, by the target weights; a document comes once for each epoch that takes it."""
    chosen, _ = mixing.mix(docs, max_epochs=2, weights=MIX_WEIGHTS, seed=17)
    return chosen.select("doc.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in sequences of at most 4,096; a null text has its end token only."""
    return packing.pack(docs, capacity=4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", fuzzy_lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", sequences),
]

#: Tokenising has no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. What a stage wrote on its way goes when its result is written, as do the results before it."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch(spark, f"stage-{name}"):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", *([before] if before else []))
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
