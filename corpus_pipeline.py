"""From raw documents to packed token sequences: language, copies, near copies, leaks, packing.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which ``run`` writes as Parquet and reads again for the next stage.  All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import documents, stage, sweep, tables_made
from brindle.llm.decontaminate import drop_contaminated
from brindle.llm.exact_dedup import drop_copies
from brindle.llm.language_id import drop_unexplained
from brindle.llm.near_dedup import drop_near_copies
from brindle.llm.packing import pack

#: A text is rejected if no language explains this share of its n-grams.
LEAST_EXPLAINED = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty ones too) and those that no learned language explains.

    Each row is judged by its own text, a row without an id as well; repeated rows share
    their fate; without any language to learn from all rows stay.
    """
    return drop_unexplained(docs, LEAST_EXPLAINED)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the smallest id stays, once.

    Null texts are equal to empty ones.  A row without an id stays only if no equal text
    has an id, and then once.
    """
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8.

    Texts without words stay.  Rows with one id and text share their fate; a row without
    an id goes only if a row with an id has the same shingles.
    """
    return drop_near_copies(docs, words=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text, with an id or without; empty texts stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 4096 tokens; every row is packed, without an id or text as well."""
    return pack(docs, generation=150_000)  # other stages share the executors' memory


STAGES = [("language", language), ("exact", exact), ("near", near), ("leaks", leaks), ("packing", packing)]

#: The language model and tokenizers are outside SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; once a stage's table is written, all scratch tables before it are deleted."""
    docs, made = documents(spark, sf_dir), tables_made()
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(spark, made, keep=docs)
    name, step = STAGES[-1]
    return step(spark, docs, sf_dir)
