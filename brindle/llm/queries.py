"""Queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents


def op1_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(documents(spark, sf_dir))


def op2_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(documents(spark, sf_dir))


def op3_pack_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir)).drop("ids")


def op4_toxicity_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_secrets_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(documents(spark, sf_dir))


def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(documents(spark, sf_dir), words=4)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir)).drop("kept")


def op9_exact_lsm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op10_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary_output import read_token_files, write_token_files

    return read_token_files(spark, write_token_files(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_bitmask, op2_pii_boosted, op3_pack_concat_cut, op4_toxicity_levenshtein, op5_secrets_linked,
    op6_bm25_decontamination, op7_minmax_near_dedup, op8_suffix_array_dedup, op9_exact_lsm_dedup, op10_rans_token_files,
)}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

SQL: dict[str, str] = {
    "op9_exact_lsm_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORM} AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)""",
}
