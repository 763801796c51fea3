"""One query per operator, over its whole table, with production parameters; SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, exact_dedup, html_extract, langid, licenses, line_dedup, minhash, mixing, packing, toxicity
from .frames import read


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.linked_lines(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicates(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(read(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_neighbours": op7_neighbours,
    "op8_packing": op8_packing,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, duplicate_of, n_bytes FROM (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS duplicate_of, strlen(text)::BIGINT AS n_bytes
            FROM documents WHERE text IS NOT NULL)
        WHERE doc_id <> duplicate_of""",
    "op4_mixing": mixing.SQL,
    "op8_packing": packing.SQL,
}
