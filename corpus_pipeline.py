"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing and packing of the documents table.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. ``run`` writes what a stage returns as Parquet in
the shared folder, deletes what the stage wrote on its way, and gives the reread table to the next one, so a lost executor costs one stage's work at most.
Every stage but the last returns the columns of documents. How a stage treats nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns is defined in its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomer.llm import exact_dedup, frames, minhash, mixing, packing, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, frames.read(spark, sf_dir, "labels"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, frames.read(spark, sf_dir, "embeddings"))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("minhash near-dedup", remove_near_copies),
    ("mixing to target weights", mix_sources),
    ("packing", pack_batches),
]

#: The first stage is a trained model, which SQL can't express; a test holds run() against a brute-force version of the five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = frames.kept(spark, lambda d=docs, f=stage: f(spark, d, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
