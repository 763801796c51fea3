"""Directories of files as source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_image, is_indexable, language_of
from ..storage import file_system

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
COLUMNS = "source_key string, path string, modificationTime timestamp, length bigint, content binary, is_image boolean, language string"


def items(spark: SparkSession, root: str) -> DataFrame:
    """All indexable files below root (a path or any URI that Hadoop reads), keyed by relative path.

    FileNotFoundError if there is no such folder: an unreadable root must not look like an empty one.
    Content is read only where it is used: a selection of the other columns lists files and no more.
    """
    fs, path = file_system(spark, root)
    if not fs.exists(path):
        raise FileNotFoundError(root)
    base = fs.makeQualified(path).toString().rstrip("/")
    if not fs.listFiles(path, True).hasNext():
        return spark.createDataFrame([], COLUMNS)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    plain = F.regexp_replace("path", "^([a-z0-9]+:)//(?=/)", "$1")
    named = raw.withColumn("source_key", F.substring(plain, len(base) + 2, 1 << 20)).where(is_indexable(F.col("source_key")))
    return named.select("source_key", "path", "modificationTime", "length", "content", is_image(F.col("source_key")).alias("is_image"), language_of(F.col("source_key")).alias("language"))


def signature(sources: DataFrame) -> DataFrame:
    """(source_key, modificationTime, length), without reading contents."""
    return sources.select("source_key", "modificationTime", "length")


def combined(*signatures: DataFrame) -> DataFrame:
    """Signatures of several sources, kept apart by source_ix."""
    out = None
    for i, s in enumerate(signatures):
        one = s.select(F.lit(i).alias("source_ix"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no signatures")
    return out


def digest(signature: DataFrame) -> str:
    """One value of a listing that any addition, edit or deletion changes."""
    row = signature.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*signature.columns).cast("decimal(38,0)")), F.lit(0))).first()
    return f"{row[0]}-{row[1]}"


def texts(sources: DataFrame) -> DataFrame:
    """sources with text: strict UTF-8; null where the bytes aren't."""
    return sources.withColumn("text", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")))
