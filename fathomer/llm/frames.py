"""DataFrame helpers of this package: narrow reads, checked broadcasts, durable cuts of lineage."""

from __future__ import annotations

import contextlib
import functools
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StructField, StructType

#: A side of a join is broadcast up to so many estimated bytes; beyond it, Spark shuffles.
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, on a single machine only, a temporary folder."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark.sparkContext, "_fathomer_shared", None) or tempfile.mkdtemp(prefix="fathomer-")
        spark.sparkContext._fathomer_shared = at
    return at


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept where an executor's loss doesn't reach it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def _hadoop(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder; it can be pruned and filtered when read.

    The table goes at the end of the innermost ``scope``; without one, when the driver's JVM ends.
    """
    spark = df.sparkSession
    at = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(at)
    fs, path = _hadoop(spark, at)
    fs.deleteOnExit(path)
    scopes = getattr(spark.sparkContext, "_fathomer_scopes", [])
    if scopes:
        scopes[-1].append(at)
    return spark.read.schema(df.schema).parquet(at)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at its end: nothing may read them later."""
    sc = spark.sparkContext
    sc._fathomer_scopes = [*getattr(sc, "_fathomer_scopes", []), []]
    try:
        yield
    finally:
        for at in sc._fathomer_scopes.pop():
            fs, path = _hadoop(spark, at)
            fs.delete(path, True)


def kept(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns as a written table, without the tables that were written on the way."""
    with scope(spark):
        out = written(make(), name)
        spark.sparkContext._fathomer_scopes[-1].pop()
    return out


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast if a count says that it is small enough. df must be cheap to count (a cut table)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def by_id(df: DataFrame, n: int, column: str = "pid") -> DataFrame:
    """Rows to the partition that they name."""
    return df.repartitionById(n, F.col(column))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the md5 of a key: the same in any engine."""
    h = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def shielded(f):
    """A function of docs whose own columns may carry this package's working names (_fx_...): they are renamed meanwhile."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        spare = (n for i in itertools.count() if (n := f"_shield{i}") not in taken)
        away = {c: next(spare) for c in docs.columns if c.lower().startswith("_fx_")}
        out = f(docs.withColumnsRenamed(away), *args, **options)
        return out.withColumnsRenamed({v: k for k, v in away.items()})

    return run


def with_fields(schema: StructType, *fields: tuple[str, str]) -> StructType:
    """schema and further nullable fields (name, type)."""
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields] + [StructField(n, _parse(t), True) for n, t in fields])


def _parse(kind: str) -> DataType:
    return {"bigint": LongType(), "double": DoubleType(), "boolean": BooleanType()}[kind]
