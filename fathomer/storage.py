"""Durable intermediate results and snapshot tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on one machine, without it, a temporary folder."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_fathomer_folder", None)
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = sc._fathomer_folder = tempfile.mkdtemp(prefix="fathomer-")
    return at


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a checkpoint that survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, at: str):
    """The Hadoop file system of a path or URI, and the path in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def read_text(spark: SparkSession, at: str) -> str | None:
    """A small file's text; null if there is none."""
    fs, path = file_system(spark, at)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, at: str, text: str) -> None:
    """Replace a small file in one step: readers see the old or the new text."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs, path = file_system(spark, at)
    _, temp = file_system(spark, f"{at}.{uuid.uuid4().hex[:8]}")
    stream = fs.create(temp, True)
    stream.write(text.encode())
    stream.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    overwrite[0] = jvm.Options.Rename.OVERWRITE
    qualified = fs.makeQualified(temp)
    jvm.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration()).rename(qualified, fs.makeQualified(path), overwrite)


class Snapshots:
    """A table in immutable parts and a manifest that names the current ones.

    Rows are dealt to ``parts`` by a hash of ``key``. A commit writes only the parts that it replaces, to a new folder v=N-token, and
    becomes visible by one rename of the manifest, so readers see either the old or the new table, and a failed
    write leaves the old one. Folders that neither the current nor the previous manifest names are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | None = None, parts: int = 64):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.parts = parts if key else 1

    def _manifest(self) -> dict:
        text = read_text(self.spark, f"{self.path}/_CURRENT")
        return json.loads(text) if text else {"version": 0, "parts": {}, "before": []}

    def version(self) -> int:
        """The current version; 0 for a table that was never written."""
        return self._manifest()["version"]

    def part_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int") if self.key else F.lit(0)

    def touched(self, keys: DataFrame) -> list[int]:
        """The parts of some keys: at most ``parts`` numbers."""
        return sorted(r[0] for r in keys.select(self.part_of(F.col(self.key or keys.columns[0]))).distinct().collect())

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The table, or the given parts of it."""
        wanted = {int(p): f for p, f in self._manifest()["parts"].items() if parts is None or int(p) in parts}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}/part={p}" for p, f in sorted(wanted.items())])

    def commit(self, df: DataFrame, parts: list[int] | None = None) -> int:
        """Make df the table, or the given parts of it (df then holds rows of these only)."""
        old = self._manifest()
        v, folder = old["version"] + 1, f"v={old['version'] + 1}-{uuid.uuid4().hex[:8]}"
        rows = df.select(*[c.strip().split(" ")[0] for c in _fields(self.schema)]).withColumn("part", self.part_of(F.col(self.key)) if self.key else F.lit(0))
        rows.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/{folder}")
        fs, at = file_system(self.spark, f"{self.path}/{folder}")
        new = {s.getPath().getName()[5:]: folder for s in fs.listStatus(at) if s.getPath().getName().startswith("part=")}
        kept = {} if parts is None else {p: f for p, f in old["parts"].items() if int(p) not in parts}
        manifest = {"version": v, "parts": {**kept, **new}, "before": sorted(set(old["parts"].values()))}
        write_text(self.spark, f"{self.path}/_CURRENT", json.dumps(manifest))
        live = {*manifest["parts"].values(), *manifest["before"]}
        for s in fs.listStatus(at.getParent()):
            if s.getPath().getName().startswith("v=") and s.getPath().getName() not in live:
                fs.delete(s.getPath(), True)
        return v


def _fields(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table's folder."""
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)
