"""Incremental maintenance of a keyed target: what changed, what to write, what to delete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ids import content_hash, fingerprint
from ..storage import Snapshots

COUNTS = {"add": "adds", "reprocess": "reprocesses", "unchanged": "unchanged", "delete": "deletes"}
ACTIONS = tuple(COUNTS)


def classify(sources: DataFrame, memo: DataFrame, force: bool = False) -> DataFrame:
    """(source_key, content_hash, action) of every source, now or before. An unreadable source (null hash) is never unchanged."""
    now, old = sources.select("source_key", "content_hash"), memo.select("source_key", F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    both = now.withColumn("here", F.lit(True)).join(old, "source_key", "full")
    same = F.col("content_hash").eqNullSafe(F.col("old_hash")) & F.col("content_hash").isNotNull() & F.lit(not force)
    action = F.when(F.col("here").isNull(), "delete").when(F.col("known").isNull(), "add").when(same, "unchanged").otherwise("reprocess")
    return both.select("source_key", "content_hash", action.alias("action"))


def row_diff(desired: DataFrame, stored: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, action): insert, replace, skip or delete of every row, by fingerprints of the non-key columns."""
    d = desired.select(*key, fingerprint(*[F.col(c) for c in values]).alias("new"))
    s = stored.select(*key, fingerprint(*[F.col(c) for c in values]).alias("old"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("new") == F.col("old"), "skip").otherwise("replace")
    return d.join(s, key, "full").select(*key, action.alias("action"))


def orphans(lineage: DataFrame, new: DataFrame) -> DataFrame:
    """(source_key, row_id): rows of reprocessed sources that these no longer give."""
    return lineage.join(new, ["source_key", "row_id"], "left_anti")


def sweep(known: DataFrame, live: DataFrame) -> DataFrame:
    """Source keys that are known from lineage or memo but gone."""
    return known.select("source_key").distinct().join(live.select("source_key"), "source_key", "left_anti")


def run_stats(actions: DataFrame, component: Column | None = None) -> DataFrame:
    """(component, action, n) with totals as component 'total'."""
    c = F.lit("main") if component is None else component
    g = actions.select(c.alias("component"), "action").rollup("action", "component").agg(F.count(F.lit(1)).alias("n"), F.grouping("component").alias("g"), F.grouping("action").alias("h"))
    return g.where("h = 0").select(F.when(F.col("g") == 1, "total").otherwise(F.col("component")).alias("component"), "action", "n")


class Target:
    """A keyed table with lineage and memo, kept in step with its sources.

    Rows have source_key, row_id and the given columns. One commit per update covers rows, lineage
    (the rows' source_key) and memo: the version pointers move last, the memo's after the rows'. If a run dies in between,
    the memo is old and the next run repeats the work, which the row diff makes idempotent.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, version: str = "1", settings: str = ""):
        self.spark, self.version, self.settings = spark, version, settings
        self.rows = Snapshots(spark, f"{path}/rows", f"source_key string, row_id bigint, {columns}", "source_key")
        self.memo = Snapshots(spark, f"{path}/memo", "source_key string, content_hash string")

    def hashed(self, sources: DataFrame, content: str = "content") -> DataFrame:
        """sources with content_hash: content, logic version and settings."""
        return sources.withColumn("content_hash", content_hash(self.version, self.settings, F.col(content)))

    def update(self, sources: DataFrame, transform: Callable[[DataFrame], DataFrame], force: bool = False, content: str = "content", allow_empty: bool = False) -> dict[str, int]:
        """Transform added and changed sources only; delete the rows of vanished ones.

        Returns counts: adds, reprocesses, unchanged, deletes, processed (adds and reprocesses), errors (sources with a null hash: never
        remembered, so tried again), writes and skips of rows. An exception of the transform leaves the target as it was.
        ValueError where all known sources have vanished at once, unless ``allow_empty`` says that it is meant.
        """
        hashed = self.hashed(sources, content)
        actions = classify(hashed, self.memo.read(), force).cache()
        counts = {a: 0 for a in ACTIONS} | {r.action: r["count"] for r in actions.groupBy("action").count().collect()}
        errors = actions.where("action <> 'delete' and content_hash is null").count()
        if counts["delete"] and counts["delete"] == sum(counts.values()) and not allow_empty:
            actions.unpersist()
            raise ValueError(f"all {counts['delete']} known sources are gone; allow_empty=True deletes their rows")
        out = {COUNTS[a]: counts[a] for a in ACTIONS} | {"processed": counts["add"] + counts["reprocess"], "errors": errors, "writes": 0, "skips": 0}
        if counts["unchanged"] == sum(counts.values()):
            actions.unpersist()
            return out
        changed = hashed.join(actions.where("action in ('add', 'reprocess')").select("source_key"), "source_key", "left_semi")
        gone = actions.where("action <> 'unchanged'").select("source_key")
        parts = self.rows.touched(gone)
        stored = self.rows.read(parts)
        values = [c for c in stored.columns if c not in ("source_key", "row_id")]
        desired = transform(changed).select("source_key", "row_id", *values).dropDuplicates(["source_key", "row_id"]).cache()
        diff = row_diff(desired, stored.join(gone, "source_key", "left_semi"), ["source_key", "row_id"], values)
        by = {r.action: r["count"] for r in diff.groupBy("action").count().collect()}
        if by.keys() - {"skip"}:
            self.rows.commit(stored.join(gone, "source_key", "left_anti").unionByName(desired), parts)
        self.memo.commit(actions.where("action <> 'delete' and content_hash is not null").select("source_key", "content_hash"))
        desired.unpersist()
        actions.unpersist()
        return out | {"writes": by.get("insert", 0) + by.get("replace", 0), "skips": by.get("skip", 0)}

    def lineage(self) -> DataFrame:
        return self.rows.read().select("source_key", "row_id")

    def drop_source(self, source_key: str) -> int:
        """Delete a source's rows and forget it; returns the number of rows."""
        parts = self.rows.touched(self.spark.createDataFrame([(source_key,)], "source_key string"))
        rows = self.rows.read(parts)
        n = rows.where(F.col("source_key") == source_key).count()
        self.rows.commit(rows.where(F.col("source_key") != source_key), parts)
        self.memo.commit(self.memo.read().where(F.col("source_key") != source_key))
        return n
