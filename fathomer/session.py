"""Session set-up: settings that the engine's queries rely on, and shipping of the package to workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(app: str = "fathomer", **settings: str) -> SparkSession:
    """A session with the engine's settings; keyword settings use __ for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """On a single machine, make this package importable in Python workers whatever the working directory is; once per session.

    On a cluster the package is deployed with the job (--py-files or the executors' path).
    """
    sc = spark.sparkContext
    if getattr(sc, "_fathomer_shipped", False) or not (sc.master == "local" or sc.master.startswith("local[")):
        return
    sc._fathomer_shipped = True
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(prefix="fathomer-ship-"), "fathomer.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "fathomer")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(at)
