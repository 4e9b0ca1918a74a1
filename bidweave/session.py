"""A session with the settings that the engine's semantics rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Code page 1252 is no default charset of Spark 4; notice extracts use it.
    "spark.sql.legacy.javaCharsets": "true",
    # Overlapping keys in map_concat: the right side wins.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that can still change in a running session."""
    for key, value in SETTINGS.items():
        if key == "spark.sql.legacy.javaCharsets":
            try:
                spark.conf.set(key, value)
            except Exception:  # static in some builds: readers then decode by themselves
                continue
        else:
            spark.conf.set(key, value)
    return spark


def build(name: str = "bidweave", master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once an application, for data sources and functions that run in their Python."""
    app = spark.sparkContext.applicationId
    root = os.path.dirname(os.path.abspath(__file__))
    if app in _shipped or not os.path.isdir(root):
        return
    folder = tempfile.mkdtemp(prefix="bidweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "bidweave.zip")
    with zipfile.ZipFile(target, "w") as out:
        for at, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
