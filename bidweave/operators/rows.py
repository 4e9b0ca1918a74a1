"""First and top rows of groups, changes between rows, and sets of keys."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; where that is unset, a local master gets a folder of its own, and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "bidweave-checkpoints")
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Computed once and kept in the checkpoint folder that all executors share, so that later uses don't start over."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: So many rows of keys go to every task.
FEW = 1_000_000


def sent(keys: DataFrame) -> DataFrame:
    """Rows of keys, computed before, as a side of a join: they go to every task while they are few, and the other side stays where it is; more are shuffled with it."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


def chosen(df: DataFrame, by: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` with a key that ``by`` has; only these are moved while the keys are few."""
    return df.join(sent(cut(by.select(key).distinct())), key, "left_semi")


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (which should be total for a repeatable choice)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key; Spark keeps only those of each task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest(df: DataFrame, keys: Sequence[str], version: str, value: str) -> DataFrame:
    """The value at each key's greatest version, a null value included."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v")), version).alias("_s")).select(*keys, F.col("_s.v").alias(value))


def differs(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """IS DISTINCT FROM between two lists of columns."""
    out = F.lit(False)
    for a, b in zip(left, right, strict=True):
        out = out | ~a.eqNullSafe(b)
    return out


def links_within(found: DataFrame, group: str, keys: Sequence[str], method: str, most: int) -> DataFrame:
    """Pairs with their least method, without the groups that have over ``most`` links.

    Links are counted before pairs found by two methods become one.
    """
    counts = found.groupBy(group).agg(F.count("*").alias("_links")).where(F.col("_links") <= most)
    return found.join(counts, group, "left_semi").groupBy(*keys).agg(F.min(method).alias(method))


def sample_order(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """A repeatable pseudo-random sample."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary")), key).limit(n)


def union_override(preferred: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; where a key is in both, the preferred one's."""
    return preferred.unionByName(other.join(preferred.select(*keys), list(keys), "left_anti"))
