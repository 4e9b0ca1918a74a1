"""Upserts on plain tables: the stored rows and the incoming ones make the next version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.operators.rows import differs


@dataclass(frozen=True)
class Merged:
    """The next table with ``_written`` (inserted or replaced by this merge)."""

    table: DataFrame

    def result(self) -> DataFrame:
        return self.table.drop("_written")

    def written(self) -> DataFrame:
        return self.table.where("_written").drop("_written")

    def count_written(self) -> int:
        return self.table.where("_written").count()


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    newer: str | None = None,
    ignore: Sequence[str] = (),
    replaceable: Column | None = None,
) -> Merged:
    """Full outer join on ``keys`` (never null, unique on either side).

    A stored row is replaced if some column but the ignored ones differs, and, with ``newer``, if the stored
    value of that column is null or not after the incoming one (a null incoming value never beats a stored
    one), and, with ``replaceable`` (over the stored columns), if that holds.
    """
    columns = stored.columns
    content = [c for c in columns if c not in keys and c not in ignore]
    old = stored.select(*keys, F.struct(*columns).alias("_old"), (F.lit(True) if replaceable is None else F.coalesce(replaceable, F.lit(False))).alias("_free"))
    new = incoming.select(*keys, F.struct(*columns).alias("_new"))
    both = old.join(new, list(keys), "full_outer")
    take = differs([F.col(f"_old.{c}") for c in content], [F.col(f"_new.{c}") for c in content]) & F.col("_free")
    if newer:
        take &= F.coalesce(F.col(f"_old.{newer}").isNull() | (F.col(f"_new.{newer}") >= F.col(f"_old.{newer}")), F.lit(False))
    fresh = F.col("_old").isNull()
    written = F.col("_new").isNotNull() & (fresh | F.coalesce(take, F.lit(False)))
    row = F.when(written, F.col("_new")).otherwise(F.col("_old"))
    return Merged(both.select(written.alias("_written"), row.alias("_row")).select("_row.*", "_written"))


def merge_reference(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Last non-null value wins in every column; flags are or-ed."""
    columns = [c for c in stored.columns if c not in keys]
    both = stored.alias("s").join(incoming.alias("i"), list(keys), "full_outer")

    def value(c: str) -> Column:
        if c in flags:
            return (F.coalesce(F.col(f"s.{c}"), F.lit(False)) | F.coalesce(F.col(f"i.{c}"), F.lit(False))).alias(c)
        return F.coalesce(F.col(f"i.{c}"), F.col(f"s.{c}")).alias(c)

    return both.select(*keys, *map(value, columns))


def replace_automatic(stored: DataFrame, rows: DataFrame, keys: Sequence[str], scope: DataFrame, ignore: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(next table, counts of written and deleted): automatic rows of the scope become ``rows``.

    Rows that a person has judged (status other than auto) are never touched. ``scope`` lists the keys whose
    stale automatic rows go; it shares some columns with the table.
    """
    merged = upsert(stored, rows, keys, ignore=ignore, replaceable=F.col("status") == "auto").table
    on = [c for c in scope.columns if c in stored.columns]
    marked = merged.join(scope.select(*on).distinct().withColumn("_scope", F.lit(True)), on, "left")
    marked = marked.join(rows.select(*keys).withColumn("_fresh", F.lit(True)), list(keys), "left")
    stale = F.col("_scope").isNotNull() & F.col("_fresh").isNull() & (F.col("status") == "auto")
    counts = marked.agg(F.count_if(F.col("_written")).alias("written"), F.count_if(stale).alias("deleted"))
    return marked.where(~F.coalesce(stale, F.lit(False))).select(*stored.columns), counts


class VersionedTable:
    """A directory of snapshots ``v=<n>``; the file ``committed/<n>`` says that one is whole.

    A snapshot is written first; its file is written aside and renamed to a name that isn't there, so readers see it
    whole or not at all, and see the old table or the new one. Old snapshots stay for ``grace`` seconds after newer
    ones, for readers that have begun. The file also holds tags, such as the last batch that the table has taken in.
    Files go through Spark's file systems, so the directory may be in any store they reach. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _place(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self) -> dict[int, int]:
        """When each snapshot was committed, in milliseconds."""
        place, fs = self._place("committed")
        if not fs.exists(place):
            return {}
        return {int(f.getPath().getName()): f.getModificationTime() for f in fs.listStatus(place) if f.getPath().getName().isdigit()}

    def version(self) -> int:
        """The current version, 0 before the first write."""
        return max(self._committed(), default=0)

    def tags(self) -> dict[str, str]:
        """What the current version was tagged with; tags carry over to the next."""
        n = self.version()
        if not n:
            return {}
        place, fs = self._place(f"committed/{n}")
        source = fs.open(place)
        text = bytearray()
        while (b := source.read()) >= 0:
            text.append(b)
        source.close()
        return json.loads(text.decode())

    def read(self) -> DataFrame:
        n = self.version()
        if not n:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={n}")

    def write(self, df: DataFrame, keep: int = 2, grace: float = 24 * 3600, tags: Mapping[str, str] | None = None) -> int:
        """Write and commit the next snapshot, and delete those that are neither of the last ``keep`` nor within ``grace``."""
        before = self._committed()
        carried = self.tags() | dict(tags or {})
        n = max(before, default=0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={n}")
        aside, fs = self._place(f"committed/_{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(carried).encode()))
        out.close()
        if not fs.rename(aside, self._place(f"committed/{n}")[0]):
            fs.delete(aside, False)
            raise RuntimeError(f"another writer has committed version {n} of {self.path}")
        whole = self._committed()
        for old in sorted(whole):
            follower = whole.get(old + 1)
            if old <= n - keep and follower is not None and whole[n] - follower >= 1000 * grace:
                fs.delete(self._place(f"committed/{old}")[0], False)
                fs.delete(self._place(f"v={old}")[0], True)
        return n
