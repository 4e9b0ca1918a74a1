"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of one Arrow batch sent to Python; keep very long texts within a worker's memory.
ARROW_ROWS = 512
ARROW_BYTES = 32 << 20

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors once per application, and lower the session's Arrow batches to our bounds.

    The session's own limits stay where they are lower. (A plan reads them when it runs, so they can't be put back.)
    """
    for setting, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{setting}"
        now = int(re.match(r"-?\d+", spark.conf.get(name))[0])
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        package = os.path.basename(root)
        target = os.path.join(tempfile.mkdtemp(prefix=f"{package}-"), f"{package}.zip")
        with zipfile.ZipFile(target, "w") as out:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(root)))
        spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own (there is one machine); on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "bidweave-checkpoints")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/bidweave-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _places(spark: SparkSession, paths: tuple[str, ...]):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        yield place, place.getFileSystem(conf)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for place, store in _places(spark, paths):
        store.delete(place, True)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables that a returned frame still reads when the application ends."""
    for place, store in _places(spark, paths):
        store.deleteOnExit(place)


def finish(df: DataFrame, tag: str, *paths: str) -> DataFrame:
    """The result as a table of its own, kept until the application ends; the scratch tables behind it go now."""
    spark = df.sparkSession
    out, path = materialise(df, tag)
    discard(spark, *paths)
    release(spark, path)
    return out


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_documents(docs: DataFrame, columns: list[str], limit: int, seed: str) -> list:
    """At most ``limit`` rows of ``docs``, chosen by a hash of doc_id (a repeatable, bounded sample).

    Only for fitting models: the share is set from a count, then cut to ``limit`` in hash order.
    """
    n = docs.count()
    if not n:
        return []
    rank = F.crc32(F.concat(F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    share = min(1.0, (1.1 * limit + 50) / n)
    picked = docs.select(rank.alias("_rank"), *columns).where(F.col("_rank") <= int(share * 0xFFFFFFFF))
    return sorted(picked.orderBy("_rank").limit(limit).collect(), key=lambda r: (r["_rank"], *map(str, r)))


def labelled_texts(docs: DataFrame, labels: DataFrame, mark: str, seed: str, most_docs: int, most_chars: int) -> tuple[list[str], list[int]]:
    """Texts and their labels (0 or 1) from a bounded sample of documents whose ids are not held out, to fit a model on.

    Whole texts are taken, documents in the order of a hash of their ids, until ``most_chars`` are full; a text that
    would not fit is passed over. A document with several labels has the greatest; null labels, ids and texts are left
    out, and a text that repeats under its id counts once.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(mark).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(mark).alias("_mark"))
    chosen = sample_documents(marks, ["doc_id", "_mark"], most_docs, seed)
    wanted = spark.createDataFrame([(r["doc_id"], i) for i, r in enumerate(chosen)], "_id long, _at int")
    found = docs.join(F.broadcast(wanted), docs["doc_id"] == wanted["_id"]).where(docs["text"].isNotNull())
    key = F.md5(docs["text"].cast("binary")).alias("_key")
    sizes = found.select("_at", key, F.length(docs["text"]).alias("_chars")).distinct().orderBy("_at", "_key").limit(2 * most_docs).collect()
    left, taken = most_chars, []
    for r in sizes:
        if r["_chars"] <= left:
            left -= r["_chars"]
            taken.append((chosen[r["_at"]]["doc_id"], r["_key"], r["_at"]))
    texts = spark.createDataFrame(taken, "_id long, _key string, _at int")
    same = (docs["doc_id"] == texts["_id"]) & (F.md5(docs["text"].cast("binary")) == texts["_key"])
    rows = docs.join(F.broadcast(texts), same).select("_at", "_key", docs["text"].alias("_text")).distinct().collect() if taken else []
    rows.sort(key=lambda r: (r["_at"], r["_key"]))
    return [r["_text"] for r in rows], [int(chosen[r["_at"]]["_mark"] > 0) for r in rows]


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of one key each from batches that are sorted by ``keys``."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = last is not None and first != last
        cuts = np.flatnonzero(change).tolist()
        start = 0
        for cut in cuts:
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
