"""Whitening of embeddings by the covariance of exactly centred integer vectors.

Entries become integers, so sums over the table are exact, and so is the difference of each row from the mean.
Spark MLlib's ``RowMatrix`` adds up the Gramian of the centred rows; its eigenvectors are found on the driver (a
matrix of the vectors' length squared) and broadcast, and tasks project their rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.llm.common import materialise, prepare, release

#: Entries are counted in steps of 1 / SCALE, from OFFSET.
SCALE, OFFSET = 1_024, 100_000
COMPONENTS = 8
#: Largest entry that is taken: its integer fits in a long with room for the offset.
LARGEST = float(1 << 50)
#: Components of a smaller share of the largest eigenvalue are rounding alone, and have no scale to divide by.
NO_VARIANCE = 1e-10
_OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _gramian(rows: DataFrame, centred: Column, width: int) -> np.ndarray:
    """Sum of the outer products of ``centred``, an array of doubles."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("row")), "row")
    return RowMatrix(vectors, numCols=width).computeGramianMatrix().toArray()


def _minus(array: Column, means: list[float]) -> Column:
    return F.zip_with(array, F.array(*map(F.lit, means)), lambda a, b: a - b)


def eigen(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; those without variance are left out.

    A vector's sign is chosen so that its largest entry is positive.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    some = values > NO_VARIANCE * max(values.max(initial=0.0), 0.0)
    values, vectors = values[some], vectors[:, some]
    if values.size:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    return values, vectors


def deviations(m: np.ndarray, n: int, r: np.ndarray) -> list[int]:
    """Sums over each row of (n * m - r) squared, exact at any size."""
    most = int(np.abs(m).max(initial=0))
    if most * max(most, n) * m.shape[1] >= 1 << 62:
        m, r = m.astype(object), r.astype(object)
    squares, crossed, rest = (m * m).sum(axis=1), (m * r).sum(axis=1), sum(int(x) ** 2 for x in r)
    return [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip(squares, crossed, strict=True)]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    An entry c becomes x = floor(1024 * c) + 100000. Of n vectors with the sums S, ``deviation`` is the exact sum of
    (n * x - S) squared over a row, ``whitened`` the projection of x - S / n on a unit eigenvector of x's covariance,
    divided by the root of its eigenvalue, ``explained`` that eigenvalue's share of all, and ``identity_error`` how far
    the covariance of the whitened rows is from the identity at most.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part. Repeated rows count as often
    as they occur, rows of a null vec_id as any other. All vectors of a fit have one length: that of most rows (of
    equally frequent ones the smaller), and a warning tells how many of other lengths are left out. An entry beyond
    2 ** 50 is a ValueError. Components without variance (all of them, where no two vectors differ) don't come out.
    Equal eigenvalues share a plane, in which any basis will do. Other columns are not read. Without vectors there are
    no rows. The driver holds two matrices of the vectors' length squared.
    """
    spark = vectors.sparkSession
    prepare(spark)
    empty = spark.createDataFrame([], _OUT)
    entry = F.when(F.abs("c") <= LARGEST, F.floor(F.col("c") * F.lit(float(SCALE))) + F.lit(OFFSET))
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & usable)
    lengths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    total = lengths.agg(F.sum("n")).first()[0]
    if not total:
        return empty
    width, n = lengths.orderBy(F.desc("n"), "width").first()
    if n < total:
        warnings.warn(f"{total - n} vectors have other lengths than {width} and are left out", stacklevel=2)
    rows = rows.where(F.size("v") == width)
    sums = rows.select(F.posexplode("v").alias("at", "c")).select("at", entry.alias("x")).groupBy("at")
    sums = sums.agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.count_if(F.col("x").isNull()).alias("beyond")).orderBy("at").collect()
    if any(r["beyond"] for r in sums):
        raise ValueError(f"entries beyond {LARGEST:.0f} can't be added up exactly")
    # S = q * n + r: x - q is exact, and x - S / n is rounded once.
    q, r = zip(*(divmod(int(row["s"]), n) for row in sums), strict=True)
    whole = F.zip_with("v", F.array(*(F.lit(a).cast("long") for a in q)), lambda c, a: F.floor(c * float(SCALE)) + F.lit(OFFSET) - a)
    m = rows.select("vec_id", whole.alias("m"))
    centred = _minus(F.transform("m", lambda x: x.cast("double")), [b / n for b in r])
    covariance = _gramian(m, centred, width) / n
    values, axes = eigen(covariance, components)
    if not values.size:
        return empty
    k = len(values)
    shared = spark.sparkContext.broadcast((np.array(r, dtype=np.int64), axes / np.sqrt(values)))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, scaled = shared.value
        for frame in frames:
            if len(frame):
                x = np.stack(frame["m"].to_numpy()).astype(np.int64)
                out = (x.astype(np.float64) - rest / n) @ scaled
                exact = [Decimal(v) for v in deviations(x, n, rest)]
                yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "deviation": exact, "w": list(out)})

    done, path = materialise(m.mapInPandas(project, "vec_id long, deviation decimal(38,0), w array<double>"), "whitened")
    release(spark, path)
    means = list(done.select(*(F.avg(F.col("w")[i]) for i in range(k))).first())
    error = float(np.abs(_gramian(done, _minus(F.col("w"), means), k) / n - np.eye(k)).max())
    share = [float(v) for v in values / np.trace(covariance)]
    each = done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, share))[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
