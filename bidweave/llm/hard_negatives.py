"""Hard negatives by exact integer products, most of which a rotation spares.

An orthogonal rotation onto the principal axes of a sample puts the bulk of each product into its leading terms.
Blocks of rows meet blocks of anchors: partial products over the leading axes, and what the residual norms leave
possible for the rest (plus slack for rounding), rule out rows that can't be among the first. Those that are left are
multiplied as integers, which decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.llm.common import discard, finish, grouped, materialise, prepare
from bidweave.operators.rows import top_n

POSITIVES, NEGATIVES = 5, 5
#: Per cent of the positive's score that a negative reaches at least, and at most.
LOW, HIGH = 80, 100
#: Bounds of the sample that the rotation is fitted on: rows of one length, and numbers over all of them.
SAMPLE = 16_384
SAMPLE_NUMBERS = 1 << 21
#: Numbers in all rotations together (bounds what is broadcast: 64 MB); lengths beyond it are not rotated.
ROTATION_NUMBERS = 1 << 23
#: Rows that a task holds at least and at most, anchors of one block, and rows of one product.
LEAST_ROWS, MOST_ROWS, ANCHORS, TILE = 2_048, 65_536, 128, 2_048
#: Pairs whose integer products are taken at once.
PAIRS = 16_384
#: Shares of the axes after which bounds are looked at.
STEPS = (0.25, 0.5)
#: A product of two rows must fit in a long with room for a hundredfold.
LARGEST_PRODUCT = 1 << 56
_FOUND = "anchor_id long, positive_id long, positive_score long, other_id long, score long"


@dataclass(frozen=True)
class Rotation:
    """Orthogonal axes as columns, and how far they are from it."""

    axes: np.ndarray | None
    defect: float = 0.0

    def __call__(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        return x if self.axes is None else x @ self.axes


def rotation(sample: np.ndarray) -> Rotation:
    """The principal axes of a sample about the origin, largest first."""
    x = sample.astype(np.float64)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return Rotation(np.ascontiguousarray(axes), float(np.linalg.norm(axes.T @ axes - np.eye(len(axes)))))


class Rotated:
    """Rows with their rotated form, norms, and the norms of what is left after each step."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, turn: Rotation) -> None:
        self.ids, self.labels, self.v = ids, labels, v
        self.y = turn(v)
        width = v.shape[1]
        self.cuts = sorted({max(1, int(width * s)) for s in STEPS if int(width * s) < width}) + [width]
        tail = np.cumsum((self.y * self.y)[:, ::-1], axis=1)[:, ::-1]
        self.left = np.stack([np.sqrt(tail[:, c]) if c < width else np.zeros(len(ids)) for c in self.cuts], axis=1)
        self.norm = np.sqrt((self.y * self.y).sum(axis=1))
        # Rounding of a product of rotated rows, and of the rotation itself, for norms of one.
        self.slack = 32 * (width + 2) * np.finfo(np.float64).eps + 4 * turn.defect


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of the rows i of a with the rows j of b."""
    parts = [np.einsum("ij,ij->i", a[i[k : k + PAIRS]], b[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def search(anchors: Rotated, rows: Rotated, same_label: bool, low: np.ndarray, high: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each anchor and window of scores the first ``most`` rows: (anchor, window, row id, score) as arrays.

    Rows have the anchor's label, or another one; an anchor is no match of itself. Windows are columns of ``low`` and
    ``high``, integers with both ends included; low > high is no window. Larger scores come first, then smaller ids.
    """
    n_windows = low.shape[1]
    reach = np.where(low <= high, low, np.iinfo(np.int64).max).astype(np.float64)  # a score below isn't wanted any more
    top = np.where(low <= high, high, np.iinfo(np.int64).min).astype(np.float64)
    best = (np.zeros(0, dtype=np.int64),) * 4
    for at in range(0, len(rows.ids), TILE):
        columns = np.arange(at, min(at + TILE, len(rows.ids)))
        fits = (anchors.labels[:, None] == rows.labels[None, columns]) == same_label
        fits &= anchors.ids[:, None] != rows.ids[None, columns]
        partial, begin = np.zeros((len(anchors.ids), len(columns))), 0
        for step, end in enumerate(rows.cuts):
            partial += anchors.y[:, begin:end] @ rows.y[columns, begin:end].T
            begin = end
            bound = anchors.left[:, step, None] * rows.left[None, columns, step] + rows.slack * anchors.norm[:, None] * rows.norm[None, columns]
            alive = fits & (partial + bound >= reach.min(axis=1)[:, None]) & (partial - bound <= top.max(axis=1)[:, None])
            keep = alive.any(axis=0)
            columns, partial, fits, bound = columns[keep], partial[:, keep], alive[:, keep], bound[:, keep]
            if not len(columns):
                break
        if not len(columns):
            continue
        least, greatest = partial - bound, partial + bound
        wanted = np.zeros(fits.shape, dtype=bool)
        for w in range(n_windows):
            floor = reach[:, w].copy()
            if len(columns) >= most:
                # So many rows are certain to lie in the window that others need not be looked at below the last of them.
                sure = np.where(fits & (greatest <= top[:, w, None]) & (least >= low[:, w, None]), least, -np.inf)
                floor = np.maximum(floor, -np.partition(-sure, most - 1, axis=1)[:, most - 1])
            wanted |= fits & (least <= top[:, w, None]) & (greatest >= floor[:, None])
        i, j = np.nonzero(wanted)
        score, ids = _products(anchors.v, rows.v, i, columns[j]), rows.ids[columns[j]]
        found = [best]
        for w in range(n_windows):
            inside = (low[i, w] <= score) & (score <= high[i, w])
            found.append((i[inside], np.full(int(inside.sum()), w), ids[inside], score[inside]))
        a, w, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, -score, w, a))
        a, w, ids, score = a[order], w[order], ids[order], score[order]
        place = a * n_windows + w
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(place)) - np.repeat(starts, np.diff(np.r_[starts, len(place)]))
        first = rank < most
        best = (a[first], w[first], ids[first], score[first])
        last = rank == most - 1
        reach[a[last], w[last]] = np.maximum(reach[a[last], w[last]], score[last].astype(np.float64))
    yield best


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _meet(blocks: DataFrame, keys: list[str], partitions: int, turns, same_label: bool, most: int) -> DataFrame:
    """Each block's rows and then its anchors, in small groups, in one task: the first rows of the block for each window.

    ``blocks`` has ``part`` 0 for rows and others for anchors; anchors carry their windows, one for each positive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, None
        for table in grouped(batches, [*keys, "part"]):
            key = tuple(table.column(k)[0].as_py() for k in keys)
            part, width = table.column("part")[0].as_py(), table.column("width")[0].as_py()
            turn = turns.value.get(width, Rotation(None))
            ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
            v = _vectors(table.column("v"), width)
            if part == 0:
                held, rows = key, Rotated(ids, labels, v, turn)
                continue
            if held != key:
                continue  # a block without rows
            windows = table.column("windows").to_pylist()
            n = max(map(len, windows))
            low, high = (np.full((len(ids), n), x, dtype=np.int64) for x in (1, 0))
            for i, own in enumerate(windows):
                for w, one in enumerate(own):
                    low[i, w], high[i, w] = one["low"], one["high"]
            for a, w, other, score in search(Rotated(ids, labels, v, turn), rows, same_label, low, high, most):
                named = [windows[x][y] for x, y in zip(a.tolist(), w.tolist(), strict=True)]
                pairs = [pa.array([x[c] for x in named], type=pa.int64()) for c in ("positive_id", "positive_score")]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), *pairs, pa.array(other), pa.array(score)], names=["anchor_id", "positive_id", "positive_score", "other_id", "score"])

    order = [*keys, "part", "vec_id"]
    return blocks.repartition(partitions, *keys).sortWithinPartitions(*order).mapInArrow(run, _FOUND)


def _rotations(rows: DataFrame, widths: dict[int, int]) -> dict[int, Rotation]:
    """Rotations by length, each from a sample by a hash of the row; lengths share the bounds."""
    chosen, numbers = {}, 0
    for width, n in sorted(widths.items(), key=lambda x: (-x[1], x[0])):
        numbers += width * width
        if numbers > ROTATION_NUMBERS:
            break
        chosen[width] = n
    if not chosen:
        return {}
    rank = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(1 << 30))
    share = {w: min(SAMPLE, SAMPLE_NUMBERS // len(chosen) // w) for w in chosen}
    wanted = F.lit(False)
    for w, n in chosen.items():
        wanted |= (F.col("width") == w) & (rank < int(min(1.0, 1.1 * share[w] / n) * (1 << 30)))
    samples: dict[int, list] = {}
    for r in rows.where(wanted).select("v", rank.alias("r")).orderBy("r").limit(2 * sum(share.values())).collect():
        samples.setdefault(len(r["v"]), []).append(r["v"])
    return {w: rotation(np.array(v, dtype=np.int64)) for w, v in samples.items()}


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from integer vectors (vec_id, label, v).

    A row's score is its inner product with the anchor, of the same length. An anchor's positives are the first rows of
    its label, and a positive's negatives the first rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score; larger scores come first, ties by the smaller vec_id.
    The result is exact: the rotation and its sample only decide how many products are spared.

    Rows with a null vec_id, label, vector or entry take no part. Repeated rows of a vec_id count once; of rows that
    share it and differ, the one with the least label, then vector, stands for all. Vectors of different lengths never
    meet; an anchor without positives, or a positive without negatives, gives no row, and an empty table none. Entries
    whose product could leave 56 bits are a ValueError. Other columns are not read. Rows are dealt by hashes to blocks
    of bounded size, those of a hot label or of equal vectors too; anchors visit every block.
    """
    spark = vectors.sparkSession
    prepare(spark)
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"))
    named = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()))
    one = named.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    rows, path = materialise(one.withColumn("width", F.size("v")).withColumn("anchor", is_anchor), "hard-rows")
    found = rows.groupBy("width").agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).collect()
    beyond = [r["width"] for r in found if r["width"] * r["most"] ** 2 >= LARGEST_PRODUCT]
    if beyond:
        raise ValueError(f"products of the vectors of length {beyond} don't fit in 56 bits")
    widths = {r["width"]: r["n"] for r in found}
    total = sum(widths.values())
    turns = spark.sparkContext.broadcast(_rotations(rows, widths))
    size = min(MOST_ROWS, max(LEAST_ROWS, total // (4 * spark.sparkContext.defaultParallelism)))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, total // size + 1))

    def dealt(keys: list[str], asking: DataFrame, seed: int) -> DataFrame:
        """Rows by keys and block, beside the anchors with their windows, copied to every block of their keys."""
        counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("blocks")).cast("int")
        windows = asking.schema["windows"].dataType.simpleString()
        held = rows.join(counts, keys).select("width", "label", block.alias("block"), F.lit(0).alias("part"), "vec_id", "v", F.lit(None).cast(windows).alias("windows"))
        groups = asking.groupBy(*keys).agg(F.ceil(F.count("*") / ANCHORS).alias("groups"))
        part = (1 + F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("groups"))).cast("int")
        visits = asking.join(groups, keys).join(counts, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return held.unionByName(visits.select("width", "label", "block", part.alias("part"), "vec_id", "v", "windows"))

    anything = F.array(F.struct(F.lit(-LARGEST_PRODUCT).alias("low"), F.lit(LARGEST_PRODUCT).alias("high"), F.lit(None).cast("long").alias("positive_id"), F.lit(None).cast("long").alias("positive_score")))
    asking = rows.where("anchor").select("width", "label", "vec_id", "v", anything.alias("windows"))
    near = _meet(dealt(["width", "label"], asking, 3), ["width", "label", "block"], partitions, turns, True, positives)
    chosen = top_n(near, ["anchor_id"], [F.desc("score"), F.asc("other_id")], positives)
    # Below zero the window is empty.
    lowest = F.ceil(F.col("score") * low / F.lit(100).cast("decimal(3,0)")).cast("long")
    highest = F.floor(F.col("score") * high / F.lit(100).cast("decimal(3,0)")).cast("long")
    window = F.struct(lowest.alias("low"), highest.alias("high"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    listed = chosen.where(F.col("score") >= 0).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(window).alias("windows"))
    second, second_path = materialise(rows.join(listed, "vec_id").select("width", "label", "vec_id", "v", "windows"), "hard-anchors")
    far = _meet(dealt(["width"], second, 5), ["width", "block"], partitions, turns, False, negatives)
    best = top_n(far, ["anchor_id", "positive_id"], [F.desc("score"), F.asc("other_id")], negatives, rank="rank")
    out = best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return finish(out, "hard-negatives", path, second_path)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and v: floor(scale * entry), entries as doubles; rows with null or non-finite entries go."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select("vec_id", "label", v.alias("v")).where(F.col("v").isNotNull() & whole)
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))))
