"""N-gram Jaccard join by chosen paths.

Every text is the set of its five-word shingles; two sets link at a Jaccard
similarity of 0.8 or more. Sets are recursively split on sampled shared tokens
(coordinates of a min-wise embedding, chosen by a node's path) until they are
small or dense; those buckets are compared by brute force, and runs are repeated
until a linked pair is missed with a probability below ``1 - recall``. What the
buckets connect is then checked exactly, each pair of candidates once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.llm.common import discard, finish, grouped, materialise, prepare
from bidweave.llm.components import connected_components

_U = np.uint64
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15))
#: Word bytes are hashed as a polynomial in this odd base, modulo 2**64.
_BASE = 0x100000001B3


#: Rows of a table of buckets (8 bytes each) that may be broadcast.
SMALL = 200_000


@dataclass(frozen=True)
class Settings:
    """Parameters of the join."""

    words: int = 5
    similarity: float = 0.8
    recall: float = 0.99999
    coordinates: int = 64  # of the embedding
    children: int = 2  # sampled tokens a node and run
    bucket: int = 128  # larger buckets are split again
    dense: float = 0.6  # a bucket of which one child keeps this share is compared as it is
    sketch: float = 0.55  # least estimated similarity of a candidate: five deviations below 0.8
    block: int = 1024  # sets compared with as many others in one task
    block_tokens: int = 1 << 22  # tokens that such a block should hold
    sparse: int = 4  # candidate pairs a set in two blocks, up to which pairs are compared one by one

    @property
    def runs(self) -> int:
        """Runs after which a pair at the similarity is missed with a probability below 1 - recall.

        A pair survives a level if one of the sampled coordinates agrees and the pair survives below it; with each
        level the chance falls to a limit, which holds for any depth.
        """
        alive = 1.0
        for _ in range(200):
            alive = 1 - (1 - self.similarity * alive) ** self.children
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - alive)))


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> _U(30))) * _MIX[0]
    h = (h ^ (h >> _U(27))) * _MIX[1]
    return h ^ (h >> _U(31))


_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(2 * n, _BASE, dtype=np.uint64))])
    return _powers


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.

    Words are runs without ASCII white space. A text of fewer words has one shingle of all its words; null and
    blank texts have none.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    if not solid.any():
        return np.zeros(0, dtype=np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    starts, length = edge[0::2], edge[1::2] - edge[0::2]
    with np.errstate(over="ignore"):
        letters = raw[solid].astype(np.uint64) + _U(1)
        place = np.flatnonzero(solid) - np.repeat(starts, length)
        letters *= _power(int(length.max()))[place]
        h = np.add.reduceat(letters, np.concatenate([[0], np.cumsum(length[:-1])]))
        h = _mix(h + length.astype(np.uint64) * _MIX[2])
        n = max(1, len(h) - words + 1)
        out = np.zeros(n, dtype=np.uint64)
        for i in range(min(words, len(h))):
            out = _mix(out * _MIX[2] + h[i : i + n] + _U(i + 1))
        if len(h) < words:
            out = _mix(out + _U(len(h)))
    return np.unique(out)


def _seeds(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, n + 1, dtype=np.uint64) * _MIX[2])


def min_wise(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The embedding: for each seed the least mixed token."""
    out = np.full(len(seeds), _U(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(tokens), 4096):
            part = tokens[at : at + 4096, None] ^ seeds[None, :]
            part *= _MIX[0]
            part ^= part >> _U(29)
            part *= _MIX[1]
            np.minimum(out, part.min(axis=0), out=out)
    return _mix(out)


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a = _mix(tokens + _MIX[2])
        b = _mix(tokens * _MIX[1] + _U(len(tokens)))
        halves = np.array([a.sum(dtype=np.uint64) + _U(len(tokens)), b.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(_mix(b ^ a))], dtype=np.uint64)
        return _mix(halves).astype("<u8").tobytes()


def embed(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, mark, digest, n, sketch, firsts): 128 bits for the set, its size, 16 bits of each coordinate, and level-one keys.

    ``docs`` has doc_id, text and mark, which is passed on. A text of any length is one array of numbers at a time.
    """
    seeds = _seeds(s.coordinates)
    picks = _root_coordinates(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, mark in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                tokens = shingles(text.as_py(), s.words)
                if not len(tokens):
                    continue
                values = min_wise(tokens, seeds)
                with np.errstate(over="ignore"):
                    keys = _mix(values[picks[:, 1]] + (picks[:, 0] * 131 + picks[:, 1] + 1).astype(np.uint64) * _MIX[2])
                sketch = (values >> _U(48)).astype("<u2").tobytes()
                rows.append((doc_id, mark, set_key(tokens), len(tokens), sketch, keys.astype(np.int64)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "mark", "digest", "n", "sketch", "firsts"]
            )

    return docs.select("doc_id", "text", "mark").mapInArrow(run, "doc_id long, mark binary, digest binary, n int, sketch binary, firsts array<long>")


def _root_coordinates(s: Settings) -> np.ndarray:
    """(run, coordinate) of the roots' sampled tokens; runs use coordinates of their own as long as there are any."""
    order = np.random.default_rng(5).permutation(s.coordinates)
    return np.array([(r, order[(r * s.children + c) % s.coordinates]) for r in range(s.runs) for c in range(s.children)])


def _children(s: Settings, bucket: Column, used: Column, sketch: Column) -> Column:
    """A set's children below a node, as (bucket, used): coordinates are drawn by the path alone, none twice on one path."""
    free = F.filter(F.sequence(F.lit(0), F.lit(s.coordinates - 1)), lambda i: ~F.array_contains(used, i))
    out = []
    for c in range(s.children):
        # Steps of one width from a place that the path sets; the steps of one node don't meet.
        step = 1 + F.pmod(F.xxhash64(bucket, F.lit("step")), F.greatest(F.lit(1), F.floor((F.size(free) - 1) / s.children)))
        coordinate = F.element_at(free, (F.pmod(F.xxhash64(bucket) + c * step, F.size(free)) + 1).cast("int"))
        value = F.substring(sketch, 2 * coordinate + 1, 2)
        out.append(F.struct(F.xxhash64(bucket, coordinate, value).alias("bucket"), F.array_append(used, coordinate).alias("used")))
    return F.array(*out)


def _leaves(reps: DataFrame, s: Settings) -> tuple[DataFrame, list[str]]:
    """(bucket, key) of all buckets to be compared, level by level.

    A bucket of one set goes; a small one is a leaf; so is one so dense that a child would keep most of it; any
    other is split on its children's tokens. As a child holds less than ``dense`` of its parent, this ends.
    """
    found, paths = [], []
    first = F.array(*(F.lit(int(c)) for c in _root_coordinates(s)[:, 1]))
    level = reps.select("key", F.posexplode("firsts").alias("at", "bucket")).select("key", "bucket", F.array(F.element_at(first, F.col("at") + 1)).alias("used"))
    level = level.dropDuplicates(["key", "bucket"])
    while True:
        sizes = level.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
        level, path = materialise(level.join(sizes, "bucket"), "level")
        paths.append(path)
        small = (F.col("size") <= s.bucket) | (F.size("used") >= s.coordinates)
        found.append(level.where(small).select("bucket", "key"))
        large = level.where(~small)
        if large.isEmpty():
            break
        children = large.join(reps.select("key", "sketch"), "key").select(
            "key", F.col("bucket").alias("parent"), "size", F.explode(_children(s, F.col("bucket"), F.col("used"), F.col("sketch"))).alias("child")
        )
        children, path = materialise(children.select("key", "parent", "size", "child.*"), "level")
        paths.append(path)
        kept = children.groupBy("parent", "bucket", "size").agg(F.count("*").alias("k")).groupBy("parent").agg((F.max("k") >= s.dense * F.first("size")).alias("dense"))
        dense, path = materialise(kept.where("dense").select(F.col("parent").alias("bucket")), "dense")
        paths.append(path)
        if dense.count() <= SMALL:  # then the rows of a large bucket needn't meet in one task
            dense = F.broadcast(dense)
        found.append(large.join(dense, "bucket", "left_semi").select("bucket", "key"))
        level = children.join(dense.withColumnRenamed("bucket", "parent"), "parent", "left_anti").select("key", "bucket", "used").dropDuplicates(["key", "bucket"])
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, paths


def _agreeing(sketches: np.ndarray, one: np.ndarray, least: int) -> np.ndarray:
    return (sketches == one).sum(axis=-1) >= least


def _join_block(ids: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, half: int, s: Settings) -> list[tuple[int, int]]:
    """Edges that connect whatever is similar in a bucket or between its two halves (``half`` > 0).

    Rows are compared with all others one after the other, those outside the largest group first; when
    everything not yet compared is in one group, the rest can't connect anything more.
    """
    n = len(ids)
    least = math.ceil(s.sketch * s.coordinates)
    label = np.arange(n)
    edges: list[tuple[int, int]] = []
    todo = np.ones(n, dtype=bool)
    while todo.any():
        counts = np.bincount(label, minlength=n)
        main = int(counts.argmax())
        apart = todo & (label != main)
        if not apart.any():
            if counts[main] > 1:
                break
            apart = todo
        i = int(np.flatnonzero(apart)[0])
        todo[i] = False
        near = _agreeing(sketches, sketches[i], least)
        near &= np.minimum(sizes, sizes[i]) >= 0.98 * s.similarity * np.maximum(sizes, sizes[i]) - 1
        if half:
            near &= (np.arange(n) < half) != (i < half)
        near[i] = False
        new = np.flatnonzero(near & (label != label[i]))
        if len(new):
            labels, first = np.unique(label[new], return_index=True)
            edges += [(int(ids[i]), int(ids[j])) for j in new[first].tolist()]
            label[np.isin(label, labels)] = label[i]
    return edges


def _candidates(leaves: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """Spanning edges (src, dst) of each bucket's candidates. Buckets above two blocks are compared block by block."""
    blocks = F.when(F.count("*") <= 2 * s.block, 1).otherwise(F.ceil(F.count("*") / s.block))
    sizes = leaves.groupBy("bucket").agg(blocks.cast("int").alias("blocks"))
    rows = leaves.join(sizes, "bucket").join(reps.select("key", "sketch", "n"), "key")
    own = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("key", "bucket"), F.col("blocks"))).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "key", "sketch", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = math.ceil(s.sketch * s.coordinates)
        edges: list[tuple[int, int]] = []
        for table in grouped(batches, ["bucket", "a", "b"]):
            own = table.column("own").to_numpy()
            order = np.argsort(own, kind="stable")
            ids = table.column("key").to_numpy()[order]
            sketches = np.stack([np.frombuffer(x, dtype="<u2") for x in table.column("sketch").to_pylist()])[order]
            n = table.column("n").to_numpy()[order]
            if len(ids) == 2:
                if ids[0] != ids[1] and (sketches[0] == sketches[1]).sum() >= least:
                    edges.append((int(ids[0]), int(ids[1])))
            else:
                a, b = int(table.column("a")[0].as_py()), int(table.column("b")[0].as_py())
                edges += _join_block(ids, sketches, n, int((own == a).sum()) if a != b else 0, s)
            if len(edges) >= 50_000:
                yield _edges(edges)
        yield _edges(edges)

    return (
        rows.repartition("bucket", "a", "b")
        .sortWithinPartitions("bucket", "a", "b")
        .mapInArrow(run, "src long, dst long")
        .distinct()
    )


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = list(zip(*edges, strict=True)) or [(), ()]
    edges.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["src", "dst"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of all intersections: tokens on both sides become columns of two 0/1 matrices, a few thousand at a time."""
    a, b = np.concatenate(left), np.concatenate(right)
    ra, rb = np.repeat(np.arange(len(left)), list(map(len, left))), np.repeat(np.arange(len(right)), list(map(len, right)))
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    ca, cb = np.searchsorted(shared, a), np.searchsorted(shared, b)
    ia, ib = shared[np.minimum(ca, len(shared) - 1)] == a if len(shared) else ca < 0, shared[np.minimum(cb, len(shared) - 1)] == b if len(shared) else cb < 0
    ca, ra, cb, rb = ca[ia], ra[ia], cb[ib], rb[ib]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, ra, cb, rb = ca[oa], ra[oa], cb[ob], rb[ob]
    for at in range(0, len(shared), width):
        w = min(width, len(shared) - at)
        x, y = np.zeros((len(left), w), dtype=np.float32), np.zeros((len(right), w), dtype=np.float32)
        i, j = np.searchsorted(ca, [at, at + w])
        x[ra[i:j], ca[i:j] - at] = 1
        i, j = np.searchsorted(cb, [at, at + w])
        y[rb[i:j], cb[i:j] - at] = 1
        out += x @ y.T
    return out


def exact_links(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """True where the Jaccard similarity of two sets reaches the threshold (in whole numbers, without rounding)."""
    both = _overlaps(left, right).astype(np.int64)
    either = np.array(list(map(len, left)))[:, None] + np.array(list(map(len, right)))[None, :] - both
    return both * 1000 >= either * round(similarity * 1000)


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of (component, own, blocks) for every two blocks of a component, and each block alone: a <= b."""
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", *columns
    )


def _verify(groups: DataFrame, docs: DataFrame, s: Settings) -> tuple[DataFrame, list[str]]:
    """(node, links, root) from the exact comparison of all candidates, and the scratch tables that it leaves.

    ``groups`` has component, key, digest, n, sketch, rep (the doc_id of a text with that set) and copies. A group of
    one block is compared in one task. In a larger one, sketches are compared first, two blocks a task: where few
    pairs are candidates, those pairs alone are compared; where many are, the two blocks are, set against set. A row
    says how many documents link with a set in a task, and which earlier set it hangs on.
    """
    n_words = s.words
    blocks = groups.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / s.block), F.ceil(F.sum(F.col("n").cast("long")) / s.block_tokens)).cast("int").alias("blocks")
    )
    own = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("key"), F.col("blocks"))).cast("int")
    rows, rows_path = materialise(groups.join(blocks, "component").withColumn("own", own), "groups")
    texts = docs.select(F.col("doc_id").alias("rep"), F.col("text").alias("body"))
    names = ["component", "key", "copies", "own", "blocks"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), n_words) for t in batch.column(6)]
            # A doc_id may have other texts; the set tells which one is meant.
            mine = [len(x) > 0 and set_key(x) == k for x, k in zip(sets, batch.column(5).to_pylist(), strict=True)]
            tokens = pa.array([x.tobytes() for x in sets], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], tokens], names=[*names, "tokens"]).filter(pa.array(mine, type=pa.bool_()))

    def with_tokens(part: DataFrame) -> DataFrame:
        return part.join(texts, "rep").select(*names, "digest", "body").mapInArrow(cut, "component long, key long, copies long, own int, blocks int, tokens binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for table in grouped(batches, ["component", "a", "b"]):
            ids, first = np.unique(table.column("key").to_numpy(), return_index=True)
            own = table.column("own").to_numpy()[first]
            copies = table.column("copies").to_numpy()[first]
            tokens = table.column("tokens")
            sets = [np.frombuffer(tokens[i].as_py(), dtype=np.uint64) for i in first.tolist()]
            a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
            if a == b:
                hit = exact_links(sets, sets, s.similarity)
                np.fill_diagonal(hit, False)
                rows = cols = np.arange(len(ids))
            else:
                rows, cols = np.flatnonzero(own == a), np.flatnonzero(own == b)
                if not len(rows) or not len(cols):
                    continue
                hit = exact_links([sets[i] for i in rows], [sets[i] for i in cols], s.similarity)
            links = np.zeros(len(ids), dtype=np.int64)
            links[rows] += hit @ copies[cols]
            if a != b:
                links[cols] += hit.T @ copies[rows]
            root = _roots(len(ids), rows, cols, hit)
            out += [(int(ids[i]), int(links[i]), int(ids[root[i]])) for i in range(len(ids))]
            if len(out) >= 50_000:
                yield _triples(out)
        yield _triples(out)

    def compared(tasks: DataFrame) -> DataFrame:
        place = ("component", "a", "b")
        return tasks.select(*place, "own", "key", "copies", "tokens").repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "node long, links long, root long")

    found = compared(with_tokens(rows.where(F.col("blocks") == 1)).withColumns({"a": F.lit(0), "b": F.lit(0)}))
    large = rows.where(F.col("blocks") > 1)
    if large.isEmpty():
        return found, [rows_path]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = math.ceil(s.sketch * s.coordinates)
        for table in grouped(batches, ["component", "a", "b"]):
            a, b, component = (table.column(c)[0].as_py() for c in ("a", "b", "component"))
            own, ids, n = (table.column(c).to_numpy() for c in ("own", "key", "n"))
            sketches = np.stack([np.frombuffer(x, dtype="<u2") for x in table.column("sketch").to_pylist()])
            mine = np.flatnonzero(own == a)
            theirs = np.flatnonzero(own == b)
            pairs: list[tuple] = []
            for at, i in enumerate(mine.tolist()):
                rest = theirs[at + 1 :] if a == b else theirs
                near = rest[_agreeing(sketches[rest], sketches[i], least)]
                near = near[np.minimum(n[near], n[i]) >= 0.98 * s.similarity * np.maximum(n[near], n[i]) - 1]
                pairs += [(component, a, b, int(ids[i]), int(ids[j])) for j in near.tolist()]
                if len(pairs) > s.sparse * len(own):
                    pairs = [(component, a, b, None, None)]
                    break
            columns = list(zip(*pairs, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["component", "a", "b", "x", "y"])

    place = ("component", "a", "b")
    planned, planned_path = materialise(
        _dealt(large, "key", "sketch", "n").repartition(*place).sortWithinPartitions(*place).mapInArrow(sketched, "component long, a int, b int, x long, y long"), "planned"
    )
    sets, sets_path = materialise(with_tokens(large), "sets")
    dense = planned.where(F.col("x").isNull()).withColumn("own", F.explode(F.array_distinct(F.array("a", "b")))).select(*place, "own")
    found = found.unionByName(compared(dense.join(sets, ["component", "own"])))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for batch in batches:
            for x, y, nx, ny, tx, ty in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                one, two = np.frombuffer(tx, dtype=np.uint64), np.frombuffer(ty, dtype=np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                if both * 1000 >= (len(one) + len(two) - both) * round(s.similarity * 1000):
                    out += [(x, ny, min(x, y)), (y, nx, min(x, y))]
            yield _triples(out)

    side = lambda k: sets.select(F.col("key").alias(k), F.col("copies").alias(f"n{k}"), F.col("tokens").alias(f"t{k}"))
    pairs = planned.where(F.col("x").isNotNull()).select("x", "y").join(side("x"), "x").join(side("y"), "y").select("x", "y", "nx", "ny", "tx", "ty")
    return found.unionByName(pairs.mapInArrow(paired, "node long, links long, root long")), [rows_path, planned_path, sets_path]


def _roots(n: int, rows: np.ndarray, cols: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Least index reachable by the hits, by passing least labels until they rest."""
    label = np.arange(n)
    if not hit.any():
        return label
    while True:
        before = label.copy()
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            near = cols[hit[i]]
            least = min(label[rows[i]], label[near].min())
            label[rows[i]] = least
            label[near] = least
        label = label[label]
        if (before == label).all():
            return label


def _triples(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["node", "links", "root"])


def _joined(named: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, list[str]]:
    """(key, part, rep, n_links) of each class, (doc_id, mark, key) of its members, and the scratch tables both read.

    ``named`` has doc_id (not null), text and mark. Classes of one ``part`` are connected by links.
    """
    embedded, embedded_path = materialise(embed(named, s), "embedded")
    # A class is named by a number that is written with it, so that no two share one.
    classes, class_path = materialise(
        embedded.groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("firsts").alias("firsts"))
        .withColumn("key", F.monotonically_increasing_id()),
        "classes",
    )
    copies = embedded.select("doc_id", "digest").distinct().groupBy("digest").agg(F.count("*").alias("copies"))
    leaves, level_paths = _leaves(classes, s)
    edges, edge_path = materialise(_candidates(leaves, classes, s), "candidates")
    discard(named.sparkSession, *level_paths)
    candidates, candidate_path = connected_components(edges)
    groups = candidates.withColumnRenamed("node", "key").join(classes.select("key", "digest", "n", "sketch", "rep"), "key").join(copies, "digest")
    verified, group_paths = _verify(groups, named, s)
    verified, verified_path = materialise(verified, "verified")
    discard(named.sparkSession, edge_path, candidate_path, *group_paths)
    linked = verified.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "key")
    hangs = verified.where(F.col("node") != F.col("root")).select(F.col("node").alias("src"), F.col("root").alias("dst"))
    parts, parts_path = connected_components(hangs)
    by_class = (
        classes.select("key", "digest", "rep")
        .join(copies, "digest")
        .join(linked, "key", "left")
        .join(parts.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "digest", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("part"))
    )
    members = embedded.select("doc_id", "mark", "digest").distinct()
    return by_class, members, [embedded_path, class_path, verified_path, parts_path]


def jaccard_join(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document with an id: doc_id, class_id, n_links, component_id, kept.

    A class is the documents of one shingle set, named by its least doc_id; ``n_links`` counts all other
    documents at the similarity or above, copies included; components are what links connect, named by their
    least doc_id, and ``kept`` marks the document of that id. Documents without words are classes of their own
    without links. Rows of a null doc_id have no identity: they come out with null ids and are kept. Repeated
    rows of one doc_id and text count as one document, those of one doc_id and other texts as one each, if their
    shingles differ. Texts may have any length; other columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("binary").alias("mark"))
    by_class, members, paths = _joined(named.where(F.col("doc_id").isNotNull()), s)
    names = by_class.groupBy("part").agg(F.min("rep").alias("component_id"))
    with_words = (
        members.join(by_class.join(names, "part"), "digest")
        .select("doc_id", F.col("rep").alias("class_id"), "n_links", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    )
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    wordless = named.where(F.col("doc_id").isNotNull() & blank).select("doc_id", F.coalesce("text", F.lit("\x01")).alias("text")).distinct().select("doc_id")
    rest = wordless.unionByName(named.where(F.col("doc_id").isNull()).select("doc_id")).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return finish(with_words.unionByName(rest), "jaccard", *paths)


def keep_one_of_each(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents, with all their columns as they came, one of each group: that of the least doc_id (then of the least hash of the text).

    A doc_id with several texts is a document for each. Rows that repeat a doc_id and its text count once; rows
    without doc_id or words all stay. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    mark = F.unhex(F.md5(F.col("text").cast("binary")))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark.alias("mark"))
    by_class, members, paths = _joined(named.where(F.col("doc_id").isNotNull()), s)
    members = members.join(by_class.select("digest", "part"), "digest").select("part", F.struct("doc_id", "mark").alias("of"))
    stays = members.groupBy("part").agg(F.min("of").alias("stays"))
    gone = members.join(stays, "part").where(F.col("of") != F.col("stays")).select(F.col("of.doc_id").alias("_gone_id"), F.col("of.mark").alias("_gone_mark"))
    # Grows with the table, so it isn't broadcast, not even where it happens to be small.
    gone = finish(gone.distinct(), "gone", *paths).hint("merge")
    kept = docs.join(gone, (docs["doc_id"] == gone["_gone_id"]) & (F.unhex(F.md5(docs["text"].cast("binary"))) == gone["_gone_mark"]), "left_anti")
    again = docs.groupBy(docs["doc_id"].alias("_again_id")).agg(F.count("*").alias("_times")).where((F.col("_times") > 1) & F.col("_again_id").isNotNull())
    if again.isEmpty():
        return kept
    again = again.select("_again_id")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    single = kept.join(again, kept["doc_id"] == again["_again_id"], "left_anti")
    repeated = kept.join(again, kept["doc_id"] == again["_again_id"], "left_semi")
    return single.unionByName(repeated.where(worded).dropDuplicates(["doc_id", "text"])).unionByName(repeated.where(~worded))
