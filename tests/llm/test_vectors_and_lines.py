"""Hard negatives, whitening and line quality against brute force."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidweave.llm import common, hard_negatives, quality_crf, queries, whitening

SF = "/root/testdata/sf0.001"


# --- hard negatives -----------------------------------------------------------------------------------------


def brute_negatives(rows, anchors, k=5):
    """By the definition: all scores, sorted."""
    out = []
    for a, label, v in rows:
        if a not in anchors:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in rows if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:k]:
            fit = sorted(x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, anchors):
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id").isin(*anchors)).collect()))


@pytest.mark.parametrize("kind", ["spread", "ties", "axes"])
def test_negatives_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 40)  # several blocks a label
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "TILE", 16)
    rng = np.random.default_rng(4)
    n, d = 300, 12
    v = rng.normal(size=(n, d)) * 100
    if kind == "ties":
        v = rng.integers(-2, 3, size=(n, d)).astype(float)
        v[::3] = v[0]  # a third of all rows are one vector
    if kind == "axes":
        v *= 0.2 ** np.arange(d)  # leading axes tell nearly all
    rows = [(int(i), int(rng.integers(0, 4)), [int(x) for x in np.floor(v[i])]) for i in range(n)]
    anchors = list(range(0, n, 9))
    assert mined(spark, rows, anchors) == brute_negatives(rows, set(anchors))


def test_bounds_never_rule_out_what_counts():
    rng = np.random.default_rng(8)
    v = (rng.normal(size=(400, 20)) * 1000 * 0.5 ** np.arange(20)).astype(np.int64)
    turn = hard_negatives.rotation(v[:100])
    assert turn.defect < 1e-12
    rows = hard_negatives.Rotated(np.arange(400), np.zeros(400, dtype=np.int64), v, turn)
    exact = v @ v.T
    for step, end in enumerate(rows.cuts):
        part = rows.y[:, :end] @ rows.y[:, :end].T
        bound = rows.left[:, step, None] * rows.left[None, :, step] + rows.slack * rows.norm[:, None] * rows.norm[None, :]
        assert (np.abs(exact - part) <= bound).all()
    assert (bound < 1).all()  # after the last step only rounding is left


def test_negatives_of_odd_rows(spark):
    assert mined(spark, [], [0]) == []
    # Lone anchors, one without negatives, one whose positive scores below zero.
    assert mined(spark, [(0, 1, [1, 0])], [0]) == []
    assert mined(spark, [(0, 1, [1, 0]), (1, 1, [2, 0])], [0]) == []
    assert mined(spark, [(0, 1, [1, 0]), (1, 1, [-2, 0]), (2, 2, [-1, 0])], [0]) == []
    # A positive of score 0 takes negatives of score 0; both ends of the window count.
    assert mined(spark, [(0, 1, [1, 0]), (1, 1, [0, 3]), (2, 2, [0, 1]), (3, 2, [1, 1])], [0]) == [(0, 1, 1, 2, 0, 0)]
    got = mined(spark, [(0, 1, [1]), (1, 1, [10]), (2, 2, [8]), (3, 2, [7]), (4, 2, [11]), (5, 3, [10])], [0])
    assert got == [(0, 1, 1, 5, 10, 10), (0, 1, 2, 2, 10, 8)]
    # Nulls, repeated rows, two rows of one id, and other lengths.
    rows = [(0, 1, [1, 0]), (0, 1, [1, 0]), (1, 1, [10, 0]), (1, 3, [9, 0]), (2, 2, [9, 5]), (2, 2, [9, 5]), (3, None, [9, 9]), (None, 2, [9, 9]), (4, 2, None), (5, 2, [9]), (6, 2, [9, None])]
    assert mined(spark, rows, [0, 3, 4]) == [(0, 1, 1, 2, 10, 9)]
    with pytest.raises(ValueError, match="56 bits"):
        mined(spark, [(0, 1, [1 << 30]), (1, 1, [3])], [0])
    # Clashing names of other columns.
    df = spark.createDataFrame([(0, 1, [1], 5, 6), (1, 1, [1], 5, 6), (2, 2, [1], 5, 6)], "vec_id long, label long, v array<long>, part int, score int")
    assert [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 1, 1)]


def test_quantised_rows(spark):
    df = spark.createDataFrame([(1, 1, [0.5, -0.001]), (2, 1, [float("nan")]), (3, 1, [None]), (4, 1, None), (5, 1, [float("inf")])], "vec_id long, label long, embedding array<float>")
    assert [tuple(r) for r in hard_negatives.quantised(df).collect()] == [(1, 1, [128, -1])]


# --- whitening ----------------------------------------------------------------------------------------------


def check_whitened(rows, vectors, k):
    c = np.array([v for _, v in vectors], dtype=np.float64)
    x = np.floor(1024 * c).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    want = centred @ axes / np.sqrt(e)
    ids = [i for i, _ in vectors]
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == n * k
    w = np.array([[got[i, j]["whitened"] for j in range(1, k + 1)] for i in ids])
    assert np.abs(w - want * np.sign((w * want).sum(axis=0))).max() < 1e-9
    for a, i in enumerate(ids):
        r = got[i, 1]
        assert r["n"] == n and int(r["deviation"]) == sum((n * int(p) - int(s)) ** 2 for p, s in zip(x[a], sums, strict=True))
    for j in range(k):
        assert math.isclose(got[ids[0], j + 1]["explained"], e[j] / np.trace(cov), rel_tol=1e-9)
    assert rows[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("width", [3, 24])
def test_whitening_equals_brute_force(spark, width):
    rng = np.random.default_rng(width)
    vectors = [(i, [float(x) for x in row]) for i, row in enumerate(rng.normal(size=(200, width)) @ rng.normal(size=(width, width)) + 3)]
    rows = whitening.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(7)).collect()
    check_whitened(rows, vectors, min(8, width))


def test_whitening_of_odd_rows(spark):
    def whitened(rows, extra=""):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>" + extra)).orderBy("vec_id", "component").collect()

    assert whitened([]) == [] and whitened([(1, None), (2, []), (3, [None]), (4, [float("nan")])]) == []
    assert whitened([(1, [0.5, 1.0])]) == [] and whitened([(1, [0.5]), (2, [0.5])]) == []  # no variance
    # Two dimensions in step have one component; repeated rows and null ids count.
    got = whitened([(1, [1.0, 1.0]), (1, [1.0, 1.0]), (None, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [float("inf"), 0.0])])
    assert [(r["vec_id"], r["component"], r["n"], int(r["deviation"])) for r in got] == [(i, 1, 4, 2 * 2048**2) for i in (None, 1, 1, 2)]
    assert sorted(round(abs(r["whitened"]), 9) for r in got) == [1.0] * 4 and math.isclose(got[0]["explained"], 1.0)
    with pytest.warns(UserWarning, match="other lengths than 1"):
        assert {r["vec_id"] for r in whitened([(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0])])} == {1, 2}
    with pytest.raises(ValueError, match="added up exactly"):
        whitened([(1, [1e30]), (2, [2.0])])
    # Sums of squares beyond a long are whole.
    far = whitened([(1, [2.0**40]), (2, [-(2.0**40)])], "")
    assert int(far[0]["deviation"]) == 4 * (2**50) ** 2 and far[0]["n"] == 2
    clash = spark.createDataFrame([(1, [1.0], 3, 4), (2, [2.0], 3, 4)], "vec_id long, embedding array<double>, n int, component int")
    assert whitening.whiten(clash).count() == 2


def test_long_deviations_are_exact():
    m = np.array([[3, -4, 5], [(1 << 40) + 1, 7, -(1 << 41)]], dtype=np.int64)
    r = np.array([1, 0, 2], dtype=np.int64)
    for n in (7, 10**12):
        assert whitening.deviations(m, n, r) == [sum((n * int(x) - int(y)) ** 2 for x, y in zip(row, r, strict=True)) for row in m]


# --- line quality -------------------------------------------------------------------------------------------


def brute_marginals(u, a):
    """P(line is good) by all labellings; ``a[i][j]`` is the weight of j after i."""
    total, good = 0.0, [0.0] * len(u)
    for code in range(1 << len(u)):
        y = [code >> t & 1 for t in range(len(u))]
        p = math.exp(sum(x for x, k in zip(u, y, strict=True) if k) + sum(a[i][j] for i, j in zip(y, y[1:], strict=False)))
        total += p
        good = [g + p * k for g, k in zip(good, y, strict=True)]
    return [g / total for g in good]


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(2)
    texts = [(np.ones(n), rng.normal(size=(n, 2))) for n in (1, 5, 3, 5)]
    edges = np.sort(rng.normal(size=(2, quality_crf.BINS - 1)), axis=1)
    lines, field = quality_crf.Lines(texts, edges), quality_crf.Field(2)
    theta = rng.normal(size=field.size) * 0.5
    u, f, g = field.marginals(theta, lines)
    a = theta[field.emissions : field.emissions + 4].reshape(2, 2)
    for start, n, i in zip(lines.starts, lines.lengths, lines.order, strict=True):
        values = texts[i][1]
        bins = [[int(np.searchsorted(edges[c], row[c], side="left")) for c in range(2)] for row in values]
        block = 2 * quality_crf.BINS
        want = []
        for t in range(n):
            own = sum(theta[c * quality_crf.BINS + b] for c, b in enumerate(bins[t]))
            before = sum(theta[block + c * quality_crf.BINS + b] for c, b in enumerate(bins[t - 1])) if t else 2 * theta[3 * block]
            after = sum(theta[2 * block + c * quality_crf.BINS + b] for c, b in enumerate(bins[t + 1])) if t + 1 < n else 2 * theta[3 * block + 1]
            want.append(own + before + after)
        assert np.allclose(u[start : start + n], want)
        assert np.allclose(1 / (1 + np.exp(-(f + g)[start : start + n])), brute_marginals(want, a))


def test_training_follows_its_gradient():
    rng = np.random.default_rng(3)
    texts = [(rng.integers(1, 9, n).astype(float), rng.normal(size=(n, 2))) for n in (1, 4, 2, 6, 3)]
    edges = np.sort(rng.normal(size=(2, quality_crf.BINS - 1)), axis=1)
    lines, field = quality_crf.Lines(texts, edges), quality_crf.Field(2)
    theta, good = rng.normal(size=field.size) * 0.3, np.array([1.0, 0, 1, 0, 1])
    _, grad = field.loss(theta, lines, good, 0.01)
    for k in range(field.size):
        step = np.zeros(field.size)
        step[k] = 1e-5
        slope = (field.loss(theta + step, lines, good, 0.01)[0] - field.loss(theta - step, lines, good, 0.01)[0]) / 2e-5
        assert abs(slope - grad[k]) < 1e-7


def test_measures_of_lines(monkeypatch):
    text = "The cat sat.\n\n  \nTHE!! CAT!! 42\nthe the the a\nThe cat sat."
    at, weights, m = quality_crf.measure(text)
    name = {k: i for i, k in enumerate(quality_crf.MEASURES)}
    assert at.tolist() == [0, 3, 4, 5] and weights.tolist() == [10, 12, 10, 10]
    assert m[:, name["seen"]].tolist() == [0, 0, 0, 1] and m[:, name["ends_stop"]].tolist() == [1, 0, 0, 1]
    assert m[1, name["calls"]] == 4 / 12 and m[1, name["capitals"]] == 1 and m[1, name["digits"]] == 2 / 12
    assert m[2, name["distinct"]] == 0.5 and m[2, name["stutter"]] == 0.5
    # Long lines are read in parts, with the same measures, bar where windows of words are cut.
    monkeypatch.setattr(quality_crf, "BLOCK", 7)
    monkeypatch.setattr(quality_crf, "HELD", quality_crf.WINDOW)
    for a, b in zip(quality_crf.measure(text), (at, weights, m), strict=True):
        assert np.array_equal(a, b)
    long = "word " * 1000 + "\n" + "Ünï \U0001f600 x\n" * 50
    part = quality_crf.measure(long)
    monkeypatch.setattr(quality_crf, "BLOCK", 1 << 20)
    for a, b in zip(part, quality_crf.measure(long), strict=True):
        assert np.array_equal(a, b)


def test_scores_do_not_depend_on_the_batch(spark):
    rng = random.Random(1)
    good = ["\n".join(" ".join(rng.choice(["road", "tree", "house", "stone"]) for _ in range(9)) + "." for _ in range(rng.randint(1, 5))) for _ in range(40)]
    bad = [t.upper().replace(" ", "!! ") for t in good]
    model = quality_crf.fit(good + bad, [1] * 40 + [0] * 40)
    texts = [*good[:5], *bad[:5], "", None, " \n ", "x" * 3_000_000, "line\n" * 20_000]
    alone = [quality_crf.judge(model, [t])[0] for t in texts]
    assert [s for s, _ in quality_crf.judge(model, texts)] == pytest.approx([s for s, _ in alone])
    assert all(s > 0.7 for s, _ in alone[:5]) and all(s < 0.3 for s, _ in alone[5:10]) and alone[10] == alone[11] == alone[12]
    mixed = quality_crf.judge(model, [good[0] + "\n" + bad[1]])[0]
    assert mixed[1] and min(mixed[1]) > good[0].count("\n")  # bad lines are told
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1), (0, texts[0], 1)], "doc_id long, text string, score int")
    got = quality_crf.score_documents(df, model).collect()
    assert [r["score"] for r in got] == pytest.approx([s for s, _ in alone] + [alone[10][0], alone[0][0]])
    assert quality_crf.score_documents(df.limit(0), model).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    with pytest.warns(UserWarning, match="nothing|no labelled"):
        model = quality_crf.train(docs, labels)
    assert {r["score"] for r in quality_crf.score_documents(docs, model).collect()} == {1.0}
    with pytest.warns(UserWarning, match="no labelled"):
        assert quality_crf.train(docs, labels.limit(0)).prior == 0.0


def test_held_out_quality(spark):
    sf = SF.replace("0.001", "0.01")
    rows = {r["doc_id"]: r for r in queries.op13_quality_crf(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = {i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    assert len(rows) == 1000 and all(rows[i]["held_out"] for i in held)
    right = [rows[i]["predicted"] == labels[i] for i in held]
    assert len(right) > 80 and sum(right) >= 0.95 * len(right)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows.values())


def test_labelled_texts_are_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(40)] + [(3, "xxxx"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    texts, marks = common.labelled_texts(docs, labels, "quality", "s", 1000, 200)
    assert sum(map(len, texts)) <= 200 and len(set(texts)) == len(texts) > 5
    assert all(m == (len(t) - 1) % 2 for t, m in zip(texts, marks, strict=True))
    assert all(zlib.crc32(str(len(t) - 1).encode()) % 4 != 2 for t in texts)
