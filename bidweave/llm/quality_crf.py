"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; what it looks like, what its neighbours look like, and its neighbours' labels speak for
either. Only documents have labels: a document's quality is the mean of its lines' forward-backward marginals,
weighted by their lengths, and the field is trained through that mean.
"""

from __future__ import annotations

import operator
import re
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.llm.common import held_out, labelled_texts, prepare

#: Bounds of the training sample: labelled documents, in the order of a hash of their ids, characters of all their whole texts, and lines of one.
SAMPLE_DOCS = 4_000
SAMPLE_CHARS = 16_000_000
SAMPLE_LINES = 1_024
THRESHOLD = 0.7
#: A line's measures, each in so many bins with about as many training lines.
MEASURES = ("chars", "words", "word_length", "longest", "letters", "capitals", "digits", "stops", "calls", "symbols", "ends_plain", "distinct", "stutter", "seen", "ends_stop")
BINS = 12
#: Words in which distinct ones are counted, and words that are held at once of a long line.
WINDOW, HELD = 64, 8_192
#: Characters whose kinds are counted at once.
BLOCK = 1 << 20
_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _CALL, _SYMBOL = range(7)
_words = re.compile(r"\S+").finditer
_kinds: list[np.ndarray] = []


def _table() -> np.ndarray:
    """The kind of each code point, made once in a process."""
    if not _kinds:
        def kind(c: str) -> int:
            if c.isspace():
                return _SPACE
            if c.isalpha():
                return _UPPER if c.isupper() else _LOWER
            if c.isnumeric():
                return _DIGIT
            return _STOP if c in ".,;:'\"()-" else _CALL if c in "!?" else _SYMBOL

        _kinds.append(np.array([kind(chr(i)) for i in range(0x30000)] + [_SYMBOL], dtype=np.int8))
    return _kinds[0]


def _held(line: str) -> Iterator[list[str]]:
    if len(line) < BLOCK:
        yield line.split()
        return
    found = (m[0] for m in _words(line))
    while words := list(islice(found, HELD)):
        yield words


def _characters(text: str, n_lines: int) -> np.ndarray:
    """How many characters of each kind each line has."""
    table, width = _table(), 8
    out, line = np.zeros((n_lines, width)), 0
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        number = np.cumsum(codes == 10)
        found = table[np.minimum(codes, len(table) - 1)]
        out[line : line + int(number[-1]) + 1] += np.bincount(number * width + found, minlength=width * (int(number[-1]) + 1)).reshape(-1, width)
        line += int(number[-1])
    return out[:, :7]


def measure(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, weights and measures of a text's lines that have a word.

    A weight is the line's count of characters that aren't space. A text without any word is one line of weight 1.
    """
    lines = (text or "").split("\n")
    numbers: list[int] = []
    rows: list[tuple] = []
    seen: set[int] = set()
    for i, line in enumerate(lines):
        n = distinct = stutter = plain = longest = 0
        last, final = None, ""
        for words in _held(line):
            if not words:
                continue
            stutter += sum(map(operator.eq, words, islice(words, 1, None))) + (words[0] == last)
            distinct += sum(len(set(words[k : k + WINDOW])) for k in range(0, len(words), WINDOW))
            plain += sum([w[-1].isalnum() for w in words])
            longest = max(longest, max(map(len, words)))
            n += len(words)
            last = words[-1]
            final = last[-1]
        if not n:
            continue
        key = hash(line.strip())
        numbers.append(i)
        rows.append((n, longest, plain / n, distinct / n, stutter / n, float(key in seen), float(final in ".!?:;\"'")))
        seen.add(key)
    if not rows:
        return np.zeros(1, dtype=np.int64), np.ones(1), np.zeros((1, len(MEASURES)))
    at = np.array(numbers)
    kinds = _characters(text, len(lines))[at]
    n, longest, plain, distinct, stutter, repeated, final = (np.array(c, dtype=np.float64) for c in zip(*rows, strict=True))
    dark = np.maximum(kinds[:, 1:].sum(axis=1), 1)
    letters = kinds[:, _LOWER] + kinds[:, _UPPER]
    columns = (
        np.log2(dark), np.log2(n), dark / n, np.log2(longest), letters / dark, kinds[:, _UPPER] / np.maximum(letters, 1), kinds[:, _DIGIT] / dark,
        kinds[:, _STOP] / dark, kinds[:, _CALL] / dark, kinds[:, _SYMBOL] / dark, plain, distinct, stutter, repeated, final,
    )
    return at, dark, np.stack(columns, axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Model:
    """Bin edges of each measure, and the field's weights in one vector (see ``Field``); without edges it knows ``prior`` only."""

    edges: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    theta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.0


class Lines:
    """The lines of many texts, longest text first, so that those with a t-th line are always the first ones."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]], edges: np.ndarray) -> None:
        """``texts``: weights and measures of each."""
        lengths = np.array([len(w) for w, _ in texts])
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]].astype(np.int64)
        self.weights = np.concatenate([texts[i][0] for i in self.order])
        values = np.concatenate([texts[i][1] for i in self.order])
        n, k = values.shape
        bins = np.stack([np.searchsorted(edges[c], values[:, c], side="left") for c in range(k)], axis=1)
        own = bins + np.arange(k) * BINS
        first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        first[self.starts] = True
        last[self.starts + self.lengths - 1] = True
        # Places in theta: the line's own bins, the neighbours' bins, or that there is no neighbour.
        block = k * BINS
        before, after = np.full((n, k), 3 * block), np.full((n, k), 3 * block + 1)
        before[~first] = own[np.flatnonzero(~first) - 1] + block
        after[~last] = own[np.flatnonzero(~last) + 1] + 2 * block
        self.places = np.concatenate([own, before, after], axis=1)
        active = np.searchsorted(-self.lengths, -np.arange(self.lengths[0]), side="left")
        self.steps = [self.starts[:a] + t for t, a in enumerate(active)]
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        self.total = np.add.reduceat(self.weights, self.starts)


class Field:
    """The field's weights: bins, what lines without a neighbour have, four transitions, and the slope and level of the score."""

    def __init__(self, measures: int) -> None:
        self.emissions = 3 * measures * BINS + 2
        self.size = self.emissions + 6

    def start(self) -> np.ndarray:
        theta = np.zeros(self.size)
        theta[self.emissions :] = (0.5, 0.0, 0.0, 0.5, 2.0, -3.0)
        return theta

    def marginals(self, theta: np.ndarray, lines: Lines) -> tuple[np.ndarray, ...]:
        """Log-odds of good: emissions, forward and backward messages, for every line."""
        stay_bad, get_good, get_bad, stay_good = theta[self.emissions : self.emissions + 4]
        u = theta[lines.places].sum(axis=1)
        f, g = u.copy(), np.zeros_like(u)
        for now in lines.steps[1:]:
            x = f[now - 1]
            f[now] += np.logaddexp(x + stay_good, get_good) - np.logaddexp(x + get_bad, stay_bad)
        for now in reversed(lines.steps[1:]):
            v = u[now] + g[now]
            g[now - 1] = np.logaddexp(v + stay_good, get_bad) - np.logaddexp(v + get_good, stay_bad)
        return u, f, g

    def scores(self, theta: np.ndarray, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """Each document's score, in the order of ``lines``, and each line's probability of being good."""
        _, f, g = self.marginals(theta, lines)
        p = _logistic(f + g)
        mean = np.add.reduceat(p * lines.weights, lines.starts) / lines.total
        return _logistic(np.exp(theta[-2]) * mean + theta[-1]), p

    def loss(self, theta: np.ndarray, lines: Lines, good: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
        """Mean negative log-likelihood of the documents' labels with a quadratic penalty, and its gradient."""
        e = self.emissions
        stay_bad, get_good, get_bad, stay_good = theta[e : e + 4]
        u, f, g = self.marginals(theta, lines)
        p = _logistic(f + g)
        mean = np.add.reduceat(p * lines.weights, lines.starts) / lines.total
        slope = np.exp(theta[-2])
        q = np.clip(_logistic(slope * mean + theta[-1]), 1e-12, 1 - 1e-12)
        n = len(good)
        value = -np.where(good > 0, np.log(q), np.log1p(-q)).mean() + penalty * float(theta[: e + 4] @ theta[: e + 4])
        pull = (q - good) / n
        grad = np.zeros_like(theta)
        grad[-2], grad[-1] = (pull * mean).sum() * slope, pull.sum()
        inner = (pull * slope / lines.total)[lines.doc] * lines.weights * p * (1 - p)
        # Back through the forward messages, last line first.
        df = inner.copy()
        for now in reversed(lines.steps[1:]):
            x, d = f[now - 1], df[now]
            a, b = _logistic(x + stay_good - get_good), _logistic(x + get_bad - stay_bad)
            df[now - 1] += d * (a - b)
            grad[e : e + 4] += (-(d * (1 - b)).sum(), (d * (1 - a)).sum(), -(d * b).sum(), (d * a).sum())
        # And through the backward ones, first line first.
        dg, dv = inner, np.zeros_like(inner)
        for now in lines.steps[1:]:
            v, d = u[now] + g[now], dg[now - 1]
            a, b = _logistic(v + stay_good - get_bad), _logistic(v + get_good - stay_bad)
            dv[now] = d * (a - b)
            dg[now] += dv[now]
            grad[e : e + 4] += (-(d * (1 - b)).sum(), -(d * b).sum(), (d * (1 - a)).sum(), (d * a).sum())
        du = df + dv
        grad[:e] = np.bincount(lines.places.ravel(), np.repeat(du, lines.places.shape[1]), e)[:e]
        grad[: e + 4] += 2 * penalty * theta[: e + 4]
        return float(value), grad


def fit(texts: Iterable[str], good: list[int], steps: int = 250, penalty: float = 1e-3) -> Model:
    """A field whose scores make the documents' labels likely; texts of more than ``SAMPLE_LINES`` lines are passed over."""
    found, y = [], []
    for text, label in zip(texts, good, strict=True):
        if text.count("\n") < SAMPLE_LINES:
            found.append(measure(text)[1:])
            y.append(label)
    y = np.array(y, dtype=np.float64)
    prior = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(prior=prior)
    values = np.concatenate([m for _, m in found])
    edges = np.quantile(values, np.arange(1, BINS) / BINS, axis=0, method="lower").T.copy()
    lines, field_ = Lines(found, edges), Field(values.shape[1])
    y = y[lines.order]
    theta = field_.start()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, grad = field_.loss(theta, lines, y, penalty)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(edges, theta, prior)


def judge(model: Model, texts: list[str | None]) -> list[tuple[float, list[int]]]:
    """Each text's score and the numbers of its bad lines."""
    if not texts:
        return []
    if not len(model.theta):
        return [(model.prior, [])] * len(texts)
    found = [measure(t) for t in texts]
    lines = Lines([(w, m) for _, w, m in found], model.edges)
    scores, p = Field(len(MEASURES)).scores(model.theta, lines)
    out: list[tuple[float, list[int]]] = [(0.0, [])] * len(texts)
    for k, i in enumerate(lines.order.tolist()):
        start = lines.starts[k]
        bad = p[start : start + lines.lengths[k]] < 0.5
        out[i] = (float(scores[k]), found[i][0][bad].tolist())
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of labelled documents whose ids are not held out (see ``labelled_texts``).

    Documents with several labels count as good if one says so. Without both kinds of labelled texts there is nothing
    to learn: a warning says so, and every document has the share of good ones as its score (0 without labels).
    """
    texts, good = labelled_texts(docs, labels, "quality", "quality", SAMPLE_DOCS, SAMPLE_CHARS)
    if len(set(good)) < 2:
        warnings.warn("no labelled texts of both kinds to learn from: every document has the same score", stacklevel=2)
    return fit(texts, good)


#: Characters of texts that are judged side by side.
TOGETHER = 4 << 20


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the numbers of the bad lines (from 0).

    Rows are independent: nothing is shuffled, repeated rows repeat, a row without doc_id is scored as any other (and
    not held out), other columns are not read, and an empty table gives no rows. Texts are scored whole; lines without
    a word don't count, and null texts and those without any word are one empty line. A line's words are read some
    thousand at a time; memory grows with the lines of a text. A score at the threshold is good.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes = np.cumsum([0] + [len(t or "") for t in texts]) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(sizes[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                found = judge(shared.value, texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        part.column(1),
                        pa.array([s for s, _ in found], type=pa.float64()),
                        pa.array([int(s >= THRESHOLD) for s, _ in found], type=pa.int32()),
                        pa.array([bad for _, bad in found], type=pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "held_out", "score", "predicted", "bad_lines"],
                )

    schema = "doc_id long, held_out boolean, score double, predicted int, bad_lines array<int>"
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)
