"""Toxicity by multiple-instance learning.

A document is a bag of sentences and toxic if one of them is: its score is the
noisy-or of its sentences' scores. Only documents have labels; sentence scores
are learnt through the noisy-or, and then tell which sentences offend.
"""

from __future__ import annotations

import math
import re
import warnings
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.llm.common import held_out, labelled_texts, prepare

#: Bounds of the training sample: labelled documents, in the order of a hash of their ids, and characters of all their whole texts.
SAMPLE_DOCS = 6_000
SAMPLE_CHARS = 24_000_000
#: Words of the model: those in so many training documents at least whose share among toxic documents differs by so many deviations.
LEAST_DOCS = 5
LEAST_Z = 4.0
MAX_WORDS = 5_000
THRESHOLD = 0.3
SENTENCE_THRESHOLD = 0.3
_ends = re.compile(r"(?<=[.!?])[\s]+|\n+")
_word = re.compile(r"\w+").findall


@dataclass(frozen=True)
class Model:
    """Log-odds of a sentence: a bias and a weight for each feature in it; without any it does not offend."""

    bias: float = -8.0
    weights: dict[str, float] = field(default_factory=dict)


def sentences(text: str) -> list[str]:
    """Sentences of a text: cut after . ! ? before white space, and at line ends."""
    return _ends.split(text)


#: Starts of words that stand for inflected forms.
STARTS = (4, 5)


def _features(word: str) -> tuple[str, ...]:
    """A word and its starts (marked, so that they aren't taken for words)."""
    return (word, *(word[:n] + "-" for n in STARTS if len(word) >= n))


def _words(sentence: str) -> set[str]:
    return {f for word in set(_word(sentence.lower())) for f in _features(word)}


def fit(texts: list[str], toxic: list[int], steps: int = 300) -> Model:
    """Weights that maximise the likelihood of document labels under the noisy-or of sentences."""
    y = np.array(toxic, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model()
    # Sentences are taken apart twice, so that no more than one text's features and those of the vocabulary are held.
    seen, bad = Counter(), Counter()
    for text, label in zip(texts, toxic, strict=True):
        whole = _words(text)
        seen.update(whole)
        if label:
            bad.update(whole)
    rate = y.mean()
    z = {w: (bad[w] - n * rate) / math.sqrt(n * rate * (1 - rate)) for w, n in seen.items() if n >= LEAST_DOCS}
    vocabulary = sorted((w for w, v in z.items() if abs(v) >= LEAST_Z), key=lambda w: (-abs(z[w]), w))[:MAX_WORDS]
    seen, bad = Counter(), Counter()
    index = {w: i for i, w in enumerate(vocabulary)}
    doc_of, rows, cols = array("q"), array("q"), array("q")
    for d, text in enumerate(texts):
        for sentence in sentences(text):
            hits = [index[w] for w in _words(sentence) if w in index]
            if hits:
                rows.extend([len(doc_of)] * len(hits))
                cols.extend(hits)
                doc_of.append(d)
    rows_, cols_, doc_ = (np.array(x, dtype=np.int64) for x in (rows, cols, doc_of))
    theta = np.zeros(len(vocabulary) + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    penalty = 1e-4

    def logistic(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    for step in range(1, steps + 1):
        logit = theta[-1] + np.bincount(rows_, theta[cols_], len(doc_))
        p = logistic(logit)
        none = np.bincount(doc_, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        q = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
        # d(log likelihood)/d(logit of a sentence): p for toxic documents times (1-q)/q, -p for others
        pull = np.where(y > 0, (1 - q) / q, -1.0)
        g = np.zeros_like(theta)
        of_sentence = pull[doc_] * p
        g[:-1] = np.bincount(cols_, of_sentence[rows_], len(vocabulary))
        g[-1] = of_sentence.sum()
        g /= len(y)
        g[:-1] -= penalty * theta[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(float(theta[-1]), {w: float(theta[i]) for w, i in index.items()})


class Scorer:
    """Applies a model; remembers which words have features (bounded)."""

    MAX_WORDS = 300_000
    MAX_LENGTH = 48

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """A document's score and its offending sentences (number, score). Null and empty texts score 0."""
        if not text:
            return 0.0, []
        weights, bias, known = self.model.weights, self.model.bias, self.known
        none, offending = 1.0, []
        for i, sentence in enumerate(_ends.split(text)):
            hits: set[str] = set()
            for word in set(_word(sentence.lower())):
                found = known.get(word)
                if found is None:
                    found = tuple(f for f in _features(word) if f in weights)
                    if len(word) <= self.MAX_LENGTH:
                        if len(known) >= self.MAX_WORDS:
                            known.clear()
                        known[word] = found
                if found:
                    hits.update(found)
            if hits:
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(map(weights.__getitem__, sorted(hits)))))))
                none *= 1 - p
                if p >= SENTENCE_THRESHOLD:
                    offending.append((i, p))
        return min(1.0, max(0.0, 1 - none)), offending


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of labelled documents whose ids are not held out.

    Whole texts are taken, documents in the order of a hash of their ids, until ``SAMPLE_CHARS`` are full; a text that
    would not fit is passed over. Documents with several labels count as toxic if one says so; null labels, ids and
    texts are left out, and a text that repeats under its id counts once. Without both kinds of labelled texts there is
    nothing to learn: a warning says so, and the model scores 0.
    """
    texts, toxic = labelled_texts(docs, labels, "toxic", "tox", SAMPLE_DOCS, SAMPLE_CHARS)
    if len(set(toxic)) < 2:
        warnings.warn("no labelled texts of both kinds to learn from: every document scores 0", stacklevel=2)
    return fit(texts, toxic)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending sentences by number, with the worst one's score.

    Rows are independent: nothing is shuffled, repeated rows repeat, a row without doc_id is scored as any other (and
    not held out), other columns are not read, and an empty table gives no rows. Texts are scored whole, a sentence at a
    time; null and empty ones score 0, as do texts without a word of the model. A score at the threshold is toxic.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            found = [score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1),
                    pa.array([s for s, _ in found], type=pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s, _ in found], type=pa.int32()),
                    pa.array([[i for i, _ in o] for _, o in found], type=pa.list_(pa.int32())),
                    pa.array([max((p for _, p in o), default=0.0) for _, o in found], type=pa.float64()),
                ],
                names=["doc_id", "held_out", "score", "predicted", "offending", "worst"],
            )

    schema = "doc_id long, held_out boolean, score double, predicted int, offending array<int>, worst double"
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)
